"""Repeated and nearly repeated lines, by a deletion-neighbourhood join in DataFrame operations only.

A line's words are what single spaces separate. Its earliest place is the
smallest (doc_id, line number). A line is dropped if an equal line, or one
within its edit bound, stands earlier; whether that one is dropped itself does
not matter. The bound is one word edit (a word put in, left out or exchanged)
for lines of ``fuzzy_words`` words and more, an eighth of the shortest, and
none for shorter ones, of which one word in seven is no near copy. Lines of
spaces alone are layout and stay.

Equal lines fall together first, by 128 bits of hash, with partial aggregation.
A line of n words then has n variants with one word deleted. Two lines with the
same variant at the same place differ by an exchange, a line that equals
another's variant by a word put in or left out. All lines of such a group are
within the bound of one another or of the one whole line, so the group's
earliest place is all that its members need: groups are aggregated, never
paired. The hash of a line is the xor of hashes of (place, word), so each
variant's hash takes one step. Partners are then verified word by word.

Not all variants can meet another. Of two lines within one edit, where the
longer has m words, either the first floor(m / 2) or the last m - floor(m / 2)
words agree, and the edit is in the other part. So lines are hashed by these
parts first, and a line emits the variants of a part only if some line shares
the other part; lines that share none emit nothing. This is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.tables import discard, materialize, maybe_broadcast, private

MIN_CHARS, FUZZY_WORDS = 1, 8
#: Places of lines (16 bytes), or keys of variants, that may be sent to every task; more are joined by a shuffle.
BROADCAST_LINES, BROADCAST_KEYS = 400_000, 1_000_000


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line_no, line)"""
    return docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split(F.col("text").cast("string"), "\n", -1)).alias("line_no", "line"))


def _parts() -> Column:
    """Keys of the parts by which partners are met, as (key, role): f and l for the first and the last part of a pair whose longer line has this line's words, w for those with one word more."""
    key = lambda m, n, part: f"xxhash64('{part}', {m}, substring_index(line, ' ', {n}))"
    own = [("n", "n div 2", "first", "f"), ("n", "-(n - n div 2)", "last", "l"), ("(n + 1)", "(n + 1) div 2", "first", "w"), ("(n + 1)", "-(n + 1 - (n + 1) div 2)", "last", "w")]
    return F.expr("array(" + ", ".join(f"named_struct('key', {key(m, n, part)}, 'role', '{role}')" for m, n, part, role in own) + ")")


def _hashed(docs: DataFrame, min_chars: int, fuzzy_words: int) -> DataFrame:
    """A shared table of the lines that are not blank, of ``min_chars`` characters and more: doc, line_no, h, g, n and the keys of their parts, null below ``fuzzy_words`` words."""
    lines = _lines(docs).where((F.length("line") >= min_chars) & (F.trim("line") != "")).withColumn("n", F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1)
    return materialize(lines.select("doc", "line_no", "n", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), F.when(F.col("n") >= fuzzy_words, _parts()).alias("parts")), "lines")


def _edit_partners(first: DataFrame, docs: DataFrame) -> DataFrame:
    """(h, g) of distinct lines that have an earlier line within one edit."""
    keys = first.where("parts is not null").select("h", "doc", "line_no", F.explode("parts").alias("p")).select("h", "doc", "line_no", "p.key", "p.role")
    shared = keys.groupBy("key").agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low <> high").select("key")
    roles = [F.max(F.col("role") == r).alias(r) for r in "flw"]
    places = materialize(keys.join(shared, "key", "left_semi").groupBy("h", "doc", "line_no").agg(*roles), "near-places")
    sent = maybe_broadcast(places.select(F.col("doc").alias("p_doc"), F.col("line_no").alias("p_no"), "f", "l", "w"), BROADCAST_LINES)
    lines = _lines(docs)
    near = lines.join(sent, lines["doc"].eqNullSafe(sent["p_doc"]) & (lines["line_no"] == sent["p_no"]))
    near = near.select(F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("g"), "doc", "line_no", F.split("line", " ", -1).alias("words"), "f", "l", "w")
    near = materialize(near.dropDuplicates(["h", "g"]), "near-words")

    here = F.transform("words", lambda w, i: F.xxhash64(i, w))
    moved = F.transform("words", lambda w, i: F.xxhash64(i - 1, w))
    marked = near.select("h", "g", F.struct("doc", "line_no").alias("at"), F.size("words").alias("n"), "f", "l", "w", here.alias("x"), F.when(F.col("f") | F.col("l"), moved).alias("y"))
    marked = marked.withColumns({"whole": F.expr("aggregate(x, 0L, (a, v) -> a ^ v)"), "shifted": F.expr("aggregate(y, 0L, (a, v) -> a ^ v)")})
    # without word i: words before it stay, words after it move by one
    marked = marked.withColumn("without", F.when(F.col("f") | F.col("l"), F.expr(_WITHOUT)))
    swap = "named_struct('key', xxhash64('swap', n, i, whole ^ x[i]), 'role', 's')"
    gap = "named_struct('key', xxhash64('gap', n - 1, without[i]), 'role', 'l')"
    places_of = "sequence(if(l, 0, n div 2), if(f, n - 1, n div 2 - 1))"
    emitted = f"""concat(if(f or l, flatten(transform({places_of}, i -> array({swap}, {gap}))), array()),
        if(w, array(named_struct('key', xxhash64('gap', n, whole), 'role', 'w')), array()))"""
    variants = marked.select("h", "g", "at", F.explode(F.expr(emitted)).alias("v")).select("v.key", "v.role", "h", "g", "at")
    crowded = materialize(variants.select("key").groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key"), "variant-keys")
    meeting = materialize(variants.join(maybe_broadcast(crowded, BROADCAST_KEYS), "key"), "met-variants")
    least = lambda role: F.min(F.when(F.col("role") == role, F.struct("at", "h", "g"))).alias(f"by_{role}")
    met = meeting.join(meeting.groupBy("key").agg(least("s"), least("l"), least("w")), "key")
    met = met.withColumn("by", F.when(F.col("role") == "s", F.col("by_s")).when(F.col("role") == "l", F.col("by_w")).otherwise(F.col("by_l")))
    pairs = met.where(F.col("by.at") < F.col("at")).select("h", "g", F.col("by.h").alias("h2"), F.col("by.g").alias("g2")).distinct()
    other = near.select(F.col("h").alias("h2"), F.col("g").alias("g2"), F.col("words").alias("words2"))
    both = pairs.join(near.select("h", "g", "words"), ["h", "g"]).join(other, ["h2", "g2"]).withColumns({"n": F.size("words"), "n2": F.size("words2")})
    out = materialize(both.where(F.expr(_WITHIN_ONE)).select("h", "g").distinct(), "edited")
    discard(places, near, crowded, meeting)
    return out


#: Hash of a line's n words without word i, for each i: the words before i in their places (x), those after i one place on (y).
#: Long lines take it from sums by runs of about the square root of n words, so no array is built up word by word.
_FOLD = "aggregate({}, 0L, (a, v) -> a ^ v)"
_RUNS = f"""transform(array(cast(ceil(sqrt(n)) as int)), w -> transform(array(transform(sequence(0, n - 1, w), b -> {_FOLD.format("zip_with(slice(x, b + 1, w), slice(y, b + 1, w), (p, q) -> p ^ q)")})), runs ->
    flatten(transform(sequence(0, size(runs) - 1), r -> transform(array(shifted ^ {_FOLD.format("slice(runs, 1, r)")}), before ->
      transform(sequence(r * w, least(r * w + w, n) - 1), i -> before ^ y[i] ^ {_FOLD.format("zip_with(slice(x, r * w + 1, i - r * w), slice(y, r * w + 1, i - r * w), (p, q) -> p ^ q)")}))[0])))[0])[0]"""
_WITHOUT = f"if(n > 64, {_RUNS}, aggregate(sequence(1, n - 1), array(shifted ^ y[0]), (acc, j) -> array_append(acc, acc[j - 1] ^ x[j - 1] ^ y[j])))"

#: words and words2 are one word edit apart at most
_WITHIN_ONE = """CASE
  WHEN n = n2 THEN size(filter(arrays_zip(words, words2), p -> p.words <> p.words2)) <= 1
  WHEN n = n2 + 1 THEN exists(sequence(0, n - 1), i -> words[i] is distinct from get(words2, i) and concat(slice(words, 1, i), slice(words, i + 2, n)) = words2)
  WHEN n2 = n + 1 THEN exists(sequence(0, n2 - 1), i -> words2[i] is distinct from get(words, i) and concat(slice(words2, 1, i), slice(words2, i + 2, n2)) = words)
  ELSE false END"""


def repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, fuzzy_words: int = FUZZY_WORDS) -> DataFrame:
    """(doc, lines): the numbers, from 0, of the lines to drop of each document that has some. Null texts have no lines; a null doc_id is the earliest; rows that repeat a doc_id are one document."""
    hashed = _hashed(docs, min_chars, fuzzy_words)
    place = F.struct("doc", "line_no")
    first = hashed.groupBy("h", "g").agg(F.min(place).alias("at"), F.max(place).alias("upto"), F.first("parts").alias("parts"))
    first = materialize(first.select("h", "g", "at.doc", "at.line_no", (F.col("at") != F.col("upto")).alias("again"), "parts"), "first-lines")
    edited = _edit_partners(first, docs)
    equal = first.where("again").select("h", "g", F.col("doc").alias("f_doc"), F.col("line_no").alias("f_no"))
    known = equal.join(edited.withColumn("edited", F.lit(True)), ["h", "g"], "left")
    later = hashed.select("h", "g", "doc", "line_no").join(known, ["h", "g"]).where(~(F.col("doc").eqNullSafe(F.col("f_doc")) & (F.col("line_no") == F.col("f_no"))) | F.col("edited"))
    alone = first.where("not again").join(edited, ["h", "g"], "left_semi")
    gone = later.select("doc", "line_no").unionByName(alone.select("doc", "line_no")).groupBy("doc").agg(F.collect_set("line_no").alias("lines"))
    gone = materialize(gone, "dropped-lines")
    discard(hashed, first, edited)
    return gone


#: The lines of p_lines whose numbers are not in p_gone, both as arrays; linear, as the numbers are taken away as a set.
_KEPT = "array_join(transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> {lines}[i]), '\n')"


def without_repeated_lines(docs: DataFrame, min_chars: int = MIN_CHARS, fuzzy_words: int = FUZZY_WORDS, count: str = "lines_dropped") -> DataFrame:
    """``docs`` with all columns, the text without its repeated lines, and their number as ``count``, with an underscore before it where ``docs`` has such a column. Texts without lines to drop, null texts too, stay as they are."""
    count, p_doc, p_gone, p_lines = private(docs, count, "gone_doc", "gone_lines", "all_lines")
    gone = repeated_lines(docs, min_chars, fuzzy_words).select(F.col("doc").alias(p_doc), F.col("lines").alias(p_gone))
    joined = docs.join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col(p_doc)), "left")
    kept = F.expr(f"transform(array(split(cast(text as string), '\n', -1)), {p_lines} -> {_KEPT.format(lines=p_lines, gone=p_gone)})[0]")
    text = F.when(F.col(p_gone).isNull(), F.col("text").cast("string")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], F.coalesce(F.size(p_gone), F.lit(0)).alias(count))


def drop_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents with their columns, repeated lines taken out and n_chars, if it is there, counted anew; documents of which no word is left go. Null, empty and blank texts have no lines to drop and stay; of rows that share a doc_id and text all keep the same lines."""
    (dropped,) = private(docs, "lines_dropped")
    out = without_repeated_lines(docs, count=dropped)
    out = out.where((F.col(dropped) == 0) | F.col("text").rlike(r"[^\x09-\x0D\x20]"))
    counted = lambda: F.when(F.col(dropped) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*[counted() if c == "n_chars" else c for c in docs.columns])
