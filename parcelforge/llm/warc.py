"""WARC archives written and read by Spark alone.

Writing: a record is one string, and the text writer's line separator is the
blank line pair that ends a record, so part files are WARC files.

Reading: the text reader cuts the files at every occurrence of the magic, in
byte ranges, so magic inside payloads makes false fragments. Each task adds up
the lengths of its fragments, parses each as a header and emits the candidate's
offset, its successor's offset and where the chain from it leaves the block.
Block sums give the offsets in the file. Pointer jumping over the blocks' exits
from offset 0 finds the one entry of each block; candidates that the chain from
the entry does not reach are payload, and join the record before them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.llm.tables import fresh_path, in_batches, join_counted, materialize, maybe_broadcast

#: What a record begins with: the format's name and the version up to its last digit, so records of 1.0 and 1.1 are read.
MAGIC, VERSION, END = "WARC/1.", "1\r\n", "\r\n\r\n"
#: Records of a part file at most.
FILE_RECORDS = 20_000
#: Revisits (64 bytes each) that may be sent to every task; more are joined by a shuffle.
BROADCAST_REVISITS = 500_000


def base32_sha1(payload):
    """Bare upper-case base32 of the SHA-1 of a column."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_warc(pages: DataFrame, path: str, revisit_from: int = 0) -> None:
    """One record per row of (page_id, url, html); a null html is empty, a null url ``urn:unknown``.

    Of rows with equal payloads of at least ``revisit_from`` bytes the largest
    page_id is the response, the others are revisit records without a block
    that refer to it; rows of that page_id and payload that repeat are
    responses too. Rows that share a page_id but not the payload are records
    of their own, each judged by its payload. Rows without page_id are
    responses.
    """
    rows = pages.select(F.col("page_id").cast("long"), F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("urn:unknown")), r"[\r\n]", "%0A").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    length = F.octet_length("html")
    rows = rows.withColumns({"digest": F.sha1("html"), "n": length})
    digests = rows.where("page_id is not null").select("page_id", "digest", "n").where(F.col("n") >= revisit_from).distinct()
    first = digests.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    first = materialize(first, "copied-payloads")
    revisits = materialize(join_counted(digests, first, ["digest", "n"], "copies").where("page_id <> refers_to").select("page_id", "digest", "n", "refers_to"), "revisits")
    rows = rows.join(maybe_broadcast(revisits, BROADCAST_REVISITS), ["page_id", "digest", "n"], "left")
    revisit = F.col("refers_to").isNotNull()
    uri = lambda c: F.concat(F.lit("<urn:page:"), c, F.lit(">"))
    record = F.concat(
        F.lit(MAGIC + VERSION + "WARC-Type: "),
        F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "),
        uri(F.coalesce(F.col("page_id").cast("string"), F.lit("-"))),
        F.lit("\r\nWARC-Target-URI: "),
        F.col("url"),
        F.lit("\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: text/html; charset=utf-8\r\nWARC-Payload-Digest: sha1:"),
        base32_sha1(F.col("html")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), uri(F.col("refers_to").cast("string")))).otherwise(""),
        F.lit("\r\nContent-Length: "),
        F.when(revisit, F.lit(0)).otherwise(length).cast("string"),
        F.lit("\r\n\r\n"),
        F.when(revisit, "").otherwise(F.col("html")),
    )
    rows.select(record.alias("value")).write.option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse_header(fragment: bytes) -> tuple[dict[str, str], int] | None:
    """Header fields, lower-case names, and the length of the header with its blank line; None if it is no record header. The fragment begins with the version's last digit."""
    end = fragment.find(b"\r\n\r\n")
    if end < 0 or not re.match(rb"\d\r\n", fragment):
        return None
    fields = {}
    for line in fragment[3:end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
    n = fields.get("content-length", "")
    if not (n.isascii() and n.isdigit() and "warc-type" in fields and "warc-record-id" in fields):
        return None
    return fields, end + 4


FRAGMENTS = (
    "file string, block long, number long, start long, length long, successor long, leave long, header long, content long, "
    "kind string, record_id string, url string, refers_to string, stated string, digest string"
)


def _fragments(path: str, spark) -> DataFrame:
    cut = in_batches(spark.read.option("lineSep", MAGIC).text(path))
    return cut.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value"))


def _walked(fragments: DataFrame) -> DataFrame:
    """Fragments with offsets relative to the first fragment of their block. ``start`` is where the magic before the fragment begins; ``leave`` the first offset of its chain that is not in the block."""
    import base64
    import hashlib

    magic, schema = len(MAGIC), FRAGMENTS

    def finish(file, block, rows):
        at = {r["start"]: i for i, r in enumerate(rows)}
        for r in reversed(rows):  # successors are further on
            s = r["successor"]
            r["leave"] = None if s is None else (rows[at[s]]["leave"] if s in at else s)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.string() if x.endswith("string") else pa.int64() for x in schema.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names=names)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, offset = None, [], 0
        for batch in batches:
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (file, block) != place:
                    if rows:
                        yield finish(*place, rows)
                    place, rows, offset = (file, block), [], 0
                text = value.as_py()
                row = {"file": file, "block": block, "number": len(rows), "start": offset - magic, "length": len(text) + magic, "successor": None, "leave": None}
                row |= dict.fromkeys(("header", "content", "kind", "record_id", "url", "refers_to", "stated", "digest"))
                if found := parse_header(text):
                    fields, header = found
                    n = int(fields["content-length"])
                    row |= {"header": header, "content": n, "successor": row["start"] + magic + header + n + 4, "kind": fields["warc-type"], "record_id": fields["warc-record-id"], "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"), "stated": fields.get("warc-payload-digest")}
                    if header + n <= len(text):
                        row["digest"] = base64.b32encode(hashlib.sha1(text[header : header + n]).digest()).decode()
                rows.append(row)
                offset += len(text) + magic
        if rows:
            yield finish(*place, rows)

    return fragments.mapInArrow(walk, schema)


def _bases(fragments: DataFrame) -> DataFrame:
    """(file, block, base): where the first fragment of each block begins. The blocks of one file are few: its bytes over the split size."""
    sums = fragments.groupBy("file", "block").agg(F.sum("length").alias("bytes"))
    return sums.select("file", "block", F.coalesce(F.expr("sum(bytes) over (partition by file order by block rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("base"))


def reachable(candidates: DataFrame) -> DataFrame:
    """(file, entry): offsets where the chain from the start of a file enters its blocks, by pointer jumping over ``leave``; candidates have file, start, leave."""
    spark = candidates.sparkSession
    jump = candidates.where("leave is not null").select("file", "start", "leave")
    seen = candidates.where("start = 0").select("file", F.col("start").alias("entry")).distinct()
    while True:
        # all offsets within 2^k jumps of the start are seen after k rounds
        step = seen.join(jump, (seen["file"] == jump["file"]) & (seen["entry"] == jump["start"])).select(seen["file"], F.col("leave").alias("entry"))
        grown = materialize(seen.unionByName(step).distinct(), "reached")
        twice = jump.alias("a").join(jump.alias("b"), F.expr("a.file = b.file and a.leave = b.start"), "left").select("a.file", "a.start", F.coalesce("b.leave", "a.leave").alias("leave"))
        if grown.count() == seen.count():
            return grown
        seen, jump = grown, materialize(twice, "jumps")


def read_warc(spark, path: str) -> DataFrame:
    """The records of the archives in ``path``: file, start, kind, record_id, url, refers_to, content (length of the block), digest (base32 SHA-1 of the block), payload_digest (as the header states)."""
    walked = materialize(_walked(_fragments(path, spark)), "candidates")
    base = _bases(walked)
    shift = lambda c: (F.col(c) + F.col("base")).alias(c)
    placed = walked.join(base, ["file", "block"])
    plain = [c for c in walked.columns if c not in ("start", "successor", "leave")]
    placed = placed.select(*plain, shift("start"), shift("successor"), shift("leave"))
    candidates = materialize(placed.where("start >= 0"), "placed")
    entries = reachable(candidates.where("successor is not null"))
    heads = candidates.join(entries, (candidates["file"] == entries["file"]) & (candidates["start"] == entries["entry"]), "left_semi").select("file", "block", F.col("start").alias("entry"))

    def follow(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        rows = batch.sort_by("start")
        start, after = rows.column("start").to_pylist(), rows.column("successor").to_pylist()
        at, owner, due = -1, [], rows.column("entry")[0].as_py()
        for s, nxt in zip(start, after, strict=True):
            if s == due:
                at, due = s, nxt
            owner.append(at)
        return pa.table({"file": rows.column("file"), "start": rows.column("start"), "owner": pa.array(owner, pa.int64())})

    own = candidates.select("file", "block", "start", "successor").join(heads, ["file", "block"]).groupBy("file", "block").applyInArrow(follow, "file string, start long, owner long")
    records = own.where("owner = start").select("file", "start").join(candidates, ["file", "start"])
    records = materialize(records.select("file", "start", "length", "header", "content", "kind", "record_id", "url", "refers_to", "stated", "digest"), "records")
    split = records.where("digest is null")
    if split.isEmpty():
        done = records
    else:
        done = records.where("digest is not null").unionByName(_digest_split(spark, path, split))
    return done.select("file", "start", "kind", "record_id", "url", "refers_to", "content", "digest", F.regexp_replace("stated", "^sha1:", "").alias("payload_digest"))


def _digest_split(spark, path: str, split: DataFrame) -> DataFrame:
    """Records whose payload holds the magic: their pieces are read again and put together, record by record."""
    import base64
    import hashlib

    magic = MAGIC.encode()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, offset = None, 0
        for batch in batches:
            starts, sizes = [], []
            for file, block, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if (file, block) != place:
                    place, offset = (file, block), 0
                starts.append(offset - len(magic))
                sizes.append(len(value.as_buffer()) + len(magic))
                offset += sizes[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["file", "block", "value", "start", "length"])

    # splits may differ from the first reading's, so these blocks are summed anew
    read = _fragments(path, spark).mapInArrow(lengths, "file string, block long, value binary, start long, length long")
    read = materialize(read.join(maybe_broadcast(split.select("file").distinct(), 10_000), "file", "left_semi"), "pieces")
    pieces = read.join(_bases(read), ["file", "block"]).select("file", (F.col("start") + F.col("base")).alias("at"), "value")
    spans = split.select("file", F.col("start").alias("from"), (F.col("start") + len(MAGIC) + F.col("header") + F.col("content")).alias("to"))
    # bins of 64 KB make the range join an equality join
    bins = F.explode(F.sequence(F.floor(F.col("from") / 65536), F.floor(F.col("to") / 65536)))
    found = pieces.withColumn("bin", F.floor(F.col("at") / 65536)).join(spans.withColumn("bin", bins), ["file", "bin"]).where("at >= from and at < to")

    def join(key: tuple[pa.Scalar, ...], batch: pa.Table) -> pa.Table:
        rows = batch.sort_by("at")
        whole = magic.join(rows.column("value").to_pylist())
        header, content = rows.column("header")[0].as_py(), rows.column("content")[0].as_py()
        digest = base64.b32encode(hashlib.sha1(whole[header : header + content]).digest()).decode()
        return pa.table({"file": [key[0].as_py()], "start": [key[1].as_py()], "digest": [digest]})

    need = split.select("file", F.col("start").alias("from"), "header", "content")
    digests = found.join(need, ["file", "from"]).select("file", "from", "at", "value", "header", "content").groupBy("file", "from").applyInArrow(join, "file string, start long, digest string")
    return split.drop("digest").join(digests, ["file", "start"])


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back, and resolve revisits: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Empty tables give no rows; a row that repeats is a record of its own, and
    so is each of several payloads of one page_id. A revisit's figures are
    those of the response that its header names, by id and payload digest.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path)
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    records = materialize(records.select(number("record_id").alias("page_id"), number("refers_to").alias("refers_to"), "kind", "content", "digest", "payload_digest"), "read")
    own = records.where("kind <> 'revisit'").select("page_id", F.col("content").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    revisits = records.where("kind = 'revisit'").select("page_id", "refers_to", "payload_digest")
    keys = ["refers_to", "payload_digest"]
    held = own.where("page_id is not null").select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").dropDuplicates(keys)
    asked = revisits.groupBy(*keys).agg(F.count("*").alias("copies"))
    held = materialize(held.join(asked, keys), "revisited")
    back = join_counted(revisits, held, keys, "copies").select("page_id", "payload_bytes", "payload_digest", F.lit("revisit").alias("record_type"), "refers_to")
    return own.unionByName(back)
