"""Similarity of texts, as Arrow-batched pandas UDFs; 0 to 100, and 0 where a side is null.

``ratio`` is the normalised indel similarity, 200 * LCS / (len a + len b). It is
not Spark's ``levenshtein``: an exchange counts as two edits.
"""

from __future__ import annotations

import difflib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one machine integer as the row of bits."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        u = row & places.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def indel(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def best_window(a: str, b: str) -> float:
    """The best ``indel`` of the shorter text with a window of its length in the longer one, shorter windows at the ends included."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    return max(indel(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def sorted_words(a: str, b: str) -> float:
    return indel(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def word_sets(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    one, other = (" ".join(filter(None, (both, " ".join(sorted(s))))) for s in (x - y, y - x))
    return max(indel(one, other), *([indel(both, one), indel(both, other)] if both else []))


def blocks_ratio(a: str, b: str) -> float:
    return 100.0 * difflib.SequenceMatcher(None, a, b).ratio()


def _as_udf(score):
    @F.pandas_udf(T.DoubleType())
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple[str, str], float] = {}
        out = np.zeros(len(a))
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            if x is not None and y is not None:
                if (x, y) not in seen:
                    seen[x, y] = score(x, y)
                out[i] = seen[x, y]
        return pd.Series(out)

    return pairs


ratio, partial_ratio, token_sort_ratio, token_set_ratio, sequence_ratio = map(_as_udf, (indel, best_window, sorted_words, word_sets, blocks_ratio))


@F.pandas_udf(T.StringType())
def number_to_words_vi(numbers: pd.Series) -> pd.Series:
    return numbers.map(lambda n: spell(n) if n is not None and not pd.isna(n) else None)


_DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")


def _under_thousand(n: int, padded: bool) -> list[str]:
    hundreds, tens, units = n // 100, n // 10 % 10, n % 10
    out = [_DIGITS[hundreds], "trăm"] if hundreds or padded else []
    if tens == 0 and units and out:
        out.append("lẻ")
    elif tens == 1:
        out.append("mười")
    elif tens > 1:
        out += [_DIGITS[tens], "mươi"]
    if units:
        out.append("mốt" if units == 1 and tens > 1 else "lăm" if units == 5 and tens else _DIGITS[units])
    return out


def spell(number: float) -> str | None:
    """A number from 0 below a thousand million in Vietnamese words, two decimals at most; else null."""
    if number < 0 or number >= 1_000_000_000:
        return None
    cents = round(number * 100)
    whole, rest = divmod(cents, 100)
    words: list[str] = []
    for size, name in ((1_000_000, "triệu"), (1_000, "nghìn"), (1, "")):
        part, whole = divmod(whole, size)
        if part:
            words += [*_under_thousand(part, bool(words)), *([name] if name else [])]
    words = words or ["không"]
    if rest:
        tens, units = divmod(rest, 10)
        words.append("phẩy")
        words += [_DIGITS[tens]] if not units else ["không", _DIGITS[units]] if not tens else _under_thousand(rest, False)
    return " ".join(words)


_UNITS = {w: i for i, w in enumerate(_DIGITS)} | {"mốt": 1, "tư": 4, "lăm": 5, "nhăm": 5, "bẩy": 7}


def read_number(words: str) -> float | None:
    """The number that Vietnamese words spell, null if they spell none."""
    total = group = 0
    last: int | None = None
    decimals: list[int] | None = None
    known = False
    for w in words.lower().replace(",", " ").split():
        if decimals is not None:
            if w in _UNITS:
                decimals.append(_UNITS[w])
            elif w == "mười":
                decimals.append(1)
            continue
        if w in _UNITS:
            last = _UNITS[w]
            known = True
        elif w == "mười":
            group, last, known = group + 10, None, True
        elif w in ("mươi", "trăm"):
            group, last = group + (last or 0) * (10 if w == "mươi" else 100), None
        elif w in ("nghìn", "ngàn", "triệu"):
            total, group, last = total + (group + (last or 0)) * (1000 if w != "triệu" else 1_000_000), 0, None
        elif w in ("phẩy", "phảy"):
            group, last, decimals = group + (last or 0), None, []
    if not known:
        return None
    whole = total + group + (last or 0)
    return whole + (int("".join(map(str, decimals))) / 10 ** len(decimals) if decimals else 0)


@F.pandas_udf(T.DoubleType())
def words_to_number_vi(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: read_number(t) if t is not None else None).astype("float64")


def area_words_agree(area: Column, words: Column, least: float = 80.0) -> Column:
    """Whether an area's words are what is written beside it, near enough."""
    return token_sort_ratio(number_to_words_vi(area.cast("double")), F.lower(words)) >= least


def _letters(texts: DataFrame, name: str, least: float) -> DataFrame:
    """Distinct ``<name>_text`` with its length ``_n``, its numbered letters ``_all`` in falling order, and of these ``_head``, the first ones.

    An indel similarity of ``least`` needs a share of least / (200 - least) of
    the letters of either text in common; a text that has none of another's
    first letters in its own misses it. The empty text has one empty letter.
    """
    low = F.lower(F.col(f"{name}_text"))
    out = texts.where(F.col(f"{name}_text").isNotNull()).withColumn("_s", F.sort_array(F.split(low, ""), asc=False)).withColumn("_n", F.length(low))
    numbered = F.transform("_s", lambda x, i: F.concat(x, (i + 1 - F.array_position(F.col("_s"), x)).cast("string")))
    out = out.withColumn("_all", F.when(F.col("_n") > 0, numbered).otherwise(F.array(F.lit(""))))
    head = F.col("_n") - F.ceil(F.col("_n") * (least / (200 - least)) - 1e-9) + 1
    out = out.withColumn("_head", F.slice("_all", F.lit(1), head.cast("int")))
    return out.select(f"{name}_text", *[F.col(c).alias(name + c) for c in ("_n", "_all", "_head")])


def may_reach(a: DataFrame, b: DataFrame, cutoff: float) -> DataFrame:
    """l_text and r_text of the pairs that lengths and common letters let reach an indel similarity of ``cutoff``, each once."""
    x = _letters(a, "l", cutoff).withColumn("_key", F.explode("l_head"))
    y = _letters(b, "r", cutoff).withColumn("_key", F.explode("r_head"))
    least, both = F.ceil((F.col("l_n") + F.col("r_n")) * (cutoff / 200) - 1e-9), F.array_intersect("l_head", "r_head")
    near = x.join(y, "_key").where((F.least("l_n", "r_n") >= least) & (F.get(both, F.lit(0)) == F.col("_key")) & (F.size(F.array_intersect("l_all", "r_all")) >= least))
    return near.select("l_text", "r_text")


def fuzzy_best(left: DataFrame, right: DataFrame, left_text: str, right_text: str, score=ratio, cutoff: float = 75.0, block_left: str | None = None, block_right: str | None = None) -> DataFrame:
    """Each left row with the best matching right text, of its block if both blocks are given, if it scores ``cutoff``.

    Distinct texts are scored, all that can reach ``cutoff``: for ``ratio`` those
    with enough letters in common, by an exact filter; for another score, or
    without a cutoff, each with each, so the right side should be a bounded list.
    """
    if (block_left is None) != (block_right is None):
        raise ValueError("blocks are given for both sides or for none")
    side = lambda df, c, name, block: df.select(F.col(c).alias(name), *([F.col(block).cast("string").alias("block")] if block else [])).distinct()
    a, b = side(left, left_text, "l_text", block_left), side(right, right_text, "r_text", block_right)
    if block_left:
        near = a.join(b, "block").select("l_text", "r_text").distinct()
    elif score is ratio and 0 < cutoff <= 100:
        near = may_reach(a, b, cutoff)
    else:
        near = a.crossJoin(b)
    pairs = near.withColumn("score", score(F.lower("l_text"), F.lower("r_text"))).where(F.col("score") >= cutoff)
    best = pairs.groupBy("l_text").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("r_text"))).alias("m")).select("l_text", F.col("m.r_text").alias("match"), (-F.col("m.s")).alias("score"))
    return left.join(best, left[left_text] == best["l_text"], "left").drop("l_text")


def register_all(spark: SparkSession) -> None:
    """The similarity and number functions under SQL names."""
    from parcelforge.functions.text import normalise_nfc

    for name, f in (
        ("fuzz_ratio", ratio), ("fuzz_partial_ratio", partial_ratio), ("token_sort_ratio", token_sort_ratio), ("token_set_ratio", token_set_ratio), ("seq_ratio", sequence_ratio),
        ("nfc", normalise_nfc), ("number_to_words_vi", number_to_words_vi), ("words_to_number_vi", words_to_number_vi),
    ):
        spark.udf.register(name, f)
