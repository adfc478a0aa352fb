"""Layout operators on tokens and their boxes.

A token row has doc_id, page_index, ord (the detector's order), text, confidence
and a box x1, y1, x2, y2. Neighbour searches are joins within a page: an
equality on the page and ranges on coordinates. Only line clustering, which
depends on the order in which lines grow, runs as a function per page; a page
is some hundred tokens.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.fuzzy import partial_ratio, ratio
from parcelforge.functions.text import clean_text, contains_any, fold_accents
from parcelforge.session import counted_broadcast

PAGE = ("doc_id", "page_index")
BOX = ("x1", "y1", "x2", "y2")


def with_box(tokens: DataFrame, polygon: str = "bbox") -> DataFrame:
    """x1, y1, x2, y2, centre, width and height (1 at least) of a polygon of points, or of a box of four numbers cast to points."""
    xs, ys = F.transform(polygon, lambda p: p[0]), F.transform(polygon, lambda p: p[1])
    out = tokens.withColumns({"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)})
    return with_centre(out)


def with_centre(tokens: DataFrame) -> DataFrame:
    return tokens.withColumns(
        {
            "cx": (F.col("x1") + F.col("x2")) / 2,
            "cy": (F.col("y1") + F.col("y2")) / 2,
            "w": F.greatest(F.lit(1.0), F.col("x2") - F.col("x1")),
            "h": F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")),
        }
    )


def reading_order(tokens: DataFrame, tolerance: float = 12.0, page: Sequence[str] = PAGE) -> DataFrame:
    """Tokens with ``line`` and ``position`` in reading order, both from 0.

    From top to bottom a token joins the first line whose mean top is within the
    tolerance, else it begins one; lines follow by mean top, tokens in a line by
    their left edge. Ties go by the top, then by ``ord``.
    """
    own = F.struct(F.col("y1").cast("double").alias("y"), F.col("x1").cast("double").alias("x"), "ord")
    pages = tokens.groupBy(*page).agg(F.array_sort(F.collect_list(own)).alias("boxes"))
    placed = pages.select(*page, F.explode(F.arrays_zip(F.col("boxes.ord").alias("ord"), reading_places(tolerance)(F.col("boxes.y"), F.col("boxes.x")).alias("at"))).alias("t"))
    return tokens.join(placed.select(*page, "t.ord", "t.at.line", "t.at.position"), [*page, "ord"])


def reading_places(tolerance: float):
    """A batched function of a page's tops and left edges, sorted by them: each token's line and position."""

    @F.pandas_udf("array<struct<line: int, position: int>>")
    def places(tops: pd.Series, lefts: pd.Series) -> pd.Series:
        out = []
        for ys, xs in zip(tops, lefts, strict=True):
            sums, counts, member = [], [], []
            for top in ys:
                at = next((i for i, (s, n) in enumerate(zip(sums, counts, strict=True)) if abs(top - s / n) <= tolerance), len(sums))
                if at == len(sums):
                    sums.append(0.0)
                    counts.append(0)
                sums[at] += top
                counts[at] += 1
                member.append(at)
            order = sorted(range(len(sums)), key=lambda i: sums[i] / counts[i])
            line = {at: i for i, at in enumerate(order)}
            position = {i: p for p, i in enumerate(sorted(range(len(member)), key=lambda i: (line[member[i]], xs[i])))}
            out.append([{"line": line[m], "position": position[i]} for i, m in enumerate(member)])
        return pd.Series(out)

    return places


def _pairs(anchors: DataFrame, tokens: DataFrame, page: Sequence[str]) -> DataFrame:
    """Each anchor with the other tokens of its page, the anchor's columns as a_*."""
    a = anchors.select(*page, *[F.col(c).alias(f"a_{c}") for c in anchors.columns if c not in page])
    return a.join(tokens, list(page)).where(F.col("ord") != F.col("a_ord"))


def right_neighbours(anchors: DataFrame, tokens: DataFrame, max_dx: float = 800.0, overlap: float = 0.4, page: Sequence[str] = PAGE) -> DataFrame:
    """Tokens right of an anchor's middle on its line, numbered from the left as ``nth`` from 1."""
    wide = F.col("a_x2") - F.col("a_x1")
    tall = F.greatest(F.lit(0.0), F.least("a_y2", "y2") - F.greatest("a_y1", "y1"))
    least = F.least(F.greatest(F.lit(1.0), F.col("a_y2") - F.col("a_y1")), F.greatest(F.lit(1.0), F.col("y2") - F.col("y1")))
    out = _pairs(anchors, tokens, page).where((F.col("x1") >= F.col("a_x1") + 0.5 * wide) & (F.col("x1") <= F.col("a_x1") + max_dx) & (tall / least >= overlap))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*page, "a_ord").orderBy("x1", "ord")))


def lower_neighbours(anchors: DataFrame, tokens: DataFrame, max_dy: float = 250.0, slack: float = 150.0, page: Sequence[str] = PAGE) -> DataFrame:
    """Tokens below an anchor in its column, numbered from the top."""
    out = _pairs(anchors, tokens, page).where(F.col("y1").between(F.col("a_y2") - 5, F.col("a_y2") + max_dy) & (F.col("x2") >= F.col("a_x1") - slack) & (F.col("x1") <= F.col("a_x2") + slack))
    return out.withColumn("nth", F.row_number().over(Window.partitionBy(*page, "a_ord").orderBy("y1", "x1", "ord")))


def nearest_below(anchors: DataFrame, tokens: DataFrame, max_dy: float = 240.0, where: Column | None = None, page: Sequence[str] = PAGE) -> DataFrame:
    """For each anchor the token nearest below, its centre within the anchor's width."""
    pairs = _pairs(anchors, tokens, page).withColumn("dy", F.col("y1") - F.col("a_y1"))
    pairs = pairs.where(F.col("dy").between(0, max_dy) & ((F.col("x1") + F.col("x2")) / 2).between(F.col("a_x1"), F.col("a_x2")))
    if where is not None:
        pairs = pairs.where(where)
    best = F.min_by(F.struct("ord", "text", "dy"), F.struct("dy", "ord")).alias("b")
    return pairs.groupBy(*page, "a_ord").agg(best).select(*page, "a_ord", "b.ord", "b.text", "b.dy")


def split_serials(tokens: DataFrame, page: Sequence[str] = PAGE) -> DataFrame:
    """Serial candidates of two tokens, one or two letters and six to eight digits right of them on one line."""
    letters = tokens.where(F.trim("text").rlike(r"^\p{L}[\p{L}01]?$"))
    digits = tokens.where(F.trim("text").rlike(r"^[0-9OIlBS]{6,8}$"))
    out = _pairs(letters, digits, page).withColumns({"gap": F.col("x1") - F.col("a_x2"), "dy": F.abs((F.col("y1") + F.col("y2")) / 2 - (F.col("a_y1") + F.col("a_y2")) / 2)})
    return out.where((F.col("dy") < 25) & (F.col("gap") >= 0) & (F.col("gap") < 70)).select(*page, "a_ord", "ord", F.concat_ws(" ", F.trim("a_text"), F.trim("text")).alias("candidate"))


def overlap_area(a: str = "a_", b: str = "") -> Column:
    wide = F.greatest(F.lit(0.0), F.least(f"{a}x2", f"{b}x2") - F.greatest(f"{a}x1", f"{b}x1"))
    return wide * F.greatest(F.lit(0.0), F.least(f"{a}y2", f"{b}y2") - F.greatest(f"{a}y1", f"{b}y1"))


def _area(p: str) -> Column:
    return (F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(f"{p}y2") - F.col(f"{p}y1"))


def iou_match(left: DataFrame, right: DataFrame, least: float = 0.5, page: Sequence[str] = PAGE) -> DataFrame:
    """Each left token with the right one of the best intersection over union, from ``least`` on."""
    a = left.select(*page, *[F.col(c).alias(f"a_{c}") for c in left.columns if c not in page])
    pairs = a.join(right, list(page)).withColumn("iou", overlap_area() / (_area("a_") + _area("") - overlap_area())).where(F.col("iou") >= least)
    best = F.max_by(F.struct("ord", "text", "confidence", "iou"), F.struct("iou", (-F.col("ord")).alias("o"))).alias("b")
    return pairs.groupBy(*page, "a_ord").agg(best).select(*page, "a_ord", "b.*")


def interval_overlap(entries: DataFrame, others: DataFrame, above: float = 60.0, below: float = 80.0, page: Sequence[str] = PAGE) -> DataFrame:
    """Tokens of another column whose height meets an entry's, widened upwards and downwards."""
    return _pairs(entries, others, page).where((F.col("y2") >= F.col("a_y1") - above) & (F.col("y1") <= F.col("a_y2") + below))


def top_k_nearest(anchors: DataFrame, tokens: DataFrame, k: int = 16, page: Sequence[str] = PAGE) -> DataFrame:
    """The k tokens that are cheapest to reach from any anchor of the page: vertical distance and 0.15 of the horizontal one."""
    dx, dy = (F.abs((F.col(f"{c}1") + F.col(f"{c}2")) / 2 - (F.col(f"a_{c}1") + F.col(f"a_{c}2")) / 2) for c in "xy")
    pairs = _pairs(anchors, tokens, page).withColumn("cost", dy + 0.15 * dx)
    cheapest = pairs.groupBy(*page, "ord").agg(F.min("cost").alias("cost"))
    return cheapest.withColumn("nth", F.row_number().over(Window.partitionBy(*page).orderBy("cost", "ord"))).where(F.col("nth") <= k)


def find_anchors(tokens: DataFrame, labels: DataFrame, threshold: float = 75.0) -> DataFrame:
    """Tokens that match a label (field, label), with ``score`` and the best label of each field.

    A text that holds the label scores 100; else the better of the partial and
    the full ratio, blended where the text is less than half of a label of
    several words. One short word never stands for a label of several words, and
    a certificate's title never for a registry number's label.
    """
    keys = ["template"] if "template" in labels.columns and "template" in tokens.columns else []
    # a text is scored once for each label, wherever it stands
    texts = tokens.select(F.lower(F.trim("text")).alias("_t"), *keys).where(F.col("_t") != "").distinct()
    names = counted_broadcast(labels.select(F.lower(F.trim("label")).alias("_l"), *keys).distinct())
    text, label = F.col("_t"), F.col("_l")
    words = lambda c: F.size(F.split(c, r"\s+"))
    short = (words(label) >= 2) & (words(text) == 1) & (F.length(text) <= 5)
    registry = fold_accents(label).rlike("vao so|so cap")
    folded = fold_accents(text)
    title = ~folded.rlike("so|vao") | (folded.rlike("giay chung nhan|cong hoa|doc lap|quyen so huu") & ~folded.contains("vao so"))
    pairs = (texts.join(names, keys) if keys else texts.join(names)).where(~short & ~(registry & title)).withColumn("inside", text.contains(label))
    # of the shorter text so many letters must be in the longer one, in any order, for either ratio to reach the threshold
    share = threshold / (200 - threshold)
    letters = lambda c: F.transform(F.array_sort(F.split(c, "")), lambda x: x)
    numbered = lambda xs: F.transform(xs, lambda x, i: F.concat(x, (i + 1 - F.array_position(xs, x)).cast("string")))
    common = F.size(F.array_intersect(numbered(letters(text)), numbered(letters(label))))
    hopeful = pairs.where(F.col("inside") | (common >= F.floor(share * F.least(F.length(text), F.length(label)))))
    part, full = partial_ratio(label, text), ratio(label, text)
    fuzzy = F.when((words(label) >= 2) & (F.length(text) < 0.5 * F.length(label)), 0.4 * part + 0.6 * full).otherwise(F.greatest(part, full))
    sure = hopeful.where("inside").withColumn("score", F.lit(100.0)).unionByName(hopeful.where("not inside").withColumn("score", fuzzy).where(F.col("score") >= threshold)).drop("inside")
    found = tokens.withColumn("_t", F.lower(F.trim("text"))).join(sure, ["_t", *keys]).join(counted_broadcast(labels.withColumn("_l", F.lower(F.trim("label")))), ["_l", *keys]).drop("_t", "_l")
    w = Window.partitionBy(*PAGE, "ord", "field").orderBy(F.desc("score"), "label")
    return found.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def inline_value(text: Column, label: Column) -> Column:
    """What follows the first colon, else what follows the label at the beginning; null if nothing does."""
    after = F.trim(F.regexp_extract(text, r"^[^:]*:(.*)$", 1))
    rest = F.regexp_replace(F.trim(F.substring(text, F.length(label) + 1, F.length(text))), r"^[:.\- ]+", "")
    return F.when(after != "", after).when(F.startswith(F.lower(text), F.lower(label)) & (rest != ""), rest)


def extract_fields(tokens: DataFrame, labels: DataFrame, max_dx: float = 800.0, max_dy: float = 250.0) -> DataFrame:
    """doc_id, page_index, field, value, confidence, match_score and the value's box: inline with what stands right of it, else right, else below the best anchor.

    ``labels`` has field and label, and may have direction (right, bottom or
    auto) and template, which then must be a column of ``tokens`` too.
    """
    anchors = find_anchors(tokens, labels)
    best = anchors.withColumn("_n", F.row_number().over(Window.partitionBy(*PAGE, "field").orderBy(F.desc("score"), "ord"))).where("_n = 1").drop("_n")
    way = F.coalesce(F.col("direction"), F.lit("auto")) if "direction" in labels.columns else F.lit("auto")
    base = best.select(*PAGE, "field", "label", "score", "ord", "text", "confidence", way.alias("way"), *BOX)

    def gathered(near: DataFrame, name: str) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.struct("nth", "text", "confidence", *BOX)))
        return near.groupBy(*PAGE, F.col("a_ord").alias("ord")).agg(parts.alias(name))

    slim = tokens.select(*PAGE, "ord", "text", "confidence", *BOX)
    spots = base.select(*PAGE, "ord", *BOX).distinct()
    out = base.join(gathered(right_neighbours(spots, slim, max_dx), "right"), [*PAGE, "ord"], "left").join(gathered(lower_neighbours(spots, slim, max_dy), "low"), [*PAGE, "ord"], "left")
    own = F.struct(F.lit(0).alias("nth"), F.col("text"), F.col("confidence"), *[F.col(c) for c in BOX])
    inline = inline_value(F.col("text"), F.col("label"))
    with_own = F.when(F.col("right").isNull(), F.array(own)).otherwise(F.concat(F.array(own), F.col("right")))
    used = F.when((F.col("way") != "bottom") & inline.isNotNull(), with_own).when(F.col("way") == "right", F.col("right")).when(F.col("way") == "bottom", F.col("low")).otherwise(F.coalesce("right", "low"))
    texts = F.transform(F.col("used"), lambda b: F.when((b["nth"] == 0), inline).otherwise(F.trim(b["text"])))
    value = F.regexp_replace(F.array_join(F.filter(texts, lambda t: t != ""), " "), r"^[:.\- ]+|[:.\- ]+$", "")
    out = out.withColumn("used", used).where(F.col("used").isNotNull()).withColumn("value", value).where(F.col("value") != "")
    mean = F.expr("aggregate(used, 0D, (a, b) -> a + coalesce(b.confidence, 0.9D)) / size(used)")
    box = [F.array_min(F.transform("used", lambda b: b["x1"])), F.array_min(F.transform("used", lambda b: b["y1"])), F.array_max(F.transform("used", lambda b: b["x2"])), F.array_max(F.transform("used", lambda b: b["y2"]))]
    return out.select(*PAGE, "field", "value", F.round(mean, 3).alias("confidence"), F.col("score").alias("match_score"), F.col("text").alias("source_line"), *[b.alias(c) for b, c in zip(box, BOX, strict=True)])


def gap_islands(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], start: Column) -> DataFrame:
    """``island``: how many rows that ``start`` one there are up to this row; the first row starts one too. ``start`` may use columns of lag."""
    w = Window.partitionBy(*group).orderBy(*order)
    first = F.when(F.row_number().over(w) == 1, 1).otherwise(F.coalesce(start.cast("int"), F.lit(0)))
    return df.withColumn("_s", first).withColumn("island", F.sum("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s")


def clusters_1d(df: DataFrame, group: Sequence[str], value: str, gap: float = 25.0) -> DataFrame:
    """``cluster`` from 1: a value more than ``gap`` beyond the last begins a new one."""
    w = Window.partitionBy(*group).orderBy(value)
    return gap_islands(df.withColumn("_d", F.col(value) - F.lag(value).over(w)), group, [value], F.col("_d") > gap).withColumnRenamed("island", "cluster").drop("_d")


def row_bands(anchors: DataFrame, group: Sequence[str], value: str, low: Column | None = None, high: Column | None = None) -> DataFrame:
    """Each anchor's band: from the middle to the one before to the middle to the one after; the table's edges at the ends, or the anchor itself."""
    w = Window.partitionBy(*group).orderBy(value)
    own = F.col(value)
    begin = F.coalesce((F.lag(value).over(w) + own) / 2, low if low is not None else own)
    end = F.coalesce((F.lead(value).over(w) + own) / 2, high if high is not None else own)
    return anchors.withColumns({"band_from": begin, "band_to": end})


def thin_anchors(values: Column, gap: float = 15.0) -> Column:
    """A sorted array without the values within ``gap`` of the last one kept; a fold, as each choice depends on the last."""
    empty = F.slice(values, 1, 0)
    return F.aggregate(values, empty, lambda kept, v: F.when((F.size(kept) == 0) | (v - F.try_element_at(kept, F.lit(-1)) > gap), F.array_append(kept, v)).otherwise(kept))


def expand_box(width: Column, height: Column, pad_x: float = 0.12, pad_y: float = 0.18, least_x: float = 20, least_y: float = 25) -> list[Column]:
    """A box grown by a share of its sides, by ``least`` pixels at least, within the page."""
    dx = F.greatest(F.lit(float(least_x)), pad_x * (F.col("x2") - F.col("x1")))
    dy = F.greatest(F.lit(float(least_y)), pad_y * (F.col("y2") - F.col("y1")))
    return [F.greatest(F.lit(0.0), F.col("x1") - dx).alias("x1"), F.greatest(F.lit(0.0), F.col("y1") - dy).alias("y1"), F.least(width, F.col("x2") + dx).alias("x2"), F.least(height, F.col("y2") + dy).alias("y2")]


#: Words that a barcode's digits never stand with.
BARCODE_VETO = (
    "cmnd", "cccd", "sinh năm", "sinh nam", "năm sinh", "nam sinh", "hộ ông", "ho ong", "hộ bà", "ho ba", "thường trú", "thuong tru", "địa chỉ", "dia chi", "thửa đất", "thua dat",
    "tờ bản đồ", "to ban do", "diện tích", "dien tich", "chủ sử dụng", "chu su dung", "ngày cấp", "ngay cap", "giấy chứng nhận", "chứng nhận", "cộng hòa", "độc lập", "quyền sử dụng",
)


def is_barcode_box(height: Column) -> Column:
    """A wide box in the lowest 35 % of the page with six digits, or four signs that are all digits, and no word of a person or parcel."""
    text = F.trim("text")
    digits = F.length(F.regexp_replace(text, r"\D", ""))
    alone = (F.length(text) >= 4) & F.replace(text, F.lit(" "), F.lit("")).rlike(r"^\d+$")
    tall = F.col("y2") - F.col("y1")
    low = (F.col("y1") + F.col("y2")) / 2 >= 0.65 * height
    return F.coalesce(low & ~contains_any(F.lower(text), BARCODE_VETO) & ((digits >= 6) | alone) & (tall > 0) & (F.col("x2") - F.col("x1") >= 2 * tall), F.lit(False))


def group_lines(tokens: DataFrame, least: float = 18.0, share: float = 0.75, page: Sequence[str] = PAGE) -> DataFrame:
    """Lines by the middle of the last line: from top to bottom a token joins the last line if its middle is within the larger of ``least`` and ``share`` of its height of that line's mean middle. One row a line: line from 0, text from left to right, box and mean confidence."""
    own = F.struct(((F.col("y1") + F.col("y2")) / 2).alias("cy"), "x1", "ord", "text", "confidence", "y1", "x2", "y2")
    pages = tokens.groupBy(*page).agg(F.array_sort(F.collect_list(own)).alias("boxes"))
    zero = F.expr("named_struct('line', -1, 'sum', 0D, 'n', 0, 'at', cast(array() as array<int>))")

    def step(s: Column, b: Column) -> Column:
        near = (s["n"] > 0) & (F.abs(b["cy"] - s["sum"] / s["n"]) <= F.greatest(F.lit(least), share * (b["y2"] - b["y1"])))
        line = F.when(near, s["line"]).otherwise(s["line"] + 1)
        return F.struct(line.alias("line"), F.when(near, s["sum"] + b["cy"]).otherwise(b["cy"]).alias("sum"), F.when(near, s["n"] + 1).otherwise(1).alias("n"), F.array_append(s["at"], line).alias("at"))

    at = F.aggregate("boxes", zero, step, lambda s: s["at"])
    rows = pages.select(*page, F.explode(F.arrays_zip("boxes", at.alias("line"))).alias("t")).select(*page, "t.line", "t.boxes.*")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x1", "ord", F.trim("text").alias("t")))), lambda x: x["t"]), " ")
    return rows.groupBy(*page, "line").agg(text.alias("text"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.round(F.avg("confidence"), 3).alias("confidence"))


def page_text(tokens: DataFrame) -> DataFrame:
    """One row per page: the tokens' texts in detector order."""
    parts = F.array_sort(F.collect_list(F.struct("ord", clean_text(F.col("text")).alias("t"))))
    return tokens.groupBy(*PAGE).agg(F.array_join(F.transform(parts, lambda p: p["t"]), " ").alias("page_text"))


def recogniser(tokens: DataFrame, detect, schema: str) -> DataFrame:
    """The ingestion boundary: ``detect`` maps batches of pages (pandas) to batches of tokens; models are the caller's."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield detect(batch)

    return tokens.mapInPandas(run, schema)
