"""Choosing between two engines' readings of a box.

The detector reads a box as it stands (p), the recogniser as it stands and
turned by half a circle; its surer non-empty reading is v. A ladder of rules
decides, the first that holds; each rule is a condition on facts of the two
readings, the side that it takes and a reason code.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.fuzzy import sequence_ratio
from parcelforge.functions.text import comparable_text, digits_only

# ---------------------------------------------------------------- fixed values
# Reason codes with the side that each takes, in the order of the rules.
REASONS = (
    ("numeric_highest_confidence", "p"), ("numeric_highest_confidence", "v"), ("barcode_vietocr", "v"), ("barcode_paddle", "p"), ("identity_paddle_only", "p"), ("vietocr_only", "v"), ("vietocr_low_confidence", "p"),
    ("vietocr_text_agrees_with_paddle", "v"), ("vietocr_pure_text_priority", "v"), ("vietocr_strong_text", "v"), ("paddle_stronger_disagreement", "p"), ("vietocr_text_priority", "v"), ("paddle_fallback", "p"),
)
BARCODE_DIGITS, BARCODE_SURE, IDENTITY_SURE, V_WEAK = (13, 15), 0.60, 0.75, 0.50
ALIKE, ALIKE_LETTERS, SURE_LETTERS = 0.70, 0.58, 0.48
V_STRONG, V_LEAD, P_LEAD, UNLIKE, V_FAIR = 0.70, 0.12, 0.18, 0.55, 0.58
IDENTITY_WORDS = ("cccd", "cmnd", "nam sinh", "sinh nam")
# ---------------------------------------------------------------- end of fixed values


def is_decimal(text: Column) -> Column:
    """A number with one to seven digits, a point or comma, and one to four digits; whole numbers are none."""
    parts = F.split(F.trim(text), "[.,]", -1)
    digits = lambda i, most: F.coalesce(F.get(parts, F.lit(i)).rlike(rf"^\d{{1,{most}}}$"), F.lit(False))
    return (F.size(parts) == 2) & digits(0, 7) & digits(1, 4)


def shows_number(text: Column) -> Column:
    """A run of 9 to 15 digits that stands alone, or a serial: two capitals and six to eight digits."""
    runs = F.exists(F.split(text, r"[^\p{L}\p{N}_]+"), lambda w: w.rlike(r"^\d{9,15}$"))
    return runs | F.regexp_replace(text, r"\s", "").rlike(r"^[A-Z]{2}\d{6,8}$")


def surer(*readings: tuple[str, Column, Column]) -> Column:
    """Of (name, text, confidence) the surest with a text, the first of equals; without any an empty one."""
    rows = F.array(*[F.struct(F.coalesce(c, F.lit(0.0)).cast("double").alias("confidence"), F.lit(-i).alias("first"), F.trim(F.coalesce(t, F.lit(""))).alias("text"), F.lit(n).alias("engine")) for i, (n, t, c) in enumerate(readings)])
    none = F.struct(F.lit(0.0).alias("confidence"), F.lit(0).alias("first"), F.lit("").alias("text"), F.lit("").alias("engine"))
    return F.coalesce(F.array_max(F.filter(rows, lambda r: r["text"] != "")), none)


def ladder(p: Column, v: Column, like: Column, barcode: Column) -> Column:
    """text, confidence, engine, side and reason; p and v are structs of text, confidence and engine, ``like`` their likeness from 0 to 1."""
    pt, vt, pc, vc = p["text"], v["text"], p["confidence"], v["confidence"]
    number_p, number_v = is_decimal(pt), is_decimal(vt)
    worded = F.exists(F.array(*[F.lit(w) for w in IDENTITY_WORDS]), lambda w: F.contains(F.lower(pt), w))
    letters = ~pt.rlike(r"\d") & ~vt.rlike(r"\d")
    conditions = (
        ~barcode & number_p & (~number_v | (pc >= vc)),
        ~barcode & (number_p | number_v),
        barcode & F.length(digits_only(vt)).between(*BARCODE_DIGITS) & (vc >= BARCODE_SURE),
        barcode,
        (shows_number(pt) | worded) & ~shows_number(vt) & (pc >= IDENTITY_SURE),
        pt == "",
        (vt == "") | (vc < V_WEAK),
        like >= ALIKE,
        letters & (like >= ALIKE_LETTERS) & (vc >= SURE_LETTERS),
        (vc >= V_STRONG) & (vc + V_LEAD >= pc),
        (pc >= vc + P_LEAD) & (like < UNLIKE),
        (vc >= V_FAIR) & (like >= UNLIKE),
        F.lit(True),
    )
    of = {"p": p, "v": v}
    rows = [F.struct(of[side]["text"].alias("text"), of[side]["confidence"].alias("confidence"), of[side]["engine"].alias("engine"), F.lit(side).alias("side"), F.lit(reason).alias("reason")) for reason, side in REASONS]
    return functools.reduce(lambda c, x: c.when(*x), zip(conditions, rows, strict=True), F)


def likeness(a: Column, b: Column) -> Column:
    """How alike two texts are without accents and signs, 0 to 1; 0 if either has no letter and no digit."""
    x, y = comparable_text(F.coalesce(a, F.lit(""))), comparable_text(F.coalesce(b, F.lit("")))
    return F.when((x == "") | (y == ""), F.lit(0.0)).otherwise(sequence_ratio(x, y) / 100)


def select_readings(tokens: DataFrame) -> DataFrame:
    """``tokens`` (is_barcode_box, p_text, p_conf, v_text, v_conf, and v180_text and v180_conf where boxes were read turned) with ``selected``. Null texts are empty, null confidences 0."""
    at = lambda c, kind: F.col(c) if c in tokens.columns else F.lit(None).cast(kind)
    out = tokens.withColumns({
        "_p": F.struct(F.trim(F.coalesce("p_text", F.lit(""))).alias("text"), F.coalesce("p_conf", F.lit(0.0)).cast("double").alias("confidence"), F.lit("paddle").alias("engine")),
        "_v": surer(("vietocr", F.col("v_text"), F.col("v_conf")), ("vietocr_180", at("v180_text", "string"), at("v180_conf", "double"))),
    })
    out = out.withColumn("_like", likeness(F.col("_p.text"), F.col("_v.text")))
    return out.withColumn("selected", ladder(F.col("_p"), F.col("_v"), F.col("_like"), F.coalesce("is_barcode_box", F.lit(False)))).drop("_p", "_v", "_like")


def engine_counts(tokens: DataFrame, by: str = "doc_id") -> DataFrame:
    """Boxes of each document by the engine whose reading was taken."""
    return tokens.groupBy(by, F.col("selected.engine").alias("engine")).agg(F.count("*").alias("tokens"))


def audit_trace(tokens: DataFrame, fields: DataFrame) -> DataFrame:
    """One row a page: boxes by engine, mean confidence, the fields that need review, sorted, and each field's evidence (value, confidence, source line).

    ``fields`` has doc_id, page_index, field_key, value, confidence, status and source_line.
    """
    page = ["doc_id", "page_index"]
    engines = tokens.groupBy(*page, F.col("selected.engine").alias("engine")).agg(F.count("*").alias("n"), F.sum("selected.confidence").alias("c"))
    boxes = engines.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct("engine", "n"))).alias("engines"), F.sum("n").alias("n_tokens"), F.round(F.sum("c") / F.sum("n"), 3).alias("mean_confidence"))
    evidence = fields.groupBy(*page).agg(
        F.array_sort(F.collect_set(F.when(F.col("status") == "review_required", F.col("field_key")))).alias("review_fields"),
        F.array_sort(F.collect_list(F.struct("field_key", "value", "confidence", "source_line"))).alias("evidence"),
    )
    return boxes.join(evidence, page, "left")


def should_retry_rotated(detected: Column, confidence: Column, read: Column, read_confidence: Column, like: Column) -> Column:
    """Whether a box is worth a turned reading: a sure detection against a weak, missing or conflicting one."""
    empty = F.coalesce(F.trim(read), F.lit("")) == ""
    weak = (F.coalesce(F.trim(detected), F.lit("")) != "") & (confidence >= 0.75) & (F.coalesce(read_confidence, F.lit(0.0)) < 0.75)
    return weak & (empty | ((confidence >= read_confidence + 0.12) & (like < 0.58)))

