"""The review projection: a field's evidence on its pages and the status it gets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import nullify_placeholder, token_match_score


def path_value(payload: Column, *paths: str) -> Column:
    """The first of several JSON paths that has a value."""
    return F.coalesce(*[F.get_json_object(payload, p) for p in paths])


def provenance(fields: DataFrame, tokens: DataFrame, least: float = 0.55) -> DataFrame:
    """doc_id, field_key and the token that best shows the field's value, with its score; a token of a page whose raw field agrees counts 0.01 more.

    ``fields`` has doc_id, field_key, value and raw_page (the page whose raw field agrees, or null).
    """
    pairs = fields.where(nullify_placeholder(F.col("value")).isNotNull()).join(tokens, "doc_id")
    scored = pairs.withColumn("score", token_match_score(F.col("value"), F.col("text")) + F.when(F.col("page_index") == F.col("raw_page"), 0.01).otherwise(0.0)).where(F.col("score") >= least)
    best = F.max_by(F.struct("page_index", "ord", "text", "confidence", "score"), F.struct("score", (-F.col("page_index")).alias("p"), (-F.col("ord")).alias("o"))).alias("b")
    return scored.groupBy("doc_id", "field_key").agg(best).select("doc_id", "field_key", "b.*")


def review_status(value: Column, flagged: Column, confidence: Column, has_place: Column) -> Column:
    return F.when(nullify_placeholder(value).isNull(), "missing").when(flagged | (confidence < 0.6), "needs_review").when(~has_place, "no_evidence").otherwise("ready")


def project(fields: DataFrame, tokens: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """The fields with their evidence, status and latest decision (doc_id, field_key, review_status, corrected_value, created_at, id)."""
    out = fields.join(provenance(fields, tokens), ["doc_id", "field_key"], "left")
    status = review_status(F.col("value"), F.coalesce("flagged", F.lit(False)), F.coalesce("confidence", F.lit(0.0)), F.col("ord").isNotNull())
    out = out.withColumn("status", status)
    if reviews is not None:
        last = reviews.groupBy("doc_id", "field_key").agg(F.max_by(F.struct("review_status", "corrected_value"), F.struct("created_at", "id")).alias("decision"))
        out = out.join(last, ["doc_id", "field_key"], "left")
    return out


def summary(projected: DataFrame) -> DataFrame:
    """doc_id, fields, and those that need a look."""
    return projected.groupBy("doc_id").agg(F.count("*").alias("fields"), F.count_if(F.col("status") != "ready").alias("open"))


def crop_evidence(crops: DataFrame, fields: DataFrame) -> DataFrame:
    """Each field with its best crop: ten times the overlap and five times the text's likeness, accepted from an overlap of 0.65 or a likeness of 0.55 on."""
    pairs = fields.join(crops, ["doc_id", "page_index"])
    wide = F.greatest(F.lit(0.0), F.least("f_x2", "x2") - F.greatest("f_x1", "x1")) * F.greatest(F.lit(0.0), F.least("f_y2", "y2") - F.greatest("f_y1", "y1"))
    area = (F.col("f_x2") - F.col("f_x1")) * (F.col("f_y2") - F.col("f_y1"))
    pairs = pairs.withColumns({"overlap": F.when(area > 0, wide / area).otherwise(0.0), "alike": token_match_score(F.col("value"), F.col("crop_text"))})
    pairs = pairs.where((F.col("overlap") >= 0.65) | (F.col("alike") >= 0.55)).withColumn("score", 10 * F.col("overlap") + 5 * F.col("alike"))
    return pairs.groupBy("doc_id", "field_key").agg(F.max_by(F.struct("crop_id", "score"), F.struct("score", "crop_id")).alias("b")).select("doc_id", "field_key", "b.*")


def json_coerce(payload: Column) -> Column:
    """A text's JSON object, '{}' for null, for what is no JSON and for JSON that is no object."""
    text = F.trim(F.coalesce(payload, F.lit("")))
    ok = text.startswith("{") & F.try_parse_json(text).isNotNull()
    return F.when(ok, text).otherwise("{}")
