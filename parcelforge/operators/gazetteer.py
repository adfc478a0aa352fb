"""Places: fuzzy matches against a gazetteer of provinces, districts and wards, each level within the one above."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.fuzzy import may_reach, ratio
from parcelforge.functions.text import fold_accents, strip_admin_prefix
from parcelforge.session import counted_broadcast

#: The least scores of a match by level.
THRESHOLDS = {"province": 80.0, "district": 78.0, "ward": 75.0}


def comparable_place(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(strip_admin_prefix(c)), r"[_\-.\s]+", " "))


def match_level(names: DataFrame, places: DataFrame, level: str, within: str | None = None) -> DataFrame:
    """``names`` (text, and ``within`` if given) with code, name and score of the best place, by accented or accent-free likeness; rows without a match are left out.

    ``places`` has code, name and, for a level below another, parent. It is a
    gazetteer's level; with ``within`` a name meets the places of its parent only.
    """
    keys = ["text", *([within] if within else [])]
    spot = places.select("code", F.col("name").alias("place"), *([F.col("parent").alias(within)] if within else []))
    asked = names.select(*keys).where("text is not null").distinct()
    least, scored = THRESHOLDS[level], []
    for form in (comparable_place, lambda c: fold_accents(comparable_place(c))):
        # texts that have too few letters in common are not scored; none that can reach the threshold is left out
        a, b = asked.withColumn("l_text", form(F.col("text"))), spot.withColumn("r_text", form(F.col("place")))
        near = may_reach(a.select("l_text").distinct(), b.select("r_text").distinct(), least).withColumn("score", ratio(F.col("l_text"), F.col("r_text"))).where(F.col("score") >= least)
        scored.append(a.join(near, "l_text").join(b, ["r_text", *keys[1:]]).select(*keys, "code", "place", "score"))
    best = F.max_by(F.struct("code", "place", "score"), F.struct("score", F.col("code")))
    return scored[0].unionByName(scored[1]).groupBy(*keys).agg(best.alias("b")).select(*keys, F.col("b.code").alias(f"{level}_code"), F.col("b.place").alias(level), F.col("b.score").alias(f"{level}_score"))


def split_address(address: Column) -> Column:
    """province, district, ward and rest of a comma-separated address, from the right."""
    parts = F.filter(F.transform(F.split(address, r"\s*[,;]\s*"), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    at = lambda i: F.get(parts, n - i)
    return F.struct(at(1).alias("province"), at(2).alias("district"), at(3).alias("ward"), F.array_join(F.slice(parts, 1, F.greatest(F.lit(0), n - 3)), ", ").alias("rest"))


def resolve_addresses(addresses: DataFrame, provinces: DataFrame, districts: DataFrame, wards: DataFrame, address: str = "address") -> DataFrame:
    """``addresses`` with province, district and ward, their codes, and rest.

    Each level is matched within the one above. A district that is matched
    although its province is not, by a name that only one province has, gives
    the province.
    """
    parts = addresses.withColumn("_p", split_address(F.col(address)))
    asked = parts.select(F.col("_p.province").alias("p_text"), F.col("_p.district").alias("d_text"), F.col("_p.ward").alias("w_text")).distinct()
    p = match_level(asked.select(F.col("p_text").alias("text")), provinces, "province").withColumnRenamed("text", "p_text")
    step = asked.join(p, "p_text", "left")
    d = match_level(step.where("province_code is not null").select(F.col("d_text").alias("text"), "province_code"), districts.withColumnRenamed("province_code", "parent"), "district", "province_code")
    step = step.join(d.withColumnRenamed("text", "d_text"), ["d_text", "province_code"], "left")
    lone = districts.withColumn("_k", fold_accents(comparable_place(F.col("name")))).groupBy("_k").agg(F.count("*").alias("_n"), F.first("code").alias("u_code"), F.first("name").alias("u_name"), F.first("province_code").alias("u_province")).where("_n = 1")
    names = provinces.select(F.col("code").alias("u_province"), F.col("name").alias("u_province_name"))
    step = step.join(counted_broadcast(lone.join(names, "u_province")), fold_accents(comparable_place(F.col("d_text"))) == F.col("_k"), "left")
    step = step.withColumns({"district_code": F.coalesce("district_code", "u_code"), "district": F.coalesce("district", "u_name"), "province_code": F.coalesce("province_code", "u_province"), "province": F.coalesce("province", "u_province_name")})
    w = match_level(step.where("district_code is not null").select(F.col("w_text").alias("text"), "district_code"), wards.withColumnRenamed("district_code", "parent"), "ward", "district_code")
    step = step.join(w.withColumnRenamed("text", "w_text"), ["w_text", "district_code"], "left")
    found = step.select("p_text", "d_text", "w_text", "province", "province_code", "district", "district_code", "ward", "ward_code")
    same = F.col("_p.province").eqNullSafe(F.col("p_text")) & F.col("_p.district").eqNullSafe(F.col("d_text")) & F.col("_p.ward").eqNullSafe(F.col("w_text"))
    return parts.join(found, same, "left").withColumn("rest", F.col("_p.rest")).drop("_p", "p_text", "d_text", "w_text")
