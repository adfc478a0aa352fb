"""Merging the pages of a document: page roles, ranking of candidates, precedence, provenance and review sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import validators as v
from parcelforge.functions.text import contains_any, digits_only, fold_accents, nullify_placeholder

#: Words that tell a household, an organisation and a community, in this order, those of a couple, and the lines of a page that are read for them.
OWNER_WORDS = (
    ("ho_gia_dinh", ("hộ gia đình", "hộ ông", "hộ bà", "hộ:", "hộ ")),
    ("to_chuc", ("công ty", "tnhh", "cổ phần", "doanh nghiệp", "ubnd", "ủy ban", "hợp tác xã", "ban quản lý")),
    ("cong_dong", ("cộng đồng", "tôn giáo", "chùa", "nhà thờ", "đền", "đình", "giáo họ")),
)
COUPLE_WORDS = ("vợ là", "chồng là", "và bà", "và ông", "và vợ", "và chồng")
OWNER_LINES = 15


def longer_wins(current: Column, other: Column) -> Column:
    """``other`` where it is longer, or there is nothing else."""
    return F.when(current.isNull() | (F.length(other) > F.length(current)), F.coalesce(other, current)).otherwise(current)


def more_of(kind: Column, a: str, b: str) -> Column:
    return F.count_if(kind == a) > F.count_if(kind == b)


def best_candidate(value: Column, scores: Sequence[Column], order: Column) -> Column:
    """The value of the highest scores, the earliest of equals; an aggregate."""
    return F.max_by(value, F.struct(*scores, (-order).alias("_first")))


def first_non_empty(values: DataFrame, document: Sequence[str], field: str, value: str, rank: Sequence[Column]) -> DataFrame:
    """Each document's and field's first value in the order of ``rank`` that is no placeholder nor ``0``; no row where there is none."""
    good = nullify_placeholder(F.col(value)).isNotNull() & (F.trim(value) != "0")
    others = [c for c in values.columns if c not in (*document, field)]
    best = F.min_by(F.struct(*others), F.when(good, F.struct(*[r.alias(f"r{i}") for i, r in enumerate(rank)]))).alias("b")
    return values.groupBy(*document, field).agg(best).where("b is not null").select(*document, field, *[F.col(f"b.{c}").alias(c) for c in others])


def field_result(raw: Column, check: Column, confidence: Column) -> Column:
    """value, confidence, status and reason of a field: missing without a reading; at most 0.40 sure and for review where its validator refuses it."""
    ok = check["ok"]
    missing = nullify_placeholder(raw).isNull()
    return F.struct(
        F.when(~missing, F.coalesce(check["value"], raw)).alias("value"),
        F.when(missing, F.lit(0.0)).when(ok, confidence).otherwise(F.least(confidence, F.lit(0.4))).alias("confidence"),
        F.when(missing, "missing").when(ok, "valid").otherwise("review_required").alias("status"),
        F.when(~missing, check["reason"]).alias("reason"),
    )


def serial_from_name(name: Column) -> Column:
    """Two letters and six digits of a file name, not part of a longer run; null if there are none."""
    shape = r"(?<![A-Z0-9])([A-Z]{2})[ _\-.]?([0-9]{6})(?![A-Z0-9])"
    up = F.upper(name)
    return F.when(up.rlike(shape), F.concat_ws(" ", F.regexp_extract(up, shape, 1), F.regexp_extract(up, shape, 2)))


def cross_validate_serial(reading: Column, file_name: Column, barcode: Column) -> Column:
    """value and confidence of a serial from the reading, the file's name and the barcode."""
    f, o = serial_from_name(file_name), v.v_serial(reading)["value"]
    ok = v.v_serial(reading)["ok"]
    o = F.when(ok, o)
    in_code = F.contains(digits_only(F.coalesce(barcode, F.lit(""))), F.element_at(F.split(f, " "), -1))
    odd = (F.length(reading) > 15) | ~F.coalesce(o.rlike(r"^\p{L}{2} \d{6}$"), F.lit(False))
    of = lambda value, c: F.struct(value.alias("value"), F.lit(float(c)).alias("confidence"))
    return (
        F.when(f.isNull() & o.isNull(), of(F.lit(None).cast("string"), 0))
        .when(f.isNull(), of(o, 0.8))
        .when(o.isNull(), of(f, 0.85))
        .when(f == o, of(o, 1))
        .when(in_code, of(f, 0.95))
        .when(odd, of(f, 0.9))
        .otherwise(of(f, 0.85))
    )


def path_hint_check(reading: Column, hint: Column) -> Column:
    """value and status of a reading beside what the path says; the path fills blanks only."""
    blank, no_hint = nullify_placeholder(reading).isNull(), nullify_placeholder(hint).isNull()
    status = F.when(no_hint, "not_available").when(blank, "filled_from_path").when(F.lower(F.trim(reading)) == F.lower(F.trim(hint)), "matched").otherwise("mismatch")
    return F.struct(F.when(blank & ~no_hint, hint).otherwise(reading).alias("value"), status.alias("status"))


def split_couple(name: Column) -> Column:
    """first, second and joint of a name that may be a couple's ("A và vợ B")."""
    shape = r"(?iu)^(.*?)\s*(?:,|;)?\s*(?:và|cùng)\s*(?:vợ|chồng)(?:\s*là)?\s*:?\s*(?:(?:ông|bà)\b\s*:?\s*)?(.+)$"
    two = name.rlike(shape)
    return F.struct(F.when(two, F.trim(F.regexp_extract(name, shape, 1))).otherwise(name).alias("first"), F.when(two, F.trim(F.regexp_extract(name, shape, 2))).alias("second"), F.coalesce(two, F.lit(False)).alias("joint"))


def birth_from_identity(number: Column) -> Column:
    """The year that a 12-digit identity number encodes; null for others."""
    d = digits_only(number)
    century = F.substring(d, 4, 1)
    return F.when((F.length(d) == 12) & century.isin("0", "1"), F.concat(F.lit("19"), F.substring(d, 5, 2))).when((F.length(d) == 12) & century.isin("2", "3"), F.concat(F.lit("20"), F.substring(d, 5, 2)))


def owner_type(name: Column, n_heirs: Column, lines: Column | None = None, spouse: Column | None = None) -> Column:
    """What an owner is, the first that holds: heirs together, a household, an organisation, a community, a couple, a person. Households, organisations and communities are told by the name or by the first fifteen lines of the page."""
    own = F.lower(F.coalesce(name, F.lit("")))
    page = F.concat_ws(" ", own, F.lower(F.array_join(F.slice(lines, 1, OWNER_LINES), " "))) if lines is not None else own
    couple = contains_any(own, COUPLE_WORDS)
    if spouse is not None:
        couple = couple | (F.coalesce(F.trim(spouse), F.lit("")) != "")
    out = F.when(n_heirs > 0, "dong_thua_ke")
    for kind, words in OWNER_WORDS:
        out = out.when(contains_any(F.concat(page, F.lit(" ")), words), kind)
    return out.when(couple, "vo_chong").otherwise("ca_nhan")


def endorsement_type(text: Column) -> Column:
    """What a change entry is; a release of a mortgage before a mortgage, before a transfer, before a correction."""
    folded = fold_accents(text)
    return (
        F.when(folded.rlike(r"xoa (dang ky )?the chap|giai chap"), "release")
        .when(folded.contains("the chap"), "mortgage")
        .when(folded.rlike("chuyen nhuong|tang cho|thua ke|nhan quyen"), "transfer")
        .when(folded.rlike("dinh chinh|thay doi|cap doi|so cccd|so cmnd"), "correction")
        .otherwise("other")
    )


def fallback_changes(changes: Column) -> Column:
    """sheet, owner and identity of an array of change texts, first to last: a corrected map sheet; the last transfer's recipient, no bank or authority, with the number in its text; without a transfer a replaced number."""
    sheet = F.regexp_extract(F.array_join(changes, "\n"), r"(?iu)tờ\s*bản\s*đồ\s*(?:số)?\s*(?:thành|là|:)\s*(\d+)", 1)
    named = r"(?iu)(?:chuyển\s*nhượng|tặng\s*cho|thừa\s*kế|để\s*thừa\s*kế)\s*(?:cho)?\s*(?:(?:hộ\s*)?(?:ông|bà)\s*:?\s*)?([\p{Lu}][\p{L} ]{3,60}?)(?=\s*(?:,|;|\.|\n|sinh|cmnd|cccd|số|theo|$))"
    of = F.transform(F.reverse(changes), lambda t: F.struct(F.trim(F.regexp_extract(t, named, 1)).alias("name"), t.alias("text")))
    real = F.filter(of, lambda x: (F.length(x["name"]) > 3) & ~fold_accents(x["name"]).rlike("ngan hang|chi nhanh|van phong|uy ban|quy tin dung"))
    last = F.get(real, F.lit(0))
    own = F.regexp_extract(last["text"], r"\b(\d{12}|\d{9})\b", 1)
    other = F.regexp_extract(F.array_join(F.reverse(changes), "\n"), r"\b(\d{12})\b", 1)
    blank = lambda c: F.nullif(c, F.lit(""))
    return F.struct(blank(sheet).alias("sheet"), last["name"].alias("owner"), F.when(last.isNotNull(), blank(own)).otherwise(blank(other)).alias("identity"))


def pair_status_counts(pairs: DataFrame) -> DataFrame:
    """One row: pairs by status (both, gcn_only, gt_only) and all of them."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return pairs.agg(of("both"), of("gcn_only"), of("gt_only"), F.count("*").alias("pairs"))


def audit_status_counts(audits: DataFrame) -> DataFrame:
    """One row: audited crops by status."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return audits.agg(of("supported"), of("review_required"), of("not_available"))


#: Labels that stand for a name where the reading is none, accent-free.
NAME_LABELS = ("ho ten", "ho va ten", "nguoi su dung dat", "chu so huu", "ten nguoi su dung")


def enrich_owner_from_card(documents: DataFrame, cards: DataFrame) -> DataFrame:
    """Documents (doc_id, ho_ten_chu_1, cccd_chu_1, nam_sinh_chu_1, gioi_tinh, dia_chi_thuong_tru) with what an identity card says: its number, birth and sex always, its name where the document has none or a label's words, its address where it is longer.

    ``cards`` has doc_id and so_cccd, ho_ten, ngay_sinh, gioi_tinh,
    noi_thuong_tru; of several cards of a document the one with the smallest
    number counts. ``enriched`` lists the fields that the card gave.
    """
    names = ("so_cccd", "ho_ten", "ngay_sinh", "gioi_tinh", "noi_thuong_tru")
    one = cards.groupBy("doc_id").agg(F.min_by(F.struct(*[nullify_placeholder(F.col(c)).alias(c) for c in names]), F.struct(F.col("so_cccd").isNull(), "so_cccd")).alias("_card"))
    out = documents.join(one, "doc_id", "left")
    card = lambda c: F.col(f"_card.{c}")
    have = set(documents.columns)
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    label = contains_any(fold_accents(F.coalesce(own("ho_ten_chu_1"), F.lit(""))), NAME_LABELS)
    new = {
        "cccd_chu_1": F.coalesce(card("so_cccd"), own("cccd_chu_1")),
        "nam_sinh_chu_1": F.coalesce(card("ngay_sinh"), own("nam_sinh_chu_1")),
        "gioi_tinh": F.coalesce(card("gioi_tinh"), own("gioi_tinh")),
        "ho_ten_chu_1": F.when(nullify_placeholder(own("ho_ten_chu_1")).isNull() | label, F.coalesce(card("ho_ten"), own("ho_ten_chu_1"))).otherwise(own("ho_ten_chu_1")),
        "dia_chi_thuong_tru": longer_wins(nullify_placeholder(own("dia_chi_thuong_tru")), card("noi_thuong_tru")),
    }
    gave = F.array_compact(F.array(*[F.when(~x.eqNullSafe(own(c)), F.lit(c)) for c, x in new.items()]))
    out = out.withColumn("enriched", gave)
    return out.select(*[(new[c].alias(c) if c in new else F.col(c)) for c in [*documents.columns, *[c for c in new if c not in have]]], "enriched")
