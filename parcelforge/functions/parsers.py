"""Parsers of recognised lines as Column expressions: areas, identity papers, codes, border tokens."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelforge.functions import validators as v
from parcelforge.functions.fuzzy import words_to_number_vi
from parcelforge.functions.text import clean_text, contains_any, digits_only, fold_accents
from parcelforge.functions.validators import let

# ---------------------------------------------------------------- fixed values
CARD_LABELS = ("ho va ten", "ho chu dem va ten", "ho, chu dem va ten", "full name", "ho ten", "khai sinh")
CARD_WORDS = "can cuoc|cong dan|cong hoa|xa hoi|chu nghia|doc lap|identity|card|citizen|socialist|republic|viet nam|ngay sinh|date of birth|gioi tinh|que quan|noi thuong tru"
ORIENTATION_HEADS = ("CONG HOA XA HOI CHU NGHIA VIET NAM", "DOC LAP - TU DO - HANH PHUC", "GIAY CHUNG NHAN")
# Wording of towns and of the country, places of either, and keywords of a use with its code, in order of precedence.
URBAN, RURAL = ("đô thị", "do thi"), ("nông thôn", "nong thon")
URBAN_PLACES, RURAL_PLACES = ("quận", "quan", "phường", "phuong", "thị trấn"), ("huyện", "xã")
PURPOSE_CODES = (
    (("nha o",), "ONT"), (("lau nam",), "CLN"), (("hang nam",), "HNK"), (("thuy san",), "NTS"), (("lua",), "LUC"), (("rung san xuat",), "RSX"), (("rung phong ho",), "RPH"),
    (("san xuat kinh doanh",), "SKC"), (("thuong mai",), "TMD"), (("phi nong nghiep",), "PNN"),
)
# ---------------------------------------------------------------- end of fixed values


def _blank(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def parse_number(text: Column) -> Column:
    """A number with points or commas for thousands and decimals: the last sign decides if both are there, one sign before three digits separates thousands."""

    def read(n: Column) -> Column:
        both = n.contains(".") & n.contains(",")
        comma_last = F.instr(F.reverse(n), ",") < F.instr(F.reverse(n), ".")
        european, american = F.regexp_replace(F.regexp_replace(n, r"\.", ""), ",", "."), F.regexp_replace(n, ",", "")
        thousands = n.rlike(r"^\d{1,3}([.,]\d{3})+$")
        return F.when(both & comma_last, european).when(both, american).when(thousands, F.regexp_replace(n, "[.,]", "")).otherwise(F.regexp_replace(n, ",", ".")).try_cast("double")

    first = F.regexp_extract(text, r"(\d{1,3}(?:\.\d{3})+(?:,\d+)?|\d{1,3}(?:,\d{3})+(?:\.\d+)?|\d+(?:[.,]\d+)?)", 1)
    return let(first, read)


def parse_area_text(text: Column) -> Column:
    """value and unit of an area as it is written."""
    unit = F.regexp_extract(text, r"(?iu)(m[²2]|mét\s*vuông)", 1)
    return F.struct(parse_number(text).alias("value"), _blank(unit).alias("unit"))


def parse_area(lines: Column) -> Column:
    """granted, private, shared and words of a page's lines: the number after each label; the words' number where the granted one is missing; all private where nothing is shared."""

    def labelled(label: str) -> Column:
        after = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, rf"(?iu){label}\s*[:.]?\s*([\d.,]+)", 1)), lambda x: x != "")
        return parse_number(F.get(after, F.lit(0)))

    words = F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?iu)bằng\s*chữ\s*[:.]?\s*\(?(.+?)\)?\s*(?:mét\s*vuông|m2|m²|$)", 1)), lambda x: x != ""), F.lit(0))
    parts = F.struct(labelled(r"(?:diện|điện)\s*tích(?:\s*(?:cấp|đất))?").alias("granted"), labelled("riêng").alias("private"), labelled("chung").alias("shared"), words.alias("words"))
    return parts


def settle_area(area: Column, from_words: Column) -> Column:
    """The parsed areas with their mutual fallbacks; ``from_words`` is the words' number (``words_to_number_vi`` of area.words)."""
    granted = F.coalesce(area["granted"], from_words, area["private"] + F.coalesce(area["shared"], F.lit(0.0)))
    shared = F.coalesce(area["shared"], F.lit(0.0))
    return F.struct(granted.alias("granted"), F.coalesce(area["private"], F.when(shared == 0, granted)).alias("private"), shared.alias("shared"), area["words"].alias("words"))


def area_from_words(area: Column) -> Column:
    return words_to_number_vi(F.lower(area["words"]))


def _runs(text: Column, pattern: str, words: bool) -> Column:
    beside = r"[\p{L}\p{M}\p{N}_]" if words else r"\d"
    return F.array_distinct(F.regexp_extract_all(text, F.lit(rf"(?<!{beside})({pattern})(?!{beside})"), 1))


def identity_numbers(text: Column, words: bool = False) -> Column:
    """The distinct runs of 9 or 12 digits, in order; with ``words`` only those that are words, not parts of one."""
    return _runs(text, r"\d{12}|\d{9}", words)


def birth_years(text: Column, words: bool = False) -> Column:
    """The distinct runs of four digits that begin with 19 or 20, in order; with ``words`` only those that are words."""
    return _runs(text, r"(?:19|20)\d{2}", words)


def machine_readable(lines: Column) -> Column:
    """so_cccd, ho_ten, ngay_sinh and gioi_tinh of a card's machine readable lines."""
    joined = F.transform(lines, lambda x: F.upper(F.regexp_replace(x, " ", "")))
    first = lambda pattern, i: _blank(F.get(F.filter(F.transform(joined, lambda x: F.regexp_extract(x, pattern, i)), lambda x: x != ""), F.lit(0)))
    date = r"(\d{2})(\d{2})(\d{2})\d([MF])\d{6}"
    year = first(date, 1)
    century = F.when(year.try_cast("int") > 25, "19").otherwise("20")
    name = F.get(F.filter(joined, lambda x: x.contains("<<") & ~x.rlike(r"\d")), F.lit(0))
    parts = F.filter(F.split(name, "<"), lambda p: p != "")
    return F.struct(
        first(r"^IDVNM\d{3}(\d{9,12})", 1).alias("so_cccd"),
        F.when(F.size(parts) >= 2, F.array_join(parts, " ")).alias("ho_ten"),
        F.when(year.isNotNull(), F.concat_ws("/", first(date, 3), first(date, 2), F.concat(century, year))).alias("ngay_sinh"),
        F.when(first(date, 4) == "M", "nam").when(first(date, 4) == "F", "nữ").alias("gioi_tinh"),
    )


def card_number(lines: Column) -> Column:
    """A card's number: twelve digits from 0 in one line, else what follows a label or stands below it, else any twelve, else nine."""
    first = lambda xs: F.get(F.filter(xs, lambda x: x != ""), F.lit(0))
    alone = first(F.transform(lines, lambda x: F.regexp_extract(F.regexp_replace(x, r"\s+", ""), r"(?<!\d)(0\d{11})(?!\d)", 1)))
    label = r"(so dinh danh|\bso\b|\bno\b|identification)"
    beside = first(F.transform(lines, lambda x: F.when(fold_accents(x).rlike(label), F.regexp_extract(x, r"(\d{9,12})", 1)).otherwise("")))
    below = first(F.transform(lines, lambda x, i: F.when((i > 0) & fold_accents(F.coalesce(F.get(lines, i - 1), F.lit(""))).rlike(label), F.regexp_extract(F.trim(x), r"^(\d{9,12})$", 1)).otherwise("")))
    text = F.array_join(lines, "\n")
    any_ = lambda p: _blank(F.regexp_extract(text, p, 1))
    return F.coalesce(alone, beside, below, any_(r"(?<!\d)(0\d{11})(?!\d)"), any_(r"(?<!\d)(\d{9})(?!\d)"))


def card_name(lines: Column) -> Column:
    """A card's name: what follows its label or stands below it, 4 to 40 letters of six words at most, mostly capitals."""
    folded = lambda x: F.regexp_replace(fold_accents(x), r"\s+", " ")
    labelled = lambda x: F.exists(F.array(*[F.lit(w) for w in CARD_LABELS]), lambda w: F.contains(folded(x), w))

    def good(x: Column) -> Column:
        words = F.filter(F.split(F.trim(x), r"\s+"), lambda w: w != "")
        capital = F.size(F.filter(words, lambda w: w == F.upper(w)))
        return F.length(F.trim(x)).between(4, 40) & ~x.rlike(r"\d") & (F.size(words) <= 6) & (capital >= 0.7 * F.size(words)) & ~folded(x).rlike(CARD_WORDS) & ~labelled(x)

    beside = F.transform(F.filter(lines, labelled), lambda x: F.trim(F.regexp_extract(x, r"[:;/]\s*([^:;/]+)$", 1)))
    below = F.filter(lines, lambda x, i: (i > 0) & labelled(F.coalesce(F.get(lines, i - 1), F.lit(""))))
    return F.get(F.filter(F.concat(beside, below), good), F.lit(0))


def parse_id_card(lines: Column) -> Column:
    """so_cccd, ho_ten, ngay_sinh, gioi_tinh, noi_thuong_tru, ngay_cap of a card's lines, filled and corrected from its machine readable ones."""
    after = lambda label: F.get(F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, rf"(?iu)(?:{label})[^:]*:\s*(.+)$", 1))), lambda x: x != ""), F.lit(0))
    dates = F.regexp_extract_all(F.array_join(lines, "\n"), F.lit(r"(\d{2}/\d{2}/\d{4})"), 1)
    read = F.struct(card_number(lines).alias("so_cccd"), card_name(lines).alias("ho_ten"), F.get(dates, F.lit(0)).alias("ngay_sinh"), after("giới tính|sex").alias("sex"), after("nơi thường trú|residence").alias("home"), F.get(F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"(?iu)(?:ngày cấp|date of issue)\D*(\d{2}/\d{2}/\d{4})", 1)), lambda x: x != ""), F.lit(0)).alias("issued"))

    def settle(p: Column) -> Column:
        r, m = p["read"], p["zone"]
        unsure = r["ho_ten"].isNull() | ~r["ho_ten"].contains(" ")
        sex = fold_accents(F.coalesce(r["sex"], F.lit("")))
        return F.struct(
            F.coalesce(r["so_cccd"], m["so_cccd"]).alias("so_cccd"),
            F.when(unsure, F.coalesce(m["ho_ten"], r["ho_ten"])).otherwise(r["ho_ten"]).alias("ho_ten"),
            F.coalesce(r["ngay_sinh"], m["ngay_sinh"]).alias("ngay_sinh"),
            F.coalesce(F.when(sex.startswith("nu") | sex.startswith("female"), "nữ").when(sex.startswith("nam") | sex.startswith("male"), "nam"), m["gioi_tinh"]).alias("gioi_tinh"),
            r["home"].alias("noi_thuong_tru"),
            r["issued"].alias("ngay_cap"),
        )

    return let(F.struct(read.alias("read"), machine_readable(lines).alias("zone")), settle)


def audit_identity(source: Column, readings: Column) -> Column:
    """status and reason of a card number against re-readings of its crop: supported if one agrees, review_required if others do not, not_available without any of 9 or 12 digits."""
    good = F.filter(F.transform(readings, digits_only), lambda d: F.length(d).isin(9, 12))
    own = digits_only(F.coalesce(source, F.lit("")))
    return (
        F.when(F.size(good) == 0, F.struct(F.lit("not_available").alias("status"), F.lit("no_reading").alias("reason")))
        .when(own == "", F.struct(F.lit("review_required").alias("status"), F.lit("no_source").alias("reason")))
        .when(F.array_contains(good, own), F.struct(F.lit("supported").alias("status"), F.lit("digits_agree").alias("reason")))
        .otherwise(F.struct(F.lit("review_required").alias("status"), F.lit("digits_differ").alias("reason")))
    )


def barcode_ladder(direct: Column, direct_confidence: Column, reread: Column, page_digits: Column) -> Column:
    """value and step of a barcode: the direct reading if it is sure and full, else the widened re-reading, else the longest run on the page."""
    full = lambda d: F.length(d).isin(13, 15)
    d, r = digits_only(F.coalesce(direct, F.lit(""))), digits_only(F.coalesce(reread, F.lit("")))
    runs = F.filter(page_digits, lambda x: F.length(x).between(13, 15))
    of = lambda value, step: F.struct(value.alias("value"), F.lit(step).alias("step"))
    return F.when(full(d) & (direct_confidence >= 0.9), of(d, "direct")).when(full(r), of(r, "reread")).when(F.size(runs) > 0, of(F.get(runs, F.lit(0)), "page")).when(full(d), of(d, "unsure")).otherwise(of(F.lit(None).cast("string"), "none"))


def prune_border(text: Column, labels: str | None = None, unit: bool = False) -> Column:
    """raw, pruned and removed of a cell: a leading label (a pattern), list marks, a unit and signs at the ends go; nothing raw is lost."""
    t = clean_text(F.coalesce(text, F.lit("")))
    lead = rf"(?iu)^(?:{labels})\s*[:.\-]?\s*" if labels else r"^(?:[a-zA-Zđ0-9]\s*[).]\s+|[\-–•*]\s*)+"
    tail = (r"(?iu)\s*m(?:2|²)?\s*[.,;:]*$|" if unit else "") + r"[\s.,;:\-–|_]+$"
    head = F.regexp_extract(t, f"({lead.replace('(?iu)', '(?iu:', 1) + ')' if lead.startswith('(?iu)') else lead})", 1)

    def cut(rest: Column) -> Column:
        pruned = F.trim(F.regexp_replace(F.regexp_replace(rest, tail, ""), tail, ""))
        end = F.trim(F.substring(rest, F.length(pruned) + 1, F.length(rest)))
        return F.struct(text.alias("raw"), pruned.alias("pruned"), F.filter(F.array(F.trim(head), end), lambda x: x != "").alias("removed"))

    return let(F.regexp_replace(t, lead, ""), cut)


def map_purpose(code: Column, wording: Column) -> Column:
    """A land use code from a code and the purpose's wording, each standing in for the other where it is blank; '' if nothing tells.

    Urban or rural wording decides before the code does; a valid code is taken,
    of a joined urban and rural one what the places in the wording say, else
    the urban one; then the purposes of the wording, then its keywords.
    """
    own = F.coalesce(F.nullif(F.trim(code), F.lit("")), F.trim(wording), F.lit(""))
    said = F.coalesce(F.nullif(F.trim(wording), F.lit("")), own)

    def decide(x: Column) -> Column:
        low, folded = F.lower(x["said"]), fold_accents(x["said"])
        given, told = v.v_land_code(x["own"]), v.v_purpose(x["own"])
        both = given["value"].contains("ONT") & given["value"].contains("ODT")
        out = F.when(x["own"] == "", "").when(contains_any(low, URBAN), "ODT").when(contains_any(low, RURAL), "ONT").when(F.upper(x["own"]) == "LUA", "LUC")
        out = out.when(given["ok"] & both & contains_any(low, URBAN_PLACES), "ODT").when(given["ok"] & both & contains_any(low, RURAL_PLACES), "ONT").when(given["ok"] & both, "ODT")
        out = out.when(given["ok"], given["value"]).when(told["ok"], told["code"])
        for words, k in PURPOSE_CODES:
            out = out.when(contains_any(folded, words), k)
        return out.otherwise("")

    return let(F.struct(own.alias("own"), said.alias("said")), decide)


def upside_down(tops: Sequence[Column] | Column, height: Column) -> Column:
    """Whether a page's headings stand in its lower half: an array of (text, y) structs."""
    heads = F.filter(tops, lambda t: F.exists(F.array(*[F.lit(h) for h in ORIENTATION_HEADS]), lambda h: F.contains(F.upper(fold_accents(t["text"])), h)))
    low = F.size(F.filter(heads, lambda t: t["y"] > 0.6 * height))
    return (low > 0) & (low * 2 > F.size(heads))


def signing_block(role_box: Column, name_box: Column) -> Column:
    """Whether a name's box is below a role's, as a signature is; structs of x1, y1, x2, y2."""
    h = F.greatest(F.lit(1.0), role_box["y2"] - role_box["y1"])
    wide = F.greatest(role_box["x2"] - role_box["x1"], name_box["x2"] - name_box["x1"])
    dy = name_box["y1"] - role_box["y2"]
    gap = F.greatest(F.lit(0.0), F.greatest(role_box["x1"], name_box["x1"]) - F.least(role_box["x2"], name_box["x2"]))
    return (dy >= -0.35 * h) & (dy <= F.greatest(F.lit(500.0), 22 * h)) & (gap <= F.greatest(F.lit(160.0), F.least(F.lit(500.0), 2.5 * wide)))


@F.pandas_udf(T.DoubleType())
def word_error_rate(readings: pd.Series, truths: pd.Series) -> pd.Series:
    """Edit distance in words over the truth's words."""

    def rate(a: str | None, b: str | None) -> float | None:
        if a is None or b is None:
            return None
        x, y = a.split(), b.split()
        row = list(range(len(y) + 1))
        for i, w in enumerate(x, 1):
            before, row[0] = row[0], i
            for j, u in enumerate(y, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (w != u))
        return row[-1] / len(y) if y else float(bool(x))

    return pd.Series([rate(a, b) for a, b in zip(readings, truths, strict=True)], dtype="float64")
