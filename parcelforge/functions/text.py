"""Text functions as Column expressions. Texts are expected in NFC (``normalise_nfc`` at ingest)."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts that stand for a missing value.
PLACEHOLDERS = ("", "-", "none", "null", "nan", "n/a", "na", "không rõ")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once; else each use of a long expression is planned and computed anew."""
    return F.transform(F.array(value), body)[0]


@F.pandas_udf(T.StringType())
def normalise_nfc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def _accented() -> tuple[str, str]:
    """Lower-case letters with marks, and their base letters; by rule from the Unicode decompositions, with the stroked d."""
    marked, plain = ["đ"], ["d"]
    for point in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        c = chr(point).lower()
        base = unicodedata.normalize("NFD", c)
        if len(c) == 1 and len(base) > 1 and base[0].isascii() and all(unicodedata.combining(x) for x in base[1:]) and c not in marked:
            marked.append(c)
            plain.append(base[0])
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accented()


def fold_accents(c: Column) -> Column:
    """Lower case without accents and combining marks; ``đ`` becomes ``d``."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, UNACCENTED), r"\p{M}+", "")


def clean_text(c: Column) -> Column:
    """Trimmed, runs of white space as one space."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def nullify_placeholder(c: Column) -> Column:
    t = clean_text(c.cast("string"))
    return F.when(~F.lower(t).isin(*PLACEHOLDERS), t)


def comparable_text(c: Column) -> Column:
    """Accent-free letters and digits only."""
    return F.regexp_replace(fold_accents(c), "[^a-z0-9]", "")


def normalise_token(c: Column) -> Column:
    """Lower case without signs, spaces and underscores; accents stay."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}\p{M}]", "")


def digits_only(c: Column) -> Column:
    return F.regexp_replace(c, r"[^0-9]", "")


def digit_repair(c: Column, letters: str = "OQDIlLSBZ", digits: str = "000111582") -> Column:
    """Digits for the letters that recognisers confuse with them."""
    return F.translate(c, letters, digits)


def contains_any(c: Column, needles: Sequence[str]) -> Column:
    """Whether a text holds one of the needles; one alternation, so the text's expression stands in the plan once."""
    return c.rlike("|".join(rf"\Q{n}\E" for n in needles)) if needles else F.lit(False)


def derive_folder(path: Column) -> Column:
    """The directory of a path, '' without one."""
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(F.lit(""))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]+$", "")


def sanitise_name(c: Column) -> Column:
    """A file name without the characters that file systems refuse."""
    return clean_text(F.regexp_replace(c, r'[<>:"/\\|?*\x00-\x1F]', ""))


def strip_admin_prefix(c: Column) -> Column:
    """A place name without its level (province, city, district, town, ward, commune)."""
    return F.trim(F.regexp_replace(clean_text(c), r"(?iu)^(tỉnh|thành phố|tp\.?|quận|huyện|thị xã|thị trấn|phường|xã)\s+", ""))


def strip_serial_tail(c: Column) -> Column:
    """Without trailing codes of five digits and more; three deep."""
    out = c
    for _ in range(3):
        out = F.regexp_replace(out, r"[\s,;.\-]*\b[A-Za-z]{0,3}\s?\d{5,}\s*$", "")
    return F.trim(out)


def normalise_area_unit(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)\bm\s?(?:2|²|\^2)", "m²")


def vietnam_time(ts: Column) -> Column:
    """A UTC timestamp as text in GMT+7."""
    return F.date_format(F.from_utc_timestamp(ts, "+07:00"), "dd/MM/yyyy HH:mm:ss")


def detect_gender(c: Column) -> Column:
    """1 for a man's title or sex, 0 for a woman's, else null."""
    t = F.concat(F.lit(" "), F.lower(clean_text(c)), F.lit(" "))
    return F.when(t.rlike(r"[ :](ông|nam)[ :.,]"), 1).when(t.rlike(r"[ :](bà|nữ)[ :.,]"), 0)


def clean_person_name(c: Column) -> Column:
    """A name without titles, cut before spouse, birth or identity words, its words capitalised."""
    bare = F.regexp_replace(clean_text(c), r"(?iu)^(hộ\s+)?(ông|bà)(\s+và\s+(ông|bà))?\s*:?\s+", "")
    cut = F.regexp_replace(bare, r"(?iu)[,;(]?\s*(và\s+(vợ|chồng)|vợ\b|chồng\b|sinh\s+năm|năm\s+sinh|cmnd|cccd|số\s+cm).*$", "")
    return F.initcap(F.trim(F.regexp_replace(cut, r"[\s,;:.\-]+$", "")))


def distinct_joined(values: Column, sep: str = "+") -> Column:
    """The distinct values of an array in first-seen order, joined."""
    return F.array_join(F.array_distinct(values), sep)


def token_match_score(field: Column, token: Column) -> Column:
    """How far a token is evidence for a field's value, 0 to 1.

    1.0 for equal texts (signs and case aside), 0.98 for equal digits, 0.82 if
    one's digits of three and more contain the other's, 0.60 + 0.35 * shorter /
    longer if one text of three letters and more contains the other.
    """
    a, b = normalise_token(field), normalise_token(token)
    da, db = digits_only(field), digits_only(token)
    la, lb = F.length(a), F.length(b)
    inside = lambda x, y: x.contains(y) | y.contains(x)
    return (
        F.when((F.coalesce(la, F.lit(0)) == 0) | (F.coalesce(lb, F.lit(0)) == 0), F.lit(0.0))
        .when(a == b, F.lit(1.0))
        .when((F.length(da) > 0) & (da == db), F.lit(0.98))
        .when((F.least(F.length(da), F.length(db)) >= 3) & inside(da, db), F.lit(0.82))
        .when((F.least(la, lb) >= 3) & inside(a, b), F.lit(0.6) + F.lit(0.35) * F.least(la, lb) / F.greatest(la, lb))
        .otherwise(F.lit(0.0))
    )


def char_error_rate(reading: Column, truth: Column) -> Column:
    """Edit distance over the truth's length; 0 for two empty texts, 1 for an empty truth."""
    n = F.length(truth)
    return F.when(n > 0, F.levenshtein(reading, truth) / n).otherwise(F.when(F.length(reading) == 0, F.lit(0.0)).otherwise(F.lit(1.0)))
