"""Parsers of a page's lines (an array of texts in reading order): owners, heirs, transfers and the certification block."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions import validators as v
from parcelforge.functions.labels import after_label, before_label, holds
from parcelforge.functions.parsers import birth_years, identity_numbers
from parcelforge.functions.text import clean_person_name, clean_text, digits_only, fold_accents
from parcelforge.functions.validators import let
from parcelforge.operators.merge import owner_type, split_couple

# ---------------------------------------------------------------- fixed values
# Abbreviations of addresses and what they stand for, in the order of their use.
ABBREVIATIONS = (
    (r"tp\.?\s", "thành phố "), (r"tx\.?\s", "thị xã "), (r"tt\.?\s", "thị trấn "), (r"p\.\s?(?=\p{Lu}|\d)", "phường "), (r"q\.\s?(?=\p{Lu}|\d)", "quận "), (r"h\.\s?(?=\p{Lu})", "huyện "),
    (r"x\.\s?(?=\p{Lu})", "xã "), (r"t\.\s?(?=\p{Lu})", "tỉnh "), (r"đ\.\s?(?=\p{Lu})", "đường "), (r"kp\.?\s?(?=\d)", "khu phố "), (r"tdp\.?\s?(?=\d)", "tổ dân phố "),
)
CUT_WORDS = "theo ho so|chuyen nhuong|tang cho|thua ke|la nguoi dai dien|nhung nguoi|dai dien|cap doi"
REPRESENTATIVE = "nguoi dai dien|nhung nguoi (duoc )?(huong )?thua ke|dong thua ke"
MOST_HEIRS = 10
# ---------------------------------------------------------------- end of fixed values


def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda x: x.isNotNull() & (x != "")), F.lit(0))


def _after(lines: Column, label: str) -> Column:
    """What follows a label (accented and plain spellings in one pattern) in the first line that has it."""
    return _first(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, rf"(?iu)(?:{label})\s*[:.]?\s*(.+)$", 1))))


def expand_abbreviations(address: Column) -> Column:
    out = clean_text(address)
    for short, long in ABBREVIATIONS:
        out = F.regexp_replace(out, rf"(?<![\p{{L}}])(?i:{short.split('(?=')[0]})" + ("(?=" + short.split("(?=", 1)[1] if "(?=" in short else ""), long)
    return F.regexp_replace(out, r"\s*,\s*", ", ")


def truncate_after_province(address: Column) -> Column:
    """An address up to its province, or its city where it names no province; what business words begin is cut."""

    def cut(t: Column) -> Column:
        folded = fold_accents(t)
        at = F.length(F.regexp_extract(folded, rf"^(.*?)\s*\b(?:{CUT_WORDS})\b", 1))
        short = F.when(folded.rlike(rf"\b({CUT_WORDS})\b"), F.substring(t, F.lit(1), at)).otherwise(t)
        province = F.regexp_extract(short, r"(?iu)^(.*\b(?:tỉnh|tinh)\s+[^,;\n]+)", 1)
        city = F.regexp_extract(short, r"(?iu)^(.*\b(?:thành\s*phố|thanh\s*pho|tp\.?)\s+[^,;\n]+)", 1)
        return F.regexp_replace(F.when(province != "", province).when(city != "", city).otherwise(short), r"[\s\-:;,.]+$", "")

    return let(clean_text(address), cut)


def extract_heirs(lines: Column) -> Column:
    """ho_ten, cmnd, ngay_sinh and gioi_tinh of the people in the ten lines after the representative's line, each once by name."""
    found = F.array_min(F.transform(lines, lambda x, i: F.when(fold_accents(x).rlike(REPRESENTATIVE), i)))
    below = F.when(found.isNotNull(), F.slice(lines, found + 2, F.lit(MOST_HEIRS)))
    people = F.filter(below, lambda x: x.rlike(r"(?iu)\b(ông|bà)\b") & ~x.rlike("(?iu)thường trú"))
    row = lambda x: F.struct(
        clean_person_name(F.regexp_extract(x, r"(?iu)((?:ông|bà)\s*:?\s*[^,;(\d]+)", 1)).alias("ho_ten"),
        F.get(identity_numbers(x), F.lit(0)).alias("cmnd"),
        F.get(birth_years(x), F.lit(0)).alias("ngay_sinh"),
        F.when(x.rlike(r"(?iu)\bông\b"), "nam").otherwise("nữ").alias("gioi_tinh"),
    )

    def once(rows: Column) -> Column:
        names = F.transform(rows, lambda r: fold_accents(r["ho_ten"]))
        return F.filter(rows, lambda r, i: (F.array_position(names, fold_accents(r["ho_ten"])) == i + 1) & (r["ho_ten"] != ""))

    return F.coalesce(let(F.transform(people, row), once), F.array().cast("array<struct<ho_ten:string,cmnd:string,ngay_sinh:string,gioi_tinh:string>>"))


def parse_owner(lines: Column) -> Column:
    """Names, identity numbers, birth years and addresses of one or two owners, the owner's type and the heirs."""
    people = F.filter(lines, lambda x: x.rlike(r"(?iu)^\s*(?:\d+[.)]\s*)?(hộ\s+)?(ông|bà|hộ gia đình)\b") & ~fold_accents(x).rlike("dai dien"))
    organisation = _first(F.transform(lines, lambda x: F.when(fold_accents(x).rlike(r"^\s*(cong ty|hop tac xa|doanh nghiep)"), F.trim(x))))
    homes = F.filter(F.transform(lines, lambda x: F.trim(F.regexp_extract(x, r"(?iu)(?:địa chỉ|dia chi)(?:\s*thường trú)?\s*:?\s*(.+)$", 1))), lambda x: x != "")

    def settle(p: Column) -> Column:
        text = F.array_join(p["people"], "\n")
        couple = split_couple(F.coalesce(F.get(p["people"], F.lit(0)), p["organisation"]))
        second = F.coalesce(couple["second"], F.get(p["people"], F.lit(1)))
        ids, years = identity_numbers(F.concat_ws("\n", text, F.array_join(lines, "\n"))), birth_years(text)
        return F.struct(
            F.coalesce(p["organisation"], F.nullif(clean_person_name(couple["first"]), F.lit(""))).alias("ho_ten_chu_1"),
            F.get(ids, F.lit(0)).alias("cmnd_chu_1"),
            F.get(years, F.lit(0)).alias("ngay_sinh_chu_1"),
            F.nullif(clean_person_name(second), F.lit("")).alias("ho_ten_chu_2"),
            F.when(second.isNotNull(), F.get(ids, F.lit(1))).alias("cmnd_chu_2"),
            F.when(second.isNotNull(), F.get(years, F.lit(1))).alias("ngay_sinh_chu_2"),
            v.clean_address(F.get(p["homes"], F.lit(0))).alias("dia_chi_thuong_tru"),
            F.when(F.size(p["homes"]) > 1, v.clean_address(F.get(p["homes"], F.lit(1)))).alias("dia_chi_thuong_tru_chu_2"),
            owner_type(F.coalesce(p["organisation"], F.get(p["people"], F.lit(0))), F.size(p["heirs"]), lines, second).alias("loai_chu"),
            p["heirs"].alias("dong_thua_ke"),
        )

    return let(F.struct(people.alias("people"), organisation.alias("organisation"), homes.alias("homes"), extract_heirs(lines).alias("heirs")), settle)


def parse_transfer(records: Column) -> Column:
    """Of an array of change records the last one's recipients, their numbers, address, file number and date."""
    last = F.try_element_at(F.filter(records, lambda r: fold_accents(r).rlike("chuyen nhuong|tang cho|thua ke|nhan quyen")), F.lit(-1))

    def read(t: Column) -> Column:
        who = F.regexp_extract_all(t, F.lit(r"(?iu)((?:ông|bà)\s*:?\s*\p{Lu}[\p{L} ]{2,50}?)(?=\s*(?:,|;|\.|và|sinh|cmnd|cccd|số|theo|$))"), 1)
        ids = identity_numbers(t)
        blank = lambda c: F.nullif(F.trim(c), F.lit(""))
        return F.struct(
            clean_person_name(F.get(who, F.lit(0))).alias("ben_nhan_1"),
            clean_person_name(F.get(who, F.lit(1))).alias("ben_nhan_2"),
            F.get(ids, F.lit(0)).alias("cmnd_1"),
            F.get(ids, F.lit(1)).alias("cmnd_2"),
            blank(F.regexp_extract(t, r"(?iu)(?:địa chỉ|thường trú)\s*(?:tại)?\s*:?\s*([^;.]+)", 1)).alias("dia_chi"),
            blank(F.regexp_extract(t, r"(\d{6}\.[A-Z]{2}\.\d{3})", 1)).alias("so_ho_so"),
            v.v_date(t)["value"].alias("ngay"),
        )

    return F.when(last.isNotNull(), let(last, read))


def collect_authorities(lines: Column) -> Column:
    """The verified authorities of one, two or three lines together, distinct, in order."""
    joined = lambda n: F.transform(lines, lambda _, i: F.array_join(F.slice(lines, i + 1, F.lit(n)), " "))
    found = F.flatten(F.array(*[F.transform(joined(n), v.n_authority) for n in (1, 2, 3)]))
    return F.array_distinct(F.array_compact(found))


def extract_registry_number(lines: Column) -> Column:
    """A registry number: after its label, on the line below the label, or any code with a prefix; validated."""
    label = r"(?:số\s*)?v[àa]o\s*s[ổốôo](?:\s*cấp)?(?:\s*(?:gcn|giấy chứng nhận))?"
    beside = _after(lines, label)
    below = _first(F.transform(lines, lambda x, i: F.when((i > 0) & F.coalesce(F.get(lines, i - 1).rlike(rf"(?iu){label}\s*:?\s*$"), F.lit(False)), F.trim(x)).otherwise("")))
    code = _first(F.transform(lines, lambda x: F.regexp_extract(x, r"\b((?:CH|CS|CN|VP)\s?\d{3,8}(?:/[A-Z]+)?)\b", 1)))
    valid = lambda c: F.when(v.v_registry(c)["ok"], v.v_registry(c)["value"])
    return F.coalesce(valid(beside), valid(below), valid(code))


def parse_certification(lines: Column) -> Column:
    """serial, barcode, registry number, authority, signer, role and date of a certification page."""
    serial = _first(F.transform(lines, lambda x: F.when(~v.is_identity_line(x) & x.rlike(r"(?u)^\s*(?:số\s*(?:phát hành|seri)?\s*:?\s*)?[\p{L}]{1,2}[01]?[\s.\-]*\d{6,8}\s*$") & v.v_serial(x)["ok"], v.v_serial(x)["value"])))
    barcode = _first(F.transform(lines, lambda x: F.when(digits_only(x).rlike(r"^\d{13,15}$") & x.rlike(r"^[\d\s]+$"), digits_only(x))))
    dates = _first(F.transform(lines, lambda x: F.when(v.v_date(x)["ok"], v.v_date(x)["value"])))
    roles = F.transform(lines, lambda x: v.v_signer_role(x))
    role_at = F.array_max(F.transform(roles, lambda r, i: F.when(r["ok"], i)))
    below = F.filter(lines, lambda x, i: i >= F.coalesce(role_at, F.lit(0)))
    return F.struct(
        serial.alias("so_phat_hanh"),
        barcode.alias("ma_vach"),
        extract_registry_number(lines).alias("so_vao_so"),
        F.get(collect_authorities(lines), F.lit(0)).alias("noi_cap"),
        _first(F.transform(below, v.n_signer)).alias("nguoi_ky_qd"),
        F.get(roles, role_at)["value"].alias("chuc_vu_nguoi_ky"),
        dates.alias("ngay_cap"),
    )



#: Labels of a parcel's fields, accent-free, which end the field before them.
PARCEL_FIELDS = {
    "so_thua": ("thua dat so", "thua so"), "to_ban_do": ("to ban do so", "to so"), "ty_le": ("ty le",), "dia_chi": ("dia chi thua dat", "dia chi"), "dien_tich_cap": ("dien tich cap", "dien tich"), "dien_tich_bang_chu": ("bang chu",),
    "hinh_thuc_su_dung": ("hinh thuc su dung",), "muc_dich_su_dung": ("muc dich su dung", "loai dat"), "thoi_han": ("thoi han su dung", "thoi han"), "nguon_goc": ("nguon goc su dung", "nguon goc"),
}


def labelled(lines: Column, label: Sequence[str], others: Sequence[str]) -> Column:
    """What follows a label in its line, up to the next label, or the line below where nothing does; null without either."""
    ends = tuple(x for x in others if x not in label)
    beside = F.transform(lines, lambda x: F.when(holds(x, label), F.trim(F.regexp_replace(before_label(after_label(x, label, anywhere=True), ends), r"[\s,;:.\-]+$", ""))))

    def found(values: Column) -> Column:
        below = F.transform(lines, lambda x, i: F.when((i > 0) & (F.get(values, i - 1) == "") & ~holds(x, (*label, *ends)), F.trim(x)))
        return F.coalesce(_first(values), _first(below))

    return let(beside, found)


def parse_parcel(lines: Column) -> Column:
    """so_thua, to_ban_do, ty_le, dia_chi, dien_tich_cap, dien_tich_bang_chu, hinh_thuc_su_dung, muc_dich_su_dung, ma_muc_dich, thoi_han and nguon_goc of a single parcel's page; values that validators refuse are null."""
    every = tuple(x for labels in PARCEL_FIELDS.values() for x in labels)
    raw = F.struct(*[labelled(lines, labels, every).alias(c) for c, labels in PARCEL_FIELDS.items()])
    ok = lambda check: F.when(check["ok"], check["value"])

    def judged(r: Column) -> Column:
        checks = F.struct(v.v_parcel(r["so_thua"]).alias("parcel"), v.v_map_sheet(r["to_ban_do"]).alias("sheet"), v.v_scale(r["ty_le"]).alias("scale"), v.v_area(F.regexp_extract(r["dien_tich_cap"], r"([\d.,]+)", 1)).alias("area"), v.v_purpose(r["muc_dich_su_dung"]).alias("use"), v.v_term(r["thoi_han"]).alias("term"), v.v_origin(r["nguon_goc"]).alias("origin"))
        return let(checks, lambda c: F.struct(
            ok(c["parcel"]).alias("so_thua"), ok(c["sheet"]).alias("to_ban_do"), ok(c["scale"]).alias("ty_le"), v.clean_address(r["dia_chi"]).alias("dia_chi"), ok(c["area"]).alias("dien_tich_cap"), r["dien_tich_bang_chu"].alias("dien_tich_bang_chu"), r["hinh_thuc_su_dung"].alias("hinh_thuc_su_dung"),
            F.coalesce(ok(c["use"]), r["muc_dich_su_dung"]).alias("muc_dich_su_dung"), F.when(c["use"]["ok"], c["use"]["code"]).alias("ma_muc_dich"), ok(c["term"]).alias("thoi_han"), ok(c["origin"]).alias("nguon_goc"),
        ))

    return let(raw, judged)


def title_name(name: Column) -> Column:
    """A name with its title in one spelling (``Ông: ``, ``Bà: ``, ``Hộ ông: ``, ``Hộ bà: ``) and its words capitalised; a name without a title has none."""
    titles = ("ông", "bà", "ong", "ba", "hộ gia đình ông", "hộ gia đình bà", "hộ ông", "hộ bà", "và ông", "và bà", "vợ là bà", "chồng là ông")

    def read(t: Column) -> Column:
        bare = after_label(t, titles, folded=False)
        lead = fold_accents(F.substring(t, F.lit(1), F.length(t) - F.length(bare)))
        who = F.when(lead.contains("ong"), "ông: ").otherwise("bà: ")
        title = F.when(F.trim(lead) == "", "").when(lead.rlike(r"^ho\b"), F.concat(F.lit("Hộ "), who)).otherwise(F.initcap(who))
        return F.concat(title, F.initcap(bare))

    return let(clean_text(name), read)
