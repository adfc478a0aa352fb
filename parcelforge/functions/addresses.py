"""Postal addresses as they stand on certificates: what is none, cleaning, and the parts of one.

All are Column expressions over one text. A gazetteer, where there is one, is
joined afterwards (``operators.gazetteer``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelforge.functions.labels import after_label, any_of, before_label, holds
from parcelforge.functions.lines import truncate_after_province
from parcelforge.functions.text import clean_text, contains_any, fold_accents, let, strip_serial_tail

# ---------------------------------------------------------------- fixed values
#: Words of authorities and signers, accent-free, as words of their own.
AUTHORITY_WORDS = ("t m", "tm", "t.m", "uy ban nhan dan", "ubnd", "chu tich", "xac nhan cua", "xac nhan boi", "co quan cap", "nguoi ky", "chi nhanh quan", "chi nhang quan", "van phong dang ky", "chi nhanh van phong", "chi nhang van phong")
#: Words that stand in tables, headings and signatures and not in addresses.
FOREIGN_WORDS = (
    "mục đích", "muc dich", "muc đích", "mục dich", "diện tích", "dien tich", "thời hạn", "thoi han", "riêng chung", "rieng chung", "riêng", "rieng", "chung", "thửa đất số", "thua dat so", "tờ bản đồ", "to ban do",
    "quyền sử dụng", "quyen su dung", "hình thức", "hinh thuc", "nguồn gốc", "nguon goc", "thông tin về đất", "thong tin ve dat", "thông tin về đát", "tài sản gắn liền với đất", "tai san gan lien voi dat", "thửa đất, nhà ở",
    "thua dat, nha o", "chi nhánh, quận", "chi nhán, quận", "chi nhánh", "chi nhán", "văn phòng đăng ký", "van phong dang ky", "vpđkđđ", "(m²)", "(m2)", "m²", "m2", "uỷ ban", "uy ban", "ubnd", "chủ tịch", "chu tich", "ký tên", "ky ten",
)
#: Words in the place of a contaminated address that leave nothing to save.
FOREIGN_IN_PLACE = ("diện tích", "thời hạn", "mục đích", "tổng số", "sử dụng", "riêng", "chung")
HEADINGS = ("thông tin về đất", "thông tin về đát", "tài sản gắn liền với đất", "thông tin về nhà ở", "thửa đất, nhà ở")
TABLE_WORDS = ("mục đích sử dụng", "thời hạn sử dụng", "nguồn gốc sử dụng", "diện tích", "tờ bản đồ")
RESIDENCE_LABELS = ("dia chi thuong tru", "ho khau thuong tru", "noi thuong tru", "thuong tru", "dia chi", "ho khau")
#: What follows an address on its line: another person, a birth, a paper.
PERSON_MARKS = ("va ba", "va ong", "vo la", "chong la", "sinh nam", "nam sinh", "cmnd", "cccd")
#: The smallest units, with which an address begins, and what must be in it.
FIRST_UNITS = ("thon", "xom", "ban", "to", "dong", "khu", "doi", "doan", "pho", "duong", "xa", "phuong", "thi tran")
UNIT_WORDS = (*FIRST_UNITS, "lang", "huyen", "quan", "thi xa", "tinh", "thanh pho", "tp")
PROVINCE_UNITS, DISTRICT_UNITS, WARD_UNITS = ("tinh", "thanh pho", "tp"), ("huyen", "quan", "thi xa", "tp", "thanh pho"), ("xa", "phuong", "thi tran")
HAMLET_UNITS = ("thon", "xom", "ban", "to dan pho", "tdp", "khu pho", "khu", "dong")
#: Units that may have lost their accents, with the spelling that they get.
UNIT_SPELLINGS = (("xa", "xã"), ("huyen", "huyện"), ("tinh", "tỉnh"))
#: Cities of their own, after whose name an address ends, and the districts of one of them.
CITIES = ("Hải Phòng", "Hà Nội", "Đà Nẵng", "Hồ Chí Minh", "Cần Thơ")
CITY_DISTRICTS = ("Lê Chân", "Hồng Bàng", "Ngô Quyền", "Hải An", "Kiến An", "Đồ Sơn", "Dương Kinh")
#: Places as they are read, accent-free, and as they are written.
PLACE_SPELLINGS = (
    ("le chan", "Lê Chân"), ("le chau", "Lê Chân"), ("le chai", "Lê Chân"), ("ton duc thang", "Tôn Đức Thắng"), ("tran nguyen han", "Trần Nguyên Hãn"), ("vinh yen", "Vĩnh Yên"), ("vinh yeu", "Vĩnh Yên"), ("binh gia", "Bình Gia"),
    ("binh giu", "Bình Gia"), ("binh chu", "Bình Gia"), ("lang son", "Lạng Sơn"), ("lang sm", "Lạng Sơn"), ("luoc son", "Lạng Sơn"), ("ling son", "Lạng Sơn"), ("khuoi dui", "Khuổi Dụi"), ("khuoi luong", "Khuổi Luông"),
    ("khuoi man", "Khuổi Màn"), ("vang un", "Vằng Ứn"), ("vung un", "Vằng Ứn"), ("hai phong", "Hải Phòng"),
)
# ---------------------------------------------------------------- end of fixed values

PARTS = ("so_nha", "ten_duong_pho", "ten_tdp", "ten_xa", "ten_huyen", "ten_tinh", "dia_chi_chi_tiet")


def is_authority_text(text: Column) -> Column:
    """Whether a text is an authority's or a signer's rather than an address; a null text is not."""
    return F.coalesce(holds(F.regexp_replace(text, r"[,:.]+", " "), AUTHORITY_WORDS), F.lit(False))


def is_contaminated_address(text: Column) -> Column:
    """Whether a text has words that no address has, or none at all."""
    return F.coalesce(text, F.lit("")).eqNullSafe(F.lit("")) | is_authority_text(text) | F.coalesce(contains_any(F.lower(text), FOREIGN_WORDS), F.lit(False))


def looks_like_table_noise(text: Column) -> Column:
    """More than 120 characters, a table's heading, or three numbers."""
    numbers = F.size(F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), 0))
    return F.coalesce((F.length(text) > 120) | contains_any(F.lower(text), TABLE_WORDS) | (numbers >= 3), F.lit(False))


def _from_first_unit(text: Column, units: tuple[str, ...]) -> Column:
    """The text from its first unit, or number of a house, on; without one the text."""
    start = rf"(?:{any_of(units)}|(?<![a-z])so\s*\d)"

    def cut(t: Column) -> Column:
        before = F.regexp_extract(fold_accents(t), rf"(?s)^(.*?){start}", 1)
        return F.when(fold_accents(t).rlike(start), F.substring(t, F.length(before) + 1, F.length(t))).otherwise(t)

    return let(text, cut)


def _place_of(text: Column) -> Column:
    """What can be saved of a contaminated address: from its first village, commune or district to the next semicolon, if no foreign word is in that."""
    units = ("thon", "ban", "khu", "dong", "xa", "huyen")
    own = F.regexp_extract(_from_first_unit(text, units), r"^([^;\n\r]*)", 1)
    return let(own, lambda o: F.when(holds(o, units) & ~contains_any(F.lower(o), FOREIGN_IN_PLACE), F.regexp_replace(o, r"[\s\-:;,]+$", "")).otherwise(""))


def respell(text: Column, spellings: tuple[tuple[str, str], ...] = PLACE_SPELLINGS) -> Column:
    """Known places in their own spelling, wherever they stand as words in any case and with any accents."""
    for plain, written in spellings:
        loose = r"\s*".join("".join(_MARKED[c] if c in _MARKED else c for c in w) for w in plain.split())
        text = F.regexp_replace(text, rf"(?iu)(?<!\p{{L}}){loose}(?!\p{{L}})", written)
    return text


def _marked() -> dict[str, str]:
    from parcelforge.functions.text import ACCENTED, UNACCENTED

    letters: dict[str, str] = {}
    for c, base in zip(ACCENTED, UNACCENTED, strict=True):
        letters[base] = letters.get(base, base) + c
    return {base: f"[{cs}]" for base, cs in letters.items()}


_MARKED = _marked()


def clean_mapped_address(text: Column) -> Column:
    """An address as the registration sheet has it: without label, people and serial, from its smallest unit to its province, units apart by commas; '' if it is none."""
    given = clean_text(F.coalesce(text.cast("string"), F.lit("")))

    def tidy(t: Column) -> Column:
        own = F.when(is_authority_text(t), "").when(is_contaminated_address(t), _place_of(t)).otherwise(t)
        own = after_label(own, RESIDENCE_LABELS, anywhere=True)
        own = after_label(own, ("va ba", "va ong", "vo la", "chong la", "ba", "ong"))
        return strip_serial_tail(F.regexp_replace(before_label(own, PERSON_MARKS), r"^[\s\-:;,.]+|[\s\-:;,.]+$", ""))

    def placed(t: Column) -> Column:
        t = _from_first_unit(t, FIRST_UNITS)
        t = F.regexp_replace(F.regexp_replace(t, r"[\s\-_–—?]+,", ","), r",[\s\-_–—?]*,", ",")
        t = respell(F.regexp_replace(t, r"[,;\s]+\d{1,4}\s*$", ""))
        for plain, written in UNIT_SPELLINGS:
            t = F.regexp_replace(t, rf"(?iu)[\s.;,]*(?<!\p{{L}}){plain}(?!\p{{L}})\s*", f", {written} ")
        t = F.regexp_replace(t, r"(?iu)(?<=[^\s,;])\s+(?=(?:xã|phường|thị\s*trấn|huyện|quận|thị\s*xã|tỉnh|thành\s*phố)(?!\p{L}))", ", ")
        return clean_text(F.regexp_replace(F.regexp_replace(t, r"\s*,\s*", ", "), r"^[\s,]+", ""))

    def ended(t: Column) -> Column:
        names = "|".join(CITIES)

        def city(short: Column) -> Column:
            found = F.regexp_extract(short, rf"(?iu)^(.*(?:thành\s*phố|tp\.?)\s+(?:{names}))(?!\p{{L}})", 1)
            return F.when(found != "", found).otherwise(short)

        def kept(out: Column) -> Column:
            low = F.lower(out)
            office = contains_any(low, ("chi nhánh", "chi nhán", "văn phòng đăng ký"))
            return F.when(office | contains_any(low, HEADINGS) | ~holds(out, UNIT_WORDS), "").otherwise(out)

        return let(let(F.regexp_replace(truncate_after_province(t), r"^[\s\-:;,.]+|[\s\-:;,.]+$", ""), city), kept)

    return let(let(let(given, tidy), placed), ended)


def decompose_address(text: Column, cleaned: bool = False) -> Column:
    """The parts of an address, blank where it has none: house, street, hamlet, ward, district, province, and the cleaned whole.

    Parts are read from the right, each of them by its unit's word. A district
    of the city whose districts are listed gives that city as the province.
    """
    whole = text if cleaned else clean_mapped_address(text)

    def split(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, r"[,;]"), lambda p: F.trim(p)), lambda p: p != "")
        last_real = F.array_max(F.transform(parts, lambda p, i: F.when(~p.rlike(r"^\d+$"), i)))
        return F.struct(t.alias("whole"), F.when(last_real.isNotNull(), F.slice(parts, F.lit(1), last_real + 1)).otherwise(F.array().cast("array<string>")).alias("parts"))

    def level(name: str, units: tuple[str, ...]):
        """Takes the last part if it has the unit."""

        def take(s: Column) -> Column:
            last = F.try_element_at(s["parts"], F.lit(-1))
            mine = F.coalesce(holds(last, units), F.lit(False))
            fields = [s[c].alias(c) for c in ("whole", *taken)]
            return F.struct(*fields, F.when(mine, F.trim(after_label(last, units, anywhere=True))).otherwise("").alias(name), F.when(mine, F.slice(s["parts"], F.lit(1), F.size(s["parts"]) - 1)).otherwise(s["parts"]).alias("parts"))

        return take

    out, taken = let(whole, split), []
    for name, units in (("ten_tinh", PROVINCE_UNITS), ("ten_huyen", DISTRICT_UNITS), ("ten_xa", WARD_UNITS)):
        out = let(out, level(name, units))
        taken.append(name)

    def rest(s: Column) -> Column:
        at = F.array_min(F.transform(s["parts"], lambda p, i: F.when(holds(p, HAMLET_UNITS), i)))
        hamlet = F.coalesce(F.get(s["parts"], at), F.lit(""))
        others = F.array_join(F.filter(s["parts"], lambda _, i: ~i.eqNullSafe(at)), ", ")
        bare = after_label(others, ("so",))
        number = F.regexp_extract(bare, r"^([0-9A-Za-z/\-]*\d[0-9A-Za-z/\-]*)", 1)
        street = F.trim(after_label(F.trim(F.substring(bare, F.length(number) + 1, F.length(bare))), ("duong", "pho")))
        numbered = number != ""
        city = F.exists(F.array(*[F.lit(d.lower()) for d in CITY_DISTRICTS]), lambda d: F.contains(F.lower(s["ten_huyen"]), d))
        return F.struct(
            F.when(numbered, number).otherwise("").alias("so_nha"),
            F.when(numbered, F.regexp_replace(street, r"^[\s,]+|[\s,]+$", "")).otherwise(others).alias("ten_duong_pho"),
            hamlet.alias("ten_tdp"),
            s["ten_xa"].alias("ten_xa"),
            s["ten_huyen"].alias("ten_huyen"),
            F.when(city, CITIES[0]).otherwise(s["ten_tinh"]).alias("ten_tinh"),
            s["whole"].alias("dia_chi_chi_tiet"),
        )

    return let(out, rest)


def with_upper_units(address: Column, district: Column, province: Column) -> Column:
    """An address with the district and the province of another one where it names none itself."""
    return let(F.struct(F.coalesce(address, F.lit("")).alias("own"), F.coalesce(district, F.lit("")).alias("district"), F.coalesce(province, F.lit("")).alias("province")), lambda s: _with_upper(s["own"], s["district"], s["province"]))


def _with_upper(own: Column, district: Column, province: Column) -> Column:
    here = lambda name: (name != "") & F.contains(F.lower(own), F.lower(name))
    city_district = F.exists(F.array(*[F.lit(d.lower()) for d in CITY_DISTRICTS]), lambda d: F.contains(F.lower(F.concat_ws(" ", district, own)), d))
    named = F.when(city_district, F.lit(CITIES[0])).otherwise(province)
    big = F.exists(F.array(*[F.lit(c.lower()) for c in CITIES]), lambda c: F.contains(F.lower(named), c))
    more_d = F.when((district != "") & ~holds(own, ("huyen", "quan", "thi xa")) & ~here(district), F.concat(F.when(city_district, "quận ").otherwise("huyện "), district))
    more_p = F.when((named != "") & ~holds(own, PROVINCE_UNITS) & ~here(named), F.concat(F.when(big, "thành phố ").otherwise("tỉnh "), named))
    return F.when(own == "", own).otherwise(F.concat_ws(", ", own, more_d, more_p))
