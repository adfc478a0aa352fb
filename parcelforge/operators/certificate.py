"""One certificate from its pages, field by field.

``pages`` has one row per page: doc_id, page_index from 0, template, lines (the
page's texts in reading order), fields and confidence (maps by field), parcels
(an array of the table's rows, or empty) and heirs. A document is some pages, so
they are gathered in an array; a field is then the first acceptable value in an
order of places in that array, which the field's rule gives.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions import validators as v
from parcelforge.functions.labels import after_label, holds
from parcelforge.functions.lines import extract_registry_number, parse_certification
from parcelforge.functions.parsers import birth_years, identity_numbers
from parcelforge.functions.text import contains_any, digits_only, fold_accents, nullify_placeholder
from parcelforge.operators.merge import birth_from_identity, fallback_changes, split_couple
from parcelforge.operators.spatial import BARCODE_VETO, PAGE, split_serials

# ---------------------------------------------------------------- fixed values
SERIAL_ANCHORS = ("so phat hanh gcn", "so phat hanh", "phat hanh gcn", "phat hanh", "so phoi gcn", "so phoi", "so seri", "so se ri", "serial")
#: Scores of a serial behind its label, alone in the lower part of a page, alone elsewhere, in two boxes low and elsewhere; the share of the height from which on is low, and the height where none is known.
LABELLED, LOW_ALONE, ALONE, LOW_PAIR, PAIR, LOW_SHARE, PAGE_HEIGHT = 100, 85, 50, 80, 75, 0.60, 1000.0
FRONT_PRIORITY, BACK_PRIORITY = 90, 70
ADDENDUM, SUPPLEMENT_WARNING, CHANGES_TITLE = ("bổ sung", "bo sung"), "không được sửa chữa", "những thay đổi sau khi cấp"
OWNER_PAGE, PARCEL_PAGE = ("cộng hòa xã hội", "cong hoa xa hoi", "người sử dụng đất"), ("thửa đất", "thua dat")
LAST_PAGE, FIRST_PAGE = ("những thay đổi", "không được sửa chữa", "khong duoc sua chua"), ("người sử dụng đất", "nguoi su dung dat", "chủ sở hữu")
ADDRESS_IN_NUMBER = ("thôn", "thon", "xã", "xa", "huyện", "huyen", "tỉnh", "tinh", "phường", "phuong", "quận", "quan", "địa chỉ", "dia chi", "thường trú", "thuong tru", "quê", "que")
CHANGE_ACTS = ("chuyển nhượng", "chuyen nhuong", "tặng cho", "thừa kế", "thế chấp", "cho ông", "cho bà")
CHANGE_HEADINGS = ("xác nhận của cơ", "xac nhan cua co", "có thẩm quyền", "co tham quyen", "nội dung thay đổi", "noi dung thay doi", "những thay đổi sau khi cấp", "người được cấp giấy")
PARCEL_ADDRESS_NOISE = ("diện tích", "thời hạn", "mục đích", "m²", "m2", "uỷ ban", "uy ban", "ubnd", "chủ tịch")
SIGNER_NOISE = ("tài nguyên", "môi trường", "ủy ban", "uỷ ban", "ubnd", "huyện", "quận", "phường", "xã", "tỉnh", "thành phố", "chủ tịch", "giám đốc", "phó chủ", "phó giám", "ký thay", "không được", "giấy chứng nhận", "plastic")
URBAN, RURAL = ("đô thị", "do thi", "quận", "phường"), ("nông thôn", "nong thon", "huyện", "xã")
HOUSEHOLD, ORGANISATION = ("hộ ông", "hộ bà", "hồ ông", "hồ bà", "hộ gia đình", "hồ gia đình", "hộ:", "hồ:"), ("công ty", "doanh nghiệp", "tổng công ty", "ubnd")
#: What an owner is, and how several hold together.
KINDS = {"heirs": "Đồng thừa kế", "couple": "Vợ chồng / Đồng sở hữu", "household": "Hộ gia đình", "organisation": "Tổ chức", "person": "Cá nhân"}
JOINT = {"heirs": "Có (Đồng thừa kế)", "couple": "Có (Vợ chồng)", "none": "Không"}
PRIVATE_USE = "Sử dụng riêng"
#: Fields of the latest transfer, each with the names under which pages give it.
TRANSFER_FIELDS = (
    ("ten_chuyen_nhuong_moi", "ten_nguoi_nhan_chuyen_nhuong"), ("cmnd_chuyen_nhuong", "cmnd_nguoi_nhan_chuyen_nhuong"), ("ten_chuyen_nhuong_2",), ("cmnd_chuyen_nhuong_2",), ("dia_chi_chuyen_nhuong",), ("so_ho_so_bien_dong",),
    ("bien_dong_ngay", "ngay_chuyen_nhuong"), ("nguoi_ky_xac_nhan",), ("chuc_vu_xac_nhan",), ("co_quan_xac_nhan",),
)
#: Parcel-page score: points for a stated total, for each heading and for an area, and against a table of changes.
PARCEL_SCORE = {"total": 8, "heading": 2, "area": 1, "changes": -10}
PARCEL_HEADINGS = ("dien tich", "muc dich", "thoi han", "nguon goc")
CHANGED_PARCELS = ("thua dat co thay doi", "thong tin thua dat moi")
# ---------------------------------------------------------------- end of fixed values

PARCEL = "array<struct<so_thua:string,to_ban_do:string,dia_chi:string,dien_tich:double,muc_dich_su_dung:string,ma_muc_dich:string,thoi_han:string,nguon_goc:string,nguon_goc_ky_hieu:string>>"
HEIRS = "array<struct<ho_ten:string,cmnd:string,ngay_sinh:string,gioi_tinh:string>>"


def serial_candidates(tokens: DataFrame, height: float = PAGE_HEIGHT) -> DataFrame:
    """doc_id, page_index, serial, raw, score, confidence and strategy of each place on a page that shows a serial: behind its label, alone, or in two boxes side by side. Lines with an identity paper's word show none."""
    own = tokens.where(~v.is_identity_line(F.col("text")) & (F.trim("text") != ""))
    c, conf = F.trim("text"), F.coalesce("confidence", F.lit(0.9))
    labelled = F.when(holds(c, SERIAL_ANCHORS), v.v_serial(after_label(c, SERIAL_ANCHORS, anywhere=True)))
    read = own.select(*PAGE, c.alias("raw"), conf.alias("c"), ((F.col("y1") + F.col("y2")) / 2 >= LOW_SHARE * height).alias("low"), labelled.alias("labelled"), v.v_serial(c).alias("alone"))
    by_label = F.coalesce(F.col("labelled.ok"), F.lit(False))
    single = read.where(by_label | F.col("alone.ok")).select(
        *PAGE, F.when(by_label, F.col("labelled.value")).otherwise(F.col("alone.value")).alias("serial"), "raw",
        F.when(by_label, LABELLED).when(F.col("low"), LOW_ALONE).otherwise(ALONE).alias("score"),
        F.when(by_label, F.greatest(F.lit(0.95), "c")).otherwise(F.col("c")).alias("confidence"),
        F.when(by_label, "anchor").when(F.col("low"), "cover_bottom").otherwise("standalone").alias("strategy"),
    )
    pairs = split_serials(tokens)
    place = lambda name: tokens.select(*PAGE, F.col("ord").alias(name), F.col("confidence").alias(f"{name}_c"), ((F.col("y1") + F.col("y2")) / 2).alias(f"{name}_y"))
    both = pairs.join(place("a_ord"), [*PAGE, "a_ord"]).join(place("ord"), [*PAGE, "ord"]).withColumn("s", v.v_serial(F.col("candidate"))).where("s.ok")
    two = both.select(*PAGE, F.col("s.value").alias("serial"), F.col("candidate").alias("raw"), F.when(F.col("a_ord_y") >= LOW_SHARE * height, LOW_PAIR).otherwise(PAIR).alias("score"), F.least(F.coalesce("a_ord_c", F.lit(0.9)), F.coalesce("ord_c", F.lit(0.9))).alias("confidence"), F.lit("split_box").alias("strategy"))
    return single.unionByName(two)


def best_serials(candidates: DataFrame) -> DataFrame:
    """The best candidate of each page by score, then confidence, then text."""
    best = F.max_by(F.struct("serial", "raw", "score", "confidence", "strategy"), F.struct("score", "confidence", "serial"))
    return candidates.groupBy(*PAGE).agg(best.alias("best")).select(*PAGE, "best")


def score_parcel_page(text: Column, has_list: Column, has_area: Column) -> Column:
    """How much a page is the one with the table of parcels; -100 without rows."""
    folded = fold_accents(text)
    points = F.when(holds(text, ("tong so thua",)), PARCEL_SCORE["total"]).otherwise(0) + F.when(has_area, PARCEL_SCORE["area"]).otherwise(0)
    for h in PARCEL_HEADINGS:
        points = points + F.when(folded.contains(h), PARCEL_SCORE["heading"]).otherwise(0)
    return F.when(has_list, points + F.when(contains_any(folded, CHANGED_PARCELS), PARCEL_SCORE["changes"]).otherwise(0)).otherwise(-100)


def select_land_code(code: Column, purpose: Column) -> Column:
    """One code of the purpose's wording, else one of the given codes, else all of the wording's, else all given; of a joined urban and rural code that which the wording's places tell. '' without any."""
    low = F.lower(F.coalesce(purpose, F.lit("")))

    def resolved(joined: Column) -> Column:
        codes = F.filter(F.split(F.coalesce(joined, F.lit("")), r"\+"), lambda x: x != "")
        both = F.array_contains(codes, "ODT") & F.array_contains(codes, "ONT")
        drop = F.when(both & contains_any(low, URBAN), "ONT").when(both & contains_any(low, RURAL), "ODT").otherwise("")
        return F.filter(codes, lambda x: x != drop)

    given = v.v_land_code(code)
    return v.let(
        F.struct(resolved(v.v_purpose(purpose)["code"]).alias("told"), resolved(F.when(given["ok"], given["value"])).alias("given")),
        lambda s: F.when(F.size(s["told"]) == 1, s["told"][0]).when(F.size(s["given"]) == 1, s["given"][0]).when(F.size(s["told"]) > 1, F.array_join(s["told"], "+")).otherwise(F.array_join(s["given"], "+")),
    )


def page_facts(pages: DataFrame, serials: DataFrame | None = None) -> DataFrame:
    """``pages`` with what the merge asks of each: its text, marks, certification, registry number, best serial and valid owner."""
    text = F.lower(F.array_join("lines", " "))
    out = pages.withColumn("text", text)
    low = F.col("text")
    warned, titled = low.contains(SUPPLEMENT_WARNING), low.contains(CHANGES_TITLE)
    last = contains_any(low, LAST_PAGE)
    out = out.withColumns({
        "is_addendum": contains_any(low, ADDENDUM),
        "is_owner": contains_any(low, OWNER_PAGE) & ~warned & ~titled,
        "is_parcel": contains_any(low, PARCEL_PAGE) & ~warned,
        "is_warned": warned,
        "is_last": last,
        "is_first": contains_any(low, FIRST_PAGE) & ~last,
        "owner_ok": v.v_person(F.col("fields")["ho_ten_chu_1"])["ok"],
        "score": score_parcel_page(F.array_join("lines", " "), F.size("parcels") > 0, F.coalesce(F.col("fields")["dien_tich_cap"], F.lit("")) != ""),
        "certified": parse_certification(F.col("lines")),
        "registry": extract_registry_number(F.col("lines")),
        "stated_total": F.regexp_extract(fold_accents(low), r"tong\s*so\s*thua\D{0,20}(\d{1,3})", 1).try_cast("int"),
        "long_number": F.get(F.filter(F.col("lines"), lambda x: ~contains_any(F.lower(x), BARCODE_VETO) & F.length(digits_only(x)).between(13, 15)), F.lit(0)),
    })
    if serials is not None:
        return out.join(serials, list(PAGE), "left")
    return out.withColumn("best", F.lit(None).cast("struct<serial:string,raw:string,score:int,confidence:double,strategy:string>"))


class _Pages:
    """Expressions over the array ``pages`` of a document; places are numbers from 0."""

    def __init__(self, pages: Column):
        self.pages = pages

    def all(self) -> Column:
        return F.transform(self.pages, lambda _, i: i)

    def where(self, test) -> Column:
        return F.filter(self.all(), lambda i: F.coalesce(test(F.get(self.pages, i)), F.lit(False)))

    def first(self, order: Column, value, good=lambda x: x.isNotNull()) -> Column:
        """(value, at) of the first place in ``order`` with a good value; null without one."""
        rows = F.transform(order, lambda i: F.struct(value(F.get(self.pages, i)).alias("value"), i.alias("at")))
        return F.get(F.filter(rows, lambda r: F.coalesce(good(r["value"]), F.lit(False))), F.lit(0))

    def field(self, order: Column, *names: str) -> Column:
        """(value, page from 1, confidence) of the first value of any of the names, blanks and 0 aside; after ``order`` all pages are read, 0 included."""

        def read(p: Column) -> Column:
            found = F.array_compact(F.array(*[F.when(nullify_placeholder(p["fields"][n]).isNotNull(), F.struct(nullify_placeholder(p["fields"][n]).alias("value"), p["confidence"][n].cast("double").alias("confidence"))) for n in names]))
            return v.let(F.get(found, F.lit(0)), lambda f: F.when(f.isNotNull(), F.struct(f["value"].alias("value"), (p["page_index"] + 1).cast("int").alias("page"), f["confidence"].alias("confidence"))))

        def chosen(rows: Column) -> Column:
            own = F.get(F.filter(F.transform(order, lambda i: F.get(rows, i)), lambda r: F.coalesce(r["value"] != "0", F.lit(False))), F.lit(0))
            other = F.get(F.filter(rows, lambda r: r.isNotNull()), F.lit(0))
            sure = lambda r, least: r.withField("confidence", F.coalesce(r["confidence"], F.lit(least)))
            return v.let(own, lambda o: F.when(o.isNotNull(), sure(o, 0.90)).otherwise(sure(other, 0.85)))

        return v.let(F.transform(self.pages, read), chosen)


def _places(*at: Column) -> Column:
    return F.array_compact(F.array(*at))


def page_orders(facts: DataFrame) -> DataFrame:
    """One row per document: its pages as an array, the template, the owner's and the parcels' page, and the order of pages by kind of field."""
    keep = ["page_index", "template", "fields", "confidence", "parcels", "heirs", "is_addendum", "is_owner", "is_parcel", "is_warned", "is_last", "is_first", "owner_ok", "score", "certified", "registry", "stated_total", "long_number", "best", "text"]
    docs = facts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*keep)), lambda a, b: (a["page_index"] - b["page_index"]).cast("int")).alias("pages"))  # maps have no order
    p = _Pages(F.col("pages"))
    known = F.filter(F.transform("pages", lambda x: x["template"]), lambda t: t != "unknown")
    template = F.when(F.array_contains(known, "mau_B"), "mau_B").otherwise(F.coalesce(F.get(known, F.lit(0)), F.lit("mau_A")))
    at = lambda places: F.get(places, F.lit(0))
    owner = F.coalesce(at(p.where(lambda x: x["is_owner"] & ~x["is_addendum"])), at(p.where(lambda x: ~x["is_warned"] & (x["text"].contains("giấy chứng nhận") | (nullify_placeholder(x["fields"]["ho_ten_chu_1"]).isNotNull())))), F.lit(0))
    docs = docs.withColumns({"template": template, "n": F.size("pages"), "owner_at": owner})
    listed = F.array_max(F.transform(p.where(lambda x: x["score"] > -100), lambda i: F.struct(F.get("pages", i)["score"].alias("score"), F.size(F.get("pages", i)["parcels"]).alias("rows"), (-i).alias("back"))))
    parcel = F.coalesce(-listed["back"], at(p.where(lambda x: x["is_parcel"] & ~x["is_addendum"] & ~x["is_owner"])), F.when(F.col("n") > 1, F.lit(1)), F.col("owner_at"))
    docs = docs.withColumn("parcel_at", parcel)
    mt, ms, every = F.col("owner_at"), F.col("parcel_at"), p.all()
    body = F.filter(every, lambda i: F.get("pages", i)["page_index"] != 3)
    changed = p.where(lambda x: nullify_placeholder(x["fields"]["ten_chuyen_nhuong_moi"]).isNotNull() | contains_any(F.lower(F.coalesce(x["fields"]["thong_tin_bien_dong"], F.lit(""))), CHANGE_ACTS) | (x["page_index"] == 3))
    last, inner = p.where(lambda x: x["is_last"]), p.where(lambda x: ~x["is_first"])
    certified = F.when(F.col("template") == "mau_2024", _places(mt, ms)).otherwise(_places(ms, mt))
    return docs.withColumns({
        "every": every,
        "owners": F.concat(_places(mt), F.filter(p.where(lambda x: x["owner_ok"]), lambda i: i != mt)),
        "parcels_first": F.concat(_places(ms, mt), every),
        "registries": F.when(F.col("n") >= 3, F.concat(_places(ms), F.filter(body, lambda i: i != mt))).otherwise(F.concat(_places(ms, mt), body)),
        "barcodes": F.when(F.size(last) > 0, last).when(F.size(inner) > 0, inner).otherwise(every),
        "certified_first": F.concat(certified, every),
        "certified": F.filter(certified, lambda i: ~F.get("pages", i)["is_last"]),
        "changes": F.when(F.size(changed) > 0, changed).otherwise(every),
    })


def _result(raw: Column, value: Column, ok: Column, page: Column, confidence: Column, reason: Column | None = None) -> Column:
    """value, raw, page, confidence (0.40 at most where it is not accepted), status and reason of a field."""
    given = F.struct(
        nullify_placeholder(raw.cast("string")).alias("raw"),
        nullify_placeholder(value.cast("string")).alias("value"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
        page.cast("int").alias("page"),
        F.coalesce(confidence, F.lit(0.0)).cast("double").alias("sure"),
        (reason if reason is not None else F.lit(None)).cast("string").alias("reason"),
    )
    return v.let(
        given,
        lambda g: F.struct(
            g["value"].alias("value"),
            g["raw"].alias("raw"),
            g["page"].alias("page"),
            F.round(F.when(g["ok"], g["sure"]).otherwise(F.least(g["sure"], F.lit(0.40))), 3).alias("confidence"),
            F.when(g["ok"], "valid").when(g["raw"].isNotNull(), "review_required").otherwise("missing").alias("status"),
            F.when(~g["ok"], g["reason"]).alias("reason"),
        ),
    )


_NOT_APPLICABLE = "named_struct('value', cast(null as string), 'raw', cast(null as string), 'page', cast(null as int), 'confidence', 0.0D, 'status', 'not_applicable', 'reason', cast(null as string))"


def _checked(found: Column, check, keep_raw: bool = False) -> Column:
    """A field of one validator: its normal form; a refused reading is left out, or kept for the reviewer."""
    return v.let(F.struct(found.alias("f"), check(found["value"]).alias("c")), lambda s: _result(s["f"]["value"], F.when(s["c"]["ok"], s["c"]["value"]).when(F.lit(keep_raw), s["f"]["value"]), s["c"]["ok"], s["f"]["page"], s["f"]["confidence"], s["c"]["reason"]))


def _plain(found: Column, value: Column | None = None, confidence: float | None = None) -> Column:
    """A field without a validator: what there is, is accepted."""
    own = F.struct(found.alias("f"), *([value.alias("v")] if value is not None else []))
    chosen = lambda s: s["v"] if value is not None else s["f"]["value"]
    return v.let(own, lambda s: _result(s["f"]["value"], chosen(s), nullify_placeholder(chosen(s)).isNotNull(), s["f"]["page"], F.lit(confidence) if confidence is not None else s["f"]["confidence"]))


def identity_fields(docs: DataFrame) -> DataFrame:
    """so_phat_hanh, ma_vach and so_vao_so."""
    p = _Pages(F.col("pages"))
    read = F.transform("pages", lambda x: F.struct(x.alias("p"), v.v_serial(x["fields"]["so_phat_hanh"]).alias("s")))
    fields = F.transform(F.filter(read, lambda r: r["s"]["ok"]), lambda r: F.struct(F.when(r["p"]["page_index"] < 2, FRONT_PRIORITY).otherwise(BACK_PRIORITY).alias("priority"), F.coalesce(r["p"]["confidence"]["so_phat_hanh"], F.lit(0.90)).cast("double").alias("confidence"), (-r["p"]["page_index"]).cast("int").alias("back"), r["s"]["value"].alias("value"), r["p"]["fields"]["so_phat_hanh"].alias("raw")))
    boxes = F.transform(F.filter("pages", lambda x: x["best"].isNotNull()), lambda x: F.struct(x["best"]["score"].alias("priority"), x["best"]["confidence"].cast("double").alias("confidence"), (-x["page_index"]).cast("int").alias("back"), x["best"]["serial"].alias("value"), x["best"]["raw"].alias("raw")))
    out = docs.withColumns({"_serial": F.array_max(F.concat(fields, boxes)), "_kept": p.field(F.col("every"), "so_phat_hanh")})
    s, kept = F.col("_serial"), F.col("_kept")
    serial = F.when(s.isNotNull(), _result(s["raw"], s["value"], F.lit(True), 1 - s["back"], s["confidence"])).otherwise(_result(kept["value"], kept["value"], F.lit(False), kept["page"], kept["confidence"], F.lit("malformed")))
    code = p.first(F.col("barcodes"), lambda x: v.v_barcode(x["fields"]["ma_vach"]), lambda c: c["ok"])
    digits = p.first(F.col("barcodes"), lambda x: x["long_number"])
    out = out.withColumns({"so_phat_hanh": serial, "_code": code, "_digits": digits, "_registry": p.field(F.col("registries"), "so_vao_so"), "_reread": p.first(F.col("registries"), lambda x: x["registry"])})
    page = lambda at: F.get("pages", at)["page_index"] + 1
    barcode = F.when(F.col("_code").isNotNull(), _result(F.col("_code.value.value"), F.col("_code.value.value"), F.lit(True), page(F.col("_code.at")), F.lit(0.95)))
    barcode = barcode.when(F.col("_digits").isNotNull(), _result(F.col("_digits.value"), digits_only(F.col("_digits.value")), F.lit(True), page(F.col("_digits.at")), F.lit(0.90))).otherwise(_plain(p.field(F.col("barcodes"), "ma_vach"), F.lit("")))
    registry = v.let(F.struct(F.col("_registry").alias("f"), v.v_registry(F.col("_registry.value")).alias("c"), F.col("_reread").alias("again"), F.get("pages", F.col("_reread.at"))["page_index"].alias("at")), lambda r: F.when(r["c"]["ok"], _result(r["f"]["value"], r["c"]["value"], F.lit(True), r["f"]["page"], r["f"]["confidence"])).when(r["again"].isNotNull(), _result(F.coalesce(r["f"]["value"], r["again"]["value"]), r["again"]["value"], F.lit(True), r["at"] + 1, F.lit(0.90))).otherwise(_result(r["f"]["value"], F.lit(""), F.lit(False), r["f"]["page"], F.lit(0.0), r["c"]["reason"])))
    return out.withColumns({"ma_vach": barcode, "so_vao_so": registry}).drop("_serial", "_kept", "_code", "_digits", "_registry", "_reread")


def owner_fields(docs: DataFrame) -> DataFrame:
    """The owners' names, numbers, births and homes, what the owner is, how owners hold together, and the heirs, who stand in for a second owner."""
    p = _Pages(F.col("pages"))
    own = F.col("owners")
    name = p.field(own, "ho_ten_chu_1", "ho_ten")
    valid = p.first(F.col("every"), lambda x: x["fields"]["ho_ten_chu_1"], lambda t: v.v_person(t)["ok"])
    number = lambda *names: v.let(p.field(own, *names), lambda f: F.when(f.isNotNull() & ~contains_any(F.lower(f["value"]), ADDRESS_IN_NUMBER) & f["value"].rlike(r"\d"), f["value"]).otherwise(""))
    out = docs.withColumns({
        "_name": F.when(v.v_person(name["value"])["ok"] | valid.isNull(), F.coalesce(name["value"], F.lit(""))).otherwise(valid["value"]),
        "_second": F.coalesce(p.field(own, "ho_ten_chu_2")["value"], F.lit("")),
        "_id": number("cmnd_chu_1", "cccd_chu_1", "cmnd"), "_id2": number("cmnd_chu_2", "cccd_chu_2"),
        "_born": F.coalesce(p.field(own, "ngay_sinh_chu_1", "nam_sinh_chu_1", "ngay_sinh")["value"], F.lit("")), "_born2": F.coalesce(p.field(own, "ngay_sinh_chu_2", "nam_sinh_chu_2")["value"], F.lit("")),
        "_home": p.field(own, "dia_chi_thuong_tru"), "_home2": p.field(own, "dia_chi_thuong_tru_chu_2"),
        "heirs": F.coalesce(F.get(F.filter(F.transform(F.concat(own, F.col("every")), lambda i: F.filter(F.get("pages", i)["heirs"], lambda h: F.coalesce(h["ho_ten"], F.lit("")) != "")), lambda h: F.size(h) > 0), F.lit(0)), F.array().cast(HEIRS)),
    })
    out = out.withColumn("_couple", split_couple(F.col("_name")))
    heirs = F.size("heirs") > 0
    one = F.when(F.col("_couple.joint"), F.col("_couple.first")).otherwise(F.col("_name"))
    two = F.when(heirs, "").when(F.col("_couple.joint"), F.col("_couple.second")).otherwise(F.col("_second"))
    out = out.withColumns({"_one": F.trim(one), "_two": F.trim(two)})
    low = F.lower("_name")
    kind = F.when(heirs, "heirs").when(F.col("_couple.joint") | (F.col("_two") != ""), "couple").when(contains_any(low, HOUSEHOLD), "household").when(contains_any(low, ORGANISATION), "organisation").otherwise("person")
    of = lambda table, key: functools.reduce(lambda c, k: c.when(key == k, F.lit(table[k])), table, F)
    joint = F.when(kind.isin("heirs", "couple"), kind).otherwise("none")
    parts = lambda c: F.filter(F.transform(F.split(c, "[,;]"), lambda x: F.trim(x)), lambda x: x != "")

    def person_id(text: Column, also: Column) -> Column:
        """A number of 9 or 12 digits, else a word that is one in the texts beside it: digits behind a name's letters are none."""
        return F.coalesce(F.when(v.v_identity(text)["ok"], digits_only(text)), F.get(identity_numbers(F.concat_ws(" ", text, also), words=True), F.lit(0)))

    def born(text: Column, also: Column) -> Column:
        return F.coalesce(F.when(v.v_birth_year(text)["ok"], v.v_birth_year(text)["value"]), F.get(birth_years(also, words=True), F.lit(0)))

    ids, years = parts(F.col("_id")), parts(F.col("_born"))
    id1, id2 = person_id(F.get(ids, F.lit(0)), F.col("_name")), F.coalesce(person_id(F.get(ids, F.lit(1)), F.lit("")), person_id(F.nullif(F.col("_id2"), F.lit("")), F.col("_second")))
    out = out.withColumns({"_n1": F.when(F.col("_id") != "", id1), "_n2": id2, "_y1": born(F.get(years, F.lit(0)), F.col("_name")), "_y2": F.coalesce(born(F.get(years, F.lit(1)), F.lit("")), born(F.nullif(F.col("_born2"), F.lit("")), F.lit("")))})
    year1 = F.coalesce("_y1", birth_from_identity(F.col("_n1")))
    front = F.lit(1)
    second = lambda result: F.when(F.col("_two") != "", result).otherwise(F.expr(_NOT_APPLICABLE))
    person = lambda c, conf: v.let(v.v_person(c), lambda r: _result(c, F.when(r["ok"], r["value"]).otherwise(c), r["ok"], front, F.lit(conf), r["reason"]))
    out = out.withColumns({
        "ho_ten_chu_1": person(F.col("_one"), 0.95),
        "cccd_chu_1": _result(F.nullif(F.col("_id"), F.lit("")), F.col("_n1"), F.col("_n1").isNotNull(), front, F.lit(0.95)),
        "nam_sinh_chu_1": _result(F.coalesce(F.nullif(F.col("_born"), F.lit("")), year1), year1, year1.isNotNull(), front, F.lit(0.90)),
        "ho_ten_chu_2": second(person(F.col("_two"), 0.90)),
        "cccd_chu_2": second(_result(F.coalesce(F.nullif(F.col("_id2"), F.lit("")), F.col("_n2")), F.col("_n2"), F.col("_n2").isNotNull(), front, F.lit(0.90))),
        "nam_sinh_chu_2": second(_result(F.coalesce(F.nullif(F.col("_born2"), F.lit("")), F.col("_y2")), F.col("_y2"), F.col("_y2").isNotNull(), front, F.lit(0.90))),
        "dia_chi_thuong_tru": v.let(v.clean_address(F.col("_home.value")), lambda a: _plain(F.col("_home"), a, 0.90)),
        "dia_chi_thuong_tru_chu_2": v.let(v.clean_address(F.col("_home2.value")), lambda a: _plain(F.col("_home2"), a, 0.90)),
        "loai_chu": v.let(of(KINDS, kind), lambda k: _result(k, k, F.lit(True), F.lit(None), F.lit(1.0))),
        "dong_su_dung": of(JOINT, joint),
        "ho_ten_goc": F.col("_name"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def parcel_fields(docs: DataFrame) -> DataFrame:
    """Parcel, sheet, scale, address, areas, use, term, form and origin, and the parcels with what the table's check says of them."""
    p, order = _Pages(F.col("pages")), F.col("parcels_first")
    get = lambda *names: p.field(order, *names)
    page = F.get("pages", F.col("parcel_at"))
    out = docs.withColumns({
        "so_thua": _checked(get("so_thua"), v.v_parcel), "to_ban_do": _checked(get("to_ban_do"), v.v_map_sheet), "ty_le_ban_do": _checked(get("ty_le", "ty_le_ban_do"), v.v_scale, keep_raw=True),
        "parcels": F.coalesce(page["parcels"], F.array().cast(PARCEL)), "_address": get("dia_chi", "dia_chi_thua"),
        "_cap": get("dien_tich_cap", "dien_tich"), "_rieng": get("dien_tich_rieng", "dien_tich"), "_chung": get("dien_tich_chung"), "_words": get("dien_tich_chu", "dien_tich_bang_chu"),
        "_use": get("muc_dich_su_dung"), "_code": get("ma_muc_dich"), "_term": get("thoi_han", "thoi_han_su_dung"), "_form": get("hinh_thuc_su_dung"), "_origin": get("nguon_goc", "nguon_goc_su_dung"),
    })
    # a table tells the numbers that no field does
    joined = lambda c, distinct: v.let(F.filter(F.transform("parcels", lambda x: x[c]), lambda t: F.coalesce(t, F.lit("")) != ""), lambda ts: F.array_join(F.array_distinct(ts) if distinct else ts, "+"))
    from_table = lambda field, c, distinct: F.when(F.col(f"{field}.value").isNull() & (joined(c, distinct) != ""), _result(joined(c, distinct), joined(c, distinct), F.lit(True), page["page_index"] + 1, F.lit(0.90))).otherwise(F.col(field))
    out = out.withColumns({"so_thua": from_table("so_thua", "so_thua", False), "to_ban_do": from_table("to_ban_do", "to_ban_do", True)})
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\+"), lambda x: F.trim(x)), lambda x: x != "")
    numbers, sheets = split(F.col("so_thua.value")), split(F.col("to_ban_do.value"))
    blank = F.lit(None).cast("string")
    dealt = F.transform(numbers, lambda n, i: F.struct(n.alias("so_thua"), F.when(F.size(sheets) == F.size(numbers), F.get(sheets, i)).when(F.size(sheets) == 1, F.get(sheets, F.lit(0))).otherwise("").alias("to_ban_do"), v.clean_address(F.col("_address.value")).alias("dia_chi"), F.lit(None).cast("double").alias("dien_tich"), *[blank.alias(c) for c in ("muc_dich_su_dung", "ma_muc_dich", "thoi_han", "nguon_goc", "nguon_goc_ky_hieu")]))
    out = out.withColumn("parcels", F.when(F.size("parcels") > 0, F.col("parcels")).when(F.size(numbers) > 1, dealt).otherwise(F.col("parcels")))
    areas = F.filter(F.transform("parcels", lambda x: x["dien_tich"]), lambda a: a.isNotNull())
    whole = v.to_number(page["fields"]["dien_tich_cap"])
    apart = F.abs(F.aggregate(areas, F.lit(0.0), lambda a, b: a + b) - whole) > F.greatest(F.lit(0.5), F.abs(whole) * 0.01)
    stated, rows = page["stated_total"], F.size("parcels")
    reasons = F.array_compact(F.array(
        F.when((stated > 0) & (stated != rows), F.concat(F.lit("row_count_mismatch:"), rows.cast("string"), F.lit("!="), stated.cast("string"))),
        F.when(whole.isNotNull() & (F.size(areas) == rows) & (rows > 0) & apart, "area_sum_mismatch"),
        F.when(whole.isNotNull() & (F.size(areas) != rows), "missing_area_rows"),
    ))
    clean = v.clean_address(F.col("_address.value"))
    other = F.get(F.filter(F.transform("parcels", lambda x: x["dia_chi"]), lambda t: F.coalesce(t, F.lit("")) != ""), F.lit(0))
    noisy = F.coalesce(contains_any(F.lower(clean), PARCEL_ADDRESS_NOISE), F.lit(True)) | (F.coalesce(clean, F.lit("")) == "")
    out = out.withColumns({"parcel_reasons": reasons, "_clean": F.when(noisy, F.coalesce(other, clean)).otherwise(clean)})
    digit = lambda c: F.coalesce(c.rlike(r"\d"), F.lit(False))
    cap, rieng = F.col("_cap.value"), F.col("_rieng.value")
    cap2 = F.when(digit(cap), cap).when(cap.isNotNull() & digit(rieng), rieng)
    rieng2 = F.when(digit(rieng), rieng).when(rieng.isNotNull() & digit(cap2), cap2)
    out = out.withColumns({"_c": cap2, "_r": rieng2}).withColumn("_b", v.v_area_balance(F.col("_c"), F.col("_r"), F.col("_chung.value")))
    ok = F.col("_b.ok")
    area = lambda raw, part, conf: _result(raw, F.when(ok, F.col(f"_b.{part}").cast("string")).otherwise(raw), ok, F.col("_cap.page"), F.when(ok, F.lit(conf)).otherwise(F.lit(0.40)), F.col("_b.reason"))
    words = after_label(F.col("_words.value"), ("bang chu", "chu"))
    code = select_land_code(F.col("_code.value"), F.col("_use.value"))
    forever = fold_accents(F.col("_term.value")).rlike(r"lau\s*d[a]?[iy]")
    out = out.withColumns({"_code2": code, "_long": F.when(forever, "Lâu dài").otherwise(F.col("_term.value")), "_o": v.v_origin(F.col("_origin.value"))})
    alone = F.col("_form").isNull() & F.col("_c").isNotNull() & F.col("_r").isNotNull() & F.when(ok, F.col("_b.shared") == 0).otherwise(F.coalesce(F.col("_chung.value"), F.lit("")).isin("", "0", "0.0"))
    form = F.when(alone, F.lit(PRIVATE_USE)).otherwise(F.col("_form.value"))
    out = out.withColumns({
        "dia_chi_thua": _plain(F.col("_address"), F.col("_clean"), 0.90),
        "dien_tich_cap": area(F.col("_c"), "granted", 0.95), "dien_tich_rieng": area(F.col("_r"), "private", 0.90), "dien_tich_chung": area(F.col("_chung.value"), "shared", 0.90),
        "dien_tich_chu": _result(F.col("_words.value"), words, (words != "") & ~words.contains("?"), F.col("_words.page"), F.lit(0.85), F.lit("unreadable")),
        "muc_dich_su_dung": _plain(F.col("_use"), None, 0.90),
        "ma_muc_dich": _result(F.coalesce(F.col("_code.value"), F.col("_use.value")), F.col("_code2"), F.col("_code2") != "", F.coalesce(F.col("_code.page"), F.col("_use.page")), F.lit(0.90), F.lit("unknown code")),
        "thoi_han_su_dung": _plain(F.col("_term"), F.col("_long"), 0.90),
        "hinh_thuc_su_dung": _result(form, form, form.isNotNull(), F.col("_form.page"), F.lit(0.85)),
        "nguon_goc_su_dung": _result(F.col("_origin.value"), F.col("_o.value"), F.col("_o.ok"), F.col("_origin.page"), F.lit(0.85), F.col("_o.reason")),
        "nguon_goc_ky_hieu": F.col("_o.code"),
    })
    out = out.withColumn("parcels", _with_defaults(out))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def _with_defaults(docs: DataFrame) -> Column:
    """The parcels with the document's address, use, code and term where theirs are blank; the origin is taken over only by a single parcel, and only known origins are kept."""
    fill = lambda own, field: F.coalesce(nullify_placeholder(own), F.col(f"{field}.value"), F.lit(""))

    def one(x: Column) -> Column:
        origin = v.v_origin(x["nguon_goc"])
        alone = F.size("parcels") == 1
        return F.struct(x["so_thua"].alias("so_thua"), x["to_ban_do"].alias("to_ban_do"), fill(x["dia_chi"], "dia_chi_thua").alias("dia_chi"), x["dien_tich"].alias("dien_tich"), fill(x["muc_dich_su_dung"], "muc_dich_su_dung").alias("muc_dich_su_dung"), fill(x["ma_muc_dich"], "ma_muc_dich").alias("ma_muc_dich"), fill(x["thoi_han"], "thoi_han_su_dung").alias("thoi_han"), F.when(origin["ok"], origin["value"]).when(alone, F.coalesce(F.col("nguon_goc_su_dung.value"), F.lit(""))).otherwise("").alias("nguon_goc"), F.when(origin["ok"], origin["code"]).when(alone, F.coalesce("nguon_goc_ky_hieu", F.lit(""))).otherwise("").alias("nguon_goc_ky_hieu"))

    return F.transform("parcels", one)


def issue_fields(docs: DataFrame) -> DataFrame:
    """noi_cap, ngay_cap, nguoi_ky_qd, chuc_vu_nguoi_ky and the fields of the latest change. Authority and signer come from a page's lines alone; no reading of a field stands in for them."""
    p = _Pages(F.col("pages"))
    place = p.first(F.col("certified_first"), lambda x: x["certified"]["noi_cap"])
    signer = p.first(F.col("certified_first"), lambda x: x["certified"]["nguoi_ky_qd"], lambda t: t.isNotNull() & ~contains_any(F.lower(t), SIGNER_NOISE))
    search = F.when(F.size("certified") > 0, F.col("certified")).otherwise(F.col("every"))
    again = p.first(search, lambda x: x["certified"]["ngay_cap"])
    out = docs.withColumns({"_place": place, "_signer": signer, "_raw_place": p.field(F.col("certified_first"), "noi_cap"), "_date": p.field(search, "ngay_cap"), "_again": again, "_role": p.field(F.col("certified_first"), "chuc_vu_nguoi_ky")})
    out = out.withColumn("_d", v.v_date(F.col("_date.value")))
    page = lambda c: F.get("pages", F.col(f"{c}.at"))["page_index"] + 1
    date = F.when(F.col("_d.ok"), _result(F.col("_date.value"), F.col("_d.value"), F.lit(True), F.col("_date.page"), F.col("_date.confidence"))).when(F.col("_again").isNotNull(), _result(F.col("_again.value"), F.col("_again.value"), F.lit(True), page("_again"), F.lit(0.85))).otherwise(_result(F.col("_date.value"), F.lit(""), F.lit(False), F.col("_date.page"), F.col("_date.confidence"), F.col("_d.reason")))
    said = p.first(F.col("changes"), lambda x: F.coalesce(nullify_placeholder(x["fields"]["thong_tin_bien_dong"]), nullify_placeholder(x["fields"]["bien_dong"])), lambda t: ~contains_any(F.lower(t), CHANGE_HEADINGS) | contains_any(F.lower(t), (*CHANGE_ACTS, "cccd", "cmnd")))
    out = out.withColumns({
        "noi_cap": _result(F.coalesce(F.col("_place.value"), F.col("_raw_place.value")), F.col("_place.value"), F.col("_place").isNotNull(), page("_place"), F.lit(0.95), F.lit("no evidence")),
        "ngay_cap": date,
        "nguoi_ky_qd": _result(F.col("_signer.value"), F.col("_signer.value"), F.col("_signer").isNotNull(), page("_signer"), F.lit(0.95), F.lit("no evidence")),
        "chuc_vu_nguoi_ky": _checked(F.col("_role"), v.v_signer_role, keep_raw=True),
        "_said": said,
        **{names[0]: p.field(F.col("changes"), *names)["value"] for names in TRANSFER_FIELDS},
    })
    changed = F.col("_said").isNotNull() | F.col("ten_chuyen_nhuong_moi").isNotNull()
    out = out.withColumn("thong_tin_bien_dong", F.when(changed, _result(F.coalesce(F.col("_said.value"), F.col("ten_chuyen_nhuong_moi")), F.col("_said.value"), F.lit(True), page("_said"), F.lit(0.90))).otherwise(F.expr(_NOT_APPLICABLE)))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


#: Fields whose lack is a case for review, whether or not something was read.
ALWAYS_REVIEWED = ("so_vao_so", "noi_cap", "nguoi_ky_qd")
RESULTS = (
    "so_phat_hanh", "so_vao_so", "ma_vach", "ho_ten_chu_1", "cccd_chu_1", "nam_sinh_chu_1", "ho_ten_chu_2", "cccd_chu_2", "nam_sinh_chu_2", "dia_chi_thuong_tru", "loai_chu", "so_thua", "to_ban_do", "dia_chi_thua",
    "dien_tich_cap", "dien_tich_rieng", "dien_tich_chung", "dien_tich_chu", "muc_dich_su_dung", "ma_muc_dich", "thoi_han_su_dung", "hinh_thuc_su_dung", "nguon_goc_su_dung", "noi_cap", "ngay_cap", "nguoi_ky_qd",
    "chuc_vu_nguoi_ky", "ty_le_ban_do", "thong_tin_bien_dong",
)


def merge_pages(pages: DataFrame, serials: DataFrame | None = None) -> DataFrame:
    """One row per document: the 29 fields as structs of value, raw, page, confidence, status and reason, parcels and their reasons, heirs, the latest transfer, template, n_pages and ``can_review``, the sorted fields that need a look.

    ``serials`` (``best_serials``) are the serials that boxes show. A document
    without pages has no row; a page without lines or fields gives nothing.
    """
    docs = page_orders(page_facts(pages, serials))
    out = issue_fields(parcel_fields(owner_fields(identity_fields(docs))))
    review = [F.when(F.col(f"{f}.status") == "review_required", F.lit(f)) for f in RESULTS if f not in ("ho_ten_chu_1", "ho_ten_chu_2")]
    review += [F.when(F.col(f"{f}.status") != "valid", F.lit(f)) for f in ALWAYS_REVIEWED] + [F.when(F.size("parcel_reasons") > 0, "danh_sach_thua")]
    can_review = F.array_sort(F.array_distinct(F.array_compact(F.array(*review))))
    kept = [*RESULTS, "dia_chi_thuong_tru_chu_2", "dong_su_dung", "ho_ten_goc", "nguon_goc_ky_hieu", "parcels", "parcel_reasons", "heirs", *[names[0] for names in TRANSFER_FIELDS]]
    return out.select("doc_id", F.col("n").alias("n_pages"), "template", *kept, can_review.alias("can_review"))


def flat_values(merged: DataFrame) -> DataFrame:
    """``merged`` with the fields' values in place of their structs."""
    return merged.select(*[F.col(f"{c}.value").alias(c) if c in (*RESULTS, "dia_chi_thuong_tru_chu_2") else F.col(c) for c in merged.columns])


def apply_mutations(documents: DataFrame, changes: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """Flat documents with what later changes say, the originals kept in ``*_goc``, and ``changed_by``: model, rules or null.

    ``changes`` has doc_id, page_index, stt and content. ``answers``, where a
    model was asked, has doc_id and any of to_ban_do, so_thua, dien_tich_cap,
    cccd_chu_1 and ho_ten_chu_1; its values are taken as they are. Without an
    answer rules take a corrected map sheet and a replaced number. New sheets,
    parcels and areas are dealt to all parcels.
    """
    texts = changes.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "stt", "content"))), lambda c: c["content"]).alias("_texts"))
    asked = {"to_ban_do": "sheet", "so_thua": None, "dien_tich_cap": None, "cccd_chu_1": "identity", "ho_ten_chu_1": None}
    out = documents.join(texts, "doc_id", "left").withColumn("_rules", F.when(F.col("_texts").isNotNull(), fallback_changes(F.col("_texts"))))
    if answers is not None:
        out = out.join(answers.select("doc_id", F.lit(True).alias("_asked"), *[F.col(c).cast("string").alias(f"_a_{c}") for c in asked if c in answers.columns]), "doc_id", "left")
    have = set(out.columns)
    by_model = F.coalesce(F.col("_asked"), F.lit(False)) if answers is not None else F.lit(False)
    new = {}
    for c, rule in asked.items():
        told = nullify_placeholder(F.col(f"_a_{c}")) if f"_a_{c}" in have else F.lit(None).cast("string")
        found = F.col(f"_rules.{rule}") if rule else F.lit(None).cast("string")
        value = F.when(F.col("_texts").isNotNull(), F.when(by_model, told).otherwise(found))
        new[c] = F.when(value != F.coalesce(F.col(c), F.lit("")), value)
    out = out.withColumns({f"_n_{c}": x for c, x in new.items()})
    parcels = F.transform("parcels", lambda x: x.withField("to_ban_do", F.coalesce(F.col("_n_to_ban_do"), x["to_ban_do"])).withField("so_thua", F.coalesce(F.col("_n_so_thua"), x["so_thua"])).withField("dien_tich", F.coalesce(v.to_number(F.col("_n_dien_tich_cap")), x["dien_tich"])))
    any_new = functools.reduce(lambda a, b: a | b, [F.col(f"_n_{c}").isNotNull() for c in asked])
    out = out.withColumns({
        **{f"{c}_goc": F.when(F.col(f"_n_{c}").isNotNull(), F.col(c)) for c in asked},
        **{c: F.coalesce(f"_n_{c}", c) for c in asked},
        "parcels": parcels,
        "new_owner": F.col("_rules.owner"),
        "changed_by": F.when(any_new & by_model, "model").when(any_new, "rules"),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def review_reasons(merged: DataFrame, fields: Sequence[str] = RESULTS) -> DataFrame:
    """doc_id, field_key and reason of each field that needs review."""
    rows = F.array(*[F.struct(F.lit(f).alias("field_key"), F.col(f"{f}.status").alias("status"), F.col(f"{f}.reason").alias("reason")) for f in fields])
    return merged.select("doc_id", F.explode(rows).alias("r")).where("r.status = 'review_required'").select("doc_id", "r.field_key", "r.reason")
