"""Page-grain decisions: which pages are a certificate's, what template and role they have, how they lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import contains_any, fold_accents
from parcelforge.session import counted_broadcast

# ---------------------------------------------------------------- fixed values
# Accent-free keywords of the certificate templates, upper case.
TEMPLATE_KEYWORDS = {
    "mau_2024": (
        "QUYEN SO HUU TAI SAN GAN LIEN VOI DAT", "1. NGUOI SU DUNG DAT", "2. THONG TIN THUA DAT", "3. THONG TIN TAI SAN GAN LIEN VOI DAT", "VAN PHONG DANG KY DAT DAI",
        "THE HIEN TAI MA QR", "THONG TIN CHI TIET DUOC THE HIEN", "LOAI DAT: DAT",
    ),
    "mau_A": (
        "CAP CHO HO ONG", "CAP CHO HO BA", "CAP CHO HO", "CAP CHO ONG", "CAP CHO BA", "SO AB", "SOAB", "SO QDD", "TEN NGUOI SU DUNG", "THUA DAT DUOC QUYEN", "THUA DAT DUOC QUYEN SU DUNG",
        "HO KHAU THUONG TRU", "I- TEN NGUOI", "II- THUA DAT", "III- TAI SAN", "IV- GHI CHU", "V- SO DO THUA DAT", "VI- NHUNG THAY DOI", "KHONG DUOC EP PLASTIC", "UBND TINH", "UBND HUYEN",
        "UBND THANH PHO", "UY BAN NHAN DAN",
    ),
    "mau_B": (
        "QUYEN SO HUU NHA", "TAI SAN KHAC GAN LIEN VOI DAT", "TAI SAN KHAC GAN LIEN", "NHA O VA TAI SAN", "CHU SO HUU NHA", "THUA DAT, NHA O", "THUA DAT NHA O", "SO HONG", "I - NGUOI SU DUNG",
        "I. NGUOI SU DUNG", "II. THUA DAT", "II - THUA DAT", "III. SO DO THUA DAT", "IV. NHUNG THAY DOI", "CHUYEN NHUONG CHO", "GIAY CHUNG NHAN QUYEN SU DUNG DAT, QUYEN SO HUU",
        "BO TAI NGUYEN VA MOI TRUONG", "TRANG BO SUNG GIAY CHUNG NHAN", "C) DIEN TICH", "D) MUC DICH", "E) THOI HAN", "G) NGUON GOC",
    ),
}
# Words of a certificate's pages and of papers that are none, as they are written.
CERTIFICATE = (
    "giấy chứng nhận", "quyền sử dụng đất", "thửa đất số", "sơ đồ thửa đất", "trang bổ sung giấy chứng nhận", "i. người sử dụng", "ii. thửa đất", "iv. những thay đổi",
    "chủ sở hữu nhà", "bằng chữ:", "bằng chữ :", "diện tích:", "diện tích :",
)
OTHER_PAPERS = (
    "đơn đăng ký", "đơn đề nghị cấp", "biên lai thu", "thông báo nộp tiền", "tờ khai lệ phí", "mảnh trích đo địa chính", "hợp đồng chuyển nhượng", "văn bản công chứng",
)
# Words that tell what a page is for; a cover shows none of the last list.
CHANGES_PAGE = ("trang bổ sung", "trang bo sung", "những thay đổi sau khi cấp", "nhung thay doi sau khi cap", "chuyển nhượng cho", "chuyen nhuong cho")
COVER_PAGE = (
    "người sử dụng đất, chủ sở hữu", "nguoi su dung dat, chu so huu", "người sử dụng đất", "nguoi su dung dat", "i. người sử dụng", "i- người sử dụng", "cộng hòa xã hội chủ nghĩa việt nam",
    "giấy chứng nhận quyền sử dụng đất",
)
CONTENT_PAGE = (
    "ii. thửa đất", "ii- thửa đất", "1. thửa đất", "thửa đất số", "thua dat so", "tờ bản đồ số", "to ban do so", "diện tích:", "dien tich:", "nguồn gốc sử dụng", "nguon goc su dung",
)
DIAGRAM_PAGE = ("iii. sơ đồ thửa đất", "iii- sơ đồ", "sơ đồ thửa đất", "so do thua dat", "tọa độ đỉnh", "chiều dài cạnh")
NO_COVER = ("ii. thửa đất", "1. thửa đất", "thửa đất số:")
#: Words of a table of changes, accent-free.
ENDORSEMENT_WORDS = ("nhung thay doi sau khi cap", "noi dung thay doi", "co so phap ly", "xac nhan cua co quan", "trang bo sung", "the chap", "chuyen nhuong", "tang cho", "thua ke", "dinh chinh")
REGISTRATION_ANCHOR = ("dang", "ky", "dat", "dai", "tai", "san", "khac", "gan", "lien")
# ---------------------------------------------------------------- end of fixed values


def keyword_score(keywords: Sequence[str], full: Column, top: Column | None, full_weight: int, top_weight: int) -> Column:
    hit = lambda text, w: [F.when(F.contains(text, F.lit(k)), w).otherwise(0) for k in keywords]
    parts = hit(full, full_weight) + (hit(top, top_weight) if top is not None else [])
    return sum(parts[1:], parts[0])


def template_of(keywords: dict[str, Sequence[str]], full: Column, top: Column | None = None, full_weights: dict[str, int] | None = None) -> Column:
    """The template of a page by the keywords in its text and its top part: 2024 from 3 points on, else B if it has as many as A and one at least, else A, else unknown."""
    w = {"mau_2024": 2, "mau_A": 1, "mau_B": 1} | (full_weights or {})
    new, a, b = (keyword_score(keywords[t], full, top, w[t], 3 if t == "mau_2024" else 2) for t in ("mau_2024", "mau_A", "mau_B"))
    return F.when(new >= 3, "mau_2024").when((b >= a) & (b >= 1), "mau_B").when(a >= 1, "mau_A").otherwise("unknown")


def classify_template(tokens: DataFrame, top_share: float = 0.4) -> DataFrame:
    """doc_id, page_index, template, from tokens with boxes; the top part is what begins in the upper ``top_share`` of the page's tokens."""
    page = Window.partitionBy("doc_id", "page_index")
    placed = tokens.where(F.trim("text") != "").withColumn("_low", F.max("y2").over(page))
    own, top = F.struct("ord", "text"), F.when(F.col("y1") <= top_share * F.col("_low"), F.struct("ord", "text"))
    joined = lambda c: F.upper(fold_accents(F.array_join(F.transform(F.array_sort(F.collect_list(c)), lambda t: t["text"]), " ")))
    texts = placed.groupBy("doc_id", "page_index").agg(joined(own).alias("full"), joined(top).alias("top"))
    return texts.select("doc_id", "page_index", template_of(TEMPLATE_KEYWORDS, F.col("full"), F.when(F.col("top") != "", F.col("top")).otherwise(F.col("full"))).alias("template"))


def main_template(pages: DataFrame) -> DataFrame:
    """B if any page is, else the first known one, else A."""
    known = F.min_by("template", F.when(F.col("template") != "unknown", F.col("page_index")))
    return pages.groupBy("doc_id").agg(F.when(F.bool_or(F.col("template") == "mau_B"), "mau_B").otherwise(F.coalesce(known, F.lit("mau_A"))).alias("template"))


def page_role(text: Column, template: Column) -> Column:
    """What a page is for by its text: unknown without any, changes, cover_and_content (all other pages of template A), cover, content or diagram; content where nothing tells."""
    low = F.lower(F.coalesce(text, F.lit("")))
    content = contains_any(low, CONTENT_PAGE)
    return (
        F.when(F.trim(low) == "", "unknown")
        .when(contains_any(low, CHANGES_PAGE), "changes")
        .when(template.eqNullSafe("mau_A"), "cover_and_content")
        .when(contains_any(low, COVER_PAGE) & ~contains_any(low, NO_COVER), "cover")
        .when(~content & contains_any(low, DIAGRAM_PAGE), "diagram")
        .otherwise("content")
    )


def is_diagram(text: Column) -> Column:
    f = fold_accents(text)
    return f.rlike("so do thua dat|chieu dai canh|toa do|so hieu diem") & ~f.rlike("muc dich su dung|nguon goc su dung")


def is_landscape(width: Column, height: Column) -> Column:
    return F.coalesce((height > 0) & (width / F.nullif(height, F.lit(0)) > 1.25), F.lit(False))


def is_supplement(width: Column, height: Column) -> Column:
    """A narrow added page, in points."""
    return F.coalesce(width.between(480, 580) & height.between(680, 810) & (width / F.nullif(height, F.lit(0))).between(0.6, 0.8), F.lit(False))


def split_spread(pages: DataFrame, overlap: float = 10.0) -> DataFrame:
    """A row for each half of a landscape page, with x_from and x_to; other pages whole, as half 0."""
    half = lambda i, a, b: F.struct(F.lit(i).alias("half"), a.alias("x_from"), b.alias("x_to"))
    mid = F.col("width") / 2
    two = F.array(half(0, F.lit(0.0), mid + overlap / 2), half(1, mid - overlap / 2, F.col("width")))
    one = F.array(half(0, F.lit(0.0), F.col("width").cast("double")))
    return pages.withColumn("_h", F.explode(F.when(is_landscape(F.col("width"), F.col("height")), two).otherwise(one))).select(*pages.columns, "_h.*")


def select_certificate_pages(pages: DataFrame) -> DataFrame:
    """The pages of a file that are the certificate's. ``pages`` has doc_id, page_index from 0, width, height, text.

    All of four pages and fewer. Else, if the first two are landscape, these,
    and of the next two those that are narrow supplements. Else those whose
    text is a certificate's and no other paper's.
    """
    index = F.col("page_index")
    doc = Window.partitionBy("doc_id")
    wide = is_landscape(F.col("width"), F.col("height"))
    text = F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")
    counted = pages.withColumns({"_n": F.count("*").over(doc), "_spread": F.bool_and((index > 1) | wide).over(doc)})
    front = (index < 2) | (index.between(2, 3) & is_supplement(F.col("width"), F.col("height")))
    own = contains_any(text, CERTIFICATE) & ~contains_any(text, OTHER_PAPERS)
    return counted.where((F.col("_n") <= 4) | F.when(F.col("_spread"), front).otherwise(own)).drop("_n", "_spread")


def is_two_page_profile(pages: DataFrame) -> DataFrame:
    return pages.groupBy("doc_id").agg(((F.count("*") == 2) & F.bool_or("qr_detected")).alias("two_page"))


def is_registration_anchor(text: Column) -> Column:
    """Seven of the nine words of the registration table's title, not the one of directive 299."""
    words = F.array_distinct(F.split(F.regexp_replace(fold_accents(text), "[^a-z0-9]+", " "), " "))
    return (F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in REGISTRATION_ANCHOR]))) >= 7) & ~text.contains("299")


def image_quality(blur: Column, brightness: Column) -> Column:
    """What is wrong with a picture, from its Laplacian variance and mean brightness."""
    return F.array_compact(F.array(F.when(blur < 50, "blurry"), F.when(brightness < 50, "dark"), F.when(brightness > 220, "bright")))


def fill_page_ids(pages: DataFrame) -> DataFrame:
    """``group_id``: the serial that a page shows, or ``unknown_0``, ``unknown_1`` and so on within a batch."""
    w = Window.partitionBy("batch_id", F.col("serial").isNull()).orderBy("page_index")
    return pages.withColumn("group_id", F.coalesce("serial", F.concat(F.lit("unknown_"), (F.row_number().over(w) - 1).cast("string"))))


def validate_groups(pages: DataFrame, least: int = 1, most: int = 10) -> DataFrame:
    """group_id, n_pages and whether a group has a possible number of pages and one serial at most."""
    out = pages.groupBy("group_id").agg(F.count("*").alias("n_pages"), F.countDistinct("serial").alias("n_serials"))
    return out.withColumn("ok", F.col("n_pages").between(least, most) & (F.col("n_serials") <= 1))


def most_common(values: DataFrame, group: Sequence[str], value: str, order: str, least: int = 2) -> DataFrame:
    """Each group's most frequent value that comes ``least`` times, the first seen of equals."""
    counts = values.groupBy(*group, value).agg(F.count("*").alias("n"), F.min(order).alias("_first")).where(F.col("n") >= least)
    return counts.groupBy(*group).agg(F.max_by(value, F.struct("n", (-F.col("_first")).alias("f"))).alias(value), F.max("n").alias("n"))


def crop_manifest(tokens: DataFrame, wanted: DataFrame, width: Column, height: Column) -> DataFrame:
    """field, the token that best shows it, and its grown box, for fields with an accent-free pattern (field, pattern)."""
    from parcelforge.operators.spatial import expand_box

    hits = tokens.join(counted_broadcast(wanted), F.rlike(fold_accents(F.col("text")), F.col("pattern")))
    best = hits.groupBy("doc_id", "page_index", "field").agg(F.max_by(F.struct("ord", "text", "x1", "y1", "x2", "y2"), F.struct("confidence", (-F.col("ord")).alias("o"))).alias("b"))
    return best.select("doc_id", "page_index", "field", "b.*").select("doc_id", "page_index", "field", "ord", "text", *expand_box(width, height))


def page_number(pages: DataFrame) -> DataFrame:
    """``page``: the number of each page in its document, from 1, whatever the indexes are."""
    return pages.withColumn("page", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index")))


#: Padding of crops by kind of box: share of the width with its least and most, share of the height with its least and most.
PADDING = {"wide": (0.025, 6, 40, 0.20, 2, 14), "default": (0.008, 2, 20, 0.20, 2, 12)}


def crop_padding(kind: Column, width: Column, height: Column) -> Column:
    """pad_x and pad_y of a crop in whole pixels; barcodes and identity numbers get more at their ends."""
    wide = kind.isin("barcode", "identity_number")
    of = lambda i: F.when(wide, F.lit(PADDING["wide"][i])).otherwise(F.lit(PADDING["default"][i]))
    side = lambda size, share, least, most: F.greatest(of(least), F.least(of(most), F.bround(size * of(share)))).cast("int")
    return F.struct(side(width, 0, 1, 2).alias("pad_x"), side(height, 3, 4, 5).alias("pad_y"))


def crop_boxes(tokens: DataFrame, width: Column, height: Column, kind: Column | None = None) -> DataFrame:
    """``tokens`` with c_x1, c_y1, c_x2 and c_y2, the crop of each box with its padding, within the page."""
    pad = crop_padding(kind if kind is not None else F.lit("default"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    out = tokens.withColumn("_pad", pad)
    low = lambda c, p: F.greatest(F.lit(0.0), F.col(c) - F.col(f"_pad.{p}"))
    high = lambda c, p, most: F.least(most.cast("double"), F.col(c) + F.col(f"_pad.{p}"))
    return out.withColumns({"c_x1": low("x1", "pad_x"), "c_y1": low("y1", "pad_y"), "c_x2": high("x2", "pad_x", width), "c_y2": high("y2", "pad_y", height)}).drop("_pad")


def is_endorsement_page(text: Column) -> Column:
    """Whether a page has a table of later changes, by its words."""
    return contains_any(fold_accents(F.coalesce(text, F.lit(""))), ENDORSEMENT_WORDS)
