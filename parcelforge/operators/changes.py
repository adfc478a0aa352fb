"""Changes after issue: the table of entries and confirmations on a page, and typed endorsements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.labels import after_label, holds
from parcelforge.functions.text import fold_accents
from parcelforge.operators.merge import endorsement_type, more_of
from parcelforge.operators.spatial import gap_islands, interval_overlap

# ---------------------------------------------------------------- fixed values
CONTENT_HEADERS = "nhung thay doi sau khi cap|noi dung thay doi|co so phap ly"
CONFIRM_HEADERS = "xac nhan cua co quan|tham quyen"
FOOTERS = "nguoi duoc cap giay chung nhan|khong duoc sua chua|khi bi mat|ma vach"
ENTRY_START = r"^(\d+[.)]\s*)?((ngay\s*)?\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4}|nguoi su dung dat|dinh chinh|chuyen nhuong|tang cho|the chap|xoa the chap|thay doi|doi (cmnd|cccd|can cuoc)|thua ke|(tach|hop) thua)"
# Accent-free wording and type of an entry, the first that holds.
ENTRY_TYPES = (
    ("dinh chinh", "dinh_chinh"), ("chuyen nhuong", "chuyen_nhuong"), ("thua ke|thira ke|thura ke", "thua_ke"), ("tang cho", "tang_cho"), ("the chap", "the_chap"),
    ("tach thua|hop thua", "tach_thua"), ("cmnd|cccd|so dinh danh|can cuoc", "thay_doi_cccd"),
)
AGENCIES = ("chi nhanh van phong dang ky dat dai", "van phong dang ky dat dai", "uy ban nhan dan", "ubnd", "so tai nguyen va moi truong")
# ---------------------------------------------------------------- end of fixed values

PAGE = ("doc_id", "page_index")
#: Words before the number of a file, accent-free.
FILE_LABELS = ("ho so so", "ho so", "hs so", "hs")


def two_columns(tokens: DataFrame, share: float = 0.6, page: Sequence[str] = PAGE) -> DataFrame:
    """The tokens of a change table's body with ``column``: 1 for the entries on the left, 2 for what confirms them.

    The table is on pages that show one of its headings; its body is what lies
    below the lowest heading and above the first footer. The columns meet half
    way between their headings, or at ``share`` of the page's width where one
    of these is missing.
    """
    folded, middle = fold_accents(F.col("text")), (F.col("x1") + F.col("x2")) / 2
    kind = F.when(folded.rlike(CONTENT_HEADERS), "left").when(folded.rlike(CONFIRM_HEADERS), "right").when(folded.rlike(FOOTERS), "foot")
    marks = tokens.select(*page, kind.alias("kind"), middle.alias("middle"), "x2", "y1", "y2").groupBy(*page).agg(
        F.avg(F.when(F.col("kind") == "left", F.col("middle"))).alias("l"),
        F.avg(F.when(F.col("kind") == "right", F.col("middle"))).alias("r"),
        F.max(F.when(F.col("kind").isin("left", "right"), F.col("y2"))).alias("top"),
        F.coalesce(F.min(F.when(F.col("kind") == "foot", F.col("y1"))), F.lit(float("inf"))).alias("bottom"),
        F.max("x2").alias("wide"),
    )
    table = marks.where("top is not null").select(*page, "top", "bottom", F.coalesce((F.col("l") + F.col("r")) / 2, share * F.col("wide")).alias("border"))
    body = tokens.join(table, list(page)).where((F.col("y1") > F.col("top")) & (F.col("y1") < F.col("bottom")) & (F.trim("text") != ""))
    return body.withColumn("column", F.when(middle < F.col("border"), 1).otherwise(2)).drop("top", "bottom", "border")


def change_entries(cells: DataFrame, gap: float = 50.0, page: Sequence[str] = PAGE) -> DataFrame:
    """Entries of the left column, numbered from the top as ``stt``: a start word, or a gap to the token above, begins one."""
    order = [F.col("y1"), F.col("ord")]
    left = cells.where("column = 1")
    below = F.col("y1") - F.lag("y2").over(Window.partitionBy(*page).orderBy(*order))
    islands = gap_islands(left.withColumn("_below", below), page, order, fold_accents(F.col("text")).rlike(ENTRY_START) | (F.col("_below") > gap))
    return islands.groupBy(*page, F.col("island").alias("stt")).agg(in_order("y1", "ord", text="text").alias("content"), F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))


def in_order(*order: str, text: str, sep: str = " ") -> Column:
    """The trimmed texts of a group in an order, joined; an aggregate."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.trim(text).alias("_t")))), lambda x: x["_t"]), sep)


def extract_mutations(tokens: DataFrame, above: float = 60.0, below: float = 80.0) -> DataFrame:
    """doc_id, page_index, stt, type, content, confirmation, date, file_no, agency and the height y1 to y2 of the entries of change tables.

    What confirms an entry are the right column's tokens that meet its height,
    ``above`` and ``below`` it included.
    """
    cells = two_columns(tokens)
    entries = change_entries(cells)
    right = cells.where("column = 2").select(*PAGE, "ord", "text", "x1", "y1", "x2", "y2")
    beside = interval_overlap(entries.select(*PAGE, F.col("stt").alias("ord"), "x1", "y1", "x2", "y2"), right.withColumn("ord", -1 - F.col("ord")), above, below)
    confirmed = beside.groupBy(*PAGE, F.col("a_ord").alias("stt")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y1", (-F.col("ord")).alias("o"), F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("confirmation"))
    out = entries.join(confirmed, [*PAGE, "stt"], "left").withColumn("confirmation", F.coalesce("confirmation", F.lit("")))
    said = F.concat_ws(" | ", "content", F.nullif(F.col("confirmation"), F.lit("")))
    out = out.withColumn("_said", said)
    return out.select(*PAGE, "stt", entry_type(F.col("content")).alias("type"), "content", "confirmation", first_date(F.col("_said")).alias("date"), file_number(F.col("_said")).alias("file_no"), named_agency(F.col("_said")).alias("agency"), "y1", "y2")


def entry_type(content: Column) -> Column:
    """The first listed type whose words an entry holds."""
    folded = fold_accents(content)
    return F.coalesce(*[F.when(folded.rlike(words), F.lit(name)) for words, name in ENTRY_TYPES], F.lit("bien_dong_khac"))


def first_date(text: Column) -> Column:
    """The first day, month and year with signs between, as dd/MM/yyyy."""
    parts = F.split(F.regexp_extract(text, r"(\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4})", 1), r"[/.\-]")
    return F.when(F.size(parts) == 3, F.concat_ws("/", F.lpad(F.get(parts, F.lit(0)), 2, "0"), F.lpad(F.get(parts, F.lit(1)), 2, "0"), F.get(parts, F.lit(2))))


def file_number(text: Column) -> Column:
    """The word with a digit that follows the words for a file."""
    word = F.regexp_replace(F.regexp_extract(after_label(text, FILE_LABELS, anywhere=True), r"^(\S+)", 1), r"[.,;:|]+$", "")
    return F.when(holds(text, FILE_LABELS) & word.rlike(r"\d"), word)


def named_agency(text: Column) -> Column:
    return F.coalesce(*[F.when(F.contains(fold_accents(text), F.lit(a)), F.lit(a.upper())) for a in AGENCIES])


def parse_endorsements(records: DataFrame, text: str = "text") -> DataFrame:
    """Typed records with kind, file_no, date and the new owner of a transfer."""
    t = F.col(text)
    owner = F.regexp_extract(t, r"(?iu)(?:cho|sang tên)\s*(?:hộ\s*)?(?:ông|bà)\s*:?\s*([\p{Lu}][\p{L} ]{2,50}?)(?=\s*(?:,|;|\.|sinh|cmnd|cccd|số|theo|$))", 1)
    kind = endorsement_type(t)
    return records.withColumns(
        {
            "kind": kind,
            "file_no": F.nullif(F.regexp_extract(t, r"(\d{6}\.[A-Z]{2}\.\d{3})", 1), F.lit("")),
            "date": F.nullif(F.regexp_extract(t, r"(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{4})", 1), F.lit("")),
            "new_owner": F.when(kind == "transfer", F.nullif(F.trim(owner), F.lit(""))),
        }
    )


def endorsement_state(endorsements: DataFrame, document: str = "doc_id", order: str = "stt") -> DataFrame:
    """Whether a mortgage is open, and the owner after the last transfer that names one."""
    named = F.when(F.col("new_owner").isNotNull(), F.col(order))
    return endorsements.groupBy(document).agg(more_of(F.col("kind"), "mortgage", "release").alias("mortgage_active"), F.max_by("new_owner", named).alias("current_owner"))


def is_mutation_page(tokens: DataFrame) -> DataFrame:
    """doc_id, page_index and whether one of a page's tokens is a heading of the change table."""
    head = fold_accents(F.col("text")).rlike(f"{CONTENT_HEADERS}|{CONFIRM_HEADERS}")
    return tokens.groupBy(*PAGE).agg(F.bool_or(F.coalesce(head, F.lit(False))).alias("is_mutation"))
