"""Parcel tables on pages: whether a page has one, its columns, rows and cells by place, and the text fallback.

A table's rows are read from whole pages, each gathered once, in ``page_tables``;
what is asked of pages alone (``multi_parcel_pages``, ``detect_columns``) is
columns by the same rules. A page has ``MOST_ROWS`` rows at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions import validators as v
from parcelforge.functions.text import contains_any, fold_accents
from parcelforge.operators.spatial import PAGE, clusters_1d
from parcelforge.session import counted_broadcast, cut_lineage

# ---------------------------------------------------------------- fixed values
#: The columns from left to right, with their default edges on a page 1280 wide; the address has no default place, the last one ends with the page.
COLUMNS = {
    "to_ban_do": (30.0, 125.0), "so_thua": (120.0, 210.0), "dia_chi": (None, None), "dien_tich_rieng": (205.0, 290.0), "dien_tich_chung": (285.0, 370.0), "muc_dich": (365.0, 510.0), "thoi_han": (505.0, 650.0),
    "nguon_goc": (645.0, 1280.0),
}
#: Accent-free words of a column's heading, in the order in which they are tried; a heading of areas alone stands for both, 25 to either side.
HEADINGS = (
    ("nguon_goc", ("nguon goc",)), ("thoi_han", ("thoi han",)), ("muc_dich", ("muc dich",)), ("dien_tich_rieng", ("rieng",)), ("dien_tich_chung", ("chung",)), ("dien_tich", ("dien tich",)), ("dia_chi", ("dia chi",)),
    ("so_thua", ("thua dat", "thua", "dat so")), ("to_ban_do", ("to ban do", "to ban", "do so", "to so")),
)
NO_HEADING = ("dia chi:", "thon ", "xa ", "huyen ", "tinh ", "ii.", "iii.", "1. thua")
PAGE_WIDTH, HEADING_BAND, NUMBER_BAND, BELOW_HEADINGS = 1280.0, (165.0, 350.0), (270.0, 850.0), 450.0
DEFAULT_TOP, DEFAULT_BOTTOM = 370.0, 850.0
FOOTERS = ("2 nha", "3 cong trinh", "4 rung", "5 cay", "tm uy ban", "chu tich")
MOST_ROWS = 200
#: Items of a single parcel's list, by their letter, and words of a table's headings.
OUTLINE = (("a", "thua dat"), ("b", "dia chi"), ("d", "muc dich"), ("e", "thoi han"))
SHEET_WORDS, PARCEL_WORDS = ("so thu tu", "stt", "to ban do", "to ban", "to\n"), ("thua dat", "thua\n", "thia", "thura")
#: Accent-free wording, name and code of a cell's land use where the purposes do not tell it.
CELL_USES = (
    (("hang nam",), "Đất bằng trồng cây hàng năm khác", "HNK"), (("lau nam",), "Đất trồng cây lâu năm khác", "CLN"), (("o tai nong thon",), "Đất ở tại nông thôn", "ONT"), (("o tai do thi",), "Đất ở tại đô thị", "ODT"),
    (("rung san xuat",), "Đất rừng sản xuất", "RSX"),
)
# ---------------------------------------------------------------- end of fixed values

AREA_NUMBER = r"(\d+[.,]\d+|(?<![\p{L}\d])\d{2,5}(?![\p{L}\d]))"
DATE = r"\d{1,2}/\d{1,2}/\d{4}"


def area_number(text: Column) -> Column:
    """The first decimal, or whole number of two to five digits, of a text without a date."""
    return F.when(~text.rlike(DATE), F.replace(F.regexp_extract(text, AREA_NUMBER, 1), F.lit(","), F.lit(".")).try_cast("double"))


def multi_parcel_pages(tokens: DataFrame) -> DataFrame:
    """doc_id, page_index, is_multi, total_parcels and total_area of each page.

    A page has a table of parcels if it states a total of 2 to 200, or if it
    has a table's headings and two different areas, whose number is then the
    total. The list of a single parcel is none, unless a total says otherwise.
    """
    parts = F.array_sort(F.collect_list(F.when(F.trim("text") != "", F.struct("ord", F.trim("text").alias("t")))))
    pages = tokens.groupBy(*PAGE).agg(F.transform(parts, lambda p: fold_accents(p["t"])).alias("lines"))
    stated = F.transform(F.filter("lines", lambda x: x.rlike("t[o0]ng")), _stated_total)
    text = F.array_join("lines", "\n")
    area = lambda lead: F.nullif(F.regexp_extract(F.col("text"), rf"{lead}dien\s*t\w{{1,5}}\s*[:.]?\s*(\d[\d.,]*)\s*m", 1), F.lit(""))
    # a second point of an area ends it
    first = F.regexp_extract(F.replace(F.coalesce(area(r"b[.)]?\s*"), area("")), F.lit(","), F.lit(".")), r"^(\d+(?:\.\d+)?)", 1).try_cast("double")
    out = pages.withColumns({"text": text, "stated": F.get(F.filter(stated, lambda n: n.isNotNull()), F.lit(0))})
    outline = F.lit(False)
    for letter, words in OUTLINE:
        outline = outline | F.col("text").rlike(rf"(?<![a-z]){letter}[.)]\s*{words}")
    total = F.when(F.col("stated").between(2, MOST_ROWS), F.col("stated"))
    headings = contains_any(F.concat("text", F.lit("\n")), SHEET_WORDS) & contains_any(F.concat("text", F.lit("\n")), PARCEL_WORDS) & F.col("text").contains("dien tich") & ~outline
    areas = F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![\p{L}\d])(\d{2,4}[.,]\d)(?![\p{L}\d])"), 1)))
    counted = headings & total.isNull() & (areas >= 2)
    return out.select(*PAGE, (total.isNotNull() | counted).alias("is_multi"), F.coalesce(total, F.when(counted, areas)).alias("total_parcels"), F.when(total.isNotNull() | ~outline, first).alias("total_area"))


def _stated_total(line: Column) -> Column:
    """The number after the word for a total: parcels are meant, or it is the list's item a."""
    rest = F.regexp_replace(F.regexp_extract(line, "t[o0]ng(.*)$", 1), r"^\s*s[o06](?![a-z])", " ")
    number = F.regexp_extract(rest, r"^\D{0,30}(\d{1,3})(?!\d)", 1)
    meant = F.regexp_extract(rest, r"^(\D*)", 1).rlike("th[uaeoir]") | line.rlike(r"(?<![a-z])a[.)]?\s*t[o0]ng")
    return F.when(meant, number.try_cast("int"))


def _placed(tokens: DataFrame) -> DataFrame:
    """Tokens with their middle and their page's width and scale."""
    width = F.greatest(F.lit(1000.0), F.max("x2").over(Window.partitionBy(*PAGE)) + 50)
    out = tokens.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2, "width": width, "folded": fold_accents(F.trim("text"))})
    return out.withColumn("scale", F.col("width") / PAGE_WIDTH)


def detect_columns(tokens: DataFrame) -> DataFrame:
    """One row per page: width, and ``<column>_from`` and ``<column>_to`` of each column, null for an address column that is not there.

    A column's middle is the median of its headings' middles. Without a heading
    for sheets or parcels, the first two clusters of short numbers left of the
    areas are these. Columns that are neighbours among those found meet half
    way; other edges are the defaults, by the page's width, and all are where
    fewer than three columns are found.
    """
    placed = _placed(tokens)
    band = F.col("y1").between(HEADING_BAND[0] * F.col("scale"), HEADING_BAND[1] * F.col("scale")) & ~contains_any(F.col("folded"), NO_HEADING)
    kind = F
    for name, words in HEADINGS:
        kind = kind.when(contains_any(F.col("folded"), words), name)
    heads = placed.where(band & (F.col("folded") != "")).withColumn("kind", kind).where("kind is not null and not (kind = 'dia_chi' and contains(folded, ':'))")
    at = lambda name, dx: F.struct(F.lit(name).alias("column"), (F.col("cx") + dx * F.col("scale")).alias("at"))
    both = F.array(at("dien_tich_rieng", -25), at("dien_tich_chung", 25))
    heads = heads.select(*PAGE, F.explode(F.when(F.col("kind") == "dien_tich", both).otherwise(F.array(F.struct(F.col("kind").alias("column"), F.col("cx").alias("at"))))).alias("h")).select(*PAGE, "h.*")
    middles = heads.groupBy(*PAGE).pivot("column", list(COLUMNS)).agg(F.percentile("at", F.lit(0.5)))
    pages = placed.select(*PAGE, "width", "scale").distinct().join(middles, list(PAGE), "left")
    area = F.coalesce("dien_tich_rieng", 250.0 * F.col("scale"))
    numbers = placed.drop("width", "scale").join(pages, list(PAGE)).where(F.col("y1").between(NUMBER_BAND[0] * F.col("scale"), NUMBER_BAND[1] * F.col("scale")) & (F.col("cx") < area - 10) & F.trim("text").rlike(r"^\d{1,4}[A-Za-z]?$"))
    clusters = clusters_1d(numbers.select(*PAGE, "cx"), PAGE, "cx").groupBy(*PAGE, "cluster").agg(F.percentile("cx", F.lit(0.5)).alias("at"))
    two = clusters.groupBy(*PAGE).agg(F.max(F.when(F.col("cluster") == 1, F.col("at"))).alias("first"), F.max(F.when(F.col("cluster") == 2, F.col("at"))).alias("second"))
    pages = pages.join(two, list(PAGE), "left")
    guess = (F.col("to_ban_do").isNull() | F.col("so_thua").isNull()) & F.col("second").isNotNull()
    pages = pages.withColumns({"to_ban_do": F.when(guess, F.col("first")).otherwise(F.col("to_ban_do")), "so_thua": F.when(guess, F.col("second")).otherwise(F.col("so_thua"))})
    enough = sum((F.col(c).isNotNull().cast("int") for c in COLUMNS), F.lit(0)) >= 3
    names, out = list(COLUMNS), []
    for i, c in enumerate(names):
        low, high = COLUMNS[c]
        before, after = F.coalesce(*[F.col(x) for x in reversed(names[:i])], F.lit(None)), F.coalesce(*[F.col(x) for x in names[i + 1 :]], F.lit(None))
        left = F.lit(None) if low is None else low * F.col("scale")
        right = F.lit(None) if high is None else F.col("width") if c == "nguon_goc" else high * F.col("scale")
        there = enough & F.col(c).isNotNull()
        out += [F.coalesce(F.when(there, (before + F.col(c)) / 2), left, F.when(there, F.lit(0.0))).cast("double").alias(f"{c}_from"), F.coalesce(F.when(there, (after + F.col(c)) / 2), right, F.when(there, F.col("width"))).cast("double").alias(f"{c}_to")]
    return pages.select(*PAGE, "width", "scale", *out)


def carry_sheets(rows: Column) -> Column:
    """An array of (sheet, parcel, glued), top to bottom, as (sheet, parcel): a glued number is split at a sheet that is known from above, a missing sheet is the first known one."""
    out = "array<struct<sheet: string, parcel: string>>"
    zero = F.struct(F.array().cast("array<string>").alias("known"), F.array().cast(out).alias("out"))

    def step(state: Column, r: Column) -> Column:
        known = state["known"]
        lead = F.get(F.filter(known, lambda k: F.startswith(r["glued"], k) & (F.length(r["glued"]) > F.length(k))), F.lit(0))
        split = lead.isNotNull()
        sheet = F.when(split, lead).otherwise(r["sheet"])
        parcel = F.when(split, F.substring(r["glued"], F.length(lead) + 1, F.length(r["glued"]))).otherwise(r["parcel"])
        grown = F.when(sheet.isNotNull() & ~F.array_contains(known, F.coalesce(sheet, F.lit(""))), F.array_append(known, sheet)).otherwise(known)
        return F.struct(grown.alias("known"), F.array_append(state["out"], F.struct(F.coalesce(sheet, F.get(grown, F.lit(0))).alias("sheet"), parcel.alias("parcel"))).alias("out"))

    return F.aggregate(rows, zero, step, lambda s: s["out"])


def extract_parcel_table(tokens: DataFrame) -> DataFrame:
    """The rows of parcel tables: doc_id, page_index, stt, so_thua, to_ban_do, dia_chi, dien_tich, muc_dich_su_dung, ma_muc_dich, thoi_han, nguon_goc, nguon_goc_ky_hieu, and the page's total_parcels and total_area.

    Only pages of several parcels have tables, and a table of which no row has
    a parcel number is none. An origin that is not a known one is blank.
    """
    from parcelforge.operators import page_tables as p

    pages = tokens.groupBy(*PAGE).agg(F.collect_list(F.struct(*[F.col(c) if c in ("ord", "text") else F.col(c).cast("double").alias(c) for c in p.TOKEN])).alias("tokens"))
    kinds = ", ".join(f"{c} {tokens.schema[c].dataType.simpleString()}" for c in PAGE)
    names = [*PAGE, "row", "sheet", "parcel", "dien_tich", "address", "purpose", "term", "origin", "total_parcels", "total_area"]
    out = cut_lineage(pages.mapInArrow(lambda batches: p.read_pages(batches, names), f"{kinds}, row int, sheet string, parcel string, dien_tich double, address string, purpose string, term string, origin string, total_parcels int, total_area double"))
    # a wording's use is worked out once for each wording
    uses = counted_broadcast(out.select("purpose").distinct()).withColumn("use", _cell_use(F.col("purpose")))
    out = out.join(uses, "purpose").withColumns({"until": v.v_term(F.col("term")), "from_": v.v_origin(F.col("origin"))})
    blank = lambda c: F.coalesce(c, F.lit(""))
    address = F.regexp_replace(F.regexp_replace("address", r",[\s,]*,", ", "), r"^[\s\-:;,.]+|[\s\-:;,.]+$", "")
    return out.select(
        *PAGE, F.col("row").alias("stt"), blank(F.col("parcel")).alias("so_thua"), blank(F.col("sheet")).alias("to_ban_do"), address.alias("dia_chi"), "dien_tich", blank(F.coalesce("use.name", "purpose")).alias("muc_dich_su_dung"), blank(F.col("use.code")).alias("ma_muc_dich"),
        F.when(F.col("until.ok"), F.col("until.value")).otherwise(F.col("term")).alias("thoi_han"), blank(F.col("from_.value")).alias("nguon_goc"), blank(F.col("from_.code")).alias("nguon_goc_ky_hieu"), "total_parcels", "total_area",
    )


def _cell_use(text: Column) -> Column:
    """name and code of a cell's land use, by the purposes, else by its words; rice is wet rice where the cell says so."""
    told, folded = v.v_purpose(text), fold_accents(text)
    of = lambda name, code: F.struct(name.alias("name"), F.lit(code).alias("code"))
    rice = F.when(folded.contains("chuyen"), "Đất chuyên trồng lúa nước").otherwise("Đất trồng lúa nước còn lại")
    out = F.when(told["ok"], F.struct(told["value"].alias("name"), told["code"].alias("code"))).when(folded.contains("lua") & folded.contains("nuoc"), of(rice, "LUC")).when(folded.contains("lua"), of(rice, "LUA"))
    for words, name, code in CELL_USES:
        out = out.when(contains_any(folded, words), of(F.lit(name), code))
    return out


def table_summary(rows: DataFrame) -> DataFrame:
    """One row per page of ``extract_parcel_table``: parcels and distinct map sheets joined by +, the first address, and the number of rows."""
    texts = lambda c: F.filter(F.transform(F.array_sort(F.collect_list(F.struct("stt", c))), lambda r: r[c]), lambda t: t != "")
    return rows.groupBy(*PAGE).agg(F.array_join(texts("so_thua"), "+").alias("so_thua"), F.array_join(F.array_distinct(texts("to_ban_do")), "+").alias("to_ban_do"), F.get(texts("dia_chi"), F.lit(0)).alias("dia_chi"), F.count("*").alias("n_rows"))


def parcels_from_text(text: Column) -> Column:
    """(so_thua, dien_tich) pairs of a text without geometry: the numbers between the table's heading and its footer, taken two by two, the smaller as parcel, the larger as area; a number of 2 digits and more that comes twice is the map sheet and left out."""
    between = F.regexp_extract(fold_accents(text), r"(?s)dien tich(.*?)(?:ghi chu|nguon goc|tong|$)", 1)
    numbers = F.transform(F.regexp_extract_all(between, F.lit(r"(?<![\d.,])(\d+(?:[.,]\d+)?)(?![\d.,])"), 1), v.to_number)

    def pairs(ns: Column) -> Column:
        repeated = F.filter(F.array_distinct(ns), lambda x: (x > 10) & (F.size(F.filter(ns, lambda y: y == x)) >= 2))
        kept = F.filter(ns, lambda x: ~F.array_contains(repeated, x))
        even = F.size(kept) - F.pmod(F.size(kept), F.lit(2))
        at = F.when(even > 1, F.sequence(F.lit(0), even - 2, F.lit(2)))
        return F.transform(at, lambda i: F.struct(F.least(F.get(kept, i), F.get(kept, i + 1)).alias("so_thua"), F.greatest(F.get(kept, i), F.get(kept, i + 1)).alias("dien_tich")))

    return v.let(numbers, pairs)


def registration_parcel(tokens: DataFrame) -> DataFrame:
    """doc_id, page_index, parcel, sheet and confidence of the registration table: the numbers below its two headings, left of the column of directive 299."""
    from parcelforge.operators.pages import is_registration_anchor

    anchor = tokens.where(is_registration_anchor(F.col("text"))).groupBy(*PAGE).agg(F.min_by(F.struct("x1", "x2", "y2"), F.struct("y1", "ord")).alias("a"))
    stop = tokens.where(F.col("text").contains("299")).groupBy(*PAGE).agg(F.min("x1").alias("stop"))
    area = anchor.join(stop, list(PAGE), "left")
    inside = tokens.join(area, list(PAGE)).where((F.col("y1") >= F.col("a.y2") - 5) & (F.col("x1") < F.coalesce("stop", F.lit(float("inf")))))
    numbers = inside.where(F.trim("text").rlike(r"^\d{1,4}[.,]?$"))
    head = fold_accents(F.col("text"))
    heads = inside.groupBy(*PAGE).agg(F.min(F.when(head.rlike("so thua|thua dat"), (F.col("x1") + F.col("x2")) / 2)).alias("px"), F.min(F.when(head.rlike("to ban do|so to"), (F.col("x1") + F.col("x2")) / 2)).alias("sx"))
    placed = numbers.join(heads, list(PAGE), "left").withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "n": F.regexp_replace(F.regexp_replace(F.trim("text"), r"[.,]$", ""), r"^0+(?=\d)", "")})
    nearest = lambda at: F.min_by(F.struct("n", "confidence"), F.when(F.col(at).isNotNull(), F.struct(F.abs(F.col("cx") - F.col(at)).alias("dx"), "y1", "ord")))
    order = F.transform(F.array_sort(F.collect_list(F.struct("cx", "ord", "n", "confidence"))), lambda x: F.struct(x["n"].alias("n"), x["confidence"].alias("confidence")))
    out = placed.groupBy(*PAGE).agg(nearest("px").alias("p"), nearest("sx").alias("s"), order.alias("all"))
    two = F.size("all") == 2
    p, s = F.coalesce("p", F.when(two, F.get("all", F.lit(0)))), F.coalesce("s", F.when(two, F.get("all", F.lit(1))))
    return out.select(*PAGE, p["n"].alias("parcel"), s["n"].alias("sheet"), F.least(p["confidence"], s["confidence"]).alias("confidence")).where("parcel is not null and sheet is not null")
