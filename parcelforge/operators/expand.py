"""Expansion of documents into registration rows: lists to rows, parcels, heirs, running numbers, de-duplication and quality checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelforge.functions.text import nullify_placeholder
from parcelforge.session import cut_lineage

#: The columns that tell registration rows of one document apart.
IDENTITY_COLUMNS = ("GCN_soPhatHanh", "GCN_soVaoSo", "CHU_hoTen", "GT_soGiayTo", "TD_soThuTuThua", "TD_soHieuToBanDo", "TD_dienTich", "TD_maMucDichSuDung")


def explode_rows(docs: DataFrame, rows: str, keep_empty: bool = False) -> DataFrame:
    """One row for each element of an array column, with ``pos`` from 0 and ``row``."""
    f = F.posexplode_outer if keep_empty else F.posexplode
    return docs.select(*[c for c in docs.columns if c != rows], f(rows).alias("pos", "row"))


def running_number(df: DataFrame, order: Sequence[str], name: str = "stt", start: int = 1) -> DataFrame:
    """Consecutive numbers in a total order without one task for all rows: rows are range-partitioned and sorted, partitions counted, and each gets its offset."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the low 33 bits of the id number a partition's rows
    # computed once: another run of the same plan may draw other range bounds
    marked = cut_lineage(parts.withColumn("_id", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_id", 33))
    counts = marked.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("_part", before.alias("_before")))  # a row for each partition
    number = F.col("_before") + F.col("_id").bitwiseAND((1 << 33) - 1) + start
    return marked.join(offsets, "_part").withColumn(name, number).drop("_id", "_part", "_before")


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], name: str = "stt", start: int = 1) -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)) + (start - 1))


def identity_key(columns: Sequence[str]) -> Column:
    return F.struct(*[F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(c) for c in columns])


def dedup_first(df: DataFrame, document: Sequence[str], identity: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each identity within a document, in the order."""
    w = Window.partitionBy(*document, identity_key(identity)).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def renumber_export(df: DataFrame, document: Sequence[str], order: Sequence[Column | str], start: int = 1) -> DataFrame:
    """STT from ``start`` within a document and the application code that follows it."""
    out = number_within(df, document, order, "STT", start)
    return out.withColumn("DDK_maDon", F.concat(F.lit("DON_"), F.col("STT").cast("string")))


def split_values(c: Column, pattern: str = r"[+,;/]") -> Column:
    """The non-empty parts of a joined value."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), lambda p: F.trim(p)), lambda p: p != "")


def aligned(values: Column, n: Column) -> Column:
    """``values`` for n rows: by place if there are as many, the one value for all if there is one, else blanks."""
    return F.when(F.size(values) == n, values).when(F.size(values) == 1, F.array_repeat(values[0], n)).otherwise(F.array_repeat(F.lit(""), n))


def expand_parcels(docs: DataFrame, parcels: str = "so_thua", others: Sequence[str] = ("to_ban_do", "ma_muc_dich", "thoi_han")) -> DataFrame:
    """A row for each parcel of a joined parcel number with two distinct ones and more, the other joined values dealt to them; other documents stay one row. ``parcel_no`` counts from 1."""
    numbers = split_values(F.col(parcels), r"\+")
    several = F.size(F.array_distinct(numbers)) >= 2
    keep = [c for c in docs.columns if c != parcels and c not in others]
    n = F.size(numbers)
    zipped = F.arrays_zip(numbers.alias(parcels), *[aligned(split_values(F.col(c), r"\+"), n).alias(c) for c in others])
    single = F.array(F.struct(F.col(parcels).cast("string").alias(parcels), *[F.col(c).cast("string").alias(c) for c in others]))
    rows = docs.withColumn("_rows", F.when(several, zipped).otherwise(single))
    return rows.select(*keep, F.posexplode("_rows").alias("_p", "_r")).select(*keep, (F.col("_p") + 1).alias("parcel_no"), *[F.col(f"_r.{c}").alias(c) for c in (parcels, *others)])


def collapse_parcels(rows: DataFrame, keys: Sequence[str], columns: Sequence[str], order: str, sep: str = "; ") -> DataFrame:
    """One row per certificate, its parcels' values joined in order."""
    lists = F.array_sort(F.collect_list(F.struct(order, *columns))).alias("_l")
    out = rows.groupBy(*keys).agg(lists)
    joined = lambda c: F.array_join(F.transform("_l", lambda r: r[c].cast("string")), sep).alias(c)
    return out.select(*keys, F.size("_l").alias("n_parcels"), *[joined(c) for c in columns])


def expand_heirs(rows: DataFrame, heirs: str = "dong_thua_ke", owner: str = "CHU_hoTen", companion: str = "VC_hoTen", order: Sequence[str] = ("stt",)) -> DataFrame:
    """A row for each heir of a row: the heir becomes the owner and the representative its companion, unless they are the same person; rows without heirs stay. Renumbered over all of a document's rows by ``heir_no``."""
    name = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    out = rows.select(*[c for c in rows.columns if c != heirs], F.posexplode_outer(heirs).alias("_pos", "_heir"))
    heir = F.col("_heir.ho_ten")
    other = heir.isNotNull() & (name(heir) != name(F.col(owner)))
    return out.withColumns({"_owner": F.coalesce(heir, F.col(owner)), companion: F.when(other, F.col(owner)).otherwise(F.col(companion)), "heir_no": F.coalesce("_pos", F.lit(0)) + 1}).drop(owner, "_pos", "_heir").withColumnRenamed("_owner", owner)


def area_quality(parts: DataFrame, whole: DataFrame, key: str, part: Column, total: Column, n_parts: str = "n_parts") -> DataFrame:
    """key, n_parts and ``reason``: whether the parts' areas sum to the whole's, within the larger of 0.5 and 1 %; ``missing`` if parts lack an area."""
    sums = parts.groupBy(key).agg(F.sum(part).alias("_sum"), F.count(part).alias("_known"), F.count("*").alias(n_parts))
    out = whole.join(sums, key, "left")
    apart = F.abs(F.coalesce("_sum", F.lit(0.0)) - total) > F.greatest(F.lit(0.5), 0.01 * total)
    reason = F.when(F.col(n_parts).isNull(), "no_parts").when(F.col("_known") < F.col(n_parts), "missing").when(apart, "mismatch").otherwise("ok")
    return out.select(key, F.coalesce(n_parts, F.lit(0)).alias(n_parts), reason.alias("reason"))


def row_count_quality(parts: DataFrame, whole: DataFrame, key: str, stated: Column) -> DataFrame:
    counts = parts.groupBy(key).agg(F.count("*").alias("n_rows"))
    return whole.join(counts, key, "left").select(key, F.coalesce("n_rows", F.lit(0)).alias("n_rows"), stated.alias("stated"), (F.coalesce("n_rows", F.lit(0)) == stated).alias("ok"))


def missing_core(columns: Sequence[str]) -> Column:
    """The names of the columns that are blank or placeholders."""
    return F.array_compact(F.array(*[F.when(nullify_placeholder(F.col(c)).isNull(), F.lit(c)) for c in columns]))


def parcel_reasons(number: Column, sheet: Column, area: Column, code: Column) -> Column:
    """Why a parcel needs review: missing_* and invalid_* in order; empty if it is accepted."""
    from parcelforge.functions import validators as v

    def of(name: str, c: Column, check) -> Column:
        blank = nullify_placeholder(c).isNull()
        return F.when(blank, F.lit(f"missing_{name}")).when(~check(c)["ok"], F.lit(f"invalid_{name}"))

    return F.array_compact(F.array(of("so_thua", number, v.v_parcel), of("to_ban_do", sheet, v.v_map_sheet), of("dien_tich", area, v.v_area), of("ma_muc_dich", code, v.v_land_code)))


def carry_forward(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], column: str) -> DataFrame:
    """Blanks take the last value before them, those at the beginning the first one after."""
    w = Window.partitionBy(*group).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    value = F.nullif(F.trim(column), F.lit(""))
    return df.withColumn(column, F.coalesce(F.last(value, ignorenulls=True).over(back), F.first(value, ignorenulls=True).over(ahead)))


def register_expand_parcels(spark) -> None:
    """``expand_parcels(numbers, sheets, codes, terms)`` as a table function of SQL: a row a parcel, other values dealt by place, one for all, or blank."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="parcel_no int, so_thua string, to_ban_do string, ma_muc_dich string, thoi_han string")
    class ExpandParcels:
        def eval(self, numbers: str, sheets: str, codes: str, terms: str):
            parts = lambda t: [p.strip() for p in (t or "").split("+") if p.strip()]
            own = parts(numbers)
            if len(set(own)) < 2:
                yield 1, numbers, sheets, codes, terms
                return
            dealt = [v if len(v) == len(own) else v * len(own) if len(v) == 1 else [""] * len(own) for v in map(parts, (sheets, codes, terms))]
            for i, (n, *rest) in enumerate(zip(own, *dealt, strict=True), 1):
                yield i, n, *rest

    spark.udtf.register("expand_parcels", ExpandParcels)
