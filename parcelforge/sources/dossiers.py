"""Files as tables: directories, scanned dossiers and pairs of certificate and identity papers. Only names and metadata are read; contents come through ``binaryFile`` where an operator asks for them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelforge.functions.text import derive_folder, file_stem, fold_accents

PATTERN = "*.{pdf,PDF,png,PNG,jpg,JPG,jpeg,JPEG}"


def scan_directory(spark: SparkSession, path: str, pattern: str = PATTERN, contents: bool = False) -> DataFrame:
    """path, modificationTime, length (and content): the files below a directory. ``number_files`` orders them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return (files if contents else files.drop("content")).dropDuplicates(["path"])


def number_files(files: DataFrame, start: int = 0, count: int | None = None) -> DataFrame:
    """Files in the order of their lower-case paths, from the ``start``-th on, ``count`` of them at most."""
    out = files.orderBy(F.lower("path"), "path").offset(start)
    return out.limit(count) if count else out


def select_dossier_files(files: DataFrame) -> DataFrame:
    """folder, path and how it was chosen: of each folder the file whose name says cover (b, bia), certificate (gcn) or g, in this order; else the first PDF whose first two pages are landscape (``landscape``); else none (``skipped``)."""
    words = F.split(fold_accents(file_stem(F.col("path"))), r"[^a-z0-9]+")
    has = lambda *w: F.arrays_overlap(words, F.array(*[F.lit(x) for x in w]))
    rank = F.when(has("b", "bia"), 0).when(has("gcn"), 1).when(has("g"), 2)
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    pdf = F.lower("path").endswith(".pdf") & F.coalesce("landscape", F.lit(False)) if "landscape" in files.columns else F.lit(False)
    by_folder = files.withColumn("folder", derive_folder(F.col("path"))).groupBy("folder")
    out = by_folder.agg(F.min_by("path", F.when(rank.isNotNull(), F.struct(rank.alias("r"), name.alias("n")))).alias("named"), F.min_by("path", F.when(pdf, name)).alias("wide"), F.count("*").alias("files"))
    how = F.when(F.col("named").isNotNull(), "name").when(F.col("wide").isNotNull(), "landscape").otherwise("skipped")
    return out.select("folder", F.coalesce("named", "wide").alias("path"), how.alias("how"), "files")


def path_hints(path: Column) -> Column:
    """sheet, parcel and owner that a path tells: the first part that names a sheet, the last that names a parcel, and the part after that."""
    parts = F.split(path, "/")
    folded = F.transform(parts, fold_accents)
    sheet = r"^(?:to|tbd|to ban do)[ _\-]*(?:so)?[ _\-]*(\d+)"
    parcel = r"(?:^|[ _\-])(?:thua)[ _\-]*(?:so)?[ _\-]*(\d+)"
    sheets = F.filter(F.transform(folded, lambda p: F.regexp_extract(p, sheet, 1)), lambda x: x != "")
    at = F.transform(folded, lambda p, i: F.when(p.rlike(parcel), i))
    last = F.array_max(at)
    owner = F.get(parts, last + 1)
    return F.struct(F.get(sheets, F.lit(0)).alias("sheet"), F.regexp_extract(F.get(folded, last), parcel, 1).alias("parcel"), F.when(~owner.contains("."), owner).alias("owner"))


def pair_status(certificates: DataFrame, identities: DataFrame, key: str) -> DataFrame:
    """key and status of a full outer join: both, gcn_only or gt_only."""
    a = certificates.select(key).distinct().withColumn("_a", F.lit(True))
    b = identities.select(key).distinct().withColumn("_b", F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.when(F.col("_a").isNull(), "gt_only").when(F.col("_b").isNull(), "gcn_only").otherwise("both").alias("status"))


def scan_pairs(files: DataFrame) -> DataFrame:
    """pair_id, gcn_path, gt_path and status of files named <id>-GCN and <id>-GT; another file is a certificate of its own if no pair has its name."""
    stem = file_stem(F.col("path"))
    shape = r"(?i)^(.*?)[\-_ ]+(GCN|GT)$"
    kind = F.upper(F.regexp_extract(stem, shape, 2))
    rows = files.select(F.when(kind != "", F.trim(F.regexp_extract(stem, shape, 1))).otherwise(stem).alias("pair_id"), F.when(kind == "", "ONE").otherwise(kind).alias("kind"), "path")
    at = lambda k: F.min(F.when(F.col("kind") == k, F.col("path")))
    out = rows.groupBy("pair_id").agg(F.coalesce(at("GCN"), F.when(at("GT").isNull(), at("ONE"))).alias("gcn_path"), at("GT").alias("gt_path"))
    return out.withColumn("status", F.when(F.col("gt_path").isNull(), "gcn_only").when(F.col("gcn_path").isNull(), "gt_only").otherwise("both"))


def unique_destinations(names: DataFrame, folder: str, name: str, order: Column) -> DataFrame:
    """``destination``: the name, with __2, __3 and so on for the second and later files of a folder that have it, in any case, in ``order``. A number that makes another file's own name is passed over, so no two files of a folder get one name."""
    from pyspark.sql import Window

    base, ending = F.regexp_replace(F.col(name), r"(\.[^.]*)?$", ""), F.regexp_extract(F.col(name), r"(\.[^.]*)$", 1)
    own = names.select(F.col(folder).alias("_f"), F.lower(base).alias("_b"), F.lower(ending).alias("_e")).distinct()
    # names that look made, by the name that they would be made of
    shape = r"^(.*)__([2-9]|[1-9]\d+)$"
    looks = own.where(F.col("_b").rlike(shape)).groupBy("_f", F.concat(F.regexp_extract("_b", shape, 1), F.col("_e")).alias("_n")).agg(F.sort_array(F.collect_set(F.regexp_extract("_b", shape, 2).cast("long"))).alias("_taken"))
    nth = F.row_number().over(Window.partitionBy(folder, F.lower(name)).orderBy(order))
    out = names.withColumns({"_k": nth, "_low": F.lower(name)})
    out = out.join(looks, out[folder].eqNullSafe(looks["_f"]) & (out["_low"] == looks["_n"]), "left").drop("_f", "_n", "_low")
    free = F.aggregate(F.coalesce("_taken", F.array().cast("array<bigint>")), F.col("_k").cast("long"), lambda f, t: F.when(t <= f, f + 1).otherwise(f))
    made = F.concat(base, F.lit("__"), free.cast("string"), ending)
    return out.withColumn("destination", F.when(F.col("_k") == 1, F.col(name)).otherwise(made)).drop("_k", "_taken")


#: Endings of files that hold pages.
IMAGES, PAGED = ("png", "jpg", "jpeg", "bmp", "tif", "tiff", "webp"), ("pdf",)


def load_pages(spark: SparkSession, path: str, render, schema: str, max_pages: int | None = None) -> DataFrame:
    """The pages of the files below ``path``: doc_id (the path), page_index, the columns of ``schema`` and ``error``.

    ``render`` is the caller's decoder, a function of a file's bytes and ending
    that gives a tuple for each page. An ending that is not known, and a file
    that cannot be decoded, give one row with the error and no page.
    """
    import pandas as pd

    names = [f.split()[0] for f in schema.split(",")]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def decoded(batches):
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                ending = name.rsplit(".", 1)[-1].lower()
                if ending not in (*IMAGES, *PAGED):
                    rows.append((name, None, *[None] * len(names), f"unsupported file type: {ending}"))
                    continue
                try:
                    pages = list(render(bytes(content), ending))
                except Exception as e:  # the caller's decoder decides what it raises
                    rows.append((name, None, *[None] * len(names), f"{type(e).__name__}: {e}"))
                    continue
                rows += [(name, i, *p, None) for i, p in enumerate(pages[:max_pages])]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", *names, "error"])

    return files.mapInPandas(decoded, f"doc_id string, page_index int, {schema}, error string")
