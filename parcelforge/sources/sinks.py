"""Outputs: the registration sheet, flat exports, Markdown files and manifests, as Spark writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.text import sanitise_name
from parcelforge.operators.registration import COLUMNS, with_alerts


def write_registration(rows: DataFrame, path: str, kind: str = "parquet") -> None:
    """The layout's columns in order with the alert level; as csv with a header, quoted."""
    out = with_alerts(rows).select(*COLUMNS, "alert_level")
    writer = out.write.mode("overwrite")
    writer.option("header", "true").csv(path) if kind == "csv" else writer.format(kind).save(path)


def write_flat(df: DataFrame, path: str, columns: Sequence[str] | None = None, kinds: Sequence[str] = ("json", "csv")) -> None:
    """A flat projection as JSON lines and as CSV with a byte order mark before the header's first name."""
    out = df.select(*columns) if columns else df
    if "json" in kinds:
        out.write.mode("overwrite").json(f"{path}/json")
    if "csv" in kinds:
        marked = out.toDF(*["﻿" + c if i == 0 else c for i, c in enumerate(out.columns)])
        marked.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")


def markdown_names(docs: DataFrame, number: str, name: str, key: str) -> DataFrame:
    """``file_name``: number, the first 50 characters of the clean name, and the first 8 of the key."""
    return docs.withColumn("file_name", F.concat_ws("_", F.lpad(F.col(number).cast("string"), 3, "0"), F.substring(sanitise_name(F.col(name)), 1, 50), F.concat(F.substring(F.col(key), 1, 8), F.lit(".md"))))


def write_markdown(docs: DataFrame, path: str, text: str = "markdown", name: str = "file_name") -> None:
    """One directory per document under its name, its text in a file."""
    docs.select(F.col(text).alias("value"), F.col(name).alias("document")).write.mode("overwrite").partitionBy("document").text(path)


def write_results(docs: DataFrame, path: str) -> None:
    """One JSON line per document, compact, in the order of ids within a file."""
    docs.sortWithinPartitions("doc_id").write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_results(spark, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path).withColumn("file_name", F.col("_metadata.file_name"))


def sheets_preview(summary: DataFrame, lines: DataFrame, rows: DataFrame, key: str, most: int = 200) -> DataFrame:
    """key and a JSON text of three sheets: summary, the first recognised lines, the first registration rows."""
    from pyspark.sql import Window

    def packed(df: DataFrame, name: str) -> DataFrame:
        cols = [c for c in df.columns if c != key]
        first = df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*cols[:3]))).where(F.col("_n") <= most)
        return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", F.struct(*cols).alias("r")))), lambda x: x["r"]).alias(name))

    out = packed(summary, "summary").join(packed(lines, "lines"), key, "left").join(packed(rows, "rows"), key, "left")
    return out.select(key, F.to_json(F.struct("summary", "lines", "rows")).alias("preview"))


def rename_manifest(files: DataFrame) -> DataFrame:
    """path and destination of files named after their parcel: <sheet>-<parcel> with the old ending, unique in their folder; files without both keep their name."""
    from parcelforge.functions.text import derive_folder
    from parcelforge.sources.dossiers import unique_destinations

    name = F.element_at(F.split("path", "/"), -1)
    made = F.when((F.col("sheet") != "") & (F.col("parcel") != ""), F.concat(F.concat_ws("-", "sheet", "parcel"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)))).otherwise(name)
    return unique_destinations(files.withColumns({"folder": derive_folder(F.col("path")), "name": made}), "folder", "name", F.col("path")).select("path", "folder", "destination")


def _column(i: int) -> str:
    """A sheet's column letters: A, B, ..., Z, AA."""
    out = ""
    while i >= 0:
        out, i = chr(65 + i % 26) + out, i // 26 - 1
    return out


#: Rows of a workbook at most, as many as a sheet has.
SHEET_ROWS = 1_048_575


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook (xlsx) with one sheet for each table, a header and texts, written row by row on the driver. It is an export for people: a table of more rows than a sheet has is an error, and goes out as parquet or csv."""
    import zipfile
    from xml.sax.saxutils import escape

    xml = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    cell = lambda i, row, v: f'<c r="{_column(i)}{row}" t="inlineStr"><is><t xml:space="preserve">{escape("" if v is None else str(v))}</t></is></c>'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for k, df in enumerate(sheets.values(), 1):
            if df.count() > SHEET_ROWS:
                raise ValueError("a sheet has no room for so many rows")
            with out.open(f"xl/worksheets/sheet{k}.xml", "w") as f:
                put = lambda text: f.write(text.encode())  # noqa: E731, B023
                put(f'{xml}<worksheet xmlns="{main}"><sheetData><row r="1">' + "".join(cell(i, 1, c) for i, c in enumerate(df.columns)) + "</row>")
                for n, row in enumerate(df.toLocalIterator(), 2):
                    put(f'<row r="{n}">' + "".join(cell(i, n, v) for i, v in enumerate(row)) + "</row>")
                put("</sheetData></worksheet>")
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{k}" r:id="rId{k}"/>' for k, n in enumerate(sheets, 1))
        out.writestr("xl/workbook.xml", f'{xml}<workbook xmlns="{main}" xmlns:r="{links}"><sheets>{names}</sheets></workbook>')
        rels = "".join(f'<Relationship Id="rId{k}" Type="{links}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, len(sheets) + 1))
        out.writestr("xl/_rels/workbook.xml.rels", f'{xml}<Relationships xmlns="{package}/relationships">{rels}</Relationships>')
        out.writestr("_rels/.rels", f'{xml}<Relationships xmlns="{package}/relationships"><Relationship Id="rId1" Type="{links}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for k in range(1, len(sheets) + 1))
        out.writestr("[Content_Types].xml", f'{xml}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{kinds}</Types>')


def write_archive(files: DataFrame, path: str, name: str = "file_name", content: str = "content") -> None:
    """A zip of the rows' contents (texts or bytes) under their names, in the order of names, one row on the driver at a time; of equal names the first is kept."""
    import zipfile

    seen = set()
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for row in files.select(name, content).orderBy(name).toLocalIterator():
            if row[0] not in seen:
                seen.add(row[0])
                out.writestr(row[0], row[1] if isinstance(row[1], str) else bytes(row[1] or b""))


def write_artifacts(crops: DataFrame, path: str) -> None:
    """Previews and crops (doc_id, kind, name, content and any metadata) as a table that is partitioned by kind; ``read_artifacts`` finds a document's."""
    crops.write.mode("append").partitionBy("kind").parquet(path)


def read_artifacts(spark, path: str, doc_id: str, kind: str | None = None) -> DataFrame:
    out = spark.read.parquet(path).where(F.col("doc_id") == doc_id)
    return out.where(F.col("kind") == kind) if kind else out
