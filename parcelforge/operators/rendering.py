"""Markdown renderings of pages and documents, and reading them back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blocks_markdown(rows: DataFrame, document: str, title: Column, body: Column, order: Sequence[str]) -> DataFrame:
    """One text per document: its id as heading, then a titled block for each row, in order. A document's rows are gathered in one task; documents are some dozen pages."""
    blocks = F.array_sort(F.collect_list(F.struct(*order, F.concat(F.lit("## "), title, F.lit("\n"), F.coalesce(body, F.lit(""))).alias("_b"))))
    text = F.concat(F.lit("# "), F.col(document).cast("string"), F.lit("\n"), F.array_join(F.transform("_l", lambda r: r["_b"]), "\n"))
    return rows.groupBy(document).agg(blocks.alias("_l")).select(document, text.alias("markdown"))


def fields_markdown(document: Column, fields: Sequence[tuple[str, Column]], parcels: Column | None = None) -> Column:
    """Heading, a ``key : value`` line for each field that has a value, and the parcels as list lines."""
    lines = [F.concat(F.lit("# "), document.cast("string")), *[F.concat(F.lit(f"{k} : "), v) for k, v in fields]]
    if parcels is not None:
        lines.append(F.array_join(F.transform(parcels, lambda p: F.concat(F.lit("- "), F.concat_ws(" | ", p["so_thua"], p["to_ban_do"], p["dien_tich"], p["ma_muc_dich"]))), "\n"))
    return F.concat_ws("\n", *lines)


def parse_markdown(docs: DataFrame, text: str = "markdown") -> DataFrame:
    """``docs`` with ``heading``, ``fields`` (a map of the ``key : value`` lines, the first of a key counts) and ``parcels`` (list lines, kept if there are two rows and two distinct parcels)."""
    lines = F.split(F.col(text), "\n")
    pairs = F.filter(F.transform(lines, lambda x: F.regexp_extract(x, r"^([^:#\-][^:]*?)\s*:\s+.+$", 1)), lambda k: k != "")
    keys = F.array_distinct(pairs)
    value = lambda k: F.regexp_extract(F.element_at(F.filter(lines, lambda x: F.startswith(x, F.concat(k, F.lit(" :"))) | F.startswith(x, F.concat(k, F.lit(":")))), 1), r"^[^:]*:\s+(.+)$", 1)
    items = F.transform(F.filter(lines, lambda x: x.startswith("- ")), lambda x: F.split(F.substring(x, 3, 10_000), r"\s*\|\s*"))
    good = (F.size(items) >= 2) & (F.size(F.array_distinct(F.transform(items, lambda i: i[0]))) >= 2)
    parcel = F.transform(items, lambda i: F.struct(F.get(i, F.lit(0)).alias("so_thua"), F.get(i, F.lit(1)).alias("to_ban_do"), F.get(i, F.lit(2)).alias("dien_tich"), F.get(i, F.lit(3)).alias("ma_muc_dich")))
    heading = F.regexp_extract(F.col(text), r"^#\s*(.+?)\s*(?:\n|$)", 1)
    return docs.withColumns({"heading": heading, "fields": F.map_from_arrays(keys, F.transform(keys, value)), "parcels": F.when(good, parcel)})
