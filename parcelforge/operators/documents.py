"""From recognised tokens to registration rows: pages, fields, one certificate a document, and the sheet.

``process_documents`` is the whole way; ``run_batch`` and ``run_pairs`` are it
with a batch's progress and with identity cards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelforge.functions.lines import parse_certification, parse_owner, parse_parcel, parse_transfer
from parcelforge.functions.parsers import parse_id_card
from parcelforge.functions.text import nullify_placeholder
from parcelforge.operators import certificate, changes, merge, registration, spatial, tables
from parcelforge.operators.pages import classify_template, is_diagram
from parcelforge.operators.store import progress
from parcelforge.session import cut_lineage

PAGE = ("doc_id", "page_index")
#: Fields that a diagram's page never gives.
NOT_ON_DIAGRAMS = ("ho_ten", "cmnd", "ngay_sinh", "dia_chi_thuong_tru", "so_phat_hanh", "so_thua", "to_ban_do", "dien_tich", "dien_tich_bang_chu", "muc_dich_su_dung", "hinh_thuc_su_dung", "thoi_han", "nguon_goc", "dia_chi")
PARSED = 0.95


def page_lines(tokens: DataFrame) -> DataFrame:
    """doc_id, page_index and ``lines``, the page's texts in reading order, blanks left out."""
    placed = spatial.reading_order(tokens)
    joined = placed.where(F.trim("text") != "").groupBy(*PAGE, "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return joined.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]).alias("lines"))


def label_table(config: DataFrame) -> DataFrame:
    """template, field, label and direction, one row a label, from rows of template, field, label, aliases (array) and direction, as a configuration of templates has them."""
    every = F.array_distinct(F.concat(F.array("label"), F.coalesce("aliases", F.array().cast("array<string>"))))
    return config.select("template", "field", F.explode(every).alias("label"), F.coalesce("direction", F.lit("auto")).alias("direction")).where(F.trim("label") != "")


def extract_all_fields(tokens: DataFrame, labels: DataFrame, templates: DataFrame) -> DataFrame:
    """The labelled fields of each page by its template: doc_id, page_index, field, value, confidence and the value's box. An unknown template is read as A; a diagram's page gives no field of persons and parcels."""
    known = templates.select(*PAGE, F.when(F.col("template") == "unknown", "mau_A").otherwise(F.col("template")).alias("template"))
    found = spatial.extract_fields(tokens.join(known, list(PAGE)), labels)
    diagrams = spatial.page_text(tokens).where(is_diagram(F.col("page_text"))).select(*PAGE, F.lit(True).alias("_diagram"))
    return found.join(diagrams, list(PAGE), "left").where(F.col("_diagram").isNull() | ~F.col("field").isin(*NOT_ON_DIAGRAMS)).drop("_diagram")


def _strings(parsed: Column, names: dict[str, str]) -> Column:
    """A map of a struct's fields under other names, without blanks."""
    entries = F.array(*[F.struct(F.lit(new).alias("key"), nullify_placeholder(parsed[old].cast("string")).alias("value")) for old, new in names.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def parser_precedence(found: Column, *parsed: Column) -> Column:
    """One map of fields: a parser's value before a label's, a later parser's before an earlier one's."""
    out = found
    for p in parsed:
        out = F.map_concat(_without(out, p), p)
    return out


def _without(m: Column, other: Column) -> Column:
    return F.map_filter(m, lambda k, _: ~F.array_contains(F.map_keys(other), k))


OWNER = {c: c for c in ("ho_ten_chu_1", "cmnd_chu_1", "ngay_sinh_chu_1", "ho_ten_chu_2", "cmnd_chu_2", "ngay_sinh_chu_2", "dia_chi_thuong_tru", "dia_chi_thuong_tru_chu_2", "loai_chu")}
PARCEL = {c: c for c in ("so_thua", "to_ban_do", "ty_le", "dia_chi", "dien_tich_cap", "dien_tich_bang_chu", "hinh_thuc_su_dung", "muc_dich_su_dung", "ma_muc_dich", "thoi_han", "nguon_goc")}
CERTIFICATION = {c: c for c in ("so_phat_hanh", "ma_vach", "so_vao_so", "noi_cap", "nguoi_ky_qd", "chuc_vu_nguoi_ky", "ngay_cap")}
TRANSFER = {"ben_nhan_1": "ten_chuyen_nhuong_moi", "ben_nhan_2": "ten_chuyen_nhuong_2", "cmnd_1": "cmnd_chuyen_nhuong", "cmnd_2": "cmnd_chuyen_nhuong_2", "dia_chi": "dia_chi_chuyen_nhuong", "so_ho_so": "so_ho_so_bien_dong", "ngay": "bien_dong_ngay"}


def page_results(tokens: DataFrame, labels: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """What ``certificate.merge_pages`` reads: each page's template, lines, fields, confidences, table rows and heirs. Parsed values come before labelled ones."""
    lines, templates = page_lines(tokens), classify_template(tokens)
    rows = cut_lineage(tables.extract_parcel_table(tokens))
    kept = F.struct("so_thua", "to_ban_do", "dia_chi", "dien_tich", "muc_dich_su_dung", "ma_muc_dich", "thoi_han", "nguon_goc", "nguon_goc_ky_hieu")
    listed = rows.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("stt", kept.alias("row")))), lambda r: r["row"]).cast(certificate.PARCEL).alias("parcels"), F.max("total_area").cast("string").alias("total_area"))
    joined = rows.groupBy(*PAGE).agg(F.count("*").alias("_n")).join(tables.table_summary(rows).select(*PAGE, F.col("so_thua").alias("t_parcel"), F.col("to_ban_do").alias("t_sheet")), list(PAGE)).drop("_n")
    mutated = (changes.extract_mutations(tokens) if found is None else found).groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(F.struct("stt", "content"))), lambda c: c["content"]).alias("contents"))
    pages = lines.join(templates, list(PAGE), "left").join(listed, list(PAGE), "left").join(joined, list(PAGE), "left").join(mutated, list(PAGE), "left")
    text = F.array_join("lines", " ")
    own = F.when(~is_diagram(text), parse_owner(F.col("lines")))
    pages = pages.withColumns({"owner": own, "parcel": F.when(~is_diagram(text), parse_parcel(F.col("lines"))), "issued": parse_certification(F.col("lines")), "moved": parse_transfer(F.coalesce("contents", F.array().cast("array<string>")))})
    table = F.struct(F.col("t_parcel").alias("so_thua"), F.col("t_sheet").alias("to_ban_do"), F.col("total_area").alias("dien_tich_cap"), F.array_join("contents", "\n").alias("thong_tin_bien_dong"))
    told = [_strings(F.col("owner"), OWNER), _strings(F.col("parcel"), PARCEL), _strings(table, {c: c for c in ("so_thua", "to_ban_do", "dien_tich_cap", "thong_tin_bien_dong")}), _strings(F.col("issued"), CERTIFICATION), _strings(F.col("moved"), TRANSFER)]
    blank = F.create_map().cast("map<string,string>")
    if labels is not None:
        read = extract_all_fields(tokens, labels, templates)
        entries = read.groupBy(*PAGE).agg(F.map_from_entries(F.collect_list(F.struct("field", "value"))).alias("labelled"), F.map_from_entries(F.collect_list(F.struct("field", "confidence"))).alias("sure"))
        pages = pages.join(entries, list(PAGE), "left")
    else:
        pages = pages.withColumns({"labelled": blank, "sure": F.create_map().cast("map<string,double>")})
    parsed = parser_precedence(blank, *told)
    sure = F.map_concat(_without(F.coalesce("sure", F.create_map().cast("map<string,double>")), F.col("_parsed")), F.transform_values("_parsed", lambda _, x: F.lit(PARSED)))
    return pages.withColumn("_parsed", parsed).select(
        *PAGE, F.coalesce("template", F.lit("unknown")).alias("template"), "lines", parser_precedence(F.coalesce("labelled", blank), F.col("_parsed")).alias("fields"), sure.alias("confidence"),
        F.coalesce("parcels", F.array().cast(certificate.PARCEL)).alias("parcels"), F.coalesce("owner.dong_thua_ke", F.array().cast(certificate.HEIRS)).alias("heirs"),
    )


def certificates(tokens: DataFrame, labels: DataFrame | None = None, answers: DataFrame | None = None) -> DataFrame:
    """One flat row per document: the merged fields after later changes, as ``registration.registration_rows`` reads them."""
    # what the parsers read is computed once
    found = cut_lineage(changes.extract_mutations(tokens))
    pages = cut_lineage(page_results(tokens, labels, found))
    merged = cut_lineage(certificate.merge_pages(pages, certificate.best_serials(certificate.serial_candidates(tokens))))
    return certificate.apply_mutations(certificate.flat_values(merged), found, answers)


def process_documents(tokens: DataFrame, files: DataFrame | None = None, labels: DataFrame | None = None) -> DataFrame:
    """Registration rows of the documents in ``tokens`` (doc_id, page_index, ord, text, confidence, x1, y1, x2, y2).

    ``files`` may give doc_id and source_path. Documents without any text have
    no rows; an empty table gives none.
    """
    docs = certificates(tokens, labels)
    if files is not None:
        docs = docs.join(files.select("doc_id", "source_path"), "doc_id", "left")
    return registration.registration_rows(docs)


def run_batch(tokens: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The registration rows of a batch's files (batch_id, doc_id, source_path), and a row of progress for each batch: a file without text is an error."""
    rows = process_documents(tokens, files)
    done = tokens.where(F.trim("text") != "").select("doc_id").distinct().withColumn("status", F.lit("success"))
    status = files.join(done, "doc_id", "left").select("batch_id", "doc_id", F.coalesce("status", F.lit("error")).alias("status"))
    return rows, progress(status, "batch_id", F.col("status"), ["success"], ["error"])


def batch_rows(batches: DataFrame, rows: DataFrame, batch: str, start: int = 1) -> DataFrame:
    """The rows of one batch's documents, each document's own repeats left out, numbered through."""
    from parcelforge.operators import expand

    own = rows.join(batches.where(F.col("batch_id") == batch).select("doc_id"), "doc_id", "left_semi").withColumnRenamed("STT", "_stt")
    first = expand.dedup_first(own, ["doc_id"], expand.IDENTITY_COLUMNS, ["_stt"])
    return expand.running_number(first, ["doc_id", "_stt"], "STT", start).withColumn("DDK_maDon", F.concat(F.lit("DON_"), F.col("STT").cast("string"))).drop("_stt")


def run_pairs(certificate_tokens: DataFrame, card_tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Certificates enriched from identity cards of the same doc_id, and the counts of pairs by status (both, gcn_only, gt_only)."""
    docs = certificates(certificate_tokens)
    lines = page_lines(card_tokens).groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "lines"))), lambda p: p["lines"])).alias("lines"))
    cards = lines.select("doc_id", parse_id_card(F.col("lines")).alias("c")).select("doc_id", "c.*")
    both = certificate_tokens.select("doc_id").distinct().withColumn("a", F.lit(1)).join(card_tokens.select("doc_id").distinct().withColumn("b", F.lit(1)), "doc_id", "full_outer")
    status = F.when(F.col("b").isNull(), "gcn_only").when(F.col("a").isNull(), "gt_only").otherwise("both")
    return merge.enrich_owner_from_card(docs, cards), merge.pair_status_counts(both.select(status.alias("status")))
