"""Fields and documents that have nothing to take."""

from parcelforge.operators import certificate, merge
from pyspark.sql import functions as F


def test_a_field_of_placeholders_only_has_no_row(spark):
    rows = [(1, "a", 1, "-"), (1, "a", 2, "x"), (1, "b", 3, "0"), (1, "b", 4, None), (2, "a", 5, " none "), (2, "b", 6, "y"), (2, "b", 7, "z")]
    values = spark.createDataFrame(rows, "doc long, field string, at long, value string")
    got = merge.first_non_empty(values, ["doc"], "field", "value", [-F.col("at")])
    assert sorted(map(tuple, got.collect())) == [(1, "a", 2, "x"), (2, "b", 7, "z")]


def test_digits_behind_a_names_letters_are_no_year_and_no_number(spark):
    """A year or number is a word of the name; ``A1900`` and ``A012345678`` are names."""
    names = {"a": "Ông Nguyễn Văn A1900", "b": "Ông Nguyễn Văn An 1954", "c": "Ông Lê Tư, sinh năm 1961, CMND 012345678", "d": "Ông Lê Tư A012345678"}
    pages = f"doc_id string, page_index int, template string, lines array<string>, fields map<string,string>, confidence map<string,double>, parcels {certificate.PARCEL}, heirs {certificate.HEIRS}"
    rows = [(k, 0, "mau_B", ["Người sử dụng đất"], {"ho_ten_chu_1": n, "cmnd_chu_1": "số 1"}, {}, [], []) for k, n in names.items()]
    got = {r.doc_id: (r.nam_sinh_chu_1.value, r.cccd_chu_1.value) for r in certificate.merge_pages(spark.createDataFrame(rows, pages)).collect()}
    assert got == {"a": (None, None), "b": ("1954", None), "c": ("1961", "012345678"), "d": (None, None)}
