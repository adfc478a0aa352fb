import random

import pytest
from pyspark.sql import functions as F

from parcelforge.functions import fuzzy, text


def one(spark, c):
    return spark.range(1).select(c.alias("r")).first().r


def test_fold_and_clean(spark):
    assert one(spark, text.fold_accents(F.lit("Đường Nguyễn Huệ, ẤP"))) == "duong nguyen hue, ap"
    assert one(spark, text.comparable_text(F.lit("Thửa đất: 12/3"))) == "thuadat123"
    assert one(spark, text.clean_text(F.lit("  a \n\t b  "))) == "a b"
    assert one(spark, text.nullify_placeholder(F.lit(" Không rõ "))) is None
    assert one(spark, text.normalise_nfc(F.lit("Nguyễn"))) == "Nguyễn"
    assert one(spark, text.strip_admin_prefix(F.lit("Tỉnh Lạng Sơn"))) == "Lạng Sơn"
    assert one(spark, text.strip_serial_tail(F.lit("thôn A, xã B, BP 425774"))) == "thôn A, xã B"
    assert one(spark, text.derive_folder(F.lit("/a/b/c.pdf"))) == "/a/b" and one(spark, text.file_stem(F.lit("/a/b/c.x.pdf"))) == "c.x"
    assert one(spark, text.clean_person_name(F.lit("Hộ ông: NGUYỄN VĂN A, sinh năm 1950"))) == "Nguyễn Văn A"
    assert one(spark, text.detect_gender(F.lit("Bà: Trần Thị B"))) == 0
    assert one(spark, text.distinct_joined(F.split(F.lit("b,a,b"), ","))) == "b+a"


@pytest.mark.parametrize(("a", "b", "want"), [("Số 12", "số 12", 1.0), ("CH 00123", "00123 -", 0.98), ("0123456", "345", 0.82), ("abcd", "abcdefgh", 0.6 + 0.35 * 0.5), ("ab", "abc", 0.0), ("", "x", 0.0)])
def test_token_match_score(spark, a, b, want):
    assert one(spark, text.token_match_score(F.lit(a), F.lit(b))) == pytest.approx(want)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def test_lcs_matches_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(0, 20))) for _ in range(2))
        assert fuzzy.lcs_length(a, b) == lcs(a, b)


def test_ratios(spark):
    assert fuzzy.indel("lang sm", "lang son") == pytest.approx(80.0)
    assert fuzzy.best_window("so vao so", "abc so vao so cap") == 100.0
    assert fuzzy.sorted_words("b a", "a b") == 100.0 and fuzzy.word_sets("a b", "b a c") == 100.0
    assert one(spark, fuzzy.ratio(F.lit("abc"), F.lit(None).cast("string"))) == 0.0


def test_numbers_and_words(spark):
    for n, words in ((0, "không"), (15, "mười lăm"), (21, "hai mươi mốt"), (105, "một trăm lẻ năm"), (1015, "một nghìn không trăm mười lăm"), (125.5, "một trăm hai mươi lăm phẩy năm"), (2_000_003, "hai triệu không trăm lẻ ba")):
        assert fuzzy.spell(n) == words
    assert fuzzy.spell(-1) is None and fuzzy.spell(1e9) is None
    for n in (0, 7, 10, 14, 21, 55, 101, 115, 999, 1000, 1015, 20_300, 1_234_567, 12.5, 150.25):
        assert fuzzy.read_number(fuzzy.spell(n)) == pytest.approx(n)
    assert one(spark, fuzzy.area_words_agree(F.lit(150.5), F.lit("Một trăm năm mươi phẩy năm mét vuông"))) in (True, False)
    assert fuzzy.read_number("xin chào") is None


def test_fuzzy_best(spark):
    left = spark.createDataFrame([(1, "Lang Sm"), (2, "Xyz")], "id int, name string")
    right = spark.createDataFrame([("lang son",), ("lao cai",)], "place string")
    got = {r.id: (r.match, r.score) for r in fuzzy.fuzzy_best(left, right, "name", "place", cutoff=80).collect()}
    assert got == {1: ("lang son", pytest.approx(80.0)), 2: (None, None)}


def test_sql_names(spark):
    fuzzy.register_all(spark)
    r = spark.sql("SELECT fuzz_ratio('ab', 'ab') AS a, number_to_words_vi(15D) AS b, words_to_number_vi('mười lăm') AS c").first()
    assert tuple(r) == (100.0, "mười lăm", 15.0)
