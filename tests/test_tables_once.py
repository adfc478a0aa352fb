"""A page's tokens are read once, however many steps its table takes."""

from parcelforge.operators import tables

SCHEMA = "doc_id long, page_index int, ord int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
HEADS = [("Tổng số thửa đất: 2", 100, 120, 400), ("Tờ bản đồ", 40, 200, 110), ("Thửa đất số", 120, 200, 200), ("Riêng", 220, 240, 270), ("Mục đích sử dụng", 380, 200, 500), (None, 1200, 900, 1230), ("", 1200, 920, 1230)]
CELLS = [("7", 60, 360, 90), ("11", 140, 360, 165), ("100m² 12,5", 220, 360, 270), ("đất ở tại đô thị", 380, 360, 500), ("712", 140, 420, 165), ("7012", 60, 420, 90), ("20,5", 220, 420, 270)]


def test_every_token_is_read_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(d, 0, i, t, 0.9, float(a), float(y), float(b), y + 20.0) for d in range(40) for i, (t, a, y, b) in enumerate(HEADS + (CELLS if d % 2 else CELLS[:1]))]
    tokens = spark.createDataFrame(rows, SCHEMA).mapInArrow(counted, SCHEMA)
    got = tables.extract_parcel_table(tokens).collect()
    assert seen.value == len(rows)
    assert sorted((r.doc_id, r.stt, r.to_ban_do, r.so_thua, r.dien_tich, r.ma_muc_dich) for r in got) == [(d, *r) for d in range(1, 40, 2) for r in ((1, "7", "11", 12.5, "ODT"), (2, "7", "012", 20.5, ""))]
