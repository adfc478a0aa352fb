import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from parcelforge.llm import quality as q
from parcelforge.llm.words import buffers


def test_chunks_cover_whole_texts():
    texts = ["", "ab", "x" * q.CHUNK, "y" * (q.CHUNK + 1), bytes(range(32, 127)).decode() * 40, None]
    data, offsets = buffers(pa.array(texts))
    symbols, first = q.chunks(data, offsets)
    for i, t in enumerate(texts):
        own = symbols[first[i] : first[i + 1]]
        assert len(own) >= 1
        back = np.concatenate([c if k == len(own) - 1 else c[: q.CHUNK - q.OVERLAP] for k, c in enumerate(own)])
        assert bytes((back[back != q.PADDING] % 256).astype(np.uint8)) == (t or "").encode()


def test_repeats_are_marked():
    marks = q.repeats(np.frombuffer(b"one two three four five" + b" again" * 6, np.uint8))
    assert not marks[:20].any() and marks[-10:].all()


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = q.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    symbols, first = rng.integers(0, q.SYMBOLS, (5, q.CHUNK)).astype(np.uint16), np.array([0, 2, 3, 5])
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        f = lambda: net.combine(np.tanh(np.concatenate([net.responses(symbols, np.einsum("sd,wdf->wsf", net.p["E"], net.p["W"])).max(1)]) + net.p["b"]), first)
        p = f()
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    g = net.gradients(symbols, first, labels)
    for name in ("u", "c", "b", "W", "E"):
        flat = np.argsort(-np.abs(g[name]).ravel())[:3]
        for i in flat:
            at = np.unravel_index(i, net.p[name].shape)
            keep, e = net.p[name][at], 1e-5
            net.p[name][at] = keep + e
            up = loss()
            net.p[name][at] = keep - e
            down = loss()
            net.p[name][at] = keep
            assert abs((up - down) / (2 * e) - g[name][at]) < 2e-3 * max(1, abs(g[name][at])), name


def test_held_out_rule(spark):
    got = spark.range(200).select("id", q.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in got)


def corpus(rng, n=160):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        w = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(20, 200))]
        rows.append((i, " ".join(w) + "." if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_learns_and_scores_unseen_rows(spark, make_docs, rng):
    rows, labels = corpus(rng)
    odd = [(900, None), (901, ""), (902, "x"), (None, "plain words here"), (903, "w " * 60000), (0, rows[0][1])]
    docs = make_docs(rows + odd)
    marks = spark.createDataFrame([*labels, (0, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = q.quality(docs, marks).collect()
    assert len(got) == len(rows) + len(odd)
    want = {i: y for i, y, _ in labels}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 20 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert len({r.score for r in got if r.doc_id in (900, 901)}) == 1


def test_labels_of_held_out_rows_are_not_used(spark, make_docs, rng):
    rows, labels = corpus(rng, 80)
    docs = make_docs(rows)
    score = lambda marks: sorted((r.doc_id, r.score) for r in q.quality(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect())
    turned = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y, t) for i, y, t in labels]
    assert score(labels) == score(turned)


def test_stage_and_no_labels(spark, make_docs, rng):
    rows, labels = corpus(rng, 80)
    docs = make_docs(rows)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = q.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in q.quality(docs, marks).where("predicted = 1").collect()}
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in q.quality(docs, none).collect()} == {0.5}
    assert q.quality(make_docs([]), marks).count() == 0
