"""Training reads whole texts, and filters try every byte."""

import numpy as np
import pyarrow as pa

from parcelforge.llm import quality as q
from parcelforge.llm.words import buffers


def test_training_takes_all_chunks(spark, make_docs, monkeypatch):
    taken = []
    monkeypatch.setattr(q.Network, "fit", lambda self, rows, labels: taken.extend(rows) or self)
    texts = ["short", "".join(f"word{i} " for i in range(3000)), "x" * 40000]
    marks = spark.createDataFrame([(i, i % 2, 0) for i in (1, 2, 4)], "doc_id long, quality int, toxic int")
    q.train(make_docs(list(zip((1, 2, 4), texts, strict=True))), marks)
    want = [q.chunks(*buffers(pa.array([t])))[0] for t in texts]
    assert [len(x) for x in taken] == [len(x) for x in want] and max(map(len, taken)) > 70
    assert all((a == b).all() for a, b in zip(taken, want, strict=True))


def test_filters_try_every_byte():
    net = q.Network(1)
    tables = net.tables()
    tables[:] = 0
    for j, c in enumerate(b"pattern!"):
        tables[j, c] = 1
    for shift in range(9):
        symbols = q.chunks(*buffers(pa.array(["." * shift + "pattern!" + "." * 30])))[0]
        assert (net.responses(symbols, tables).max(1) == 8).all(), shift
    assert net.responses(np.zeros((1, q.CHUNK), np.uint16), tables).shape[1] == q.CHUNK - q.WIDTH + 1
