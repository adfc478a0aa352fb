import math
import random

from parcelforge.llm import top_k


def brute(rows, k, every):
    vs = [(i, [math.floor(64.0 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in vs:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in vs if i != q and len(a) == len(b))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def test_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(6)]) for i in range(240)] + [(300 + i, [rng.choice((0.0, 0.5, -0.5)) for _ in range(6)]) for i in range(120)]
    rows += [(500, None), (520, []), (540, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (560, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (580, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (600, [0.0] * 6), (620, [1e6, -1e6, 1.0, 1.0, 1.0, 1.0]), (640, [1.0, 2.0]), (641, [2.0, 1.0]), (None, [0.1] * 6)]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, id string, v int")
    got = sorted(tuple(r) for r in top_k.embedding_neighbours(frame, k=7, every=20).select("query_id", "rank", "vec_id", "score").collect())
    assert got == brute(rows, 7, 20)


def test_shards_and_blocks_do_not_matter(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-3, 4) for _ in range(4)]) for i in range(150)]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    run = lambda **o: sorted(map(tuple, top_k.exact_top_k(frame, frame.where("id % 7 = 0"), 5, **o).collect()))
    whole = run()
    monkeypatch.setattr(top_k, "TOGETHER", 3)
    assert run(shard_rows=13, query_block=4) == run(shard_rows=1) == whole


def test_sums_beyond_64_bits(spark):
    rng = random.Random(5)
    rows = [(i, [rng.randrange(-(2**56), 2**56) for _ in range(5)]) for i in range(120)] + [(200 + i, [rng.randrange(-3, 4) for _ in range(5)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "id long, v array<long>")
    want, clip = [], lambda s: min(max(s, -(2**63)), 2**63 - 1)
    for q, a in rows:
        if q % 7 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in rows if i != q)[:6]
            want += [(q, n, i, clip(-s)) for n, (s, i) in enumerate(best, 1)]
    for shard in (8192, 11):
        assert sorted(map(tuple, top_k.exact_top_k(frame, frame.where("id % 7 = 0"), 6, shard_rows=shard).collect())) == sorted(want)


def test_repeated_rows_count_as_often(spark):
    frame = spark.createDataFrame([(i, [1, 2]) for i in (1, 2, 2, 3)], "id long, v array<long>")
    got = [tuple(r) for r in top_k.exact_top_k(frame, frame.where("id = 1"), 9).collect()]
    assert sorted(got) == [(1, 1, 2, 5), (1, 2, 2, 5), (1, 3, 3, 5)]


class Recorded:
    """Sorted lists that note how much of them is read at once."""

    def __init__(self, lists, reads):
        self.lists, self.reads = lists, reads

    def __getitem__(self, at):
        out = self.lists[at]
        self.reads.append(out.shape[1] if len(out) else 0)
        return out


def test_stops_before_reading_all():
    import numpy as np

    ids, v = np.arange(5000), np.zeros((5000, 2), np.int64)
    v[:, 0] = np.arange(5000)
    shard = top_k.Shard(ids, v)
    reads = []
    shard.lists = Recorded(shard.lists, reads)
    ((found, scores),) = shard.top(np.array([[1, 0]]), np.array([4999]), 3)
    assert reads and max(reads) <= 5000 // 48
    assert found.tolist() == [4998, 4997, 4996] and scores.tolist() == [4998, 4997, 4996]


def test_empty(spark):
    assert top_k.embedding_neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
