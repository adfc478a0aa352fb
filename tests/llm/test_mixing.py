import itertools

import pytest

from parcelforge.llm import mixing
from tests.llm.conftest import words_of


def test_water_fill():
    got = mixing.water_fill({"a": 100, "b": 10, "c": 40, None: 0}, {"a": 3, "b": 1, "c": 2, None: 3}, 225, 2)
    assert got[None] == 0 and got["b"] == 20 and got["c"] == 80 and got["a"] == pytest.approx(125)
    assert mixing.water_fill({}, {}, 0, 2) == {}


def test_flow_is_largest_and_cheapest():
    patterns = [(("a",), 5), (("a", "b"), 4), (("b", "c"), 3), (("c",), 2)]
    quotas = {"a": 7, "b": 5, "c": 6}
    given = mixing.route(patterns, quotas, 2)
    best = None
    # each pattern's words to its sources, in all ways
    ways = [[dict(zip(s, w, strict=True)) for w in itertools.product(range(2 * n + 1), repeat=len(s)) if sum(w) <= 2 * n] for s, n in patterns]
    for choice in itertools.product(*ways):
        load = {q: sum(c.get(q, 0) for c in choice) for q in quotas}
        if all(load[q] <= quotas[q] for q in quotas):
            cost = sum(max(0, sum(c.values()) - n) for c, (_, n) in zip(choice, patterns, strict=True))
            best = min(best or (0, 0), (-sum(load.values()), cost))
    assert (-sum(given), sum(max(0, g - n) for g, (_, n) in zip(given, patterns, strict=True))) == best


def test_overlapping_sources(spark):
    rows = [(i, 10 + i % 7, ["a"] if i % 3 else ["a", "b"]) for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, size long, sources array<string>")
    out, sizes, targets = mixing.mix(frame, lambda s: dict.fromkeys(s, 1.0), share=1.2)
    got = out.collect()
    total = sum(r[1] for r in rows)
    assert sizes == {"a": total, "b": sum(r[1] for r in rows if len(r[2]) == 2)}
    assert all(0 <= r.taken <= 2 * r.size for r in got)
    # all words are given out, as the patterns can meet both quotas
    assert abs(sum(r.taken for r in got) - 1.2 * total) < 40


def corpus(rng):
    rows = [(i, " ".join(words_of(rng, rng.randrange(1, 60))), f"src{i % 4}" if i % 4 else None) for i in range(300)]
    return rows + [(400, None, "src1"), (401, "", "only-empty"), (402, " \n ", "src2"), (403, "x " * 5000, "big"), (404, "same words here", "tie"), (405, "same words here", "tie"), (405, "same words here", "tie"), (None, "a b c", "src3")]


def test_contract(make_docs, rng):
    rows = corpus(rng)
    got = mixing.mix_documents(make_docs(rows)).collect()
    assert len(got) == len(rows)
    sizes, taken, target = {}, {}, {}
    own = {(i, len((t or "").split())): s for i, t, s in rows}
    for r in got:
        s = own[r.doc_id, r.size]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        assert target.setdefault(s, r.target) == r.target
        assert r.taken in (0, r.size, 2 * r.size)
    assert {own[r.doc_id, r.size]: r.source_size for r in got} == sizes
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = mixing.water_fill({s: sizes[s] for s in order}, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2)
    assert target == pytest.approx(want)
    for s in sizes:
        if s not in ("big", "tie"):  # of one document, or of three equal words
            assert abs(taken[s] - target[s]) <= max(3, 0.02 * target[s]), s
    again = mixing.mix_documents(make_docs(list(reversed(rows))).repartition(7)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_empty_table(make_docs):
    assert mixing.mix_documents(make_docs([])).count() == 0
    assert [r.taken for r in mixing.mix_documents(make_docs([(1, None), (2, "")])).collect()] == [0, 0]
