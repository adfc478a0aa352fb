"""Results computed a second way, in plain Python: a network's scores, a lexicon's scores, the mix's targets and amounts, long items and long words."""

import math
import re
import tracemalloc
from fractions import Fraction

import numpy as np
import pyarrow as pa

from parcelforge.llm import decontaminate, mixing, quality, toxicity, words
from tests.llm.conftest import words_of
from tests.llm.test_decontaminate import brute as brute_contamination


def plain_score(net, text):
    """The forward pass symbol by symbol."""
    data = text.encode()
    marks = [any(i - lag >= 7 and data[i - 7 : i + 1] == data[i - 7 - lag : i + 1 - lag] for lag in quality.LAGS) for i in range(len(data))]
    symbols = [b + 256 * m for b, m in zip(data, marks, strict=True)]
    hop = quality.CHUNK - quality.OVERLAP
    n = max(1, -(-max(len(symbols) - quality.OVERLAP, 1) // hop))
    responses = []
    for c in range(n):
        chunk = symbols[c * hop : c * hop + quality.CHUNK]
        chunk += [quality.PADDING] * (quality.CHUNK - len(chunk))
        best = [-math.inf] * quality.FILTERS
        for at in range(quality.CHUNK - quality.WIDTH + 1):
            for f in range(quality.FILTERS):
                r = sum(float(net.p["E"][chunk[at + w]] @ net.p["W"][w, :, f]) for w in range(quality.WIDTH))
                best[f] = max(best[f], r)
        responses.append([math.tanh(r + float(net.p["b"][f])) for f, r in enumerate(best)])
    features = [sum(r[f] for r in responses) / n for f in range(quality.FILTERS)] + [max(r[f] for r in responses) for f in range(quality.FILTERS)]
    return 1 / (1 + math.exp(-sum(x * float(u) for x, u in zip(features, net.p["u"], strict=True)) - float(net.p["c"][0])))


def test_network_scores(monkeypatch):
    monkeypatch.setattr(quality, "CHUNK", 40)
    monkeypatch.setattr(quality, "SCORE_CHUNKS", 2)
    net = quality.Network(3)
    net.p["u"] = np.random.default_rng(1).standard_normal(2 * quality.FILTERS).astype(np.float32)
    texts = ["", "Short.", "Some words, then MORE words 123 and é ü", "again and again and again and again and again and again", "x" * 150]
    got = net.score(*words.buffers(pa.array(texts)))
    assert np.allclose(got, [plain_score(net, t) for t in texts], atol=1e-4)


def plain_toxicity(lex, text):
    """Entries at word beginnings, the heaviest at each place, none inside an exception; weights over the length."""
    folded = toxicity.fold(text)
    starts = [i for i in range(len(folded)) if i == 0 or not folded[i - 1].isalnum()]
    ends = lambda i: i >= len(folded) or not folded[i].isalnum()
    spared = [(i, i + len(p)) for p in lex.exceptions for i in starts if folded.startswith(p, i) and ends(i + len(p))]
    total = 0.0
    for i in starts:
        weights = []
        for entry, w in lex.weights.items():
            word, whole = entry.rstrip(" "), entry.endswith(" ")
            if folded.startswith(word, i) and (not whole or ends(i + len(word))) and not any(a <= i and i + len(word) <= b for a, b in spared):
                weights.append(w)
        total += max(weights, default=0.0)
    x = lex.offset + lex.slope * math.log1p(1000 * total / (len(folded) + toxicity.LENGTH_FLOOR))
    return 1 / (1 + math.exp(-x))


def test_toxicity_scores(rng):
    lex = toxicity.Lexicon({"vex": 2.0, "vexlor": 3.5, "gromp ": 1.5, "scum": 2.5}, frozenset({"vexlor lamp", "old scum", "scum pond"}), 1.7, -3.0)
    parts = ["vexlor", "VEXLOR", "vex", "vexing", "gr0mp", "gromps", "lamp", "old", "scum", "pond", "avex", "a", "ѕcum", ".", "\n", "é"]
    for _ in range(400):
        text = rng.choice(["", " "]).join(rng.choice(parts) + rng.choice([" ", " ", "  ", "", ","]) for _ in range(rng.randrange(0, 30)))
        assert abs(lex.score(text) - plain_toxicity(lex, text)) < 1e-12, text


def test_long_texts_full_of_hits(rng):
    """Twice the hits take about twice the time."""
    import time

    lex = toxicity.Lexicon({"vexlor": 3.0}, frozenset({"vexlor lamp"}))
    seconds = []
    for n in (20_000, 80_000):
        text = "vexlor lamp vexlor x " * n
        start = time.process_time()
        assert len(lex.hits(text)) == n
        toxicity._phrases(text, lex)
        seconds.append(time.process_time() - start)
    assert seconds[1] < 4 * seconds[0] * 2


def plain_mix(rows):
    """Targets of the sources by exact fractions, from the contract's words."""
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = Fraction(3, 2) * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return sizes, fixed | share
        fixed |= {s: Fraction(2 * sizes[s]) for s in over}


def test_mix_by_hand(make_docs, rng):
    rows = [(i, " ".join(words_of(rng, rng.randrange(0, 50))), rng.choice(["b", "a", "é", None, "z", "small"] if i % 9 else ["small2"])) for i in range(500)]
    sizes, targets = plain_mix(rows)
    got = mixing.mix_documents(make_docs(rows)).collect()
    source = {i: s for i, _, s in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and abs(r.target - float(targets[s])) < 1e-6 and 0 <= r.taken <= 2 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - targets[s]) <= 3 for s in sizes)


def test_flow_by_parts():
    """Sources that share no pattern are solved apart, with the amounts that one flow gives."""
    patterns = [(("a",), 50), (("b",), 10), (("c", "d"), 30), (("d",), 5), (("x",), 7)]
    quotas = {"a": 70, "b": 90, "c": 20, "d": 25}
    given = mixing.route(patterns, quotas, 2)
    assert given[0] == 70 and given[1] == 20 and given[2] + given[3] == 45 and given[2] <= 60 and given[3] <= 10 and given[4] == 0
    # the smaller repetition cost first: 30 + 5 words once, the other ten again
    assert given == mixing.route(patterns, quotas, 2) and max(0, given[2] - 30) + max(0, given[3] - 5) == 10


def test_long_items_are_cut(spark, make_docs, rng, monkeypatch):
    """Items longer than a block are found as whole ones are, in several passes too."""
    item = words_of(rng, 700, 10**6)
    items = [(1, " ".join(item)), (2, " ".join(words_of(rng, 30))), (3, "few words"), (4, None)]
    rows = [(1, " ".join([*words_of(rng, 20), *item[331:352], *words_of(rng, 20)])), (2, " ".join(item)), (3, "some few words here"), (4, None), (5, " ".join(item[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_contamination(rows, items, 10))
    for block in (200_000, 97, 16):
        got = decontaminate.contamination(make_docs(rows), bench, block_words=block).collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want


def test_one_long_word_takes_little_memory():
    data = np.full(12_000_000, 97, np.uint8)
    tracemalloc.start()
    hashes, rows = words.word_hashes(data, np.array([0, len(data)]), "nonspace")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(hashes) == 1 and rows.tolist() == [0, 1] and peak < 8 * len(data)


def test_pieces_of_long_rows_are_the_whole(monkeypatch):
    text = " ".join(["word", "x" * 9000, "é" * 50, "", "tail"] * 40)
    data, offsets = words.buffers(pa.array(["short", text, None, text[:100]]))
    whole, rows = words.word_hashes(data, offsets, "nonspace")
    for size in (64, 700, 5000):
        monkeypatch.setattr(words, "BLOCK_BYTES", size)
        got, at = words.word_hashes(data, offsets, "nonspace")
        assert (got == whole).all() and (at == rows).all()
