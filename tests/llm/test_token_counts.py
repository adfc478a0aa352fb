import base64

import numpy as np
import pytest

from parcelforge.llm import token_counts as tc

TEXTS = ["", "one line", "two\nlines\n", "\n\n\n  \n x", "é\nü ßß\n日本\n語", "a" * 3000 + "\n" + "b  \n\n c", "tab\t\n\n\nend\n", "'s 12345 !!! \r\n x"]
#: Merges of the vocabulary of the tests, besides all bytes.
MERGES = ["on", "li", "ne", "line", " line", "aa", "aaaa", "  ", " \n", "\n\n", "\n\n\n", "é", "日", "本", " x", "nd", "12", "te", "lon", "g "]


@pytest.fixture(scope="module")
def vocabulary(tmp_path_factory):
    pieces = [bytes([i]) for i in range(256)] + [m.encode() for m in MERGES if len(m.encode()) > 1]
    path = tmp_path_factory.mktemp("vocabulary") / "small.tiktoken"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate(pieces)))
    return str(path)


def brute(text, encoding, pieces, spans=None):
    """Tokens of each line or span, byte by byte from the pieces themselves."""
    data = text.encode()
    if spans is None:
        starts = [0] + [i + 1 for i, b in enumerate(data) if b == 10 and i + 1 < len(data)]
        owner, n = (np.searchsorted(starts, np.arange(len(data)), "right") - 1).tolist(), len(starts)
    else:
        # bytes between spans belong to pieces of their own, in order
        char_of = [k for k, c in enumerate(text) for _ in c.encode()]
        owner, n = [2 * sum(b <= k for _, b in spans) + any(a <= k < b for a, b in spans) for k in char_of], len(spans)
    counts, at, crossing = {}, 0, 0
    ids = encoding.encode_ordinary(text)
    for i in ids:
        held = {}
        for o in owner[at : at + len(pieces[i])]:
            held[o] = held.get(o, 0) + 1
        best = max(held, key=lambda o: (held[o], -o))
        counts[best] = counts.get(best, 0) + 1
        crossing += len(held) > 1
        at += len(pieces[i])
    assert at == len(data)
    return len(data), len(ids), n, crossing, [counts.get(k if spans is None else 2 * k + 1, 0) for k in range(n)]


def test_lines_match_brute_force(make_docs, vocabulary):
    ranks = tc.read_ranks(vocabulary)
    encoding, _ = tc.encoder(ranks)
    pieces = {v: k for k, v in ranks.items()}
    rows = [*enumerate(TEXTS), (50, "long text " * 30000), (51, None), (None, "x"), (1, TEXTS[1])]
    got = tc.token_counts(make_docs(rows), vocabulary).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == brute(texts[r.doc_id] or "", encoding, pieces)
        assert sum(r.section_tokens) == r.n_tokens


def test_given_spans_match_brute_force(spark, vocabulary, rng):
    ranks = tc.read_ranks(vocabulary)
    encoding, _ = tc.encoder(ranks)
    pieces = {v: k for k, v in ranks.items()}
    rows = []
    for i, text in enumerate(TEXTS * 5):
        places = sorted(rng.sample(range(len(text) + 1), 2 * min(3, (len(text) + 1) // 2)))
        spans = [(a, b) for a, b in zip(places[::2], places[1::2], strict=True)]
        rows.append((i, text, spans))
    rows += [(90, "one line", None), (91, None, [(0, 5)]), (92, "ab", [(0, 1), (1, 99)])]
    frame = spark.createDataFrame(rows, "doc_id long, text string, fields array<struct<start: int, stop: int>>")
    got = {r.doc_id: r for r in tc.token_counts(frame, vocabulary, sections="fields").collect()}
    for i, text, spans in rows:
        r = got[i]
        assert (r.n_bytes, r.n_tokens, r.n_sections, r.n_crossing, r.section_tokens) == brute(text or "", encoding, pieces, spans or []), (i, text, spans)


def test_boundary_rule():
    own, crossing = tc.allocate(np.array([0, 3, 5, 9]), np.array([3, 5, 9, 12]), np.array([0, 4, 10]))
    # 3..5 is half in each: to the first; 9..12 is mostly in the last
    assert own.tolist() == [2, 1, 1] and crossing == 2


def test_missing_vocabulary_and_bad_spans(make_docs):
    with pytest.raises(FileNotFoundError, match="its path is a setting"):
        tc.token_counts(make_docs([]), "/nowhere/v.tiktoken")
    with pytest.raises(ValueError, match="overlap"):
        tc.spans_to_cuts(np.arange(10), [(0, 4), (3, 5)])


def test_empty_table(make_docs, vocabulary):
    assert tc.token_counts(make_docs([]), vocabulary).count() == 0
