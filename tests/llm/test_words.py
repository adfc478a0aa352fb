import re

import numpy as np
import pyarrow as pa

from parcelforge.llm.words import blocks, buffers, shingle_hashes, word_hashes

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATTERNS = {"alnum": r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "nonspace": r"[^\x20\x09-\x0D]+"}
TEXTS = ["", None, "One two", "ÀB cà-b  x", "end ", " start\tmid\x0bz", "a", "éé1", "日本 語x", "\n\n", "A" * 5000 + " b", "tail", "nb\xa0sp \x85"]


def test_words_are_those_of_the_patterns():
    data, offsets = buffers(pa.array(TEXTS))
    for kind, pattern in PATTERNS.items():
        hashes, rows = word_hashes(data, offsets, kind)
        seen = {}
        for i, t in enumerate(TEXTS):
            words = re.findall(pattern, (t or "").translate(LOWER))
            own = hashes[rows[i] : rows[i + 1]].tolist()
            assert len(own) == len(words)
            for w, h in zip(words, own, strict=True):
                assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_hashes_do_not_depend_on_the_block():
    data, offsets = buffers(pa.array(TEXTS))
    whole, _ = word_hashes(data, offsets, "alnum")
    parts = [word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], "alnum")[0] for a, b in blocks(offsets, 10)]
    assert np.array_equal(whole, np.concatenate(parts))


def test_sliced_columns():
    data, offsets = buffers(pa.array(["abc", "de", None, "f"])[1:])
    assert bytes(data) == b"def" and offsets.tolist() == [0, 2, 2, 3]


def test_shingles():
    data, offsets = buffers(pa.array(["a b c", "a b", "b", "", "a b a b", "c a b"]))
    sets = [set(s.tolist()) for s in shingle_hashes(*word_hashes(data, offsets, "nonspace"), 2)]
    assert [len(s) for s in sets] == [2, 1, 1, 0, 2, 2]
    assert sets[1] < sets[0] and len(sets[0] & sets[5]) == 1 and len(sets[4] & sets[0]) == 1
    # fewer words than k: the whole sequence is one shingle, and order counts
    data, offsets = buffers(pa.array(["a b", "b a", "a b"]))
    short = [s.tolist() for s in shingle_hashes(*word_hashes(data, offsets, "nonspace"), 5)]
    assert short[0] == short[2] != short[1]
