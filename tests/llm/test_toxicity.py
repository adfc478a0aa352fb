import numpy as np

from parcelforge.llm import toxicity as t


def test_fold():
    assert t.fold("ÌDÍ0T") == t.fold("іdiоt") == t.fold("ｉｄｉｏｔ") == t.fold("1d1ot") == t.fold("idi​ot") == "idiot"
    assert t.fold("plain text") == "plain text"


def test_hits_begin_words_and_spare_exceptions():
    lex = t.Lexicon({"idiot": 4.0, "scum ": 3.0, "idio": 2.0}, frozenset({"idiot proof"}))
    find = lambda s: [(s[a:b], w) for a, b, w in lex.hits(s)]
    assert find("an idiot, idiots and the xidiot") == [("idiot", 4.0), ("idiot", 4.0)]
    assert find("scum scummy") == [("scum", 3.0)]
    assert find("idiot proof, idiot proofs") == [("idiot", 4.0)]
    assert t.Lexicon({}).hits("idiot") == []


def test_score_falls_with_length():
    lex = t.Lexicon({"idiot": 4.0})
    short, long, none = lex.score("you idiot"), lex.score("you idiot " + "fine words here " * 500), lex.score(None)
    assert short > long > none == lex.score("")


def corpus(rng, n=400):
    rows, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.25
        w = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 8))) for _ in range(rng.randrange(10, 120))]
        for _ in range(3 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["vexlor", "Grumble", "gr0mp" + rng.choice(["", "s", "ing", "ed"])]))
        if not bad and rng.random() < 0.12:
            w.insert(rng.randrange(len(w)), "vexlor lamp")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_learns_words_stems_and_exceptions(spark, make_docs, rng):
    rows, labels = corpus(rng)
    odd = [(900, None), (901, ""), (902, "GRÛMBLE"), (None, "vexlor"), (903, "calm " * 50000), (0, rows[0][1])]
    docs, marks = make_docs(rows + odd), spark.createDataFrame([*labels, (None, 1, 1)], "doc_id long, quality int, toxic int")
    lex = t.learn(docs, marks)
    assert "grumble" in lex.weights and "gromp" in lex.weights and "vexlor lamp" in lex.exceptions
    got = t.toxicity(docs, marks).collect()
    want = {i: y for i, _, y in labels}
    held = [r for r in got if r.held_out and r.doc_id in want]
    assert len(held) > 50 and np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.97
    by = {r.doc_id: r for r in got}
    assert by[902].predicted == 1 and by[900].score == by[901].score < 0.3 and by[903].predicted == 0
    assert len(got) == len(rows) + len(odd)


def test_no_labels_and_empty_table(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in t.toxicity(make_docs([(1, "words")]), none).collect()] == [0]
    assert t.toxicity(make_docs([]), none).count() == 0
