from parcelforge.llm import line_dedup
from tests.llm.conftest import words_of


def near(a, b):
    """Within one word edit."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(rows, min_chars, fuzzy_words):
    places = {}
    for doc, text in rows:
        for no, line in enumerate(text.split("\n")) if text is not None else ():
            if len(line) >= min_chars and line.strip(" "):
                places.setdefault(line, set()).add((doc is not None, doc or 0, no))
    first = {line: min(p) for line, p in places.items()}
    long = [line for line in first if len(line.split(" ")) >= fuzzy_words]
    gone = set()
    for line, at in places.items():
        gone |= at - {first[line]}
        if line in long and any(first[o] < first[line] and o != line and near(o.split(" "), line.split(" ")) for o in long):
            gone |= at
    return gone


def corpus(rng):
    lines = [" ".join(words_of(rng, rng.randrange(1, 14), 60)) for _ in range(60)]
    for base in list(lines):
        w = base.split(" ")
        if len(w) >= 7:
            i = rng.randrange(len(w))
            lines += [" ".join([*w[:i], "exchanged", *w[i + 1 :]]), " ".join([*w[:i], *w[i + 1 :]]), " ".join([*w[:i], "put-in", *w[i:]]), " ".join([*w[:i], w[i], *w[i:]])]
    rows = [(d, "\n".join(rng.choice(lines) for _ in range(rng.randrange(0, 9)))) for d in range(60)]
    rows += [(70, None), (71, ""), (72, "\n\n  \n" + "                    " + "\n"), (73, rows[0][1]), (73, rows[0][1]), (None, "\n".join(lines[:3])), (-5, lines[4])]
    return rows + [(80, " ".join(words_of(rng, 3000, 5000))), (81, "template line with number 1 of many kept here"), (82, "template line with number 2 of many kept here"), (83, "template line with number 3 of many kept here")]


def test_matches_brute_force(make_docs, rng):
    rows = corpus(rng)
    for min_chars, fuzzy_words in ((1, 8), (16, 8), (5, 3)):
        got = {(r.doc is not None, r.doc or 0, no) for r in line_dedup.repeated_lines(make_docs(rows), min_chars, fuzzy_words).collect() for no in r["lines"]}
        assert got == brute(rows, min_chars, fuzzy_words)


def test_texts_and_columns(make_docs, rng):
    rows = corpus(rng)
    frame = make_docs(rows)
    gone = brute(rows, 1, 8)
    want = [(d, t if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (d is not None, d or 0, i) not in gone)) for d, t in rows]
    out = line_dedup.without_repeated_lines(frame)
    assert out.columns == [*frame.columns, "lines_dropped"]
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(want, key=str)
    kept = line_dedup.drop_repeated_lines(frame)
    assert kept.columns == frame.columns and dict(kept.dtypes) == dict(frame.dtypes)
    left = {r.doc_id: r for r in kept.collect()}
    assert 83 not in left and 81 in left and 70 in left and 71 in left
    assert all(r.n_chars == len(r.text or "") for r in left.values())


def test_empty_table(make_docs):
    assert line_dedup.without_repeated_lines(make_docs([])).count() == 0


def test_plan_is_native(make_docs, rng):
    plan = line_dedup.without_repeated_lines(make_docs(corpus(rng)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_short_lines_are_repeated_lines(make_docs):
    rows = [(1, "OK\n\nyes\n  "), (2, "yes\n\nno\n  "), (3, "OK"), (4, "ok")]
    out = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.without_repeated_lines(make_docs(rows)).collect()}
    assert out == {1: ("OK\n\nyes\n  ", 0), 2: ("\nno\n  ", 1), 3: ("", 1), 4: ("ok", 0)}
    assert {r.doc_id for r in line_dedup.drop_repeated_lines(make_docs(rows)).collect()} == {1, 2, 4}


def test_long_lines(make_docs, rng):
    """Variants of lines beyond 64 words come from sums by runs."""
    for n in (63, 64, 65, 66, 100, 257):
        base = words_of(rng, n, 10**6)
        rows = [(1, " ".join(base))]
        rows += [(10 + i, " ".join([*base[:at], *base[at + 1 :]])) for i, at in enumerate((0, n // 2, n - 1))]
        rows += [(20 + i, " ".join([*base[:at], "put", *base[at:]])) for i, at in enumerate((0, n // 3, n))]
        rows += [(30 + i, " ".join([*base[:at], "other", *base[at + 1 :]])) for i, at in enumerate((0, n // 5, n - 1))]
        rows += [(40, " ".join(reversed(base)))]
        got = {(True, r.doc, no) for r in line_dedup.repeated_lines(make_docs(rows)).collect() for no in r["lines"]}
        assert got == brute(rows, 1, 8) and len(got) == 9


def test_many_lines_of_one_document(make_docs):
    n = 30_000
    rows = [(1, "\n".join(f"line {i} here" for i in range(n))), (2, "\n".join(f"line {i} here" if i % 2 else f"own {i}" for i in range(n)))]
    out = {r.doc_id: r for r in line_dedup.without_repeated_lines(make_docs(rows)).collect()}
    assert out[1].lines_dropped == 0 and out[2].lines_dropped == n // 2
    assert out[2].text == "\n".join(f"own {i}" for i in range(0, n, 2))


def test_clashing_columns(make_docs):
    from pyspark.sql import functions as F

    names = ("gone_doc", "gone_lines", "lines_dropped", "all_lines", "doc", "line", "line_no", "lines")
    docs = make_docs([(1, "a line"), (2, "a line\nmore")]).select("*", *[F.lit("mine").alias(c) for c in names])
    out = line_dedup.without_repeated_lines(docs)
    assert out.columns == [*docs.columns, "_lines_dropped"]
    assert {r.doc_id: (r.text, r._lines_dropped) for r in out.collect()} == {1: ("a line", 0), 2: ("more", 1)}
    kept = line_dedup.drop_repeated_lines(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.gone_doc for r in kept.collect()} == {1: "mine", 2: "mine"}
