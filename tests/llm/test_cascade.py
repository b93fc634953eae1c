import random
import re

from tidewater.llm import cascade

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = W.findall(t)
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(tri) if tri.count(x) > 1 for k in range(3)}
    lines = [x for x in t.split("\n") if W.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(covered)


def texts():
    rng = random.Random(6)
    words = ["a", "the", "é日", "x\x1cy", "B!", "#|", "q\x85q", "long" * 5]
    out = [None, "", " \n\n", "one", "a b", "a b c a b c", "same\nsame\n same\n\n\nsame\r", "!! " * 60, "AB " * 70]
    return out + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t", "\r\n"]) for _ in range(rng.randint(1, 150))) for _ in range(60)]


def test_measures_and_verdict(spark):
    rows = [(i, t, True, "x") for i, t in enumerate(texts())] + [(0, None, True, "x"), (None, "one", True, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept boolean, n_words string")
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    forward = cascade.run(docs, cascade.RULES, names).collect()
    backward = cascade.run(docs, cascade.RULES[::-1], names).collect()
    assert sorted((str(r.doc_id), *(r[n] for n in names)) for r in forward) == sorted((str(i), *brute(t)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.kept) for r in forward) == sorted((str(r.doc_id), r.kept) for r in backward)
    assert all(r.kept == (r.rejected_by is None) for r in forward)
    assert all(r.n_tried == (8 if r.kept else [x.name for x in cascade.RULES].index(r.rejected_by) + 1) for r in forward)


def test_order_by_rejections_per_cost(spark):
    some = lambda t: t.n_words > 0
    rules = (cascade.Rule("dear", some, per_byte=90), cascade.Rule("never", lambda t: False), cascade.Rule("cheap", some, per_word=100), cascade.Rule("lines", some, per_line=150))
    docs = spark.createDataFrame([(i % 40, "some words", "x") for i in range(50)] + [(None, None, "x")], "doc_id long, text string, name string")
    seen = cascade.profile(docs, rules)
    assert {p.name: (p.rows, p.rejected, p.nanoseconds) for p in seen} == {"dear": (51, 50, 45000), "never": (51, 0, 0), "cheap": (51, 50, 10000), "lines": (51, 50, 7500)}
    assert [r.name for r in cascade.order(rules, seen)] == ["lines", "cheap", "dear", "never"]


def test_copies_are_drawn_one_by_one(spark):
    docs = spark.range(20000).selectExpr("id as doc_id", "case when id < 10000 then 'copy' else cast(id as string) end as text")
    rows = [cascade.profile(docs, sample=n)[0].rows for n in (400, 400, 2000)]
    assert rows[0] == rows[1] and abs(rows[0] - 400) < 100 and abs(rows[2] - 2000) < 250
    alike = docs.selectExpr("doc_id", "'copy' as text")
    assert cascade.profile(alike, sample=400)[0].rows == rows[0]


def test_stops_at_the_first_rejection():
    asked = []
    rule = lambda name, says: cascade.Rule(name, lambda t: asked.append(name) or says)
    assert cascade.first_rejection(cascade.Text(b"x"), (rule("a", False), rule("b", True), rule("c", True))) == ("b", 2)
    assert asked == ["a", "b"]
    assert cascade.first_rejection(cascade.Text(b"x"), (rule("a", False),)) == (None, 1)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert {p.rows for p in cascade.profile(docs)} == {0}
    assert cascade.run(docs, cascade.RULES).collect() == []
