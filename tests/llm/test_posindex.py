import random
import re
from collections import Counter, defaultdict

import pytest

from tidewater.llm import posindex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(text, items):
    w = words(text)
    hit, found = set(), set()
    for item_id, t in items:
        x = words(t)
        size = min(10, len(x))
        for k in range(len(x) - size + 1) if x else ():
            for i in range(len(w) - size + 1):
                if w[i : i + size] == x[k : k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item_id))
    return len(w), len(hit), ",".join(sorted(found))


def brute_near(docs, items):
    """(places, items) where an item's three rarest words are near each other, for each document."""
    df = Counter(w for _, t in docs for w in words(t))
    lists = [(i, sorted({(df[w], w) for w in words(t) if df[w]})[:3]) for i, t in dict.fromkeys(items)]
    out = []
    for _, t in docs:
        at = defaultdict(list)
        for i, w in enumerate(words(t)):
            at[w].append(i)
        met = [(i, p) for i, rare in lists if rare for p in at[rare[0][1]] if all(any(abs(p - q) <= 20 for q in at[w]) for _, w in rare)]
        out.append((len(met), sorted({str(i) for i, _ in met})))
    return out


def tables():
    rng = random.Random(4)
    vocab = ["the", "of", "and", *(f"w{i}" for i in range(40)), "é", "École", "日本"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.randint(10, 40))) for i in range(8)]
    items += [(20, "Short item."), (21, "w1"), (22, ""), (23, None), (24, "absent words only"), (25, items[0][1]), (25, items[1][1]), (26, "the the the the the the the the the the the the")]
    docs = [(i, text(rng.randint(0, 200))) for i in range(30)]
    for i, (_, t) in enumerate(items[:10]):
        docs.append((100 + i, text(20) + "!\n" + t.upper().replace("É", "é") + " " + text(5)))
        part = t.split()
        docs.append((200 + i, "  " + " ".join(part[: max(9, len(part) // 2)]) + "... short ITEM"))
    docs += [(300, None), (301, ""), (302, "..."), (303, "the " * 300), (304, items[0][1] * 3), (304, items[0][1]), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 18, 0])
def test_matches_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(posindex, "BROADCAST_TERMS", limit)
    docs, items = tables()
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, term string, pos int")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, key string")
    got = posindex.contamination(posindex.build(d, b)).collect()
    assert len(got) == len(docs)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, ",".join(r["items"])) for r in got) == sorted((str(i), *brute(t, items)) for i, t in docs)
    near = brute_near(docs, items)
    assert any(n for n, _ in near)
    assert sorted((str(r.doc_id), r.n_words, r.n_near, r.near_items) for r in got) == sorted((str(i), len(words(t)), *x) for (i, t), x in zip(docs, near, strict=True))


def test_proximity(spark):
    d = spark.createDataFrame([(1, "the red fox and a lazy dog"), (2, "red " + "x " * 50 + "fox dog"), (3, "dog fox red")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "red fox dog")], "item_id long, text string")
    index = posindex.build(d, b)
    assert {r.id for r in posindex.proximity(index, span=6, terms=3).collect()} == {1, 3}
    assert {r.id for r in posindex.phrases(index).collect()} == set()


def test_without_contaminated(spark):
    docs, items = tables()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    docs.append((304, "clean text under an id of others"))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    good = [(i, t) for i, t in docs if not brute(t, items)[1]]
    assert sorted(map(str, posindex.without_contaminated(d, b).collect())) == sorted(f"Row(doc_id={i}, text={t!r})" for i, t in good)


def test_empty(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit) for r in posindex.contamination(posindex.build(d, b)).collect()] == [(2, 0)]
    assert posindex.contamination(posindex.build(d.limit(0), b)).collect() == []


def test_no_python_in_the_plan(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    index = posindex.build(d, d.withColumnRenamed("doc_id", "item_id"))
    plan = posindex.contamination(index)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
