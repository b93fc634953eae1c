import random

import numpy as np
import pytest

import corpus_pipeline
from tidewater.llm import minhash


def brute_sets(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute_components(rows, least=0.8):
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least_id = {}
    for i, (d, _) in enumerate(rows):
        least_id[find(i)] = min(least_id.get(find(i), d), d)
    return sorted((d, least_id[find(i)]) for i, (d, _) in enumerate(rows))


def corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for i in range(25):
        t = [rng.choice(words) for _ in range(rng.randint(3, 300))]
        rows.append((i, " ".join(t)))
        for k in range(4):
            c = list(t)
            for _ in range(k):
                c[rng.randrange(len(c))] = "changed"
            rows.append((100 * (k + 1) + i, " ".join(c).upper() if k == 1 else "  ".join(c)))
    return [*rows, (900, None), (901, ""), (902, " \n"), (7, rows[35][1]), (7, rows[35][1])]


@pytest.mark.parametrize("cell", [3, 256])
def test_components_against_brute_force(spark, monkeypatch, cell):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, component string, node int")
    monkeypatch.setattr(minhash.links, "__defaults__", (*minhash.links.__defaults__[:-1], cell))
    got = sorted((r.doc_id, r.component) for r in minhash.near_duplicates(docs).collect())
    assert got == brute_components(rows)


def test_stage_drops_copies_with_changed_words(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(200)]
    other = [f"w{rng.randrange(3000)}" for _ in range(200)]
    changed = [*base[:60], "changed", *base[61:150], "too", *base[151:]]  # Jaccard 186 / 206
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(changed)), (3, " ".join(other))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [1, 3]


def test_recall_of_the_bands_at_the_limit():
    rng = np.random.default_rng(3)
    hit = 0
    for _ in range(400):
        h = rng.integers(0, 1 << 63, 110, np.uint64) * np.uint64(2)
        a, b = minhash.bands(h[:99]), minhash.bands(h[11:])  # 88 of 110 shared: 0.8
        hit += any(x == y for x, y in zip(a, b, strict=True))
    assert hit >= 398


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert minhash.one_of_each(docs).collect() == []
