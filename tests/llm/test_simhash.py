import random
import re

import numpy as np
import pytest
import xxhash

from tidewater.llm import simhash


def brute_fp(text):
    t = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows, radius=2):
    ids, fps = [r[0] for r in rows], [brute_fp(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i in range(len(rows)):
        r = find(i)
        least[r] = min(least.get(r, ids[i]), ids[i])
    return {(ids[i], fps[i], least[find(i)]) for i in range(len(rows))}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "one TWO", "É a B c\x1cd É", "a b c a b c a b c", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fp(text)


@pytest.mark.parametrize("cell,radius", [(4, 2), (4096, 2), (8, 1), (4096, 3)])
def test_links_find_every_close_pair(spark, cell, radius):
    rng = random.Random(cell + radius)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = {b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 4))) for b in base for _ in range(8)} | {0, 1, 2**63}
    signed = [(int(np.uint64(f).view(np.int64)),) for f in fps]
    edges = simhash.links(spark.createDataFrame(signed, "fp long"), radius, cell)
    got = {r.node: r.root for r in simhash.components(edges).collect()}
    want = {}
    items = [s[0] for s in signed]
    for a in items:
        seen, todo = {a}, [a]
        while todo:
            x = todo.pop()
            near = [b for b in items if b not in seen and bin((x ^ b) & (2**64 - 1)).count("1") <= radius]
            seen.update(near)
            todo += near
        if len(seen) > 1 and min(seen) != a:
            want[a] = min(seen)
    assert got == want


def test_hot_cell_of_two_chunks():
    rng = random.Random(3)
    fps = np.array([1 << rng.randrange(20) for _ in range(200)], np.uint64)
    sides = np.array([0] * 100 + [1] * 100)
    edges = simhash.cell_links(fps, np.array([0, 200]), sides, 2, list(range(64)))
    assert edges and all(bin(a ^ b).count("1") <= 64 for a, b in edges)


def test_documents(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(50)]
    rows = []
    for i in range(40):
        t = [rng.choice(words) for _ in range(rng.randint(1, 400))]
        rows.append((i, " ".join(t)))
        if i % 3 == 0:
            t[rng.randrange(len(t))] = "changed"
            rows.append((100 + i, " ".join(t).upper()))
    rows += [(500, None), (501, ""), (502, " \n"), (7, rows[7][1]), (7, rows[7][1])]
    docs = spark.createDataFrame([(*r, "clash", 5) for r in rows], "doc_id long, text string, component string, fp int")
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(rows)
    assert set(got) == brute_components(rows)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
