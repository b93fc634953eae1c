import math
import random
from collections import Counter, defaultdict

import numpy as np

from tidewater.llm import ppm

EN = ["the cat sat on the mat", "this is the thing that they wanted", "where there is a will"]
FR = ["le chat est sur la table", "où est la bibliothèque", "il était une fois"]


def brute_bits(train, text):
    """PPM with escape method C and exclusion, straight from the definition."""
    tree = defaultdict(Counter)
    for t in train:
        line = [ppm.START] * ppm.ORDER + list(t.encode())
        for i in range(ppm.ORDER, len(line)):
            for k in range(ppm.ORDER + 1):
                tree[tuple(line[i - k : i])][line[i]] += 1
    total = 0.0
    line = [ppm.START] * ppm.ORDER + list(text.encode())
    for i in range(ppm.ORDER, len(line)):
        out = set()
        for k in range(ppm.ORDER, -1, -1):
            c = {s: n for s, n in tree.get(tuple(line[i - k : i]), {}).items() if s not in out}
            if not c:
                continue
            whole = sum(c.values()) + len(c)
            if line[i] in c:
                total -= math.log2(c[line[i]] / whole)
                break
            total -= math.log2(len(c) / whole)
            out |= set(c)
        else:
            total += math.log2(256 - len(out))
    return total


def model():
    return ppm.build({"en": ppm._grams([t.encode() for t in EN]), "fr": ppm._grams([t.encode() for t in FR])})


def test_code_lengths_are_exact():
    rng = random.Random(2)
    texts = [*EN, *FR, "a", "zzz", "Ünïcode ☃", "".join(rng.choice("abcdefgh tzé☃") for _ in range(500))]
    got = ppm.Coder(model()).lengths([t.encode() for t in texts])
    want = [[brute_bits(EN, t), brute_bits(FR, t)] for t in texts]
    np.testing.assert_allclose(got, want, rtol=1e-9)


def test_frame(spark):
    rows = [(i, t, "en", "x") for i, t in enumerate(EN * 3)] + [(100 + i, t, "fr", "y") for i, t in enumerate(FR * 3)]
    rows += [(200, None, "en", "z"), (201, "", None, "z"), (202, "12 ... 34", "en", None), (None, "the thing", None, "z"), (0, EN[0], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    m = ppm.learn(docs.filter(~ppm.held_out()))
    got = ppm.predict(docs, m).collect()
    assert len(got) == len(rows)
    pred = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert pred[200] == pred[201] == pred[202] == ("und", 0.0)
    assert all(pred[i][0] == lang for i, t, lang, _ in rows if t and i is not None and i < 200)
    assert all(0 <= r.score <= 1 for r in got)
    kept = ppm.keep_identified(docs, m)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {200, 201, 202}


def test_sample_bound(spark):
    docs = spark.createDataFrame([(i, f"text number {i}", "en") for i in range(500)], "doc_id long, text string, lang string")
    few = ppm.learn(docs, per_language=5)
    assert few.languages == ["en"]
    again = ppm.learn(docs, per_language=5)
    assert all(a.follower.tolist() == b.follower.tolist() and a.saved.tolist() == b.saved.tolist() for a, b in zip(few.orders[0], again.orders[0], strict=True))
    assert few.orders[0][0].context.tolist() == [0]


def test_a_worker_forgets_and_codes_alike(monkeypatch):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcdefgh tzé☃") for _ in range(rng.randrange(60))).encode() for _ in range(200)]
    want = ppm.Coder(model()).lengths(texts)
    monkeypatch.setattr(ppm, "MEMO", 100)
    coder = ppm.Coder(model())
    np.testing.assert_allclose(np.concatenate([coder.lengths(texts[i : i + 7]) for i in range(0, 200, 7)]), want)


def test_long_texts_are_learned_from_only_without_others(spark):
    docs = spark.createDataFrame([(EN[0] * 50, "en"), (EN[1], "en"), (FR[0] * 50, "fr"), (FR[1] * 50, "fr")], "text string, lang string")
    m = ppm.learn(docs, text_bytes=100, calibrate=False)
    assert m.languages == ["en", "fr"]
    starts = lambda x: 2 ** m.orders[m.languages.index(x)][3].saved.max()
    assert starts("en") < 5 and starts("fr") > 40


def test_repeated_texts_hide_no_language(spark):
    rows = [(EN[i % 3], "en") for i in range(20000)] + [(f"{FR[i % 3]} {i}", "fr") for i in range(400)]
    docs = spark.createDataFrame(rows, "text string, lang string").cache()
    for seed in range(6):
        assert ppm.learn(docs, seed=seed, calibrate=False).languages == ["en", "fr"]
    docs.unpersist()


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    m = ppm.learn(docs)
    assert [(r.lang_pred, r.score) for r in ppm.predict(docs, m).collect()] == [("und", 0.0)]
    assert ppm.predict(docs.limit(0), m).collect() == []


def test_noise_and_languages_that_were_not_learned_go(spark):
    rng = random.Random(4)
    say = lambda words: " ".join(rng.choice(words.split()) for _ in range(80))
    en = "the of and that with for this from was are which have not but they their would there about"
    fr = "le la les des que dans pour sur une avec être où déjà très même sont nous vous mais"
    good = [(i, say(en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(200)]
    bad = [(1000, say("kaikki ihmiset syntyvät vapaina tasavertaisina arvoltaan oikeuksiltaan heille annettu järki"), "en")]
    bad += [(1001, say("все люди рождаются свободными равными своём достоинстве правах"), "fr")]
    bad += [(1002, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)), "en")]
    bad += [(1003, "".join(rng.choice("ABCDEFGHIJKLMNOPabcdefghijklmnop0123456789+/") for _ in range(400)), "en")]
    schema = "doc_id long, text string, lang string"
    m = ppm.learn(spark.createDataFrame(good, schema))
    assert sorted(m.limits) == ["en", "fr"]
    kept = ppm.keep_identified(spark.createDataFrame([*good, *bad, (2000, "the have", "en")], schema), m)
    assert sorted(r.doc_id for r in kept.collect()) == [*range(200), 2000]


def sample_of(monkeypatch, docs, per_language):
    """Languages and numbers of texts that learn() takes its counts from."""
    seen = []
    build = ppm.build
    monkeypatch.setattr(ppm, "build", lambda counts: seen.append({x: int(n[key >> 9 & (1 << 27) - 1 == (ppm.START << 18 | ppm.START << 9 | ppm.START)].sum()) for x, (key, n) in counts.items()}) or build(counts))
    ppm.learn(docs, per_language=per_language, calibrate=False)
    return seen[-1]


def test_sample_holds_its_distinct_texts_among_copies(spark, monkeypatch):
    rows = [(f"texte numéro {i % 40}", "fr") for i in range(8000)] + [(f"text number {i % 3}", "en") for i in range(4000)]
    rows += [(f"wort nummer {i}", "de") for i in range(2000)] + [("solo", "it")]
    docs = spark.createDataFrame(rows, "text string, lang string")
    assert sample_of(monkeypatch, docs, 20) == {"de": 20, "en": 3, "fr": 20, "it": 1}


def test_every_language_is_learned(spark, monkeypatch):
    docs = spark.createDataFrame([(f"t{i}", f"l{i:04}") for i in range(1100)], "text string, lang string")
    assert len(sample_of(monkeypatch, docs, 2)) == 1100
