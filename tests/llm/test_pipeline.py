import hashlib
import random

import public_tokenizers as P
import tiktoken
from test_blobs import PATTERNS, brute as spans_of
from test_posindex import brute as leaks_of
from test_simhash import brute_components

import corpus_pipeline
from tidewater.llm import bpe, minhash, simhash


def write(spark, tmp_path):
    """A small corpus with copies, leaks, secrets, junk, nulls and repeated rows."""
    rng = random.Random(11)
    en = "the of and that with for this from was are which have not but they their would there about".split()
    fr = "le la les des que dans pour sur une avec être où déjà très même sont nous vous mais".split()
    text = lambda lang, n: " ".join(rng.choice(en if lang == "en" else fr) + rng.choice(["", "", "s", "er"]) for _ in range(n))
    items = [(i, text("en", 30)) for i in range(4)]
    rows = []
    for i in range(60):
        lang = "en" if i % 2 else "fr"
        rows.append((i, text(lang, rng.randint(60, 200)), lang))
    rows += [(100 + i, rows[i][1], rows[i][2]) for i in range(5)]
    rows += [(110, rows[7][1].upper(), "en"), (120, None, "en"), (121, "", "fr"), (122, "123 ... 456", "en")]
    rows += [(130 + i, text("en", 20) + " " + items[i][1] + " " + text("en", 20), "en") for i in range(3)]
    rows += [(140, text("en", 80) + " password=0b1d3c05757a6b256e " + text("en", 5), "en"), (3, rows[3][1], rows[3][2])]
    docs = [(i, t, lang, "src0", None if t is None else len(t)) for i, t, lang in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return rows, items


def test_stages_against_brute_force(spark, tmp_path):
    rows, items = write(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_dedup", "decontaminate", "secret_scan", "tokenize"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = [(r.doc_id, r.text) for r in docs.collect()], spark.read.parquet(f"{tmp_path}/{k}")
        after = [(r.doc_id, r.text) for r in docs.collect()]
        if k == 0:
            assert set(before) - set(after) == {(120, None), (121, ""), (122, "123 ... 456")}
        elif k == 1:
            want = {i for i, _, c in brute_components(before) if i == c}
            assert sorted(i for i, _ in after) == sorted(want)
        elif k == 2:
            assert sorted(after) == sorted(r for r in before if not leaks_of(r[1], items)[1])
        else:
            assert {i for i, _ in before} == {i for i, _ in after}
            assert [t for _, t in after if spans_of(t)] == [] and len(PATTERNS) == 3
            assert {r for r in before if not spans_of(r[1])} <= set(after)
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tok = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path(corpus_pipeline.RANKS)), special_tokens={})
    want = {i: tok.encode_ordinary(t) for i, t in after}
    assert {r.doc_id: r["ids"] for r in last} == want
    assert {r.doc_id: r.decoded_sha256 for r in last} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after}


def test_empty_documents(spark, tmp_path):
    write(spark, tmp_path / "full")
    empty = spark.read.parquet(f"{tmp_path}/full/documents.parquet").limit(0)
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/full/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_dedup_follows_simhash_and_jaccard_links(spark):
    """a and b: fingerprints within two bits, Jaccard under 0.8; b and c: Jaccard over 0.8, fingerprints further apart."""
    bits = lambda x, y: bin(simhash.fingerprint(x.encode()) ^ simhash.fingerprint(y.encode())).count("1")
    sets = lambda x: set(minhash.shingles(x.encode()).tolist())
    same = lambda x, y: len(sets(x) & sets(y)) / len(sets(x) | sets(y))
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefgh", k=6))
    phrase = [word() for _ in range(13)]
    b = phrase * 40 + [word() for _ in range(12)]
    a = phrase * 38 + [word() for _ in range(12)]
    texts = {10: " ".join(b), 5: " ".join(a)}
    assert bits(texts[5], texts[10]) <= 2 and same(texts[5], texts[10]) < 0.8
    long = [word() for _ in range(150)]
    for _ in range(200):
        changed = list(long)
        for at in (20, 90):
            changed[at] = word()
        if bits(" ".join(long), " ".join(changed)) > 2:
            break
    texts |= {20: " ".join(long), 21: " ".join(changed), 30: " ".join(word() for _ in range(90))}
    assert bits(texts[20], texts[21]) > 2 and same(texts[20], texts[21]) >= 0.8
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.simhash_dedup(spark, docs, "").collect()) == [5, 20, 30]
