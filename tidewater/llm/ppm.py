"""Language identification by prediction by partial matching.

Each language has a context tree over bytes: contexts of 0 to ORDER preceding
bytes with the counts of the bytes that followed. A byte that a context hasn't
seen is coded by an escape to the next shorter context, with escape method C
(d / (n + d) for d distinct bytes among n) and exclusion of the bytes that the
longer contexts offer. After training the statistics are frozen, so the code
length of a byte depends on its context alone: it is worked out when a worker first
meets a byte in a context, and a text's score is an exact sum over its bytes.

Training takes, for each language, the `per_language` distinct texts of lowest
XXH64 among the rows given to learn(), of those of at most `text_bytes` bytes; a
language of longer texts only is learned from one of them. This is the documented
bound of the classifier's sample. Every text is scored whole.

keep_identified() also holds each text to what its language costs: half of a
language's sample is coded by a model of the other half, and the limit is MARGIN
times the bits a byte that a tenth of these left-out texts exceed. SLACK bits are
free, so a short text with a number or a key isn't judged by that alone. A language
of one text has no limit.

Defined results: a null text and one without a letter are `und` with score 0; so
is every text if no row could be learned from. Equal code lengths go to the
smaller language name. Rows are kept in number; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_arrow, text_chunks

#: Longest context, in bytes.
ORDER = 3
#: Texts that are learned from, for each language.
PER_LANGUAGE = 300
#: Longest text that is learned from, in bytes, if its language has others.
TEXT_BYTES = 1 << 18
#: Code lengths that a worker keeps, one for each gram and language.
MEMO = 1 << 21
#: A context position before the start of a text.
START = 256
#: A text may cost so many times the bits a byte that a tenth of the left-out texts of its language exceed,
MARGIN = 2.0
#: and so many bits besides, whatever its length.
SLACK = 320
LETTER = regex.compile(r"\p{L}")


@dataclass
class Order:
    """The contexts of one length in one language, as sorted numbers of 9 bits a symbol,
    and the symbols that followed them. Costs are in bits."""

    context: np.ndarray
    top: np.ndarray  # of a symbol of count one after this context, the longest that was seen
    escape: np.ndarray  # to the next shorter context from it
    below: np.ndarray  # of a symbol of count one after the context without its first symbol, which escaped from this one
    below_escape: np.ndarray  # and of an escape from that
    follower: np.ndarray  # context << 9 | symbol
    saved: np.ndarray  # log2 of the follower's count


@dataclass
class Model:
    """Frozen statistics: a sparse context tree for each language. What it holds grows with
    the distinct contexts of the sample, whatever the number of languages or bytes in use."""

    languages: list[str]
    orders: list[list[Order]]  # of each language, by length of context
    limits: dict[str, float] = field(default_factory=dict)  # language -> bits a byte

    def costs(self, grams: np.ndarray) -> np.ndarray:
        """Bits of the last symbol of each gram (ORDER + 1 symbols), [gram, language]."""
        symbol, context = grams & 511, grams >> 9
        out = np.zeros((len(grams), len(self.languages)))
        for x, own in enumerate(self.orders):
            spent, open_ = np.zeros(len(grams)), np.ones(len(grams), bool)
            child = np.full(len(grams), -1)  # the context one longer, if it was seen
            for k in range(ORDER, -1, -1):
                o, suffix = own[k], context & ((1 << 9 * k) - 1)
                at, seen = _find(o.context, suffix)
                to, has = _find(o.follower, suffix << 9 | symbol)
                under = child >= 0
                longer = own[k + 1] if k < ORDER else o
                cost = np.where(under, longer.below[child], o.top[at])
                escape = np.where(under, longer.below_escape[child], o.escape[at])
                hit = open_ & has
                out[hit, x] = (spent + cost - o.saved[to])[hit]
                open_ &= ~has
                spent = np.where(open_ & seen, spent + escape, spent)
                child = np.where(seen, at, -1)
            left = max(256 - len(own[0].follower), 1)
            out[open_, x] = spent[open_] + np.log2(left)
        return out


class Coder:
    """Code lengths under a model, with the costs of grams met before: at most MEMO values,
    after which it starts afresh."""

    def __init__(self, model: Model):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.grams, self.bits = np.zeros(0, np.int64), np.zeros((0, len(self.model.languages)))

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, [text, language]."""
        out = np.zeros((len(texts), len(self.model.languages)))
        size = np.array([len(t) for t in texts], np.int64)
        full = np.flatnonzero(size)
        if not len(full) or not self.model.languages:
            return out
        line, distinct = pd.factorize(np.concatenate([_keys(texts[i]) for i in full]))
        at, known = _find(self.grams, distinct)
        if not known.all():
            if self.bits.size + len(distinct) * len(self.model.languages) > MEMO:
                self._forget()
                known = np.zeros(len(distinct), bool)
            new = np.sort(distinct[~known])
            grams = np.concatenate([self.grams, new])
            order = np.argsort(grams, kind="stable")
            self.grams, self.bits = grams[order], np.concatenate([self.bits, self.model.costs(new)])[order]
            at, _ = _find(self.grams, distinct)
        starts = np.concatenate([[0], np.cumsum(size[full])[:-1]])
        place = at[line]
        for x in range(len(self.model.languages)):
            out[full, x] = np.add.reduceat(self.bits[:, x][place], starts)
        return out


def _find(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of keys in a sorted table, and whether they are there; 0 for those that aren't."""
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    there = table[at] == keys
    return np.where(there, at, 0), there


def _keys(text: bytes) -> np.ndarray:
    """The ORDER + 1 symbols that end at each byte, 9 bits a symbol."""
    line = np.concatenate([np.full(ORDER, START, np.int64), np.frombuffer(text, np.uint8)])
    key = np.zeros(len(text), np.int64)
    for back in range(ORDER, -1, -1):
        key = key << 9 | line[ORDER - back : len(line) - back]
    return key


def _grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the keys of texts."""
    return np.unique(np.concatenate([_keys(t) for t in texts]), return_counts=True) if texts else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def build(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The model of counts from _grams, by language; one without a byte is left out."""
    languages = sorted(x for x in counts if len(counts[x][0]))
    return Model(languages, [_orders(*counts[x]) for x in languages])


def _orders(key: np.ndarray, many: np.ndarray) -> list[Order]:
    """The context tree of one language.

    What follows a context also follows its shorter ones, so the symbols that an escape
    excludes are those of the context one longer, and what is left after it depends on
    that context alone.
    """
    out: list[Order] = []
    times_before: np.ndarray = np.zeros(0)
    for k in range(ORDER + 1):
        follower, at = np.unique(key & ((1 << 9 * (k + 1)) - 1), return_inverse=True)
        times = np.bincount(at, weights=many)
        context, of = np.unique(follower >> 9, return_inverse=True)
        total, distinct = np.bincount(of, weights=times), np.bincount(of).astype(float)
        top = np.log2(total + distinct)
        below = below_escape = np.zeros(len(context))
        if k:
            last = out[-1]
            shorter, _ = _find(last.follower, follower & ((1 << 9 * k) - 1))
            excluded = np.bincount(of, weights=times_before[shorter])
            parent, _ = _find(last.context, context & ((1 << 9 * (k - 1)) - 1))
            left, kinds = total_before[parent] - excluded, distinct_before[parent] - distinct
            some = kinds > 0
            below = np.where(some, np.log2(np.maximum(left + kinds, 1)), 0)
            below_escape = np.where(some, below - np.log2(np.maximum(kinds, 1)), 0)
        out.append(Order(context, top, top - np.log2(distinct), below, below_escape, follower, np.log2(times)))
        times_before, total_before, distinct_before = times, total, distinct
    return out


def _up_to(rows: DataFrame, last: dict[str, int], middle: dict[str, int] | None = None) -> DataFrame:
    """rows of the languages of `last` whose hash is at most its value, with `middle`'s."""
    table = rows.sparkSession.createDataFrame([(x, h, (middle or last)[x]) for x, h in last.items()], "lang string, last long, middle long")
    return rows.join(F.broadcast(table), "lang").filter(F.col("h") <= F.col("last")).drop("last")


def learn(
    rows: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, text_bytes: int = TEXT_BYTES, seed: int = 42, calibrate: bool = True
) -> Model:
    """A model from rows with a text and a language.

    The languages' counts of distinct texts give each a hash range that holds a few
    times `per_language` of them; a range that turns out to hold too few is widened
    until it has enough or is the whole. Of these the lowest hashes are learned from.
    What reaches the driver are hashes and counts of that bounded sample.
    """
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).dropna()
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "text")).withColumn("short", F.octet_length("text") <= text_bytes)
    counts = rows.groupBy("lang").agg(F.approx_count_distinct(F.when(F.col("short"), F.col("h"))).alias("n"), F.approx_count_distinct("h").alias("all")).collect()
    if not counts:
        return build({})
    sizes = {r.lang: r.n or r.all for r in counts}
    only_long = [r.lang for r in counts if not r.n]
    rows = rows.filter(F.col("short") | F.col("lang").isin(only_long)).drop("short")
    enough = {x: 1 if x in only_long else per_language for x in sizes}
    top = 1 << 63
    share = {x: 4 * enough[x] / max(n, 1) for x, n in sizes.items()}
    lowest: dict[str, list[int]] = {}
    todo = set(sizes)
    while todo:
        ends = {x: int(min(top - 1, -top + 2 * top * min(1.0, share[x]))) for x in todo}
        found = {x: [] for x in todo}
        for r in _up_to(rows, ends).select("lang", "h").distinct().collect():
            found[r.lang].append(r.h)
        lowest |= found
        todo = {x for x in todo if len(found[x]) < enough[x] and share[x] < 1}
        for x in todo:
            share[x] *= 8
    lowest = {x: sorted(h)[: enough[x]] for x, h in lowest.items()}
    last = {x: h[-1] for x, h in lowest.items()}
    middle = {x: h[(len(h) - 1) // 2] for x, h in lowest.items()}
    sample = _up_to(rows, last, middle).dropDuplicates(["lang", "h"])
    sample = sample.select("lang", "text", (F.col("h") > F.col("middle")).cast("int").alias("fold"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            names = list(zip(part.column("lang").to_pylist(), part.column("fold").to_pylist(), strict=True))
            texts = part.column("text").cast(pa.binary()).to_pylist()
            for x in sorted(set(names)):
                key, many = _grams([t for t, name in zip(texts, names, strict=True) if name == x])
                yield pa.RecordBatch.from_arrays([pa.array([x[0]] * len(key), pa.string()), pa.array([x[1]] * len(key), pa.int32()), pa.array(key, pa.int64()), pa.array(many, pa.int64())], ["lang", "fold", "key", "n"])

    grams = map_arrow(sample, run, "lang string, fold int, key long, n long").groupBy("lang", "fold", "key").agg(F.sum("n").alias("n")).toArrow()
    lang, fold, key, n = (grams.column(c).to_numpy() for c in ("lang", "fold", "key", "n"))

    def model(rows: np.ndarray) -> Model:
        """Of these rows of the counts; the folds' counts of a context add up."""
        of = {}
        for x in set(lang[rows].tolist()):
            own = rows & (lang == x)
            keys, at = np.unique(key[own], return_inverse=True)
            of[str(x)] = (keys, np.bincount(at, weights=n[own]).astype(np.int64))
        return build(of)

    whole = model(np.ones(len(lang), bool))
    if calibrate:
        whole.limits = _limits(sample, [model(fold != k) for k in (0, 1)])
    return whole


def _limits(sample: DataFrame, without: list[Model]) -> dict[str, float]:
    """Bits a byte that a text of each language may cost, from models that left a fold out."""
    shared = sample.sparkSession.sparkContext.broadcast(without)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = [Coder(m) for m in shared.value]
        for part in text_chunks(batches, "text"):
            names, folds = part.column("lang").to_pylist(), part.column("fold").to_pylist()
            texts = part.column("text").cast(pa.binary()).to_pylist()
            bits = [m.lengths(texts) for m in coders]
            out = [(x, bits[k][i, shared.value[k].languages.index(x)] / len(t)) for i, (x, k, t) in enumerate(zip(names, folds, texts, strict=True)) if t and x in shared.value[k].languages]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.string()), pa.array([v for _, v in out], pa.float64())], ["lang", "bits"])

    cost: dict[str, list[float]] = {}
    for r in map_arrow(sample, run, "lang string, bits double").collect():
        cost.setdefault(r.lang, []).append(r.bits)
    return {x: MARGIN * float(np.quantile(v, 0.9)) for x, v in cost.items()}


def _judge(coder: Coder, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and bits a byte of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    model, length = coder.model, coder.lengths(raw)
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    best = length.argmin(axis=1)
    least = length.min(axis=1)
    score = 1 / np.exp2(np.maximum(least[:, None] - length, -1000.0)).sum(axis=1)
    ok = np.array([bool(t) and LETTER.search(t) is not None for t in texts], bool)
    per_byte = least / np.maximum([len(t) for t in raw], 1)
    return [model.languages[b] if k else "und" for b, k in zip(best, ok, strict=True)], np.where(ok, score, 0.0), per_byte


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score, bits_per_byte) for every row; no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for part in text_chunks(batches, "text"):
            lang, score, per_byte = _judge(coder, part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(lang, pa.string()), pa.array(score), pa.array(per_byte)], schema.names)

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, schema)
    return out.withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that have a language with a score of `least` or more
    and cost no more bits than its limit allows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(shared.value)
        for part in text_chunks(batches, text_col):
            texts = part.column(text_col).to_pylist()
            lang, score, per_byte = _judge(coder, texts)
            size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts])
            spare = size * np.array([shared.value.limits.get(x, np.inf) for x in lang]) + SLACK if len(texts) else size
            yield part.filter(pa.array([x != "und" and s >= least and fits for x, s, fits in zip(lang, score, per_byte * size <= spare, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def held_out(id_col: str | Column = "doc_id") -> Column:
    """Rows that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
