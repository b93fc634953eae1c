"""Quality rules as a short-circuit cascade.

profile() runs every rule alone on a sample, which gives the share of documents that it
rejects, and prices it: what it reads of the sample (bytes, words, lines) times the time
that a unit of it takes. order() puts the rule with the most rejections per cost first.
run() applies the rules to each whole text in that order and stops at the first that
rejects; what rules share (words, lines) is worked out once and only when a rule asks
for it. A document is kept if no rule rejects it, so the order changes the cost, the
number of rules tried and the name of the rejecting rule, never the verdict.

Unit times are fixed parameters, measured once, not clocked in each run: so a job gives
the same names whatever executors it lost or how busy they were.

The sample is drawn by the MD5 of the id, at a rate that gives SAMPLE rows on average,
so copies of a text are drawn one by one; only sums over it reach the driver.

Defined results: a null text is a text without words, which the rule for few words
rejects; rows are kept in number; rows with one id are drawn together, null is an id;
a table without rows is profiled as all ties, which go by name. Other columns aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_arrow, text_chunks

#: Rows of the sample, on average.
SAMPLE = 1000
BLANKS = b"\x20\t\n\x0b\x0c\r"
REST_OF_CHARACTER = bytes(range(0x80, 0xC0))
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(0x41, 0x5B))
LETTERS = CAPITALS + bytes(range(0x61, 0x7B))


class Text:
    """Measures of one text, each worked out when first asked for."""

    def __init__(self, raw: bytes | None):
        self.raw = raw or b""

    def _count(self, of: bytes) -> int:
        return len(self.raw) - len(self.raw.translate(None, of))

    @cached_property
    def words(self) -> list[bytes]:
        return self.raw.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(self.raw.translate(None, BLANKS + REST_OF_CHARACTER))

    @cached_property
    def n_symbols(self) -> int:
        return self._count(SYMBOLS)

    @cached_property
    def n_bangs(self) -> int:
        return self.raw.count(b"!")

    @cached_property
    def n_capitals(self) -> int:
        return self._count(CAPITALS)

    @cached_property
    def n_letters(self) -> int:
        return self._count(LETTERS)

    @cached_property
    def lines(self) -> list[bytes]:
        """Lines with a word."""
        return [line for line in self.raw.split(b"\n") if line.strip()]

    @cached_property
    def n_lines(self) -> int:
        return len(self.lines)

    @cached_property
    def n_dup_lines(self) -> int:
        return self.n_lines - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in windows of three words that occur twice or more, the first included."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        twice = [times[x] > 1 for x in windows]
        no = [False]
        return sum(a or b or c for a, b, c in zip(no * 2 + twice, no + twice + no, twice + no * 2, strict=True))


@dataclass(frozen=True)
class Rule:
    """A rule and the nanoseconds that it takes for each byte, word and line of a text."""

    name: str
    rejects: Callable[[Text], bool]
    per_byte: int = 0
    per_word: int = 0
    per_line: int = 0


#: The base rules of the query and rules for other junk. All compare integers. Times were
#: measured over sf0.1: 150 ns a word to split, 4 a byte to count characters, 2 to count
#: one, 620 a word for windows, 1100 a line to split lines and 650 to compare them.
BASE_RULES = (
    Rule("few_words", lambda t: t.n_words < 50, per_word=150),
    Rule("repeated_words", lambda t: 100 * t.n_repeat_words > 50 * t.n_words, per_word=770),
)
RULES = (
    *BASE_RULES,
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words, per_byte=4, per_word=150),
    Rule("repeated_lines", lambda t: 2 * t.n_dup_lines > t.n_lines, per_line=1750),
    Rule("short_words", lambda t: t.word_chars < 2 * t.n_words, per_byte=7, per_word=150),
    Rule("long_words", lambda t: t.word_chars > 15 * t.n_words, per_byte=7, per_word=150),
    Rule("capitals", lambda t: 2 * t.n_capitals > t.n_letters, per_byte=11),
    Rule("bangs", lambda t: 2 * t.n_bangs > t.n_words, per_byte=2, per_word=150),
)


@dataclass(frozen=True)
class Profile:
    """What a rule costs and rejects on the sample."""

    name: str
    rows: int
    rejected: int
    nanoseconds: int

    @property
    def rank(self) -> float:
        """Rejected documents for each nanosecond."""
        return self.rejected / max(self.nanoseconds, 1)


def profile(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> list[Profile]:
    """Each rule alone on the sample; one row for each rule reaches the driver."""
    share = min(1.0, sample / max(docs.count(), 1))
    place = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    drawn = docs.filter(place < round(share * (1 << 32))).select(F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            texts = [Text(t) for t in part.column("text").cast(pa.binary()).to_pylist()]
            read = [sum(len(t.raw) for t in texts), sum(t.n_words for t in texts), sum(t.n_lines for t in texts)]
            out = [(r.name, len(texts), sum(map(r.rejects, texts)), r.per_byte * read[0] + r.per_word * read[1] + r.per_line * read[2]) for r in rules]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["name", "rows", "rejected", "ns"])

    seen = map_arrow(drawn, run, "name string, rows long, rejected long, ns long").groupBy("name").agg(F.sum("rows"), F.sum("rejected"), F.sum("ns"))
    by_name = {r[0]: Profile(*r) for r in seen.collect()}
    return [by_name.get(r.name, Profile(r.name, 0, 0, 0)) for r in rules]


def order(rules: tuple[Rule, ...], profiles: list[Profile]) -> tuple[Rule, ...]:
    """Most rejections per cost first; ties by name."""
    rank = {p.name: p.rank for p in profiles}
    return tuple(sorted(rules, key=lambda r: (-rank.get(r.name, 0.0), r.name)))


def first_rejection(text: Text, ordered: tuple[Rule, ...]) -> tuple[str | None, int]:
    """The name of the first rule that rejects the text, and the number of rules tried."""
    for tried, rule in enumerate(ordered, 1):
        if rule.rejects(text):
            return rule.name, tried
    return None, len(ordered)


def run(
    docs: DataFrame, ordered: tuple[Rule, ...], measures: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, kept, rejected_by, n_tried[, measures]) for every row; no shuffle.

    measures: names of integer measures of Text to return for every document, also
    for those that a rule rejected before they were needed.
    """
    measures = measures or []
    schema = T.StructType(
        [T.StructField("id", docs.schema[id_col].dataType), T.StructField("kept", T.BooleanType()), T.StructField("rejected_by", T.StringType()), T.StructField("n_tried", T.LongType())]
        + [T.StructField(m, T.LongType()) for m in measures]
    )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, "text"):
            by, tried, values = [], [], []
            for raw in part.column("text").cast(pa.binary()).to_pylist():
                text = Text(raw)
                name, n = first_rejection(text, ordered)
                by.append(name)
                tried.append(n)
                values.append([getattr(text, m) for m in measures])
            columns = [pa.array(list(x), pa.int64()) for x in zip(*values, strict=True)] if measures else []
            kept = pa.array([x is None for x in by], pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column("id"), kept, pa.array(by, pa.string()), pa.array(tried, pa.int64()), *columns], schema.names)

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), each, schema)
    return out.withColumnRenamed("id", id_col)
