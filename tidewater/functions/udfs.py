"""The few functions that expressions can't say, as Arrow-batched pandas functions, and
the extension points for models and parsers."""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.session import ship_package

SEPARATORS = ("\n\n", "\n", " ", "")


def _vectorised(run: Callable, kind: T.DataType, *columns: Column) -> Column:
    """A pandas function over columns, with this package at hand on the executors."""
    ship_package(SparkSession.active())
    return F.pandas_udf(run, kind)(*columns)


def split_recursively(text: str, size: int, overlap: int, separators: Sequence[str] = SEPARATORS) -> list[str]:
    """Chunks of at most `size` characters, cut at the coarsest separator that fits; a chunk
    begins with the last pieces of the one before, up to `overlap` characters."""
    if len(text) <= size:
        return [text] if text.strip() else []
    here = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(here) + 1 :] if here in separators else ()
    pieces = list(text) if here == "" else text.split(here)
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        chunk = here.join(held).strip()
        if chunk:
            out.append(chunk)

    for piece in pieces:
        if len(piece) > size:
            if held:
                flush()
                held = []
            out += split_recursively(piece, size, overlap, finer or ("",))
            continue
        if held and len(here.join([*held, piece])) > size:
            flush()
            while held and (len(here.join(held)) > overlap or len(here.join([*held, piece])) > size):
                held.pop(0)
        held.append(piece)
    if held:
        flush()
    return out


def recursive_chunks(x: Column, size: int = 800, overlap: int = 200) -> Column:
    """split_recursively() of a column; null has no chunks."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t, size, overlap) if t else [])

    return _vectorised(run, T.ArrayType(T.StringType()), x)


def sequence_ratio(a: Column, b: Column) -> Column:
    """Ratio of matching blocks of two texts; null if either is null."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(xs, ys, strict=True)], dtype="float64")

    return _vectorised(run, T.DoubleType(), a, b)


def name_ratios(a: str, b: str) -> tuple[float, float, float]:
    """Of two names: the ratio of matching blocks; that of their sorted words; and the best
    ratio of the shorter one with a part of the other that is as long and lies at a matching
    block. The last two are rounded to hundredths."""
    whole = difflib.SequenceMatcher(None, a, b).ratio()
    x, y = (" ".join(sorted(re.sub(r"\W|_", " ", v.lower()).split())) for v in (a, b))
    by_words = round(100 * difflib.SequenceMatcher(None, x, y).ratio()) / 100 if x and y else 0.0
    short, long = sorted((a, b), key=len)
    part = 0.0
    for m in difflib.SequenceMatcher(None, short, long).get_matching_blocks() if short else ():
        start = max(m.b - m.a, 0)
        part = max(part, difflib.SequenceMatcher(None, short, long[start : start + len(short)]).ratio())
    return whole, by_words, 1.0 if part > 0.995 else round(100 * part) / 100


def name_similarity(a: Column, b: Column) -> Column:
    """struct<words, similarity>: the ratio of sorted words, and 0.4 ratio + 0.4 ratio of sorted words + 0.2 best part."""

    def run(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = [name_ratios(x or "", y or "") for x, y in zip(xs, ys, strict=True)]
        return pd.DataFrame({"words": [w for _, w, _ in rows], "similarity": [0.4 * r + 0.4 * w + 0.2 * p for r, w, p in rows]}, dtype="float64")

    return _vectorised(run, T.StructType([T.StructField("words", T.DoubleType()), T.StructField("similarity", T.DoubleType())]), a, b)


def first_object(text: str | None) -> str | None:
    """The first balanced {...} of a text; braces in strings don't count."""
    if not text or "{" not in text:
        return None
    start, depth, quoted, escaped = text.index("{"), 0, False, False
    for i in range(start, len(text)):
        c = text[i]
        if quoted:
            quoted, escaped = escaped or c != '"', c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if not depth:
                return text[start : i + 1]
    return None


def balanced_json(x: Column) -> Column:
    """first_object() of a column."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(first_object)

    return _vectorised(run, T.StringType(), x)


class Registry:
    """Named column functions: parsers of pages, extractors, re-rankers, handlers."""

    def __init__(self) -> None:
        self._known: dict[str, Callable] = {}

    def register(self, name: str, function: Callable) -> None:
        self._known[name] = function

    def __getitem__(self, name: str) -> Callable:
        return self._known[name]

    def names(self) -> list[str]:
        return sorted(self._known)


parsers, extractors, rerankers = Registry(), Registry(), Registry()
