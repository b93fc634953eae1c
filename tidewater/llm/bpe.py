"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

Every match of the pre-tokeniser pattern is encoded alone. A segment tree over
its byte positions stores, in each node, the leftmost minimum of the ranks of
the pairs that start in the node's range; the root names the next merge. A merge
changes the pair at the merged position, the pair of its live left neighbour and
retires the right part: three point updates of logarithmic cost.

Short pieces run many trees side by side as the rows of one array; a longer
piece has a tree of its own. Encodings of pieces are kept in a per-task table
that is emptied at a fixed number of entries, so memory stays bounded and the
result doesn't depend on it.

Defined results: a null or empty text has no ids and decodes to no bytes; the
order and number of rows are kept, repeated rows give repeated results; columns
other than the id and the text aren't read.
"""

from __future__ import annotations

import base64
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.llm.common import map_arrow, text_chunks

#: Pieces of up to this many bytes share an array of trees.
SHORT = 64
#: Entries of a worker's table of encoded pieces; beyond it the table starts anew.
MEMO = 1 << 18
#: Trees that run side by side.
LANES = 1 << 12


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file: base64 of a token's bytes, a space, its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class SegmentTreeBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        self.top = max(ranks.values(), default=0) + 1
        missing = [i for i in range(256) if bytes([i]) not in ranks]
        if missing:
            raise ValueError(f"the ranks lack {len(missing)} single bytes")
        self.first = np.array([ranks[bytes([i])] for i in range(256)], np.int64)
        pairs = [
            (left * self.top + right, rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None and (right := ranks.get(token[cut:])) is not None
        ]
        table = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = table[:, 0].copy(), table[:, 1].copy()
        self.token: list[bytes | None] = [None] * self.top
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [str(i) for i in range(self.top)]
        #: pieces and their ids as little-endian 32-bit integers
        self.memo: dict[str, bytes] = {}

    # one tree

    def encode_long(self, piece: bytes) -> list[int]:
        """One piece with a tree of its own; O(n log n)."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = self.top * size
        token: list[int] = [int(self.first[b]) for b in piece]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * size)
        of, rank_of = self.token, self.ranks.get
        for i in range(n - 1):
            rank = rank_of(of[token[i]] + of[token[i + 1]])
            if rank is not None:
                tree[size + i] = rank * size + i
        for i in range(size - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])

        def put(i: int) -> None:
            j = after[i]
            rank = rank_of(of[token[i]] + of[token[j]]) if token[i] >= 0 and j < n else None
            node = size + i
            tree[node] = none if rank is None else rank * size + i
            while node > 1:
                node >>= 1
                least = min(tree[2 * node], tree[2 * node + 1])
                if tree[node] == least:
                    break
                tree[node] = least

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            token[i], token[j] = rank, -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j)
            put(i)
            if before[i] >= 0:
                put(before[i])
        return [t for t in token if t >= 0]

    # many trees

    def _rank(self, left: np.ndarray, right: np.ndarray, ok: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens; `top` where there is none."""
        keys = left * self.top + right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), max(len(self.pair_keys) - 1, 0))
        if not len(self.pair_keys):
            return np.full(len(keys), self.top, np.int64)
        return np.where(ok & (self.pair_keys[at] == keys), self.pair_ranks[at], self.top)

    def encode_short(self, pieces: list[bytes]) -> list[bytes]:
        """Pieces of 2 to SHORT bytes, one row of the array each; ids as in the table."""
        n = np.array([len(p) for p in pieces], np.int64)
        size = 1 << max(1, int(n.max() - 1).bit_length())
        rows = len(pieces)
        raw = np.zeros((rows, size), np.uint8)
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        inside = np.arange(size) < n[:, None]
        raw[inside] = flat
        token = self.first[raw]
        token[~inside] = -1
        after = np.broadcast_to(np.arange(1, size + 1), (rows, size)).copy()
        before = np.broadcast_to(np.arange(-1, size - 1), (rows, size)).copy()
        none = self.top * size
        tree = np.full((rows, 2 * size), none, np.int64)
        ok = (np.arange(1, size + 1) < n[:, None])[:, : size - 1]
        ranks = self._rank(token[:, :-1].ravel(), token[:, 1:].ravel(), ok.ravel()).reshape(rows, size - 1)
        place = np.arange(size - 1)
        tree[:, size : 2 * size - 1] = np.where(ranks < self.top, ranks * size + place, none)
        level = size
        while level > 1:
            half = level >> 1
            tree[:, half:level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level = half
        live = np.flatnonzero(tree[:, 1] < none)
        while len(live):
            rank, i = np.divmod(tree[live, 1], size)
            j = after[live, i]
            token[live, i] = rank
            token[live, j] = -1
            k = after[live, j]
            after[live, i] = k
            has_next = k < n[live]
            before[live[has_next], k[has_next]] = i[has_next]
            self._update(tree, live, j, np.full(len(live), none, np.int64), size)
            right = np.where(has_next, token[live, np.minimum(k, size - 1)], 0)
            found = self._rank(rank, right, has_next)
            self._update(tree, live, i, np.where(found < self.top, found * size + i, none), size)
            h = before[live, i]
            has_left = h >= 0
            if has_left.any():
                who, h2 = live[has_left], h[has_left]
                found = self._rank(token[who, h2], rank[has_left], np.ones(len(who), bool))
                self._update(tree, who, h2, np.where(found < self.top, found * size + h2, none), size)
            live = live[tree[live, 1] < none]
        kept = token >= 0
        ids, ends = token[kept].astype("<i4").tobytes(), (4 * np.cumsum(kept.sum(axis=1))).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    @staticmethod
    def _update(tree: np.ndarray, rows: np.ndarray, place: np.ndarray, value: np.ndarray, size: int) -> None:
        """Set one leaf of each row's tree and the nodes above it."""
        node = place + size
        tree[rows, node] = value
        while size > 1:
            node >>= 1
            tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            size >>= 1

    # texts

    def learn(self, pieces: set[str]) -> None:
        """Put the encodings of these pieces into the table."""
        if len(self.memo) + len(pieces) > MEMO:
            self.memo.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces:
            if piece in self.memo:
                continue
            raw = piece.encode("utf-8", "surrogatepass")
            whole = self.ranks.get(raw)
            if whole is not None:
                self.memo[piece] = whole.to_bytes(4, "little")
            elif len(raw) > SHORT:
                self.memo[piece] = np.array(self.encode_long(raw), "<i4").tobytes()
            else:
                by_size.setdefault((len(raw) - 1).bit_length(), []).append((piece, raw))
        for group in by_size.values():
            for at in range(0, len(group), LANES):
                part = group[at : at + LANES]
                for (piece, _), ids in zip(part, self.encode_short([raw for _, raw in part]), strict=True):
                    self.memo[piece] = ids

    def encode_texts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        cut = [self.pattern.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(cut)))
        return [np.frombuffer(b"".join(map(self.memo.__getitem__, pieces)), "<i4") for pieces in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids."""
        return b"".join(map(self.token.__getitem__, ids.tolist()))

    def text_of(self, ids: np.ndarray) -> str:
        """The ids as decimal numbers, joined by commas."""
        return ",".join(map(self.decimal.__getitem__, ids.tolist()))


#: The encoder that a Python worker holds from one task to the next, by the call that made it.
_held: dict[str, SegmentTreeBpe] = {}


def _encoder(call: str, ranks: dict[bytes, int], pattern: str) -> SegmentTreeBpe:
    if call not in _held:
        _held.clear()
        _held[call] = SegmentTreeBpe(ranks, pattern)
    return _held[call]


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_decoded: bool = False,
    with_text: bool = False,
) -> DataFrame:
    """(id, ids array<int>[, decoded binary][, ids_text]) for every row of docs;
    ids_text has the ids as decimal numbers, joined by commas.

    The rank file is read on the driver and broadcast; its size is that of the
    vocabulary. No shuffle: the work follows the input's splits.
    """
    spark = docs.sparkSession
    table, call = spark.sparkContext.broadcast((read_ranks(ranks_path), pattern)), uuid.uuid4().hex
    fields = [T.StructField("id", docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if with_decoded:
        fields.append(T.StructField("decoded", T.BinaryType()))
    if with_text:
        fields.append(T.StructField("ids_text", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _encoder(call, *table.value)
        for part in text_chunks(batches, "text"):
            ids = bpe.encode_texts(part.column("text").to_pylist())
            ends, flat = np.cumsum([0, *map(len, ids)]), np.concatenate(ids)
            columns = [part.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            names = ["id", "ids"]
            if with_decoded:
                columns.append(pa.array([bpe.decode(x) for x in ids], pa.binary()))
                names.append("decoded")
            if with_text:
                columns.append(pa.array([bpe.text_of(x) for x in ids], pa.string()))
                names.append("ids_text")
            yield pa.RecordBatch.from_arrays(columns, names)

    out = map_arrow(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, T.StructType(fields))
    return out.withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ranks_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """encoded with the bytes of its ids beside them; null ids decode to null."""
    table = encoded.sparkSession.sparkContext.broadcast({i: b for b, i in read_ranks(ranks_path).items()})
    schema = T.StructType([f for f in encoded.schema if f.name != out_col] + [T.StructField(out_col, T.BinaryType())])
    keep = [f.name for f in schema][:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = table.value.__getitem__
        for batch in batches:
            raw = [None if x is None else b"".join(map(get, x)) for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(raw, pa.binary())], [*keep, out_col])

    return map_arrow(encoded, run, schema)


def digests(encoded: DataFrame, id_col: str = "doc_id", extra: list[str] | None = None) -> DataFrame:
    """Count and SHA-256 digests of what encode(with_decoded=True) returns. With ids_text
    the JVM hashes that instead of making a string of each id, which fills its heap."""
    text = F.col("ids_text") if "ids_text" in encoded.columns else F.array_join(F.col("ids").cast("array<string>"), ",")
    return encoded.select(
        id_col,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(text.cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *(extra or []),
    )
