"""Secret scans over an incremental blob ledger.

A version of a file is a path and a text. Its blob is the SHA-256 of the text's
UTF-8 bytes, so equal texts, wherever and whenever they occur, are one blob. The
ledger has one row for each scan of a blob: the rule versions that were run and
the spans they found. update() scans only (blob, rule version) pairs that no row
has, appends one row for each blob it scanned, and on_paths() joins the spans back
to every path. Texts whose blob was scanned before aren't moved again. A row appears together with its spans or not at all, so a job that
dies leaves no pair marked as scanned without its findings.

Defined results: a null text is the empty text; paths may be null or repeated,
each row gets its findings; an empty table gives none. Spans count code points,
the end is exclusive. A column that isn't a path or the text isn't read.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import bit_map, map_arrow, probe, stored, text_chunks
from tidewater.session import shared_folder

SPANS = "array<struct<start:int,rank:int,kind:string,stop:int>>"
LEDGER = f"blob binary, rules array<string>, spans {SPANS}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `version` changes whenever `find` can give other spans."""

    kind: str
    version: int
    find: Callable[[str], list[tuple[int, int]]]

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


_ASSIGN = re.compile(
    r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----)?")
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_FORGE = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")


def _assign(text: str) -> list[tuple[int, int]]:
    low = text.lower()
    if not any(word in low for word in ("passw", "secret", "token", "api")):
        return []
    # a match whose value is too short still takes its characters
    return [m.span() for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]


def _access(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _ACCESS.finditer(text) if len(m[0]) >= 18] if "AKIA" in text else []


def _hex(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _HEX.finditer(text)]


def _jwt(text: str) -> list[tuple[int, int]]:
    """eyJ and 8 or more characters of a run, a dot, a run of 8 or more, a dot and a run.

    The last character before a dot ends its run, so only the first eyJ of a run can
    start a match: every run is walked over a bounded number of times.
    """
    out, at = [], text.find("eyJ")
    while at >= 0:
        end = _RUN.match(text, at).end()
        if end - at >= 11 and text[end : end + 1] == ".":
            second = _RUN.match(text, end + 1).end()
            if second - end > 8 and text[second : second + 1] == ".":
                third = _RUN.match(text, second + 1).end()
                if third > second + 1:
                    out.append((at, third))
                    end = third
        at = text.find("eyJ", end)
    return out


def _containing(hint: str, pattern: re.Pattern) -> Callable[[str], list[tuple[int, int]]]:
    return lambda text: [m.span() for m in pattern.finditer(text)] if hint in text else []


#: In the order in which spans that start together are listed.
BASE_RULES = (Rule("assign", 1, _assign), Rule("access", 1, _access), Rule("hex", 1, _hex))
RULES = (
    *BASE_RULES,
    Rule("pem", 1, _containing("-----BEGIN ", _PEM)),
    Rule("jwt", 1, _jwt),
    Rule("forge", 1, _containing("gh", _FORGE)),
)


def blob_of(text: Column) -> Column:
    """The content address of a text."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


class Ledger:
    """The scans that were made, in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"

    def exists(self) -> bool:
        """Whether any scan was made; one that died before its end left no row."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return fs.exists(path) and any(not s.getPath().getName().startswith(("_", ".")) for s in fs.listStatus(path))

    def rows(self) -> DataFrame:
        if not self.exists():
            return self.spark.createDataFrame([], LEDGER)
        return self.spark.read.schema(LEDGER).parquet(self.folder)

    def unseen(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
        """(blob, text, rules): each blob of versions that lacks a scan by some rule version.

        What is unseen is found by content addresses alone. Then only texts that a bit
        map of the unseen addresses can't clear are moved, so a version that brings
        little news moves little text. Equal texts meet in the map-side part of the
        aggregation, so a blob with any number of paths sends one row from each map task.
        """
        address = blob_of(F.col(text_col)).alias("blob")
        wanted = F.array(*[F.lit(r.key) for r in rules]).cast("array<string>")
        blobs = versions.select(address, F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        if not self.exists():
            return blobs.dropDuplicates(["blob"]).withColumn("rules", wanted)
        done = self.rows().groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("done"))
        todo = versions.select(address).distinct().join(done, "blob", "left")
        todo = todo.select(F.col("blob").alias("new"), F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>"))).alias("rules"))
        todo = stored(todo.filter(F.size("rules") > 0), "unseen")
        maybe = probe(blobs, "blob", bit_map(todo, "new")).filter("_may").drop("_may").dropDuplicates(["blob"])
        return maybe.join(todo, F.col("blob") == F.col("new")).select("blob", "text", "rules")

    def update(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> None:
        """Scan what hasn't been scanned and append it."""
        by_key = {r.key: (rank, r) for rank, r in enumerate(rules)}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            schema = pa.schema(
                [
                    ("blob", pa.binary()),
                    ("rules", pa.list_(pa.string())),
                    ("spans", pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("kind", pa.string()), ("stop", pa.int32())]))),
                ]
            )
            for part in text_chunks(batches, "text"):
                todo, spans = part.column("rules").to_pylist(), []
                for text, keys in zip(part.column("text").to_pylist(), todo, strict=True):
                    found = [(a, by_key[k][0], by_key[k][1].kind, b) for k in keys for a, b in by_key[k][1].find(text)]
                    spans.append([dict(zip(("start", "rank", "kind", "stop"), x, strict=True)) for x in sorted(found)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("blob").cast(pa.binary()), pa.array(todo, schema.field("rules").type), pa.array(spans, schema.field("spans").type)], schema=schema
                )

        map_arrow(self.unseen(versions, rules, text_col), run, LEDGER).write.mode("append").parquet(self.folder)

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """(found, spans): each blob's spans of these rule versions, by start, then rule.

        A blob that was scanned twice, by two appends at one time, has each span once."""
        now = {r.key: rank for rank, r in enumerate(rules)}
        kinds = F.create_map(*[F.lit(v) for key, rank in now.items() for v in (key.rpartition("@")[0], rank)])
        wanted = F.array(*[F.lit(k) for k in now])
        current = self.rows().select("blob", F.array_intersect("rules", wanted).alias("rules"), "spans").filter(F.size("rules") > 0)
        names = F.transform("rules", lambda k: F.substring_index(k, "@", 1))
        own = F.filter("spans", lambda s: F.array_contains(names, s["kind"]))
        own = F.transform(own, lambda s: F.struct(s["start"].alias("start"), kinds[s["kind"]].alias("rank"), s["kind"].alias("kind"), s["stop"].alias("stop")))
        return current.select(F.col("blob").alias("found"), own.alias("spans")).groupBy("found").agg(
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).cast(SPANS).alias("spans")
        )

    def on_paths(self, versions: DataFrame, paths: list[str], rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
        """The path columns of each row of versions with its spans; rows that were never scanned have none."""
        rows = versions.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(paths)], blob_of(F.col(text_col)).alias("blob"))
        # a table of its own: behind an aggregation, adaptive execution couldn't split a hot blob
        found = stored(self.findings(rules).filter(F.size("spans") > 0), "findings")
        return rows.join(found, F.col("blob") == F.col("found"), "left").select(
            *[F.col(f"_p{i}").alias(p) for i, p in enumerate(paths)], F.coalesce("spans", F.array().cast(SPANS)).alias("spans")
        )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def redact(docs: DataFrame, ledger: Ledger, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with each run of overlapping or touching spans replaced by the mask.

    A column n_chars follows the new text; all other values stay.
    """
    schema = docs.schema
    keyed = docs.withColumn("_blob", blob_of(F.col(text_col)))
    found = stored(ledger.findings(rules).filter(F.size("spans") > 0), "findings").select("found", F.col("spans").alias("_spans"))
    # documents whose blob certainly has no finding stay where they are
    probed = probe(keyed, "_blob", bit_map(found, "found"))
    joined = probed.filter("_may").drop("_may").join(found, F.col("_blob") == F.col("found"), "left").drop("_blob", "found")

    def cut(text: str, spans: list[dict]) -> str:
        out, at, end = [], 0, -1
        for s in spans:
            if s["start"] > end:
                out += [text[at : s["start"]], mask] if end < 0 or s["start"] > end else []
            end = max(end, s["stop"])
            at = end
        return "".join(out) + text[at:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_chunks(batches, text_col):
            spans = part.column("_spans").to_pylist()
            columns = {f.name: part.column(f.name) for f in schema}
            if any(spans):
                texts = [cut(t, s) if s else t for t, s in zip(part.column(text_col).to_pylist(), spans, strict=True)]
                columns[text_col] = pa.array(texts, columns[text_col].type)
                if "n_chars" in columns:
                    old = columns["n_chars"]
                    new = [len(t) if s else n for t, s, n in zip(texts, spans, old.to_pylist(), strict=True)]
                    columns["n_chars"] = pa.array(new, old.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return probed.filter("not _may").select(*schema.names).unionByName(map_arrow(joined, run, schema))
