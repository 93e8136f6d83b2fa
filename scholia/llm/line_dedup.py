"""Line deduplication by levelled sorted runs of line hashes.

A line's key is the line, stripped of ASCII white space at both ends, A-Z in lower case. Keys found in
`least` documents or more lose all their lines in every document.

Runs hold (key's 128-bit hash, number of documents), sorted by hash. The corpus comes in batches. A batch's
keys are counted, the keys already known to be over the limit are merge-anti-joined away (their counting is
over), and the rest is added as a sorted run of level 0. When a level has FANOUT runs, they are compacted into
one run of the next level; keys whose count reaches the limit then move to the full runs. The last compaction
merges all levels; the full runs then hold exactly the keys found in `least` documents.

Keys found so often come back to the documents in one of two ways, by their number: up to KEYS_TO_SEND
(16 bytes each) they are sent to every task and no text is shuffled; beyond that, each document's keys are
joined with them and its list of doomed keys is joined to it by doc_id.

Null and empty texts are one empty line, which has no key. A row is a document, also where doc_id repeats.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import textnum as T
from scholia.llm.tables import fresh, written

LEAST, BATCHES, FANOUT, KEYS_TO_SEND = 10, 4, 2, 500_000
_SPACE = b" \t\n\r\x0b\x0c"
_PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])


def line_keys(text: bytes) -> tuple[list[bytes], np.ndarray]:
    """The lines and their 128-bit hashes; (0, 0) where the key is empty."""
    import xxhash

    lines = text.split(b"\n")
    raw = b"".join(xxhash.xxh3_128_digest(key) if (key := x.strip(_SPACE).lower()) else b"\0" * 16 for x in lines)
    return lines, np.frombuffer(raw, _PAIR)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.unique(keys)
    return keys[(keys["a"] != 0) | (keys["b"] != 0)]


class SortedRuns:
    """Levelled runs in the shared folder."""

    def __init__(self, least: int, fanout: int = FANOUT) -> None:
        self.least, self.fanout = least, fanout
        self.levels: dict[int, list[DataFrame]] = {}
        self.full: list[DataFrame] = []

    @staticmethod
    def _sorted(df: DataFrame) -> DataFrame:
        return df.sortWithinPartitions("a", "b")

    @staticmethod
    def _all(runs: list[DataFrame]) -> DataFrame:
        out = runs[0]
        for r in runs[1:]:
            out = out.unionByName(r)
        return out

    def add(self, counts: DataFrame) -> None:
        """counts: (a, b, n), a row for each key."""
        if self.full:
            counts = counts.join(self._all(self.full).hint("merge"), ["a", "b"], "left_anti")
        self._put(0, counts)

    def _put(self, level: int, run: DataFrame) -> None:
        self.levels.setdefault(level, []).append(written(self._sorted(run), f"run{level}"))
        while len(self.levels.get(level, ())) >= self.fanout:
            self._compact([level], level + 1)
            level += 1

    def _compact(self, levels: list[int], to: int) -> None:
        runs = [r for x in levels for r in self.levels.pop(x, [])]
        if not runs:
            return
        merged = written(self._sorted(self._all(runs).groupBy("a", "b").agg(F.sum("n").alias("n"))), "merged") if len(runs) > 1 else runs[0]
        self.full.append(merged.where(F.col("n") >= self.least))
        self.levels.setdefault(to, []).append(merged.where(F.col("n") < self.least))

    def close(self) -> DataFrame:
        """All keys found often enough: (a, b)."""
        if self.levels:
            self._compact(sorted(self.levels), max(self.levels) + 1)
        return self._all(self.full).select("a", "b")


def counted(docs: DataFrame, text: str, batches: int) -> DataFrame:
    """(a, b, n, batch): documents by key, summed over each Arrow batch; tasks are dealt to batches."""

    def count(rows):
        from pyspark import TaskContext

        batch = TaskContext.get().partitionId() % batches
        for r in rows:
            keys = [_distinct(line_keys(x)[1]) for x in T.as_bytes(r.column(0))]
            keys, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, _PAIR), np.zeros(0, int))
            yield pa.RecordBatch.from_arrays([pa.array(keys["a"].copy()), pa.array(keys["b"].copy()), pa.array(n), pa.array(np.full(len(n), batch, np.int32))], names=["a", "b", "n", "batch"])

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(count, "a bigint, b bigint, n bigint, batch int")


def frequent_keys(docs: DataFrame, text: str = "text", least: int = LEAST, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """(a, b): the hashes of the keys found in `least` documents or more."""
    rows = written(counted(docs, text, batches), "lines")
    runs = SortedRuns(least, fanout)
    for k in range(batches):
        runs.add(rows.where(F.col("batch") == k).groupBy("a", "b").agg(F.sum("n").alias("n")))
    return runs.close()


_KIND = pa.struct([("kept_text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
SCHEMA = "kept_text string, n_lines bigint, n_dropped bigint"


def _kept(text: bytes, doomed: np.ndarray) -> dict:
    """doomed: sorted."""
    lines, keys = line_keys(text)
    if len(doomed):
        drop = doomed[np.minimum(np.searchsorted(doomed, keys), len(doomed) - 1)] == keys
    else:
        drop = np.zeros(len(lines), bool)
    kept = text if not drop.any() else b"\n".join(x for x, gone in zip(lines, drop, strict=True) if not gone)
    return {"kept_text": kept.decode("utf-8", "replace"), "n_lines": len(lines), "n_dropped": int(drop.sum())}


def line_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", least: int = LEAST, batches: int = BATCHES, keys_to_send: int = KEYS_TO_SEND, into: str = "lines") -> DataFrame:
    """All columns of docs and the struct `into` (SCHEMA), which replaces a column of that name."""
    doomed = written(frequent_keys(docs, text, least, batches), "frequent")
    raw = F.col(text).cast("binary")
    if doomed.limit(keys_to_send + 1).count() <= keys_to_send:
        table = doomed.toArrow()
        keys = np.zeros(table.num_rows, _PAIR)
        keys["a"], keys["b"] = table["a"].to_numpy(), table["b"].to_numpy()
        sent = docs.sparkSession.sparkContext.broadcast(np.sort(keys))

        def with_all(column: pa.Array) -> pa.Array:
            return pa.array([_kept(x, sent.value) for x in T.as_bytes(column)], _KIND)

        return docs.withColumn(into, F.arrow_udf(with_all, SCHEMA)(raw))

    def hashes(column: pa.Array) -> pa.Array:
        out = [_distinct(line_keys(x)[1]) for x in T.as_bytes(column)]
        return pa.array([[{"a": int(a), "b": int(b)} for a, b in x] for x in out], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))

    def with_own(column: pa.Array, own: pa.Array) -> pa.Array:
        out = []
        for x, keys in zip(T.as_bytes(column), own.to_pylist(), strict=True):
            out.append(_kept(x, np.sort(np.array([(k["a"], k["b"]) for k in keys or ()], _PAIR))))
        return pa.array(out, _KIND)

    doc, own = fresh(docs, "_doc"), fresh(docs, "_own")
    pairs = docs.select(F.col(doc_id).alias(doc), F.explode(F.arrow_udf(hashes, "array<struct<a: bigint, b: bigint>>")(raw)).alias("k")).select(doc, "k.a", "k.b")
    lists = pairs.join(doomed, ["a", "b"], "left_semi").groupBy(doc).agg(F.collect_set(F.struct("a", "b")).alias(own))
    joined = docs.join(lists, F.col(doc_id).eqNullSafe(F.col(doc)), "left").drop(doc)
    return joined.withColumn(into, F.arrow_udf(with_own, SCHEMA)(raw, F.col(own))).drop(own)
