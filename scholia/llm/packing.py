"""Packing token sequences into windows by Karmarkar-Karp multiway differencing.

A document is its ids and an end id. Whole windows of `capacity` ids are cut off first; the rest is cut into
pieces of at most `piece` ids. Pieces gather until they fill GROUP windows, then are dealt into windows:
each piece starts as a partial partition with one filled window; the two partial partitions with the largest
imbalance are merged, the fullest windows of one with the emptiest of the other, until one is left. Its windows
are nearly equal. If one is beyond the capacity, the number of windows rises and the dealing is done again.
Windows shorter than the capacity are padded to it, unless their length is a power of two.

Groups are made inside a task, so there is no shuffle and memory is bounded by a group and one document.
sequence_id holds the task's number in its upper bits. A task that is run again gives the same rows, as its
input is read in the same order.

Null and empty texts are documents of one id, the end. Rows that repeat (equal doc_id) are packed each.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scholia.llm import tokens

CAPACITY, PIECE, GROUP, END = 1024, 256, 128, 0
SCHEMA = "start bigint, length bigint, ids_le binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def differencing(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size."""
    n = len(sizes)
    if k == 1:
        return np.zeros(n, int)
    left, right = list(range(n)), [-1] * n  # a set of pieces is a tree; below n a single piece
    heap: list = []
    for i, s in enumerate(sizes):
        sums, sets = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], sets[0] = s, i
        heap.append((-s, i, sums, sets))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, a, sa = heapq.heappop(heap)
        _, _, b, sb = heapq.heappop(heap)
        b, sb = b[::-1], sb[::-1]
        sums, sets = a + b, np.where(sa < 0, sb, sa)
        for j in np.flatnonzero((sa >= 0) & (sb >= 0)):
            left.append(int(sa[j]))
            right.append(int(sb[j]))
            sets[j] = len(left) - 1
        sums -= sums.min()  # only differences matter
        order = np.argsort(-sums, kind="stable")
        sums, sets = sums[order], sets[order]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, sets))
        serial += 1
    out = np.zeros(n, int)
    for window, top in enumerate(heap[0][3]):
        stack = [int(top)] if top >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                out[x] = window
            else:
                stack += [left[x], right[x]]
    return out


def deal(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size; no window holds more than the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, weights=sizes, minlength=k).max(initial=0) <= capacity:
            return window
        k += 1


def pack(documents: Iterator[tuple[object, np.ndarray]], capacity: int = CAPACITY, piece: int = PIECE, group: int = GROUP) -> Iterator[list[tuple]]:
    """Lists of (document, start, ids, doc_tokens, sequence, offset); sequences count from 0."""
    waiting: list[tuple] = []
    size = sequence = 0

    def close():
        nonlocal waiting, size, sequence
        window = deal([len(p[2]) for p in waiting], capacity)
        out, at = [], {}
        for (doc, start, ids, total), w in zip(waiting, window.tolist(), strict=True):
            number, offset = at.get(w, (sequence + len(at), 0))
            at[w] = number, offset + len(ids)
            out.append((doc, start, ids, total, number, offset))
        sequence += len(at)
        waiting, size = [], 0
        return out

    limit = group * capacity - group * capacity // 256
    for doc, ids in documents:
        whole = len(ids) // capacity * capacity
        out = []
        for start in range(0, whole, capacity):
            out.append((doc, start, ids[start : start + capacity], len(ids), sequence, 0))
            sequence += 1
        parts = -(-(len(ids) - whole) // piece)
        for start, end in zip(*(lambda c: (c[:-1], c[1:]))(np.linspace(whole, len(ids), parts + 1).astype(int).tolist()), strict=True) if parts else ():
            if size + end - start > limit:
                out += close()
            waiting.append((doc, start, ids[start:end], len(ids)))
            size += end - start
        if out:
            yield out
    if waiting:
        yield close()


def pack_documents(docs: DataFrame, path: str | None = None, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, piece: int = PIECE, end: int = END) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_le (little-endian unsigned 32-bit ids), doc_tokens, sequence_id, offset."""
    path = path or tokens.default_path()
    columns = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = columns.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        above = TaskContext.get().partitionId() << 40

        def documents():
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a in range(0, len(ids), 256):
                    for doc, got in zip(ids[a : a + 256], tokens.encode(path, texts[a : a + 256]), strict=True):
                        yield doc, np.r_[got, np.uint32(end)].astype("<u4")

        def rows(got):
            doc, start, ids, total, sequence, offset = zip(*got, strict=True)
            columns = [pa.array(doc, pa_kind), pa.array(start, pa.int64()), pa.array([len(i) for i in ids], pa.int64()), pa.array([i.tobytes() for i in ids], pa.binary()), pa.array(total, pa.int64()), pa.array([above + s for s in sequence], pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=names)

        waiting: list = []
        for got in pack(documents(), capacity, piece):
            waiting += got
            if len(waiting) >= 2000:
                yield rows(waiting)
                waiting = []
        if waiting:
            yield rows(waiting)

    from pyspark.sql.pandas.types import to_arrow_type

    pa_kind, names = to_arrow_type(columns.schema["doc_id"].dataType), ["doc_id", *(x.split()[0] for x in SCHEMA.split(", "))]
    return columns.mapInArrow(run, f"doc_id {kind}, {SCHEMA}")
