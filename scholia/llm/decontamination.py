"""Benchmark decontamination by winnowing.

Texts are lower-cased (A-Z) and split into words. The fingerprint of 10 consecutive words is the least hash of their 5-word
grams; consecutive windows of one least gram share it, so a text keeps about two fingerprints for seven words. Equal
windows have equal fingerprints: joining those of documents and items misses no shared span of 10 words. A joined
fingerprint is then extended: the windows that stand for it are joined with the items' windows. An item of fewer than
10 words is one window, and its own fingerprint.

All joins are by key, whatever the benchmark's size; Spark sends a side to all tasks only where it is small. A bitmap
of fixed size over the items' fingerprints keeps most others from being shuffled; it is a help only, results don't depend
on it. Hits are found by text, not by row: a text is known by 128 bits of hash, so copies are looked up once, and ids may
be null, repeat, or stand on several texts.

Null and empty texts have no words. Items without words, or with a null id, are never found. Items of equal text are all found.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import textnum as T
from scholia.llm.idfilter import IdFilter
from scholia.llm.tables import fresh, is_small, written

WINDOW, GRAM = 10, 5
#: Bits of the map of fingerprints, whatever the benchmark's size.
BITS = 1 << 25


def fingerprints(h: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of words h[offsets[i]:offsets[i + 1]]: starts, ends and fingerprints of the runs of windows that share one."""
    least = T.sliding_min(T.grams(h, GRAM), WINDOW - GRAM + 1)
    inside = T.within(offsets, WINDOW, len(h))
    new = np.r_[True, (least[1:] != least[:-1]) | (inside[1:] != inside[:-1])][: len(least)]
    text = offsets[(offsets > 0) & (offsets < len(least))]
    new[text] = True
    start = np.flatnonzero(new)
    end = np.r_[start[1:], len(least)][: len(start)]
    ok = inside[start]
    return start[ok], end[ok], least[start[ok]]


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def indexed(items: DataFrame) -> DataFrame:
    """items: (id, text). Rows of kind 0 (k, h: a fingerprint of windows of k words) and kind 1 (k, h, id: a window of an item)."""
    schema = "kind int, k int, h bigint, id string"

    def index(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), T.as_bytes(batch.column(1))
            for a, b in T.slices(texts):
                h, offsets = T.word_hashes(texts[a:b], T.ALNUM, lower=True)
                sizes = np.diff(offsets)
                owner = np.repeat(np.arange(a, b), sizes)
                prints = fingerprints(h, offsets)[2]
                inside = np.flatnonzero(T.within(offsets, WINDOW, len(h)))
                k, found, of = [np.full(len(inside), WINDOW)], [T.grams_at(h, inside, WINDOW)], [owner[inside]]
                for n in range(1, WINDOW):
                    if len(at := offsets[:-1][sizes == n]):
                        k, found, of = [*k, np.full(len(at), n)], [*found, T.grams(h, n)[at]], [*of, owner[at]]
                k, found, of = map(np.concatenate, (k, found, of))
                prints = np.unique(prints)
                rows = np.unique(np.rec.fromarrays([k, _signed(found), of], names="k,h,of"))
                short = rows[rows["k"] < WINDOW]
                keys, values = np.r_[np.full(len(prints), WINDOW), short["k"]], np.r_[_signed(prints), short["h"]]
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[np.zeros(len(keys)), np.ones(len(rows))].astype(np.int32)), pa.array(np.r_[keys, rows["k"]].astype(np.int32)), pa.array(np.r_[values, rows["h"]]), pa.array([None] * len(keys) + [ids[i] for i in rows["of"]], pa.string())], names=["kind", "k", "h", "id"])

    return items.select("id", "text").mapInArrow(index, schema)


def _bitmap(prints: DataFrame) -> np.ndarray:
    """Built by the executors: BITS / 64 numbers at most reach the driver."""
    bit = F.shiftrightunsigned("h", 64 - BITS.bit_length() + 1)
    words = prints.select(F.shiftrightunsigned(bit, 6).alias("w"), F.expr("1L").alias("one"), bit.bitwiseAND(F.lit(63)).cast("int").alias("place"))
    table = words.selectExpr("w", "shiftleft(one, place) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[table["w"].to_numpy()] = table["b"].to_numpy()
    return out


def probes(docs: DataFrame, bitmap, lengths: list[int]) -> DataFrame:
    """docs: (a, b, text). (a, b, k, print, at, windows): fingerprints of a text that the bitmap lets through, with their windows' hashes, the first of them at word `at`."""
    schema = "a bigint, b bigint, k int, print bigint, at bigint, windows array<bigint>"
    names = [x.split()[0] for x in schema.split(", ")]
    shift = np.uint64(64 - BITS.bit_length() + 1)

    def there(prints: np.ndarray) -> np.ndarray:
        bit = (prints >> shift).astype(np.int64)
        return (bitmap.value[bit >> 6] >> (bit & 63)) & 1 == 1

    def of(key: np.ndarray, texts: list[bytes]):
        h, offsets = T.word_hashes(texts, T.ALNUM, lower=True)
        start, end, prints = fingerprints(h, offsets)
        ok = there(prints)
        parts = [(WINDOW, start[ok], end[ok], prints[ok])]
        for n in lengths:
            grams = T.grams(h, n)
            at = np.flatnonzero(T.within(offsets, n, len(h))[: len(grams)] & there(grams))
            parts.append((n, at, at + 1, grams[at]))
        for k, s, e, p in parts:
            if not len(s):
                continue
            doc = np.searchsorted(offsets, s, "right") - 1
            sizes = e - s
            flat = np.repeat(s - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(_signed(T.grams_at(h, flat, k))))
            yield pa.RecordBatch.from_arrays([pa.array(key[doc, 0]), pa.array(key[doc, 1]), pa.array(np.full(len(s), k, np.int32)), pa.array(_signed(p)), pa.array(s - offsets[doc]), lists], names=names)

    def probe(batches):
        for batch in batches:
            key = np.stack([batch.column(i).to_numpy() for i in (0, 1)], 1)
            texts = T.as_bytes(batch.column(2))
            _, first = np.unique(key, axis=0, return_index=True)
            key, texts = key[first], [texts[i] for i in first]
            for a, b in T.slices(texts):
                yield from of(key[a:b], texts[a:b])

    return docs.select("a", "b", "text").mapInArrow(probe, schema)


def _key(text: Column) -> list[Column]:
    raw = F.coalesce(text.cast("binary"), F.lit(b""))
    return [F.xxhash64(F.lit(1), raw), F.xxhash64(raw, F.lit(2))]


def found(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame:
    """(a, b, spans: at and k of the windows found, items): a row for each distinct text that holds a window of an item."""
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).cast("binary").alias("text")).dropna()
    index = written(indexed(items), "benchmark")
    prints = index.where("kind = 0").select("k", F.col("h").alias("print")).distinct()
    windows = index.where("kind = 1").select("k", "h", "id").distinct()
    lengths = sorted(r["k"] for r in index.where(F.col("k") < WINDOW).select("k").distinct().collect())  # nine at most
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(prints.select(F.col("print").alias("h"))))
    a, b = _key(F.col(text))
    met = probes(docs.select(a.alias("a"), b.alias("b"), F.col(text).cast("binary").alias("text")), sent, lengths).join(prints, ["k", "print"], "left_semi")
    extended = met.select("a", "b", "k", F.posexplode("windows").alias("place", "h"), "at").select("a", "b", "k", "h", (F.col("at") + F.col("place")).alias("at"))
    # Sets are gathered in part before the shuffle, and hold no more than a text's windows and the items found in it.
    both = extended.join(windows, ["k", "h"]).groupBy("a", "b").agg(F.collect_set(F.struct("at", "k")).alias("spans"), F.sort_array(F.collect_set("id")).alias("items"))
    return written(both, "hits")


SCHEMA = "n_words bigint, n_hit bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"
_KIND = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def n_words(texts: list[bytes]) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for buf, at in T.pieces(texts, T.ALNUM):
        s, _ = T.bounds(buf, T.ALNUM)
        np.add.at(out, [i for i, _ in at], np.diff(np.r_[np.searchsorted(s, [x for _, x in at]), len(s)]))
    return out


def _clean(column: pa.Array) -> pa.Array:
    return pa.array([{"n_words": int(n), "n_hit": 0, "spans": [], "items": []} for n in n_words(T.as_bytes(column))], _KIND)


def _merged(column: pa.Array, spans: pa.Array, items: pa.Array) -> pa.Array:
    out = []
    for n, own, ids in zip(n_words(T.as_bytes(column)).tolist(), spans.to_pylist(), items.to_pylist(), strict=True):
        at, k = (np.array([x[c] for x in own or ()], np.int64) for c in ("at", "k"))
        s, e = T.runs(T.covered(at, at + k, n))
        out.append({"n_words": n, "n_hit": int((e - s).sum()), "spans": [{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True)], "items": ids or []})
    return pa.array(out, _KIND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "hits") -> DataFrame:
    """All columns of docs and the struct `into` (SCHEMA), which replaces a column of that name: places in words, ids as strings, sorted."""
    a, b, spans, items, held = (fresh(docs, x) for x in ("_a", "_b", "_spans", "_items", "_held"))
    some = found(docs, benchmark, text, item_id, item_text).select(F.col("a").alias(a), F.col("b").alias(b), F.col("spans").alias(spans), F.col("items").alias(items))
    raw, (key_a, key_b) = F.col(text).cast("binary"), _key(F.col(text))
    own_a, own_b = a + a, b + b

    def met(rows: DataFrame) -> DataFrame:
        joined = rows.withColumns({own_a: key_a, own_b: key_b}).join(some, (F.col(own_a) == F.col(a)) & (F.col(own_b) == F.col(b)), "left")
        return joined.withColumn(into, F.arrow_udf(_merged, SCHEMA)(raw, F.col(spans), F.col(items))).drop(a, b, own_a, own_b, spans, items)

    if is_small(some):
        return met(docs)
    # Texts without a hit stay where they are; only the others are shuffled to what was found in them.
    marked = docs.withColumn(held, IdFilter(some, a).may_hold(key_a))
    return met(marked.where(F.col(held))).drop(held).unionByName(marked.where(~F.col(held)).withColumn(into, F.arrow_udf(_clean, SCHEMA)(raw)).drop(held))
