"""Quality classifier by importance resampling.

Hashed n-gram generative models: unigrams and bigrams of words, stems (a word's first four bytes), and trigrams of token
shapes (case, symbols, length, whether a token repeats the one before). A model is a vector of counts by bucket. The
target model counts good rows of a bounded sample of labelled rows, smoothed towards the counts of all texts. A text's
importance is its likelihood in the target model over that in raw text,

    w(x) = p_target(x) / p_raw(x)

Raw text is a mixture, document by document: of the target model and of models of what isn't wanted (poor rows, toxic rows: the
target model mixed with what those rows hold in clear excess of it), by their shares among the labelled rows, so
p_raw = sum_c share_c * p_c. The counts of all texts only smooth the target model. As the denominator itself, or as a further part
of the mixture, they were tried and give worse samples: the first can't tell a long text with a few toxic words from a good one,
the second takes good text with words that no label shows for junk (figures in the README). The price is that junk
of a kind that no poor or toxic label shows is kept.

share_target * w(x) is a text's chance to be target text. Gumbel top-k keeps the k texts of the largest log w + Gumbel noise
(a sample without replacement in proportion to w); k is the sum of those chances, so the sample is as large as the
target text in the corpus. The noise is a hash of doc_id: a rerun keeps the same rows. Logarithms and chances are added as whole
numbers of fixed steps, so a row's weight doesn't depend on its neighbours, nor k on the order of rows.

Null and empty texts have no n-grams: their w is 1. Rows of equal key at the cut stay together. Without
labels of both kinds nothing is known, and everything stays. Labels with a null id or a null quality are left
out; a null toxic counts as 0; of several labels of an id the worst counts. Rows that repeat an id have equal noise.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import textnum as T
from scholia.llm.tables import fresh, written

#: So many labelled rows are used, chosen by a hash of doc_id. (Their ids and classes are broadcast: 16 bytes each.)
LABEL_SAMPLE = 40_000
WORD_BUCKETS, SHAPE_BUCKETS, STEM_BUCKETS, STEM, SEED = 1 << 16, 1 << 14, 1 << 17, 4, 20240517
#: The parts of a model, each a distribution of its own.
PARTS = (slice(0, WORD_BUCKETS), slice(WORD_BUCKETS, WORD_BUCKETS + SHAPE_BUCKETS), slice(WORD_BUCKETS + SHAPE_BUCKETS, WORD_BUCKETS + SHAPE_BUCKETS + STEM_BUCKETS))
SIZE = PARTS[-1].stop
#: Share of the raw counts in the target model; an excess is clear beyond so many standard errors and so many times the expected count.
SMOOTH, SURE, TIMES = 0.005, 5.0, 3.0
CLASSES = ("target", "poor", "toxic")
#: Steps of a logarithm, of a chance, of a key.
STEPS, _KEY_STEPS = 1 << 20, float(1 << 32)

_CLASS = np.full(256, 4, np.uint8)
_CLASS[0x61:0x7B] = 0
_CLASS[0x80:] = 0
_CLASS[0x41:0x5B] = 1
_CLASS[0x30:0x3A] = 2
_CLASS[[ord(x) for x in "#*$%&|<>!@^~_=+{}[]\\"]] = 3


def buckets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of all n-grams, text by text, and offsets."""
    h, at = T.word_hashes(texts, T.ALNUM, lower=True)
    pairs, inside = T.grams(h, 2), T.within(at, 2, len(h))
    owner = np.repeat(np.arange(len(texts)), np.diff(at))
    got = [(owner, h % np.uint64(WORD_BUCKETS)), (owner[: len(pairs)][inside], pairs[inside] % np.uint64(WORD_BUCKETS))]
    stems = []
    for buf, _ in T.pieces(texts, T.ALNUM):
        buf = T.lowered(buf)
        s, e = T.bounds(buf, T.ALNUM)
        stems.append(T.substring(buf, s, np.minimum(e, s + STEM)))
    got.append((owner, np.concatenate(stems or [h]) % np.uint64(STEM_BUCKETS) + np.uint64(PARTS[2].start)))
    for buf, where in T.pieces(texts, T.NONSPACE):
        s, e = T.bounds(buf, T.NONSPACE)
        if not len(s):
            continue
        kind = _CLASS[buf]
        upper, odd = (np.r_[0, np.cumsum(kind == c)] for c in (1, 3))
        n = e - s
        same = np.r_[False, (lambda x: x[1:] == x[:-1])(T.substring(buf, s, e))]
        shape = kind[s].astype(np.uint64)
        for value in (kind[e - 1], np.minimum(upper[e] - upper[s], 2), np.minimum(odd[e] - odd[s], 3), np.minimum(np.log2(n).astype(int), 6), same):
            shape = shape * np.uint64(8) + value.astype(np.uint64)
        shape = T.mix(shape)
        ids, starts = np.array([i for i, _ in where]), np.array([a for _, a in where])
        mine = ids[np.searchsorted(starts, s, "right") - 1]
        three = T.grams(shape, 3)
        if len(three):
            ok = mine[:-2] == mine[2:]
            got.append((mine[:-2][ok], three[ok] % np.uint64(SHAPE_BUCKETS) + np.uint64(WORD_BUCKETS)))
    owners, numbers = np.concatenate([a for a, _ in got]), np.concatenate([b for _, b in got]).astype(np.int64)
    order = np.argsort(owners, kind="stable")
    return numbers[order], np.r_[0, np.cumsum(np.bincount(owners, minlength=len(texts)))]


def counted(docs: DataFrame, text: str, kind: str) -> DataFrame:
    """(bucket, raw, target, poor, toxic): n-gram counts over all rows. A task sends a row for each bucket at most."""
    size = SIZE

    def count(batches):
        total = np.zeros((1 + len(CLASSES), size), np.int64)
        for batch in batches:
            numbers, at = buckets(T.as_bytes(batch.column(0)))
            which = np.array([-1 if k is None else k for k in batch.column(1).to_pylist()], int)
            total[0] += np.bincount(numbers, minlength=size)
            of = np.repeat(which, np.diff(at))
            for k in np.unique(which[which >= 0]):
                total[1 + k] += np.bincount(numbers[of == k], minlength=size)
        there = np.flatnonzero(total[0])
        yield pa.RecordBatch.from_arrays([pa.array(there), *(pa.array(x[there]) for x in total)], names=["bucket", "raw", *CLASSES])

    schema = ", ".join(f"{c} bigint" for c in ("bucket", "raw", *CLASSES))
    rows = docs.select(F.col(text).cast("binary").alias("text"), F.col(kind).cast("int").alias("kind")).mapInArrow(count, schema)
    return rows.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("raw", *CLASSES)))


@dataclass(frozen=True)
class Model:
    """logs[i][b]: log of p_i / p_target in bucket b, in steps; i goes over the poor and the toxic model. shares of the classes among the labelled rows."""

    logs: np.ndarray
    shares: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray, sizes: np.ndarray) -> Model:
        """counts: raw, target, poor, toxic by bucket; sizes: labelled rows by class."""
        logs = np.zeros((len(CLASSES) - 1, SIZE))
        for part in PARTS:
            raw, good = counts[0, part] / max(1.0, counts[0, part].sum()), counts[1, part]
            target = np.maximum((good / max(1.0, good.sum()) + SMOOTH * raw) / (1 + SMOOTH), 1e-12)
            for c in range(1, len(CLASSES)):
                own = counts[1 + c, part]
                n = max(1.0, own.sum())
                excess = np.where(own > TIMES * n * target + SURE * np.sqrt(n * target + 1), own - n * target, 0) / n
                logs[c - 1, part] = np.log(np.maximum(1 - excess.sum(), 1e-9) + excess / target)
        return cls(np.rint(logs * STEPS).astype(np.int64), sizes / max(1.0, sizes.sum()))

    @property
    def known(self) -> bool:
        return bool(self.shares[0] > 0 and self.shares[1:].sum() > 0)

    def log_weights(self, texts: list[bytes]) -> list[float]:
        if not self.known:
            return [0.0] * len(texts)
        return [w for a, b in T.slices(texts) for w in self._log_weights(texts[a:b])]

    def _log_weights(self, texts: list[bytes]) -> list[float]:
        numbers, at = buckets(texts)
        sums = [np.diff(np.r_[0, np.cumsum(x[numbers])][at]).tolist() for x in self.logs]
        return [self._log_weight(own) for own in zip(*sums, strict=True)]

    def _log_weight(self, sums: tuple[int, ...]) -> float:
        """sums: a text's logarithms, in steps. One text at a time, so that no vector's length enters."""
        terms = [math.log(share) + x / STEPS for share, x in zip(self.shares, (0, *sums), strict=True) if share > 0]
        top = max(terms)
        return -round((top + math.log(math.fsum(math.exp(t - top) for t in terms))) * STEPS) / STEPS


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = LABEL_SAMPLE) -> Model:
    """Two small results reach the driver: the counts by bucket (a fixed number) and the classes' sizes in the sample."""
    classes = F.when(F.min("quality") < 1, 1).when(F.max(F.coalesce(F.col("toxic"), F.lit(0))) > 0, 2).otherwise(0)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(classes.alias("_class"))
    # Poor text comes before toxic text: a poor toxic row is poor.
    # Ids are distinct here, so a hash below sample / rows picks `sample` rows, give or take a few hundred, without a sort.
    known = written(known, "labels")
    share = sample / max(1, known.count())
    draw = F.xxhash64(F.lit(SEED), "_id").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    chosen = known.where(draw < F.lit(share))
    bounded = F.broadcast(chosen)  # about `sample` rows of two numbers
    joined = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(bounded, "_id", "left")
    sizes = {r["_class"]: r["n"] for r in chosen.groupBy("_class").agg(F.count("*").alias("n")).collect()}
    table = counted(joined, "_text", "_class").toArrow()
    counts = np.zeros((1 + len(CLASSES), SIZE))
    counts[:, table["bucket"].to_numpy()] = [table[c].to_numpy() for c in ("raw", *CLASSES)]
    return Model.of(counts, np.array([sizes.get(c, 0) for c in range(len(CLASSES))], float))


def weight_column(text: Column, model: Model) -> Column:
    def weigh(column: pa.Array) -> pa.Array:
        return pa.array(model.log_weights(T.as_bytes(column)), pa.float64())

    return F.arrow_udf(weigh, "double")(text.cast("binary"))


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise from a hash of the id."""
    u = (F.xxhash64(F.lit(seed), doc_id).bitwiseAND(F.lit((1 << 52) - 1)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.log(-F.log(u))


def threshold(keys: DataFrame, key: str, k: int) -> int | None:
    """The k-th largest of a column of longs (None if k < 1; the least if there are fewer): four counting passes, 65,536 counters at most each."""
    if k < 1:
        return None
    digits = keys.select(F.col(key).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint")).alias("u"))
    known, bits = 0, 0
    for shift in (48, 32, 16, 0):
        part = digits if not bits else digits.where(F.shiftrightunsigned("u", shift + 16) == F.lit(known))
        digit = F.shiftrightunsigned("u", shift).bitwiseAND(F.lit(0xFFFF))
        counts = sorted(((r[0], r[1]) for r in part.groupBy(digit.alias("d")).count().collect()), reverse=True)
        if not counts:
            return None
        for d, n in counts:
            if n >= k or d == counts[-1][0]:
                break
            k -= n
        known, bits = known << 16 | d, bits + 16
    return known - (1 << 63)


def key_column(log_weight: Column, doc_id: Column) -> Column:
    """Order-keeping long; weights beyond +-1e8 are as good as that."""
    return F.floor((F.greatest(F.lit(-1e8), F.least(F.lit(1e8), log_weight)) + gumbel(doc_id)) * F.lit(_KEY_STEPS)).cast("bigint")


@dataclass(frozen=True)
class Sample:
    """rows: the written rows with log_weight, chance and sample_key; the cut between the keys kept and the others."""

    rows: DataFrame
    known: bool
    expected: int
    cut: int | None

    @property
    def kept(self) -> Column:
        return F.lit(True) if not self.known else F.lit(False) if self.cut is None else F.col("sample_key") >= F.lit(self.cut)


def sample_of(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id", sample: int = LABEL_SAMPLE, columns: list[str] | None = None) -> Sample:
    """Two passes over the texts: one counts, the other weighs and writes `columns` of docs (all of them by default) with each row's key."""
    model = fit(docs, labels, text, doc_id, sample)
    out = docs.withColumn("log_weight", weight_column(F.col(text), model))
    out = out.withColumn("chance", F.least(F.lit(1.0), F.lit(float(model.shares[0])) * F.exp("log_weight")) if model.known else F.lit(1.0))
    out = out.withColumn("sample_key", key_column(F.col("log_weight"), F.col(doc_id)))
    own = ["log_weight", "chance", "sample_key"]
    rows = written(out.select(*(c for c in (docs.columns if columns is None else columns) if c not in own), *own), "quality")
    if not model.known:
        return Sample(rows, False, 0, None)
    steps = rows.agg(F.sum(F.floor(F.col("chance") * STEPS))).collect()[0][0] or 0
    expected = (steps + STEPS // 2) // STEPS
    return Sample(rows, True, expected, threshold(rows, "sample_key", expected))


def quality_classifier(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs (or the `columns` of it) with log_weight, chance (of being target text), sample_key and kept, which replace columns of these names."""
    got = sample_of(docs, labels, **options)
    return got.rows.withColumn("kept", got.kept)


def keep(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, with their columns."""
    own = {c: fresh(docs, f"_{c}") if c.lower() in ("log_weight", "chance", "sample_key") else c for c in docs.columns}
    got = sample_of(docs.withColumnsRenamed(own), labels, **options)
    return got.rows.where(got.kept).select(*(F.col(new).alias(c) for c, new in own.items()))
