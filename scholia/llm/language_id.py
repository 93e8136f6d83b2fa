"""Language identification by error-correcting output codes.

Each language has a codeword of bits; for each bit a binary classifier over hashed byte n-grams predicts it.
Decoding takes the codeword with the least loss, each bit weighted by how well its classifier did in training.
A text whose two best codewords lie close is flagged as ambiguous.

The classifiers are fitted on a bounded sample (`sample` rows in all, shared evenly between languages, chosen
by a hash of doc_id) of rows with a language that the caller's filter lets through. Whole texts count, in
training and in prediction; nothing but the text enters a prediction.

Null texts and texts without a letter give `und` and score 0, as does everything where nothing can be learned
(no rows). With one language, it is predicted always. Repeated rows get equal results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import textnum as T

SAMPLE, DIMENSIONS, STEPS, AMBIGUOUS = 1600, 4096, 120, 0.2
UNKNOWN = "und"
#: ASCII letters in lower case and all bytes beyond ASCII count; anything else is a gap.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


@cache
def _letter():
    import regex

    return regex.compile(r"\p{L}")


def features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's vector of length one."""
    counts = np.zeros(DIMENSIONS, np.int64)
    for start in range(0, len(text), T.PIECE):
        b = _FOLD[np.frombuffer(text, np.uint8, min(T.PIECE + 2, len(text) - start), start)]
        b = np.r_[np.uint8(0x20), b[(b != 0x20) | np.r_[True, b[:-1] != 0x20]], np.uint8(0x20)].astype(np.uint32)
        two = b[:-1] << 8 | b[1:]
        three = two[:-1] << 8 | b[2:]
        for g, seed in ((two, 1), (three, 2)):
            counts += np.bincount(((g + np.uint32(seed << 24)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIMENSIONS)
    at = np.flatnonzero(counts)
    value = np.sqrt(counts[at])
    return at, value / max(1e-9, math.sqrt(float((value**2).sum())))


def codewords(n: int) -> np.ndarray:
    """A row of +1 and -1 for each of n classes: all distinct splits for few classes, else a seeded code whose closest rows lie far apart."""
    if n <= 2:
        return np.array([[1.0], [-1.0]])[:n]
    if n <= 6:
        splits = np.arange(1, 2 ** (n - 1))
        return np.vstack([np.ones(len(splits)), *(1 - 2.0 * ((splits >> i) & 1) for i in range(n - 1))])
    rng, best, far = np.random.default_rng(7), None, -1
    for _ in range(64):
        code = rng.choice([-1.0, 1.0], (n, 12 * math.ceil(math.log2(n))))
        code = code[:, np.abs(code.sum(0)) < n]
        least = int(((code[:, None] != code[None]).sum(-1) + code.shape[1] * np.eye(n, dtype=int)).min())
        if least > far:
            best, far = code, least
    return best


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, text: bytes | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _letter().search(text.decode("utf-8", "replace")):
            return UNKNOWN, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        at, value = features(text)
        margin = value @ self.weights[at] + self.bias
        loss = (np.logaddexp(0, -self.code * margin) * self.trust).sum(1)
        order = np.argsort(loss, kind="stable")
        share = np.exp(loss[order[0]] - loss)
        score = float(1 / share.sum())
        return self.languages[order[0]], score, bool(1 - math.exp(loss[order[0]] - loss[order[1]]) < AMBIGUOUS)


def train(languages: list[str], rows: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """rows: index of the language, places and values of the features."""
    code = codewords(len(languages))
    if len(languages) < 2:
        return Model(tuple(languages), code, np.zeros((DIMENSIONS, 1)), np.zeros(1), np.ones(1))
    x = np.zeros((len(rows), DIMENSIONS), np.float32)
    for i, (_, at, value) in enumerate(rows):
        x[i, at] = value
    which = np.array([k for k, _, _ in rows])
    y = code[which].astype(np.float32)
    weight = (1 / np.bincount(which, minlength=len(languages))[which]).astype(np.float32)[:, None]
    weight /= weight.sum()
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    look_w, look_b = w, b
    for step in range(STEPS):  # accelerated gradient descent on the logistic loss
        g = -weight * y / (1 + np.exp(y * (x @ look_w + look_b)))
        new_w, new_b = look_w - 4.0 * (x.T @ g + 1e-5 * look_w), look_b - 1.0 * g.sum(0)
        pace = step / (step + 3)
        look_w, look_b, w, b = new_w + pace * (new_w - w), new_b + pace * (new_b - b), new_w, new_b
    wrong = ((np.sign(x @ w + b) != y) * weight).sum(0)
    trust = np.log((1 - wrong + 0.01) / (wrong + 0.01))
    trust = np.clip(trust, 0, None)
    return Model(tuple(languages), code, w.astype(float) * 4, b.astype(float) * 4, trust / max(trust.mean(), 1e-9) if trust.any() else np.ones_like(trust))


def fit(docs: DataFrame, usable: Column, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on at most 2 x `sample` rows (`sample` is expected) for which `usable` holds."""
    rows = docs.where(usable & F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(lang).count().collect()}
    if not sizes:
        return train([], [])
    languages, quota = sorted(sizes), max(1, sample // len(sizes))
    # A hash of doc_id in [0, 1) under quota / rows of the language: an even share of each language, the same in every run.
    draw = (F.xxhash64(F.lit(17), F.col(doc_id)).bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))).cast("double")
    share = F.element_at(F.create_map(*(F.lit(v) for k in languages for v in (k, quota / sizes[k]))), F.col(lang))

    def vectors(column: pa.Array) -> pa.Array:
        out = [features(x) for x in T.as_bytes(column)]
        return pa.array([{"at": a.astype(np.int32), "value": v.astype(np.float32)} for a, v in out], pa.struct([("at", pa.list_(pa.int32())), ("value", pa.list_(pa.float32()))]))

    picked = rows.where(draw < share).limit(2 * sample).select(F.col(lang).alias("lang"), F.arrow_udf(vectors, "at array<int>, value array<float>")(F.col(text).cast("binary")).alias("x"))
    got = [(languages.index(r["lang"]), np.array(r["x"]["at"], int), np.array(r["x"]["value"])) for r in picked.collect()]
    seen = sorted({k for k, _, _ in got})
    return train([languages[k] for k in seen], [(seen.index(k), a, v) for k, a, v in got])


SCHEMA = "lang_pred string, score double, ambiguous boolean"


def language_column(text: Column, model: Model) -> Column:
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])

    def identify(column: pa.Array) -> pa.Array:
        return pa.array([dict(zip(kind.names, model.predict(x), strict=True)) for x in column.to_pylist()], kind)

    return F.arrow_udf(identify, SCHEMA)(text.cast("binary"))


def language_id(docs: DataFrame, usable: Column, text: str = "text", **columns) -> DataFrame:
    """All columns of docs and the struct `language` (SCHEMA), which replaces a column of that name. A sampling pass and a pass without a shuffle."""
    return docs.withColumn("language", language_column(F.col(text), fit(docs, usable, text, **columns)))
