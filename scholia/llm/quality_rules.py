"""Quality rules: counts of words, symbols and repeats, and zstandard compression bands.

A text's ratio is its compressed size over its size in bytes. Repetitive text has a low ratio, random or
encoded text a high one. Short texts compress worse, so the limits depend on the length. The whole text must
lie within its band, and so must two thirds at least of its fixed chunks (a last chunk of under half a chunk
counts with the one before it).

Null and empty texts have no words and no ratio; they fail by word count. Each row is judged alone, so ties,
repeated rows, null ids and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.llm import textnum as T

#: (length in bytes below which the band holds, least ratio, largest ratio)
BANDS = ((64, 0.45, 3.0), (128, 0.45, 1.6), (256, 0.42, 1.2), (512, 0.42, 1.0), (1024, 0.40, 0.90), (2048, 0.38, 0.80), (4096, 0.36, 0.76), (16384, 0.33, 0.74), (None, 0.30, 0.74))
CHUNK, CHUNK_BAND, CHUNKS_WITHIN = 2048, (0.36, 0.80), 2 / 3
LEVEL = 3
MIN_WORDS, WINDOW, MAX_REPEAT_PERCENT = 20, 8, 30
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\r\x0b\x0c"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True

COUNTS = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"
SCHEMA = f"{COUNTS}, ratio double, chunks_outside bigint, n_chunks bigint, base_failed boolean, kept boolean"


def ratios(text: bytes, chunk: int, pack) -> tuple[float, np.ndarray]:
    """The ratio of the whole text and of each chunk."""
    whole = len(pack(text)) / len(text)
    cuts = [*range(0, max(1, len(text) - chunk // 2), chunk), len(text)]
    if len(cuts) == 2:
        return whole, np.array([whole])
    return whole, np.array([len(pack(text[a:b])) / (b - a) for a, b in zip(cuts, cuts[1:], strict=False)])


def band(size: int, bands: Sequence[tuple]) -> tuple[float, float]:
    return next((lo, hi) for below, lo, hi in bands if below is None or size < below)


def measure(texts: list[bytes], bands=BANDS, chunk=CHUNK, chunk_band=CHUNK_BAND, within=CHUNKS_WITHIN, level=LEVEL) -> list[dict]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=level).compress
    return [x for a, b in T.slices(texts) for x in _measure(texts[a:b], pack, bands, chunk, chunk_band, within)]


def _measure(texts: list[bytes], pack, bands, chunk: int, chunk_band: tuple, within: float) -> list[dict]:
    hashes, at = T.word_hashes(texts, T.NONSPACE, lower=False)
    out = []
    for i, text in enumerate(texts):
        h = hashes[at[i] : at[i + 1]]
        b = np.frombuffer(text, np.uint8)
        lines = [x for x in text.split(b"\n") if x.strip(_SPACE)] if b"\n" in text else []
        windows = T.grams(h, WINDOW)
        _, of, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[of] > 1) if len(windows) else np.zeros(0, int)
        n, again = len(h), int(T.covered(twice, twice + WINDOW, len(h)).sum()) if len(twice) else 0
        row = {"n_words": n, "word_chars": int((((b & 0xC0) != 0x80) & T.NONSPACE[b]).sum()), "n_symbols": int(_SYMBOL[b].sum()), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": again, "ratio": None, "chunks_outside": 0, "n_chunks": 0}
        row["base_failed"] = n < MIN_WORDS or 100 * again > MAX_REPEAT_PERCENT * n
        good = False
        if text:
            whole, parts = ratios(text, chunk, pack)
            lo, hi = band(len(text), bands)
            outside = int(((parts < chunk_band[0]) | (parts > chunk_band[1])).sum()) if len(parts) > 1 else int(not lo <= whole <= hi)
            row |= {"ratio": whole, "chunks_outside": outside, "n_chunks": len(parts)}
            good = lo <= whole <= hi and len(parts) - outside >= within * len(parts)
        row["kept"] = bool(good and not row["base_failed"])
        out.append(row)
    return out


def _arrow(schema: str) -> pa.StructType:
    kinds = {"bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.struct([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def rule_column(text: Column, **options) -> Column:
    kind = _arrow(SCHEMA)

    def rules(column: pa.Array) -> pa.Array:
        return pa.array(measure(T.as_bytes(column), **options), kind)

    return F.arrow_udf(rules, SCHEMA)(text.cast("binary"))


def quality_rules(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """All columns of docs and the struct `rules` (SCHEMA), which replaces a column of that name. One pass, no shuffle."""
    return docs.withColumn("rules", rule_column(F.col(text), **options))
