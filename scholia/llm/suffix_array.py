"""Substring deduplication by prefix doubling over sampled positions.

The rank of a position is the name of the bytes that start there. A rank of twice the length is named by a pair of
ranks, that at the position and that at an offset:

    rank 12 (i)     = name(8 bytes at i, 4 bytes at i + 8)
    rank 24 (i)     = name(rank 12 (i), rank 12 (i + 12))
    rank 48 (i)     = name(rank 24 (i), rank 24 (i + 24))
    any length n    = (rank L (i), rank L (i + n - L)) for the largest L of these with L <= n <= 2 L

Names are 64-bit hashes of the pair, so tasks agree on a pair's name without numbering all pairs first; both halves stand in
one text, so no join by position is needed to bring them together. Spark sorts (rank, position) rows at growing lengths;
equal neighbours are equal text, a position whose rank is unique can't start a repeat and is retired, and the
others go on until the length is `span` bytes. The last sort is by the pair of ranks itself.

Ranking every byte would sort more rows than the corpus has bytes, at each length. So the positions are sampled,
without losing a repeat: each span-byte window stands for the place of its least 12-byte gram (by rank), the same place
in equal windows, and the consecutive windows of one place form a run, one row. The lengths are

1. 12 bytes: Spark sorts the runs by the rank at their place. A rank of one document only is retired.
2. the run's whole content (all of its windows, 50 to 88 bytes: a pair of rank 48): equal runs form a class. All but
   those of the class's first document are repeats.
3. 40 bytes (a pair of rank 24): the gram extended to the left, to the right, or to both in one of two ways. Equal windows agree
   in the way that their gram's place in the window calls for; windows that agree so with no other class of their gram
   are retired.
4. `span` bytes: what is left (the edges of repeats) is expanded into windows, which Spark sorts by their pair of ranks; again
   all but the first document's are repeats.

Equal runs inside a task's slice of SLICE bytes are settled there, so a group of copies sends a row for each
slice, not for each copy. No group is collected: a task reads its sorted rows as a stream. Grams so frequent that one would
fill much of a task (found in a sample of the documents) are dealt by gram and content; their runs skip step 3.
Which grams these are changes no result.

Null and empty texts have no bytes. Rows with a null doc_id are kept whole and aren't the source of a repeat. Rows that repeat
a doc_id with one text get equal results; rows of one doc_id with several texts are judged each, and none of them is a
source for another, as their doc_id isn't smaller.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm import textnum as T
from scholia.llm.idfilter import IdFilter
from scholia.llm.tables import fresh, written

SPAN, GRAM, SLICE = 50, 12, 1 << 19
#: Lengths of the doubling.
_LENGTHS = (GRAM, 2 * GRAM, 4 * GRAM)
#: Runs of one gram that step 3 compares at once; those of a gram with more all go to step 4.
HELD = 50_000
#: Windows that step 4 settles at once in a task.
WINDOWS = 250_000
_PLACE = (1 << 22) - 1  # of a slice, which is shorter
_SCHEMA = "gram bigint, rank bigint, doc bigint, place bigint, marks int"
_NAMES = [x.split()[0] for x in _SCHEMA.split(", ")]
_WINDOW_SCHEMA = "first bigint, second bigint, doc bigint, place bigint"
#: place: start << 32 | settled (a repeat already, its length in rank) << 31 | windows << 25 | bytes before the gram in the first << 19 | frequent gram << 18 | agreements 2 and 3 (9 bits each);
#: rank: of the whole content. marks: agreements 0 and 1 (14 bits each). An agreement is 0 where the run doesn't reach so far.
_SETTLED, _FREQUENT = 1 << 31, 1 << 18
#: One document of so many is sampled for frequent grams; a gram is frequent beyond this share of a task's rows.
SAMPLED, SHARE = 64, 1 / 8


def _ways(span: int) -> list[tuple[int, int, int, int, int]]:
    """(bytes to the left, to the right, least and largest number of bytes before the gram for which it counts, bits)."""
    rest = span - GRAM
    q = [rest * i // 4 for i in range(5)]
    return [(q[i], rest - q[i + 1], q[i], q[i + 1] - (i < 3), bits) for i, bits in ((0, 14), (1, 14), (2, 9), (3, 9))]


def name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rank of a pair of ranks (which are mixed already, so that a multiplication each is enough before the next mixing)."""
    return T.mix(a * np.uint64(0x9E3779B97F4A7C15) ^ b * np.uint64(0xD1342543DE82EF95))


class Ranks:
    """Ranks of all places of a buffer, doubled from 12 bytes on: at all places up to `longest`, beyond it at the places asked for."""

    def __init__(self, buf: np.ndarray, longest: int = 48) -> None:
        n = len(buf)
        eight = np.ascontiguousarray(T.eight(buf)[:n])
        self.levels = {GRAM: name(eight[: max(0, n - GRAM + 1)], T.mix((eight[8 : n - 3] & np.uint64(0xFFFFFFFF)) + np.uint64(1)))}
        size = GRAM
        while 2 * size <= longest:
            r = self.levels[size]
            self.levels[2 * size] = name(r[:-size], r[size:]) if len(r) > size else r[:0]
            size *= 2

    def at(self, start: np.ndarray, size: int) -> np.ndarray:
        """Ranks of buf[start:start + size], a length of the doubling."""
        if size in self.levels:
            return self.levels[size][start]
        return name(self.at(start, size // 2), self.at(start + size // 2, size // 2))

    def pair(self, start: np.ndarray, length: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
        """The two ranks that name buf[start:start + length]; all lengths between one level and twice that."""
        size = max(x for x in _LENGTHS if x <= np.min(length, initial=1 << 20))
        return self.at(start, size), self.at(start + length - size, size)

    def of(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        if not len(start):
            return np.zeros(0, np.uint64)
        return name(*self.pair(start, length))


def sampled(docs: list[tuple[int, bytes, int]], span: int, frequent: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of windows over parts of documents (doc, bytes, start of the part in its document). frequent: sorted grams to be dealt by content too."""
    buf = np.frombuffer(b"".join(x for _, x, _ in docs), np.uint8)
    sizes = np.array([len(x) for _, x, _ in docs], np.int64)
    if len(buf) < span:
        return {}
    ends = np.cumsum(sizes)
    ranks = Ranks(buf, GRAM)  # longer ones are asked for at the sampled places only
    g = ranks.levels[GRAM]
    w = span - GRAM + 1
    v = (g & ~np.uint64(_PLACE)) | np.arange(len(g), dtype=np.uint64)
    at = (T.sliding_min(v, w) & np.uint64(_PLACE)).astype(np.int64)
    change = np.zeros(len(buf) + 1, np.int64)
    np.add.at(change, ends - sizes, 1)
    np.add.at(change, np.maximum(ends - span + 1, ends - sizes), -1)
    valid = np.cumsum(change)[: len(at)] > 0
    win = np.flatnonzero(valid)
    if not len(win):
        return {}
    at = at[win]
    first = np.flatnonzero(np.r_[True, (win[1:] != win[:-1] + 1) | (at[1:] != at[:-1])])
    n = np.diff(np.r_[first, len(win)])
    start, place = win[first], at[first]
    end = start + n - 1 + span
    before = place - start
    marks = []
    for left, right, _, most, bits in _ways(span):
        # The way counts for windows with `least` to `most` bytes before the gram; the run must reach as far as the way does.
        there = (before >= left) & (end - place - GRAM >= right)
        at = np.flatnonzero(there)
        mark = np.zeros(len(start), np.int64)
        mark[at] = (ranks.of(place[at] - left, left + GRAM + right) % np.uint64((1 << bits) - 1)).astype(np.int64) + 1
        marks.append(mark)
    rank = ranks.of(start, end - start).astype(np.int64)
    part = np.searchsorted(ends, start, "right")
    doc, base = np.array([d for d, _, _ in docs])[part], (np.array([b for _, _, b in docs]) - (ends - sizes))[part]
    gram, low = g[place].astype(np.int64), n << 25 | before << 19 | marks[2] << 9 | marks[3]
    if frequent is not None and len(frequent):
        often = frequent[np.minimum(np.searchsorted(frequent, gram), len(frequent) - 1)] == gram
        gram[often] = name(gram[often].astype(np.uint64), rank[often].astype(np.uint64)).astype(np.int64)
        low = np.where(often, low | _FREQUENT, low)
    return {"gram": gram, "rank": rank, "doc": doc, "start": start + base, "low": low, "marks": (marks[0] << 14 | marks[1]).astype(np.int32)}


def _start(place: np.ndarray) -> np.ndarray:
    return place >> 32


def _n(place: np.ndarray) -> np.ndarray:
    return place >> 25 & 63


def _runs_of(docs: list[tuple[int, bytes, int]], span: int, low: int = 0, frequent: np.ndarray | None = None) -> list[np.ndarray] | None:
    """Rows of _SCHEMA: runs of each class's first document, and spans that are repeats already."""
    r = sampled(sorted(docs, key=lambda d: (d[0], d[2])), span, frequent)
    if not r:
        return None
    order = np.lexsort((r["rank"], r["gram"]))  # stable: rows stand by doc already
    r = {k: x[order] for k, x in r.items()}
    return _first_and_settled(r["gram"], r["rank"], r["doc"], r["start"] << 32 | r["low"], _n(r["low"]) - 1 + span, low, r["marks"])


def _first_and_settled(gram: np.ndarray, rank: np.ndarray, doc: np.ndarray, place: np.ndarray, length: np.ndarray | int, low: int = 0, *more: np.ndarray) -> list[np.ndarray]:
    """Of rows sorted by gram, rank, doc: those of each class's first document (documents are equal that differ in their lowest `low` bits only); the bytes of the others, merged, as settled rows. more: further columns, 0 in those."""
    new = np.r_[True, (gram[1:] != gram[:-1]) | (rank[1:] != rank[:-1])]
    keep = doc >> low == (doc >> low)[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = [x[keep] for x in (gram, rank, doc, place, *more)]
    if keep.all():
        return out
    doc, a = doc[~keep], place[~keep] >> 32
    b = a + np.broadcast_to(length, keep.shape)[~keep]
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    far = np.maximum.accumulate(b + (np.cumsum(np.r_[0, doc[1:] != doc[:-1]]) << 40)) & ((1 << 40) - 1)
    head = np.r_[True, (doc[1:] != doc[:-1]) | (a[1:] > far[:-1])]
    last = np.r_[np.flatnonzero(head)[1:] - 1, len(a) - 1]
    doc, a, b = doc[head], a[head], far[last]
    # A hash of the place in the gram's stead deals them evenly.
    settled = [T.mix((a * 31 + doc).astype(np.uint64)).astype(np.int64), b - a, doc, a << 32 | _SETTLED, *(np.zeros(len(a), x.dtype) for x in more)]
    return [np.concatenate(x) for x in zip(out, settled, strict=True)]


def _batch(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=names)


def runs(docs: DataFrame, span: int, low: int = 0, frequent=None) -> DataFrame:
    """frequent: a broadcast of sorted grams."""

    def find(batches):
        often = frequent.value if frequent is not None else None
        for batch in batches:
            held: list = []
            size = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for start in range(0, max(1, len(text) - span + 1), SLICE):  # a long text in parts whose windows are apart
                    part = text[start : start + SLICE + span - 1]
                    if held and size + len(part) > SLICE:
                        if (out := _runs_of(held, span, low, often)) is not None:
                            yield _batch(out, _NAMES)
                        held, size = [], 0
                    held.append((doc, part, start))
                    size += len(part)
            if held and (out := _runs_of(held, span, low, often)) is not None:
                yield _batch(out, _NAMES)

    return docs.select(F.col("doc"), F.col("raw")).mapInArrow(find, _SCHEMA)


_FOUND = "kind int, doc bigint, start bigint, n bigint"
_FOUND_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
REPEAT, OPEN = 1, 2


def _classes(batches, span: int, low: int = 0):
    """Rows sorted by gram, rank, doc: kind REPEAT with the length of the bytes, kind OPEN with the number of windows."""
    key: tuple | None = None  # gram, content and first document of the class that the last row was in
    waiting: list[np.ndarray] | None = None  # first documents' rows of the last gram
    over = None  # that gram, once it has had too many rows

    def rows(kind: int, doc, start, n):
        return _batch([np.full(len(doc), kind, np.int32), doc, start, n], _FOUND_NAMES)

    def settle(held: list[np.ndarray], everything: bool):
        """Step 3 over the first documents' rows of whole grams."""
        gram, rank, doc, place, marks = held
        if everything:
            return rows(OPEN, doc, _start(place), _n(place))
        often = (place & _FREQUENT) > 0
        before, out = place >> 19 & 63, [(doc[often], _start(place[often]), _n(place[often]))]
        for (_, _, least, most, _), mark in zip(_ways(span), (marks >> 14 & 0x3FFF, marks & 0x3FFF, place >> 9 & 0x1FF, place & 0x1FF), strict=True):
            order = np.lexsort((rank, mark, gram))
            g, s, c = gram[order], mark[order], rank[order]
            group = np.cumsum(np.r_[False, (g[1:] != g[:-1]) | (s[1:] != s[:-1])][: len(g)])
            more = np.r_[False, (c[1:] != c[:-1]) & (group[1:] == group[:-1])][: len(g)]
            go = order[(np.bincount(group, more) > 0)[group] & (s > 0) & ~often[order]]
            # The windows with least to most bytes before the gram, of those that the run has.
            a = np.maximum(0, before[go] - most)
            b = np.minimum(_n(place[go]), before[go] - least + 1)
            go, a, b = go[b > a], a[b > a], b[b > a]
            out.append((doc[go], _start(place[go]) + a, b - a))
        return rows(OPEN, *(np.concatenate(x) for x in zip(*out, strict=True)))

    for batch in batches:
        gram, rank, doc, place, marks = (c.to_numpy() for c in batch.columns)
        done = (place & _SETTLED) > 0
        if done.any():
            yield rows(REPEAT, doc[done], _start(place[done]), rank[done])
            gram, rank, doc, place, marks = (x[~done] for x in (gram, rank, doc, place, marks))
        if not len(gram):
            continue
        new = np.r_[True, (gram[1:] != gram[:-1]) | (rank[1:] != rank[:-1])]
        first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if key and key[:2] == (gram[0], rank[0]):
            first[: np.append(np.flatnonzero(new)[1:], len(new))[0]] = key[2]
        key = (gram[-1], rank[-1], first[-1])
        again = doc >> low > first >> low
        yield rows(REPEAT, doc[again], _start(place[again]), _n(place[again]) - 1 + span)
        own = [x[~again] for x in (gram, rank, doc, place, marks)]
        if not len(own[0]):
            continue
        if waiting is not None:
            own = [np.concatenate(x) for x in zip(waiting, own, strict=True)]
        last = own[0][-1]
        cut = int(np.searchsorted(own[0], last))
        head, waiting = [x[:cut] for x in own], [x[cut:] for x in own]
        if over is not None and cut:
            mine = head[0] == over
            yield settle([x[mine] for x in head], True)
            head = [x[~mine] for x in head]
        if len(head[0]):
            yield settle(head, False)
        if over != last:
            over = last if len(waiting[0]) > HELD else None
        if over is not None:
            yield settle(waiting, True)
            waiting = None
    if waiting is not None and len(waiting[0]):
        yield settle(waiting, over is not None)


def _windows(opened: DataFrame, span: int, low: int) -> DataFrame:
    """opened: (doc, packed text, runs). Step 4's rows: a window's pair of ranks, doc, place (its start); settled in a task as runs are."""

    def of(doc: int, text: bytes, own: list[dict]):
        own.sort(key=lambda r: r["start"])
        while own:  # runs within SLICE bytes of the first
            base = own[0]["start"]
            near = own[: np.searchsorted([r["start"] for r in own], base + SLICE)]
            own = own[len(near) :]
            buf = np.frombuffer(text, np.uint8, min(SLICE + 2 * span, len(text) - base), base)
            n = np.array([r["n"] for r in near])
            start = np.repeat(np.array([r["start"] for r in near]) - base - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            first, second = Ranks(buf).pair(start, span)
            yield first.astype(np.int64), second.astype(np.int64), np.full(len(start), doc), start + base << 32

    def flushed(held: list):
        rows = [np.concatenate(x) for x in zip(*held, strict=True)]
        order = np.lexsort((rows[3], rows[2], rows[1], rows[0]))
        return _batch(_first_and_settled(*(x[order] for x in rows), span, low), ["first", "second", "doc", "place"])

    def expand(batches):
        from zstandard import ZstdDecompressor

        unpack = ZstdDecompressor().decompress
        held, size = [], 0
        for batch in batches:
            for doc, packed, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                for part in of(doc, unpack(packed), own):
                    held.append(part)
                    size += len(part[0])
                    if size > WINDOWS:
                        yield flushed(held)
                        held, size = [], 0
        if held:
            yield flushed(held)

    return opened.mapInArrow(expand, _WINDOW_SCHEMA)


def _later(batches, span: int, low: int = 0):
    """Of rows sorted by both ranks and doc: those of a later document than the first of their ranks."""
    key = None
    for batch in batches:
        one, two, doc, place = (c.to_numpy() for c in batch.columns)
        done = (place & _SETTLED) > 0
        if done.any():
            yield _batch([doc[done], _start(place[done]), two[done]], ["doc", "start", "n"])
            one, two, doc, place = (x[~done] for x in (one, two, doc, place))
        if not len(one):
            continue
        new = np.r_[True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])]
        first = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        if key and key[:2] == (one[0], two[0]):
            first[: np.append(np.flatnonzero(new)[1:], len(new))[0]] = key[2]
        key = (one[-1], two[-1], first[-1])
        again = doc >> low > first >> low
        yield _batch([doc[again], _start(place[again]), np.full(int(again.sum()), span)], ["doc", "start", "n"])


def _packed(column: pa.Array) -> pa.Array:
    from zstandard import ZstdCompressor

    return pa.array(list(map(ZstdCompressor(level=1).compress, T.as_bytes(column))), pa.binary())


def _frequent(docs: DataFrame, span: int, low: int):
    """A broadcast of the grams that would fill much of a task: no more of them than tasks / SHARE."""
    spark = docs.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    some = written(runs(docs.where(F.pmod(F.xxhash64(F.lit(5), "doc"), F.lit(SAMPLED)) == 0), span, low).groupBy("gram").agg(F.count("*").alias("n")), "grams")
    total = some.agg(F.sum("n")).collect()[0][0] or 0
    grams = some.where(F.col("n") > F.lit(max(16.0, total * SHARE / tasks))).select("gram").toArrow()["gram"].to_numpy()
    return spark.sparkContext.broadcast(np.sort(grams))


def repeats(docs: DataFrame, span: int, low: int = 0) -> DataFrame:
    """docs: (doc, raw). (doc, span): bytes of repeats, start << 32 | length; they may overlap."""
    sorted_runs = runs(docs, span, low, _frequent(docs, span, low)).repartition("gram").sortWithinPartitions("gram", "rank", "doc")
    found = written(sorted_runs.mapInArrow(lambda batches: _classes(batches, span, low), _FOUND), "classes")
    opened = found.where(F.col("kind") == OPEN)
    lists = opened.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("runs"))
    some = docs.where(IdFilter(opened, "doc").may_hold(F.col("doc")))
    # Text is shuffled compressed; rows that repeat a doc and its text are one.
    packed = some.select("doc", F.arrow_udf(_packed, "binary")("raw").alias("packed"))
    windows = _windows(packed.join(lists, "doc").select("doc", "packed", "runs"), span, low).repartition("first", "second").sortWithinPartitions("first", "second", "doc")
    edges = windows.mapInArrow(lambda batches: _later(batches, span, low), "doc bigint, start bigint, n bigint")
    both = found.where(F.col("kind") == REPEAT).select("doc", "start", "n").unionByName(edges)
    return both.select("doc", (F.shiftleft("start", 32).bitwiseOR(F.col("n"))).alias("span"))


def _numbered(docs: DataFrame, doc_id: str, text: str, into: str) -> tuple[DataFrame, int]:
    """docs with a number for each doc_id and text in the order of doc_ids, and how many of its lowest bits tell an id's texts apart.

    Where each id has one text the number is the id. Else texts of one id are counted by hash, and where ids are too large to
    make room for that, they are replaced by their order."""
    number, content = F.col(doc_id).cast("bigint"), F.xxhash64(F.col(text).cast("binary"))
    pairs = docs.select(number.alias("id"), content.alias("h")).dropna()
    several = pairs.groupBy("id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a < b").select("id")
    if not several.limit(1).count():
        return docs.withColumn(into, number), 0
    several = written(several, "several")
    place = F.row_number().over(Window.partitionBy("id").orderBy("h")) - 1
    places = written(pairs.join(several, "id", "left_semi").distinct().withColumn("place", place.cast("bigint")), "texts")
    low = int(places.agg(F.max("place")).collect()[0][0]).bit_length()
    most = docs.agg(F.max(F.abs(number))).collect()[0][0]
    key, h, at, order = (fresh(docs, x) for x in ("_id", "_h", "_place", "_order"))
    out = docs.join(places.select(F.col("id").alias(key), F.col("h").alias(h), F.col("place").alias(at)), (number == F.col(key)) & (content == F.col(h)), "left").drop(key, h)
    if most < 1 << 62 - low:
        return out.withColumn(into, F.shiftleft(number, low).bitwiseOR(F.coalesce(at, F.lit(0)))).drop(at), low
    ids = pairs.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    # Partitions follow each other in the ids' order, so these numbers do; 43 bits hold them for up to 1,024 partitions.
    orders = written(ids.select(F.col("id").alias(key), F.monotonically_increasing_id().alias(order)), "order")
    if low > 19:
        raise ValueError("too many texts under one 64-bit doc_id")
    out = out.join(orders, number == F.col(key), "left").drop(key)
    return out.withColumn(into, F.shiftleft(order, low).bitwiseOR(F.coalesce(at, F.lit(0)))).drop(at, order), low


SCHEMA = "kept binary, n_bytes bigint, n_removed bigint, n_spans bigint"
_KIND = pa.struct([("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())])


def cut(text: bytes, spans: list[int] | None) -> dict:
    if not spans:
        return {"kept": text, "n_bytes": len(text), "n_removed": 0, "n_spans": 0}
    spans = np.array(spans, np.int64)
    gone = T.covered(spans >> 32, (spans >> 32) + (spans & 0xFFFFFFFF), len(text))
    return {"kept": np.frombuffer(text, np.uint8)[~gone].tobytes(), "n_bytes": len(text), "n_removed": int(gone.sum()), "n_spans": len(T.runs(gone)[0])}


def suffix_array_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", span: int = SPAN, into: str = "repeats") -> DataFrame:
    """All columns of docs and the struct `into` (SCHEMA), which replaces a column of that name. doc_id is an integer; span is 44 to 58."""

    def apply(column: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([cut(x, s) for x, s in zip(T.as_bytes(column), spans.to_pylist(), strict=True)], _KIND)

    def whole(column: pa.Array) -> pa.Array:
        return pa.array([cut(x, None) for x in T.as_bytes(column)], _KIND)

    doc, own, held, number = (fresh(docs, x) for x in ("_doc", "_spans", "_held", "_number"))
    raw = F.col(text).cast("binary")
    rows, low = _numbered(docs, doc_id, text, number)
    base = rows.select(F.col(number).alias("doc"), raw.alias("raw")).where(F.col("doc").isNotNull() & F.col("raw").isNotNull())
    spans = written(repeats(base, span, low).groupBy("doc").agg(F.collect_list("span").alias(own)), "spans").withColumnRenamed("doc", doc)
    # Documents that have no repeats stay where they are; the others meet their spans.
    marked = rows.withColumn(held, F.coalesce(IdFilter(spans, doc).may_hold(F.col(number)), F.lit(False)) & F.col(number).isNotNull())
    hit = marked.where(F.col(held)).join(spans, F.col(number) == F.col(doc), "left").withColumn(into, F.arrow_udf(apply, SCHEMA)(raw, F.col(own)))
    rest = marked.where(~F.col(held)).withColumn(into, F.arrow_udf(whole, SCHEMA)(raw))
    return hit.drop(held, doc, own, number).unionByName(rest.drop(held, number))
