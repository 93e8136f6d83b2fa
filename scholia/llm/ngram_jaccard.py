"""Exact n-gram Jaccard self-join by a blocked sparse matrix product.

The incidence matrix has a row for each distinct set of 5-word shingles (lower-cased A-Z, words between ASCII
white space) and a column for each shingle. Two rows link when 100 * overlap >= 80 * union. Overlaps are entries
of the matrix times its transpose. Of the matrix these columns enter:

* Documents of equal sets are one row; its number is their least doc_id. Copies never meet each other.
* Rows linked at 0.8 share one of the first n/5 + 1 of their n shingles, in any order common to all rows. The order
  is rare first, by a count sketch of fixed size, so that frequent shingles are left out wherever a row has others.
  Only these entries are multiplied. Columns of equal rows are multiplied once, with their number as weight.

The product is done in blocks of BLOCK by BLOCK rows of a column, inside tasks. A block adds a column's weight to each of its
pairs; Spark sums a pair's weights over all columns and blocks. With overlap c among the first entries, the whole overlap
is at most c plus the entries that the longer rest of the two rows has; pairs whose bound, or whose sizes, can't reach the
threshold are discarded. Pairs in one component already, and pairs whose bitmaps differ in more bits than linked rows of
such sizes differ in shingles, aren't accumulated. What is left is multiplied over whole rows.

Before the product, each column's rows meet some of its rows, its hubs, and the links found join components; what is
left in several components meets other hubs, in a few rounds. So a group of near copies costs a row or two for each of them, not for each pair. No link that matters
to a component is lost.

No task takes a whole column of any length: entries of columns that the sketch takes for frequent are dealt by column and a
share of the rows (the salt), their counts and least rows are aggregated in part before they are shuffled.

Null and empty texts have no shingles and link with nothing: they are their own component. With fewer than five
words, the whole sequence is one shingle. Rows that repeat a doc_id get equal results; a null doc_id is never
the number of a component (the component is null if no row of it has an id). Rows without an id get a number from
a hash of their text, beyond all ids, so they link as others do. (With an id of OWN or more in docs there is no room for
these numbers: rows without an id then join only the component of rows of an equal set.) Shingles, and the sets'
identity, are 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.llm import textnum as T
from scholia.llm.components import components
from scholia.llm.idfilter import IdFilter
from scholia.llm.tables import fresh, written

N, PERCENT = 5, 80
SKETCH = 1 << 17
BLOCK = 1024
#: Entries of a column, by the sketch, that go to one task; columns with more, and with so many times the sketch's mean, are split.
SPLIT, TIMES = 4096, 4
#: Rows of one text are dealt to so many tasks when they meet their component.
SHARES = 16
#: Entries of the product that a task holds before it sums them by pair.
PRODUCT = 200_000
#: Seeds of the hubs, round by round.
HUBS = ((1, 2), (3, 4, 5))
#: Pairs of rows that are looked at together, and words of their bitmaps that are looked at first.
PAIRS, FEW = 1 << 15, 8
#: Entries of a block of whole rows.
ENTRIES = 400_000
#: Numbers of rows without an id begin here.
OWN = 1 << 62
#: Bits of a row's bitmap: two rows differ in as many shingles, at least, as their bitmaps in bits.
BITMAP = 2048


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    if len(spans := list(T.slices(texts))) > 1:
        return [x for a, b in spans for x in shingle_sets(texts[a:b], n)]
    h, at = T.word_hashes(texts, T.NONSPACE, lower=True)
    return [np.unique(T.grams(h[a:b], min(n, b - a))) if b > a else np.zeros(0, np.uint64) for a, b in zip(at[:-1], at[1:], strict=True)]


def set_number(row: np.ndarray) -> int:
    import xxhash

    return int(np.uint64(xxhash.xxh3_64_intdigest(row.tobytes())).astype(np.int64)) if len(row) else 0


def _described(docs: DataFrame, text: str, doc_id: str, n: int) -> DataFrame:
    """kind 0: (doc_id, number of the set, size) by row; kind 1: (None, bucket of the sketch, count) by task."""
    columns = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        for batch in batches:
            rows = shingle_sets(T.as_bytes(batch.column(1)), n)
            for row in rows:
                sketch += np.bincount((row % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) if len(row) > SKETCH // 64 else 0
            small = [r for r in rows if len(r) <= SKETCH // 64]
            if small:
                sketch += np.bincount((np.concatenate(small) % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), batch.column(0), pa.array([set_number(r) for r in rows], pa.int64()), pa.array([len(r) for r in rows], pa.int64())], names=names)
        at = np.flatnonzero(sketch)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int32)), pa.nulls(len(at), pa.int64()), pa.array(at), pa.array(sketch[at])], names=names)

    names = ["kind", "doc_id", "k", "v"]
    return columns.mapInArrow(run, "kind int, doc_id bigint, k bigint, v bigint")


def first_entries(n: int, percent: int) -> int:
    """How many of a row's n entries, in the common order, a row that links with it must share one of."""
    return n - -(-percent * n // 100) + 1


def _prefixes(docs: DataFrame, text: str, sent, n: int, percent: int) -> DataFrame:
    """(shingle, salt, k, size): the rare shingles of each distinct set of an Arrow batch. salt: 0, or the share of a frequent column's rows, from 1."""

    def run(batches):
        sketch = sent.value
        most = max(SPLIT, int(TIMES * sketch.mean()))
        for batch in batches:
            seen, shingles, numbers, sizes, counts = set(), [], [], [], []
            for row in shingle_sets(T.as_bytes(batch.column(0)), n):
                k = set_number(row)
                if not len(row) or k in seen:
                    continue
                seen.add(k)
                count = sketch[(row % np.uint64(SKETCH)).astype(np.int64)]
                chosen = np.lexsort((row, count))[: first_entries(len(row), percent)]
                shingles.append(row[chosen])
                counts.append(count[chosen])
                numbers.append(k)
                sizes.append(len(row))
            if shingles:
                lengths = list(map(len, shingles))
                shares = np.concatenate(counts) // most
                k = np.repeat(numbers, lengths)
                salt = np.where(shares > 0, 1 + T.mix(k.astype(np.uint64)) % (shares + 1).astype(np.uint64), np.uint64(0)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(shingles).astype(np.int64)), pa.array(salt), pa.array(k), pa.array(np.repeat(sizes, lengths).astype(np.int32))], names=["shingle", "salt", "k", "size"])

    return docs.select(F.col(text).cast("binary").alias("text")).mapInArrow(run, "shingle bigint, salt int, k bigint, size int")


def _columns(prefixes: DataFrame, numbers: DataFrame) -> DataFrame:
    """(shingle, salt, node, size, m, weight): entries of columns that two rows or more share, one of those of equal rows. m: the column's entries; weight: the number of equal columns."""
    rows = prefixes.repartition("shingle", "salt").groupBy("shingle", "salt", "k").agg(F.first("size").alias("size"))
    share = Window.partitionBy("shingle", "salt").orderBy("k")  # a share of a frequent column, or a column that isn't
    shared = rows.withColumn("near", F.coalesce(F.lag("k").over(share), F.lead("k").over(share))).where("near IS NOT NULL OR salt > 0")
    rows = written(shared.select("shingle", "salt", "k", "size"), "shared")
    marks = rows.groupBy("shingle").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("k")).alias("x"), F.bit_xor(F.xxhash64(F.lit(3), "k")).alias("y")).where("m > 1")
    one = marks.groupBy("m", "x", "y").agg(F.min("shingle").alias("shingle"), F.count("*").alias("weight")).select("shingle", "m", "weight")
    kept = rows.join(one.join(_shares(rows), "shingle"), ["shingle", "salt"])
    return kept.join(numbers, "k").select("shingle", "salt", "node", "size", "m", "weight")


def _shares(rows: DataFrame) -> DataFrame:
    return rows.select("shingle", "salt").distinct()


def bitmap(row: np.ndarray, size: int = BITMAP) -> bytes:
    bits = np.zeros(size, np.uint8)
    bits[(row >> np.uint64(20)) % np.uint64(size)] = 1
    return np.packbits(bits).tobytes()


def _fine(n: int) -> int:
    """Bits in proportion to a row's size: a power of two."""
    return 1 << max(8, (4 * n).bit_length())


def _folded(a: bytes, b: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps brought to the smaller one's size; they still differ in no more places than the rows."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    least = min(len(x), len(y))
    return np.bitwise_or.reduce(x.reshape(-1, least), 0), np.bitwise_or.reduce(y.reshape(-1, least), 0)


def _may_link(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes and bitmaps allow a link. With overlap o and union u = sizes - o, o >= percent * u / 100 leaves
    u - o <= sizes * (100 - percent) / (100 + percent)."""
    sizes = size_a + size_b
    ok = 100 * np.minimum(size_a, size_b) >= percent * np.maximum(size_a, size_b)
    return ok & ((100 + percent) * np.bitwise_count(a ^ b).sum(-1, dtype=np.int64) <= (100 - percent) * sizes)


def _words(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), BITMAP // 64)


def _may_reach(size_x: Column, size_y: Column, c: Column, percent: int) -> Column:
    """Whether rows that share c of their first entries may link: common entries beyond them are among the rest of the row whose first entries end first."""
    rest = F.greatest(*(F.ceil(s * percent / F.lit(100)) - 1 for s in (size_x, size_y)))
    return (c + rest) * (100 + percent) >= percent * (size_x + size_y)


def _with_hubs(columns: DataFrame, percent: int, seeds: tuple[int, ...]) -> DataFrame:
    """Pairs (x, y) of a column's rows with its hubs, as far as sizes allow a link and they aren't in one component: the smallest row, and those picked by a hash, which columns of one group have in common."""
    row = F.struct("size", "node", "label")
    picks = [F.min(row), *(F.min_by(row, F.xxhash64(F.lit(seed), "node")) for seed in seeds)]  # in part before the shuffle
    hubs = columns.groupBy("shingle").agg(F.array(*picks).alias("hubs")).withColumn("hubs", F.array_distinct("hubs"))
    of_shares = hubs.join(_shares(columns), "shingle").select("shingle", "salt", F.explode("hubs").alias("hub"))
    near = (F.col("label") != F.col("hub.label")) & (100 * F.least("size", "hub.size") >= percent * F.greatest("size", "hub.size"))
    return columns.join(of_shares, ["shingle", "salt"]).where(near).select(F.least("node", "hub.node").alias("x"), F.greatest("node", "hub.node").alias("y")).distinct()


def _in_blocks(columns: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of rows in different components whose overlap, accumulated over all columns, may reach the threshold. columns: with label, bits and family."""
    blocks = F.expr(f"(m + {BLOCK - 1}) div {BLOCK}")
    rows = columns.withColumn("own", F.pmod(F.xxhash64("node"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    # Columns of one family of rows go to one task, where the weights of a pair meet; a family of many rows is dealt by block.
    rows = rows.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "weight", "node", "size", "label", "bits", "family")
    rows = rows.repartition("family", "i", "j").sortWithinPartitions("shingle", "i", "j", "own").drop("family")
    names = ["x", "y", "c", "size_x", "size_y"]
    product = rows.mapInArrow(lambda batches: _products(batches, percent, names), ", ".join(f"{c} bigint" for c in names)).groupBy("x", "y").agg(F.sum("c").alias("c"), F.first("size_x").alias("size_x"), F.first("size_y").alias("size_y"))
    return product.where(_may_reach(F.col("size_x"), F.col("size_y"), F.col("c"), percent)).select("x", "y")


def _products(batches, percent: int, names: list[str]):
    """The product's entries (x, y, weight, sizes), weights summed over the columns at hand. batches: rows in the order of (shingle, i, j, own);
    all blocks that end in a batch are multiplied at once, as most are of a few rows. Pairs that can't link are 0 in the product and left out."""
    found: list[np.ndarray] = []

    def closed():
        rows = np.concatenate([np.zeros((0, 5), np.int64), *found])
        found.clear()
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        new = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)][: len(rows)])
        c = np.add.reduceat(rows[:, 2], new) if len(new) else rows[:, 2]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (rows[new, 0], rows[new, 1], c, rows[new, 3], rows[new, 4])], names=names)

    def multiplied(rows: pa.Table, starts: np.ndarray):
        """rows: whole blocks, that begin at starts."""
        i, j, own, weight, node, size, label = (rows[c].to_numpy() for c in ("i", "j", "own", "weight", "node", "size", "label"))
        bits = _words(rows["bits"])
        size = size.astype(np.int64)
        at = np.arange(len(own))
        lengths = np.diff(np.r_[starts, len(own)])
        # A row meets those after it in a block of i = j, else a row of i those of j, which end the block.
        of_i = np.add.reduceat((own == i).astype(np.int64), starts)
        first = np.where(i == j, at + 1, np.repeat(starts + of_i, lengths))
        met = np.where(own == i, np.repeat(starts + lengths, lengths) - first, 0)
        ends = np.cumsum(met)
        for a, b in _pieces(ends):
            n = met[a:b]
            left = np.repeat(at[a:b], n)
            right = np.repeat(first[a:b] - (ends[a:b] - n), n) + np.arange(ends[a] - met[a], ends[b - 1])
            near = (label[left] != label[right]) & (100 * np.minimum(size[left], size[right]) >= percent * np.maximum(size[left], size[right]))
            for some in (FEW, None):  # a part of the bits settles most pairs
                left, right = left[near], right[near]
                near = _may_link(bits[left, :some], bits[right, :some], size[left], size[right], percent)
            left, right = left[near], right[near]
            least, most = np.where(node[left] < node[right], (left, right), (right, left))
            yield np.stack([node[least], node[most], weight[left], size[least], size[most]], 1)

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        key = np.stack([rows[c].to_numpy() for c in ("shingle", "i", "j")], 1)
        starts = np.r_[0, np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1]
        held = rows.slice(starts[-1])
        if len(starts) > 1:
            for block in multiplied(rows.slice(0, starts[-1]), starts[:-1]):
                found.append(block)
                if sum(map(len, found)) > PRODUCT:
                    yield closed()
    if held is not None:
        for block in multiplied(held, np.zeros(1, np.int64)):
            found.append(block)
            if sum(map(len, found)) > PRODUCT:
                yield closed()
    yield closed()


def _pieces(ends: np.ndarray):
    """Ranges (a, b) of rows that make PAIRS pairs together, or one row's. ends: the pairs up to each row's end."""
    a = done = 0
    while done < (ends[-1] if len(ends) else 0):
        b = max(a + 1, int(np.searchsorted(ends, done + PAIRS, "right")))
        yield a, b
        a, done = b, ends[b - 1]


def _of_nodes(nodes: DataFrame, docs: DataFrame, text: str, doc_id: str, n: int, what: str, describe) -> DataFrame:
    """(id, r) of the nodes (id): describe() of their sorted shingles. Only their texts are shuffled and hashed."""
    wanted = IdFilter(nodes, "id")

    def run(column: pa.Array) -> pa.Array:
        return pa.array(list(map(describe, shingle_sets(T.as_bytes(column), n))), pa.struct([(c, pa.int64() if c == "size" else pa.binary()) for c in (x.split()[0] for x in what.split(", "))]))

    some = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("binary").alias("_text"))
    some = some.where(wanted.may_hold(F.col("id"))).join(nodes, "id", "left_semi")
    return some.groupBy("id").agg(F.first("_text").alias("_text")).select("id", F.arrow_udf(run, what)("_text").alias("r")).select("id", "r.*")


def _verified(pairs: DataFrame, marks: DataFrame, rows_of, percent: int) -> DataFrame:
    """Those of the pairs (x, y) of ids that link, by their rows' whole overlap."""

    def near(batches):
        for batch in batches:
            fine = [_folded(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)]
            sizes = zip(batch.column(3).to_pylist(), batch.column(5).to_pylist(), strict=True)
            ok = pa.array([bool(_may_link(a, b, i, j, percent)) for (a, b), (i, j) in zip(fine, sizes, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["x", "y"])

    # First by bitmaps in proportion to the rows, a sixteenth of their size; then by the rows.
    fine_x, fine_y = (marks.select(F.col("id").alias(s), F.col("fine").alias(f"fine_{s}"), F.col("size").alias(f"size_{s}")) for s in "xy")
    left = written(pairs.join(fine_x, "x").join(fine_y, "y").select("x", "y", "fine_x", "size_x", "fine_y", "size_y").mapInArrow(near, "x bigint, y bigint"), "near")
    ids = left.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    rows = written(rows_of(ids), "rows")
    row_x, row_y = (rows.select(F.col("id").alias(s), F.col("row").alias(f"row_{s}")) for s in "xy")
    joined = left.join(row_x, "x").join(row_y, "y").select("x", "y", "row_x", "row_y")

    def multiply(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        """A block of the product: overlaps of a[i] and b[i], as entries (pair, shingle) that both sides have."""
        pair = np.repeat(np.r_[np.arange(len(a)), np.arange(len(b))], [*map(len, a), *map(len, b)])
        value = np.concatenate([*a, *b])
        order = np.lexsort((value, pair))
        pair, value = pair[order], value[order]
        return np.bincount(pair[1:][(pair[1:] == pair[:-1]) & (value[1:] == value[:-1])], minlength=len(a))

    def overlap(batches):
        for batch in batches:
            a, b = ([np.frombuffer(r, np.uint64) for r in batch.column(c).to_pylist()] for c in (2, 3))
            size_a, size_b = np.array(list(map(len, a)), int), np.array(list(map(len, b)), int)
            cuts = np.r_[0, np.flatnonzero(np.diff(np.cumsum(size_a + size_b) // ENTRIES)) + 1, len(a)]
            both = np.concatenate([multiply(a[i:j], b[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if j > i] or [np.zeros(0, int)])
            ok = pa.array(100 * both >= percent * (size_a + size_b - both))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["x", "y"])

    return joined.mapInArrow(overlap, "x bigint, y bigint")


def without_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", **options) -> DataFrame:
    """docs without those that aren't the first of their component. Rows that share a doc_id, and rows without one, stay."""
    found = ngram_jaccard(docs, text, doc_id, **options)
    gone = written(found.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias(fresh(docs, "_gone"))).distinct(), "gone")
    name, number = gone.columns[0], F.col(doc_id).cast("bigint")
    # Only rows that may have to go are shuffled.
    maybe = F.coalesce(IdFilter(gone, name).may_hold(number), F.lit(False))
    return docs.where(~maybe).unionByName(docs.where(maybe).join(gone, number == F.col(name), "left_anti"))


def ngram_jaccard(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = N, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs."""
    number = F.col(doc_id).cast("bigint")
    without, most = docs.agg(F.count_if(number.isNull()), F.max(number)).collect()[0]
    if not without or (most is not None and most >= OWN):
        return _linked(docs, text, doc_id, n, percent)
    own = F.xxhash64(F.col(text).cast("binary")).bitwiseAND(F.lit(OWN - 1)).bitwiseOR(F.lit(OWN))
    found = _linked(docs.select(F.coalesce(number, own).alias("doc_id"), F.col(text).alias("text")), "text", "doc_id", n, percent)
    true = lambda c: F.when(F.col(c) < F.lit(OWN), F.col(c)).alias(c)
    return found.select(true("doc_id"), "n_shingles", true("component_id"))


def _linked(docs: DataFrame, text: str, doc_id: str, n: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    told = written(_described(docs, text, doc_id, n), "sets")
    sketch = np.zeros(SKETCH, np.int64)
    counts = told.where("kind = 1").groupBy("k").agg(F.sum("v").alias("v")).toArrow()  # SKETCH rows at most
    sketch[counts["k"].to_numpy()] = counts["v"].to_numpy()
    sets = told.where("kind = 0").select("doc_id", "k", F.col("v").alias("n_shingles"))
    full = sets.where("n_shingles > 0")
    numbers = full.groupBy("k").agg(F.min("doc_id").alias("node"), F.count("*").alias("copies"))
    nodes = numbers.where("node IS NOT NULL").select("k", "node")
    columns = written(_columns(_prefixes(docs, text, spark.sparkContext.broadcast(sketch), n, percent), nodes), "columns")
    bitmaps = lambda r: {"fine": bitmap(r, _fine(len(r))), "bits": bitmap(r), "size": len(r)}
    marks = written(_of_nodes(columns.select(F.col("node").alias("id")).distinct(), docs, text, doc_id, n, "fine binary, bits binary, size bigint", bitmaps), "marks")

    def rows_of(ids: DataFrame) -> DataFrame:
        return _of_nodes(ids, docs, text, doc_id, n, "row binary", lambda r: {"row": r.tobytes()})


    def labelled(labels: DataFrame | None) -> DataFrame:
        return columns.withColumn("label", F.col("node")) if labels is None else columns.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))

    def several(labels: DataFrame | None) -> DataFrame:
        """Entries of columns with rows of two components or more; all of them, so that a pair's overlap is accumulated in full."""
        rows = labelled(labels)
        found = rows.groupBy("shingle").agg(F.min("label").alias("a"), F.max("label").alias("b"), F.min_by("node", F.xxhash64(F.lit(9), "node")).alias("family"))
        return rows.join(found.where("a < b").join(_shares(rows), "shingle").select("shingle", "salt", "family"), ["shingle", "salt"])

    def joined_by(links: DataFrame, labels: DataFrame | None) -> DataFrame | None:
        if links.isEmpty():
            return labels
        return components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("x"), F.col("label").alias("y"))))

    labels = tested = None
    for seeds in HUBS:
        pairs = _with_hubs(several(labels), percent, seeds)
        pairs = written(pairs if tested is None else pairs.join(tested, ["x", "y"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        labels = joined_by(written(_verified(pairs, marks, rows_of, percent), "links"), labels)
    opened = several(labels).join(marks.select(F.col("id").alias("node"), "bits"), "node")
    pairs = written(_in_blocks(opened, percent).join(tested, ["x", "y"], "left_anti"), "pairs")
    labels = joined_by(written(_verified(pairs, marks, rows_of, percent), "links"), labels)

    found = numbers.where("copies > 1 or node is null")
    if labels is not None:
        found = numbers.join(labels, "node", "left").where("copies > 1 or label is not null or node is null").select("k", F.coalesce("label", "node").alias("node"))
    # Copies of one text are dealt to SHARES tasks by their place in the written table.
    share = F.pmod(F.monotonically_increasing_id(), F.lit(SHARES))
    left = sets.withColumn("_share", share)
    right = found.select(F.col("k").alias("_k"), F.col("node").alias("_node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SHARES - 1).cast("bigint"))).alias("_at"))
    joined = left.join(right, (F.col("k") == F.col("_k")) & (F.col("_share") == F.col("_at")) & (F.col("n_shingles") > 0), "left")
    return joined.select("doc_id", "n_shingles", F.coalesce("_node", "doc_id").alias("component_id"))
