"""Line dedup, decontamination, substring dedup, n-gram Jaccard join: against plain versions."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scholia.llm import decontamination, line_dedup, ngram_jaccard, suffix_array
from scholia.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def key(line):
    return lowered(line.strip(" \t\n\r\x0b\x0c"))


def lines_left(texts, least):
    seen = Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) and seen[key(x)] >= least)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("keys_to_send", [1000, 0])
@pytest.mark.parametrize(("least", "batches"), [(10, 4), (2, 1)])
def test_lines(odd_docs, texts, keys_to_send, least, batches):
    got = line_dedup.line_dedup(odd_docs, least=least, batches=batches, keys_to_send=keys_to_send).collect()
    want = Counter((i, *x) for (i, *_), x in zip(texts, lines_left([t for _, t, *_ in texts], least), strict=True))
    assert Counter((r["doc_id"], r["lines"]["n_lines"], r["lines"]["n_dropped"], r["lines"]["kept_text"]) for r in got) == want
    assert got[0]["rules"] == "mine"


def test_runs_are_levelled_and_lose_nothing(spark):
    rng = random.Random(2)
    runs, total = line_dedup.SortedRuns(least=5, fanout=2), Counter()
    for _ in range(7):
        batch = Counter(rng.randrange(40) for _ in range(60))
        total.update(batch)
        runs.add(spark.createDataFrame([(k, k, n) for k, n in batch.items()], "a bigint, b bigint, n bigint"))
        assert all(len(x) < 2 for x in runs.levels.values())
    got = {r["a"] for r in runs.close().collect()}
    assert got == {k for k, n in total.items() if n >= 5}


def contaminated(docs, items):
    windows = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).add(item)
    sizes = {len(x) for x in windows}
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if own := windows.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out.append((doc, len(w), len(hit), tuple(sorted(map(str, found)))))
    return Counter(out)


@pytest.mark.parametrize("bits", [1 << 25, 1 << 6])
@pytest.mark.parametrize("threshold", ["10MB", "-1"])
def test_benchmark(spark, monkeypatch, odd_docs, texts, bits, threshold):
    """Null and repeated ids included; with a full bitmap, and where every join is by shuffle."""
    monkeypatch.setattr(decontamination, "BITS", bits)
    own = [(7, "one other text"), (7, next(t for i, t, *_ in texts if i == 5)), (None, "alpha of the end"), (None, "nothing"), (None, None)]
    docs = odd_docs.unionByName(spark.createDataFrame(own, "doc_id bigint, text string"), allowMissingColumns=True)
    rows = [(i, t) for i, t, *_ in texts] + own
    shared = next(t for i, t in rows if i == 6)
    words = shared.split()
    items = [(1, shared), (2, shared), (3, " ".join(words[20:30])), (4, " ".join(words[5:14])), (5, "alpha"), (6, "A b, C"), (7, None), (8, ""), (9, "nothing of this is there in any of the documents at all"), (10, " ".join(words[50:]) + " and then some other words follow on"), (None, shared), (11, "word " * 12)]
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        got = decontamination.decontaminate(docs, benchmark).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert Counter((r["doc_id"], r["hits"]["n_words"], r["hits"]["n_hit"], tuple(r["hits"]["items"])) for r in got) == contaminated(rows, [x for x in items if x[0]])
    assert all(sum(s["end"] - s["start"] for s in r["hits"]["spans"]) == r["hits"]["n_hit"] for r in got)


def test_benchmark_of_nothing_and_repeated_rows(spark, odd_docs, no_docs):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.decontaminate(odd_docs, none).where("hits.n_hit > 0").count() == 0
    assert decontamination.decontaminate(no_docs, none).count() == 0
    one = spark.createDataFrame([(1, odd_docs.where("doc_id = 40").first()["text"])], "item_id bigint, text string")
    assert decontamination.decontaminate(odd_docs, one).where("hits.n_hit > 0 AND doc_id = 40").count() == 2


def test_equal_windows_have_equal_fingerprints():
    import numpy as np

    from scholia.llm import textnum as T

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(n)).encode() for n in (600, 9, 10, 0, 11, 300)]
    h, offsets = T.word_hashes(texts, T.ALNUM, lower=True)
    start, end, prints = decontamination.fingerprints(h, offsets)
    windows = T.grams(h, 10)
    of = {}
    for s, e, p in zip(start, end, prints, strict=True):
        for w in range(s, e):
            assert w not in of
            of[w] = p
    inside = np.flatnonzero(T.within(offsets, 10, len(h)))
    assert sorted(of) == inside.tolist()
    assert all(of[w] == T.grams(h, 5)[w : w + 6].min() for w in of)
    one, _ = T.word_hashes([b" ".join(texts[0].split()[40:50])], T.ALNUM, lower=True)
    alone = decontamination.fingerprints(one, np.array([0, 10]))
    assert alone[2].tolist() == [of[40]] and T.grams_at(one, np.array([0]), 10)[0] == windows[40]


def test_words_of_one_polynomial_hash_apart():
    """Thue-Morse words and their complements, which collide in any polynomial hash modulo 2 ** 64."""
    from scholia.llm import textnum as T

    for n in (256, 1024, 2048, 4096):
        a = bytes(97 + i.bit_count() % 2 for i in range(n))
        h, _ = T.word_hashes([a, bytes(195 - x for x in a)], T.ALNUM, lower=True)
        assert h[0] != h[1]


def bytes_left(rows, span=50):
    """rows: (doc_id, bytes). By (doc_id, bytes)."""
    first = {}
    for doc, b in rows:
        for i in range(len(b) - span + 1):
            s = b[i : i + span]
            first[s] = min(first.get(s, doc), doc)
    out = {}
    for doc, b in rows:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < doc:
                gone[i : i + span] = b"\1" * span
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[doc, b] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


def repeated_documents(seed):
    rng = random.Random(seed)
    alphabet = rng.choice([b"ab", b"abcdefgh ", bytes(range(97, 123))])
    noise = lambda n: bytes(rng.choice(alphabet) for _ in range(n))
    passages = [noise(rng.choice([49, 50, 51, 80, 200])) for _ in range(5)]
    rows = []
    for doc in rng.sample(range(1000), 40):
        parts = [rng.choice([noise(rng.randrange(60)), rng.choice(passages), rng.choice(passages)[rng.randrange(20) :]]) for _ in range(rng.randrange(5))]
        rows.append((doc, b"".join(parts)))
    rows += [(1001, rows[3][1]), (1002, rows[3][1]), (1003, b"z" * 400), (1004, b"z" * 130), (1005, b"")]
    return rows


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("small", [False, True])
def test_substrings(spark, monkeypatch, seed, small):
    if small:  # parts of documents, and few rows at a time
        monkeypatch.setattr(suffix_array, "SLICE", 97)
        monkeypatch.setattr(suffix_array, "WINDOWS", 30)
        monkeypatch.setattr(suffix_array, "HELD", 3)
    rows = repeated_documents(seed)
    want = bytes_left(rows)
    # The steps as Spark runs them, in this process, so that the limits hold.
    import pyarrow as pa

    held, size, runs = [], 0, []
    for doc, b in rows:
        for start in range(0, max(1, len(b) - 49), suffix_array.SLICE):
            runs.append(suffix_array._runs_of([(doc, b[start : start + suffix_array.SLICE + 49], start)], 50))
    columns = [pa.array(x) for x in map(list, zip(*((v for r in runs if r is not None for v in zip(*r, strict=True)))))] if any(r is not None for r in runs) else None
    table = pa.table(columns, names=suffix_array._NAMES).sort_by([(n, "ascending") for n in ("gram", "rank", "doc")])
    found = pa.Table.from_batches(list(suffix_array._classes(iter(table.to_batches(max_chunksize=7)), 50)))
    spans = {}
    opened = {}
    for kind, doc, start, n in zip(*(c.to_pylist() for c in found.columns), strict=True):
        (spans if kind == suffix_array.REPEAT else opened).setdefault(doc, []).append((start, n))
    windows = [(b[i : i + 50], doc, i) for doc, b in rows for start, n in opened.get(doc, []) for i in range(start, start + n)]
    first = {}
    for w, doc, _ in windows:
        first[w] = min(first.get(w, doc), doc)
    for w, doc, i in windows:
        if first[w] < doc:
            spans.setdefault(doc, []).append((i, 50))
    for doc, b in rows:
        r = suffix_array.cut(b, [s << 32 | n for s, n in spans.get(doc, [])])
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept"]) == want[doc, b], doc
    assert held == [] and size == 0


def removed_in_spark(docs):
    got = suffix_array.suffix_array_dedup(docs).collect()
    return Counter((r["doc_id"], bytes((r["text"] or "").encode()), r["repeats"]["n_bytes"], r["repeats"]["n_removed"], r["repeats"]["n_spans"], bytes(r["repeats"]["kept"])) for r in got)


@pytest.mark.parametrize("seed", [9, 10, 11])
@pytest.mark.parametrize("share", [1 / 8, 0.0])
def test_substrings_in_spark(spark, monkeypatch, seed, share):
    """share 0: many grams are dealt as frequent ones."""
    monkeypatch.setattr(suffix_array, "SAMPLED", 2)
    monkeypatch.setattr(suffix_array, "SHARE", share)
    rows = [(i, b) for i, b in repeated_documents(seed) if b.isascii()]
    docs = spark.createDataFrame([(i, b.decode()) for i, b in rows], "doc_id bigint, text string").repartition(3)
    want = bytes_left(rows)
    assert removed_in_spark(docs) == Counter((i, b, *want[i, b]) for i, b in rows)


@pytest.mark.parametrize("large", [0, (1 << 62) - 3])
def test_one_id_on_several_texts(spark, large):
    """Each of its texts is judged against smaller ids only; ids with room for a text's number, and without."""
    rng = random.Random(4)
    prose = [bytes(rng.choice(b"abcdefgh ") for _ in range(160)) for _ in range(4)]
    rows = [(3, prose[0]), (3, prose[1] + prose[0][:70]), (3, b"short"), (3, prose[0]), (5, prose[0][20:] + prose[2]), (5, prose[2] + b"!"), (5, prose[1]), (7, prose[2]), (7, b""), (-2, prose[3]), (8, prose[3]), (large + 9, prose[3][:90])]
    want = bytes_left(rows)
    docs = spark.createDataFrame([(i, b.decode()) for i, b in rows] + [(None, prose[0].decode()), (3, None)], "doc_id bigint, text string").repartition(3)
    extra = [(None, prose[0], 160, 0, 0, prose[0]), (3, b"", 0, 0, 0, b"")]
    assert removed_in_spark(docs) == Counter([(i, b, *want[i, b]) for i, b in rows] + extra)


def test_ranks_are_equal_where_the_bytes_are():
    import numpy as np

    rng = random.Random(2)
    text = bytes(rng.choice(b"ab") for _ in range(400)) * 2 + bytes(rng.choice(b"abc") for _ in range(300))
    ranks = suffix_array.Ranks(np.frombuffer(text, np.uint8))
    assert sorted(ranks.levels) == [12, 24, 48]
    for length in (12, 20, 24, 40, 48, 50, 60, 88, 96):
        start = np.arange(len(text) - length + 1)
        named, seen = ranks.of(start, length).tolist(), {}
        for i, r in enumerate(named):
            assert seen.setdefault(text[i : i + length], r) == r
        assert len(set(seen.values())) == len(seen)
    # A rank is the name of two earlier ranks.
    r24, r48 = ranks.levels[24], ranks.levels[48]
    assert (suffix_array.name(r24[: len(r48)], r24[24 : 24 + len(r48)]) == r48).all()


@pytest.mark.parametrize("parts", [1, 2])
def test_unlike_runs_whose_hashes_begin_alike_stay(spark, parts):
    """One gram, and content hashes that agree in their first 36 bits: in one slice, and in two tasks."""
    rows = [(1, "efkkecphmjjxmeavudkapdztjzpfjeqpbihejcdykfyuptuhic"), (2, "vqwtscstcqpstanrtwfxxnbakzcoebqpbihejcdykffnhlucmr"), (3, "efkkecphmjjxmeavudkapdztjzpfjeqpbihejcdykfyuptuhic")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs = docs.coalesce(1) if parts == 1 else docs.repartitionByRange(2, "doc_id")
    got = {r["doc_id"]: bytes(r["repeats"]["kept"]).decode() for r in suffix_array.suffix_array_dedup(docs).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_substrings_of_odd_rows(odd_docs, no_docs, texts):
    short = odd_docs.where("doc_id IS NULL OR doc_id NOT IN (9, 10)")
    rows = [(i, (t or "").encode()) for i, t, *_ in texts if i not in (9, 10)]
    want = bytes_left([x for x in rows if x[0] is not None])
    got = suffix_array.suffix_array_dedup(short).collect()
    assert len(got) == len(rows)
    for r in got:
        n, removed, spans, kept = want.get((r["doc_id"], (r["text"] or "").encode()), (len((r["text"] or "").encode()), 0, 0, (r["text"] or "").encode()))
        assert (r["repeats"]["n_bytes"], r["repeats"]["n_removed"], r["repeats"]["n_spans"], bytes(r["repeats"]["kept"])) == (n, removed, spans, kept)
        assert r["_spans"] == "mine"
    assert suffix_array.suffix_array_dedup(no_docs).count() == 0
    assert suffix_array.suffix_array_dedup(odd_docs).count() == len(texts)


def shingles(text):
    w = SPACED.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def linked(rows):
    """(doc_id, n_shingles, component_id) by brute force; ids distinct."""
    sets = {i: shingles(t) for i, t in rows}
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((root(i), root(j)))
                label[q] = p
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") + str(rng.randrange(60))
    rows = []
    for family in range(6):
        base = [word() for _ in range(rng.choice([3, 6, 24, 60, 300]))]
        for k in range(rng.randrange(1, 25)):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = word()
            rows.append((rng.randrange(10**6), " ".join(own)))
        chain = [word() for _ in range(120)]
        for k in range(8):  # each like the next, the ends unlike
            chain[k * 12 : k * 12 + 3] = [word() for _ in range(3)]
            rows.append((10**6 + family * 100 + k, " ".join(chain)))
    return list({i: (i, t) for i, t in rows}.values())


@pytest.mark.parametrize("block", [1024, 4])
@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("split", [4096, 3])
def test_components_of_near_copies(spark, monkeypatch, seed, block, split):
    """In small blocks, and with most columns split."""
    monkeypatch.setattr(ngram_jaccard, "BLOCK", block)
    monkeypatch.setattr(ngram_jaccard, "SPLIT", split)
    rows = near_copies(seed)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_jaccard.ngram_jaccard(docs).collect()}
    assert got == linked(rows)


def test_accumulated_overlaps_bound_the_whole_overlap(spark):
    """No pair that links is discarded by its count of shared first entries, whatever the order of shingles."""
    rng = random.Random(7)
    rows = []
    for _ in range(3000):
        n = rng.randrange(1, 60)
        x = set(rng.sample(range(200), n))
        y = set(x)
        for _ in range(rng.randrange(0, max(1, n // 4) + 1)):
            y.discard(rng.choice(sorted(x)))
            if rng.random() < 0.6:
                y.add(rng.randrange(200))
        if y and 100 * len(x & y) >= 80 * len(x | y):
            px, py = (set(sorted(s)[: ngram_jaccard.first_entries(len(s), 80)]) for s in (x, y))
            assert px & py
            rows.append((len(x), len(y), len(px & py)))
    df = spark.createDataFrame(rows, "a bigint, b bigint, c bigint")
    assert len(rows) > 500 and df.where(~ngram_jaccard._may_reach(F.col("a"), F.col("b"), F.col("c"), 80)).count() == 0
    assert spark.createDataFrame([(100, 100, 1), (100, 100, 8)], "a bigint, b bigint, c bigint").where(ngram_jaccard._may_reach(F.col("a"), F.col("b"), F.col("c"), 80)).count() == 0


@pytest.mark.parametrize("pairs", [1, 7, 1 << 15])
@pytest.mark.parametrize("cut", [3, 1000])
def test_blocks_are_multiplied_together(monkeypatch, pairs, cut):
    """The product of 600 columns, most of two or three rows, equals plain loops; its passes follow the pairs at hand, not the columns."""
    monkeypatch.setattr(ngram_jaccard, "PAIRS", pairs)
    rng, passes = random.Random(pairs), []
    may_link = ngram_jaccard._may_link
    monkeypatch.setattr(ngram_jaccard, "_may_link", lambda *a: passes.append(len(a[0])) or may_link(*a))
    base = np.arange(1, 61, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    sets = [np.sort(np.r_[base[: 60 - rng.randrange(9)], np.array([rng.getrandbits(64) for _ in range(rng.choice([0, 2, 40]))], np.uint64)]) for _ in range(80)]
    rows, plain = [], Counter()
    for shingle in range(600):
        i, j = rng.choice([(0, 0), (0, 1), (2, 2), (1, 2)])
        mine = [(rng.choice([i, j]), rng.randrange(80)) for _ in range(rng.choice([1, 2, 2, 3, 30 if shingle % 50 == 0 else 2]))]
        mine = sorted({node: own for own, node in mine}.items(), key=lambda x: x[1])
        weight = rng.randrange(1, 4)
        rows += [{"shingle": shingle, "i": i, "j": j, "own": own, "weight": weight, "node": node, "size": len(sets[node]), "label": node % 70, "bits": ngram_jaccard.bitmap(sets[node])} for node, own in mine]
        for (x, a), (y, b) in itertools.combinations(mine, 2):
            if (i == j or a != b) and x % 70 != y % 70:
                differ = sum((p ^ q).bit_count() for p, q in zip(ngram_jaccard.bitmap(sets[x]), ngram_jaccard.bitmap(sets[y]), strict=True))
                small, large = sorted((len(sets[x]), len(sets[y])))
                if 100 * small >= 80 * large and 180 * differ <= 20 * (small + large):
                    plain[min(x, y), max(x, y), len(sets[min(x, y)]), len(sets[max(x, y)])] += weight
    table = pa.Table.from_pylist(rows)
    batches = [b for a in range(0, len(rows), cut) for b in table.slice(a, cut).to_batches()]
    got = Counter()
    for batch in ngram_jaccard._products(iter(batches), 80, ["x", "y", "c", "size_x", "size_y"]):
        for r in batch.to_pylist():
            got[r["x"], r["y"], r["size_x"], r["size_y"]] += r["c"]
    assert got == plain and len(plain) > 50
    if pairs > 7 and cut > 3:
        assert len(passes) < 20


def test_near_copies_without_an_id_link(spark):
    words = [f"w{i}" for i in range(120)]
    chain = []
    for k in range(3):  # each like the next, the ends unlike
        words[k * 12 : k * 12 + 3] = [f"x{k}", f"y{k}", f"z{k}"]
        chain.append(" ".join(words))
    other = [f"v{i}" for i in range(100)]
    alone = [" ".join(other), " ".join([*other[:-1], "u"])]
    sets = [shingles(t) for t in chain]
    near = lambda x, y: 100 * len(x & y) >= 80 * len(x | y)
    assert near(sets[0], sets[1]) and near(sets[1], sets[2]) and not near(sets[0], sets[2])
    rows = [(7, chain[0]), (None, chain[1]), (5, chain[2]), (None, alone[0]), (None, alone[1]), (None, None), (9, "a b c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["component_id"], r["n_shingles"]) for r in ngram_jaccard.ngram_jaccard(docs).collect())
    assert got == Counter([(7, 5, 116), (None, 5, 116), (5, 5, 116), (None, None, 96), (None, None, 96), (None, None, 0), (9, 9, 1)])
    left = ngram_jaccard.without_copies(docs).collect()
    assert Counter(r["doc_id"] for r in left) == Counter([None] * 4 + [5, 9])


def test_near_copies_of_odd_rows(odd_docs, no_docs, texts):
    want = linked(list({i: (i, t) for i, t, *_ in texts if i is not None}.values()))
    got = ngram_jaccard.ngram_jaccard(odd_docs).collect()
    assert len(got) == len(texts)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == want[r["doc_id"]]
        else:
            assert r["component_id"] == 6
    assert ngram_jaccard.ngram_jaccard(no_docs).count() == 0
    kept = ngram_jaccard.without_copies(odd_docs)
    assert kept.columns == odd_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(i for i, *_ in texts if i is None or want[i][1] == i)


def test_components_of_a_long_path(spark):
    rng = random.Random(1)
    order = rng.sample(range(60), 60)
    links = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(100, 101), (102, 101)], "x bigint, y bigint")
    got = {r["node"]: r["label"] for r in components(links).collect()}
    assert got == {i: 0 for i in range(60)} | {100: 100, 101: 100, 102: 100}
    assert components(links.limit(0)).count() == 0


def test_filter_lets_all_wanted_rows_through(spark):
    from scholia.llm.idfilter import IdFilter

    wanted = spark.range(0, 5000, 7)
    kept = spark.range(5000).where(IdFilter(wanted, "id").may_hold(F.col("id")))
    assert wanted.join(kept, "id", "left_anti").count() == 0 and kept.count() < 1000
