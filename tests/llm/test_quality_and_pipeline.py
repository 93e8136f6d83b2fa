from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scholia.llm import line_dedup, ngram_jaccard, packing, quality_classifier, tokens
from scholia.llm.queries import QUERIES


def test_good_documents_stay_and_poor_and_toxic_ones_go(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = QUERIES["op4_quality_classifier"](spark, sf_dir).join(labels, "doc_id")
    share = {(r["quality"], r["toxic"]): r["s"] for r in rows.groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("s")).collect()}
    assert share[1, 0] > 0.95 and share[0, 0] < 0.05 and share[1, 1] < 0.1


def plainly_sampled(rows, labels):
    """(log weights in steps, k, kept rows) by loops over texts and buckets."""
    import math

    Q = quality_classifier
    worst = {}
    for i, quality, toxic in labels:
        if i is not None and quality is not None:
            old = worst.get(i, (1, 0))
            worst[i] = min(old[0], quality), max(old[1], toxic or 0)
    kind = {i: 1 if q < 1 else 2 if t > 0 else 0 for i, (q, t) in worst.items()}
    numbers = [Q.buckets([(t or "").encode()])[0].tolist() for _, t in rows]
    counts = [[0] * Q.SIZE for _ in range(4)]
    for (i, _), own in zip(rows, numbers, strict=True):
        for b in own:
            counts[0][b] += 1
            if i in kind:
                counts[1 + kind[i]][b] += 1
    logs = [{}, {}]
    for part in Q.PARTS:
        at = range(part.start, part.stop)
        total = [max(1, sum(c[b] for b in at)) for c in counts]
        target = {b: max((counts[1][b] / total[1] + Q.SMOOTH * counts[0][b] / total[0]) / (1 + Q.SMOOTH), 1e-12) for b in at}
        for c in (1, 2):
            n = total[1 + c]
            excess = {b: (counts[1 + c][b] - n * target[b]) / n if counts[1 + c][b] > Q.TIMES * n * target[b] + Q.SURE * math.sqrt(n * target[b] + 1) else 0.0 for b in at}
            rest = max(1 - math.fsum(excess.values()), 1e-9)
            logs[c - 1] |= {b: round(math.log(rest + excess[b] / target[b]) * Q.STEPS) for b in at}
    sizes = [sum(k == c for k in kind.values()) for c in range(3)]
    shares = [n / sum(sizes) for n in sizes]
    weights = []
    for own in numbers:
        p = [shares[0], *(s * math.exp(min(600, sum(x[b] for b in own) / Q.STEPS)) for s, x in zip(shares[1:], logs, strict=True))]
        weights.append(-math.log(math.fsum(p)))
    return weights, round(math.fsum(min(1, shares[0] * math.exp(w)) for w in weights))


def test_weights_and_sample_are_their_plain_version(spark, sf_dir):
    """On two partitionings the same rows to the last bit; weights, k and the kept rows as by plain loops."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").limit(120)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic")
    weights, k = plainly_sampled(rows, [tuple(r) for r in labels.join(docs, "doc_id", "left_semi").collect()])
    results = []
    for parts in (docs.coalesce(1), docs.repartition(5, "text")):
        got = quality_classifier.sample_of(parts, labels.join(docs, "doc_id", "left_semi"))
        out = sorted((r["doc_id"], r["log_weight"], r["chance"], r["sample_key"], r["kept"]) for r in got.rows.withColumn("kept", got.kept).collect())
        results.append((out, got.expected, got.cut))
    assert results[0] == results[1]
    out, expected, cut = results[0]
    mine = {i: w for i, w, *_ in out}
    for (i, _), w in zip(rows, weights, strict=True):
        assert abs(mine[i] - w) < 1e-3 * max(1, abs(w)) or (mine[i] < -500 and w < -500), i
    assert abs(expected - k) <= 1
    keys = sorted((x[3] for x in out), reverse=True)
    assert cut == keys[expected - 1] and all(x[4] == (x[3] >= cut) for x in out) and 0 < expected < len(out)


def test_a_weight_does_not_depend_on_neighbours(spark, sf_dir):
    texts = [(r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = np.random.default_rng(3)
    model = quality_classifier.Model.of(rng.integers(0, 50, (4, quality_classifier.SIZE)).astype(float), np.array([8.0, 1.0, 1.0]))
    together = model.log_weights(texts)
    assert together == [model.log_weights([t])[0] for t in texts]


def test_the_same_rows_again(spark, sf_dir):
    a, b = (sorted((r["doc_id"], r["kept"]) for r in QUERIES["op4_quality_classifier"](spark, sf_dir).collect()) for _ in range(2))
    assert a == b and len(a) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


@pytest.mark.parametrize("k", [0, 1, 5, 17, 49, 50, 80])
def test_threshold_is_the_kth_largest(spark, k):
    rng = random.Random(k)
    values = [rng.choice([rng.randrange(-(2**63), 2**63), rng.randrange(-5, 5), 7]) for _ in range(50)]
    keys = spark.createDataFrame([(v,) for v in values], "key bigint")
    want = sorted(values, reverse=True)[min(k, 50) - 1] if k else None
    assert quality_classifier.threshold(keys, "key", k) == want


def test_gumbel_noise(spark):
    x = np.array([r[0] for r in spark.range(20000).select(quality_classifier.gumbel(F.col("id"))).collect()])
    assert abs(x.mean() - 0.5772) < 0.05 and abs(x.var() - np.pi**2 / 6) < 0.1


def test_buckets_of_texts_do_not_depend_on_their_neighbours():
    texts = [b"One two. THREE!!", b"", b"four", b"x" * 100, "é über".encode()]
    numbers, at = quality_classifier.buckets(texts)
    for i, t in enumerate(texts):
        alone, _ = quality_classifier.buckets([t])
        assert sorted(alone.tolist()) == sorted(numbers[at[i] : at[i + 1]].tolist())


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs, texts):
    labels = spark.createDataFrame([(5, 1, 0), (5, 0, None), (8, 1, None), (13, 0, 1), (None, 0, 0), (10, None, 1), (20, 1, 0), (21, 1, 1)], "doc_id bigint, quality int, toxic int")
    rows = quality_classifier.quality_classifier(odd_docs, labels).collect()
    assert len(rows) == len(texts) and all(isinstance(r["kept"], bool) for r in rows)
    twice = [r["kept"] for r in rows if r["doc_id"] == 40]
    assert twice[0] == twice[1]
    for some in (labels.limit(0), labels.where("quality = 1 AND toxic IS NULL AND doc_id = 8")):
        assert quality_classifier.quality_classifier(odd_docs, some).where("kept").count() == len(texts)
    assert quality_classifier.quality_classifier(no_docs, labels).count() == 0


def words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_pipeline_is_its_plain_version(spark, sf_dir, tmp_path):
    """Each stage against a plain version over what the stage before kept; the classifier's rows are its operator's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    kept = {r["doc_id"] for r in QUERIES["op4_quality_classifier"](spark, sf_dir).where("kept").collect()}
    rows = [r for r in rows if r["doc_id"] in kept]
    from test_dedup import lines_left, linked

    for r, (_, _, text) in zip(rows, lines_left([r["text"] for r in rows], line_dedup.LEAST), strict=True):
        r["text"] = text if r["text"] is not None else None
    first = linked([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if first[r["doc_id"]][1] == r["doc_id"]]
    items = [words(r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for w in items for i in range(max(1, len(w) - 9) if w else 0)}
    sizes = {len(w) for w in windows}

    def leaks(text):
        w = words(text)
        return any(tuple(w[i : i + n]) in windows for n in sizes for i in range(len(w) - n + 1))

    rows = [r for r in rows if not leaks(r["text"])]
    current = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"file://{tmp_path}/{name}"
        stage(spark, current, sf_dir).write.parquet(path)
        current = spark.read.parquet(path)
        assert current.columns == columns
    assert {r["doc_id"]: r["text"] for r in current.collect()} == {r["doc_id"]: r["text"] for r in rows}
    assert all(r["n_chars"] == len(r["text"]) for r in current.where("text IS NOT NULL").collect())
    want = {r["doc_id"]: len(ids) + 1 for r, ids in zip(rows, tokens.encode(tokens.default_path(), [r["text"] for r in rows]), strict=True)}
    got = corpus_pipeline.run(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r["doc_id"]: r["n"] for r in got} == want == {r["doc_id"]: r["t"] for r in got}


def test_stages_survive_odd_rows(spark, odd_docs, no_docs, sf_dir):
    current = odd_docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        current = stage(spark, current, sf_dir)
        assert current.columns == odd_docs.columns
        current = spark.createDataFrame(current.collect(), current.schema)
    assert packing.pack_documents(current).count() > 0
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, no_docs, sf_dir).count() == 0
    assert ngram_jaccard.PERCENT == 80
