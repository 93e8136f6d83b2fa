"""Token counts and packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from scholia.llm import packing, token_counts, tokens
from scholia.llm.queries import QUERIES
from scholia.llm.tables import shared_dir


@pytest.fixture(scope="module")
def ids_of():
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_are_those_of_the_library(ids_of, texts):
    path = tokens.default_path()
    odd = [t for _, t, *_ in texts if t is None or len(t) < 200_000] + ["<|endoftext|> end", "a <|endoftext|> b<|endoftext|>", "a <|endoftext| > b", "a" * 5000, " " * 5000, " 　 x", "don't I'LL"]
    for text, got in zip(odd, tokens.encode(path, odd), strict=True):
        assert got.tolist() == ids_of(text)


def test_special_strings_are_the_librarys_ids(spark, ids_of):
    rows = [(1, "a <|endoftext|> b"), (2, "plain"), (3, "<|endoftext|>" * 700)]
    assert 50256 in ids_of(rows[0][1])
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(docs).collect()} == {i: len(ids_of(t)) for i, t in rows}
    from pyspark.sql import functions as F

    check_packing(packing.pack_documents(docs).withColumn("ids_crc32", F.crc32("ids_le")).collect(), rows, ids_of)


def test_other_vocabularies_go_to_the_library(ids_of):
    path = public_tokenizers.path("word_bpe_49k.json")
    want = Tokenizer.from_file(path).encode("Hello there", add_special_tokens=False).ids
    assert tokens.encode(path, ["Hello there"])[0].tolist() == want


def check_packing(pieces, documents, ids_of):
    """Every id of every document lies in one piece; sequences are gapless and within the capacity."""
    by_doc, by_sequence = {}, {}
    for r in pieces:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 1024
    want = {}
    for doc, text in documents:
        want.setdefault(doc, []).append(ids_of(text) + [0])
    assert set(by_doc) == set(want)
    for doc, own in by_doc.items():
        copies = want[doc]
        assert sum(r["length"] for r in own) == sum(map(len, copies))
        if len(copies) == 1:
            at = 0
            for r in sorted(own, key=lambda r: r["start"]):
                part = copies[0][at : at + r["length"]]
                assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(copies[0]), zlib.crc32(np.array(part, "<u4").tobytes()))
                at += r["length"]
    return by_sequence


def test_packing_of_the_whole_table(spark, sf_dir, ids_of):
    documents = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    by_sequence = check_packing(QUERIES["op3_packing"](spark, sf_dir).collect(), documents, ids_of)
    used = [sum(n for _, n in own) for own in by_sequence.values()]
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in used)
    assert padding < 0.03 * sum(used)


def test_packing_of_odd_rows(odd_docs, no_docs, texts, ids_of):
    from pyspark.sql import functions as F

    got = packing.pack_documents(odd_docs).withColumn("ids_crc32", F.crc32("ids_le")).collect()
    check_packing(got, [(i, t) for i, t, *_ in texts], ids_of)
    assert packing.pack_documents(no_docs).count() == 0


def test_windows_are_nearly_equal_and_never_too_full():
    rng = random.Random(3)
    for _ in range(20):
        sizes = [rng.randrange(1, 257) for _ in range(rng.randrange(1, 300))]
        window = packing.deal(sizes, 1024)
        loads = np.bincount(window, weights=sizes)
        assert loads.max() <= 1024 and len(window) == len(sizes)
        if len(sizes) > 100:
            assert loads.max() - loads.min() < 64


def test_differencing_balances():
    assert sorted(np.bincount(packing.differencing([8, 7, 6, 5, 4], 2), weights=[8, 7, 6, 5, 4])) == [14, 16]


def test_counts_of_the_whole_table(spark, sf_dir, ids_of):
    want = {r["doc_id"]: len(ids_of(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert {r["doc_id"]: r["n_tokens"] for r in QUERIES["op2_token_counts"](spark, sf_dir).collect()} == want


def test_counts_of_odd_rows(spark, texts, no_docs, ids_of):
    docs = spark.createDataFrame(texts, no_docs.schema)
    got = token_counts.token_counts(docs).collect()
    assert sorted(map(repr, ((r["doc_id"], r["n_tokens"]) for r in got))) == sorted(map(repr, ((i, len(ids_of(t))) for i, t, *_ in texts)))
    assert token_counts.token_counts(no_docs).count() == 0


@pytest.mark.parametrize("block", [1, 2, 3, 7, 64])
def test_boundaries_across_blocks_and_files(spark, tmp_path, block):
    rng = random.Random(block)
    folder = tmp_path / "t"
    folder.mkdir()
    want, stream = [], {}
    for part in range(3):
        counts = [rng.choice([0, 0, 1, 2, 5, 9]) for _ in range(rng.randrange(0, 9))]
        ids = [x for n in counts for x in [*([5] * n), 0]]
        if part == 2:
            ids += [7] * 4
            counts.append(4)
        stream[part] = ids
        want += [(part, i, n) for i, n in enumerate(counts)]
        cut = rng.randrange(0, len(ids) + 1)
        for share, piece in enumerate((ids[:cut], ids[cut:])):
            (folder / f"part-{part:05d}-x-c{share:03d}.txt").write_bytes(np.array(piece, "<u2").tobytes())
    got = token_counts.separator_scan(spark, f"file://{folder}", block).collect()
    assert sorted((r["part"], r["ordinal"], r["n_tokens"]) for r in got) == sorted(want)


def test_shared_folder_is_the_sessions():
    class Conf:
        def get(self, key, default=None):
            assert key == "spark.checkpoint.dir"
            return "hdfs://cluster/tmp/"

    class Session:
        conf = Conf()

    assert shared_dir(Session(), "x").startswith("hdfs://cluster/tmp/x-")


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://head:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(), "x")
