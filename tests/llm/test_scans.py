"""Licence scan, quality rules, language id: each row alone."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from scholia.llm import language_id, license_scan, quality_rules
from scholia.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def documents(spark, sf_dir):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


def base_places(text):
    words = WORD.findall(lowered(text))
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


def check_licences(text, row):
    n, found = base_places(text)
    at = [i for i, _ in found]
    labels = sorted({x for _, x in found})
    assert (row["n_words"], row["n_base"], row["first_word"], row["last_word"], row["base_labels"]) == (n, len(found), min(at, default=None), max(at, default=None), ",".join(labels))
    assert set(labels) <= set(row["labels"].split(",")) | {""} and 0 <= row["score"] <= 1
    assert row["labels"].split(",") == sorted(set(row["labels"].split(",")))


def test_base_phrases_of_the_whole_table(spark, sf_dir):
    texts = documents(spark, sf_dir)
    rows = QUERIES["op1_license_scan"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_licences(texts[r["doc_id"]], r)


def test_base_phrases_anywhere(odd_docs, spark):
    odd = spark.createDataFrame([(1, "UNDER--the.MIT\nLicense"), (2, "under the mit licensee"), (3, "cc-by-nc cc by nc"), (4, "Apache License, Version 2.0"), (5, "apache license version 20")], "doc_id int, text string")
    for r in license_scan.license_scan(odd).collect():
        check_licences(r["text"], r["licence"])


def test_there_are_hundreds_of_rules():
    assert len(license_scan.rules()) > 300


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("SPDX-License-Identifier: GPL-3.0-or-later", ["gpl-3"]),
        ("Licensed under the Mozilla Public License, version 2.0", ["mpl-2"]),
        ("released under the GNU General Public License, version 3", ["gpl-3"]),
        ("License: BSD 3-Clause", ["bsd-3-clause"]),
        ("see https://creativecommons.org/licenses/by-nc-sa/4.0/", ["cc-by-nc-sa"]),
        ("mit dem Hund und der Lizenz", []),
        ("the license of the house", []),
    ],
)
def test_rules(text, labels):
    assert [x for x in license_scan.scan(text.encode())["labels"].split(",") if x] == labels


@pytest.mark.parametrize(
    ("text", "label"),
    [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose", "isc"),
        ("Redistribution and use in source and binary forms, with or without modification", "bsd-2-clause"),
        ("This is free and unencumbered software released into the public domain", "unlicense"),
        ("placed in the public domain", "public-domain"),
        ("Copyright A. All rights reserved", "proprietary"),
        ("licensed under the Microsoft Public License", "ms-pl"),
        ("licensed under the Business Source License", "busl"),
        ("released under the GPL version 3", "gpl-3"),
    ],
)
def test_rules_of_wrapped_text(text, label):
    for at in (m.start() for m in re.finditer(" ", text)):
        wrapped = text[:at] + "\n" + text[at + 1 :]
        if not text[:at].startswith("Copyright") or text[at:].count(" ") < 3:  # a copyright's owner stands on its line
            assert label in license_scan.scan(wrapped.encode())["labels"].split(","), wrapped


def a_match(parsed, rng):
    """A random text that the parsed pattern matches; a space is any white space."""
    out = ""
    for op, value in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(value)
        elif name == "NOT_LITERAL":
            out += "q"
        elif name == "BRANCH":
            out += a_match(rng.choice(value[1]), rng)
        elif name == "SUBPATTERN":
            out += a_match(value[3], rng)
        elif name == "MAX_REPEAT":
            least, most, part = value
            out += "".join(a_match(part, rng) for _ in range(rng.randint(least, min(int(most), least + 2))))
        elif name == "IN":
            kind, own = rng.choice(value)
            if str(kind) == "CATEGORY":
                out += rng.choice("\n\t ") if "SPACE" in str(own) else "7"
            else:
                out += chr(own if str(kind) == "LITERAL" else rng.randint(*own))
        else:
            assert name.startswith("ASSERT"), name
    return out


def test_keywords_are_in_every_match():
    import random

    rng = random.Random(8)
    for _, _, label, _, need, pattern in license_scan.rules():
        for _ in range(12):
            text = a_match(re._parser.parse(pattern.pattern), rng)
            assert pattern.search(text), (label, text)
            assert all(any(w in text for w in alternatives) for alternatives in need), (label, need, text)


def test_contained_matches_of_worse_rules_are_suppressed():
    spans = license_scan.scan(b"Licensed under the MIT License")["spans"]
    assert [(s["label"], s["priority"]) for s in spans] == [("mit", 2)]


def plainly_kept(found):
    """Suppression by comparing each interval with all kept ones."""
    kept = []
    for f in sorted(found, key=lambda f: (f[2], f[0] - f[1], f[0], f[3])):
        if not any(k[0] <= f[0] and f[1] <= k[1] for k in kept):
            kept.append(f)
    return kept


def test_suppression_is_its_plain_version():
    import random

    rng = random.Random(6)
    for _ in range(300):
        found = []
        for order in range(rng.randrange(25)):
            start = rng.randrange(30)
            found.append((start, start + rng.randrange(1, 12), rng.randrange(1, 5), order % 7, f"l{order}"))
        found = list({f[:4]: f for f in found}.values())
        assert sorted(license_scan.not_contained(found)) == sorted(plainly_kept(found))


@pytest.mark.parametrize("phrase", ["mit license. ", "cc by nc ", "licensed under the mit license "])
def test_long_texts_of_licences_take_time_in_proportion(phrase):
    import time

    text = (phrase * (2_000_000 // len(phrase))).encode()
    began = time.perf_counter()
    row = license_scan.scan(text)
    assert time.perf_counter() - began < 30
    n = 2_000_000 // len(phrase)
    assert row["n_base"] == (0 if phrase.startswith("mit") else n) and len(row["spans"]) >= 1


def counts(text):
    """Plain versions of the counts of the quality rules."""
    text = text or ""
    words = SPACED.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    again = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if SPACED.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(again), failed


def check_quality(text, r):
    assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == counts(text)
    assert not (r["kept"] and r["base_failed"])


def test_quality_counts_of_the_whole_table(spark, sf_dir):
    texts = documents(spark, sf_dir)
    rows = QUERIES["op7_quality_rules"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        check_quality(texts[r["doc_id"]], r)


def test_quality_keeps_good_documents(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1 AND toxic = 0")
    kept = QUERIES["op7_quality_rules"](spark, sf_dir).where("n_words >= 20").join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int"))).collect()[0][0]
    assert kept > 0.97


def test_bands_reject_repetitive_and_random_text():
    import random

    rng = random.Random(1)
    noise = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(60)) for _ in range(60))
    rows = quality_rules.measure([noise.encode(), ("so it goes on and on " * 200).encode()])
    assert [r["kept"] for r in rows] == [False, False]


def test_odd_rows(odd_docs, no_docs, texts):
    for operator, name, check in ((license_scan.license_scan, "licence", check_licences), (quality_rules.quality_rules, "rules", check_quality)):
        rows = operator(odd_docs).collect()
        assert len(rows) == len(texts)
        for r in rows:
            check(r["text"], r[name])
        assert operator(no_docs).count() == 0


def test_held_out_accuracy(spark, sf_dir):
    langs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = QUERIES["op10_language_id"](spark, sf_dir).join(langs, "doc_id").collect()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and r["lang"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.97 * len(held)


def test_language_of_odd_rows(odd_docs, no_docs, texts, spark):
    rows = language_id.language_id(odd_docs, F.lit(True)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        if r["text"] is None or not re.search(r"[^\W\d_]", r["text"]):
            assert (r["language"]["lang_pred"], r["language"]["score"]) == ("und", 0.0)
        else:
            assert r["language"]["lang_pred"] in ("en", "de")
    assert language_id.language_id(no_docs, F.lit(True)).count() == 0
    nothing = language_id.language_id(odd_docs, F.lit(False)).collect()
    assert {r["language"]["lang_pred"] for r in nothing} == {"und"}


def test_codewords_are_distinct():
    for n in (1, 2, 3, 6, 7, 40):
        code = language_id.codewords(n)
        assert len({tuple(x) for x in code}) == n
