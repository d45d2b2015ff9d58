"""The registered queries themselves: columns, laws and edge cases over small tables."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attesto.llm import exact_dedup, mixing, sharding
from attesto.llm.queries import QUERIES
from attesto.llm.scratch import fresh

FOLDER = "/root/testdata/sf0.001"
HOSTILE = "doc_id bigint, text string, lang string, source string, until int, offset int, block int, s int, p int, row int, `order` int, part int, rank int, data string, digest string, __digest string, kept_id int"


def hostile(spark, rows):
    """Documents whose other columns are named like those that operators use inside."""
    return spark.createDataFrame([(i, t, "en", f"s{i % 2 if i is not None else 0}", *range(9), "d", "e", "f", 5) for i, t in rows], HOSTILE)


TEXTS = [(1, "a b"), (2, None), (3, ""), (4, "a b"), (4, "a b"), (None, "z"), (5, "long " * 60_000), (6, "é 中 😀")]


def test_sharding_query(spark, tmp_path):
    hostile(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["op4_sharding"](spark, str(tmp_path)).collect()
    raw = lambda t: (t or "").encode()
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(((i, len(raw(t)) + 1, zlib.crc32(raw(t))) for i, t in TEXTS), key=repr)
    slots = defaultdict(list)
    for r in got:
        assert r.law == "rows" and 0 <= r.shard < 8 and r.grown_shard is None
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values()) and {len(x) for x in slots.values()} == {1}


def test_names_of_the_user_survive(spark):
    docs = hostile(spark, TEXTS)
    dealt = sharding.shuffle_into_shards(docs, 3)
    assert dealt.columns == [*docs.columns, "shard", "slot"]
    assert sorted(map(repr, dealt.drop("shard", "slot").collect())) == sorted(map(repr, docs.collect()))
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns and {r["__digest"] for r in kept.collect()} == {"f"}
    assert fresh("digest", docs) == "digest_" and fresh("DATA", docs) == "DATA_"
    mixed = mixing.mix(docs)
    assert set(docs.columns) <= set(mixed.columns) and mixed.count() == len(TEXTS)


def test_targets_that_do_not_fit_are_told(spark):
    docs = spark.createDataFrame([(i, "w w", f"s{i % 2}", f"l{i % 2}") for i in range(40)], "doc_id bigint, text string, source string, lang string")
    with pytest.warns(UserWarning, match="cannot be met together"):
        mixing.mix(docs, {"source": {"s0": 0.9, "s1": 0.1}, "lang": {"l0": 0.5, "l1": 0.5}})


def test_language_query_on_held_out_texts(spark):
    got = QUERIES["op2_language_id"](spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("lang is not null").collect()
    assert got.count() == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 30 and sum(r.lang == r.lang_pred for r in out) >= 0.95 * len(out)


def test_toxicity_query(spark):
    rows = QUERIES["op10_toxicity"](spark, FOLDER).collect()
    assert len(rows) == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)


def test_mixing_query(spark):
    rows = QUERIES["op8_mixing"](spark, FOLDER)
    assert rows.count() == spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    sums = rows.agg(F.sum("tokens").alias("all"), F.sum(F.when(F.col("kept"), F.col("tokens"))).alias("kept"), F.sum(F.col("tokens") * F.col("probability")).alias("expected"), F.min("probability").alias("low"), F.max("probability").alias("high")).first()
    assert abs(sums["expected"] / sums["all"] - 0.6) < 1e-6 and 0 <= sums["low"] and sums["high"] <= 1 and 0.4 < sums["kept"] / sums["all"] < 0.8


def test_substring_query_finds_planted_passages(spark, tmp_path):
    """Recall against what was planted: exact and fuzzy passages, each in three documents at random places."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randint(0, 5000)}"
    docs = [[word() for _ in range(rng.randint(50, 300))] for _ in range(80)]
    planted = []
    for k in range(30):
        passage = [word() for _ in range(rng.randint(60, 100))]
        for doc in sorted(rng.sample(range(80), 3)):
            own = list(passage)
            for at in rng.sample(range(len(own)), k % 3):
                own[at] = word()
            planted.append([k, doc, own])
    spans = {}
    for doc in range(80):
        for k, d, own in planted:
            if d == doc:
                spans[k, doc] = len(docs[doc]), len(docs[doc]) + len(own)
                docs[doc] += own + [word() for _ in range(20)]
    spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op3_substring_dedup"](spark, str(tmp_path)).collect()
    found, all_ = 0, 0
    for (k, doc), (start, end) in spans.items():
        if any(k2 == k and d < doc for k2, d in spans):
            all_ += 1
            found += any(r.doc_id == doc and min(r.end_word, end) - max(r.start_word, start) >= 0.9 * (end - start) for r in rows)
    assert found >= 0.95 * all_
    for r in rows:  # nothing is reported that is not as similar as it says
        a, b = docs[r.doc_id][r.start_word : r.end_word], docs[r.source_doc_id][r.source_start : r.source_end]
        assert len(a) >= 50 and len(set(a) & set(b)) >= 0.7 * len(set(a))
