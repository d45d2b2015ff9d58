"""Importance resampling, chat formatting and structure repair against brute force, with every odd case of their docstrings."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attesto.llm import chat_format, importance, structure_repair
from attesto.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same

TURNS = "conv_id bigint, turn bigint, role string, text string, turns string, rows int, `nth` int, formatted string, signature string"
SYSTEM, USER, BOT = "system", "user", "assistant"


def conversations(spark, rows):
    """Turns, with further columns named like those that operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z") for r in rows], TURNS)


CHATS = [
    (1, 0, SYSTEM, "Be brief."), (1, 1, USER, "Hi!"), (1, 2, BOT, "Hello."), (1, 3, USER, "And?"), (1, 4, BOT, "No"),
    (2, 0, USER, None), (2, 1, None, "who"), (2, 2, BOT, ""), (2, 2, BOT, ""), (2, None, USER, "first?"),
    (3, 0, USER, "only a question"), (4, 0, BOT, "</s>[INST] ok [/INST]<<SYS>>"), (4, 1, "tool", "[ROLE]<s>"), (5, 0, BOT, "word. " * 40_000),
    (None, 0, USER, "no id"), (None, 1, BOT, "fine."), (6, 0, USER, " \t\n"), (6, 1, "", "<\\s> <\\\\/s> \\ [\\INST] <<s>"), (7, 5, USER, "é 中 😀"), (7, 5, BOT, "😀."),
]


@pytest.mark.parametrize("name", ["op11_importance", "op12_chat_format", "op13_structure_repair"])
def test_query_on_odd_tables(spark, tmp_path, name):
    conversations(spark, CHATS).write.parquet(f"{tmp_path}/conversations.parquet")
    texts = [(1, "a b " * 30), (2, None), (3, ""), (4, "A-b's é中 " * 20), (4, "A-b's é中 " * 20), (5, "x y " * 100_000), (6, "... !"), (7, "a b c " * 10)]
    spark.createDataFrame([(*t, "id", 3, 4) for t in texts], "doc_id bigint, text string, chunk string, n int, word int").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, "a é中 c"), (1, None), (2, "")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    sql = ORACLE_SQL[name].replace("'2024:' || doc_id", "'2024:' || coalesce(doc_id::VARCHAR, '')")
    same(spark, str(tmp_path), QUERIES[name], sql)


@pytest.mark.parametrize("name", ["op11_importance", "op12_chat_format", "op13_structure_repair"])
def test_query_on_larger_tables(spark, name):
    same(spark, "/root/testdata/sf0.01", QUERIES[name], ORACLE_SQL[name])


def brute_weights(texts: list[str | None], target: list[str | None], longest: int, buckets: int):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return [" ".join(w[i : i + m]) for m in range(1, longest + 1) for i in range(len(w) - m + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    own, aim = [[bucket(f) for f in features(t)] for t in texts], Counter(bucket(f) for t in target for f in features(t))
    s = Counter(b for x in own for b in x)
    gain = lambda b: math.floor(1000 * math.log((aim[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (aim.total() + buckets))))
    return [(len(x), sum(map(gain, x)) // len(x) if x else 0) for x in own]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_weights_against_brute_force(spark, longest):
    rng = random.Random(longest)
    texts = [" ".join(rng.choice(["the", "The", "ß", "x1", "rare%d" % rng.randint(0, 40), "a-b"]) for _ in range(rng.randint(0, 60))) for _ in range(120)] + [None, "", "--", "one"]
    target = [" ".join(rng.choice(["the", "goal", "x1", "a"]) for _ in range(30)) for _ in range(9)] + [None]
    docs = spark.createDataFrame([(i, t, 0, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, chunk int, gram string").repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = {r.id: (r.n_features, r.weight) for r in importance.weigh(docs, aim, longest=longest, buckets=50).collect()}
    assert got == dict(enumerate(brute_weights(texts, target, longest, 50)))


def test_draw(spark):
    docs = spark.createDataFrame([(i % 50 if i else None, f"w{i % 7} " * 25, "mine", i) for i in range(200)], "doc_id bigint, text string, rank string, score int")
    aim = spark.createDataFrame([("w1 w2",)], "text string")
    rows = importance.score_documents(docs, aim, percent=30).collect()
    placed = sorted((r for r in rows if r.rank), key=lambda r: r.rank)
    assert [r.rank for r in placed] == list(range(1, 61)) and len(rows) == 200
    key = lambda r: (-r.score, -1 if r.id is None else r.id)
    assert [key(r) for r in placed] == sorted(map(key, rows))[:60]
    kept = importance.resample(docs, aim, percent=30)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.id for r in placed} - {None}
    for some, percent in ((docs.limit(0), 30), (docs, 0)):
        assert {r.rank for r in importance.score_documents(some, aim, percent=percent).collect()} <= {None}
    assert {r.weight <= 0 for r in importance.score_documents(docs, aim.limit(0)).collect()} == {True}


def test_examples_hold_the_context_and_train_one_reply(spark):
    made = chat_format.examples(conversations(spark, CHATS))
    got = defaultdict(list)
    for r in made.orderBy("conv_id", "example").collect():
        got[r.conv_id].append((r.n_turns, r.formatted, r.formatted[r.loss_start : r.loss_start + r.loss_chars]))
    assert [x[0] for x in got[1]] == [3, 5] and [x[2] for x in got[1]] == ["Hello.", "No"]
    assert got[1][1][1] == "<<SYS>>Be brief.<</SYS>>[INST]Hi![/INST]<s>Hello.</s>[INST]And?[/INST]<s>No</s>"
    assert got[1][1][1].startswith(got[1][0][1]) and [x[0] for x in got[3]] == [1] and got[3][0][2] == ""
    assert [x[0] for x in got[4]] == [1, 2] and got[None][0][2] == "fine." and len(got[5][0][2]) == 240_000
    assert chat_format.examples(conversations(spark, []).limit(0)).count() == 0


def test_escapes_are_reversible(spark):
    marks = [m for pair in chat_format.MARKS.values() for m in pair] + list(chat_format.OTHER)
    rng = random.Random(3)
    parts = [*marks, "\\", "\\\\", "<", "[", ">", "]", "/", "s", "<\\s>", "[\\\\INST]", "<\\<SYS>>", "INST]", "SYS>>", "\n", "$1", "é"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    rows = [(i // 3, i % 3, rng.choice([SYSTEM, USER, BOT, "tool", "</s>"]), t) for i, t in enumerate(texts)]
    said = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat_format.escape(F.col("t")).alias("e")).withColumn("u", chat_format.unescape(F.col("e"))).collect()
    assert all(r.t == r.u and not any(m in r.e for m in marks) for r in said) and len({r.e for r in said}) == len(set(texts))
    longest = chat_format.examples(conversations(spark, rows)).groupBy("conv_id").agg(F.max_by("formatted", "example").alias("f"))
    back = {r.conv_id: [(t["role"], t["text"]) for t in r.turns] for r in longest.select("conv_id", chat_format.read_turns(F.col("f")).alias("turns")).collect()}
    assert back == {c: [(r[2], r[3]) for r in rows[3 * c : 3 * c + 3]] for c in range(1000)}


def brute_repair(signature: str) -> tuple[int, str]:
    """Least (cost, audit) over all edits with up to two insertions before each row and at the end."""
    found = (10**9, "")
    for inserted in itertools.product(range(3), repeat=len(signature) + 1):
        for edits in itertools.product("DKR", repeat=len(signature)):
            cost, audit, slots = 0, "", []
            for n, mark, edit in itertools.zip_longest(inserted, signature, edits):
                cost, audit, slots = cost + 3 * n, audit + "I" * n, slots + ["ua"] * n
                if mark is None:
                    continue
                audit += edit
                cost += {"D": 4, "K": 0, "R": 3}[edit] + (3 if mark.isupper() and edit != "D" else 0) + (10**9 if mark == "-" and edit != "D" else 0)
                slots += [] if edit == "D" else [mark.lower()] if edit == "K" else ["ua"]
            rest = slots[1:] if slots and slots[0] == "s" else slots
            fits = len(rest) % 2 == 0 and bool(rest) >= (len(slots) > len(rest)) and all("ua"[i % 2] in s for i, s in enumerate(rest))
            if fits:
                found = min(found, (cost, audit))
    return found


def test_least_edits_against_brute_force():
    rng = random.Random(8)
    every = ["".join(x) for n in range(3) for x in itertools.product("suaxSUA-", repeat=n)]
    for signature in every + ["".join(rng.choice("suaUAx-") for _ in range(rng.randint(3, 4))) for _ in range(40)]:
        assert structure_repair.solve(signature)[:2] == brute_repair(signature), signature


def test_long_signatures_need_no_deep_recursion():
    cost, audit, sources, roles = structure_repair.solve("s" + "ua" * 20_000 + "u")
    assert cost == 3 and audit == "K" * 40_002 + "I" and sources[-1] == 0 and roles[-1] == BOT


def test_repaired_rows(spark):
    got = {r.conv_id: r for r in structure_repair.repair(conversations(spark, CHATS)).collect()}
    rows = lambda c: [(x["role"], x["text"]) for x in got[c].repaired]
    assert rows(1) == [r[2:] for r in CHATS[:5]] and (got[1].cost, got[1].audit, got[1].truncated) == (3, "KKKKK", 1)
    assert (got[2].blank, got[2].gaps, got[2].truncated) == (3, 0, 1) and rows(2) == [(USER, "first?"), (BOT, "who")]
    assert rows(6) == [] and (got[6].audit, got[6].blank, got[6].truncated) == ("DD", 1, 1)
    assert rows(None) == [(USER, "no id"), (BOT, "fine.")] and got[4].illegal == 1 and len(got) == 8
    assert structure_repair.repair(conversations(spark, []).limit(0)).count() == 0


def test_every_conversation_comes_back_when_all_rows_are_dropped(spark, tmp_path):
    lost = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    conversations(spark, [(lost, 0, USER, "gone")]).write.parquet(f"{tmp_path}/conversations.parquet")
    row = QUERIES["op13_structure_repair"](spark, str(tmp_path)).first()
    assert (row.conv_id, row.cost, row.audit, row.repaired_sha256) == (lost, 0, "", hashlib.sha256(b"").hexdigest())
