"""The corpus operators against brute force, on small tables with nulls, ties, repeated rows and hostile columns."""

from __future__ import annotations

import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from attesto.llm import bpe, embedding_dedup, exact_dedup, html_text, jaccard_join, language_id, mixing, scratch, sharding, substring_dedup, toxicity, wordhash
from attesto.llm.components import connected_components
from attesto.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g"), (2, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, ""), (None, "a b"), (5, "x" * 300_000), (6, "é ß\n\t中 😀 a")]


def odd(spark):
    """Nulls, repeated rows, an empty and a very long text, and columns whose names operators use inside."""
    rows = [(i, t, "en", "src", k, "clash", 0) for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, row int, digest string, score int")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(spark, FOLDER, QUERIES[name], ORACLE_SQL[name])


def test_exact_groups(spark):
    got = {(r.id, r.row): (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd(spark)).collect()}
    assert len(got) == len(ODD)
    assert Counter((k[0], v) for k, v in got.items()) == Counter([(1, (2, 3, False)), (2, (2, 3, False)), (2, (2, 3, True)), (3, (4, 2, False)), (4, (4, 2, True)), (None, (None, 1, True)), (5, (5, 1, True)), (6, (6, 1, True))])
    kept = exact_dedup.drop_exact_duplicates(odd(spark))
    assert kept.columns == odd(spark).columns and sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 4, 5, 6]
    assert exact_dedup.exact_groups(odd(spark).limit(0)).count() == 0


def test_texts_under_one_digest_are_told_apart(spark):
    docs = odd(spark)
    weak = F.lit(b"same")
    got = sorted((r.id or 0, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs, digest=weak).collect())
    assert got == sorted((r.id or 0, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect())


def test_shards_are_even_and_gapless(spark):
    for n in (0, 3, 1000):
        got = sharding.shuffle_into_shards(spark.range(n).repartition(7), 8).groupBy("shard").agg(F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("d")).collect()
        assert sum(r.n for r in got) == n and all(r.n in (n // 8, n // 8 + 1) and r.low == 0 and r.high == r.n - 1 == r.d - 1 for r in got)


def test_draws_follow_the_hypergeometric_law(spark):
    from math import comb

    u = spark.range(20_000).select(sharding.hypergeometric(F.lit(6), F.lit(15), F.lit(5), (F.col("id") + 0.5) / 20_000).alias("x"))
    got = {r.x: r["count"] / 20_000 for r in u.groupBy("x").count().collect()}
    assert all(abs(got.get(k, 0) - comb(6, k) * comb(9, 5 - k) / comb(15, 5)) < 1e-3 for k in range(6))


def test_bpe_equals_the_library(spark):
    rng, parts = random.Random(5), ["a", "Z", " ", "  ", "\n", "\t", "'s", "é", "中", "<|endoftext|>", "12", "!", "\x1c", "\x85", "😀", " the"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(300)] + [None, "", "y" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = bpe.tokenizer(tokenizer_path())
    ids = {i: found.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    encoded = bpe.encode(docs, tokenizer_path())
    assert {r.doc_id: list(r.ids) for r in encoded.collect()} == ids
    assert {r.doc_id: r.decoded for r in bpe.decode(encoded, tokenizer_path()).collect()} == {i: found.decode(x, skip_special_tokens=False) for i, x in ids.items()}
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, tokenizer_path()).collect()} == {
        i: (len(x), sha(np.array(x, "<u4").tobytes()), sha(found.decode(x, skip_special_tokens=False).encode())) for i, x in ids.items()
    }
    assert bpe.encode_digests(odd(spark), tokenizer_path()).count() == len(ODD) and bpe.encode_digests(docs.limit(0), tokenizer_path()).count() == 0


def brute_set(text: str | None) -> set:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_groups_equal_brute_force(spark):
    rng = random.Random(3)
    base = [[rng.choice("abcdefghij") + str(rng.randint(0, 300)) for _ in range(rng.randint(3, 80))] for _ in range(15)]
    texts = []
    for words in base:
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    texts += [None, "", "A b C", "a B c"]
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.jaccard_groups(docs).collect()} == {i: (len(s), find(i)) for i, s in enumerate(sets)}
    kept = jaccard_join.drop_near_duplicates(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({find(i) for i in range(len(sets))})
    assert jaccard_join.jaccard_groups(odd(spark)).count() == len(ODD) and jaccard_join.jaccard_groups(docs.limit(0)).count() == 0


def brute_components(texts: list) -> list[int]:
    sets = [brute_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_jaccard_groups_near_the_threshold(spark):
    """Large families whose members are about as similar as the threshold, with edits of their own, shared edits and shared passages."""
    rng = random.Random(11)
    passage = [f"p{i}" for i in range(12)]
    texts = []
    for family in range(4):
        base = [f"f{family}w{rng.randint(0, 400)}" for _ in range(rng.randint(40, 120))]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 2, 3, 3, 4])):
                at = rng.randrange(len(w))
                w[at] = rng.choice([f"own{rng.random()}", f"alt{at}", f"alt{at // 7}"])
            at = rng.randrange(len(w))
            w = w[: len(w) - rng.choice([0, 0, 3, 8])]
            w[at:at] = rng.choice([[], [], passage, passage[:4]])
            texts.append(" ".join(w))
    order = list(range(len(texts)))
    rng.shuffle(order)
    texts = [texts[i] for i in order]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard_join.jaccard_groups(docs).collect()}
    expected = brute_components(texts)
    assert 8 < len(set(expected)) < 200
    assert got == dict(enumerate(expected))


def test_jaccard_guests_without_a_similar_member_are_left_out(spark):
    """By the numbers of their differences, or by the tokens that they add; a guest that resembles a member stays, also where that is far from the centre."""
    row = lambda key, home, added, missing: (key, 1, home, 100, 180 * (len(added) + missing) - 2000, list(added), list(range(missing)))
    rows = [row(1, True, [], 0), row(2, True, range(500, 510), 10), row(5, True, range(1000, 1080), 80), row(3, False, range(2000, 2095), 95), row(6, False, range(1004, 1084), 80), row(7, False, range(3000, 3080), 80)]
    rows = spark.createDataFrame(rows, "key bigint, grp bigint, home boolean, n bigint, e bigint, added array<bigint>, missing array<bigint>")
    low = rows.groupBy("grp").agg(F.min(F.struct("e", "key")).alias("low"), F.max("e").alias("high"))
    assert sorted(r.key for r in jaccard_join._strangers(rows, low, 80).collect()) == [3, 7]


@pytest.mark.parametrize("cell", [2048, 8])
def test_embedding_links_equal_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)  # small: hot cells are cut into blocks
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 32))
    x = np.concatenate([x, x[:20] + 0.05 * rng.standard_normal((20, 32)), x[:1] + 0.02 * rng.standard_normal((30, 32)), x[5:6]])
    vectors = [v.tolist() for v in x.astype(np.float32)] + [None, [0.0] * 32, [float("nan")] * 32, [1.0, None], []]
    docs = spark.createDataFrame(list(enumerate(vectors)), "vec_id bigint, embedding array<float>")
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.9
    root = embedding_dedup._roots(len(u), *np.nonzero(near))
    expected = {i: (int(near[i].sum()) - 1, int(root[i])) for i in range(len(u))} | {len(u) + k: (0, len(u) + k) for k in range(5)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(docs).collect()}
    assert sum(got[i] == expected[i] for i in expected) >= 0.98 * len(expected) and all(got[i][0] <= expected[i][0] for i in expected)
    assert embedding_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_passages(spark):
    rng = random.Random(2)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage = text(80)
    fuzzy = [w if i % 27 else "changed" for i, w in enumerate(passage)]
    docs = [(i, " ".join(w)) for i, w in enumerate([text(50) + passage + text(40), text(20) + passage, text(70) + fuzzy + text(9), text(200), passage[:30] + text(50)])] + [(9, None), (10, ""), (None, " ".join(passage))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.source_doc_id) for r in got} == {(1, 0), (2, 0)}
    exact = next(r for r in got if r.doc_id == 1)
    assert (exact.start_word, exact.end_word, exact.source_start, exact.similarity) == (20, 100, 50, 1.0)
    assert substring_dedup.repeated_passages(odd(spark)).count() == 0


@pytest.mark.parametrize(("gap", "other_gap"), [(40, 40), (100, 100), (250, 250), (100, 0)])
def test_passages_apart_are_both_found(spark, gap, other_gap):
    rng = random.Random(gap)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    one, two = text(60), text(60)
    docs = [(0, " ".join(text(30) + one + text(other_gap) + two + text(30))), (1, " ".join(text(10) + one + text(gap) + two + text(20)))]
    got = substring_dedup.repeated_passages(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert sorted((r.start_word, r.end_word, r.similarity) for r in got) == [(10, 70, 1.0), (70 + gap, 130 + gap, 1.0)]


def test_fragments_in_earlier_documents_hide_no_passage(spark):
    rng = random.Random(8)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    passage, second, third = text(90), text(100), text(60)
    rows = [text(9) + passage[:45] + text(9), text(5) + passage[45:] + text(9), passage + text(20), text(30) + passage + text(7)]  # fragments in two documents
    rows += [second[:40] + text(30) + second, text(15) + second]  # a fragment earlier inside the first document
    rows += [text(3) + third[5:45] + text(50), text(40) + third + text(2), text(2) + third + text(30)]  # in one document
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")
    got = {(r.doc_id, r.source_doc_id): (r.start_word, r.end_word, r.source_start, r.similarity) for r in substring_dedup.repeated_passages(docs).collect()}
    assert got == {(3, 2): (30, 120, 0, 1.0), (5, 4): (15, 115, 70, 1.0), (8, 7): (2, 62, 40, 1.0)}


@pytest.mark.parametrize("group", [512, 3])
def test_fuzzy_passages_are_found_whatever_documents_have_their_seeds_first(spark, monkeypatch, group):
    """Of a passage with a changed word in the middle, each half is first in an earlier document of its own; a line is in all documents."""
    monkeypatch.setattr(substring_dedup, "GROUP", group)
    rng = random.Random(15)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    line, passage = text(20), text(81)
    changed = passage[:40] + ["changed"] + passage[41:]
    rows = [text(9) + passage[:40] + text(60), text(9) + passage[41:] + text(60), text(30) + passage + text(30), text(20) + changed + text(40), text(20) + changed + text(40)]
    rows += [text(200) for _ in range(8)]
    rows = [w + text(40) + line + text(40) for w in rows]
    rows += [rows[3], text(70) + passage[:40] + text(1) + passage[41:]]
    got = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(rows)], "doc_id bigint, text string")).collect()
    long = {(r.doc_id, r.source_doc_id): (r.start_word, r.end_word, r.source_start) for r in got if r.n_words == 81}
    assert long[3, 2] == (20, 101, 30) and long[4, 3] == (20, 101, 20) and long[14, 2] == (70, 151, 30)
    assert all(r.doc_id > r.source_doc_id >= 2 for r in got) and {r.doc_id for r in got} == {3, 4, 13, 14}


def test_passages_reach_beyond_their_outer_seeds(spark):
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    pairs = []
    for changed in [(11, 48), (7, 52), (4, 9, 50, 55), (44, 48, 52, 56), (0, 59)] * 3:
        passage = text(60)
        pairs += [text(30) + passage + text(30), text(17) + [f"c{i}" if i in changed else w for i, w in enumerate(passage)] + text(40)]
    short = text(45)
    pairs += [text(30) + short + text(30), text(17) + short + text(40)]  # 45 words are too few
    got = {r.doc_id: r for r in substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(pairs)], "doc_id bigint, text string")).collect()}
    assert sorted(got) == list(range(1, 30, 2))
    assert [(got[i].start_word, got[i].end_word, got[i].source_start, got[i].source_end) for i in (1, 11, 21)] == [(17, 77, 30, 90)] * 3
    assert all(abs(got[i].similarity - 58 / 60) < 1e-9 for i in (1, 3, 11, 13)) and got[9].n_words == 58 and got[9].similarity == 1


def test_text_that_repeats_itself_is_covered_by_few_passages(spark):
    rng = random.Random(14)
    text = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    docs = [(0, text(20) + ["x"] * 60 + text(20)), (1, text(30) + ["x"] * 600 + text(5)), (2, text(30) + ["x"] * 60 + text(5))]
    got = substring_dedup.repeated_passages(spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id bigint, text string")).collect()
    assert {w for r in got if r.doc_id == 1 for w in range(r.start_word, r.end_word)} == set(range(30, 630))
    assert (30, 90) in {(r.start_word, r.end_word) for r in got if r.doc_id == 2} and len(got) < 60


def test_extensions_keep_the_score():
    a, b = "a b c X d e f g h".split(), "a b c Y d e f g h".split()
    assert max(substring_dedup.extensions(a, b, 0.2))[1:] == (9, 9, 2)
    assert substring_dedup.extensions(["x"] * 50, ["y"] * 50, 0.2) == []


def test_chains_are_ordered(spark):
    assert substring_dedup.chains(np.array([0, 8, 16, 500]), np.array([100, 108, 116, 90]), 8)[0] == (0, 24, 100, 124, 3)


def test_languages(spark):
    words = {"en": "the and of with this", "fr": "les des que pour dans", "de": "der die und nicht ist"}
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(words[lang].split()) for _ in range(40)), lang) for i, lang in enumerate(["en", "fr", "de"] * 20)] + [(90, None, "en"), (91, "123 !", None), (92, "the of and this", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") % 3 == 5).collect()}
    assert all(got[i].lang_pred == lang and 0 <= got[i].score <= 1 for i, _, lang in rows[:60])
    assert got[90].lang_pred == got[91].lang_pred == "und" and got[91].score == 0 and got[92].lang_pred == "en"
    assert {r.lang_pred for r in language_id.identify(docs.limit(0).union(docs.filter("lang is null")), F.lit(False)).collect()} == {"und"}


def test_toxicity_ignores_identity_terms(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        w = [f"w{rng.randint(0, 200)}" for _ in range(12)] + (["insult"] if bad else []) + (["muslim"] if bad and i % 8 == 0 else [])
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "w1 muslim w2"), (902, "w1 insult w2")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in toxicity.classify(docs, labels, lambda c: c % 10 == 9).collect()}
    assert len(got) == 403 and got[901].predicted == 0 and got[902].predicted == 1 and got[900].predicted == 0
    assert all(got[i].predicted == y for i, _, y in rows)
    assert max(r.score for r in toxicity.classify(docs, labels.limit(0), lambda c: c < 0).collect()) < 1e-6


def test_html(spark):
    page = '<html><body><nav>Menu <a href=x>A</a></nav><div class="ad">Buy now, really long advert text here</div><div id=c><h1>T&eacute;tle</h1><p>One <b>bo</b>ld.<br>Two<p>x</div><div class="comments"><p>me too</p></div><footer>f</footer></body>'
    assert html_text.main_text(page) == "Tétle One bold. Two x"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<article><p>a</p><form>no</form></article><div>out of it, long long long</div>") == "a"


PROSE = "<p>" + "long words of prose that anyone may read at leisure. " * 6 + "</p>"


def test_ratios_choose_the_regions_of_a_page():
    said = html_text.main_text(PROSE)
    links = "<ul>" + "".join(f"<li><a href=/{i}>see also {i}</a></li>" for i in range(6)) + "</ul>"
    # in an article a block of links falls under the threshold, a list and a table of text do not
    page = f"<body><article><h1>Name</h1>{PROSE}{links}{PROSE}<ul><li>one thing</li></ul><table><tr><td>5</td><td>7</td></tr></table></article></body>"
    assert html_text.main_text(page) == f"Name {said} {said} one thing 5 7"
    # teasers in articles do not replace a body outside of them; without an article, the blocks above the threshold are taken
    teasers = "".join(f"<article><h3><a href=/{i}>Teaser {i}</a></h3><p>short blurb</p></article>" for i in range(5))
    assert html_text.main_text(f"<body><div><h1>Name</h1>{PROSE}{PROSE}</div>{teasers}</body>") == f"Name {said} {said}"
    assert html_text.main_text(f"<body><div><a>a</a> <a>b</a></div><div><h1>Name</h1>{PROSE}</div><div><a>z</a></div></body>") == f"Name {said}"
    assert html_text.main_text(f"<body><main><h2>Two</h2>{PROSE}{links}</main>{links}</body>") == f"Two {said}"
    assert html_text.main_text(f"<body>{links}</body>") == ""


def test_html_query_on_odd_pages(spark, tmp_path):
    long = f"<article>{PROSE * 2000}</article>"
    rows = [(1, "u", None, "x"), (2, None, "", "x"), (3, "u", f"<nav>no</nav><article>{PROSE}</article>", "x"), (3, "u", f"<nav>no</nav><article>{PROSE}</article>", "x"), (4, "u", long, "x"), (None, "u", "a&lt;b", "x")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = QUERIES["op7_html_text"](spark, str(tmp_path))
    said = html_text.main_text(PROSE)
    expected = [(1, "u", ""), (2, None, ""), (3, "u", said), (3, "u", said), (4, "u", " ".join([said] * 2000)), (None, "u", "a<b")]
    assert sorted(((r.page_id, r.url, r.text, r.n_chars) for r in got.collect()), key=repr) == sorted(((*x, len(x[2])) for x in expected), key=repr)
    pages.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert QUERIES["op7_html_text"](spark, str(tmp_path)).count() == 0


def test_mixing_meets_its_targets(spark):
    rows = [(i, "w " * 20, f"s{i % 3}", "en" if i % 2 else "fr") for i in range(600)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    got = mixing.mix(docs, {"source": {"s0": 0.5, "s1": 0.25, "s2": 0.25}}, share=0.5).toPandas()
    cells = got.drop_duplicates(["__source", "__lang", "__topic"]).groupby("__source")["__weight"].sum()
    assert len(got) == 601 and abs(cells["s0"] / cells["s1"] - 2) < 1e-4 and got["__probability"].between(0, 1).all()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    assert {r.id: r.component for r in connected_components(edges).collect()} == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100}


def test_long_text_is_hashed_in_pieces(monkeypatch):
    text = ("ab Cd éf gh " * 4000).strip()
    whole = list(wordhash.shingle_sets([text]))
    monkeypatch.setattr(wordhash, "PIECE", 100)
    assert (list(wordhash.shingle_sets([text]))[0] == whole[0]).all() and len(whole[0]) == len(brute_set(text))


def test_repeated_passages_leave_only_what_is_read_again(spark):
    """Matches, seeds, and the first pass' chains and words go before the second pass."""
    words = [f"w{i}" for i in range(300)]
    docs = spark.createDataFrame([(i, " ".join([*(f"o{i}x{j}" for j in range(60)), *words[i : i + 200]])) for i in range(6)], "doc_id bigint, text string")
    names = lambda folder: sorted(os.listdir(folder))
    folder = os.path.dirname(scratch.shared_dir(spark, "any").removeprefix("file:"))
    before = set(names(folder)) if os.path.isdir(folder) else set()
    got = substring_dedup.repeated_passages(docs)
    left = sorted(n.split("-")[0] for n in set(names(folder)) - before)
    assert left == ["chains", "found", "passages"]
    assert {r.doc_id for r in got.collect()} == {1, 2, 3, 4, 5}
