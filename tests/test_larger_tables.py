"""What shows only on larger tables: numbers of more digits, layouts that spare shuffles, values worked out once."""

from __future__ import annotations

import datetime
import decimal
import itertools
import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from attesto.functions import scalars
from attesto.operators import duplicates, mutations, rules, typed
from attesto.operators.verdicts import partial_amount_status
from attesto.plans.catalogue import ORACLE_SQL, QUERIES
from attesto.plans.context import fields_of, from_documents
from attesto.plans import files as standin_files
from attesto.plans.files import stored, whole_files
from attesto.plans.rule_queries import _fraction
from attesto.sources.scratch import discard, written_in_turns
from tests.compare import same

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def beyond(spark, tmp_path):
    """Tables whose keys have seven digits, and more new files than five digits count."""
    for name in ("supplier", "customer", "lineitem"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    part = spark.read.parquet(f"{FOLDER}/part.parquet")
    part.unionByName(part.withColumn("p_partkey", (F.col("p_partkey") * 10 + 1_000_000).cast(part.schema["p_partkey"].dataType))).write.parquet(str(tmp_path / "part.parquet"))
    orders = spark.read.parquet(f"{FOLDER}/orders.parquet")
    n = -(-110_000 // max(orders.filter("o_orderdate >= '2000-06-01'").count(), 1))
    more = orders.filter("o_orderdate >= '2000-06-01'").crossJoin(spark.range(n)).withColumn("o_orderkey", (F.col("o_orderkey") + F.col("id") * 1_000_000).cast(orders.schema["o_orderkey"].dataType)).drop("id")
    more.write.parquet(str(tmp_path / "orders.parquet"))
    return str(tmp_path)


@pytest.mark.parametrize("name", ["created_dossiers", "custom_rules_enabled"])
def test_numbers_of_more_digits(spark, beyond, name):
    same(spark, beyond, QUERIES[name], ORACLE_SQL[name])


def test_files_are_numbered_in_ranges(spark):
    got = {r.dossier_id: (r.numero, r.reference) for r in mutations.created(spark.range(0, 3000, 3).withColumnRenamed("id", "dossier_id"), 2026, 99_990).collect()}
    assert [got[k][0] for k in sorted(got)] == list(range(99_991, 100_991)) and got[27][1] == "DOS-2026-00000"


def test_context_of_stored_files_shuffles_nothing(spark):
    docs, files = stored(spark, FOLDER)
    plan = from_documents(typed.dossier_rows(docs), files)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan


def test_files_are_made_of_buckets_that_go_when_they_are_used(spark):
    files, used = whole_files(spark, FOLDER, 3)
    assert "Exchange hashpartitioning" not in files._jdf.queryExecution().executedPlan().toString()
    folders = {os.path.dirname(f.removeprefix("file://")) for t in used for f in t.inputFiles()}
    assert len(folders) == 3 and all(map(os.path.isdir, folders))
    discard(*used)
    assert not any(map(os.path.exists, folders))


def test_rules_of_one_family_write_no_context(spark):
    folder = FOLDER + "/"  # of no other test
    same(spark, folder, QUERIES["rules_chronology"], ORACLE_SQL["rules_chronology"])
    assert (spark.sparkContext.applicationId, folder, "context") not in standin_files._stored


def test_turns_hold_every_row_once(spark):
    rows = spark.range(1000).select(F.when(F.col("id") % 7 > 0, F.col("id") % 50).alias("k"), "id")
    table = written_in_turns((rows.filter(turn) for turn in standin_files.turns("k")), "turns", "k", 3)
    assert sorted(r.id for r in table.collect()) == list(range(1000)) and table.filter("k is null").count() == 143
    assert "Exchange" not in table.groupBy("k").count()._jdf.queryExecution().executedPlan().toString()
    discard(table)


def test_a_value_is_worked_out_once(spark):
    sizes = [len(f(F.col("c"))._jc.toString()) for f in (scalars.parse_amount, scalars.parse_amount_strict)]
    nested = scalars.parse_amount_strict(scalars.parse_amount_strict(F.col("c")).cast("string"))
    assert len(nested._jc.toString()) < 3 * sizes[1]
    row = spark.sql("SELECT '1 234,50' AS a, '1.234,50 DH' AS b, '12-5' AS c, CAST(NULL AS STRING) AS d")
    assert [str(x) for x in row.select(*map(scalars.parse_amount_strict, map(F.col, "abcd"))).head()] == ["1234.50", "1234.50", "None", "None"]


def _plan(spark, name: str) -> str:
    return QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


def test_documents_by_type_expand_nothing(spark):
    same(spark, FOLDER, QUERIES["documents_by_type"], ORACLE_SQL["documents_by_type"])
    assert "Expand" not in _plan(spark, "documents_by_type")


def test_lines_are_dealt_once(spark):
    same(spark, FOLDER, QUERIES["rule_lines"], ORACLE_SQL["rule_lines"])
    assert _plan(spark, "rule_lines").count("Exchange hashpartitioning") <= 3  # of references, which are a union, and of candidates before and after the greedy pass


def test_labels_are_normalised_before_they_are_paired(spark):
    same(spark, FOLDER, QUERIES["compared_part_names"], ORACLE_SQL["compared_part_names"])
    plan = QUERIES["compared_part_names"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" in plan and "regexp_replace" not in plan.split("Join Inner")[0]


def test_invoices_of_one_amount_and_day_are_counted_without_pairs(spark):
    """Their pairs would be 900 million."""
    column = lambda value, kind: F.lit(value).cast(kind)
    rows = spark.range(30_000).select(F.col("id").alias("facture_id"), F.col("id").alias("dossier_id"), F.concat(F.lit("F"), "id").alias("numero"), column("a", "string").alias("fournisseur"), column(None, "int").alias("canonique"), column(100, "decimal(18,2)").alias("ttc"), column("2024-05-01", "date").alias("jour"))
    got = duplicates.duplicate_verdicts(rows, "2024-06-01")
    assert got.agg(F.min("doublons"), F.max("doublons")).first()[:] == (29_999, 29_999)
    assert "a_tranche" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_counted_bands_equal_brute_force(spark):
    """Amounts on the margin, equal numbers, and names that differ inside a file and across files."""
    rng = random.Random(19)
    rows = []
    for i in range(500):
        ttc = decimal.Decimal(rng.choice([10000, 10099, 10100, 10101, 10201, 9999, 9900, 9901, 50, 1, rng.randint(9000, 11000), 10000 + 101 * rng.randint(0, 9)])) / 100
        rows.append((i, rng.choice([None, *range(60)]), rng.choice([None, " ", f"N{rng.randint(0, 40)}", f" n{rng.randint(0, 40)}"]), rng.choice([None, "a", "A", " a", "b", " "]), rng.choice([None, None, 1, 2]), ttc, datetime.date(2024, 1, rng.randint(1, 9))))

    def alike(a, b) -> bool:
        number, name = (lambda r: (r[2] or "").lower()), (lambda r: None if r[3] is None else r[3].lower())
        trimmed = lambda r: (name(r) or "").strip() or None
        if a[0] == b[0] or abs((a[6] - b[6]).days) > 3 or abs(a[5] - b[5]) > round(a[5] / 100, 4) or (number(a).strip() and a[2].lower() == (b[2] or "").lower()):
            return False
        if a[4] is not None and b[4] is not None and a[4] == b[4]:
            return True
        if trimmed(a) is None or trimmed(a) != trimmed(b):
            return False
        if a[1] is not None and a[1] == b[1]:
            return (a[4] is None or b[4] is None) and name(a) == name(b)
        return a[4] is None

    sound = spark.createDataFrame(rows, "facture_id int, dossier_id int, numero string, fournisseur string, canonique int, ttc decimal(18,2), jour date").withColumn("numero", F.lower("numero")).withColumn("cle", F.nullif(F.trim("numero"), F.lit(""))).withColumn("nom", F.lower("fournisseur")).withColumn("qui", F.nullif(F.trim(F.lower("fournisseur")), F.lit("")))
    got = {r.facture_id: r.n for r in duplicates._by_amount(sound, 1.0, 3).groupBy("facture_id").agg(F.sum("doublons").alias("n")).collect()}
    expected = {a[0]: sum(alike(a, b) for b in rows) for a in rows}
    assert {i: got.get(i, 0) for i in expected} == expected and sum(expected.values()) > 1000


def test_fractions_are_compared_as_their_sql_compares_them(spark):
    """Differences of exactly the tolerance, which decimals and doubles tell apart; the first three are of sixty times sf0.1 with fresh amounts."""
    orders = [(decimal.Decimal(a), decimal.Decimal(b)) for a, b in (("2743.81", "32926.36"), ("4015.03", "48179.73"), ("2858.69", "34303.62"), ("-1.00", "0.00"))]
    for whole, n, cents in itertools.product((10000, 98765, 4817973, 31415926, 31415927), (2, 3, 4, 6, 12), (-6, -5, -4, 0, 4, 5, 6)):
        orders.append((decimal.Decimal(round(whole / n) + cents) / 100, decimal.Decimal(whole) / 100))
    rows = spark.createDataFrame(orders, "a decimal(18,2), b decimal(18,2)")
    got = [r.s for r in rows.select(partial_amount_status(F.col("a"), F.col("b")).alias("s")).collect()]
    values = ", ".join(f"({i}, CAST({a} AS DECIMAL(18,2)), CAST({b} AS DECIMAL(18,2)))" for i, (a, b) in enumerate(orders))
    expected = [r[0] for r in duckdb.connect().execute(f"SELECT {_fraction('a', 'b')} FROM (VALUES {values}) t(i, a, b) ORDER BY i").fetchall()]
    assert got == expected and got[:3] == ["NON_CONFORME"] * 3


def test_a_family_reads_only_what_its_rules_look_at(spark):
    """No join with other files, no documents of types that no rule of the family reads, and no other columns; the rest of the family is compared with its SQL."""
    folder = FOLDER + "//"  # of no other test
    rows = standin_files.context_rows(spark, folder, rules.reads("chronology"))
    assert set(rows.columns) == {"dossier_id"} | rules.reads("chronology")
    assert not any("/across-" in f for f in rows.inputFiles()) and any("/lineitem-" in f for f in rows.inputFiles())
    assert "FACTURE" in fields_of(rules.reads("chronology")) and not {"CHECKLIST_AUTOCONTROLE", "TABLEAU_CONTROLE"} & set(fields_of(rules.reads("chronology")))
    asked = standin_files.context_rows(spark, folder, rules.reads("engagement"))
    assert any("/across-" in f for f in asked.inputFiles())
    docs, files = stored(spark, FOLDER)
    whole = from_documents(typed.dossier_rows(docs), files)
    pick = [F.col("dossier_id"), *[F.col(c) for c in sorted(rules.reads("chronology"))]]
    assert sorted(map(repr, rows.select(pick).collect())) == sorted(map(repr, whole.select(pick).collect()))


def test_reruns_make_documents_of_touched_files_only(spark):
    same(spark, FOLDER, QUERIES["corrected_reruns"], ORACLE_SQL["corrected_reruns"])
    docs, files = standin_files.some_documents(spark, FOLDER, lambda k: k % 20 < 2, rules.reads("amounts"))
    assert docs.filter("dossier_id % 20 >= 2").count() == 0 and files.filter("dossier_id % 20 >= 2").count() == 0
    assert files.count() == spark.read.parquet(f"{FOLDER}/orders.parquet").filter("o_orderkey % 20 < 2").count()
    assert {r.type for r in docs.select("type").distinct().collect()} == {"FACTURE", "BON_COMMANDE", "CONTRAT_AVENANT", "ORDRE_PAIEMENT", "PV_RECEPTION"}
