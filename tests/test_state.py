"""Sinks, streams and operators that a query over the tables at hand does not reach."""

from __future__ import annotations

import zipfile

from pyspark.sql import functions as F

from attesto.operators import custom, listing, search
from attesto.sources import tables
from attesto.sources.buckets import Buckets
from attesto.streaming import telemetry


def test_a_rerun_of_one_file_leaves_the_others(spark, tmp_path):
    path, schema = f"{tmp_path}/verdicts", "dossier_id int, regle string, statut string, source string"
    assert tables.read_verdicts(spark, path) is None
    tables.write_verdicts(spark.createDataFrame([(1, "R01", "CONFORME", "DETERMINISTE"), (2, "R01", "CONFORME", "DETERMINISTE"), (2, "CUSTOM-01", "CONFORME", "CUSTOM")], schema), path)
    tables.write_verdicts(spark.createDataFrame([(2, "R01", "NON_CONFORME", "DETERMINISTE")], schema), path)
    assert {(r.dossier_id, r.regle, r.statut) for r in tables.read_verdicts(spark, path).collect()} == {(1, "R01", "CONFORME"), (2, "R01", "NON_CONFORME"), (2, "CUSTOM-01", "CONFORME")}


def test_archives_are_read_file_by_file(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("x/facture.txt", b"one")
        archive.writestr("pv.txt", b"two")
    assert {(r.nom, bytes(r.contenu)) for r in tables.read_archive(spark, str(tmp_path)).collect()} == {("x/facture.txt", b"one"), ("pv.txt", b"two")}


def test_uploads_are_taken_once_a_file(spark, tmp_path):
    rows = [(1, b"a", "2024-01-01 10:00:00"), (1, b"a", "2024-01-01 11:00:00"), (2, b"a", "2024-01-01 12:00:00")]
    df = spark.createDataFrame(rows, "dossier_id int, contenu binary, t string").select("dossier_id", "contenu", F.to_timestamp("t").alias("ts"))
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = telemetry.new_documents(stream).writeStream.format("memory").queryName("taken").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.dossier_id for r in spark.sql("select dossier_id from taken").collect()) == [1, 2]


def test_reruns_take_one_step_of_dependencies():
    assert listing.cascade_scope(["R01"], {"R01f": ["R01"], "R01g": ["R01f"], "R02": []}) == ["R01", "R01f"]


def test_bad_predicate_rules_say_why_and_stop_nothing(spark):
    context = spark.createDataFrame([(1, 10, None), (2, 30, "x"), (3, None, "x")], "dossier_id int, f_ttc int, f_numero string")
    asked = [("CUSTOM-01", "NON_CONFORME", "f_ttc < 20"), ("CUSTOM-02", "AVERTISSEMENT", "f_numero IS NOT NULL"), ("CUSTOM-03", "", "inconnue > 1"), ("CUSTOM-04", "", "sum(f_ttc) > 1"), ("CUSTOM-05", "", "f_ttc IN (SELECT 1)"), ("CUSTOM-06", "", "f_ttc +"), ("CUSTOM-07", "", "f_ttc")]
    rows, bad = custom.predicate_verdicts(context, asked)
    assert sorted(bad) == [f"CUSTOM-0{i}" for i in range(3, 8)] and all(bad.values())
    assert {(r.dossier_id, r.regle): r.statut for r in rows.collect()} == {(1, "CUSTOM-01"): "CONFORME", (2, "CUSTOM-01"): "NON_CONFORME", (1, "CUSTOM-02"): "AVERTISSEMENT", (2, "CUSTOM-02"): "CONFORME", (3, "CUSTOM-02"): "CONFORME"}
    assert custom.predicate_verdicts(context, asked[2:3])[0] is None


def test_a_search_reads_its_words_buckets_only(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Note de l'eau", "eau et l'Eau potable"), (2, "Autre", "l eau"), (3, None, None), (4, "l'eau", "")], "doc_id bigint, titre string, texte string")
    index = Buckets(spark, f"{tmp_path}/index", key="mot", buckets=16)
    search.add_documents(index, docs.filter("doc_id < 3"), "doc_id", "titre", "texte")
    search.add_documents(index, docs.filter("doc_id > 2"), "doc_id", "titre", "texte")
    search.add_documents(index, docs.filter("doc_id = 4"), "doc_id", "titre", "texte")  # again
    found = search.search(index, "l'EAU")
    assert [(r.doc_id, r.rang) for r in found.collect()] == [(1, 23), (4, 20), (2, 2)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "seau" in plan.split("PartitionFilters")[1][:200]
    assert search.search(index, "absent eau").count() == 0 and search.search(index, " - ").count() == 0


def test_added_documents_rewrite_nothing_of_an_index(spark, tmp_path):
    """What was added before is neither read nor written again; of a document that is added again only its words of now count."""
    rows = lambda *given: spark.createDataFrame(given, "doc_id bigint, titre string, texte string")
    index, files = Buckets(spark, f"{tmp_path}/index", key="mot", buckets=4), lambda: {f: f.stat().st_mtime_ns for f in (tmp_path / "index").rglob("part-*")}
    assert search.search(index, "eau").count() == 0
    search.add_documents(index, rows((1, "eau", "vive"), (2, "", "eau eau"), (2, "eau", None)), "doc_id", "titre", "texte")
    before = files()
    search.add_documents(index, rows((3, None, "Eau VIVE"), (1, None, "morte")), "doc_id", "titre", "texte")
    search.add_documents(index, rows((4, None, " - "), (2, None, None)), "doc_id", "titre", "texte")
    assert before.items() <= files().items()
    found = lambda text: [(r.doc_id, r.rang) for r in search.search(index, text).collect()]
    assert found("eau") == [(3, 1)] and found("vive") == [(3, 1)] and found("morte") == [(1, 1)]
    search.add_documents(index, rows((2, "eau", "eau eau")), "doc_id", "titre", "texte")
    (tmp_path / "index/lots/_done/4").rename(tmp_path / "index/gone")  # a writer that failed before the end
    assert found("eau") == [(3, 1)]
    search.add_documents(index, rows((5, "eau", "")), "doc_id", "titre", "texte")
    assert found("eau") == [(5, 10), (3, 1)]
