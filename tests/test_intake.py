"""From documents to verdicts: typed rows, corrections, bucketed tables, and the intake stream with its replays."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import json
import os

import pytest

from attesto.operators import corrections, typed
from attesto.plans.context import from_documents
from attesto.sources.buckets import Buckets
from attesto.streaming import intake

D = decimal.Decimal
PIECE = "document_id bigint, dossier_id bigint, type string, upload int, data string, empreinte string, texte string, qr string"


def pieces_of(spark, *docs):
    return spark.createDataFrame([(i, f, kind, up, data if isinstance(data, str) or data is None else json.dumps(data), f"h{i}" if len(more) == 0 else more[0], None, None) for i, f, kind, up, data, *more in docs], PIECE)


def test_typed_rows_of_a_file(spark):
    rows = typed.dossier_rows(pieces_of(
        spark, (1, 1, "FACTURE", 1, {"numeroFacture": "F1", "montantTTC": "1 200,50 MAD", "montantHT": 1000, "tauxTVA": True, "dateFacture": "31/02/2024", "devise": " mad ", "lignes": [{"designation": " a ", "quantite": 2, "prixUnitaireHt": "3,5"}, {"designation": " "}, 7]}),
        (2, 1, "FACTURE", 0, {"numeroFacture": 12}), (3, 1, "FACTURE", 2, "{broken"), (4, 1, "FACTURE", 3, "[1]"), (5, 1, "FACTURE", 4, None),
        (6, 1, "ORDRE_PAIEMENT", 1, {"montantOperation": 5, "retenues": [{"type": "GARANTIE", "montant": "x"}, {"type": "??", "taux": 10}], "piecesJustificatives": ["a", 1]}), (7, 1, "ORDRE_PAIEMENT", 2, {"montantOperation": "6"}), (8, 1, "AUTRE", 1, {}),
    )).first()
    assert [f.document_id for f in rows.factures] == [2, 1] and rows.factures[0].numero_facture is None
    first = rows.factures[1]
    assert (first.montant_ttc, first.montant_ht, first.taux_tva, first.date_facture, first.devise) == (D("1200.50"), D("1000.00"), None, dt.date(2024, 2, 29), "MAD")
    assert [(x.designation, x.quantite, x.prix_unitaire_ht) for x in first.lignes] == [("a", D("2.000"), D("3.50"))]
    op = rows.ordre_paiement  # the last document's fields, the last list's children, the first document's id
    assert (op.document_id, op.montant_operation, op.pieces_justificatives) == (6, D("6.00"), None) and [(r.type, r.montant, r.taux) for r in op.retenues] == [("GARANTIE", None, None), ("AUTRE", None, D("10.00"))]
    assert rows.bon_commande is None and rows.types == ["AUTRE", "FACTURE", "ORDRE_PAIEMENT"] and len(rows.documents) == 8


def test_corrections_lie_over_what_was_read(spark):
    docs = pieces_of(spark, (1, 1, "FACTURE", 0, {"numeroFacture": "F1", "montantTTC": 5, "dateFacture": "2024-01-01"}), (2, 1, "ATTESTATION_FISCALE", 0, {"estEnRegle": False}))
    fixes = spark.createDataFrame([(1, "montantTtc", "1 234,50", 1), (1, "dateFacture", "2024/05/06", 1), (1, "numeroFacture", "old", 1), (1, "numeroFacture", None, 2), (2, "estEnRegle", "oui", 1), (9, "x", "y", 1)], "document_id bigint, champ string, valeur string, rang int")
    row = typed.dossier_rows(corrections.with_corrections(docs, fixes)).first()
    f = row.factures[0]
    assert (f.numero_facture, f.montant_ttc, f.date_facture, row.attestation_fiscale.est_en_regle) == (None, D("1234.50"), dt.date(2024, 5, 6), True)


def test_scope_is_one_step():
    assert corrections.scope_of("R07") == ["R07", "R08"] and corrections.scope_of("R19") == ["R19"] and len(corrections.scope_of("R12.03")) == 11
    assert corrections.families_of({"R01", "R09"}) == ["amounts", "identities"]


def files_of(folder: str) -> dict[str, float]:
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{folder}/rows/*/*.parquet")}


def test_a_change_of_one_file_rewrites_one_bucket(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t", buckets=8)
    assert table.read() is None
    everything = spark.range(200).selectExpr("id dossier_id", "id % 3 v")
    table.replace(everything, everything)
    before = files_of(table.path)
    table.replace(spark.createDataFrame([(5, 77), (5, 78)], "dossier_id bigint, v bigint"), spark.createDataFrame([(5,)], "dossier_id bigint"))
    after = files_of(table.path)
    assert len({f.split("/")[-2] for f in before}) == 8 and len({f.split("/")[-2] for f in set(before) ^ set(after)}) == 1
    assert sorted(r.v for r in table.read().filter("dossier_id = 5").collect()) == [77, 78] and table.read().count() == 201
    one = table.read(spark.createDataFrame([(5,)], "dossier_id bigint"))
    assert {f.split("/")[-2] for f in one.inputFiles()} >= {f.split("/")[-2] for f in set(before) ^ set(after)} and one.count() < 60
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "seau" in plan
    table.replace(table.read().limit(0), everything)
    assert table.read() is None or table.read().count() == 0


def test_a_second_writer_is_refused(spark, tmp_path):
    table = Buckets(spark, f"{tmp_path}/t")
    rows = spark.createDataFrame([(1, 2)], "dossier_id bigint, v int")
    with table.writer(), pytest.raises(RuntimeError, match="is being written"):
        table.replace(rows, rows)
    table.replace(rows, rows)
    assert table.read().count() == 1


def test_intake_replays_change_nothing(spark, tmp_path):
    """Late and repeated uploads, a query that stops after the sink, and one that fails between the tables: the rows stay the same."""
    fac = lambda n, ttc: {"numeroFacture": n, "montantTTC": ttc, "montantHT": 100, "montantTVA": 20}
    batches = [
        pieces_of(spark, (1, 1, "FACTURE", 0, fac("F1", 120), "a"), (2, 2, "FACTURE", 0, fac("F2", 120), "a"), (3, 1, "BON_COMMANDE", 0, {"montantTTC": 120, "reference": "B1"}, "b")),
        pieces_of(spark, (4, 1, "FACTURE", 1, fac("F1", 120), "a"), (5, 2, "BON_COMMANDE", 1, {"montantTTC": 240, "reference": "B2"}, "c")),
    ]
    files = spark.createDataFrame([(1, "BC"), (2, "BC")], "dossier_id bigint, type_dossier string")
    pieces, verdicts = Buckets(spark, f"{tmp_path}/pieces", buckets=4), Buckets(spark, f"{tmp_path}/verdicts", buckets=4)
    take = {"pieces": pieces, "verdicts": verdicts, "context_of": from_documents, "files": files}
    shown = lambda: {(r.dossier_id, r.regle): r.statut for r in verdicts.read().collect()}
    intake.take_in(batches[0], **take)
    own = spark.createDataFrame([(1, "CUSTOM-01", "CONFORME")], "dossier_id bigint, regle string, statut string")
    verdicts.replace(verdicts.read().filter("dossier_id = 1").unionByName(own, allowMissingColumns=True), own)
    assert shown()[1, "R01"] == "CONFORME" and (2, "R01") not in shown()
    batches[1].write.parquet(f"{tmp_path}/in")

    class Crash(Exception):
        pass

    def failing(*_):
        raise Crash

    with pytest.raises(Crash):  # after the documents are stored, before the verdicts are
        intake.take_in(batches[1], **take | {"context_of": lambda rows, files: failing()})
    stream = spark.readStream.schema(batches[1].schema).parquet(f"{tmp_path}/in")
    intake.start(stream, f"{tmp_path}/checkpoint", **take).awaitTermination()
    first = shown()
    assert first[2, "R01"] == "AVERTISSEMENT" and first[1, "CUSTOM-01"] == "CONFORME" and sorted(r.document_id for r in pieces.read().collect()) == [1, 2, 3, 5]
    intake.start(stream, f"{tmp_path}/again", **take).awaitTermination()  # a new checkpoint: the whole batch comes again
    assert shown() == first and pieces.read().count() == 4
