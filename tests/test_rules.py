"""Verdicts of single rules over hand-made files."""

from __future__ import annotations

import datetime as dt

import pytest

from attesto.functions import scalars
from attesto.operators import crossfile, duplicates, lines, quality, rules
from attesto.operators.verdicts import emit
from attesto.plans.context import COLUMNS, complete
from pyspark.sql import functions as F

D = dt.date


def statuses(spark, family: str, **given) -> dict[str, str]:
    schema = ", ".join(["dossier_id int", *[f"{k} {COLUMNS[k]}" for k in given]])
    context = complete(spark.createDataFrame([(1, *given.values())], schema))
    return {r["regle"]: r["statut"] for r in emit(context, rules.FAMILIES[family]()).collect()}


def dec(x):
    import decimal

    return decimal.Decimal(str(x))


def test_amounts(spark):
    base = {"type_dossier": "BC", "f_ht": dec(100), "f_tva": dec(20), "f_ttc": dec(120), "bc_ttc": dec(120), "bc_ht": dec(200), "bc_tva": dec(50), "f_taux": dec(20)}
    got = statuses(spark, "amounts", **base)
    assert got["R01"] == "CONFORME" and got["R02"] == "AVERTISSEMENT" and got["R03"] == "NON_CONFORME" and got["R16"] == "CONFORME" and got["R30"] == "CONFORME"
    assert "R03b" not in got and "R04" not in got and "R06" not in got  # missing rows, not warnings


def test_withholdings(spark):
    held = [("TVA_SOURCE", dec(20), dec(75), dec(15)), ("IS_HONORAIRES", dec(100), dec(12), dec(12))]
    got = statuses(spark, "amounts", f_ttc=dec(120), op_montant=dec(93), retenues=held)
    assert got["R05"] == "CONFORME" and got["R06"] == "CONFORME" and got["R06b"] == "NON_CONFORME" and "R04" not in got


@pytest.mark.parametrize(("mode", "ttc", "expected"), [("Espèces", 6000, "NON_CONFORME"), ("especes", 5000, "CONFORME"), ("virement", 6000, None)])
def test_cash(spark, mode, ttc, expected):
    assert statuses(spark, "chronology", op_mode=mode, f_ttc=dec(ttc)).get("R26") == expected


def test_certificate_lasts_six_months_inclusive(spark):
    assert statuses(spark, "chronology", arf_date=D(2024, 1, 15), op_date=D(2024, 7, 15))["R18"] == "CONFORME"
    assert statuses(spark, "chronology", arf_date=D(2024, 1, 15), op_date=D(2024, 7, 16))["R18"] == "NON_CONFORME"
    assert statuses(spark, "chronology", e_type="MARCHE", arf_date=D(2024, 1, 15), op_date=D(2024, 5, 1))["R18"] == "NON_CONFORME"


def test_identifiers(spark):
    got = statuses(spark, "identities", f_ice="001509176000008", arf_ice="1509176000008", arf_date=D(2024, 1, 1), f_id_fiscal="0042", arf_id_fiscal="42")
    assert got["R09"] == "NON_CONFORME" and got["R09b"] == "NON_CONFORME" and got["R10"] == "CONFORME" and got["R23"] == "AVERTISSEMENT"


def test_missing_documents(spark):
    for missing, status in ((0, "CONFORME"), (2, "AVERTISSEMENT"), (3, "NON_CONFORME")):
        assert statuses(spark, "references", requis=["A", "B", "C"], presents=["A", "B", "C"][missing:])["R20"] == status


def test_checklist_takes_the_worst_point(spark):
    got = statuses(spark, "checklist", f_ttc=dec(120), f_ht=dec(100), f_tva=dec(20), points=[(6, True), (10, False), (2, None)])
    assert got["R12.06"] == "CONFORME" and got["R12.10"] == "NON_CONFORME" and got["R12.02"] == "CONFORME" and got["R12"] == "NON_CONFORME"


def test_engagement(spark):
    got = statuses(spark, "engagement", e_type="CONTRAT", e_statut="SUSPENDU", e_plafond=dec(100), e_consomme=dec(101), f_ttc=dec(115), e_precedent_ttc=dec(100), e_indice="S")
    assert got["R-E01"] == "AVERTISSEMENT" and got["R-E03"] == "AVERTISSEMENT" and got["R-E05"] == "CONFORME" and got["R-C04"] == "AVERTISSEMENT" and "R-M01" not in got
    assert "R-E01" not in statuses(spark, "engagement", f_ttc=dec(1))


def test_identifiers_agree_whatever_their_separators(spark):
    got = spark.range(1).select(scalars.compact(F.lit("001-780 12.3")).alias("c"), scalars.normalize_id(F.lit("00-1.2")).alias("i"), scalars.normalize_ice(F.lit("0012-34")).alias("ice"), scalars.compact(F.lit(" -. ")).alias("none")).first()
    assert tuple(got) == ("001780123", "12", "001234", None)


def test_scalars(spark):
    row = spark.range(1).select(
        *[scalars.parse_amount(F.lit(x)).cast("string").alias(f"a{i}") for i, x in enumerate(["1 234,56", "1.234,56 MAD", "1,234.56", "-7", "x"])],
        scalars.match_reference(F.lit("BC-2024/001"), F.lit("bc2024001")).alias("same"), scalars.match_reference(F.lit("12"), F.lit("312")).alias("short"),
        scalars.jaccard(scalars.words(F.lit("Société Alpha SARL")), scalars.words(F.lit("alpha sarl"))).alias("j"),
    ).head()
    assert list(row)[:5] == ["1234.56", "1234.56", "1234.56", "-7.00", None] and row["same"] and not row["short"] and abs(row["j"] - 2 / 3) < 1e-9


def test_rule_switches_and_reruns(spark):
    v = spark.createDataFrame([(1, "R01", "CONFORME"), (1, "R02", "CONFORME"), (2, "R01", "CONFORME"), (2, "CUSTOM-1", "CONFORME")], "dossier_id int, regle string, statut string")
    on = crossfile.enabled_verdicts(v, spark.createDataFrame([("R01", False)], "regle string, enabled boolean"), spark.createDataFrame([(2, "R01", True)], "dossier_id int, regle string, enabled boolean"))
    assert {(r[0], r[1]) for r in on.select("dossier_id", "regle").collect()} == {(1, "R02"), (2, "R01"), (2, "CUSTOM-1")}
    new = spark.createDataFrame([(2, "R09", "CONFORME")], v.schema)
    assert {(r[0], r[1]) for r in crossfile.replace_verdicts(v, new).select("dossier_id", "regle").collect()} == {(1, "R01"), (1, "R02"), (2, "CUSTOM-1"), (2, "R09")}


@pytest.mark.parametrize(
    ("system", "human", "expected"),
    [("NON_CONFORME", True, "NON_CONFORME"), ("AVERTISSEMENT", True, "AVERTISSEMENT"), ("NON_APPLICABLE", True, "CONFORME"), ("CONFORME", True, "CONFORME"), ("CONFORME", False, "NON_CONFORME"), ("AVERTISSEMENT", None, "AVERTISSEMENT"), ("NON_APPLICABLE", None, "NON_APPLICABLE")],
)
def test_a_yes_never_lifts_a_warning(spark, system, human, expected):
    assert spark.range(1).select(rules.merge_status(F.lit(system), F.lit(human).cast("boolean"))).first()[0] == expected


def test_apostrophes_are_no_part_of_a_reference(spark):
    assert spark.range(1).select(scalars.match_reference(F.lit("L'ABC-12"), F.lit("LABC12"))).first()[0]


INVOICE = "facture_id int, dossier_id int, numero string, fournisseur string, canonique int, ttc decimal(18,2), jour date, genre string"


def duplicates_of(spark, *rows) -> dict[int, tuple]:
    given = [(i, *r, *[None] * (7 - len(r))) for i, r in enumerate(rows)]
    return {r.facture_id: (r.doublons, r.compensations) for r in duplicates.duplicate_verdicts(spark.createDataFrame(given, INVOICE), "2024-06-01").collect()}


def test_duplicates_with_mixed_canonical_suppliers(spark):
    """Of each pair one side has a canonical supplier; the side without one looks by name among all, the other by its id only."""
    day = D(2024, 5, 1)
    got = duplicates_of(spark, (1, "A1", "Alpha", 7, dec(1000), day), (2, "A2", "ALPHA ", None, dec(1005), day), (3, "B1", "Beta", 9, dec(50), day), (3, "B2", "beta", None, dec(50), day), (4, "C", "Gamma", 7, dec(999), D(2024, 5, 4)))
    assert got == {0: (1, 0), 1: (1, 0), 2: (1, 0), 3: (1, 0), 4: (1, 0)}


def test_duplicates_by_number(spark):
    got = duplicates_of(
        spark, (1, "F-1", "x", None, None, D(2024, 5, 1)), (2, " f-1 ", "y", None, None, None), (3, "F-1", "z", None, None, D(2020, 1, 1)),  # the last is too old to be found, and finds
        (4, "G", "x", None, dec(10), D(2024, 5, 1)), (4, "g", "x", None, dec(-10), D(2024, 5, 1)), (5, " ", "x", None, dec(10), D(2024, 5, 9)), (6, "H", "u", None, dec(5), D(2024, 5, 1), "Avoir"), (7, "H", "v", None, dec(5), D(2024, 5, 1)),
    )
    assert got == {0: (1, 0), 1: (1, 0), 2: (2, 0), 3: (0, 1), 4: (0, 1), 5: (0, 0), 6: (0, 1), 7: (0, 1)}


def test_a_number_that_all_bear_is_counted_without_pairs(spark):
    rows = spark.range(20_000).select(F.col("id").cast("int").alias("facture_id"), F.col("id").cast("int").alias("dossier_id"), F.lit("1").alias("numero"), F.col("id").cast("string").alias("fournisseur"), F.lit(None).cast("int").alias("canonique"), F.lit(None).cast("decimal(18,2)").alias("ttc"), F.lit(None).cast("date").alias("jour"))
    assert duplicates.duplicate_verdicts(rows, "2024-06-01").agg(F.min("doublons"), F.max("doublons")).first()[:] == (19_999, 19_999)


def test_previous_payment_is_strictly_earlier(spark):
    rows = [(1, 1, D(2024, 1, 1), dec(10)), (2, 1, D(2024, 1, 1), None), (3, 1, D(2024, 3, 1), dec(30)), (4, 1, None, dec(40)), (5, 1, D(2023, 1, 1), dec(50)), (6, None, D(2024, 5, 5), dec(60)), (7, None, D(2024, 5, 6), dec(70))]
    df = spark.createDataFrame(rows, "dossier_id int, e int, jour date, ttc decimal(18,2)")
    got = {r.dossier_id: (r.precedente, r.precedent_ttc) for r in crossfile.previous_payment(df, "e", "jour", "dossier_id", "ttc").collect()}
    assert got == {1: (D(2023, 1, 1), None), 2: (D(2023, 1, 1), dec(10)), 3: (D(2024, 1, 1), None), 4: (None, dec(30)), 5: (None, dec(40)), 6: (None, None), 7: (None, None)}


def test_order_engagements_of_one_supplier_add_up(spark):
    rows = [(1, "Alpha", D(2024, 1, 1), dec(100)), (2, " ALPHA", D(2023, 12, 1), dec(50)), (3, "alpha", D(2022, 1, 1), dec(900)), (4, "Beta", D(2024, 1, 1), None), (5, " ", D(2024, 1, 1), dec(5))]
    out = crossfile.split_orders(spark.createDataFrame(rows, "engagement_id int, fournisseur string, jour date, montant decimal(18,2)"), "2024-06-01")
    assert {r.engagement_id: r.cumul for r in out.collect()} == {1: dec(150), 2: dec(150), 3: dec(1050), 4: 0, 5: None}


def test_the_last_answer_of_a_code_counts(spark):
    rules_ = spark.createDataFrame([(1, "C", "AVERTISSEMENT", True)], "dossier_id int, code string, severity string, applique boolean")
    said = spark.createDataFrame([(1, '{"verdicts":[{"code":"C","statut":"NON_CONFORME"},{"code":"C","statut":"CONFORME","detail":"last"}]}')], "dossier_id int, reponse string")
    assert [(r.statut, r.detail) for r in quality.custom_verdicts(rules_, said).collect()] == [("CONFORME", "last")]


def test_names_fold_as_their_decomposition(spark):
    """Every assigned character of the first three planes: decomposed, marks dropped, lower case, only ASCII letters and digits kept."""
    import re
    import unicodedata

    chars = [chr(c) for c in range(0x20, 0x30000) if unicodedata.category(chr(c)) not in ("Cn", "Cs")]
    joined = ["x" + "y".join(chars[i : i + 50]) for i in range(0, len(chars), 50)]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(joined)], "i int, t string").select("i", scalars.normalize_label(F.col("t")).alias("n")).orderBy("i").select("n").collect()]
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if not 0x300 <= ord(c) < 0x370)
    assert got == [re.sub("[^a-z0-9]+", " ", bare(t).lower()).strip() for t in joined]


def test_lines_take_codes_first_and_contested_references_once(spark):
    line = "dossier_id bigint, ligne int, code string, designation string, quantite decimal(15,3), pu decimal(18,2), total decimal(18,2)"
    own = [(1, 1, None, "pompe immergée bleue", 1, 10, 10), (1, 2, " ab-1 ", "autre chose", 2, 10, 20), (1, 3, None, "pompe immergee", 1, 10, 10), (1, 4, None, "Pompe immergée", 1, 10, 10), (2, 1, "AB1", "x", 1, 1, 1)]
    refs = [(1, 1, "AB-1", "pompe immergee bleue", 2, 10, 20), (1, 2, None, "POMPE immergée", 1, 11, 10), (1, 3, None, "frais", 1, 1, 1), (2, 1, "AB-1", "y", 1, 1, 1), (2, 2, "ab1", "z", 1, 1, 1)]
    rows = lambda given: spark.createDataFrame([(*r[:4], *map(dec, r[4:])) for r in given], line)
    pairs = {(r.dossier_id, r.l): (r.r, r.differe) for r in lines.greedy(lines.candidates(rows(own), rows(refs))).collect()}
    # line 1 takes reference 1 by its words before line 2 can have it by its code; line 3 takes reference 2, so line 4 finds nothing
    assert pairs == {(1, 1): (1, True), (1, 3): (2, True), (2, 1): (2, False)}
    got = {r.dossier_id: (r.statut, r.sans_reference, r.differentes, r.manquantes) for r in lines.line_verdicts(rows(own), rows(refs)).collect()}
    assert got == {1: ("NON_CONFORME", 2, 2, 1), 2: ("NON_CONFORME", 0, 0, 1)}
