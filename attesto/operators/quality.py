"""Quality of extracted documents: schema, grounding, agreement of two passes, completeness, coherence, review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.functions import scalars, texts
from attesto.operators.verdicts import KO, NA, OK, WARN

#: Fields that are checked by type, as (field, kind, critical).
SCHEMA = {
    "FACTURE": [
        ("ice", "ICE", True), ("rib", "RIB", False), ("identifiantFiscal", "IF", False), ("dateFacture", "DATE", True), ("montantTTC", "MONTANT", True), ("montantHT", "MONTANT", False),
        ("montantTVA", "MONTANT", False), ("tauxTVA", "TAUX", False), ("numeroFacture", "TEXTE", True), ("fournisseur", "TEXTE", True),
    ],
    "BON_COMMANDE": [("dateBc", "DATE", False), ("montantTTC", "MONTANT", True), ("fournisseur", "TEXTE", True)],
    "ORDRE_PAIEMENT": [("dateEmission", "DATE", False), ("montantOperation", "MONTANT", True), ("rib", "RIB", False)],
    "CONTRAT_AVENANT": [("dateSignature", "DATE", False), ("dateEffet", "DATE", False)],
    "ATTESTATION_FISCALE": [("ice", "ICE", False), ("identifiantFiscal", "IF", False), ("dateEdition", "DATE", False)],
    "MARCHE": [
        ("reference", "TEXTE", True), ("fournisseur", "TEXTE", True), ("dateDocument", "DATE", False), ("dateSignature", "DATE", False), ("dateNotification", "DATE", False), ("dateAo", "DATE", False),
        ("montantTtc", "MONTANT", True), ("montantHt", "MONTANT", False), ("montantTva", "MONTANT", False), ("tauxTva", "TAUX", False),
    ],
    "BON_COMMANDE_CADRE": [
        ("reference", "TEXTE", True), ("fournisseur", "TEXTE", True), ("dateDocument", "DATE", False), ("dateSignature", "DATE", False), ("dateValiditeFin", "DATE", False), ("montantTtc", "MONTANT", True),
        ("plafondMontant", "MONTANT", False), ("tauxTva", "TAUX", False),
    ],
    "CONTRAT_CADRE": [
        ("reference", "TEXTE", True), ("fournisseur", "TEXTE", True), ("dateDocument", "DATE", False), ("dateSignature", "DATE", False), ("dateDebut", "DATE", False), ("dateFin", "DATE", False),
        ("montantTtc", "MONTANT", True), ("tauxTva", "TAUX", False),
    ],
}
#: Identifiers that must occur in the text, as (field, kind, least length, critical).
GROUNDED = {
    "FACTURE": [("ice", "DIGITS", 10, True), ("rib", "DIGITS", 20, False), ("identifiantFiscal", "DIGITS", 5, False), ("numeroFacture", "ALNUM", 4, True)],
    "BON_COMMANDE": [("reference", "ALNUM", 4, True)],
    "ORDRE_PAIEMENT": [("numeroOp", "ALNUM", 4, True), ("rib", "DIGITS", 20, False), ("referenceFacture", "ALNUM", 4, False)],
    "CONTRAT_AVENANT": [("referenceContrat", "ALNUM", 3, True)],
    "ATTESTATION_FISCALE": [("numero", "ALNUM", 3, True), ("ice", "DIGITS", 10, False), ("identifiantFiscal", "DIGITS", 5, False)],
    "PV_RECEPTION": [("referenceContrat", "ALNUM", 3, False)],
    "CHECKLIST_AUTOCONTROLE": [("referenceFacture", "ALNUM", 4, True)], "CHECKLIST_PIECES": [("referenceFacture", "ALNUM", 4, True)], "TABLEAU_CONTROLE": [("referenceFacture", "ALNUM", 4, True)],
    "MARCHE": [("reference", "ALNUM", 3, True), ("numeroAo", "ALNUM", 3, False)], "BON_COMMANDE_CADRE": [("reference", "ALNUM", 3, True)], "CONTRAT_CADRE": [("reference", "ALNUM", 3, True)],
}
#: Fields that a document of a type must have, and should have.
MANDATORY = {
    "FACTURE": ["numeroFacture", "dateFacture", "montantTTC", "fournisseur", "ice"], "BON_COMMANDE": ["reference", "dateBc", "montantTTC", "fournisseur"],
    "ORDRE_PAIEMENT": ["numeroOp", "dateEmission", "montantOperation", "rib", "beneficiaire"], "ATTESTATION_FISCALE": ["numero", "dateEdition", "raisonSociale", "ice"],
    "CONTRAT_AVENANT": ["referenceContrat", "dateSignature", "parties", "objet"], "PV_RECEPTION": ["dateReception", "referenceContrat", "prestations"], "CHECKLIST_AUTOCONTROLE": ["points", "referenceFacture", "prestataire"],
    "CHECKLIST_PIECES": ["pieces", "referenceFacture"], "TABLEAU_CONTROLE": ["points", "referenceFacture", "fournisseur"], "MARCHE": ["reference", "objet", "fournisseur", "montantTtc", "dateDocument"],
    "BON_COMMANDE_CADRE": ["reference", "objet", "fournisseur", "montantTtc", "dateDocument"], "CONTRAT_CADRE": ["reference", "objet", "fournisseur", "montantTtc", "dateDocument"],
}
IMPORTANT = {
    "FACTURE": ["montantHT", "tauxTVA", "lignes", "identifiantFiscal", "rib", "devise", "dateReceptionFacture"], "BON_COMMANDE": ["montantHT", "tauxTVA", "lignes", "objet", "signataire"],
    "ORDRE_PAIEMENT": ["referenceFacture", "retenues", "banque", "syntheseControleur", "modePaiement", "signataireOrdonnateur", "signataireComptable"],
    "ATTESTATION_FISCALE": ["identifiantFiscal", "rc", "estEnRegle", "codeVerification", "typeAttestation"], "CONTRAT_AVENANT": ["grillesTarifaires", "dateEffet", "numeroAvenant"],
    "PV_RECEPTION": ["signataireMadaef", "signataireFournisseur", "periodeDebut", "periodeFin"], "CHECKLIST_AUTOCONTROLE": ["signataires", "dateEtablissement", "referenceBc", "nomProjet"],
    "CHECKLIST_PIECES": ["typeDossier", "signataire", "dateEtablissement"], "TABLEAU_CONTROLE": ["signataire", "dateControle", "conclusionGenerale", "societeGeree"],
    "MARCHE": ["montantHt", "tauxTva", "numeroAo", "dateAo", "categorie", "delaiExecutionMois", "retenueGarantiePct", "cautionDefinitivePct", "revisionPrixAutorisee"],
    "BON_COMMANDE_CADRE": ["montantHt", "tauxTva", "plafondMontant", "dateValiditeFin", "seuilAntiFractionnement"],
    "CONTRAT_CADRE": ["montantHt", "tauxTva", "dateDebut", "dateFin", "periodicite", "reconductionTacite", "preavisResiliationJours"],
}
PLACEHOLDERS = ("n/a", "na", "inconnu", "unknown", "?", "-", "null", "none")
RETRY_BELOW, REVIEW_BELOW = 70, 60


def fields(json: Column) -> Column:
    """The fields of a JSON object by lower-case name; of names that differ in case only, the first."""
    entries = F.map_entries(F.from_json(json, "map<string,string>"))
    keys = F.transform(entries, lambda e: F.lower(e["key"]))
    first = F.filter(entries, lambda e, i: F.array_position(keys, F.lower(e["key"])) == i + 1)
    return F.map_from_entries(F.transform(first, lambda e: F.struct(F.lower(e["key"]), e["value"])))


def field(data: Column, name: str) -> Column:
    return F.try_element_at(data, F.lit(name.lower()))


def amount_field(data: Column, *names: str) -> Column:
    """The amount of the first field that is there; an unreadable one is null, and no later field is tried."""
    return scalars.parse_amount(F.coalesce(*[field(data, n) for n in names]))


def _broken(kind: str, value: Column) -> Column:
    t = F.trim(value)
    digits, amount = texts.digits_only(t), scalars.parse_amount(t)
    wrong = {
        "ICE": ~digits.rlike("^[0-9]{15}$"), "RIB": ~digits.rlike("^[0-9]{24}$"), "IF": ~digits.rlike("^[0-9]{5,15}$"), "DATE": scalars.parse_date_correction(t).isNull(), "MONTANT": amount.isNull() | (amount < 0),
        "TAUX": amount.isNull() | ~amount.isin(*scalars.VAT_RATES), "TEXTE": F.lower(t).isin(*PLACEHOLDERS) | t.rlike(r"^\p{Punct}+$") | (F.length(t) < 2),
    }[kind]
    return F.when(value.isNull(), False).when(t == "", F.lit(kind == "TEXTE")).otherwise(wrong)


def _checked(docs: DataFrame, rules: dict, test, critical_at: int) -> DataFrame:
    """``docs`` (type, data, ...) with violations (fields), valide and data without the fields that are stripped."""
    by_type = lambda kind: F.filter(F.array(*[F.when(F.coalesce(test(rule, field(F.col("data"), rule[0])), F.lit(False)), F.struct(F.lit(rule[0]).alias("champ"), F.lit(rule[critical_at]).alias("critique"), F.lit(rule[1] != "TEXTE").alias("retire"))) for rule in rules[kind]]), lambda v: v.isNotNull())
    found = F.array().cast("array<struct<champ:string,critique:boolean,retire:boolean>>")
    for kind in rules:
        found = F.when(F.col("type") == kind, by_type(kind)).otherwise(found)
    out = docs.withColumn("v", found)
    gone = F.transform(F.filter("v", lambda x: x["retire"]), lambda x: F.lower(x["champ"]))
    kept = F.map_filter("data", lambda k, _: ~F.array_contains(gone, k))
    return out.withColumn("data", kept).withColumn("violations", F.transform("v", lambda x: x["champ"])).withColumn("valide", ~F.exists("v", lambda x: x["critique"])).drop("v")


def validate_schema(docs: DataFrame) -> DataFrame:
    """Fields whose format is wrong; all but free texts are stripped, and a critical one makes the document invalid. Null never violates."""
    return _checked(docs, SCHEMA, lambda rule, value: _broken(rule[1], value), 2)


def validate_grounding(docs: DataFrame) -> DataFrame:
    """Identifiers that do not occur in the document's ``texte``."""
    test = lambda rule, value: (F.trim(value) != "") & ~texts.grounded(F.trim(value), F.coalesce("texte", F.lit("")), rule[1], rule[2])
    return _checked(docs, GROUNDED, test, 3)


def compare_passes(first: DataFrame, second: DataFrame, names: list[str]) -> DataFrame:
    """Per document the identifiers that two passes read differently (stripped) or only the first read (doubted)."""
    both = first.select("document_id", F.col("data").alias("a")).join(second.select("document_id", F.col("data").alias("b")), "document_id", "left")

    def verdict(name: str) -> Column:
        a, b = field(F.col("a"), name), field(F.col("b"), name)
        x, y = texts.digits_only(a), texts.digits_only(b)
        return F.when(a.isNull(), None).when(b.isNull(), "doute").when((x != "") & (y != "") & (x != y), "retire")

    verdicts = [F.struct(F.lit(n).alias("champ"), verdict(n).alias("issue")) for n in names]
    return both.select("document_id", F.inline(F.filter(F.array(*verdicts), lambda v: v["issue"].isNotNull())))


def _missing(names: dict[str, list[str]], kind: Column) -> Column:
    out = F.array().cast("array<string>")
    for name, wanted in names.items():
        there = lambda n: F.coalesce(~F.trim(field(F.col("data"), n)).isin("", "[]", "{}"), F.lit(False))
        out = F.when(kind == name, F.filter(F.array(*[F.when(~there(n), n) for n in wanted]), lambda x: x.isNotNull())).otherwise(out)
    return out


def _share(missing: Column, names: dict[str, list[str]], kind: Column) -> Column:
    total = F.lit(None).cast("int")
    for name, wanted in names.items():
        total = F.when(kind == name, len(wanted)).otherwise(total)
    return F.when(total.isNull(), 1.0).otherwise((total - F.size(missing)) / total)


def _from_ratio(ratio: Column) -> Column:
    return F.when(ratio <= 0.01, 1.0).otherwise(F.greatest(1.0 - ratio * 5.0, F.lit(0.0)))


def coherence() -> Column:
    """Invoices and orders: the mean of the signals there are (HT + TVA against TTC, lines against HT), 0.5 without any; others 1."""
    data, kind = F.col("data"), F.col("type")
    ht, tva, ttc = (amount_field(data, n) for n in ("montantHT", "montantTVA", "montantTTC"))
    gap = lambda a, b: F.round((F.abs(a - b) / F.greatest(F.abs(b), F.lit(1))).cast("double"), 6)
    totals = F.when((ttc != 0) & ht.isNotNull() & tva.isNotNull(), _from_ratio(gap(ht + tva, ttc)))
    lines = F.from_json(field(data, "lignes"), "array<map<string,string>>")
    key = F.when(kind == "FACTURE", F.lit("montantTotalHT")).otherwise(F.lit("montantLigneHT"))
    summed = F.aggregate(lines, F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + F.coalesce(scalars.parse_amount(F.try_element_at(x, key)), F.lit(0))).cast("decimal(28,2)"))
    detail = F.when((ht != 0) & (F.size(lines) > 0) & (summed != 0), _from_ratio(gap(summed, ht)))
    signals = F.filter(F.array(totals, detail), lambda x: x.isNotNull())
    mean = F.aggregate(signals, F.lit(0.0), lambda a, x: a + x) / F.size(signals)
    return F.when(~kind.isin("FACTURE", "BON_COMMANDE"), 1.0).when(F.size(signals) == 0, 0.5).otherwise(mean)


def quality(docs: DataFrame) -> DataFrame:
    """``docs`` (type, data, ocr_confidence, extraction_confidence; -1 is unknown) with manquants and score (0 to 100).

    A high confidence that the extraction claims for itself counts half where two mandatory fields miss or the amounts do not add up.
    """
    kind = F.col("type")
    out = docs.withColumn("manquants", _missing(MANDATORY, kind)).withColumn("souhaites", _missing(IMPORTANT, kind)).withColumn("coherence", coherence())
    known = lambda c, top: F.when(F.col(c) >= 0, F.least(F.col(c) / top, F.lit(1.0))).otherwise(0.5)
    claimed = known("extraction_confidence", F.lit(1.0))
    sure = F.when((claimed > 0.8) & ((F.size("manquants") >= 2) | (F.col("coherence") < 0.7)), F.least(claimed, F.lit(0.5))).otherwise(claimed)
    complete = 0.70 * _share(F.col("manquants"), MANDATORY, kind) + 0.30 * _share(F.col("souhaites"), IMPORTANT, kind)
    raw = 0.30 * known("ocr_confidence", F.lit(100.0)) + 0.30 * sure + 0.25 * complete + 0.15 * F.col("coherence")
    return out.withColumn("score", F.least(F.greatest(raw * 100, F.lit(0.0)), F.lit(100.0)).cast("int"))


def review(docs: DataFrame) -> DataFrame:
    """``docs`` (score, tronque, valide) with suite: ``REVUE_HUMAINE_REQUISE``, ``RELANCE`` or ``EXTRAIT``."""
    person = (F.col("score") < REVIEW_BELOW) | F.col("tronque") | ~F.col("valide")
    return docs.withColumn("suite", F.when(person, "REVUE_HUMAINE_REQUISE").when(F.col("score") < RETRY_BELOW, "RELANCE").otherwise("EXTRAIT"))


def custom_verdicts(rules: DataFrame, answers: DataFrame) -> DataFrame:
    """Verdicts of prompt rules from a model's JSON answers: one row for each rule and file it was put to.

    ``rules``: code, severity, applique (does it apply to the file), dossier_id; ``answers``: dossier_id, reponse, an object
    with ``verdicts`` of code, statut, detail, needsMoreInfo. The last verdict of a code counts, no answer is a warning, severity
    caps failures.
    """
    schema = "struct<verdicts:array<struct<code:string,statut:string,detail:string,needsMoreInfo:boolean>>>"
    each = answers.select("dossier_id", F.posexplode(F.from_json("reponse", schema)["verdicts"]).alias("place", "v"))
    said = each.groupBy("dossier_id", F.col("v.code").alias("code")).agg(F.max_by("v", "place").alias("v")).select("dossier_id", "code", "v.statut", "v.detail", "v.needsMoreInfo")
    status = F.upper(F.coalesce("statut", F.lit(WARN)))
    status = F.when(~status.isin(OK, KO, WARN, NA), WARN).when((status == KO) & (F.col("severity") == WARN), WARN).otherwise(status)
    out = rules.join(said, ["dossier_id", "code"], "left")
    final = F.when(~F.col("applique"), NA).when(F.col("statut").isNull() & F.col("detail").isNull() & F.col("needsMoreInfo").isNull(), WARN).when(F.col("needsMoreInfo"), NA).otherwise(status)
    return out.select("dossier_id", F.col("code").alias("regle"), final.alias("statut"), "detail")
