"""Text, number, date and quality functions over stand-in texts, with SQL.

Each order carries one of a few texts, chosen by its key, with the key put in for ``#``; the SQL states what each gives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.functions import scalars, texts
from attesto.operators import quality, typed
from attesto.plans.registry import query
from attesto.sources.tables import table


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _chosen(values: list) -> str:
    """DuckDB: the value of an order's key."""
    items = ", ".join("NULL" if v is None else _quoted(v) if isinstance(v, str) else str(v) for v in values)
    return f"([{items}])[CAST(o_orderkey % {len(values)} AS INT) + 1]"


def _put(values: list) -> str:
    return f"replace({_chosen(values)}, '#', CAST(o_orderkey AS VARCHAR))"


def _samples(spark: SparkSession, sf_dir: str, values: list[str | None]) -> DataFrame:
    """(k, t): an order's key and its text."""
    chosen = F.get(F.array(*[F.lit(v).cast("string") for v in values]), (F.col("o_orderkey") % len(values)).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.replace(chosen, F.lit("#"), F.col("o_orderkey").cast("string")).alias("t"))


WORDS = "regexp_split_to_array(t, '\\s+')"
LINES = "regexp_split_to_array(t, '\\r\\n|\\n|\\r')"
NOISE = f"len(list_filter({LINES}, lambda x: length(trim(x, ' ')) BETWEEN 1 AND 2))"
KEYWORDS = " + ".join(f"CASE WHEN contains(lower(t), '{w}') THEN 8 ELSE 0 END" for w in texts.KEYWORDS)


#: Score of a recognised text ``t``.
SCORE = f"""CAST(CASE WHEN trim(t, ' ') = '' THEN 0 ELSE len(list_filter({WORDS}, lambda x: length(x) > 1)) + 10 * len(regexp_extract_all(t, '\\d+[.,]\\d{{2}}')) + 5 * len(regexp_extract_all(t, '\\b(\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{2}}[/-]\\d{{2}}[/-]\\d{{4}})\\b'))
    + 5 * len(list_filter({LINES}, lambda x: starts_with(ltrim(x, ' '), '#'))) + 15 * len(list_filter({LINES}, lambda x: length(x) - length(replace(x, '|', '')) >= 3)) - 5 * {NOISE} END AS INT)"""


@query(f"""SELECT doc_id, {SCORE} AS score,
    CAST(CASE WHEN trim(t, ' ') = '' THEN 0 ELSE 2 * len(list_filter({WORDS}, lambda x: length(x) > 2)) + 5 * len(regexp_extract_all(t, '\\d{{3,}}')) + 8 * len(regexp_extract_all(t, '\\d+[.,]\\d{{2}}')) + {KEYWORDS} + 3 * len(list_filter({LINES}, lambda x: contains(x, ':') AND length(x) > 10)) - 3 * {NOISE} END AS INT) AS balayage,
    round(least(greatest(len({WORDS}) / 300, 0.05), 1.0), 6) AS confiance FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)""")
def recognition_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", texts.recognition_score(t).cast("int").alias("score"), texts.scan_score(t).cast("int").alias("balayage"), F.round(texts.text_confidence(F.size(F.split(t, r"\s+"))), 6).alias("confiance"))


@query(f"""SELECT conv_id, arg_max(turn, (s, -turn)) AS turn FROM (SELECT conv_id, turn, {SCORE} AS s FROM (SELECT conv_id, turn, text AS t FROM conversations WHERE trim(coalesce(text, ''), ' ') <> '')) GROUP BY 1""")
def best_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best of several readings (turns): the highest recognition score, the first on ties."""
    rows = table(spark, sf_dir, "conversations").filter("trim(coalesce(text, '')) <> ''")
    score = texts.recognition_score(F.col("text"))
    return rows.groupBy("conv_id").agg(F.max_by("turn", F.struct(score.alias("s"), (-F.col("turn")).alias("t"))).alias("turn"))


TYPED = [
    ("Fiche CCF-EN-04 #", "CHECKLIST_AUTOCONTROLE"), ("check list des pieces justificatives", "CHECKLIST_PIECES"), ("Ordre de paiement # tableau de controle conforme", "ORDRE_PAIEMENT"), ("Tableau de contrôle : observation", "TABLEAU_CONTROLE"),
    ("Procès-verbal de réception", "PV_RECEPTION"), ("Attestation de régularité fiscale", "ATTESTATION_FISCALE"), ("Appel d'offres #, le titulaire du bon de commande", "MARCHE"), ("Bon de commande # plafond et validité", "BON_COMMANDE_CADRE"),
    ("Contrat d'entretien #", "CONTRAT_CADRE"), ("Contrat et avenant #", "CONTRAT_AVENANT"), ("FACTURE # bon de commande 7 total TTC", "FACTURE"), ("Bon de commande # facture montant" + " x" * 10, "FACTURE"), ("CF SIE 12", "BON_COMMANDE"),
    ("Ouverture de compte", "FORMULAIRE_FOURNISSEUR"), ("x " * 320 + "facture montant", "FACTURE"), ("rien #", "INCONNU"), (None, "INCONNU"),
]


@query(f"SELECT o_orderkey AS k, {_chosen([t for _, t in TYPED])} AS type, CASE WHEN o_orderkey % {len(TYPED)} < 15 THEN {_chosen([t for _, t in TYPED])} WHEN o_orderkey % 3 = 0 THEN 'FACTURE' ELSE 'INCONNU' END AS retenu FROM orders")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, [t for t, _ in TYPED]).withColumn("type", texts.document_type(F.col("t")))
    return rows.select("k", "type", texts.resolved_type(F.col("type"), F.lit("FACTURE"), F.when(F.col("k") % 3 == 0, 0.7).otherwise(0.5)).alias("retenu"))


REPAIRED = [
    ("a\r\nb\r\n\n\n\nc  d", "a\nb\n\nc d"), ("Factura TVA RlB l.C.E #", "Facture T.V.A. RIB I.C.E #"), ("Total : 1 2 3 4 , 5 6 DH", "Total : 1234,5 6 DH"), ("ICE : OO1509176OOO0l8", "ICE : 001509176000018"), ("IF 12l4I6", "IF 121416"),
    ("مـــحمد أب", "مـحمد اب"), ("x\x07y​z  ", "xyz"), ("plain #", "plain #"),
]


@query(f"SELECT o_orderkey AS k, {_put([t for _, t in REPAIRED])} AS texte FROM orders")
def repaired_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, [t for t, _ in REPAIRED])
    return rows.select("k", texts.normalize_text(texts.mend_numbers(F.col("t"))).alias("texte"))


MASKED = [
    ("Mail a.b@c.ma, tel 0612345678 et a.b@c.ma", "Mail [EMAIL_1], tel [PHONE_1] et [EMAIL_1]"), ("M. Karim El-Amrani et Mme Sara Idrissi #", "[PERSON_1] et [PERSON_2] #"), ("+212 6 12 34 56 78 puis 0522-33-44-55", "[PHONE_1] puis [PHONE_2]"),
    ("rien # 12345678901", "rien # 12345678901"), ("x#@y.org M. Alami", "[EMAIL_1] [PERSON_1]"),
]


@query(f"SELECT o_orderkey AS k, {_put([t for _, t in MASKED])} AS masque, true AS retabli FROM orders")
def pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, [t for t, _ in MASKED]).withColumn("p", texts.pseudonymize(F.col("t")))
    return rows.select("k", F.col("p.text").alias("masque"), (texts.restore(F.col("p.text"), F.col("p.mapping")) == F.col("t")).alias("retabli"))


JSON = [('Voici {"a": {"b": "x}"}, "n": #} fin {', '{"a": {"b": "x}"}, "n": #}'), ("aucun #", None), ('{"ouvert": "', None), ('```{"q":"\\"}"}```', '{"q":"\\"}"}'), ("{}", "{}")]


@query(f"SELECT o_orderkey AS k, {_put([t for _, t in JSON])} AS objet FROM orders")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir, [t for t, _ in JSON]).select("k", texts.first_json_object(F.col("t")).alias("objet"))


COLUMNS = [
    ("Titre\nA   B   C\n1   2   3\nfin", "Titre\n| A | B | C |\n| --- | --- | --- |\n| 1 | 2 | 3 |\nfin"), ("une   seule\nligne", "une   seule\nligne"), ("a   b\nc   d   e\nf   g   h   i", "| a | b |  |\n| --- | --- | --- |\n| c | d | e |\nf   g   h   i"), ("#", "#"),
]


@query(f"SELECT o_orderkey AS k, {_put([t for _, t in COLUMNS])} AS texte FROM orders")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(spark, sf_dir, [t for t, _ in COLUMNS]).select("k", texts.columns_to_markdown(F.col("t")).alias("texte"))


# text, general amount, strict, plain, date, corrected date, boolean, without numbers
VALUES = [
    ("1 234,56 DH", 1234.56, 1234.56, None, None, None, None, None), ("1,234", 1.23, 1.23, 1.23, None, None, None, None), ("1.234.567", None, None, None, None, None, None, None), ("1.234,56", 1234.56, 1234.56, None, None, None, None, None),
    ("€ 12", 12.0, None, None, None, None, None, None), ("0", 0.0, 0.0, 0.0, None, None, False, None), ("Oui", None, None, None, None, None, True, True), ("y", None, None, None, None, None, None, True), ("NON conforme", None, None, None, None, None, False, False),
    ("2026-02-03", None, None, None, "2026-02-03", "2026-02-03", None, None), ("3/2/26", None, None, None, "2026-02-03", "2026-02-03", None, None), ("31/02/2026", None, None, None, None, None, None, None), ("2026/02/03", None, None, None, None, "2026-02-03", None, None), ("", None, None, None, None, None, None, None), (None,) * 8,
]


def _column(i: int) -> str:
    return _chosen([v[i] if not isinstance(v[i], bool) else str(v[i]).lower() == "true" for v in VALUES])


@query(f"SELECT o_orderkey AS k, {_column(1)}::DOUBLE AS montant, {_column(2)}::DOUBLE AS strict, {_column(3)}::DOUBLE AS simple, CAST({_column(4)} AS DATE) AS jour, CAST({_column(5)} AS DATE) AS corrige, CAST({_column(6)} AS BOOLEAN) AS oui, CAST({_column(7)} AS BOOLEAN) AS accord FROM orders")
def parsed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, number = F.col("t"), lambda c: c.cast("double")
    amount = F.when(~t.rlike("[-/]") & ~F.lower(t).isin("oui", "y"), scalars.parse_amount(t))
    strict = F.when(~t.rlike("[-/]"), scalars.parse_amount_strict(t))
    return _samples(spark, sf_dir, [v[0] for v in VALUES]).select(
        "k", number(amount).alias("montant"), number(strict).alias("strict"), number(scalars.parse_amount_plain(t)).alias("simple"), scalars.parse_date(t).alias("jour"), scalars.parse_date_correction(t).alias("corrige"), scalars.parse_bool(t).alias("oui"), scalars.parse_bool(t, False).alias("accord"),
    )


# text, RIB, id, ICE, valid ICE, code, reference, label, supplier
NAMES = [
    ("001-509 176.000008", "001509176000008", "1509176000008", "001509176000008", True, "001509176000008", "001509176000008", "001 509 176 000008", "001 509 176000008"), ("Société Été S.A.R.L", "SociétéÉtéSARL", "SociétéÉtéSARL", "SociétéÉtéSARL", False, "sociétéétésarl", "sociétéétésarl", "societe ete s a r l", "societe ete"),
    ("0-0", "00", "0", "00", False, "00", "00", "0 0", "0 0"), (" ", None, None, None, False, "", "", "", ""), ("AO_12/B|7", "AO_12/B|7", "AO_12/B|7", "AO_12/B|7", False, "ao12b7", "ao12b|7", "ao 12 b 7", "ao 12 b 7"), (None, None, None, None, False, None, None, "", ""),
]


def _name(i: int) -> str:
    return _chosen([v[i] for v in NAMES])


@query(f"SELECT o_orderkey AS k, {_name(1)} AS rib, {_name(2)} AS ident, {_name(3)} AS ice, {_chosen([v[4] for v in NAMES])} AS ice_valide, {_name(5)} AS code, {_name(6)} AS reference, {_name(7)} AS libelle, {_name(8)} AS fournisseur FROM orders")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _samples(spark, sf_dir, [v[0] for v in NAMES]).select(
        "k", scalars.compact(t).alias("rib"), scalars.normalize_id(t).alias("ident"), scalars.normalize_ice(t).alias("ice"), scalars.valid_ice(t).alias("ice_valide"), scalars.normalize_code(t).alias("code"), scalars.normalize_reference(t).alias("reference"),
        scalars.normalize_label(t).alias("libelle"), scalars.supplier_key(t).alias("fournisseur"),
    )


# two texts: same reference, label similarity, same person, containment
PAIRS = [
    ("BC-2024/001", "bc2024001", True, 0.0, False, 0.95), ("12", "312", False, 0.0, False, 0.0), ("M. Alami", "Mohamed ALAMI", False, 0.5, True, 0.0), ("Sara Alami", "Mohamed Alami", False, 0.333333, False, 0.0), ("Pompe Immergée", "pompe immergee", False, 1.0, True, 0.0),
    ("FA-7788 #", "7788", True, 0.333333, False, 0.0), ("", "x", False, 0.0, False, 0.0), (None, "x", False, 0.0, False, 0.0),
]


@query(f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % {len(PAIRS)} = 5 THEN true ELSE {_chosen([v[2] for v in PAIRS])} END AS meme, CASE WHEN o_orderkey % {len(PAIRS)} = 5 THEN CASE WHEN o_orderkey < 10 THEN 0.5 ELSE 0.333333 END ELSE {_chosen([v[3] for v in PAIRS])} END::DOUBLE AS proche, {_chosen([v[4] for v in PAIRS])} AS personne FROM orders")
def compared_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir, [v[0] for v in PAIRS]).withColumn("b", F.get(F.array(*[F.lit(v[1]) for v in PAIRS]), (F.col("k") % len(PAIRS)).cast("int")))
    a, b = F.col("t"), F.col("b")
    return rows.select("k", scalars.match_reference(a, b).alias("meme"), F.round(scalars.label_similarity(a, b), 6).alias("proche"), scalars.same_person(a, b).alias("personne"))


# payload, code, risk, number, host
PAYLOADS = [
    ("https://attestation.tax.gov.ma/v?code=18a50bf6baf3", "18a50bf6baf3", "SAFE", None, "attestation.tax.gov.ma"), ("18A50BF6BAF372BD", "18A50BF6BAF372BD", "SAFE", None, None), ("javascript:alert(1)", "javascript:alert(1)", "DANGEROUS", None, None), ("http://tax.gov.ma/?ref=7", "7", "UNSAFE", None, "tax.gov.ma"),
    ("https://u:p@tax.gov.ma/x", "https://u:p@tax.gov.ma/x", "DANGEROUS", None, "tax.gov.ma"), ("n 1234/2026/567 du", "n 1234/2026/567 du", "DANGEROUS", "1234/2026/567", None), ("", None, "ABSENT", None, None), (None, None, "ABSENT", None, None), ("x\ny", "x\ny", "DANGEROUS", None, None),
]


@query(f"SELECT o_orderkey AS k, {_chosen([v[1] for v in PAYLOADS])} AS code, {_chosen([v[2] for v in PAYLOADS])} AS risque, {_chosen([v[3] for v in PAYLOADS])} AS numero, {_chosen([v[4] for v in PAYLOADS])} AS hote FROM orders")
def qr_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _samples(spark, sf_dir, [v[0] for v in PAYLOADS]).select("k", scalars.verification_code(t).alias("code"), scalars.payload_risk(t).alias("risque"), scalars.attestation_number(t).alias("numero"), scalars.url_host(t).alias("hote"))


@query("""SELECT o_orderkey AS k, greatest(12 * (year(e) - year(d)) + month(e) - month(d) - CASE WHEN day(e) < day(d) THEN 1 ELSE 0 END, 1) AS mois, CASE o_orderkey % 5 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 2 END AS periode, o_orderkey % 3 = 0 OR o_orderkey % 4 = 1 AS avoir
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 200 AS INT) + 1 AS e FROM orders)""")
def periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d, none = F.col("o_orderkey"), F.to_date("o_orderdate"), F.lit(None).cast("date")
    named = F.get(F.array(F.lit("T3 2026"), F.lit("s1"), F.lit("mars et avril"), F.lit("février"), F.lit(None)), (k % 5).cast("int"))
    number = F.when(k % 4 == 1, "Note de credit 7").otherwise("AVOIRDUPOIS 8")
    return table(spark, sf_dir, "orders").select(k.alias("k"), scalars.months_covered(d, F.date_add(d, (k % 200).cast("int")), F.lit(None)).alias("mois"), scalars.months_covered(none, none, named).alias("periode"), scalars.is_credit_note(number, F.when(k % 3 == 0, -1).otherwise(1)).alias("avoir"))


# --- extraction quality ------------------------------------------------------------------------------------------
#: Extracted documents: type, JSON, text, and what the checks find: schema violations, valid, ungrounded, missing, coherence.
EXTRACTED = [
    ("FACTURE", '{"numeroFacture":"F-2024-7","dateFacture":"2024-05-06","montantTTC":"1 200,00","montantHT":"1000","montantTVA":"200","tauxTVA":"20","fournisseur":"Alpha","ICE":"001509176000008","rib":"12"}', "Facture F 2024 7 ICE OO15 0917 6000 008", "rib", True, "", "", 1.0),
    ("FACTURE", '{"numeroFacture":"?","dateFacture":"6 mai","montantTTC":"-5","tauxTVA":"19","fournisseur":"Beta","ice":"12"}', "rien", "dateFacture,ice,montantTTC,numeroFacture,tauxTVA", False, "", "", 0.5),
    ("FACTURE", '{"numeroFacture":"ZX-999","montantTTC":"110","montantHT":"90","montantTVA":"10","lignes":[{"montantTotalHT":"60"},{"montantTotalHT":"30"}]}', "autre texte", "", True, "numeroFacture", "dateFacture,fournisseur,ice", 0.772728),
    ("ORDRE_PAIEMENT", '{"numeroOp":"OP-12","montantOperation":"abc","rib":"007123456789012345678901"}', "OP 12 rib 007 123456789012345678901", "montantOperation", False, "", "beneficiaire,dateEmission", 1.0),
    ("PV_RECEPTION", '{"dateReception":"x"}', "", "", True, "", "", 1.0),
]


def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.get(F.array(*[F.lit(v[i]) for v in EXTRACTED]), (F.col("o_orderkey") % len(EXTRACTED)).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"), at(0).alias("type"), at(1).alias("json"), at(2).alias("texte"))
    return rows.withColumn("data", quality.fields(F.col("json")))


def _joined(fields: Column) -> Column:
    return F.array_join(F.array_sort(fields), ",")


@query(f"SELECT o_orderkey AS document_id, {_chosen([v[3] for v in EXTRACTED])} AS violations, {_chosen([v[4] for v in EXTRACTED])} AS valide FROM orders")
def schema_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_schema(_extracted(spark, sf_dir)).select("document_id", _joined(F.col("violations")).alias("violations"), "valide")


@query(f"SELECT o_orderkey AS document_id, {_chosen([v[5] for v in EXTRACTED])} AS absents, o_orderkey % {len(EXTRACTED)} <> 2 AS valide FROM orders")
def ungrounded_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.validate_grounding(_extracted(spark, sf_dir)).select("document_id", _joined(F.col("violations")).alias("absents"), "valide")


@query("SELECT o_orderkey AS document_id, 'ice' AS champ, CASE o_orderkey % 4 WHEN 1 THEN 'retire' ELSE 'doute' END AS issue FROM orders WHERE o_orderkey % 4 IN (1, 2) UNION ALL SELECT o_orderkey, 'rib', 'doute' FROM orders")
def identifier_doubts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("document_id")
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("document_id"))
    first = rows.withColumn("data", F.expr("map('ice', 'O01' || document_id, 'rib', '7')"))
    second = rows.withColumn("data", F.when(key % 4 == 0, F.expr("map('ice', '001' || document_id)")).when(key % 4 == 1, F.expr("map('ice', '9')")).when(key % 4 == 2, F.expr("map('x', 'y')")).otherwise(F.expr("map('ice', 'aucun')")))
    return quality.compare_passes(first, second, ["ice", "rib"])


@query(f"SELECT o_orderkey AS document_id, {_chosen([1.0, 0.5, 0.772728, 1.0, 1.0])}::DOUBLE AS coherence, {_chosen([0, 0, 3, 2, 2])} AS manquants FROM orders")
def quality_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(_extracted(spark, sf_dir).withColumn("ocr_confidence", F.lit(90.0)).withColumn("extraction_confidence", F.lit(0.95)))
    return scored.select("document_id", F.round("coherence", 6).alias("coherence"), F.size("manquants").alias("manquants"))


#: Scores of the five documents with OCR at 90 and extraction at 0.95, worked out by hand.
SCORES = [91, 68, 62, 67, 62]


@query(f"SELECT o_orderkey AS document_id, {_chosen(SCORES)} AS score, CASE WHEN o_orderkey % 9 = 0 OR o_orderkey % 8 = 0 THEN 'REVUE_HUMAINE_REQUISE' WHEN {_chosen(SCORES)} < 70 THEN 'RELANCE' ELSE 'EXTRAIT' END AS suite FROM orders")
def review_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality(_extracted(spark, sf_dir).withColumn("ocr_confidence", F.lit(90.0)).withColumn("extraction_confidence", F.lit(0.95)))
    gated = quality.review(scored.withColumn("tronque", F.col("document_id") % 9 == 0).withColumn("valide", F.col("document_id") % 8 != 0))
    return gated.select("document_id", "score", "suite")


ANSWERS = ['{"verdicts":[{"code":"CUSTOM-01","statut":"non_conforme","detail":"d"}]}', '{"verdicts":[{"code":"CUSTOM-01","needsMoreInfo":true}]}', '{"verdicts":[{"code":"CUSTOM-02","statut":"CONFORME"}]}', "pas du JSON", '{"verdicts":[{"code":"CUSTOM-01","statut":"bizarre"}]}']


@query("""SELECT o_orderkey AS dossier_id, 'CUSTOM-01' AS regle, CASE WHEN o_orderkey % 6 = 0 OR o_orderkey % 5 = 1 THEN 'NON_APPLICABLE' ELSE 'AVERTISSEMENT' END AS statut FROM orders
    UNION ALL SELECT o_orderkey, 'CUSTOM-02', CASE WHEN o_orderkey % 5 = 2 THEN 'CONFORME' ELSE 'AVERTISSEMENT' END FROM orders""")
def custom_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dossier_id"))
    rules = files.select("dossier_id", F.lit("CUSTOM-01").alias("code"), F.lit("AVERTISSEMENT").alias("severity"), (F.col("dossier_id") % 6 != 0).alias("applique")).unionAll(files.select("dossier_id", F.lit("CUSTOM-02"), F.lit("NON_CONFORME"), F.lit(True)))
    answers = files.select("dossier_id", F.get(F.array(*map(F.lit, ANSWERS)), (F.col("dossier_id") % 5).cast("int")).alias("reponse"))
    return quality.custom_verdicts(rules, answers).select("dossier_id", "regle", "statut")


@query(f"""SELECT o_orderkey AS document_id, {_chosen(["F-2024-7", "?", "ZX-999", None, None])} AS numero, {_chosen(["Alpha", "Beta", None, None, None])} AS fournisseur, {_chosen(["001509176000008", "12", None, None, None])} AS ice, CAST({_chosen(["2024-05-06", None, None, None, None])} AS DATE) AS jour,
    {_chosen([1000.0, None, 90.0, None, None])}::DOUBLE AS ht, {_chosen([200.0, None, 10.0, None, None])}::DOUBLE AS tva, {_chosen([1200.0, -5.0, 110.0, None, None])}::DOUBLE AS ttc FROM orders WHERE o_orderkey % 5 < 3""")
def typed_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed.invoices(_extracted(spark, sf_dir))
    return rows.select("document_id", "numero", "fournisseur", "ice", "jour", *[F.col(c).cast("double").alias(c) for c in ("ht", "tva", "ttc")])


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT DISTINCT t FROM d WHERE doc_id % 3 = 0)
    SELECT doc_id, t IN (SELECT t FROM c) AS en_cache FROM d""")
def cached_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose content another pass has recognised already."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("texte")).withColumn("sha256", F.sha2("texte", 256))
    cache = typed.cache_rows(docs.filter("doc_id % 3 = 0"), 2).unionByName(typed.cache_rows(docs.filter("doc_id % 3 = 1"), 1))
    return typed.with_cached_text(docs.select("doc_id", "sha256"), cache, 2).select("doc_id", "en_cache")
