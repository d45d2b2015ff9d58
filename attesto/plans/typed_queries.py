"""Typed rows and engagements from JSON documents that are derived from the orders, with SQL that reads the same JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.operators import client, typed
from attesto.plans.registry import query
from attesto.sources.tables import table

_T, _D = "CAST(ttc AS STRING)", "CAST(d AS STRING)"
_FR = f"substr({_D}, 9, 2) || '/' || substr({_D}, 6, 2) || '/' || substr({_D}, 1, 4)"
_ORDERS = "(SELECT o_orderkey AS k, o_custkey AS cust, CAST(o_totalprice AS DECIMAL(18,2)) AS ttc, CAST(o_orderdate AS DATE) AS d FROM orders)"

def _json(**fields: str) -> str:
    """A JSON object from fields whose values are SQL expressions of JSON text."""
    return "'{' || " + " || ',' || ".join(f"'\"{n}\":' || {v}" for n, v in fields.items()) + " || '}'"

def _quoted(sql: str) -> str:
    return f"'\"' || {sql} || '\"'"

#: Documents by type: (number, condition, JSON). Numbers, strings, nulls, wrong types, nested objects, empty lists, text that is cut, and second versions.
DOCUMENTS = {
    "FACTURE": [
        (0, "true", f"CASE WHEN k % 11 = 0 THEN '{{\"numeroFacture\":\"F' ELSE " + _json(
            numeroFacture=_quoted("'F-' || CAST(k AS STRING)"), dateFacture=f"CASE k % 3 WHEN 0 THEN {_quoted(_FR)} WHEN 1 THEN {_quoted(_D)} ELSE '\"hier\"' END",
            fournisseur=f"CASE k % 7 WHEN 0 THEN 'null' WHEN 1 THEN '12' ELSE {_quoted("'Client ' || CAST(cust AS STRING)")} END", devise="'\" mad \"'",
            montantTTC=f"CASE k % 4 WHEN 0 THEN {_quoted(f"{_T} || ' MAD'")} WHEN 1 THEN {_T} WHEN 2 THEN {_quoted(f"replace({_T}, '.', ',')")} ELSE '\"env. 12 €\"' END",
            lignes=f"CASE k % 5 WHEN 0 THEN '\"aucune\"' WHEN 1 THEN '[]' ELSE '[{{\"designation\":\" Pompe \",\"quantite\":' || CAST(k % 9 AS STRING) || ',\"prixUnitaireHt\":\"' || CAST(k % 100 AS STRING) || ',5\"}},{{\"designation\":\" \"}},{{\"designation\":\"Vanne\",\"montantLigneHT\":' || {_T} || '}}]' END",
        ) + " END"),
        (1, "k % 2 = 0", _json(numeroFacture=_quoted("'G-' || CAST(k AS STRING)"), montantTTC="'{\"valeur\":3}'", lignes="'null'")),
    ],
    "BON_COMMANDE": [
        (2, "k % 3 < 2", _json(reference=_quoted("'BC-' || CAST(k AS STRING)"), montantTTC=_T, dateBc=_quoted(_D))), (3, "k % 5 = 0", _json(reference=_quoted("'BC2-' || CAST(k AS STRING)"), montantTTC="'true'")),
    ],
    "CONTRAT_AVENANT": [
        (4, "k % 3 = 2", _json(referenceContrat=_quoted("'CT-' || CAST(cust AS STRING)"), parties="'[\"Alpha\",7,null]'", grillesTarifaires="'[{\"designation\":\"a\",\"prixUnitaireHT\":10,\"periodicite\":\"ANNUEL\"},{\"prixUnitaireHT\":\"2,5\",\"periodicite\":\"parfois\"}]'")),
    ],
    "ORDRE_PAIEMENT": [
        (5, "k % 4 > 0", _json(numeroOp=_quoted("'OP' || CAST(k AS STRING)"), montantOperation=_T, modePaiement="'\" especes \"'", retenues=f"'[{{\"type\":\"GARANTIE\",\"base\":' || {_T} || ',\"taux\":10,\"montant\":\"1 000,50 DH\"}},{{\"type\":\"inconnue\",\"montant\":3}}]'")),
        (6, "k % 3 = 0", _json(numeroOp=_quoted("'OP' || CAST(k AS STRING) || 'bis'"), montantOperation=_quoted("'12'"))),
    ],
    "CHECKLIST_AUTOCONTROLE": [(7, "k % 6 > 0", _json(points="'[{\"numero\":1,\"estValide\":\"Oui\"},{\"numero\":2,\"estValide\":false},{\"estValide\":\"peut-etre\"},{\"numero\":\"4\",\"estValide\":1}]'"))],
    "PV_RECEPTION": [(8, "k % 2 = 1", _json(dateReception=_quoted(_FR), prestations="'[\"a\",\"b\"]'"))],
    "ATTESTATION_FISCALE": [(9, "k % 3 > 0", _json(numero=_quoted("CAST(k AS STRING)"), estEnRegle="CASE k % 3 WHEN 1 THEN 'true' ELSE '\"true\"' END", typeAttestation="'\" definitive \"'", dateEdition="'\"31/02/2024\"'"))],
}
PIECES = " UNION ALL ".join(f"SELECT k * 16 + {n} AS document_id, k AS dossier_id, '{kind}' AS type, {n} AS upload, {data} AS data FROM {_ORDERS} WHERE {when}" for kind, docs in DOCUMENTS.items() for n, when, data in docs)

def _text(path: str, j: str = "j") -> str:
    return f"CASE WHEN json_type({j}, '{path}') = 'VARCHAR' THEN json_extract_string({j}, '{path}') END"

def _amount(path: str, j: str = "j") -> str:
    bare = f"regexp_replace(json_extract_string({j}, '{path}'), '[\\sA-Za-z'']', '', 'g')"
    return f"CASE WHEN json_type({j}, '{path}') IN ('BIGINT', 'UBIGINT', 'DOUBLE') THEN CAST(json_extract_string({j}, '{path}') AS DECIMAL(18,2)) WHEN json_type({j}, '{path}') = 'VARCHAR' AND regexp_full_match({bare}, '-?[0-9.,]+') THEN TRY_CAST(replace({bare}, ',', '.') AS DECIMAL(18,2)) END"

def _day(path: str) -> str:
    t = f"trim({_text(path)})"
    return f"coalesce(CASE WHEN regexp_full_match({t}, '\\d{{4}}-\\d\\d-\\d\\d') THEN TRY_CAST({t} AS DATE) END, TRY_CAST(try_strptime({t}, '%d/%m/%Y') AS DATE))"

_DOCS = f"WITH docs AS (SELECT *, TRY_CAST(data AS JSON) AS j FROM ({PIECES}))"

def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over the orders of a folder; its own braces are text."""
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace("FROM orders", "FROM {orders}"), orders=table(spark, sf_dir, "orders"))


def _pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, PIECES)

@query(f"""{_DOCS}, l AS (SELECT document_id, unnest(CASE WHEN json_type(j, '$.lignes') = 'ARRAY' THEN CAST(j->'$.lignes' AS JSON[]) END) AS r FROM docs WHERE type = 'FACTURE'),
    s AS (SELECT document_id, count(*) AS n, sum({_amount('$.prixUnitaireHt', 'r')})::DOUBLE AS pu, sum({_amount('$.montantLigneHT', 'r')})::DOUBLE AS total, sum({_amount('$.quantite', 'r')})::DOUBLE AS quantite FROM l WHERE trim({_text('$.designation', 'r')}) <> '' GROUP BY 1)
    SELECT d.document_id, dossier_id, {_text('$.numeroFacture')} AS numero, {_day('$.dateFacture')} AS jour, {_text('$.fournisseur')} AS fournisseur, upper(trim({_text('$.devise')})) AS devise, ({_amount('$.montantTTC')})::DOUBLE AS ttc,
           coalesce(n, 0) AS lignes, pu, total, quantite FROM docs d LEFT JOIN s USING (document_id) WHERE type = 'FACTURE' AND json_type(j) = 'OBJECT'""")
def typed_invoice_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed.dossier_rows(_pieces(spark, sf_dir)).select("dossier_id", F.inline("factures"))
    total = lambda f, name: F.aggregate(F.filter(F.transform("lignes", lambda x: x[f].cast("double")), lambda v: v.isNotNull()), F.lit(None).cast("double"), lambda a, v: F.coalesce(a, F.lit(0.0)) + v).alias(name)
    return rows.select(
        "document_id", "dossier_id", F.col("numero_facture").alias("numero"), F.col("date_facture").alias("jour"), "fournisseur", "devise", F.col("montant_ttc").cast("double").alias("ttc"), F.greatest(F.coalesce(F.size("lignes"), F.lit(0)), F.lit(0)).alias("lignes"),
        total("prix_unitaire_ht", "pu"), total("montant_total_ht", "total"), total("quantite", "quantite"),
    )

@query(f"""{_DOCS}, t AS (SELECT dossier_id, list_sort(list(DISTINCT type)) AS types, min(document_id) FILTER (type = 'ORDRE_PAIEMENT') AS op_document, arg_max({_text('$.numeroOp')}, upload) FILTER (type = 'ORDRE_PAIEMENT') AS op_numero,
        arg_max(struct_pack(v := ({_amount('$.montantOperation')})::DOUBLE), upload) FILTER (type = 'ORDRE_PAIEMENT') AS op_montant, arg_max(struct_pack(v := upper(trim({_text('$.modePaiement')}))), upload) FILTER (type = 'ORDRE_PAIEMENT') AS op_mode,
        arg_max({_text('$.reference')}, upload) FILTER (type = 'BON_COMMANDE') AS bc_reference, arg_max(struct_pack(v := ({_amount('$.montantTTC')})::DOUBLE), upload) FILTER (type = 'BON_COMMANDE') AS bc_ttc, arg_max(struct_pack(v := {_day('$.dateBc')}), upload) FILTER (type = 'BON_COMMANDE') AS bc_date,
        bool_or(type = 'CONTRAT_AVENANT') AS contrat, max({_day('$.dateReception')}) FILTER (type = 'PV_RECEPTION') AS pv_date, bool_or(json_type(j, '$.estEnRegle') = 'BOOLEAN') FILTER (type = 'ATTESTATION_FISCALE') AS en_regle,
        bool_or(type = 'ATTESTATION_FISCALE') AS arf, bool_or(type = 'CHECKLIST_AUTOCONTROLE') AS ck, bool_or(type = 'ORDRE_PAIEMENT' AND json_type(j, '$.retenues') = 'ARRAY') AS retenu, bool_or(type = 'PV_RECEPTION') AS pv FROM docs GROUP BY 1)
    SELECT dossier_id, array_to_string(types, ',') AS types, op_document, op_numero, op_montant.v AS op_montant, op_mode.v AS op_mode, CASE WHEN op_document IS NOT NULL THEN CASE WHEN retenu THEN 'GARANTIE:1000.50,AUTRE:3.00' ELSE '' END END AS retenues, bc_reference, bc_ttc.v AS bc_ttc, bc_date.v AS bc_date,
           CASE WHEN contrat THEN 'Alpha,7,null' END AS parties, CASE WHEN contrat THEN 'ANNUEL:10.00,MENSUEL:2.50' END AS grille, pv_date, CASE WHEN pv THEN 'a,b' END AS prestations, CASE WHEN en_regle THEN true END AS en_regle, CASE WHEN arf THEN DATE '2024-02-29' END AS edition,
           CASE WHEN ck THEN '1:true,2:false,0:?,0:true' END AS points FROM t""")
def typed_dossier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed.dossier_rows(_pieces(spark, sf_dir))
    shown = lambda array, a, b: F.array_join(F.transform(array, lambda x: F.concat(x[a].cast("string"), F.lit(":"), F.coalesce(x[b].cast("string"), F.lit("?")))), ",")
    op, bc, ct, arf = (F.col(c) for c in ("ordre_paiement", "bon_commande", "contrat_avenant", "attestation_fiscale"))
    return rows.select(
        "dossier_id", F.array_join("types", ",").alias("types"), op["document_id"].alias("op_document"), op["numero_op"].alias("op_numero"), op["montant_operation"].cast("double").alias("op_montant"), op["mode_paiement"].alias("op_mode"),
        shown(op["retenues"], "type", "montant").alias("retenues"), bc["reference"].alias("bc_reference"), bc["montant_ttc"].cast("double").alias("bc_ttc"), bc["date_bc"].alias("bc_date"), ct["parties"].alias("parties"),
        shown(ct["grilles_tarifaires"], "periodicite", "prix_unitaire_ht").alias("grille"), F.col("pv_reception")["date_reception"].alias("pv_date"), F.col("pv_reception")["prestations"].alias("prestations"), arf["est_en_regle"].alias("en_regle"), arf["date_edition"].alias("edition"),
        shown(F.col("checklist_autocontrole")["points"], "numero", "est_valide").alias("points"),
    )

#: Contract documents: three types under shared references, fields that come and go.
ENGAGED = f"""SELECT k AS document_id, k AS upload, CASE k % 4 WHEN 0 THEN 'MARCHE' WHEN 1 THEN 'BON_COMMANDE_CADRE' WHEN 2 THEN 'CONTRAT_CADRE' ELSE 'FACTURE' END AS type,
    CASE WHEN k % 13 = 0 THEN '{{"reference":' ELSE {_json(reference=f"CASE WHEN k % 9 = 0 THEN '\" \"' ELSE {_quoted("' ENG-' || CAST(cust % 300 AS STRING) || ' '")} END", objet=f"CASE k % 3 WHEN 0 THEN '\" \"' ELSE {_quoted("'objet ' || CAST(k AS STRING)")} END",
        montantTtc=f"CASE k % 5 WHEN 0 THEN 'null' WHEN 1 THEN {_quoted(f"replace({_T}, '.', ',')")} ELSE {_T} END", delaiExecutionMois="CASE k % 6 WHEN 0 THEN '\"12\"' ELSE CAST(k % 24 AS STRING) END", dateFin=f"CASE k % 2 WHEN 0 THEN {_quoted(_D)} ELSE {_quoted(_FR)} END",
        periodicite="CASE k % 7 WHEN 0 THEN '\"jamais\"' ELSE '\"mensuel\"' END", revisionPrixAutorisee="CASE k % 8 WHEN 0 THEN 'true' WHEN 4 THEN 'false' ELSE '1' END", plafondMontant=_quoted("'1 ' || CAST(100 + k % 900 AS STRING)"))} END AS data FROM {_ORDERS}"""

def _latest(value: str, kind: str | None = None) -> str:
    last = f"arg_max({value}, upload) FILTER (({value}) IS NOT NULL)"
    return last if kind is None else f"CASE WHEN arg_min(type, upload) = '{kind}' THEN {last} END"

_PLAIN = "CASE WHEN json_type(j, '{0}') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'VARCHAR') THEN TRY_CAST(replace(replace(json_extract_string(j, '{0}'), ' ', ''), ',', '.') AS DECIMAL(18,4)) END"

@query(f"""WITH docs AS (SELECT *, TRY_CAST(data AS JSON) AS j FROM ({ENGAGED})), e AS (SELECT *, trim({_text('$.reference')}) AS reference FROM docs WHERE type <> 'FACTURE')
    SELECT reference, arg_min(type, upload) AS type, max(upload) AS modifie, {_latest(f"CASE WHEN trim({_text('$.objet')}) <> '' THEN {_text('$.objet')} END")} AS objet, ({_latest(_PLAIN.format('$.montantTtc'))})::DOUBLE AS montant,
           {_latest("CASE WHEN json_type(j, '$.delaiExecutionMois') IN ('BIGINT', 'UBIGINT') THEN CAST(j->>'$.delaiExecutionMois' AS INT) END", 'MARCHE')} AS delai,
           {_latest(f"CASE WHEN regexp_full_match({_text('$.dateFin')}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST({_text('$.dateFin')} AS DATE) END", 'CONTRAT_CADRE')} AS fin,
           {_latest(f"CASE WHEN upper({_text('$.periodicite')}) IN ('MENSUEL', 'TRIMESTRIEL', 'SEMESTRIEL', 'ANNUEL') THEN upper({_text('$.periodicite')}) END", 'CONTRAT_CADRE')} AS periodicite,
           {_latest("CASE WHEN json_type(j, '$.revisionPrixAutorisee') = 'BOOLEAN' THEN CAST(j->>'$.revisionPrixAutorisee' AS BOOLEAN) END", 'MARCHE')} AS revision, ({_latest(_PLAIN.format('$.plafondMontant'), 'BON_COMMANDE_CADRE')})::DOUBLE AS plafond
    FROM e WHERE reference <> '' GROUP BY 1""")
def typed_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = typed.engagement_rows(_run(spark, sf_dir, ENGAGED))
    money = lambda c, name: F.col(c).cast("double").alias(name)
    return rows.select(
        "reference", "type", "modifie", "objet", money("montant_ttc", "montant"), F.col("delai_execution_mois").alias("delai"), F.col("date_fin").alias("fin"), "periodicite", F.col("revision_prix_autorisee").alias("revision"), money("plafond_montant", "plafond")
    )


@query(f"""WITH d AS (SELECT k AS dossier_id, k % 6 > 0 AS propre FROM {_ORDERS})
    SELECT dossier_id, i AS rang, CASE WHEN propre THEN ['Point 1', 'Point 2', 'Point 0', 'Point 0'][i] ELSE {list(client.DEFAULT_POINTS)}[i] END AS description, CASE WHEN propre THEN ['Conforme', 'Non conforme', 'NA', 'Conforme'][i] ELSE 'NA' END AS observation
    FROM d, unnest(range(1, CASE WHEN propre THEN 5 ELSE 11 END)) AS r(i)""".replace('"Respect du delai d\'execution des prestations"', "'Respect du delai d''execution des prestations'"))
def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.control_points(typed.dossier_rows(_pieces(spark, sf_dir))).select("dossier_id", "rang", "description", "observation")
