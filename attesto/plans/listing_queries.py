"""The listings over the stand-in relations, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.operators import custom, listing, search
from attesto.plans.files import buckets
from attesto.plans.registry import query
from attesto.plans.standins import over, view
from attesto.sources.buckets import Buckets
from attesto.sources.scratch import shared_folder
from attesto.sources.tables import table

_COUNTS = """(SELECT d.*, coalesce(nb_documents, 0) AS nb_documents, coalesce(nb_conformes, 0) AS nb_conformes, coalesce(nb_verdicts, 0) AS nb_verdicts FROM dossiers_ d
    LEFT JOIN (SELECT dossier_id, count(DISTINCT document_id) AS nb_documents FROM documents_ GROUP BY 1) USING (dossier_id)
    LEFT JOIN (SELECT dossier_id, count(*) FILTER (statut = 'CONFORME') AS nb_conformes, count(*) AS nb_verdicts FROM verdicts_ GROUP BY 1) USING (dossier_id))"""


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.with_counts(view(spark, sf_dir, "dossiers"), view(spark, sf_dir, "documents"), view(spark, sf_dir, "verdicts"))


@query(over(f"SELECT dossier_id, reference, nb_documents, nb_conformes, nb_verdicts FROM {_COUNTS}", "dossiers", "documents", "verdicts"))
def dossier_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counted(spark, sf_dir).select("dossier_id", "reference", "nb_documents", "nb_conformes", "nb_verdicts")


@query(over(f"SELECT dossier_id, reference, ttc::DOUBLE AS ttc, nb_documents, nb_verdicts FROM {_COUNTS} ORDER BY date_creation DESC, dossier_id DESC LIMIT 20 OFFSET 20", "dossiers", "documents", "verdicts"))
def dossier_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.newest(_counted(spark, sf_dir), "date_creation", "dossier_id", 1).select("dossier_id", "reference", F.col("ttc").cast("double").alias("ttc"), "nb_documents", "nb_verdicts")


@query(over(f"SELECT dossier_id, nb_documents, nb_conformes FROM {_COUNTS} WHERE statut = 'VALIDE' AND type = 'BC' AND lower(fournisseur) LIKE '%customer#0000000_1%'", "dossiers", "documents", "verdicts"))
def dossier_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.search(_counted(spark, sf_dir), statut="VALIDE", type_="BC", fournisseur="Customer#0000000_1").select("dossier_id", "nb_documents", "nb_conformes")


@query(over("SELECT fournisseur, count(*) AS nb, count(*) FILTER (statut = 'BROUILLON') AS brouillons, count(*) FILTER (statut = 'EN_VERIFICATION') AS en_cours, count(*) FILTER (statut = 'VALIDE') AS valides, count(*) FILTER (statut = 'REJETE') AS rejetes, sum(ttc)::DOUBLE AS total, sum(ht)::DOUBLE AS total_ht, sum(ttc - ht)::DOUBLE AS total_tva, coalesce(sum(ttc) FILTER (statut = 'VALIDE'), 0)::DOUBLE AS total_valide, max(date_creation) AS dernier, min(date_creation) AS premier FROM dossiers_ WHERE trim(fournisseur) <> '' GROUP BY 1", "dossiers"))
def suppliers_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.by_supplier(view(spark, sf_dir, "dossiers"))


@query(over("SELECT count(*) AS fournisseurs, count(*) FILTER (a > 0) AS actifs, sum(t)::DOUBLE AS montant FROM (SELECT count(*) FILTER (statut IN ('BROUILLON', 'EN_VERIFICATION')) AS a, sum(ttc) AS t FROM dossiers_ WHERE trim(fournisseur) <> '' GROUP BY fournisseur)", "dossiers"))
def supplier_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.supplier_totals(view(spark, sf_dir, "dossiers"))


@query(over("SELECT dossier_id, reference FROM dossiers_ WHERE lower(fournisseur) = 'customer#000000001'", "dossiers"))
def supplier_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.of_supplier(view(spark, sf_dir, "dossiers"), "Customer#000000001").select("dossier_id", "reference")


@query(over("SELECT lower(fournisseur) AS cle, arg_max(reference, dossier_id) AS reference, arg_max(ttc, dossier_id)::DOUBLE AS ttc FROM dossiers_ WHERE trim(fournisseur) <> '' GROUP BY 1", "dossiers"))
def latest_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.identities(view(spark, sf_dir, "dossiers"), "fournisseur", "dossier_id", ["reference", "ttc"]).withColumn("ttc", F.col("ttc").cast("double"))


@query(over("SELECT dossier_id, i.reference AS derniere FROM dossiers_ LEFT JOIN (SELECT lower(fournisseur) AS cle, arg_max(reference, dossier_id) AS reference FROM dossiers_ WHERE trim(fournisseur) <> '' GROUP BY 1) i ON cle = lower(fournisseur)", "dossiers"))
def dossier_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    dossiers = view(spark, sf_dir, "dossiers")
    known = listing.identities(dossiers, "fournisseur", "dossier_id", ["reference"]).withColumnRenamed("reference", "derniere")
    return listing.supplier_identity(dossiers.select("dossier_id", "fournisseur"), known).select("dossier_id", "derniere")


@query(over("SELECT type, count(*) AS nb, count(DISTINCT empreinte) AS empreintes, count(DISTINCT dossier_id) AS dossiers FROM documents_ GROUP BY 1", "documents"))
def documents_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines are dealt by file into as many partitions as the files need, so that a task's share does not grow with the tables."""
    return listing.counts_by_type(view(spark, sf_dir, "documents", "l_orderkey", buckets(spark, sf_dir)))


@query(over("SELECT dossier_id, statut, count(*) AS nb FROM verdicts_ WHERE NOT starts_with(regle, 'CUSTOM-') GROUP BY ALL", "verdicts"))
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.status_counts(listing.without_custom(view(spark, sf_dir, "verdicts")))


@query(over("""SELECT dossier_id, array_to_string(CASE WHEN requis IS NULL THEN CASE WHEN type = 'BC' THEN ['FACTURE', 'BON_COMMANDE', 'ORDRE_PAIEMENT'] ELSE ['FACTURE', 'CONTRAT_AVENANT', 'ORDRE_PAIEMENT', 'PV_RECEPTION'] END
    ELSE ['FACTURE', 'PV_RECEPTION'] END, '|') AS requis FROM dossiers_""", "dossiers"))
def required_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.required(view(spark, sf_dir, "dossiers")).select("dossier_id", F.array_join("requis", "|").alias("requis"))


@query(over("""SELECT dossier_id, champ, max(v) FILTER (s = 'FACTURE') AS facture, max(v) FILTER (s = 'ORDRE_PAIEMENT') AS ordre_paiement, max(v) FILTER (s = 'BON_COMMANDE') AS bon_commande, count(DISTINCT lower(trim(v))) > 1 AS conflit
    FROM (SELECT dossier_id, type AS s, 'montant' AS champ, CAST(montant AS VARCHAR) AS v FROM documents_ UNION ALL SELECT dossier_id, type, 'emetteur', CAST(emetteur % 3 AS VARCHAR) FROM documents_) GROUP BY ALL""", "documents"))
def compared_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = view(spark, sf_dir, "documents").withColumn("emetteur", F.col("emetteur") % 3)
    long = docs.select("dossier_id", F.col("type").alias("source"), F.expr("stack(2, 'montant', CAST(montant AS STRING), 'emetteur', CAST(emetteur AS STRING)) AS (champ, valeur)"))
    return listing.compare_fields(long, ["FACTURE", "ORDRE_PAIEMENT", "BON_COMMANDE"])


@query(over("SELECT count(*) FILTER (c) AS conflits, count(*) AS champs FROM (SELECT count(DISTINCT emetteur % 3) > 1 AS c FROM documents_ GROUP BY dossier_id)", "documents"))
def conflict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = compared_fields(spark, sf_dir).filter("champ = 'emetteur'")
    return fields.agg(F.count_if("conflit").alias("conflits"), F.count(F.lit(1)).alias("champs"))


@query(over("SELECT dossier_id, arg_min(document_id, (upload, document_id)) FILTER (type = 'FACTURE') AS facture, arg_min(document_id, (upload, document_id)) FILTER (type = 'ORDRE_PAIEMENT') AS ordre FROM documents_ GROUP BY 1", "documents"))
def first_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.first_by_type(view(spark, sf_dir, "documents")).select("dossier_id", F.try_element_at("premiers", F.lit("FACTURE")).alias("facture"), F.try_element_at("premiers", F.lit("ORDRE_PAIEMENT")).alias("ordre"))


@query(over("SELECT regle, count(*) AS nb, round(avg(duree), 6) AS moyenne, max(duree) AS maximum, min(duree) AS minimum FROM verdicts_ WHERE duree IS NOT NULL GROUP BY 1", "verdicts"))
def rule_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.rule_durations(view(spark, sf_dir, "verdicts"))


_CORRECTIONS = """(SELECT regle, count(*) AS total, count(*) FILTER (c) AS corriges, count(*) FILTER (c AND statut_original = 'NON_CONFORME' AND statut = 'CONFORME') AS faux_positifs, count(*) FILTER (c AND statut_original = 'CONFORME' AND statut = 'NON_CONFORME') AS faux_negatifs
    FROM (SELECT *, statut_original IS NOT NULL AND statut_original <> statut AS c FROM verdicts_ WHERE execution >= DATE '1998-01-01') GROUP BY 1)"""


@query(over(f"SELECT *, round(corriges::DOUBLE / total, 6) AS taux FROM {_CORRECTIONS} WHERE corriges > 0", "verdicts"))
def corrections_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.rule_corrections(view(spark, sf_dir, "verdicts"), "1998-01-01")


@query(over(f"SELECT CAST(sum(corriges) AS BIGINT) AS corriges, CAST(sum(faux_positifs) AS BIGINT) AS faux_positifs, CAST(sum(faux_negatifs) AS BIGINT) AS faux_negatifs FROM {_CORRECTIONS}", "verdicts"))
def correction_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.correction_totals(listing.rule_corrections(view(spark, sf_dir, "verdicts"), "1998-01-01"))


@query(over("SELECT dossier_id, CASE WHEN ko > 0 THEN 'rouge' WHEN ok < n THEN 'orange' ELSE 'vert' END AS feu, CAST(round(ok * 100 / n) AS INT) AS pourcent FROM (SELECT dossier_id, count(*) FILTER (statut = 'NON_CONFORME') AS ko, count(*) FILTER (statut = 'CONFORME') AS ok, count(*) AS n FROM verdicts_ GROUP BY 1)", "verdicts"))
def traffic_lights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.traffic_light(view(spark, sf_dir, "verdicts"))


@query(over("SELECT dossier_id, e IS NOT NULL AS charge, coalesce(e, false) AS extrait, v.dossier_id IS NOT NULL AS verifie, statut = 'VALIDE' AS valide FROM dossiers_ d LEFT JOIN (SELECT dossier_id, bool_and(extrait) AS e FROM documents_ GROUP BY 1) USING (dossier_id) LEFT JOIN (SELECT DISTINCT dossier_id FROM verdicts_) v USING (dossier_id)".replace("SELECT dossier_id, e", "SELECT d.dossier_id, e"), "dossiers", "documents", "verdicts"))
def workflow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.workflow(view(spark, sf_dir, "dossiers"), view(spark, sf_dir, "documents"), view(spark, sf_dir, "verdicts"))


@query(over("SELECT CAST(round(count(*) FILTER (statut = 'VALIDE') * 100 / count(*)) AS INT) AS valides, CAST(round(count(*) FILTER (statut = 'REJETE') * 100 / count(*)) AS INT) AS rejetes FROM dossiers_", "dossiers"))
def dossier_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.rates(view(spark, sf_dir, "dossiers"))


@query(over("SELECT type, statut, count(*) AS nb, sum(plafond)::DOUBLE AS plafond FROM engagements_ GROUP BY ROLLUP (type, statut)", "engagements"))
def engagement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.engagement_stats(view(spark, sf_dir, "engagements"))


@query(over("SELECT engagement_id, coalesce(n, 0) AS nb, coalesce(s, 0)::DOUBLE AS consomme, CASE WHEN plafond > 0 THEN CAST(CAST(coalesce(s, 0)::DOUBLE / plafond::DOUBLE AS DECIMAL(18,4)) * 100 AS DOUBLE) END AS taux FROM engagements_ LEFT JOIN (SELECT engagement_id, count(*) AS n, sum(ttc) AS s FROM dossiers_ WHERE engagement_id IS NOT NULL GROUP BY 1) USING (engagement_id)", "engagements", "dossiers"))
def engagement_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.engagement_rows(view(spark, sf_dir, "engagements"), view(spark, sf_dir, "dossiers")).select("engagement_id", "nb", F.col("consomme").cast("double").alias("consomme"), "taux")


@query(over("SELECT engagement_id, reference FROM engagements_ WHERE statut = 'ACTIF' AND lower(fournisseur) LIKE '%customer%' AND lower(reference) LIKE '%eng-0000%'", "engagements"))
def engagement_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.search(view(spark, sf_dir, "engagements"), statut="ACTIF", fournisseur="customer", reference="eng-0000").select("engagement_id", "reference")


@query(over("SELECT e.engagement_id, d.dossier_id FROM engagements_ e JOIN dossiers_ d ON d.engagement_id = e.engagement_id WHERE numero_ao IS NOT NULL", "engagements", "dossiers"))
def engagement_dossiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, "engagements").filter("numero_ao is not null")
    return found.select("engagement_id").join(view(spark, sf_dir, "dossiers"), "engagement_id").select("engagement_id", "dossier_id")


@query(over("SELECT engagement_id, type, coalesce(numero_ao, periodicite, CAST(seuil AS VARCHAR)) AS propre FROM engagements_", "engagements"))
def engagement_subtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = view(spark, sf_dir, "engagements")
    own = lambda kind, field: all_.filter(F.col("type") == kind).select("engagement_id", F.col(field).cast("string").alias(field))
    joined = all_.select("engagement_id", "type")
    for kind, field in (("MARCHE", "numero_ao"), ("CONTRAT", "periodicite"), ("BON_COMMANDE", "seuil")):
        joined = joined.join(own(kind, field), "engagement_id", "left")
    return joined.select("engagement_id", "type", F.coalesce("numero_ao", "periodicite", "seuil").alias("propre"))


@query(over("""SELECT dossier_id, min(engagement_id) AS engagement_id FROM (SELECT d.dossier_id, e.engagement_id FROM dossiers_ d JOIN engagements_ e ON e.reference IN ('ENG-' || lpad(CAST(d.dossier_id % 200 AS VARCHAR), 6, '0'), 'ENG-' || lpad(CAST(d.dossier_id % 300 AS VARCHAR), 6, '0')))
    GROUP BY 1 HAVING count(DISTINCT engagement_id) = 1""", "dossiers", "engagements"))
def attached_engagements(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = F.expr("array('ENG-' || lpad(CAST(dossier_id % 200 AS STRING), 6, '0'), 'ENG-' || lpad(CAST(dossier_id % 300 AS STRING), 6, '0'))")
    return listing.attach(view(spark, sf_dir, "dossiers").select("dossier_id", refs.alias("refs")), view(spark, sf_dir, "engagements"))


@query(over("""SELECT dossier_id, CAST(coalesce(t, 0) - CASE WHEN r THEN ttc ELSE 0 END AS DOUBLE) AS autres FROM (SELECT *, type = 'BC' AND date_creation >= DATE '1997-01-01' AS r FROM dossiers_ WHERE trim(fournisseur) <> '') a
    LEFT JOIN (SELECT lower(trim(fournisseur)) AS f, sum(ttc) AS t FROM dossiers_ WHERE type = 'BC' AND date_creation >= DATE '1997-01-01' GROUP BY 1) ON f = lower(trim(fournisseur))""", "dossiers"))
def other_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.other_orders_total(view(spark, sf_dir, "dossiers"), "1998-01-01").select("dossier_id", F.col("autres").cast("double").alias("autres"))


_USAGE = "count(*) AS appels, CAST(sum(entree) AS BIGINT) AS entree, CAST(sum(sortie) AS BIGINT) AS sortie, count(*) FILTER (NOT succes) AS erreurs, round(avg(duree), 6) AS duree"


@query(over(f"SELECT dossier_id, {_USAGE} FROM usage_ GROUP BY 1", "usage"))
def usage_by_dossier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.usage_totals(view(spark, sf_dir, "usage"), [F.col("dossier_id")])


@query(over(f"SELECT {_USAGE} FROM usage_ WHERE created_at >= TIMESTAMP '2024-01-10 00:00:00'", "usage"))
def usage_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.usage_totals(view(spark, sf_dir, "usage").filter("created_at >= '2024-01-10 00:00:00'"), [])


@query(over("""SELECT modele, count(*) AS appels, round(sum(entree * coalesce(pe, 1.0) + sortie * coalesce(ps, 5.0))::DOUBLE / 1e6, 6) AS cout, round(count(*) FILTER (NOT succes) * 100 / count(*), 2) AS erreurs,
    round(round(sum(entree * coalesce(pe, 1.0) + sortie * coalesce(ps, 5.0))::DOUBLE / 1e6, 6) / count(*), 8) AS par_appel FROM usage_ LEFT JOIN (VALUES ('petit', 0.8, 4.0), ('grand', 15.0, 75.0)) p(m, pe, ps) ON m = modele GROUP BY 1""", "usage"))
def usage_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = spark.createDataFrame([("petit", "0.8", "4"), ("grand", "15", "75")], "modele string, e string, s string").select("modele", F.col("e").cast("decimal(10,4)").alias("prix_entree"), F.col("s").cast("decimal(10,4)").alias("prix_sortie"))
    return listing.usage_cost(view(spark, sf_dir, "usage"), prices, ("1", "5"))


@query(over("SELECT u.dossier_id, jetons, reference FROM (SELECT dossier_id, CAST(sum(entree + sortie) AS BIGINT) AS jetons FROM usage_ WHERE dossier_id IS NOT NULL GROUP BY 1) u LEFT JOIN dossiers_ d ON d.dossier_id = u.dossier_id ORDER BY jetons DESC, u.dossier_id LIMIT 10", "usage", "dossiers"))
def heaviest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.heaviest(view(spark, sf_dir, "usage"), view(spark, sf_dir, "dossiers"), 10)


@query("""WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+') AS w, string_split_regex(lower(coalesce(source, '')), '[^\\pL\\pN]+') AS s FROM documents),
    n AS (SELECT doc_id, 10 * len(list_filter(s, lambda x: x = 'die')) + len(list_filter(w, lambda x: x = 'die')) AS a, 10 * len(list_filter(s, lambda x: x = 'für')) + len(list_filter(w, lambda x: x = 'für')) AS b FROM t)
    SELECT doc_id, CAST(a + b AS BIGINT) AS rang FROM n WHERE a > 0 AND b > 0 ORDER BY rang DESC, doc_id LIMIT 50""")
def ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.full_text(table(spark, sf_dir, "documents"), "Für die", F.col("source"))


@query("SELECT doc_id, 0.0::DOUBLE AS rang FROM documents WHERE contains(lower(source), 'ation') OR contains(lower(coalesce(text, '')), 'ation') ORDER BY doc_id DESC LIMIT 50")
def containing_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.containing(table(spark, sf_dir, "documents"), "ATION", F.col("source"))


_AUDIT = "SELECT event_id AS audit_id, user_id AS dossier_id, upper(event_type) AS action, ts AS date_action FROM events"


@query(f"SELECT audit_id, action, date_action FROM ({_AUDIT}) WHERE dossier_id = 7")
def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = spark.sql(_AUDIT.replace("FROM events", "FROM {events}"), events=table(spark, sf_dir, "events"))
    return listing.audit_trail(log, 7).select("audit_id", "action", "date_action")


@query(over("SELECT dossier_id, regle, statut, row_number() OVER (PARTITION BY dossier_id ORDER BY regle) AS rang FROM verdicts_", "verdicts"))
def verdicts_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.in_order(view(spark, sf_dir, "verdicts"), "regle").select("dossier_id", "regle", "statut", "rang")


@query(over("SELECT dossier_id, document_id, row_number() OVER (PARTITION BY dossier_id ORDER BY upload, document_id) AS rang FROM documents_", "documents"))
def documents_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.in_order(view(spark, sf_dir, "documents"), "upload", "document_id").select("dossier_id", "document_id", "rang")


_CUSTOM = """SELECT 'CUSTOM-' || lpad(CAST(p_partkey AS STRING), 6, '0') AS code, p_name AS libelle, p_size > 25 AS enabled, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE 'prompt ' || p_type END AS prompt,
    CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN 'AVERTISSEMENT' WHEN 2 THEN 'NON_CONFORME' ELSE 'GRAVE' END AS severity, p_partkey % 3 > 0 AS bc, p_partkey % 5 > 0 AS contractuel, p_partkey AS demande FROM part"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_CUSTOM.replace("FROM part", "FROM {part}"), part=table(spark, sf_dir, "part"))


@query(f"SELECT code, libelle FROM ({_CUSTOM}) WHERE CASE WHEN demande % 10 = 3 THEN demande % 20 = 3 ELSE enabled END")
def custom_rules_enabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of users that are on, by code, after some were switched."""
    rules = _rules(spark, sf_dir)
    changes = rules.filter("demande % 10 = 3").select("demande", (F.col("demande") % 20 == 3).alias("actif"))
    return custom.listed(custom.toggled(rules, changes, "demande"), enabled_only=True).select("code", "libelle")


@query(f"""WITH a AS (SELECT *, CASE WHEN trim(prompt) = '' THEN 'PROMPT' WHEN NOT (bc OR contractuel) THEN 'TYPE' WHEN severity = 'GRAVE' THEN 'SEVERITE' END AS refus FROM ({_CUSTOM})),
    n AS (SELECT *, count(*) FILTER (refus IS NULL) OVER (ORDER BY demande) + 41 AS numero FROM a)
    SELECT demande, CASE WHEN refus IS NULL THEN 'CUSTOM-' || CAST(numero AS VARCHAR) END AS code, refus, CASE WHEN severity = '' THEN 'NON_CONFORME' ELSE severity END AS severity FROM n""")
def custom_rules_created(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = spark.createDataFrame([("CUSTOM-07",), ("CUSTOM-41",), ("AUTRE-99",)], "code string")
    return custom.created(known, _rules(spark, sf_dir).drop("code", "enabled")).select("demande", "code", "refus", "severity")


@query("""
WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+') AS w, string_split_regex(lower(coalesce(source, '')), '[^\\pL\\pN]+') AS s FROM documents),
     n AS (SELECT doc_id, list_transform(['the', 'of', 'src1'], lambda q: 10 * len(list_filter(s, lambda x: x = q)) + len(list_filter(w, lambda x: x = q))) AS r FROM t)
SELECT doc_id, CAST(list_sum(r) AS BIGINT) AS rang FROM n WHERE list_min(r) > 0 ORDER BY rang DESC, doc_id LIMIT 50""")
def indexed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words in title and text by an inverted index, which is built in two steps; the query is cut as the texts are."""
    docs = table(spark, sf_dir, "documents")
    index = Buckets(spark, f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", key="mot")
    search.add_documents(index, docs.filter("doc_id % 2 = 0"), "doc_id", "source", "text")
    search.add_documents(index, docs.filter("doc_id % 2 = 1"), "doc_id", "source", "text")
    return search.search(index, "The, of: (SRC1)!")
