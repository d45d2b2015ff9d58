"""The registered queries over the reference operators, with their DuckDB counterparts.

The tables at hand have no invoices; each operator is bound to a stand-in: orders are payment files, line items invoice
lines, customers suppliers and engagements, events usage records, labels human corrections.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.functions import scalars
from attesto.operators import crossfile, listing, reports, rules
from attesto.operators.verdicts import emit
from attesto.plans import listing_queries, rule_queries, state_queries, text_queries, typed_queries, value_queries  # noqa: F401  they register their queries
from attesto.plans.context import from_orders
from attesto.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from attesto.sources.tables import table
from attesto.streaming.telemetry import daily_usage

FLAGSHIP = "rule_verdicts"


def ttc():
    """An order's total as money."""
    return scalars.money(F.col("o_totalprice"))


VERDICT_SQL = """
WITH l AS (
    SELECT l_orderkey AS k, CAST(l_extendedprice AS DECIMAL(18,2)) AS mt, CAST(l_quantity AS DECIMAL(15,3)) AS q, l_tax, l_shipdate FROM lineitem
), p AS (SELECT *, CAST(round(CAST(mt AS DOUBLE) / CAST(q AS DOUBLE), 2) AS DECIMAL(18,2)) AS pu FROM l
), agg AS (
    SELECT k, sum(mt) AS bc, max(CAST(l_shipdate AS DATE)) AS op, max(CAST(l_tax * 100 AS DECIMAL(5,2))) AS taux,
           bool_or(abs(round(q * pu, 2) - mt) > greatest(0.05, greatest(abs(round(q * pu, 2)), abs(mt), 1)::DOUBLE * 0.005)) AS bad
    FROM p GROUP BY k
), f AS (
    SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS ttc, CAST(o_orderdate AS DATE) AS jour, bc, op, taux, bad
    FROM orders LEFT JOIN agg ON k = o_orderkey
), v AS (
    SELECT 'R01' AS regle, CASE WHEN abs(ttc - bc) <= 0.05 THEN 'CONFORME'
        WHEN bc <> 0 AND ttc < bc AND (abs(ttc - round(bc / 2, 2)) <= 0.05 OR abs(ttc - round(bc / 3, 2)) <= 0.05 OR abs(ttc - round(bc / 4, 2)) <= 0.05 OR abs(ttc - round(bc / 6, 2)) <= 0.05 OR abs(ttc - round(bc / 12, 2)) <= 0.05) THEN 'AVERTISSEMENT'
        ELSE 'NON_CONFORME' END AS statut FROM f WHERE bc IS NOT NULL
    UNION ALL SELECT 'R16b', CASE WHEN bad THEN 'NON_CONFORME' ELSE 'CONFORME' END FROM f WHERE bc IS NOT NULL
    UNION ALL SELECT 'R17b', CASE WHEN op >= jour THEN 'CONFORME' ELSE 'NON_CONFORME' END FROM f WHERE op IS NOT NULL
    UNION ALL SELECT 'R24', CASE WHEN bc IS NOT NULL THEN 'CONFORME' ELSE 'AVERTISSEMENT' END FROM f WHERE ttc >= 50000
    UNION ALL SELECT 'R30', CASE WHEN taux IN (0, 7, 10, 14, 20) THEN 'CONFORME' ELSE 'NON_CONFORME' END FROM f WHERE taux IS NOT NULL
)
SELECT regle, statut, count(*) AS nb FROM v GROUP BY ALL
"""


def file_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    context = from_orders(table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"))
    return emit(context, [*rules.amounts(), *rules.references(), *rules.chronology()])


@query(VERDICT_SQL)
def rule_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = file_verdicts(spark, sf_dir).filter(F.col("regle").isin("R01", "R16b", "R17b", "R24", "R30"))
    return found.groupBy("regle", "statut").agg(F.count(F.lit(1)).alias("nb"))


@query("SELECT o_orderstatus AS statut, count(*) AS nb, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS total FROM orders GROUP BY 1")
def status_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_status(table(spark, sf_dir, "orders"), "o_orderstatus", ttc())


@query("SELECT count(*) AS total, count(*) FILTER (o_orderstatus = 'O') AS ouverts, count(*) FILTER (o_orderstatus = 'F') AS valides, count(*) FILTER (o_orderstatus = 'P') AS en_cours, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS montant FROM orders")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.dashboard(table(spark, sf_dir, "orders"), "o_orderstatus", ttc(), {"ouverts": "O", "valides": "F", "en_cours": "P"})


SUPPLIER_SQL = """
SELECT o_custkey AS fournisseur, count(*) AS nb, count(*) FILTER (o_orderstatus = 'F') AS valides, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total,
       CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))) FILTER (o_orderstatus = 'F'), 0) AS DOUBLE) AS total_valide, CAST(max(o_orderdate) AS DATE) AS dernier, CAST(min(o_orderdate) AS DATE) AS premier
FROM orders WHERE o_custkey IS NOT NULL GROUP BY 1"""


@query(SUPPLIER_SQL)
def supplier_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.by_supplier(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ttc(), "o_orderdate", "F")


@query(f"SELECT fournisseur, total FROM ({SUPPLIER_SQL}) ORDER BY total DESC, fournisseur LIMIT 5")
def top_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.top(supplier_summary(spark, sf_dir).select("fournisseur", "total"), "total", 5, "fournisseur")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1")
def usage_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_usage(table(spark, sf_dir, "events"))


@query("""
WITH d AS (SELECT CAST(ts AS DATE) AS day, count(*) AS calls FROM events WHERE event_type = 'error' GROUP BY 1),
     g AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d)
SELECT day, CAST(coalesce(calls, 0) AS BIGINT) AS calls FROM g LEFT JOIN d USING (day)""")
def errors_gap_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = daily_usage(table(spark, sf_dir, "events").filter("event_type = 'error'")).select("day", "calls")
    return reports.fill_days(daily, "day", ["calls"])


@query("SELECT event_type AS modele, count(*) AS appels, round(sum(CAST(value AS DECIMAL(18,4))), 2)::DOUBLE AS cout, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS jetons FROM events GROUP BY 1")
def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("modele")).agg(F.count(F.lit(1)).alias("appels"), F.round(F.sum(F.col("value").cast("decimal(18,4)")), 2).cast("double").alias("cout"), F.sum(tokens).alias("jetons"))


@query("""
WITH i AS (SELECT o_orderkey AS id, o_custkey AS f, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS ttc, CAST(o_orderdate AS DATE) AS j FROM orders)
SELECT a.id AS a_invoice_id, b.id AS invoice_id, a.ttc AS a_ttc, b.ttc AS ttc FROM i a JOIN i b ON a.f = b.f AND a.id <> b.id
WHERE b.ttc >= a.ttc * (1 - 10 / 100.0::DOUBLE) AND b.ttc <= a.ttc * (1 + 10 / 100.0::DOUBLE) AND abs(date_diff('day', a.j, b.j)) <= 30""")
def duplicate_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    invoices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice_id"), F.col("o_orderkey").alias("dossier_id"), F.col("o_custkey").alias("fournisseur"), ttc().cast("double").alias("ttc"), F.to_date("o_orderdate").alias("jour"))
    return crossfile.duplicate_amounts(invoices, percent=10, days=30)


@query("""
WITH u AS (SELECT o_custkey AS k, count(*) AS nb, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS s FROM orders GROUP BY 1)
SELECT c_custkey AS engagement_id, coalesce(nb, 0) AS nb, coalesce(s, 0)::DOUBLE AS consomme,
       CASE WHEN c_acctbal * 100 > 0 THEN round(coalesce(s, 0)::DOUBLE / CAST(c_acctbal * 100 AS DECIMAL(18,2))::DOUBLE * 100, 2) END AS taux
FROM customer LEFT JOIN u ON k = c_custkey""")
def engagement_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("engagement_id"), ttc().alias("ttc"))
    caps = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("engagement_id"), (F.col("c_acctbal") * 100).cast("decimal(18,2)").alias("plafond"))
    return crossfile.consumption(files, caps).select("engagement_id", "nb", F.col("consomme").cast("double").alias("consomme"), "taux")


@query("""
SELECT dossier_id, max(j) OVER (PARTITION BY f ORDER BY j RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING) AS precedente, lag(ttc) OVER (PARTITION BY f ORDER BY dossier_id) AS precedent_ttc
FROM (SELECT o_orderkey AS dossier_id, o_custkey % 20 AS f, CAST(o_orderdate AS DATE) AS j, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS ttc FROM orders)""")
def previous_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few engagements with many files each, so that files of one day and files without an amount occur."""
    amount = F.when(F.col("o_orderkey") % 9 > 0, ttc())
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dossier_id"), (F.col("o_custkey") % 20).alias("engagement"), F.to_date("o_orderdate").alias("jour"), amount.alias("ttc"))
    return crossfile.previous_payment(files, "engagement", "jour", "dossier_id", "ttc").select("dossier_id", "precedente", "precedent_ttc")


@query("""
SELECT o_orderkey AS dossier_id, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) RANGE BETWEEN 365 PRECEDING AND CURRENT ROW) AS DOUBLE) AS cumul FROM orders""")
def rolling_supplier_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dossier_id"), "o_custkey", F.to_date("o_orderdate").alias("jour"), ttc().alias("ttc"))
    return crossfile.rolling_total(files, "o_custkey", "jour", "ttc").select("dossier_id", F.col("cumul").cast("double").alias("cumul"))


@query("SELECT o_orderkey AS dossier_id, CAST(o_totalprice AS DECIMAL(18,2))::DOUBLE AS ttc FROM orders WHERE o_orderstatus = 'F' AND lower(o_orderpriority) LIKE '%urgent%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reports.search(table(spark, sf_dir, "orders"), {"o_orderstatus": "F"}, {"o_orderpriority": "URGENT"})
    return reports.page(found, [F.desc("o_orderdate"), F.col("o_orderkey")], 1).select(F.col("o_orderkey").alias("dossier_id"), ttc().cast("double").alias("ttc"))


@query("""
WITH t AS (SELECT doc_id, string_split_regex(lower(coalesce(text, '')), '[^\\pL\\pN]+') AS w, string_split_regex(lower(coalesce(source, '')), '[^\\pL\\pN]+') AS s FROM documents),
     n AS (SELECT doc_id, 10 * len(list_filter(s, lambda x: x = 'the')) + len(list_filter(w, lambda x: x = 'the')) AS a, 10 * len(list_filter(s, lambda x: x = 'with')) + len(list_filter(w, lambda x: x = 'with')) AS b FROM t)
SELECT doc_id, CAST(a + b AS BIGINT) AS rang FROM n WHERE a > 0 AND b > 0 ORDER BY rang DESC, doc_id LIMIT 50""")
def full_text_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.full_text(table(spark, sf_dir, "documents"), "the with", F.col("source"))


@query("""
SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '') AS hote,
       CASE WHEN regexp_matches(lower(trim(url)), '^(javascript|data|file|vbscript):') THEN 'DANGEROUS' WHEN starts_with(lower(url), 'https://') THEN 'SAFE' ELSE 'UNSAFE' END AS risque FROM pages""")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", scalars.url_host(F.col("url")).alias("hote"), scalars.url_risk(F.col("url")).alias("risque"))


@query("""
WITH m AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+\\-]+@[A-Za-z0-9.\\-]+\\.[A-Za-z]{2,}', '[EMAIL]', 'g'), '\\b[0-9]{24}\\b', '[RIB]', 'g'), '\\b[0-9]{15}\\b', '[ICE]', 'g') AS t FROM documents)
SELECT doc_id, md5(t) AS empreinte, contains(t, '[EMAIL]') AS courriel FROM m""")
def masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    masked = table(spark, sf_dir, "documents").select("doc_id", scalars.mask_personal_data(F.col("text")).alias("t"))
    return masked.select("doc_id", F.md5("t").alias("empreinte"), F.contains("t", F.lit("[EMAIL]")).alias("courriel"))


@query("""
WITH s AS (SELECT source, CASE WHEN n_chars > 1000 THEN 1 ELSE 0 END AS systeme, quality AS humain FROM documents JOIN labels USING (doc_id)),
     g AS (SELECT source AS regle, count(*) AS total, count(*) FILTER (systeme <> humain) AS corriges, count(*) FILTER (systeme = 1 AND humain = 0) AS faux_positifs, count(*) FILTER (systeme = 0 AND humain = 1) AS faux_negatifs FROM s GROUP BY 1)
SELECT *, round(corriges::DOUBLE / total, 6) AS taux FROM g WHERE corriges > 0""")
def rule_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return reports.corrections_by(checked, F.col("source"), F.when(F.col("n_chars") > 1000, 1).otherwise(0), F.col("quality"))


@query("SELECT c_custkey AS fournisseur FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
def suppliers_without_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers without an urgent file under way."""
    urgent = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select(F.col("c_custkey").alias("fournisseur"))


@query("SELECT o_custkey AS fournisseur, arg_max(o_orderkey, CAST(o_orderdate AS VARCHAR) || lpad(CAST(o_orderkey AS VARCHAR), 20, '0')) AS dossier_id FROM orders GROUP BY 1")
def latest_file_by_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("fournisseur")).agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("dossier_id"))


@query("SELECT o_orderkey AS dossier_id, CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'CORRIGE' ELSE o_orderstatus END AS statut FROM orders")
def corrected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dossier_id"), F.col("o_orderstatus").alias("statut"))
    fixes = files.filter("dossier_id % 7 = 0 or dossier_id % 5 = 0").select("dossier_id", F.lit("statut").alias("champ"), F.when(F.col("dossier_id") % 7 != 0, "CORRIGE").alias("valeur"))
    return crossfile.overlay(files, fixes, "dossier_id", ["statut"])
