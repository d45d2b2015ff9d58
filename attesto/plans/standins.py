"""Stand-in relations over the tables at hand, as SQL that Spark and DuckDB both run; queries build on their views.

Orders are payment files, line items their documents and verdicts, customers suppliers and engagements, events the
usage records of models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attesto.sources.tables import table

_MONEY = "CAST({} AS DECIMAL(18,2))"

SQL = {
    "dossiers": f"""SELECT o_orderkey AS dossier_id, 'DOS-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS reference, CASE WHEN o_orderpriority < '3' THEN 'CONTRACTUEL' ELSE 'BC' END AS type,
        CASE o_orderstatus WHEN 'O' THEN 'BROUILLON' WHEN 'F' THEN 'VALIDE' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'EN_VERIFICATION' ELSE 'REJETE' END END AS statut,
        CASE WHEN o_orderkey % 29 = 0 THEN ' ' WHEN o_orderkey % 2 = 0 THEN upper(c_name) ELSE c_name END AS fournisseur, {_MONEY.format("o_totalprice")} AS ttc, {_MONEY.format("CAST(o_totalprice AS DECIMAL(18,2)) * 0.75")} AS ht, o_orderdate AS date_creation,
        CASE WHEN o_custkey % 4 < 3 THEN o_custkey END AS engagement_id, CASE WHEN o_orderkey % 6 = 0 THEN 'FACTURE,INCONNUE,PV_RECEPTION' END AS requis FROM orders JOIN customer ON c_custkey = o_custkey""",
    "documents": """SELECT l_orderkey * 10 + l_linenumber AS document_id, l_orderkey AS dossier_id, min(CASE l_returnflag WHEN 'R' THEN 'FACTURE' WHEN 'A' THEN 'ORDRE_PAIEMENT' ELSE 'BON_COMMANDE' END) AS type,
        min(l_shipdate) AS upload, min('h' || CAST(l_partkey % 50 AS STRING)) AS empreinte, min('Piece_' || CAST(l_partkey AS STRING) || '.pdf') AS fichier, min(CAST(l_quantity AS INT)) AS pages,
        min(l_linestatus) = 'F' AS extrait, CAST(min(l_extendedprice) AS DECIMAL(18,2)) AS montant, min(l_suppkey) AS emetteur FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "verdicts": """SELECT l_orderkey AS dossier_id, CASE WHEN l_partkey % 12 = 0 THEN 'CUSTOM-01' ELSE 'R' || lpad(CAST(l_partkey % 12 AS STRING), 2, '0') END AS regle,
        min(CASE WHEN l_returnflag = 'R' THEN 'NON_CONFORME' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'AVERTISSEMENT' WHEN l_suppkey % 9 = 0 THEN 'NON_APPLICABLE' ELSE 'CONFORME' END) AS statut,
        min(CASE WHEN l_suppkey % 10 = 0 THEN 'CONFORME' WHEN l_suppkey % 10 = 1 THEN 'NON_CONFORME' END) AS statut_original, min(CASE WHEN l_quantity > 45 THEN NULL ELSE CAST(l_quantity AS INT) END) AS duree,
        max(l_shipdate) AS execution, min(l_orderkey * 10 + l_linenumber) AS document_id, min('attendu ' || CAST(l_partkey AS STRING)) AS attendue, min(CASE WHEN l_suppkey % 3 > 0 THEN 'trouve ' || CAST(l_suppkey AS STRING) END) AS trouvee,
        min('Ecart releve. Suite ' || CAST(l_partkey AS STRING)) AS detail FROM lineitem GROUP BY l_orderkey, l_partkey % 12""",
    "engagements": f"""SELECT c_custkey AS engagement_id, 'ENG-' || lpad(CAST(c_custkey AS STRING), 6, '0') AS reference, CASE c_custkey % 4 WHEN 0 THEN 'MARCHE' WHEN 1 THEN 'BON_COMMANDE' ELSE 'CONTRAT' END AS type,
        CASE c_custkey % 5 WHEN 0 THEN 'CLOTURE' WHEN 1 THEN 'SUSPENDU' ELSE 'ACTIF' END AS statut, c_name AS fournisseur, {_MONEY.format("CAST(c_acctbal AS DECIMAL(18,2)) * 500")} AS plafond, CASE WHEN c_custkey % 4 = 0 THEN 'AO-' || CAST(c_custkey AS STRING) END AS numero_ao,
        CASE WHEN c_custkey % 4 = 1 THEN {_MONEY.format("100000")} END AS seuil, CASE WHEN c_custkey % 4 IN (2, 3) THEN 'MENSUEL' END AS periodicite FROM customer WHERE c_custkey % 4 < 3""",
    "usage": """SELECT event_id AS usage_id, ts AS created_at, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS dossier_id, CASE event_type WHEN 'error' THEN 'petit' WHEN 'click' THEN 'moyen' ELSE 'grand' END AS modele,
        CAST(floor(value * 100) AS BIGINT) AS entree, CAST(floor(value * 10) AS BIGINT) AS sortie, event_type <> 'error' AS succes, CAST(floor(value) AS INT) AS duree FROM events""",
}
SOURCES = {"dossiers": ("orders", "customer"), "documents": ("lineitem",), "verdicts": ("lineitem",), "engagements": ("customer",), "usage": ("events",)}


def view(spark: SparkSession, sf_dir: str, name: str, by: str | None = None, parts: int = 0) -> DataFrame:
    """One stand-in relation; with ``by``, its tables are dealt into ``parts`` partitions of that column first."""
    sql = SQL[name]
    for source in SOURCES[name]:
        sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}").replace(f"JOIN {source}", f"JOIN {{{source}}}")
    sources = {source: table(spark, sf_dir, source) for source in SOURCES[name]}
    return spark.sql(sql, **{source: df.repartition(parts, by) if by else df for source, df in sources.items()})


def over(sql: str, *names: str) -> str:
    """``sql`` over the named stand-ins, for DuckDB."""
    return f"WITH {', '.join(f'{n}_ AS ({SQL[n]})' for n in names)} {sql}"
