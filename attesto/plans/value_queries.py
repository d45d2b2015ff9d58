"""Amounts, dates, names and texts of the tables at hand in the notations that documents use, with SQL that works the values out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.functions import scalars, texts
from attesto.operators import quality, typed
from attesto.plans.registry import query
from attesto.sources.tables import table


def _run(spark: SparkSession, sf_dir: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace("{", "{{").replace("}", "}}").replace(f"FROM {name}", f"FROM {{{name}}}"), **{name: table(spark, sf_dir, name)})


#: Prices of lines with groups of thousands and decimal marks of three notations, with and without a currency.
_GROUPED = "CASE WHEN w >= 1000 THEN CAST(floor(w / 1000) AS BIGINT) || '{g}' || lpad(CAST(w % 1000 AS STRING), 3, '0') ELSE CAST(w AS STRING) END || '{d}' || lpad(CAST(c AS STRING), 2, '0')"
PRICES = f"""SELECT k, n, v, w, c, CASE v WHEN 0 THEN {_GROUPED.format(g=' ', d=',')} || ' MAD' WHEN 1 THEN {_GROUPED.format(g='.', d=',')} WHEN 2 THEN {_GROUPED.format(g=',', d='.')} WHEN 3 THEN {_GROUPED.format(g='', d='.')} ELSE 'env. ' || CAST(w AS STRING) || '€' END AS t
    FROM (SELECT l_orderkey AS k, l_linenumber AS n, (l_orderkey + l_linenumber) % 5 AS v, CAST(floor(l_extendedprice) AS BIGINT) AS w, CAST(round(l_extendedprice * 100) AS BIGINT) % 100 AS c FROM lineitem)"""


@query(f"""WITH p AS ({PRICES}), s AS (SELECT *, CASE WHEN v = 4 THEN w::DOUBLE ELSE w + c / 100 END AS x FROM p)
    SELECT k, n, t, CASE WHEN v = 4 THEN round(CAST('.' || w AS DECIMAL(18,9)), 2)::DOUBLE ELSE round(x, 2) END AS souple, CASE WHEN v < 4 THEN round(x, 2) END AS typee, CASE WHEN v = 3 OR v IN (1, 2) AND w < 1000 THEN round(x, 2) END AS engagement FROM s""")
def parsed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three grammars of amounts over the same notations."""
    rows, number = _run(spark, sf_dir, PRICES, "lineitem"), lambda c: c.cast("double")
    t = F.col("t")
    return rows.select("k", "n", "t", number(scalars.parse_amount(t)).alias("souple"), number(scalars.parse_amount_strict(t)).alias("typee"), number(scalars.parse_amount_plain(t)).alias("engagement"))


_S = "CAST(d AS STRING)"
DATES = f"""SELECT k, d, k % 7 AS v, CASE k % 7 WHEN 0 THEN {_S} WHEN 1 THEN substr({_S}, 9, 2) || '/' || substr({_S}, 6, 2) || '/' || substr({_S}, 1, 4) WHEN 2 THEN substr({_S}, 9, 2) || '-' || substr({_S}, 6, 2) || '-' || substr({_S}, 1, 4)
    WHEN 3 THEN ' ' || substr({_S}, 9, 2) || '.' || substr({_S}, 6, 2) || '.' || substr({_S}, 1, 4) WHEN 4 THEN replace({_S}, '-', '/') WHEN 5 THEN '31/02/' || substr({_S}, 1, 4) ELSE 'le ' || {_S} END AS t FROM (SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders)"""


@query(f"""WITH p AS ({DATES}) SELECT k, CASE WHEN v < 4 THEN d END AS souple, CASE WHEN v < 2 THEN d WHEN v = 5 THEN last_day(make_date(year(d), 2, 1)) END AS typee, CASE WHEN v < 5 THEN d END AS correction FROM p""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grammars of dates: of the rules, of the typed rows (a day beyond the end of its month is its last), of corrections."""
    t = F.col("t")
    return _run(spark, sf_dir, DATES, "orders").select("k", scalars.parse_date(t).alias("souple"), scalars.parse_date_typed(t).alias("typee"), scalars.parse_date_correction(t).alias("correction"))


NAMES = "SELECT p_partkey AS k, CASE p_partkey % 4 WHEN 0 THEN upper(replace(p_name, 'e', 'é')) || ' S.A.R.L' WHEN 1 THEN 'L''' || p_name || ' -- N°' || CAST(p_partkey AS STRING) WHEN 2 THEN replace(replace(p_name, 'i', 'ǐ'), 'o', 'ộ') || ' sas' ELSE '00' || CAST(p_partkey AS STRING) || '/' || p_name || '.' END AS t FROM part"
_BARE = "regexp_replace(lower(strip_accents(replace(t, '.', '{dot}'))), '[^a-z0-9]+', ' ', 'g')"


@query(f"""WITH p AS ({NAMES}) SELECT k, trim({_BARE.format(dot=' ')}) AS libelle, trim(regexp_replace(regexp_replace({_BARE.format(dot='')}, '\\b(sarl|sas|sa|sprl|eurl|sci|gie)\\b', ' ', 'g'), ' +', ' ', 'g')) AS fournisseur,
    lower(regexp_replace(t, '[\\s\\-_/.'']+', '', 'g')) AS reference, lower(regexp_replace(trim(t), '[\\s\\-_|/.]+', '', 'g')) AS code, coalesce(nullif(ltrim(regexp_replace(t, '[\\s\\-.]', '', 'g'), '0'), ''), '0') AS identifiant FROM p""")
def normalized_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("t")
    return _run(spark, sf_dir, NAMES, "part").select(
        "k", scalars.normalize_label(t).alias("libelle"), scalars.supplier_key(t).alias("fournisseur"), scalars.normalize_reference(t).alias("reference"), scalars.normalize_code(t).alias("code"), scalars.normalize_id(t).alias("identifiant")
    )


@query("""WITH a AS (SELECT p_partkey AS k, lower(p_name || ' ' || p_brand || ' ' || p_type) AS t FROM part),
    w AS (SELECT k, trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')) AS l, list_distinct(list_filter(string_split(trim(regexp_replace(t, '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: length(x) >= 2)) AS m FROM a),
    p AS (SELECT x.k, y.k AS autre, x.l AS l1, y.l AS l2, len(list_intersect(x.m, y.m)) AS i, len(x.m) + len(y.m) AS n FROM w x JOIN w y ON y.k BETWEEN x.k + 1 AND x.k + 5)
    SELECT k, autre, round(CASE WHEN l1 = l2 THEN 1 ELSE i / (n - i) END, 6) AS libelles,
           round(CASE WHEN contains(l1, l2) OR contains(l2, l1) THEN 0.80 + 0.15 * least(length(l1), length(l2)) / greatest(length(l1), length(l2)) ELSE 0 END, 6) AS contenu FROM p""")
def compared_part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's label against those of its next five neighbours; a label is normalised and cut once, before the pairs are made."""
    named = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), scalars.normalize_label(F.concat_ws(" ", "p_name", "p_brand", "p_type")).alias("l"))
    named = named.withColumn("m", scalars.label_words(F.col("l")))
    near = named.select("k", "l", "m", F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: F.col("k") + i)).alias("autre"))
    pairs = near.join(named.select(F.col("k").alias("autre"), F.col("l").alias("l2"), F.col("m").alias("m2")), "autre")
    return pairs.select("k", "autre", F.round(scalars.labels_alike(*map(F.col, ("l", "m", "l2", "m2"))), 6).alias("libelles"), F.round(scalars.containment_bonus(F.col("l"), F.col("l2")), 6).alias("contenu"))


#: Turns as strings of a JSON object inside other text; every fourth object is not closed.
OBJECTS = """SELECT conv_id, turn, '{"tour":{"texte":"' || replace(replace(coalesce(text, ''), '\\\\', '\\\\\\\\'), '"', '\\\\"') || '"},"n":' || CAST(turn AS STRING) AS debut FROM conversations"""


@query(f"SELECT conv_id, turn, CASE WHEN turn % 4 <> 3 THEN md5(debut || '}}') END AS objet FROM ({OBJECTS.replace(chr(92) * 2, chr(92))})")
def turn_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first balanced JSON object of an answer that holds a turn, quotes, braces and backslashes included."""
    rows = _run(spark, sf_dir, OBJECTS, "conversations")
    answer = F.concat(F.lit("Voici ```json\\n"), "debut", F.when(F.col("turn") % 4 != 3, "}``` fin } {").otherwise(""))
    return rows.select("conv_id", "turn", F.md5(texts.first_json_object(answer)).alias("objet"))


_MAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"


@query(f"SELECT doc_id, len(list_distinct(regexp_extract_all(coalesce(text, ''), '{_MAIL}'))) AS adresses, true AS retabli FROM documents")
def restored_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under pseudonyms: how many addresses got a token, and that the mapping gives the text back."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).withColumn("p", texts.pseudonymize(F.col("t")))
    mails = F.size(F.filter(F.map_keys("p.mapping"), lambda k: k.startswith("[EMAIL_")))
    return rows.select("doc_id", mails.alias("adresses"), (texts.restore(F.col("p.text"), F.col("p.mapping")) == F.col("t")).alias("retabli"))


#: Payment orders in JSON: account numbers of 24 digits or fewer, apart by blanks, days in three notations, amounts that are read, negative or missing.
ORDERED = """SELECT o_orderkey AS document_id, 'ORDRE_PAIEMENT' AS type, '{"RIB":' || CASE o_orderkey % 4 WHEN 0 THEN '"' || lpad(CAST(o_orderkey AS STRING), 24, '7') || '"' WHEN 1 THEN '"007 ' || lpad(CAST(o_orderkey AS STRING), 20, '1') || ' 9"' WHEN 2 THEN '" "' ELSE '"' || CAST(o_orderkey AS STRING) || '"' END
    || ',"dateEmission":' || CASE o_orderkey % 5 WHEN 0 THEN 'null' WHEN 1 THEN '"hier"' WHEN 2 THEN '"2024/05/06"' ELSE '"' || substr(CAST(o_orderdate AS STRING), 1, 10) || '"' END
    || ',"montantOperation":' || CASE o_orderkey % 7 WHEN 0 THEN '"-' || CAST(o_orderkey AS STRING) || '"' WHEN 1 THEN '"illisible"' WHEN 2 THEN '""' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END || '}' AS json FROM orders"""


@query(f"""WITH d AS (SELECT document_id, json::JSON AS j FROM ({ORDERED})), v AS (SELECT document_id,
    [CASE WHEN j->>'$.dateEmission' IS NOT NULL AND TRY_CAST(replace(j->>'$.dateEmission', '/', '-') AS DATE) IS NULL THEN 'dateEmission' END,
     CASE WHEN trim(j->>'$.montantOperation') <> '' AND coalesce(TRY_CAST(j->>'$.montantOperation' AS DOUBLE) < 0, true) THEN 'montantOperation' END,
     CASE WHEN trim(j->>'$.RIB') <> '' AND length(regexp_replace(j->>'$.RIB', '[^0-9]', '', 'g')) <> 24 THEN 'rib' END] AS f FROM d)
    SELECT document_id, array_to_string(list_filter(f, lambda x: x IS NOT NULL), ',') AS violations, f[2] IS NULL AS valide FROM v""")
def checked_payment_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted payment orders against their schema; a field is found whatever the case of its name."""
    docs = _run(spark, sf_dir, ORDERED, "orders").withColumn("data", quality.fields(F.col("json")))
    checked = quality.validate_schema(docs)
    return checked.select("document_id", F.array_join(F.array_sort("violations"), ",").alias("violations"), "valide")


@query(f"""WITH d AS (SELECT document_id, json::JSON AS j FROM ({ORDERED})), f AS (SELECT document_id, regexp_replace(j->>'$.RIB', '[^0-9]', '', 'g') AS a, CASE WHEN document_id % 6 > 0 THEN CASE WHEN document_id % 10 = 3 THEN '1' ELSE '' END || regexp_replace(j->>'$.RIB', '[^0-9]', '', 'g') END AS b FROM d)
    SELECT document_id, 'rib' AS champ, CASE WHEN b IS NULL THEN 'doute' ELSE 'retire' END AS issue FROM f WHERE b IS NULL OR a <> '' AND b <> '' AND a <> b""")
def doubted_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Account numbers that a second reading gives otherwise, or not at all."""
    first = _run(spark, sf_dir, ORDERED, "orders").select("document_id", quality.fields(F.col("json")).alias("data"))
    again = F.when(F.col("document_id") % 6 > 0, F.concat(F.when(F.col("document_id") % 10 == 3, "1").otherwise(""), F.col("data")["rib"]))
    second = first.select("document_id", F.when(again.isNotNull(), F.create_map(F.lit("rib"), again)).otherwise(F.create_map(F.lit("autre"), F.lit("x"))).alias("data"))
    return quality.compare_passes(first, second, ["rib"])


#: Events as uploads: few contents, which come again and again; some read as blank.
UPLOADED = "SELECT sha256(CAST(user_id % 97 AS STRING)) AS sha256, ts, CASE WHEN user_id % 97 % 10 = 3 THEN ' ' ELSE 'texte ' || CAST(user_id % 97 AS STRING) END AS texte, event_id FROM events"


@query(f"""WITH u AS ({UPLOADED}), a AS (SELECT sha256, count(*) FILTER (event_id % 3 = 0) AS a, max(ts) FILTER (event_id % 3 = 0) AS ta, count(*) FILTER (event_id % 3 = 1) AS b, max(ts) FILTER (event_id % 3 = 1) AS tb, count(*) FILTER (event_id % 3 = 2 AND event_id % 2 = 0) AS c,
        max(ts) FILTER (event_id % 3 = 2 AND event_id % 2 = 0) AS tc, min(texte) AS texte FROM u GROUP BY 1)
    SELECT sha256, CASE WHEN c > 0 THEN 2 ELSE 1 END AS version, texte, CASE WHEN c > 0 THEN c - 1 ELSE a + b - 1 END AS hits, CASE WHEN c > 0 THEN tc ELSE greatest(coalesce(ta, tb), coalesce(tb, ta)) END AS dernier FROM a WHERE trim(texte) <> '' AND a + b + c > 0""")
def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache of recognised texts after two passes in one version and one in the next."""
    uploads = _run(spark, sf_dir, UPLOADED.replace("sha256(CAST(user_id % 97 AS STRING))", "sha2(CAST(user_id % 97 AS STRING), 256)"), "events")
    cache = spark.createDataFrame([], "sha256 string, version int, texte string, hits bigint, dernier timestamp")
    for version, taken in ((1, "event_id % 3 = 0"), (1, "event_id % 3 = 1"), (2, "event_id % 3 = 2 AND event_id % 2 = 0")):
        cache = typed.fold_cache(cache, uploads.filter(taken), version)
    return cache
