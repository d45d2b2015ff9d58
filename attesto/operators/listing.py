"""Listings of payment files, documents, verdicts, suppliers, engagements and model usage, with their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesto.functions import scalars

#: Documents that a file needs by default, and all document types.
DEFAULT_REQUIRED = {"BC": ["FACTURE", "BON_COMMANDE", "ORDRE_PAIEMENT"], "CONTRACTUEL": ["FACTURE", "CONTRAT_AVENANT", "ORDRE_PAIEMENT", "PV_RECEPTION"]}
TYPES = (
    "FACTURE", "BON_COMMANDE", "CONTRAT_AVENANT", "ORDRE_PAIEMENT", "CHECKLIST_AUTOCONTROLE", "CHECKLIST_PIECES", "TABLEAU_CONTROLE", "PV_RECEPTION", "ATTESTATION_FISCALE",
    "FORMULAIRE_FOURNISSEUR", "MARCHE", "BON_COMMANDE_CADRE", "CONTRAT_CADRE", "INCONNU",
)

blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))


def with_counts(dossiers: DataFrame, documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Files with nb_documents, nb_conformes and nb_verdicts; each side is summed before it is joined, so rows never multiply."""
    docs = documents.groupBy("dossier_id").agg(F.count_distinct("document_id").alias("nb_documents"))
    found = verdicts.groupBy("dossier_id").agg(F.count_if(F.col("statut") == "CONFORME").alias("nb_conformes"), F.count(F.lit(1)).alias("nb_verdicts"))
    return dossiers.join(docs, "dossier_id", "left").join(found, "dossier_id", "left").fillna(0, ["nb_documents", "nb_conformes", "nb_verdicts"])


def pattern(column: str, value: str | None) -> Column:
    """Containment without regard to case, with ``%`` and ``_`` as wildcards; null does not filter."""
    return F.lit(True) if value is None else F.lower(column).like(f"%{value.lower()}%")


def search(dossiers: DataFrame, statut: str | None = None, type_: str | None = None, fournisseur: str | None = None, reference: str | None = None) -> DataFrame:
    """Optional filters, absent ones do not filter."""
    equal = lambda c, v: F.lit(True) if v is None else F.col(c) == v
    return dossiers.filter(equal("statut", statut) & equal("type", type_) & pattern("fournisseur", fournisseur) & pattern("reference", reference))


def newest(df: DataFrame, day: str, tie: str, number: int = 0, size: int = 20) -> DataFrame:
    return df.orderBy(F.desc(day), F.desc(tie)).offset(number * size).limit(size)


def of_supplier(dossiers: DataFrame, name: str) -> DataFrame:
    """A supplier's files whatever the case, newest first."""
    return dossiers.filter(F.lower("fournisseur") == name.lower()).orderBy(F.desc("date_creation"), F.desc("dossier_id"))


def identities(rows: DataFrame, name: str, order: str, fields: list[str]) -> DataFrame:
    """The distinct identities of each supplier (whatever the case), the last by ``order`` for each."""
    last = F.max_by(F.struct(*fields), F.struct(order)).alias("last")
    return rows.filter(~blank(F.col(name))).groupBy(F.lower(name).alias("cle")).agg(last).select("cle", "last.*")


def by_supplier(dossiers: DataFrame) -> DataFrame:
    """Per raw name: files by status, sums of TTC and HT, first and last; most files first."""
    is_ = lambda s: F.count_if(F.col("statut") == s)
    out = dossiers.filter(~blank(F.col("fournisseur"))).groupBy("fournisseur").agg(
        F.count(F.lit(1)).alias("nb"), is_("BROUILLON").alias("brouillons"), is_("EN_VERIFICATION").alias("en_cours"), is_("VALIDE").alias("valides"), is_("REJETE").alias("rejetes"),
        F.coalesce(F.sum("ttc"), F.lit(0)).cast("double").alias("total"), F.coalesce(F.sum("ht"), F.lit(0)).cast("double").alias("total_ht"), F.coalesce(F.sum(F.col("ttc") - F.col("ht")), F.lit(0)).cast("double").alias("total_tva"),
        F.coalesce(F.sum(F.when(F.col("statut") == "VALIDE", F.col("ttc"))), F.lit(0)).cast("double").alias("total_valide"), F.max("date_creation").alias("dernier"), F.min("date_creation").alias("premier"),
    )
    return out.orderBy(F.desc("nb"), "fournisseur")


def supplier_totals(dossiers: DataFrame) -> DataFrame:
    """One row: suppliers, those with files under way, and the sum."""
    per = by_supplier(dossiers)
    return per.agg(F.count(F.lit(1)).alias("fournisseurs"), F.count_if((F.col("brouillons") + F.col("en_cours")) > 0).alias("actifs"), F.sum(F.col("total").cast("decimal(28,2)")).cast("double").alias("montant"))


def required(dossiers: DataFrame) -> DataFrame:
    """Each file's required document types: its own list without unknown types, else the default of its type."""
    own = F.filter(F.transform(F.split("requis", ","), F.trim), lambda t: t.isin(*TYPES))
    default = F.when(F.col("type") == "BC", F.array(*map(F.lit, DEFAULT_REQUIRED["BC"]))).otherwise(F.array(*map(F.lit, DEFAULT_REQUIRED["CONTRACTUEL"])))
    return dossiers.withColumn("requis", F.when(blank(F.col("requis")), default).otherwise(own))


def compare_fields(values: DataFrame, sources: list[str]) -> DataFrame:
    """From (dossier_id, champ, source, valeur) one row for each field with a column for each source, and whether they conflict."""
    own = lambda s: F.max(F.when(F.col("source") == s, F.col("valeur"))).alias(s.lower())
    differ = F.count_distinct(F.when(~blank(F.col("valeur")), F.lower(F.trim("valeur")))) > 1
    return values.groupBy("dossier_id", "champ").agg(*map(own, sources), differ.alias("conflit"))


def first_by_type(documents: DataFrame) -> DataFrame:
    """Per file, the first document of each type by upload, as a map from type to document."""
    each = documents.groupBy("dossier_id", "type").agg(F.min_by("document_id", F.struct("upload", "document_id")).alias("document_id"))
    return each.groupBy("dossier_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "document_id")))).alias("premiers"))


def counts_by_type(documents: DataFrame) -> DataFrame:
    """Per type: documents, distinct fingerprints and files. Files are counted where the documents of a file lie together, and nothing is expanded for the distinct counts."""
    files = documents.groupBy("type", "dossier_id").agg(F.count(F.lit(1)).alias("n")).groupBy("type").agg(F.sum("n").alias("nb"), F.count("dossier_id").alias("dossiers"))
    prints = documents.groupBy("type", "empreinte").agg(F.lit(1)).groupBy("type").agg(F.count("empreinte").alias("empreintes"))
    return files.join(prints.withColumnRenamed("type", "__type"), F.col("type").eqNullSafe(F.col("__type"))).select("type", "nb", "empreintes", "dossiers")


def status_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("dossier_id", "statut").agg(F.count(F.lit(1)).alias("nb"))


def without_custom(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(~F.col("regle").startswith("CUSTOM-"))


def rule_durations(verdicts: DataFrame) -> DataFrame:
    """Per rule with known durations: count, mean, maximum and minimum; slowest first."""
    out = verdicts.filter("duree is not null").groupBy("regle").agg(F.count(F.lit(1)).alias("nb"), F.round(F.avg("duree"), 6).alias("moyenne"), F.max("duree").alias("maximum"), F.min("duree").alias("minimum"))
    return out.orderBy(F.desc("moyenne"), "regle")


def rule_corrections(verdicts: DataFrame, since) -> DataFrame:
    """Per rule since a day: all, corrected, false positives and negatives, rate; only corrected rules, most false positives first."""
    changed, was = F.col("statut_original").isNotNull() & (F.col("statut_original") != F.col("statut")), F.col("statut_original")
    out = verdicts.filter(F.col("execution") >= since).groupBy("regle").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(changed).alias("corriges"), F.count_if(changed & (was == "NON_CONFORME") & (F.col("statut") == "CONFORME")).alias("faux_positifs"),
        F.count_if(changed & (was == "CONFORME") & (F.col("statut") == "NON_CONFORME")).alias("faux_negatifs"),
    )
    return out.filter("corriges > 0").withColumn("taux", F.round(F.col("corriges") / F.col("total"), 6)).orderBy(F.desc("faux_positifs"), "regle")


def correction_totals(corrections: DataFrame) -> DataFrame:
    return corrections.agg(*[F.sum(c).alias(c) for c in ("corriges", "faux_positifs", "faux_negatifs")])


def traffic_light(verdicts: DataFrame) -> DataFrame:
    """Per file: red with any failure, amber where not all conform, else green; and the share that conforms."""
    bad, good, n = F.count_if(F.col("statut") == "NON_CONFORME"), F.count_if(F.col("statut") == "CONFORME"), F.count(F.lit(1))
    return verdicts.groupBy("dossier_id").agg(F.when(bad > 0, "rouge").when(good < n, "orange").otherwise("vert").alias("feu"), F.round(good * 100 / n).cast("int").alias("pourcent"))


def workflow(dossiers: DataFrame, documents: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per file the steps done: documents there, all extracted, verified, validated."""
    docs = documents.groupBy("dossier_id").agg(F.every("extrait").alias("extraits"))
    seen = verdicts.select("dossier_id").distinct().withColumn("verifie", F.lit(True))
    out = dossiers.join(docs, "dossier_id", "left").join(seen, "dossier_id", "left")
    return out.select("dossier_id", F.col("extraits").isNotNull().alias("charge"), F.coalesce("extraits", F.lit(False)).alias("extrait"), F.coalesce("verifie", F.lit(False)).alias("verifie"), (F.col("statut") == "VALIDE").alias("valide"))


def rates(dossiers: DataFrame) -> DataFrame:
    """One row: percentages of validated and rejected files; null without files."""
    part = lambda s: F.round(F.try_divide(F.count_if(F.col("statut") == s) * 100, F.count(F.lit(1)))).cast("int")
    return dossiers.agg(part("VALIDE").alias("valides"), part("REJETE").alias("rejetes"))


def engagement_stats(engagements: DataFrame) -> DataFrame:
    """Counts and caps by type and status, with totals by type and over all (null)."""
    return engagements.rollup("type", "statut").agg(F.count(F.lit(1)).alias("nb"), F.sum("plafond").cast("double").alias("plafond"))


def engagement_rows(engagements: DataFrame, dossiers: DataFrame) -> DataFrame:
    """Engagements with the number and sum of their files (zero if none) and the percentage of the cap that is used."""
    used = dossiers.filter("engagement_id is not null").groupBy("engagement_id").agg(F.count(F.lit(1)).alias("nb"), F.sum("ttc").alias("consomme"))
    out = engagements.join(used, "engagement_id", "left").withColumn("nb", F.coalesce("nb", F.lit(0))).withColumn("consomme", F.coalesce("consomme", F.lit(0)).cast("decimal(28,2)"))
    return out.withColumn("taux", F.when(F.col("plafond") > 0, F.round(F.round(F.col("consomme") / F.col("plafond"), 4) * 100, 2).cast("double")))


def other_orders_total(dossiers: DataFrame, as_of, months: int = 12) -> DataFrame:
    """Per order file the sum of the supplier's other order files since ``months`` before ``as_of``."""
    recent = (F.col("type") == "BC") & (F.col("date_creation") >= F.add_months(F.lit(as_of).cast("date"), -months))
    key = Window.partitionBy(F.lower(F.trim("fournisseur")))
    own = F.when(recent, F.col("ttc")).otherwise(F.lit(0))
    return dossiers.filter(~blank(F.col("fournisseur"))).withColumn("autres", (F.coalesce(F.sum(F.when(recent, F.col("ttc"))).over(key), F.lit(0)) - own).cast("decimal(28,2)"))


def usage_totals(usage: DataFrame, by: list[Column]) -> DataFrame:
    return usage.groupBy(*by).agg(F.count(F.lit(1)).alias("appels"), F.sum("entree").alias("entree"), F.sum("sortie").alias("sortie"), F.count_if(~F.col("succes")).alias("erreurs"), F.round(F.avg("duree"), 6).alias("duree"))


def usage_cost(usage: DataFrame, prices: DataFrame, fallback: tuple[str, str]) -> DataFrame:
    """Per model: calls, cost (prices are per million tokens; unknown models take the fallback), cost a call and percentage of errors."""
    price = lambda c, other: F.coalesce(c, F.lit(other).cast("decimal(10,4)"))
    rows = usage.join(F.broadcast(prices), "modele", "left")  # a row for each model
    cost = F.sum(F.col("entree") * price(F.col("prix_entree"), fallback[0]) + F.col("sortie") * price(F.col("prix_sortie"), fallback[1])).cast("double") / 1e6
    out = rows.groupBy("modele").agg(F.count(F.lit(1)).alias("appels"), F.round(cost, 6).alias("cout"), F.round(F.count_if(~F.col("succes")) * 100 / F.count(F.lit(1)), 2).alias("erreurs"))
    return out.withColumn("par_appel", F.round(F.col("cout") / F.col("appels"), 8))


def heaviest(usage: DataFrame, dossiers: DataFrame, limit: int) -> DataFrame:
    """The files with most tokens, their reference where the file is known; 1 to 100 rows."""
    sums = usage.filter("dossier_id is not null").groupBy("dossier_id").agg(F.sum(F.col("entree") + F.col("sortie")).alias("jetons"))
    return sums.join(dossiers.select("dossier_id", "reference"), "dossier_id", "left").orderBy(F.desc("jetons"), "dossier_id").limit(max(1, min(100, limit)))


def attach(candidates: DataFrame, engagements: DataFrame) -> DataFrame:
    """From (dossier_id, refs) the engagement whose reference is among them, if exactly one is."""
    found = candidates.select("dossier_id", F.explode("refs").alias("reference")).join(engagements.select("reference", "engagement_id"), "reference")
    return found.groupBy("dossier_id").agg(F.count_distinct("engagement_id").alias("n"), F.min("engagement_id").alias("engagement_id")).filter("n = 1").drop("n")


def full_text(docs: DataFrame, query: str, title: Column, key: str = "doc_id", text: str = "text", limit: int = 50) -> DataFrame:
    """Documents that hold every word of the query in title or text, by rank: a word in the title counts ten, in the text one."""
    wanted = sorted({w for w in query.lower().split() if w})
    tokens = lambda c: F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+")
    times = lambda c, w: F.size(F.filter(tokens(c), lambda t: t == w))
    hits = [10 * times(title, w) + times(F.col(text), w) for w in wanted]
    counted = docs.select(key, *[h.alias(f"n{i}") for i, h in enumerate(hits)])
    ranks = [F.col(f"n{i}") for i in range(len(hits))]
    found = counted.filter(F.least(*ranks, F.lit(10**9)) > 0).select(key, sum(ranks, F.lit(0)).cast("bigint").alias("rang"))
    return found.orderBy(F.desc("rang"), key).limit(limit)


def containing(docs: DataFrame, value: str, title: Column, key: str = "doc_id", text: str = "text", limit: int = 50) -> DataFrame:
    """The fallback: titles or texts that contain the value, newest first, rank 0."""
    like = F.lower(title).contains(value.lower()) | F.lower(F.coalesce(text, F.lit(""))).contains(value.lower())
    return docs.filter(like).select(key, F.lit(0.0).alias("rang")).orderBy(F.desc(key)).limit(limit)


def supplier_identity(dossiers: DataFrame, known: DataFrame) -> DataFrame:
    """Files with their supplier's identity, looked up without regard to case."""
    return dossiers.join(known, F.lower(dossiers["fournisseur"]) == known["cle"], "left")


def duplicates_by_number(invoices: DataFrame, since) -> DataFrame:
    """Pairs of invoices of different files with one number (trimmed, whatever the case); the other since ``since`` or undated."""
    key = F.lower(F.trim("numero"))
    a = invoices.filter(~blank(F.col("numero"))).select(key.alias("cle"), *[F.col(c).alias(f"a_{c}") for c in ("facture_id", "dossier_id")])
    b = invoices.filter(F.col("jour").isNull() | (F.col("jour") >= since)).withColumn("cle", key)
    return a.join(b, "cle").filter("a_dossier_id <> dossier_id").select("a_facture_id", "facture_id")


def audit_trail(log: DataFrame, dossier_id) -> DataFrame:
    """What was done to one file, the newest first."""
    return log.filter(F.col("dossier_id") == dossier_id).orderBy(F.desc("date_action"), F.desc("audit_id"))


def in_order(rows: DataFrame, *order) -> DataFrame:
    """Rows of each file with their place: verdicts by rule, documents by upload."""
    return rows.withColumn("rang", F.row_number().over(Window.partitionBy("dossier_id").orderBy(*order)))


def cascade_scope(rules: list[str], depends: dict[str, list[str]]) -> list[str]:
    """The rules to run again with these: themselves and those that depend on them, one step."""
    return sorted({*rules, *(r for r, needs in depends.items() if set(needs) & set(rules))})


def normalized_names(names: Column) -> Column:
    return scalars.supplier_key(names)
