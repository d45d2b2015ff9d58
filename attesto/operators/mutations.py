"""Changes to the tables, as DataFrames of the new state: files, verdicts, corrections, rule switches, engagements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesto.sources.scratch import written

#: Allowed changes of a file's status, rules whose failure forbids validation, rules that rerun with another.
TRANSITIONS = {"BROUILLON": ["EN_VERIFICATION", "VALIDE", "REJETE"], "EN_VERIFICATION": ["VALIDE", "REJETE", "BROUILLON"], "VALIDE": ["BROUILLON"], "REJETE": ["BROUILLON"]}
BLOCKING = ("R01", "R04", "R07", "R11", "R16")


def numbered(rows: DataFrame, column: str, last: int = 0) -> DataFrame:
    """``rows`` with ``numero``, counted on from ``last`` in the order of ``column`` (unique).

    Rows are sorted in ranges, each numbered by itself after the counts of the ranges before it; only these counts reach the driver.
    """
    ranged = written(rows.repartitionByRange(column).withColumn("__part", F.spark_partition_id()), "numbered")
    starts, sofar = [], last
    for part, n in sorted(ranged.groupBy("__part").count().collect()):
        starts, sofar = [*starts, (part, sofar)], sofar + n
    starts = rows.sparkSession.createDataFrame(starts, "__part int, __start bigint")
    out = ranged.join(F.broadcast(starts), "__part").withColumn("numero", F.col("__start") + F.row_number().over(Window.partitionBy("__part").orderBy(column)))
    return out.drop("__part", "__start")


def created(new: DataFrame, year: int, last: int) -> DataFrame:
    """New files with their number, on from ``last`` in the order of dossier_id, and the reference that shows its last five digits."""
    return numbered(new, "dossier_id", last).withColumn("reference", F.format_string(f"DOS-{year}-%05d", F.col("numero") % 100_000))


def merged(rows: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows after an update: fields that the change leaves null stay."""
    fields = [c for c in changes.columns if c != key]
    out = rows.join(changes.select(key, *[F.col(c).alias(f"nouveau_{c}") for c in fields]), key, "left")
    return out.select(key, *[F.coalesce(f"nouveau_{c}", c).alias(c) if c in fields else F.col(c) for c in rows.columns if c != key])


def upserted(rows: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with those of ``changes`` in place of rows with the same keys."""
    return rows.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes, allowMissingColumns=True)


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """The rows that a cascading delete leaves."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def retyped(documents: DataFrame, changes: DataFrame, typed: tuple[str, ...] = ("montant",)) -> DataFrame:
    """Documents after a change of type: the ``typed`` fields are emptied and extraction starts again; all others stay as they are."""
    nouveau = changes.select(F.col("document_id").alias("__changed"), F.col("type").alias("__type"))
    changed = F.coalesce(F.col("__type") != F.col("type"), F.lit(False))
    value = {name: F.when(~changed, F.col(name)) for name in typed} | {"type": F.coalesce("__type", "type"), "statut_extraction": F.when(changed, "EN_ATTENTE").otherwise(F.col("statut_extraction"))}
    return documents.join(nouveau, F.col("document_id") == F.col("__changed"), "left").select(*[value.get(n, F.col(n)).alias(n) for n in documents.columns])


def overridden(verdicts: DataFrame, overrides: DataFrame) -> DataFrame:
    """Verdicts after a person set some (dossier_id, regle, nouveau); the first original status is kept."""
    out = verdicts.join(overrides, ["dossier_id", "regle"], "left")
    set_ = F.col("nouveau").isNotNull()
    return out.withColumn("statut_original", F.when(set_, F.coalesce("statut_original", "statut")).otherwise(F.col("statut_original"))).withColumn("statut", F.coalesce("nouveau", "statut")).drop("nouveau")


def rerun(old: DataFrame, fresh: DataFrame, scope: list[str], corrected: list[str]) -> DataFrame:
    """The verdicts after the rules of ``scope`` ran again: fresh ones, on which a person's status is set again unless the rule's data were corrected."""
    kept = old.filter(~F.col("regle").isin(*scope))
    by_hand = old.filter(F.col("regle").isin(*scope) & F.col("statut_original").isNotNull() & ~F.col("regle").isin(*(corrected or [""]))).select("dossier_id", "regle", F.col("statut").alias("force"))
    again = fresh.filter(F.col("regle").isin(*scope)).join(by_hand, ["dossier_id", "regle"], "left")
    again = again.withColumn("statut_original", F.when(F.col("force").isNotNull(), F.col("statut"))).withColumn("statut", F.coalesce("force", "statut")).drop("force")
    return kept.unionByName(again, allowMissingColumns=True)


def corrected_values(corrections: DataFrame, changes: DataFrame) -> DataFrame:
    """Corrections (document_id, champ, valeur, originale) after new ones: the last value counts, the first original is kept."""
    both = corrections.withColumn("ordre", F.lit(0)).unionByName(changes.withColumn("ordre", F.lit(1)))
    return both.groupBy("document_id", "champ").agg(F.max_by("valeur", "ordre").alias("valeur"), F.min_by("originale", "ordre").alias("originale"))


def transitions(dossiers: DataFrame, asked: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Outcome of asked status changes (dossier_id, demande): statut, ok, and why not; one row for each, none fails the batch."""
    allowed = F.lit(None).cast("array<string>")
    for status, to in TRANSITIONS.items():
        allowed = F.when(F.col("statut") == status, F.array(*map(F.lit, to))).otherwise(allowed)
    blockers = verdicts.filter(F.col("regle").isin(*BLOCKING) & (F.col("statut") == "NON_CONFORME")).groupBy("dossier_id").agg(F.array_join(F.array_sort(F.collect_set("regle")), ",").alias("bloquants"))
    out = asked.join(dossiers.select("dossier_id", "statut"), "dossier_id", "left").join(blockers, "dossier_id", "left")
    why = F.when(F.col("statut").isNull(), "INCONNU").when(~F.array_contains(allowed, F.col("demande")), "TRANSITION").when((F.col("demande") == "VALIDE") & F.col("bloquants").isNotNull(), F.concat(F.lit("BLOQUE "), F.col("bloquants")))
    return out.select("dossier_id", F.when(why.isNull(), F.col("demande")).otherwise(F.col("statut")).alias("statut"), why.isNull().alias("ok"), why.alias("motif"))


def with_invoice_totals(dossiers: DataFrame, invoices: DataFrame) -> DataFrame:
    """Files with the totals of their invoice; a supplier that is there stays."""
    first = invoices.select("dossier_id", F.col("ttc").alias("f_ttc"), F.col("fournisseur").alias("f_fournisseur"))
    out = dossiers.join(first, "dossier_id", "left")
    return out.withColumn("ttc", F.coalesce("f_ttc", "ttc")).withColumn("fournisseur", F.coalesce("fournisseur", "f_fournisseur")).drop("f_ttc", "f_fournisseur")


def attachable(asked: DataFrame, engagements: DataFrame) -> DataFrame:
    """Asked attachments (dossier_id, engagement_id) with ok: the engagement is there and not closed."""
    out = asked.join(engagements.select("engagement_id", "statut"), "engagement_id", "left")
    return out.select("dossier_id", "engagement_id", F.coalesce(F.col("statut") != "CLOTURE", F.lit(False)).alias("ok"))


def deletable(engagements: DataFrame, dossiers: DataFrame) -> DataFrame:
    """The engagements that no file refers to."""
    return engagements.join(dossiers.select("engagement_id"), "engagement_id", "left_anti")


def finalized(dossiers: DataFrame, done: DataFrame) -> DataFrame:
    out = dossiers.join(done.select("dossier_id").distinct().withColumn("fini", F.lit(True)), "dossier_id", "left")
    return out.withColumn("statut", F.when(F.col("fini"), "VALIDE").otherwise(F.col("statut"))).drop("fini")


def next_rule_code(rules: DataFrame) -> DataFrame:
    """One row: the code of the next prompt rule."""
    return rules.agg(F.format_string("CUSTOM-%02d", F.coalesce(F.max(F.regexp_extract("code", r"^CUSTOM-(\d+)$", 1).try_cast("int")), F.lit(0)) + 1).alias("code"))


def referenced(verdicts: DataFrame, documents: DataFrame, types: dict[str, list[str]]) -> DataFrame:
    """Verdicts with the documents of the types that their rule reads, where they name none."""
    rule_types: Column = F.create_map(*[x for rule, names in types.items() for x in (F.lit(rule), F.array(*map(F.lit, names)))])
    wanted = verdicts.select("dossier_id", "regle", F.explode(F.element_at(rule_types, F.col("regle"))).alias("type"))
    found = wanted.join(documents.select("dossier_id", "type", "document_id"), ["dossier_id", "type"]).groupBy("dossier_id", "regle").agg(F.array_join(F.transform(F.array_sort(F.collect_set("document_id")), lambda x: x.cast("string")), ",").alias("document_ids"))
    return verdicts.join(found, ["dossier_id", "regle"], "left")
