"""Correct and run again: a person's corrections of fields, the rules that they touch, and the verdicts afterwards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesto.operators import rules, typed
from attesto.operators.verdicts import emit

#: The rules that run again with a rule.
DEPENDENCIES = {
    "R01": ["R02", "R03", "R03b"], "R02": ["R01", "R03", "R03b"], "R03": ["R01", "R02", "R03b", "R30"], "R03b": ["R01", "R02", "R03", "R30"], "R04": ["R05", "R16"], "R05": ["R04", "R06", "R16"], "R06": ["R05", "R06b"], "R06b": ["R06"],
    "R07": ["R08"], "R08": ["R07"], "R09": ["R09b", "R10"], "R09b": ["R09"], "R10": ["R09", "R09b"], "R11": ["R14"], "R14": ["R11"], "R15": ["R16", "R04"], "R16": ["R04", "R05", "R15", "R16b", "R16c"], "R16b": ["R16", "R16c"],
    "R16c": ["R16", "R16b", "R01f"], "R01f": ["R01", "R02", "R16c", "R01g"], "R01g": ["R01", "R02", "R01f", "R15"], "R14b": ["R09", "R09b", "R10", "R14"], "R17a": ["R17b"], "R17b": ["R17a"], "R18": ["R23"], "R22": ["R25"], "R23": ["R18"],
    "R25": ["R22"], "R30": ["R03", "R03b"],
}


def scope_of(rule: str) -> list[str]:
    """The rules that run when ``rule`` is run again: one step of dependencies; a point of the checklist brings all of it."""
    points = ["R12", *(f"R12.{i:02d}" for i in range(1, 11))] if rule == "R12" or rule.startswith("R12.") else []
    return sorted({rule, *DEPENDENCIES.get(rule, []), *points})


def families_of(codes: set[str]) -> list[str]:
    """The families that hold these rules; the others are not evaluated."""
    return [family for family in rules.FAMILIES if codes & set(rules.CODES[family])]


def with_corrections(pieces: DataFrame, corrections: DataFrame) -> DataFrame:
    """Documents with the latest correction (document_id, champ, valeur; rang: its order) of each field, as a map that ``typed.parsed`` lays over what was read."""
    last = corrections.groupBy("document_id", "champ").agg(F.max_by("valeur", "rang").alias("valeur"))
    maps = last.groupBy("document_id").agg(F.map_from_entries(F.collect_list(F.struct("champ", "valeur"))).alias("corrections"))
    return pieces.join(maps, "document_id", "left")


def rerun_files(asked: DataFrame, pieces: DataFrame, corrections: DataFrame, files: DataFrame, old: DataFrame, context_of, fields_of=None) -> DataFrame:
    """The verdicts of the touched files after rules were run again for them; those of other files are not read.

    ``asked``: dossier_id, regle, frais (whether fields were corrected along with it); ``pieces``, ``files`` and ``old``: documents, what is
    known of the files, and verdicts with statut_original, of the touched files at least; ``corrections``: all of them. Only rules
    in the scope of an asked one are replaced, and rules outside of it stay as they are. A status that a person set stays on the
    fresh verdict, unless the rule's data were corrected. ``context_of``: ``plans.context.from_documents``. With
    ``fields_of`` (of ``plans.context``), only what the rules of the families that run again look at is read; ``pieces`` may lack the rest.
    """
    touched = asked.select("dossier_id").distinct()
    here = lambda df: df.join(F.broadcast(touched) if small else touched, "dossier_id", "left_semi")
    small = touched.limit(100_001).count() <= 100_000  # else a shuffle
    codes = {r.regle for r in asked.select("regle").distinct().collect()}  # at most as many as there are rules
    steps = [(code, other) for code in codes for other in scope_of(code)]
    scope = asked.join(F.broadcast(asked.sparkSession.createDataFrame(steps, "regle string, cible string")), "regle")
    scope = scope.groupBy("dossier_id", F.col("cible").alias("regle")).agg(F.max("frais").alias("frais"))
    families = families_of({other for _, other in steps})
    columns = rules.reads(*families) if fields_of else None
    rows = context_of(typed.dossier_rows(with_corrections(here(pieces), corrections), fields_of(columns) if fields_of else None), here(files), columns=columns)
    made = emit(rows, [rule for family in families for rule in rules.FAMILIES[family]()])
    fresh = made.join(scope, ["dossier_id", "regle"])
    mine = here(old)
    kept = mine.join(scope, ["dossier_id", "regle"], "left_anti")
    by_hand = mine.filter("statut_original is not null").join(scope.filter("not frais"), ["dossier_id", "regle"], "left_semi").groupBy("dossier_id", "regle").agg(F.max("statut").alias("force"))
    again = fresh.join(by_hand, ["dossier_id", "regle"], "left")
    again = again.withColumn("statut_original", F.when(F.col("force").isNotNull(), F.col("statut"))).withColumn("statut", F.coalesce("force", "statut"))
    return kept.unionByName(again.select(*[c for c in old.columns if c in again.columns]), allowMissingColumns=True)
