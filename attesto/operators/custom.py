"""Rules of users: what is asked of them, changes to them, and rules that are predicates over the context."""

from __future__ import annotations

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesto.operators.verdicts import KO, OK, WARN, choose, emit, verdict

#: Longest label and text of a rule.
LABEL, PROMPT = 200, 4000


def listed(rules: DataFrame, enabled_only: bool = False) -> DataFrame:
    """The rules by code."""
    return (rules.filter("enabled") if enabled_only else rules).orderBy("code")


def refusal(request: DataFrame) -> Column:
    """Why a rule (libelle, prompt, severity, bc, contractuel) is refused; null if it is not."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return (
        F.when(blank("libelle"), "LIBELLE").when(blank("prompt"), "PROMPT").when(F.length("libelle") > LABEL, "LIBELLE LONG").when(F.length("prompt") > PROMPT, "PROMPT LONG")
        .when(~F.coalesce(F.col("bc") | F.col("contractuel"), F.lit(False)), "TYPE").when(~F.coalesce(F.col("severity"), F.lit("")).isin("", KO, WARN), "SEVERITE")
    )


def created(rules: DataFrame, requests: DataFrame) -> DataFrame:
    """Asked rules (demande: their order) with their code, the next number after the greatest, or why they are refused.

    Only accepted requests take numbers. Requests of one call are made by people, so they are few and are numbered in one place.
    """
    last = rules.agg(F.max(F.regexp_extract("code", r"^CUSTOM-(\d+)$", 1).try_cast("int"))).head()[0] or 0
    asked = requests.withColumn("refus", refusal(requests))
    number = F.sum(F.when(F.col("refus").isNull(), 1).otherwise(0)).over(Window.orderBy("demande"))
    code = F.when(F.col("refus").isNull(), F.format_string("CUSTOM-%02d", (F.col("numero") + last).cast("int")))
    out = asked.withColumn("numero", number).withColumn("code", code)
    return out.select("demande", "code", "refus", F.trim("libelle").alias("libelle"), F.trim("prompt").alias("prompt"), F.coalesce(F.nullif("severity", F.lit("")), F.lit(KO)).alias("severity"), "bc", "contractuel")


def toggled(rules: DataFrame, changes: DataFrame, key: str = "code") -> DataFrame:
    """The rules after some (``key``, actif) were switched on or off; ``key`` tells rules apart, and a code of too few digits may not."""
    out = rules.join(changes.select(key, "actif"), key, "left")
    return out.withColumn("enabled", F.coalesce("actif", "enabled")).drop("actif")


def without_rule(rows: DataFrame, deleted: DataFrame, column: str = "regle") -> DataFrame:
    """Verdicts, switches or overrides without those of deleted rules (code)."""
    return rows.join(deleted.select(F.col("code").alias(column)).distinct(), column, "left_anti")


def compiled(context: DataFrame, rules: list[tuple[str, str, str]]) -> tuple[list[Column], dict[str, str]]:
    """Verdicts of predicate rules (code, severity, SQL condition over the context), and why the others cannot be run.

    A condition is checked against the context's columns once, before anything runs: an unknown column, an aggregate, a
    subquery or a value that is no truth value refuses its rule and stops no other. A condition that is null gives no row.
    """
    good, bad = [], {}
    for code, severity, condition in rules:
        try:
            if "select" in condition.lower():
                raise ValueError("a subquery is not allowed")
            kind = context.limit(0).select("dossier_id", F.expr(condition).alias("ok")).schema["ok"].dataType.simpleString()
            if kind != "boolean":
                raise ValueError(f"the condition is {kind}, not a truth value")
            good.append(verdict(code, F.when(F.expr(condition).isNotNull(), choose(F.expr(condition), OK, WARN if severity == WARN else KO)), source="CUSTOM"))
        except (AnalysisException, ParseException, ValueError) as error:
            bad[code] = next((line for line in str(error).splitlines() if line.strip()), type(error).__name__)
    return good, bad


def predicate_verdicts(context: DataFrame, rules: list[tuple[str, str, str]]) -> tuple[DataFrame | None, dict[str, str]]:
    """The verdicts of all predicate rules in one pass over the context, and the rules that were refused."""
    good, bad = compiled(context, rules)
    return (emit(context, good) if good else None), bad
