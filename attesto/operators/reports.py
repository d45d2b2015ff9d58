"""Reporting queries: counts and sums by status, supplier, day and rule; search and paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_status(files: DataFrame, status: str, amount: Column) -> DataFrame:
    return files.groupBy(F.col(status).alias("statut")).agg(F.count(F.lit(1)).alias("nb"), F.coalesce(F.sum(amount), F.lit(0)).cast("double").alias("total"))


def dashboard(files: DataFrame, status: str, amount: Column, states: dict[str, str]) -> DataFrame:
    """One row: a counter for each state, the number of files and their sum."""
    return files.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(status) == v).alias(k) for k, v in states.items()], F.sum(amount).cast("double").alias("montant"))


def by_supplier(files: DataFrame, supplier: str, status: str, amount: Column, day: str, done: str) -> DataFrame:
    return files.filter(F.col(supplier).isNotNull()).groupBy(F.col(supplier).alias("fournisseur")).agg(
        F.count(F.lit(1)).alias("nb"), F.count_if(F.col(status) == done).alias("valides"), F.sum(amount).cast("double").alias("total"),
        F.coalesce(F.sum(F.when(F.col(status) == done, amount)), F.lit(0)).cast("double").alias("total_valide"), F.to_date(F.max(day)).alias("dernier"), F.to_date(F.min(day)).alias("premier"),
    )


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def corrections_by(df: DataFrame, rule: Column, system: Column, human: Column) -> DataFrame:
    """Per rule: checks, corrections, false positives and negatives; rules that were never corrected are left out."""
    out = df.groupBy(rule.alias("regle")).agg(F.count(F.lit(1)).alias("total"), F.count_if(system != human).alias("corriges"), F.count_if((system == 1) & (human == 0)).alias("faux_positifs"), F.count_if((system == 0) & (human == 1)).alias("faux_negatifs"))
    return out.filter("corriges > 0").withColumn("taux", F.round(F.col("corriges") / F.col("total"), 6))


def fill_days(daily: DataFrame, day: str, counters: list[str]) -> DataFrame:
    """Missing days between the first and the last, with zeros."""
    days = daily.agg(F.explode(F.sequence(F.min(day), F.max(day))).alias(day))
    return days.join(daily, day, "left").select(day, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in counters])


def search(files: DataFrame, equal: dict[str, object] | None = None, like: dict[str, str] | None = None) -> DataFrame:
    """Optional filters: equality, and containment without regard to case; absent ones do not filter."""
    for column, value in (equal or {}).items():
        files = files if value is None else files.filter(F.col(column) == value)
    for column, value in (like or {}).items():
        files = files if value is None else files.filter(F.lower(column).contains(value.lower()))
    return files


def page(df: DataFrame, by: list[Column], number: int, size: int = 20) -> DataFrame:
    return df.orderBy(*by).offset(number * size).limit(size)

