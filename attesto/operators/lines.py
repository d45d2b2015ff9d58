"""R01g: invoice lines matched greedily with the lines of the order or the price grid."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.functions import scalars
from attesto.operators.verdicts import KO, OK, RELATIVE, TOLERANCE

#: Similarity of two designations above which lines may match.
ALIKE = 0.60


def _prepared(rows: DataFrame, n: str, trim: bool) -> DataFrame:
    """Lines with what pairs are judged by, worked out once a line: code, label and its words."""
    label = scalars.normalize_label(F.col("designation"))
    code = F.nullif(F.lower(F.trim("code") if trim else F.col("code")), F.lit(""))
    out = rows.select("dossier_id", F.col("ligne").alias(n), code.alias(f"code_{n}"), label.alias(f"label_{n}"), *[F.col(c).alias(f"{c}_{n}") for c in ("quantite", "pu", "total")])
    return out.withColumn(f"words_{n}", F.array_distinct(F.filter(F.split(f"label_{n}", " "), lambda w: F.length(w) >= 2)))


def candidates(lines: DataFrame, references: DataFrame) -> DataFrame:
    """(dossier_id, l, r, score, differe): pairs of one file's lines and reference lines; codes that agree whatever the case score 2, else the similarity of the designations above ``ALIKE``."""
    pairs = _prepared(lines, "l", True).join(_prepared(references, "r", False), "dossier_id")

    def score(both: Column) -> Column:
        union = F.size("words_l") + F.size("words_r") - both
        alike = F.when((F.col("label_l") == "") | (F.col("label_r") == ""), 0.0).when(F.col("label_l") == F.col("label_r"), 1.0).when(union == 0, 0.0).otherwise(both / union)
        return F.when(F.col("code_l") == F.col("code_r"), 2.0).when(alike > ALIKE, alike)

    off = lambda c, limit: F.coalesce(F.abs(F.col(f"{c}_l") - F.col(f"{c}_r")) > limit, F.lit(False))
    price = F.greatest(F.lit(TOLERANCE), F.greatest(F.abs("pu_r"), F.lit(1)).cast("double") * RELATIVE)
    differ = off("quantite", TOLERANCE) | off("pu", price) | off("total", TOLERANCE)
    once = scalars.once(F.size(F.array_intersect("words_l", "words_r")), score)  # the words of a pair are met once, however often the score names them
    scored = pairs.select("dossier_id", "l", "r", once.alias("score"), differ.alias("differe"))
    return scored.filter("score is not null")


def greedy(pairs: DataFrame) -> DataFrame:
    """(dossier_id, l, r, differe): in line order each line takes its best reference line that is still free, the first on ties.

    Sequential within a file: the pairs of a file come to one task in this order, and one pass keeps only the reference
    lines that the present file has taken.
    """

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        file, line, taken, done = None, None, set(), False
        for frame in frames:
            keep = []
            for d, own, r in zip(frame["dossier_id"].tolist(), frame["l"].tolist(), frame["r"].tolist(), strict=True):
                if d != file:
                    file, line, taken = d, None, set()
                if own != line:
                    line, done = own, False
                new = not done and r not in taken
                if new:
                    taken.add(r)
                    done = True
                keep.append(new)
            yield frame.loc[keep, ["dossier_id", "l", "r", "differe"]]

    ordered = pairs.repartition("dossier_id").sortWithinPartitions("dossier_id", "l", F.desc("score"), "r")
    return ordered.mapInPandas(assign, "dossier_id bigint, l int, r int, differe boolean")


def line_verdicts(lines: DataFrame, references: DataFrame, whole: bool = True) -> DataFrame:
    """Per file with lines on both sides: statut, and how many lines are unmatched, differ, or (``whole``) miss in the invoice."""
    found = greedy(candidates(lines, references)).groupBy("dossier_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("differe").alias("differentes"))
    own, there = lines.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("own")), references.groupBy("dossier_id").agg(F.count(F.lit(1)).alias("there"))
    out = own.join(there, "dossier_id").join(found, "dossier_id", "left").fillna(0, ["n", "differentes"])
    out = out.withColumn("sans_reference", F.col("own") - F.col("n")).withColumn("manquantes", F.when(F.lit(whole), F.col("there") - F.col("n")).otherwise(0))
    return out.select("dossier_id", F.when(F.col("sans_reference") + F.col("differentes") + F.col("manquantes") > 0, KO).otherwise(OK).alias("statut"), "sans_reference", "differentes", "manquantes")
