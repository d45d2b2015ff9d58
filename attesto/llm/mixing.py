"""Mixing sources to target weights by iterative proportional fitting.

Token counts of the cells (source, language, topic) are raked until the sums over each of the three match their
target shares. A document is then kept with the probability of its cell, by a hash of its id. Probabilities are
calibrated so that the expected tokens of the sample are a given share of all: cells that would need more than they
have are kept whole, and the others share the rest in the raked proportions.

Edge cases: null attributes form a category of their own; null and empty texts count one token; values without a
target keep their own share; targets without documents are left out and the others scaled up; repeated rows share
one decision; an empty table gives an empty result. Targets that no weights meet together (a source with one language
that differs in share) leave a gap, of which a warning tells. Columns named like those that ``mix`` adds are replaced.
"""

from __future__ import annotations

import warnings

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesto.llm.scratch import bounded_batches, stage

MISSING = "∅"
SWEEPS, ROUNDS, TOLERANCE = 5, 20, 1e-6


#: Bytes that separate words, and those whose share of the characters gives the form of a text, with that share.
BLANKS = b" \n\t\r"
FORMS = {"symbols": (b"*%$#&!@", 0.05), "tabular": (b"|\t;", 0.03), "figures": (b"0123456789", 0.1)}
SHORT = 200


def form_of(text: str | None) -> tuple[int, str]:
    """Words, counted by their blanks (one at least), and a coarse topic by form: ``symbols``, ``tabular``, ``figures``, ``short`` or ``prose``. The bytes are counted in one pass."""
    counts = np.bincount(np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    chars = int(counts.sum() - counts[0x80:0xC0].sum())  # without continuation bytes
    for name, (marks, share) in FORMS.items():
        if counts[list(marks)].sum() / max(chars, 1) > share:
            return int(counts[list(BLANKS)].sum()) + 1, name
    return int(counts[list(BLANKS)].sum()) + 1, "short" if chars < SHORT else "prose"


def forms(text: Column) -> Column:
    """A struct of ``tokens`` and ``topic`` of each text."""

    @F.pandas_udf("struct<tokens: bigint, topic: string>")
    def form(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([form_of(t) for t in texts], columns=["tokens", "topic"])

    return form(text)


def rake(cells: DataFrame, dims: list[str], targets: dict[str, dict[str, float]] | None, power: float) -> DataFrame:
    """``cells`` (``dims``, tokens) with ``weight``: raked token shares.

    ``targets`` has shares by dimension and value; a dimension without gets its token shares to the ``power``, made
    to sum to 1, which lifts small sources and tempers large ones.
    """
    spark, out = cells.sparkSession, cells.filter("tokens > 0").withColumn("weight", F.col("tokens").cast("double"))
    whole = Window.partitionBy(F.lit(0))
    for d in dims:
        own = out.groupBy(d).agg(F.sum("weight").alias("own"))
        own = own.withColumn("share", F.col("own") / F.sum("own").over(whole))
        if targets and d in targets:
            given = spark.createDataFrame(list(targets[d].items()), f"`{d}` string, given double")
            own = own.join(given, d, "left").withColumn("raw", F.coalesce("given", "share"))
        else:
            own = own.withColumn("raw", F.pow("share", F.lit(power)))
        out = out.join(own.select(d, (F.col("raw") / F.sum("raw").over(whole)).alias(f"t_{d}")), d)
    out = stage(out.withColumn("weight", F.col("weight") / F.sum("weight").over(whole)), "cells")
    for _ in range(ROUNDS):
        for _ in range(SWEEPS):
            for d in dims:
                out = out.withColumn("weight", F.when(F.col(f"t_{d}") > 0, F.col("weight") * F.col(f"t_{d}") / F.sum("weight").over(Window.partitionBy(d))).otherwise(0.0))
        out = stage(out, "raked")
        gaps = [out.groupBy(d).agg(F.abs(F.sum("weight") - F.first(f"t_{d}")).alias("gap")).agg(F.max("gap").alias("gap")) for d in dims]
        gap = max(g.head()["gap"] or 0.0 for g in gaps)
        if gap < TOLERANCE:
            break
    else:
        warnings.warn(f"targets cannot be met together: after {SWEEPS * ROUNDS} sweeps a share is off by {gap:.2g}", stacklevel=2)
    return out.select(*dims, "tokens", "weight")


def calibrate(cells: DataFrame, share: float) -> float:
    """The factor by which ratios become probabilities, so that the expected tokens are ``share`` of all.

    Cells in descending order of ratio: the first at which the budget left, spread over what remains, gives no
    probability above 1 sets the factor. The table has a row for each cell, not for each document.
    """
    order = Window.orderBy(F.desc("ratio")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    spent, left = F.coalesce(F.sum("tokens").over(order), F.lit(0)), F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(order), F.lit(0.0))
    tried = cells.withColumn("factor", (F.lit(share) * F.sum("tokens").over(whole) - spent) / left)
    return tried.filter("ratio > 0 and factor * ratio <= 1").agg(F.min_by("factor", F.struct(-F.col("ratio")))).head()[0] or 0.0


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, power: float = 0.8, share: float = 0.6, seed: int = 11, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", topic: Column | None = None) -> DataFrame:
    """``docs`` with ``__source``, ``__lang``, ``__topic``, ``__tokens``, ``__weight``, ``__probability`` and ``__kept``."""
    dims = ["__source", "__lang", "__topic"]
    bounded_batches(docs.sparkSession)
    named = (
        docs.withColumn("__source", F.coalesce(docs[source_col].cast("string"), F.lit(MISSING)))
        .withColumn("__lang", F.coalesce(docs[lang_col].cast("string"), F.lit(MISSING)))
        .withColumn("__form", forms(docs[text_col]))
        .withColumn("__topic", F.coalesce((F.col("__form.topic") if topic is None else topic).cast("string"), F.lit(MISSING)))
        .withColumn("__tokens", F.col("__form.tokens"))
        .drop("__form")
    )
    cells = stage(named.groupBy(*dims).agg(F.sum("__tokens").alias("tokens")), "tokens")
    renamed = {f"__{k}": v for k, v in (targets or {}).items()}
    raked = stage(rake(cells, dims, renamed or None, power).withColumn("ratio", F.col("weight") / F.col("tokens")), "weights")
    scale = calibrate(raked, share)
    cells = raked.select(*dims, F.col("weight").alias("__weight"), F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)).alias("__probability"))
    draw = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), docs[id_col]), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return named.join(stage(cells, "probabilities"), dims, "left").withColumn("__kept", F.coalesce(draw < F.col("__probability"), F.lit(False)))
