"""From uploads to verdicts: each batch of documents is taken in, its files' rules run, and their verdicts replaced."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesto.operators import rules, typed
from attesto.operators.verdicts import emit
from attesto.sources.buckets import Buckets
from attesto.sources.scratch import written


def take_in(uploads: DataFrame, pieces: Buckets, verdicts: Buckets, context_of: Callable[[DataFrame, DataFrame], DataFrame], files: DataFrame) -> None:
    """Takes one batch of extracted documents (document_id, dossier_id, type, upload, data, and their content's digest ``empreinte``).

    Of equal contents in a file the first counts, within the batch and against what is stored. Then the rules run over all documents of
    the files that got one, and their verdicts replace the old ones; verdicts of prompt rules (``CUSTOM-``) stay. Both tables are
    replaced by file, so a batch that is taken again, whole or after a failure anywhere, leaves the same rows.
    """
    batch = written(uploads, "batch")
    touched = batch.select("dossier_id").distinct()
    stored = pieces.read(touched)
    mine = None if stored is None else stored.join(touched, "dossier_id", "left_semi")
    both = batch.withColumn("deja", F.lit(0)) if mine is None else mine.withColumn("deja", F.lit(1)).unionByName(batch.withColumn("deja", F.lit(0)), allowMissingColumns=True)
    first = both.groupBy("dossier_id", "empreinte").agg(F.min_by(F.struct(*batch.columns), F.struct(-F.col("deja"), F.col("upload"), F.col("document_id"))).alias("d")).select("d.*")
    kept = written(first, "kept")
    pieces.replace(kept, touched)
    rows = context_of(typed.dossier_rows(kept), files.join(touched, "dossier_id", "left_semi"))
    fresh = emit(rows, [rule for family in rules.FAMILIES.values() for rule in family()])
    old = verdicts.read(touched)
    custom = None if old is None else old.join(touched, "dossier_id", "left_semi").filter(F.col("regle").startswith("CUSTOM-"))
    verdicts.replace(fresh if custom is None else fresh.unionByName(custom, allowMissingColumns=True), touched)


def start(uploads: DataFrame, checkpoint: str, **take) -> object:
    """Starts the stream; what is there is taken in batches, and the query ends when it is done."""
    return uploads.writeStream.foreachBatch(lambda batch, _: take_in(batch, **take)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
