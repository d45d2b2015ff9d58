"""Exact deduplication by a stateful stream.

The state, kept on disk by RocksDB and never expired, holds for each digest the identifier of the row that stays, a
locator of its content and the number of rows seen. Digests only propose: rows that hit an existing digest are
compared with the full bytes of the row that stays, and texts that share a digest but differ get groups of their own.

Edge cases: a null text counts as empty; a null id sorts below all others; of repeated rows (same id and text) one
stays; an empty table gives an empty result; further columns are kept by ``drop_exact_duplicates`` and ignored by
``exact_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.llm.scratch import fresh, shared_dir, stage

#: The state store; without preallocation, as there are many small stores.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
#: Digests (32 bytes each) up to which the repeated ones are broadcast.
BROADCAST = 200_000


def text_digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, null counted as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def fold_into_state(arrivals: DataFrame, state_path: str, max_files: int = 1000) -> DataFrame:
    """Streams ``arrivals`` (a staged table with digest, id, row, place) into the state at ``state_path`` and returns the state.

    A later call with the same path and a table written to the same folder goes on from the state that is there.
    The count and the largest row are partially aggregated before the shuffle, so a hot digest costs one row a task.
    """
    spark = arrivals.sparkSession
    source = arrivals.inputFiles()
    folder = source[0].rsplit("/", 1)[0] if source else None
    if folder is None:
        return spark.createDataFrame([], "digest binary, keeper struct<id:bigint,row:bigint,place:string>, group_size bigint")
    before = {k: spark.conf.get(k, None) for k in STORE}
    for k, v in STORE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(arrivals.schema).option("maxFilesPerTrigger", max_files).parquet(folder)
        seen = stream.groupBy("digest").agg(F.max(F.struct("id", "row", "place")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        run = seen.writeStream.outputMode("update").format("noop").option("checkpointLocation", state_path).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(state_path)
    names = state.schema["value"].dataType.names
    return state.select("key.digest", F.col("value")[names[0]].alias("keeper"), F.col("value")[names[1]].alias("group_size"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Column | None = None) -> DataFrame:
    """One row for each input row: id, row, digest, sha256, keep_id, group_size, kept.

    ``digest`` replaces SHA-256 as the key of the state (tests pass a weak one to force collisions).
    """
    key = text_digest(docs[text_col]) if digest is None else digest
    rows = stage(
        docs.select(
            key.alias("digest"), docs[id_col].cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.input_file_name().alias("place"), text_digest(docs[text_col]).alias("sha"),
        ),
        "digests",
    )
    groups = stage(fold_into_state(rows, shared_dir(docs.sparkSession, "state")), "groups")
    hot = groups.filter("group_size > 1").select("digest", F.col("keeper.id").alias("keep"))
    if hot.limit(BROADCAST + 1).count() <= BROADCAST:
        hot = F.broadcast(hot)  # else a shuffle of all texts
    hits = docs.select(key.alias("digest"), docs[id_col].cast("bigint").alias("id"), F.coalesce(docs[text_col], F.lit("")).alias("text")).join(hot, "digest")
    first = hits.filter(F.col("id").eqNullSafe(F.col("keep"))).groupBy("digest").agg(F.min("text").alias("stays"))
    clash = stage(hits.join(first, "digest").filter("text <> stays").select("digest").distinct(), "clashes")
    named = rows.join(groups, "digest")
    if clash.head(1):  # texts that differ under one digest: regroup them by their full text
        texts = docs.select(
            key.alias("digest"), docs[id_col].cast("bigint").alias("id"), F.monotonically_increasing_id().alias("row"),
            F.input_file_name().alias("place"), text_digest(docs[text_col]).alias("sha"), F.coalesce(docs[text_col], F.lit("")).alias("text"),
        )
        texts = stage(texts.join(clash, "digest", "left_semi"), "clashing")
        again = texts.groupBy("digest", "text").agg(F.max(F.struct("id", "row", "place")).alias("keeper"), F.count(F.lit(1)).alias("group_size"))
        named = named.join(clash, "digest", "left_anti").unionByName(texts.join(again, ["digest", "text"]).select(named.columns))
    return named.select(
        "id", "row", "digest", F.lower(F.hex("sha")).alias("sha256"), F.col("keeper.id").alias("keep_id"),
        F.col("group_size").cast("bigint").alias("group_size"), (F.col("row") == F.col("keeper.row")).alias("kept"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of equal texts that with the largest id."""
    kept = stage(exact_groups(docs, id_col, text_col).filter("kept").select(F.col("digest").alias("kept_digest"), F.col("id").alias("kept_id")), "kept")
    own = fresh("digest", docs)
    marked = docs.withColumn(own, text_digest(docs[text_col]))
    stays = marked.join(kept, (marked[own] == kept["kept_digest"]) & marked[id_col].cast("bigint").eqNullSafe(kept["kept_id"]), "left_semi")
    twins = docs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").head(1)
    if twins:  # repeated rows: one of each stays
        stays = stays.dropDuplicates([own])
    return stays.drop(own)
