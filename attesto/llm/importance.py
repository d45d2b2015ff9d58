"""Target-distribution importance resampling through an integer word dictionary.

Texts are cut into words and chunks (some millions of characters each). A chunk lists its distinct words once and holds
its texts as numbers into that list; a dictionary maps each distinct word of all texts to an integer id, so n-grams
are tuples of ids. Each distinct tuple is put back into bytes and hashed once, its counts in the documents and in the
target are summed, and the gain of its bucket goes back to the chunks by a join on the tuple. What is shuffled is one
row for each distinct n-gram of a chunk, so no word, however common, has more rows than there are chunks.

Edge cases: a null text has no words, no features and weight 0; a null id is hashed as an empty text; repeated rows are
separate rows and rows with equal score and id have ranks next to each other, in any order; without documents, or where
the share comes to none, nothing is drawn; an empty target gives every bucket t = 0; other columns are ignored by
``score_documents`` and kept by ``resample``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesto.llm.bpe import pack, unpack
from attesto.llm.scratch import bounded_batches, discard, stage

#: Words, over UTF-8 bytes with A-Z lower-cased: runs of letters and digits of ASCII and of all bytes above it.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of text after which a chunk ends (a longer text is a chunk of its own).
CHUNK_BYTES = 16 << 20
#: Texts after which a chunk ends.
CHUNK_TEXTS = 20_000
#: Texts, then distinct features: numbers packed a text, then a row for each number.
CHUNK_ROWS = "chunk bigint, is_text boolean, id bigint, n_words bigint, numbers binary, number int, n bigint"


def words_of(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "replace").lower()) if isinstance(text, str) else []


def _rows(chunk: int, ids: list, sizes: list[int], numbers: list[np.ndarray], n: int) -> tuple[pd.DataFrame, np.ndarray]:
    """The rows of a chunk with ``n`` distinct features, and the order of the features: frequent ones get small numbers."""
    used = np.bincount(np.concatenate([*numbers, np.zeros(0, np.int64)]).astype(np.int64), minlength=n)
    order = np.argsort(-used, kind="stable")
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    texts = pd.DataFrame({"chunk": chunk, "is_text": True, "id": pd.array(ids, dtype="Int64"), "n_words": pd.array(sizes, dtype="Int64"), "numbers": [pack(rank[x])[0].tobytes() for x in numbers]})
    features = pd.DataFrame({"chunk": chunk, "is_text": False, "number": pd.array(np.arange(n), dtype="Int32"), "n": pd.array(used[order], dtype="Int64")})
    return pd.concat([texts.astype(object), features.astype(object)], ignore_index=True), order


def _cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chunks of (id, text) rows and their distinct words."""
    from pyspark import TaskContext

    task, made = TaskContext.get().partitionId(), 0
    ids, sizes, numbers, index, size = [], [], [], {}, 0

    def flush() -> pd.DataFrame:
        rows, order = _rows((task << 32) + made, ids, sizes, numbers, len(index))
        words = list(index)
        rows["word"] = [None] * len(ids) + [words[i].decode("utf-8", "replace") for i in order.tolist()]
        return rows.where(rows.notna(), None)

    for frame in frames:
        for row_id, text in zip(frame["id"], frame["text"], strict=True):
            words = words_of(text)
            numbers.append(np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int64, count=len(words)))
            sizes.append(len(words))
            ids.append(None if pd.isna(row_id) else int(row_id))
            size += len(text) if isinstance(text, str) else 0
            if size >= CHUNK_BYTES or len(ids) >= CHUNK_TEXTS:
                yield flush()
                made += 1
                ids, sizes, numbers, index, size = [], [], [], {}, 0
    if ids:
        yield flush()


def _tuples(longest: int):
    """For a chunk, the texts as numbers of n-grams of 1 to ``longest`` words, and the distinct n-grams as tuples of ids."""

    def run(texts: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        of = np.zeros(len(words), dtype=np.int64)
        of[words["number"].to_numpy(dtype=np.int64)] = words["word_id"].to_numpy(dtype=np.int64)
        grams, owner = [], []
        for k, packed in enumerate(texts["numbers"]):
            ids = of[unpack(packed)]
            for m in range(1, min(longest, len(ids)) + 1):
                part = np.full((len(ids) - m + 1, longest), -1, dtype=np.int64)
                part[:, :m] = np.lib.stride_tricks.sliding_window_view(ids, m)
                grams.append(part)
                owner.append(np.full(len(part), k))
        flat, own = np.concatenate([*grams, np.zeros((0, longest), np.int64)]), np.concatenate([*owner, np.zeros(0, np.int64)]).astype(np.int64)
        distinct, number = np.unique(flat, axis=0, return_inverse=True)
        cut = np.split(number.reshape(-1)[np.argsort(own, kind="stable")], np.searchsorted(np.sort(own), np.arange(1, len(texts))))
        rows, order = _rows(int(texts["chunk"].iloc[0]), texts["id"].astype("Int64").tolist(), texts["n_words"].tolist(), cut, len(distinct))
        rows["gram"] = [None] * len(texts) + [[x for x in row if x >= 0] for row in distinct[order].tolist()]
        rows["id"] = rows["id"].astype("Int64")
        return rows.astype(object).where(rows.notna(), None)

    return run


def chunked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(docs[id_col].cast("bigint").alias("id"), docs[text_col].alias("text"))
    return stage(rows.mapInPandas(_cut, f"{CHUNK_ROWS}, word string"), "importance-chunks", "zstd")


def _grams(chunks: DataFrame, dictionary: DataFrame, longest: int) -> tuple[DataFrame, DataFrame]:
    """(chunk, id, n_words, numbers) of the texts and (chunk, number, gram, n) of the distinct n-grams of each chunk."""
    texts = chunks.filter("is_text").select("chunk", "id", "n_words", "numbers")
    found = chunks.filter("not is_text").select("chunk", "number", "n", "word").join(dictionary, "word")
    if longest == 1:
        return texts, found.select("chunk", "number", F.array("word_id").alias("gram"), "n")
    words = found.select(F.col("chunk").alias("own_chunk"), "number", "word_id")
    made = stage(texts.groupBy("chunk").cogroup(words.groupBy("own_chunk")).applyInPandas(_tuples(longest), f"{CHUNK_ROWS}, gram array<bigint>"), "importance-grams", "zstd")
    return made.filter("is_text").select("chunk", "id", "n_words", "numbers"), made.filter("not is_text").select("chunk", "number", "gram", "n")


def _hashed(grams: DataFrame, dictionary: DataFrame, buckets: int) -> DataFrame:
    """(gram, s, t, bucket): each distinct tuple's words are put together again and hashed once."""
    counted = stage(grams.groupBy("gram").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "importance-counts")
    words = counted.select("gram", F.posexplode("gram").alias("at", "word_id")).join(dictionary, "word_id")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"])
    texts = words.groupBy("gram").agg(F.array_join(ordered, " ").alias("feature"))
    return counted.join(texts, "gram").select("gram", "s", "t", (F.crc32(F.col("feature").cast("binary")) % buckets).alias("bucket"))


def bucket_gains(features: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): the log ratio of the target's share of a bucket to the documents', each count plus one, in whole thousandths. At most ``buckets`` rows."""
    sums = features.groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    total = lambda c: F.sum(c).over(Window.partitionBy())
    ratio = (F.col("t") + 1) * (total("s") + buckets) / ((F.col("s") + 1) * (total("t") + buckets))
    return sums.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def _weigh(texts: pd.DataFrame, gains: pd.DataFrame) -> pd.DataFrame:
    """The floored mean gain of each text of a chunk."""
    of = np.zeros(len(gains), dtype=np.int64)
    of[gains["number"].to_numpy(dtype=np.int64)] = gains["gain"].to_numpy(dtype=np.int64)
    features = [unpack(x) for x in texts["numbers"]]
    n = np.array([len(x) for x in features], dtype=np.int64)
    sums = np.array([int(of[x].sum()) for x in features], dtype=np.int64)
    return pd.DataFrame({"id": texts["id"].astype("Int64"), "n_words": texts["n_words"].astype("int64"), "n_features": n, "weight": sums // np.maximum(n, 1)})


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", longest: int = 1, buckets: int = 10_000) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    own = chunked(docs, id_col, text_col)
    aim = chunked(target.select(F.lit(None).cast("bigint").alias("none"), target[target_text].alias("text")), "none", "text")
    words = own.filter("not is_text").select("word").union(aim.filter("not is_text").select("word")).distinct()
    dictionary = stage(words.withColumn("word_id", F.monotonically_increasing_id()), "importance-words")
    texts, grams = _grams(own, dictionary, longest)
    grams = stage(grams, "importance-tuples")
    aimed = _grams(aim, dictionary, longest)[1]
    counts = grams.select("gram", F.col("n").alias("s"), F.lit(0).cast("bigint").alias("t")).union(aimed.select("gram", F.lit(0).cast("bigint"), "n"))
    features = stage(_hashed(counts, dictionary, buckets), "importance-features")
    gains = F.broadcast(bucket_gains(features, buckets))
    back = grams.select("chunk", "number", "gram").join(features.select("gram", "bucket"), "gram").join(gains, "bucket").select("chunk", "number", "gain")
    weighed = texts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInPandas(_weigh, "id bigint, n_words bigint, n_features bigint, weight bigint")
    weighed = stage(weighed, "importance-weights")
    discard(own, aim, grams, features, dictionary)
    return weighed


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (with score and id) and their place among the ``k`` highest scores, null below.

    The score that the last of them has comes from the counts by score (whole thousandths, so as many rows as the
    scores' range); only rows from there on are sorted, by ranges, and counted by range.
    """
    counts = rows.groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = counts.withColumn("upto", F.sum("n").over(Window.orderBy(F.col("score").desc())))
    cut = above.filter(F.col("upto") >= k).agg(F.max("score").alias("cut")).head()["cut"] if k else None
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("bigint"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("score").desc(), F.col("id").asc_nulls_first(), F.col("at")]
    first = rows.filter(F.col("score") >= cut).withColumn("at", F.monotonically_increasing_id())
    first = stage(first.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "importance-order")
    part = F.shiftright("at", 33)
    sizes = first.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1
    placed = first.withColumn("part", part).join(F.broadcast(before), "part").withColumn("rank", F.when(place <= k, place)).drop("at", "part", "before")
    rest = rows.filter(F.col("score") < cut).withColumn("rank", F.lit(None).cast("bigint"))
    return placed.select(rest.columns).union(rest)


def score_documents(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    longest: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row: Gumbel top-k, so a draw without replacement by weight.

    ``percent`` of the rows with at least ``min_words`` words are drawn. The noise depends on ``seed`` and the id only.
    """
    part = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((part + 0.5) / 4294967296)))
    rows = weigh(docs, target, id_col, text_col, target_text, longest, buckets)
    rows = stage(rows.withColumn("score", F.col("weight") + noise), "importance-scores")
    enough = rows.filter(F.col("n_words") >= min_words)
    drawn = ranked(enough, percent * enough.count() // 100)
    return drawn.union(rows.filter(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("bigint")))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` that are drawn, with all their columns. Rows that share an id go together; rows without an id are never drawn."""
    drawn = score_documents(docs, target, id_col, **options).filter("rank is not null").select(F.col("id").alias("__drawn")).distinct()
    return docs.join(drawn, docs[id_col].cast("bigint") == drawn["__drawn"], "left_semi")
