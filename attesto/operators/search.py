"""Full-text search over an inverted index: postings in buckets of their words, so that a search reads its words' buckets only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesto.sources.buckets import Buckets

#: Weights of a word in the title and in the text, and how many documents a search gives.
TITLE, TEXT, BEST = 10, 1, 50


#: What separates words.
APART = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """The words of a text or a query, repeated ones included: runs of letters and digits, lower case."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), APART), lambda w: w != "")


def postings(docs: DataFrame, id_col: str, title: str, text: str) -> DataFrame:
    """(mot, doc_id, poids): each word of each document with its summed weight. Texts are dealt by document and cut once; words are counted where they are cut."""
    part = lambda c, weight: F.struct(F.lower(F.coalesce(F.col(c), F.lit(""))).alias("texte"), F.lit(weight).alias("poids"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given, so that texts are not put together by their size: their words take more room
    dealt = docs.select(F.col(id_col).alias("doc_id"), F.col(title), F.col(text)).repartition(parts, "doc_id")
    flat = dealt.select("doc_id", F.inline(F.array(part(title, TITLE), part(text, TEXT)))).select("doc_id", "poids", F.explode(F.split("texte", APART)).alias("mot")).filter("mot <> ''")
    return flat.groupBy("mot", "doc_id").agg(F.sum("poids").alias("poids"))


def add_documents(index: Buckets, docs: DataFrame, id_col: str, title: str, text: str) -> None:
    """Adds documents to an index over ``mot``, as a lot of its own; no other lot is read but for its ids, and none is rewritten.

    A document that is added again counts with the words it has now: the lot notes it, and a search leaves out what older lots hold of it.
    """
    ids = docs.select(F.col(id_col).alias("doc_id")).distinct()
    known = index.read_lots("ids")
    again = ids.limit(0) if known is None else ids.join(known, "doc_id", "left_semi")
    index.append(postings(docs, id_col, title, text), {"ids": ids, "again": again})


def search(index: Buckets, text: str, best: int = BEST) -> DataFrame:
    """(doc_id, rang) of the documents that hold every word of ``text``, the greatest sums of weights first."""
    spark = index.spark
    asked = spark.createDataFrame([(text,)], "t string").select(F.explode(F.array_distinct(words(F.col("t")))).alias("mot"))
    wanted = sorted(r.mot for r in asked.collect())  # of one query
    found = index.read_lots("rows", asked)
    if found is None or not wanted:
        return spark.createDataFrame([], "doc_id bigint, rang bigint")
    again = index.read_lots("again").groupBy("doc_id").agg(F.max("lot").alias("dernier"))
    found = found.filter(F.col("mot").isin(*wanted)).join(again, "doc_id", "left").filter(F.col("lot") >= F.coalesce("dernier", F.lit(0)))
    hits = found.groupBy("doc_id").agg(F.sum("poids").alias("rang"), F.count(F.lit(1)).alias("mots"))
    return hits.filter(F.col("mots") == len(wanted)).select("doc_id", "rang").orderBy(F.desc("rang"), "doc_id").limit(best)
