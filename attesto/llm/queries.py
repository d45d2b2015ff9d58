"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attesto.llm import bpe, chat_format, embedding_dedup, exact_dedup, html_text, importance, jaccard_join, language_id, mixing, sharding, structure_repair, substring_dedup, toxicity


def held_out(doc_id: Column) -> Column:
    """The rows that nothing is learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return language_id.identify(docs, held_out(docs["doc_id"]))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(read(spark, sf_dir, "documents"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"))
    dealt = sharding.shuffle_into_shards(rows, 8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(read(spark, sf_dir, "documents"), tokenizer_path())


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_groups(read(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url", html_text.extract_main_text(F.col("html")).alias("text"))
    return pages.withColumn("n_chars", F.length("text").cast("bigint"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", F.col("__topic").alias("topic"), F.col("__tokens").alias("tokens"), F.col("__weight").alias("weight"), F.col("__probability").alias("probability"), F.col("__kept").alias("kept"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = exact_dedup.exact_groups(read(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("sha256").alias("text_sha256"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), held_out)


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = importance.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return scored.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    rows = rows.union(spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], rows.schema))
    made = chat_format.examples(rows)
    read_back = made.select("conv_id", "example", "formatted", chat_format.trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("learnt"))
    whole = read_back.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("longest"), F.sort_array(F.collect_list(F.struct("example", "learnt"))).alias("learnt"), F.sum(F.length("formatted")).alias("formatted_chars")
    )
    turns = chat_format.read_turns(F.col("longest"))
    said_by = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    learnt = F.array_join(F.transform("learnt", lambda x: x["learnt"]), "")
    whole = whole.select("conv_id", turns.alias("turns"), learnt.alias("learnt"), "formatted_chars")
    return whole.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said_by.cast("binary"), 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): by the checksum of conversation and turn, a row is dropped, emptied, loses its full stops, comes twice or becomes a user's."""
    space = lambda c: F.coalesce(c, F.lit(" "))
    case = F.crc32(F.concat(space(F.col("conv_id").cast("string")), F.lit(":"), space(F.col("turn").cast("string"))).cast("binary")) % 20
    text, role = space(F.col("text")), space(F.col("role"))
    rows = rows.select(
        "conv_id", "turn", F.when(case == 4, "user").otherwise(role).alias("role"), F.when(case == 1, "").when(case == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(1), F.when(case == 0, 0).when(case == 3, 2).otherwise(1))).alias("copy"),
    )
    return rows.drop("copy")


def op13_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    repaired = structure_repair.repair(damaged(rows)).withColumnRenamed("conv_id", "repaired_id")
    found = rows.select("conv_id").distinct().join(repaired, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return found.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.sha2(F.coalesce(lines, F.lit("")).cast("binary"), 256).alias("repaired_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_language_id": op2_language_id,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_sharding": op4_sharding,
    "op5_bpe": op5_bpe,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_html_text": op7_html_text,
    "op8_mixing": op8_mixing,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_importance": op11_importance,
    "op12_chat_format": op12_chat_format,
    "op13_structure_repair": op13_structure_repair,
}

#: The checksum's table by its rule, for SQL without a crc32 function.
CRC_TABLE = """crc_table AS (
            SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc
        )"""

ORACLE_SQL: dict[str, str] = {
    "op6_jaccard_join": """
        WITH RECURSIVE words AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
        ), shingles AS (
            SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS s
            FROM words, unnest(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1)) AS r(i)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
        ), shared AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
        ), links AS (
            SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)
        ), both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links
        ), reach AS (
            SELECT doc_id AS x, doc_id AS r FROM documents UNION SELECT e.y, reach.r FROM reach JOIN both_ways e ON e.x = reach.x
        )
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id
        FROM documents d LEFT JOIN sizes USING (doc_id) JOIN (SELECT x AS doc_id, min(r) AS component_id FROM reach GROUP BY x) c USING (doc_id)
    """,
    "op9_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents
        WINDOW g AS (PARTITION BY coalesce(text, ''))
    """,
    "op11_importance": rf"""
        WITH {CRC_TABLE}, texts AS (
            SELECT true AS own, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark
        ), cut AS (
            SELECT own, k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
        ), words AS (SELECT own, k, unnest(w) AS word FROM cut
        ), hashed AS (
            SELECT word, xor(list_reduce(list_concat([4294967295], list_transform(range(strlen(word)), lambda j: 16 * (instr('0123456789ABCDEF', hex(word)[2 * j + 1]) - 1) + instr('0123456789ABCDEF', hex(word)[2 * j + 2]) - 1)),
                       lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
            FROM (SELECT DISTINCT word FROM words), crc_table
        ), counts AS (
            SELECT bucket, count(*) FILTER (WHERE own) AS s, count(*) FILTER (WHERE NOT own) AS t FROM words JOIN hashed USING (word) GROUP BY bucket
        ), gains AS (
            SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counts
        ), sums AS (SELECT k, sum(gain) AS total FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE own GROUP BY k
        ), scored AS (
            SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(total::DOUBLE / len(w)) END::BIGINT AS weight,
                   list_reduce(list_concat([0], list_transform(range(1, 9), lambda j: instr('0123456789abcdef', sha256('2024:' || doc_id)[j]) - 1)), lambda a, b: 16 * a + b) AS h
            FROM cut LEFT JOIN sums USING (k) WHERE own
        ), noisy AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score FROM scored
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM noisy
        )
        SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
    """,
    "op12_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
        ), shown AS (
            SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY conv_id) AS n,
                   sum(length(regexp_replace(text, '(<)(\\*)(<SYS>>|</SYS>>|s>|/s>)|(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '\1\4\\\2\3\5\6', 'g'))
                       + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7
                         ELSE 17 + length(regexp_replace(role, '(<)(\\*)(<SYS>>|</SYS>>|s>|/s>)|(\[)(\\*)(INST\]|/INST\]|ROLE\]|/ROLE\])', '\1\4\\\2\3\5\6', 'g')) END) OVER o AS upto
            FROM said WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING)
        )
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               (sum(upto) FILTER (WHERE role = 'assistant' OR k = n))::BIGINT AS formatted_chars
        FROM shown GROUP BY conv_id
    """,
    "op13_structure_repair": rf"""
        WITH RECURSIVE {CRC_TABLE}, marked AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_concat([4294967295], list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: unicode(x)::BIGINT)),
                       lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS x
            FROM conversations, crc_table
        ), rows_after AS (
            SELECT conv_id, turn, CASE WHEN x = 4 THEN 'user' ELSE role END AS role, CASE x WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
            FROM marked, unnest(range(CASE x WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copies(i)
        ), numbered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth FROM rows_after
        ), faulty AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, nth) AS k,
                   CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b'
                        WHEN nth > 1 THEN 'd'
                        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 't' ELSE '' END AS fault
            FROM numbered
        ), seen AS (
            SELECT *, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY k) || role[1] AS pair FROM faulty
        ), whole AS (
            SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'b') AS blank, count(*) FILTER (WHERE fault = 'd') AS duplicate,
                   count(*) FILTER (WHERE fault = 't') AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal,
                   list({{'i': role[1], 'f': fault, 'r': role, 't': text}} ORDER BY k) AS r
            FROM seen GROUP BY conv_id
        ), steps AS (
            -- least (cost, audit) after k rows with nothing yet, a system turn, a user's turn, a reply
            SELECT conv_id, 0 AS k, r, {{'c': 0, 'a': ''}} AS z, {{'c': 1000000, 'a': ''}} AS s, {{'c': 3, 'a': 'I'}} AS u, {{'c': 6, 'a': 'II'}} AS a FROM whole
            UNION ALL
            SELECT conv_id, k, r, z, s, u2, list_min([a, {{'c': u2.c + 3, 'a': u2.a || 'I'}}]) FROM (
                SELECT *, list_min([u, {{'c': z.c + 3, 'a': z.a || 'I'}}, {{'c': s.c + 3, 'a': s.a || 'I'}}, {{'c': a.c + 3, 'a': a.a || 'I'}}]) AS u2 FROM (
                    SELECT conv_id, k + 1 AS k, r, {{'c': z.c + 4, 'a': z.a || 'D'}} AS z,
                           list_min([{{'c': s.c + 4, 'a': s.a || 'D'}}, {{'c': z.c + more + CASE WHEN i = 's' THEN 0 ELSE 1000000 END, 'a': z.a || 'K'}}]) AS s,
                           list_min(list_concat([{{'c': u.c + 4, 'a': u.a || 'D'}}], list_transform([z, s, a], lambda v: {{'c': v.c + more + CASE WHEN i = 'u' THEN 0 ELSE 3 END, 'a': v.a || CASE WHEN i = 'u' THEN 'K' ELSE 'R' END}}))) AS u,
                           list_min([{{'c': a.c + 4, 'a': a.a || 'D'}}, {{'c': u.c + more + CASE WHEN i = 'a' THEN 0 ELSE 3 END, 'a': u.a || CASE WHEN i = 'a' THEN 'K' ELSE 'R' END}}]) AS a
                    FROM (SELECT *, r[k + 1].i AS i, CASE r[k + 1].f WHEN 't' THEN 3 WHEN '' THEN 0 ELSE 1000000 END AS more FROM steps WHERE k < len(r))))
        ), solved AS (
            SELECT conv_id, r, list_min([z, a]) AS best FROM steps WHERE k = len(r)
        ), replayed AS (
            SELECT conv_id, best, array_to_string(list_transform(list_filter(range(1, len(best.a) + 1), lambda j: best.a[j] <> 'D'), lambda j:
                CASE WHEN best.a[j] = 'K' THEN r[len(replace(best.a[:j], 'I', ''))].r
                     WHEN (len(replace(best.a[:j], 'D', '')) + CASE WHEN replace(best.a, 'D', '')[1] = 'K' AND r[len(regexp_extract(best.a, '^D*')) + 1].i = 's' THEN 1 ELSE 0 END) % 2 = 1 THEN 'user' ELSE 'assistant' END
                || ':' || CASE WHEN best.a[j] = 'I' THEN '' ELSE r[len(replace(best.a[:j], 'I', ''))].t END), chr(10)) AS lines
            FROM solved
        )
        SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN replayed p ON p.conv_id IS NOT DISTINCT FROM o.conv_id
    """,
}
