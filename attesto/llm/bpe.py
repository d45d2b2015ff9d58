"""BPE encoding and decoding through a table of distinct words.

Texts are cut before spaces that a non-blank character follows; byte-level pre-tokenisation never joins the two
sides of such a cut, so each word is encoded alike wherever it stands. Each chunk of texts (a few megabytes) becomes
word numbers and a list of its distinct words; the lists go to the tasks that own the words by hash, where each
distinct word is encoded once; the ids come back to the chunk and are laid out by position. Nothing but word numbers
and distinct words is shuffled.

Edge cases: null counts as empty and gives no ids; a text without blanks is one word; repeated rows are separate
rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesto.llm.scratch import bounded_batches, shared_dir, stage

#: Characters of text after which a chunk ends.
CHUNK_CHARS = 24 << 20
#: Words laid out at once.
LAID_OUT = 1 << 20


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a file, with padding and truncation off."""
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_padding()
    found.no_truncation()
    return found


@lru_cache(maxsize=2)
def specials(path: str) -> tuple[str, ...]:
    """Strings that the tokenizer cuts out of a text before anything else."""
    with open(path, encoding="utf-8") as file:
        return tuple(x["content"] for x in json.load(file).get("added_tokens", []))


def words_of(text: str, cut_out: tuple[str, ...] = ()) -> list[str]:
    """Pieces whose concatenation is ``text`` and whose encodings, one after the other, are its encoding."""
    for mark in cut_out:
        if mark and mark in text:
            rest = tuple(x for x in cut_out if x != mark)
            out: list[str] = []
            for i, part in enumerate(text.split(mark)):
                out += [mark] * (i > 0) + words_of(part, rest)
            return out
    if not text:
        return []
    parts = text.split(" ")
    out = [parts[0]] if parts[0] else []
    held = " " if len(parts) > 1 else ""
    for part in parts[1:]:
        if part and not part[0].isspace():  # a cut before this space
            if len(held) > 1:
                out.append(held[:-1])
            out.append(" " + part)
            held = " "
        else:  # two spaces, or a space before another blank: no cut, so this goes with what is before
            last = out.pop() if out and len(held) == 1 else ""
            held = held if len(held) > 1 else last + held
            held += part + " "
    if len(held) > 1:
        out.append(held[:-1])
    return out


def byte_of_char() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, inverted."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def pieces(path: str) -> dict[int, bytes]:
    """The bytes of each token id; as large as the tokenizer file, whatever the corpus."""
    table, extra = byte_of_char(), set(specials(path))
    return {i: token.encode() if token in extra else bytes(table[c] for c in token) for token, i in tokenizer(path).get_vocab().items()}


def piece_table(spark, path: str) -> DataFrame:
    """(id, piece) of the vocabulary."""
    return spark.createDataFrame(pd.DataFrame(sorted(pieces(path).items()), columns=["id", "piece"]), "id int, piece binary")


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded) of rows with an array of token ids, by a join of each id with its piece.

    Bytes that are not UTF-8 become U+FFFD; a null or empty array decodes to an empty text.
    """
    rows = stage(encoded.select(F.col(id_col).alias("__id"), F.col(ids_col).alias("__ids"), F.monotonically_increasing_id().alias("__row")), "encoded")
    flat = rows.select("__row", F.posexplode("__ids").alias("pos", "id")).join(F.broadcast(piece_table(encoded.sparkSession, path)), "id")
    texts = flat.groupBy("__row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.hex("piece").alias("hex")))), lambda x: x["hex"]), "").alias("hex"))
    return rows.join(texts, "__row", "left").select(F.col("__id").alias(id_col), F.decode(F.unhex(F.coalesce("hex", F.lit(""))), "UTF-8").alias("decoded"))


def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative integers below 2**28 in one to four bytes each (seven bits a byte), and where each ends."""
    v = values.astype(np.uint32)
    n = 1 + (v >= 1 << 7).astype(np.int64) + (v >= 1 << 14) + (v >= 1 << 21)
    ends = np.cumsum(n)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)
    for j in range(int(n.max()) if len(n) else 0):
        there = n > j
        out[(ends - n)[there] + j] = ((v[there] >> np.uint32(7 * j)) & np.uint32(127)) | np.where(n[there] > j + 1, 128, 0).astype(np.uint32)
    return out, ends


def unpack(raw: bytes) -> np.ndarray:
    """The integers of ``pack``."""
    b = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(b < 128) + 1
    starts = np.concatenate(([0], ends[:-1])).astype(np.int64)[: len(ends)]
    out = (b[starts] & 127).astype(np.int64)
    for j in range(1, int((ends - starts).max()) if len(ends) else 0):
        there = ends - starts > j
        out[there] |= (b[starts[there] + j] & 127).astype(np.int64) << (7 * j)
    return out


def _chunks(path: str, buckets: int):
    """Chunks of texts: rows of (chunk, doc_id, numbers of its words), and of (chunk, owner, numbers, words)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        from pyspark import TaskContext

        cut_out, task, made = specials(path), TaskContext.get().partitionId(), 0
        ids, numbers, size, index = [], [], 0, {}

        def flush() -> pd.DataFrame:
            used = np.zeros(len(index), dtype=np.int64)
            for x in numbers:
                np.add.at(used, x, 1)
            order = np.argsort(-used, kind="stable")  # frequent words get small numbers, in fewer bytes
            rank = np.empty(len(index), dtype=np.int64)
            rank[order] = np.arange(len(index))
            texts = [pack(rank[x])[0].tobytes() for x in numbers]
            rows = pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), "bucket": -1, "numbers": texts})
            words = list(index)
            owner = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for w in words), dtype=np.int64, count=len(words))[order]
            lists = [np.flatnonzero(owner == b) for b in np.unique(owner)]
            held = [[words[i] for i in order[x].tolist()] for x in lists]
            parts = pd.DataFrame({
                "doc_id": pd.array([None] * len(lists), dtype="Int64"), "bucket": np.unique(owner), "numbers": [pack(np.diff(x, prepend=0))[0].tobytes() for x in lists],
                "sizes": [pack(np.array([len(w) for w in ws]))[0].tobytes() for ws in held], "words": ["".join(ws) for ws in held],
            })
            return pd.concat([rows, parts], ignore_index=True).assign(chunk=(task << 32) + made)[["chunk", "bucket", "doc_id", "numbers", "sizes", "words"]].astype(object).where(lambda x: x.notna(), None)

        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text if isinstance(text, str) else ""
                words = words_of(text, cut_out)
                numbers.append(np.fromiter((index.setdefault(w, len(index)) for w in words), dtype=np.int32, count=len(words)))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                size += len(text)
                if size >= CHUNK_CHARS:
                    yield flush()
                    ids, numbers, size, index = [], [], 0, {}
                    made += 1
        if ids:
            yield flush()

    return run


def id_type(path: str) -> str:
    """Two bytes an id where the vocabulary allows it."""
    return "<u2" if max(pieces(path)) < 1 << 16 else "<u4"


def _encode_once(path: str):
    """Encodes the words of a task's buckets, each distinct one once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, known = tokenizer(path), {}
        kind = id_type(path)
        for frame in frames:
            lists = []
            for text, sizes in zip(frame["words"], frame["sizes"], strict=True):
                ends = np.cumsum(unpack(sizes)).tolist()
                lists.append([text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
            fresh = list({w for words in lists for w in words} - known.keys())
            for low in range(0, len(fresh), 20_000):
                part = fresh[low : low + 20_000]
                known.update(zip(part, (x.ids for x in found.encode_batch_fast(part, add_special_tokens=False)), strict=True))
            out = [[known[w] for w in words] for words in lists]
            yield pd.DataFrame({
                "chunk": frame["chunk"], "bucket": frame["bucket"], "lengths": [pack(np.array([len(x) for x in row]))[0].tobytes() for row in out],
                "ids": [np.array([i for x in row for i in x], dtype=kind).tobytes() for row in out],
            })

    return run


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions ``starts[i]`` to ``starts[i] + lengths[i]``, one run after the other."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _lay_out(make, kind: str):
    """For each chunk, the ids of its texts by position; ``make`` turns (doc ids, ids of all, ends) into a frame."""

    def run(key, rows: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        own = rows["bucket"].to_numpy() >= 0
        numbers = {b: np.cumsum(unpack(x)) for b, x in zip(rows["bucket"][own], rows["numbers"][own], strict=True)}
        size = sum(map(len, numbers.values()))
        lengths, where, base, flat = np.zeros(size, dtype=np.int32), np.zeros(size, dtype=np.int32), 0, []
        for bucket, packed, ids in zip(parts["bucket"], parts["lengths"], parts["ids"], strict=True):
            length = unpack(packed)
            lengths[numbers[bucket]] = length
            where[numbers[bucket]] = base + np.cumsum(length) - length
            flat.append(np.frombuffer(ids, dtype=kind))
            base += len(flat[-1])
        pool = np.concatenate([*flat, np.zeros(0, kind)])
        docs = rows[~own]
        count = np.array([len(x) - int((np.frombuffer(x, np.uint8) >= 128).sum()) for x in docs["numbers"]], dtype=np.int64)
        out = []
        for at in np.split(np.arange(len(docs)), np.flatnonzero(np.diff(np.cumsum(count) // LAID_OUT)) + 1):  # runs of about LAID_OUT words
            words = unpack(b"".join(docs["numbers"].iloc[at]))
            n = lengths[words].astype(np.int64)
            tokens = pool[_spread(where[words].astype(np.int64), n)]
            out.append(make(docs["doc_id"].iloc[at].astype("Int64"), tokens, np.concatenate(([0], np.cumsum(n)))[np.cumsum(count[at])]))
        return pd.concat(out, ignore_index=True)

    return run


def _plain(doc_ids: pd.Series, tokens: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": doc_ids, "ids": np.split(tokens.astype(np.int32), ends[:-1])})


def _digests(shared):
    def make(doc_ids: pd.Series, tokens: np.ndarray, ends: np.ndarray) -> pd.DataFrame:
        text, starts, sizes = shared.value
        of = np.concatenate(([0], np.cumsum(sizes[tokens])))[ends]
        raw = text[_spread(starts[tokens], sizes[tokens])].tobytes()
        codes, sha = tokens.astype("<u4").tobytes(), lambda x: hashlib.sha256(x).hexdigest()
        spans = list(zip([0, *ends[:-1].tolist()], ends.tolist(), [0, *of[:-1].tolist()], of.tolist(), strict=True))
        return pd.DataFrame({
            "doc_id": doc_ids, "n_tokens": [b - a for a, b, _, _ in spans], "ids_sha256": [sha(codes[4 * a : 4 * b]) for a, b, _, _ in spans],
            "decoded_sha256": [sha(raw[c:d].decode("utf-8", "replace").encode()) for _, _, c, d in spans],
        })

    return make


def _through_words(docs: DataFrame, path: str, id_col: str, text_col: str, make, schema: str) -> DataFrame:
    """The chunks are a table bucketed by chunk, so the word numbers, the bulk of it, are not shuffled to meet their ids."""
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].alias("text"))
    made = rows.mapInPandas(_chunks(path, 2 * parts), "chunk bigint, bucket int, doc_id bigint, numbers binary, sizes binary, words string")
    name = f"attesto_chunks_{uuid.uuid4().hex}"
    made.write.option("path", shared_dir(spark, "chunks")).option("compression", "zstd").bucketBy(parts, "chunk").saveAsTable(name)
    made = spark.table(name)
    lists = made.filter("bucket >= 0").select("chunk", "bucket", "sizes", "words").repartition(parts, "bucket")
    ids = lists.mapInPandas(_encode_once(path), "chunk bigint, bucket int, lengths binary, ids binary")
    return made.select("chunk", "bucket", "doc_id", "numbers").groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInPandas(_lay_out(make, id_type(path)), schema)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every text, as ``tokenizers`` encodes it without special tokens around it."""
    return _through_words(docs, path, id_col, text_col, _plain, "doc_id bigint, ids array<int>")


def encode_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids of every text and their decoding, as digests.

    The decoding joins ids to the piece table (bounded by the vocabulary, so it is broadcast) where the ids are made.
    """
    found = pieces(path)
    text = [found.get(i, b"") for i in range(max(found) + 1)]
    sizes = np.array([len(x) for x in text], dtype=np.int64)
    table = docs.sparkSession.sparkContext.broadcast((np.frombuffer(b"".join(text), dtype=np.uint8), np.cumsum(sizes) - sizes, sizes))
    return _through_words(docs, path, id_col, text_col, _digests(table), "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
