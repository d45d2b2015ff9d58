"""Embedding near-duplicates by collision-counting projections.

Vectors are sorted along many one-dimensional random projections; two vectors collide in a projection when one lies
in a window centred on the other. Pairs that collide in enough projections are verified by their cosine, in double
precision. The window and the count come from the recall wanted at the similarity asked for.

One projection alone spreads vectors too little to be sorted over a cluster (a fixed share of all pairs would collide
in it), so the sort takes place inside cells: each of several tables deals the vectors by a few coarse projections, a
task sorts its cells by one more, and the collisions of each pair met in a window are counted over all counting
projections. The number of coarse projections grows with the logarithm of the vectors, the number of tables follows
from the recall. A pair is counted in the first table that brings it together. Cells above ``CELL`` vectors are cut
into blocks whose pairs are separate groups, so no task holds a whole hot cell; a task returns counts and spanning
links, not pairs.

Edge cases: null, zero, empty and non-finite vectors link with nothing; equal vectors are compared once and counted
as often as they occur; only vectors of one dimension are compared; a null id is ignored by the minimum that names a
component; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesto.llm.components import connected_components
from attesto.llm.scratch import stage
from attesto.llm.wordhash import mix

COUNTING = 64
CELL = 2048
PAIRS = 1 << 17


@dataclass(frozen=True)
class Plan:
    similarity: float
    tables: int
    coarse: int  # projections of a table's cells
    width: float  # of a cell along a coarse projection
    window: float  # half width around a vector
    least: int  # collisions that a pair needs


def plan(vectors: int, similarity: float, recall: float = 0.97, seed_width: float = 4.0) -> Plan:
    """Windows, cells and the collision count from the recall at exactly ``similarity``.

    Projections of two unit vectors at distance d differ by a normal variable of deviation d.
    """
    d = math.sqrt(2 - 2 * similarity)
    same = 1 - 2 * 0.5 * math.erfc(seed_width / math.sqrt(2)) - math.sqrt(2 / math.pi) / seed_width * (1 - math.exp(-(seed_width**2) / 2))
    coarse = max(4, round(math.log(max(vectors, 2))))
    meet = same**coarse * math.erf(2.2 / math.sqrt(2))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - meet))
    p, tail, least = math.erf(1.96 / math.sqrt(2)), 0.0, COUNTING
    while least > 0 and tail < 0.999:  # the largest count that pairs at this distance reach with that probability
        tail += math.comb(COUNTING, least) * p**least * (1 - p) ** (COUNTING - least)
        least -= 1
    return Plan(similarity, tables, coarse, seed_width * d, 1.96 * d, least + 1)


def _directions(how: Plan, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coarse directions and shifts, sorting directions and counting directions, the same in every task."""
    rng = np.random.Generator(np.random.PCG64(977 + dim))
    return (
        rng.standard_normal((dim, how.tables * how.coarse)), rng.uniform(0, how.width, how.tables * how.coarse),
        rng.standard_normal((dim, how.tables)), rng.standard_normal((dim, COUNTING)),
    )


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)  # first by the largest part, so that squares neither vanish nor overflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _cells(how: Plan, x: np.ndarray) -> np.ndarray:
    """The cell of each vector in each table."""
    coarse, shift, _, _ = _directions(how, x.shape[1])
    steps = np.floor((x @ coarse + shift) / how.width).astype(np.int64).reshape(len(x), how.tables, how.coarse).view(np.uint64)
    out = np.full((len(x), how.tables), x.shape[1], dtype=np.uint64)
    for j in range(how.coarse):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + steps[:, :, j] + np.uint64(j + 1))
    return mix(out + np.arange(how.tables, dtype=np.uint64)).view(np.int64)


def _deal(how: Plan, whole: bool):
    """(tab, cell) of every vector in every table, with the vector itself if ``whole``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sizes = frame["v"].map(len)
            for dim in sizes.unique():
                part = frame[sizes == dim]
                for low in range(0, len(part), 256):
                    some = part.iloc[low : low + 256]
                    cells = _cells(how, _unit(some["v"]))
                    at = np.tile(np.arange(len(some)), how.tables)
                    out = pd.DataFrame({"tab": np.repeat(np.arange(how.tables, dtype=np.int32), len(some)), "cell": cells.T.ravel()})
                    if whole:
                        out = out.assign(key=some["key"].to_numpy()[at], times=some["times"].to_numpy()[at], v=some["v"].to_numpy()[at])
                    yield out

    return run


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest vertex that each of ``n`` vertices reaches over the links a-b."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for side in (root[a], root[b], a, b):
            np.minimum.at(new, side, low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def _count(how: Plan, frame: pd.DataFrame) -> pd.DataFrame:
    """Links found in whole cells, all of one dimension: key, links (with multiplicity), root (a key linked to, or its own)."""
    x = _unit(frame["v"])
    _, _, sorting, counting = _directions(how, x.shape[1])
    tab, times = frame["tab"].to_numpy(), frame["times"].to_numpy()
    _, group = np.unique(frame[["cell", "block"]].to_numpy() @ np.array([1, 7919]), return_inverse=True)
    along = np.einsum("ij,ji->i", x, sorting[:, tab])
    order = np.lexsort((along, group))
    x, tab, times, group, along = x[order], tab[order], times[order], group[order], along[order]
    half, keys, cells = frame["half"].to_numpy()[order], frame["key"].to_numpy()[order], frame["cell"].to_numpy()[order]
    reach = 2.2 / 1.96 * how.window
    line = group * 64.0 + along
    until = np.searchsorted(line, line + reach, side="right")
    counted = (x @ counting).astype(np.float32)
    lefts, rights = [], []
    for rows in np.array_split(np.arange(len(x)), max(1, math.ceil((until - np.arange(len(x)) - 1).sum() / PAIRS))):
        n = until[rows] - rows - 1
        a = np.repeat(rows, n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        good = (group[a] == group[b]) & (cells[a] == cells[b]) & ((half[a] != half[b]) | (half[a] == 0)) & (keys[a] != keys[b])
        a, b = a[good], b[good]
        good = (np.abs(counted[a] - counted[b]) <= how.window).sum(axis=1) >= how.least
        a, b = a[good], b[good]
        good = np.einsum("ij,ij->i", x[a], x[b]) >= how.similarity
        lefts.append(a[good])
        rights.append(b[good])
    a, b = np.concatenate(lefts), np.concatenate(rights)
    if len(a):  # keep a pair in the first table that brings it together
        used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        all_cells, all_along = _cells(how, x[used]), x[used] @ sorting
        first = np.zeros(len(a), dtype=bool)
        for low in range(0, len(a), PAIRS // 4):
            i, j = where[: len(a)][low : low + PAIRS // 4], where[len(a) :][low : low + PAIRS // 4]
            meet = (all_cells[i] == all_cells[j]) & (np.abs(all_along[i] - all_along[j]) <= reach)
            meet[np.arange(len(i)), tab[a[low : low + PAIRS // 4]]] = True
            first[low : low + PAIRS // 4] = meet.argmax(axis=1) == tab[a[low : low + PAIRS // 4]]
        a, b = a[first], b[first]
    links = np.bincount(a, times[b], len(x)) + np.bincount(b, times[a], len(x))
    linked = np.flatnonzero(links)
    return pd.DataFrame({"key": keys[linked], "links": links[linked].astype(np.int64), "root": keys[_roots(len(x), a, b)][linked]})


def _windows(how: Plan):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            last = held.iloc[-1]
            open_ = (held["tab"] == last["tab"]) & (held["cell"] == last["cell"]) & (held["block"] == last["block"])
            done, held = held[~open_], held[open_]  # the last group may go on
            yield from whole(done)
        if held is not None:
            yield from whole(held)

    def whole(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sizes = frame["v"].map(len) if len(frame) else pd.Series(dtype=int)
        for dim in sizes.unique():
            yield _count(how, frame[sizes == dim].reset_index(drop=True))

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", similarity: float = 0.9, recall: float = 0.97) -> DataFrame:
    """One row for each input row: vec_id, n_links, component_id, kept."""
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].alias("v"), F.monotonically_increasing_id().alias("row"))
    sound = F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = stage(rows.withColumn("sound", sound), "vectors")
    classes = stage(rows.filter("sound").groupBy("v").agg(F.min("row").alias("key"), F.count(F.lit(1)).alias("times"), F.min("vec_id").alias("least")), "classes")
    how = plan(classes.count(), similarity, recall)
    hot = stage(classes.select("v").mapInPandas(_deal(how, False), "tab int, cell bigint").groupBy("tab", "cell").count().filter(F.col("count") > CELL), "hot-cells")
    dealt = classes.select("key", "times", "v").mapInPandas(_deal(how, True), f"tab int, cell bigint, key bigint, times bigint, v {rows.schema['v'].dataType.simpleString()}")
    if hot.head(1):  # blocks of a hot cell meet pairwise: each block goes to all pairs that hold it
        blocks = F.ceil(F.col("count") / CELL).cast("bigint")
        mine = F.pmod(F.xxhash64("key"), F.coalesce(blocks, F.lit(1)))
        pairs = F.transform(F.sequence(F.lit(0).cast("bigint"), F.coalesce(blocks, F.lit(1)) - 1), lambda k: F.struct((F.greatest(mine, k) * 65536 + F.least(mine, k)).alias("block"), F.when(mine == k, 0).when(mine < k, 1).otherwise(2).alias("half")))
        dealt = dealt.join(hot, ["tab", "cell"], "left").withColumn("p", F.explode(pairs)).select("tab", "cell", "key", "times", "v", "p.block", "p.half")
    else:
        dealt = dealt.withColumn("block", F.lit(0).cast("bigint")).withColumn("half", F.lit(0))
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = dealt.repartition(parts, "tab", "cell", "block").sortWithinPartitions("tab", "cell", "block").mapInPandas(_windows(how), "key bigint, links bigint, root bigint")
    found = stage(found, "links")
    groups = stage(connected_components(found.select(F.col("key").alias("a"), F.col("root").alias("b"))), "components").withColumnRenamed("id", "key")
    named = classes.join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left").join(groups, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(least, "component").select("v", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id")
    linked = rows.filter("sound").join(named, "v").select("vec_id", "n_links", "component_id")
    out = linked.unionAll(rows.filter("not sound").select("vec_id", F.lit(0).cast("bigint"), "vec_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
