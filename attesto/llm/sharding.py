"""Uniform shuffle into shards of exact size, through a hypergeometric communication matrix.

A uniform permutation sends to each shard a number of rows from each source block; these numbers follow a
multivariate hypergeometric law. They are drawn first (groups of blocks, then the blocks of each group), each block
permutes its rows and sends runs of the drawn lengths, and each shard permutes what it got. All of it is DataFrame
expressions: the draws are higher-order functions over arrays.

Edge cases: null values travel like others; repeated rows are separate rows; an empty table gives an empty result;
shards may be empty when there are fewer rows than shards.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesto.llm.scratch import stage

#: Rows that one task permutes at most about, in a source block or in a part of a shard. Blocks are dealt as ``side`` groups of
#: ``side`` blocks, 32 at least, so the matrix has a row for each ROWS rows and no fewer than 1024; shards have 64 parts at least.
ROWS = 2_000_000


def _uniform(*keys: Column) -> Column:
    """A number in (0, 1) that the keys decide."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") + 0.5) * F.lit(2.0**-53)


def hypergeometric(marked: Column, total: Column, drawn: Column, u: Column) -> Column:
    """How many of ``drawn`` items out of ``total`` are among the ``marked``, by inversion at ``u``.

    Weights relative to the mode come from the ratio of neighbouring probabilities, ten standard deviations to
    either side; what is beyond lies under the resolution of a double.
    """
    K, N, n = (x.cast("double") for x in (marked, total, drawn))
    low, high = F.greatest(F.lit(0.0), n + K - N), F.least(n, K)
    mode = F.least(high, F.greatest(low, F.floor((n + 1) * (K + 1) / (N + 2)).cast("double")))
    reach = F.ceil(10 * F.sqrt(n * K / F.greatest(N, F.lit(1.0)) * (N - K) / F.greatest(N, F.lit(1.0)) * (N - n) / F.greatest(N - 1, F.lit(1.0)))).cast("double") + 12
    up, down = F.least(high - mode, reach).cast("int"), F.least(mode - low, reach).cast("int")
    at = lambda sign, t: mode + sign * t.cast("double")
    ratio_up = lambda t: (K - at(1, t) + 1) * (n - at(1, t) + 1) / (at(1, t) * (N - K - n + at(1, t)))
    ratio_down = lambda t: (at(-1, t) + 1) * (N - K - n + at(-1, t) + 1) / ((K - at(-1, t)) * (n - at(-1, t)))
    steps = lambda m: F.when(m > 0, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>"))

    def mass(m: Column, ratio) -> Column:
        return F.aggregate(
            steps(m), F.struct(F.lit(1.0).alias("w"), F.lit(0.0).alias("s")),
            lambda a, t: F.struct((a["w"] * ratio(t)).alias("w"), (a["s"] + a["w"] * ratio(t)).alias("s")), lambda a: a["s"],
        )

    def find(m: Column, ratio, left: Column) -> Column:
        """The first step at which the weights summed so far exceed ``left``."""
        return F.aggregate(
            steps(m), F.struct(F.lit(1.0).alias("w"), left.alias("r"), F.lit(0).alias("k")),
            lambda a, t: F.when(a["r"] < 0, a).otherwise(F.struct((a["w"] * ratio(t)).alias("w"), (a["r"] - a["w"] * ratio(t)).alias("r"), t.alias("k"))), lambda a: a["k"],
        )

    def pick(masses: Column) -> Column:
        aim = u * (1.0 + masses["up"] + masses["down"])
        return (
            F.when(aim < 1.0, mode)
            .when(aim < 1.0 + masses["up"], mode + find(up, ratio_up, aim - 1.0))
            .otherwise(mode - find(down, ratio_down, aim - 1.0 - masses["up"]))
        )

    once = F.transform(F.array(F.struct(mass(up, ratio_up).alias("up"), mass(down, ratio_down).alias("down"))), pick)
    return F.when(low >= high, low).otherwise(once[0]).cast("bigint")


def deal(counts: Column, room: Column, shards: int, *keys: Column) -> Column:
    """For each source in ``counts`` (rows to send), how many rows go to each shard; ``room`` is what the shards take in all."""

    def to_shards(state: Column, source: Column) -> Column:
        """Sends one source's rows: shard after shard, given what is left of both."""
        start = F.struct(F.array().cast("array<bigint>").alias("out"), source["n"].alias("left"), F.aggregate(state["room"], F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(shards - 1)), start,
            lambda a, j: F.transform(
                F.array(hypergeometric(F.get(state["room"], j), a["total"], a["left"], _uniform(*keys, source["i"], j))),
                lambda x: F.struct(F.concat(a["out"], F.array(x)).alias("out"), (a["left"] - x).alias("left"), (a["total"] - F.get(state["room"], j)).alias("total")),
            )[0],
            lambda a: a["out"],
        )

    indexed = F.transform(counts, lambda n, i: F.struct(n.cast("bigint").alias("n"), i.alias("i")))
    begin = F.struct(room.alias("room"), F.array().cast("array<array<bigint>>").alias("rows"))
    return F.aggregate(
        indexed, begin,
        lambda s, c: F.transform(
            F.array(to_shards(s, c)),
            lambda out: F.struct(F.zip_with(s["room"], out, lambda a, b: a - b).alias("room"), F.concat(s["rows"], F.array(out)).alias("rows")),
        )[0],
        lambda s: s["rows"],
    )


def _dense(slots: int, key: str, *, by: list[str], df: DataFrame, value: str) -> DataFrame:
    """Arrays of ``slots`` values, zero where a key is missing, one for each ``by``."""
    pairs = F.map_from_entries(F.collect_list(F.struct(key, value)))
    return df.groupBy(*by).agg(F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.coalesce(F.element_at(pairs, i), F.lit(0).cast("bigint"))).alias("counts"))


def communication_matrix(blocks: DataFrame, shards: int, seed: int, side: int = 32) -> DataFrame:
    """From (block, n) the drawn matrix: block, ``until`` (for each shard the local rank below which rows go to it or one before)."""
    cells = blocks.withColumn("group", F.floor(F.col("block") / side).cast("int")).withColumn("member", (F.col("block") % side).cast("int"))
    sums = cells.groupBy("group").agg(F.sum("n").alias("n"))
    whole = _dense(side, "group", by=[], df=sums, value="n").filter(F.size("counts") > 0)
    total = F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    room = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda j: F.floor(total / shards).cast("bigint") + F.when(j < total % shards, 1).otherwise(0).cast("bigint"))
    groups = whole.select(F.posexplode(deal(F.col("counts"), room, shards, F.lit(seed), F.lit("groups"))).alias("group", "room"))
    inside = _dense(side, "member", by=["group"], df=cells, value="n").join(groups, "group")
    drawn = inside.select("group", F.posexplode(deal(F.col("counts"), F.col("room"), shards, F.lit(seed), F.col("group"))).alias("member", "sent"))
    until = F.transform("sent", lambda _, j: F.aggregate(F.slice("sent", F.lit(1), j + 1), F.lit(0).cast("bigint"), lambda a, x: a + x))
    return drawn.select((F.col("group") * side + F.col("member")).alias("block"), until.alias("until"))


def shuffle_into_shards(df: DataFrame, shards: int = 8, seed: int = 7) -> DataFrame:
    """``df`` with ``shard`` and ``slot``: a uniform shuffle, shard sizes at most one apart, slots gapless from 0.

    The rows are written once with the number of their source partition; everything after reads that table, so a
    retried task sees the same blocks. A row travels as one struct, so its column names meet no others; columns of ``df``
    named ``shard`` or ``slot`` are replaced.
    """
    own = [df[c] for c in df.columns if c.lower() not in ("shard", "slot")]
    rows = stage(df.select((F.struct(*own) if own else F.lit(None)).alias("data"), F.monotonically_increasing_id().alias("row")), "rows")
    n = rows.count()
    side, parts = max(32, math.ceil(math.sqrt(n / ROWS))), max(64, math.ceil(n / shards / ROWS))
    rows = rows.withColumn("block", F.pmod(F.shiftright("row", 33), F.lit(side * side)).cast("int"))
    counts = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"))
    matrix = stage(communication_matrix(counts, shards, seed, side), "matrix")  # side * side rows
    local = Window.partitionBy("block").orderBy(F.xxhash64(F.lit(seed), F.lit("local"), "row"), "row")
    sent = rows.withColumn("rank", F.row_number().over(local) - 1).join(F.broadcast(matrix), "block")
    sent = sent.select("data", "row", F.size(F.filter("until", lambda c: c <= F.col("rank"))).cast("int").alias("shard"))
    sent = sent.withColumn("order", F.xxhash64(F.lit(seed), F.lit("final"), "row"))
    sent = stage(sent.withColumn("part", F.pmod(F.shiftright("order", 40), F.lit(parts)).cast("int")), "exchanged")
    sizes = sent.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))  # shards * parts rows
    offsets = sizes.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("offset"))
    last = Window.partitionBy("shard", "part").orderBy("order", "row")
    placed = sent.withColumn("rank", F.row_number().over(last) - 1).join(F.broadcast(offsets), ["shard", "part"])
    slot = F.col("offset") + F.col("rank")
    return placed.select("data.*", "shard", slot.alias("slot")) if own else placed.select("shard", slot.alias("slot"))
