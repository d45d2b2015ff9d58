"""Repair of the role structure of conversations, solved once for each distinct signature.

A conversation is encoded as one character a row: the initial of its role (``x`` for all but system, user and
assistant), upper-cased if the text is truncated, or ``-`` if the row must go. Many conversations share a signature;
each distinct one is solved once by memoised recursion, and the edits are joined back and replayed on the rows.
Signatures that hold over a thousandth of all conversations (fewer than a thousand, therefore) are broadcast, the others
are joined by key, so no key of that join is hot.

The rows of one conversation meet in one row: its signature is one string and its edits depend on each other from end
to end. The recursion goes back from the end in steps, so its depth does not grow with the conversation.

Edge cases: nulls in role and text count as one space; a null turn comes first; rows of one turn go by role, then text;
rows with a null conversation are one conversation; a conversation whose rows all go has an empty result; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesto.llm.scratch import bounded_batches, stage

BLANKS = " \t\n\x0b\x0c\r"
#: Costs of the edits, and of a truncated row that is not deleted.
COSTS = {"K": 0, "R": 3, "D": 4, "I": 3}
TRUNCATED = 3
#: A signature is hot from this share of all conversations.
HOT_SHARE = 1 / 1000
#: Longer ones are never broadcast.
HOT_LENGTH = 1000
#: Rows by which the recursion goes back at a time.
STEP = 100

#: The state after a role is added: nothing yet, a system turn, a user's turn (a reply must follow), a reply.
START, SYSTEM, USER, REPLY = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, REPLY: USER}, "a": {USER: REPLY}}


def solve(signature: str) -> tuple[int, str, list[int], list[str | None]]:
    """Least cost, audit, and for each repaired row its place in the conversation (0: inserted) and its new role (None: its own).

    The audit names the edits in order: Keep, Rerole, Delete, Insert; of equally cheap ones the ASCII-least is taken. In
    a state only one role can be added by Rerole or Insert, so the audit says all.
    """
    memo: dict[tuple[int, int], tuple[int, str, int, int]] = {}

    def added(state: int) -> int:
        return REPLY if state == USER else USER

    def best(at: int, state: int, inserted: int = 0) -> tuple[int, str, int, int]:
        """(cost, first edit, next row, next state) from row ``at`` on; a third insertion in a row never pays."""
        key = (at, state, inserted)
        if key in memo:
            return memo[key]
        found = [(0, "", at, state)] if at == len(signature) and state in (START, REPLY) else []
        if inserted < 2:
            found.append((COSTS["I"] + best(at, added(state), inserted + 1)[0], "I", at, added(state)))
        if at < len(signature):
            mark = signature[at]
            found.append((COSTS["D"] + best(at + 1, state)[0], "D", at + 1, state))
            if mark != "-":
                more = TRUNCATED * mark.isupper()
                if (to := NEXT.get(mark.lower(), {}).get(state)) is not None:
                    found.append((COSTS["K"] + more + best(at + 1, to)[0], "K", at + 1, to))
                found.append((COSTS["R"] + more + best(at + 1, added(state))[0], "R", at + 1, added(state)))
        memo[key] = min(found, default=(1 << 60, "~", at, state))
        return memo[key]

    for at in range(len(signature), -1, -STEP):
        for state in range(4):
            best(at, state)
    cost, at, state, inserted = best(0, START)[0], 0, START, 0
    audit, sources, roles = [], [], []
    while (edit := best(at, state, inserted))[1]:
        _, letter, to, after = edit
        audit.append(letter)
        if letter != "D":
            sources.append(0 if letter == "I" else at + 1)
            roles.append(None if letter == "K" else "assistant" if after == REPLY else "user")
        inserted = inserted + 1 if letter == "I" else 0
        at, state = to, after
    return cost, "".join(audit), sources, roles


def _solved(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        found = [solve(s) for s in frame["signature"]]
        yield pd.DataFrame({"signature": frame["signature"], "n": frame["n"], "cost": [x[0] for x in found], "audit": [x[1] for x in found], "sources": [x[2] for x in found], "roles": [x[3] for x in found]})


def fault_of(text: Column, nth: Column) -> Column:
    """The first fault of a row: blank, duplicate (``nth`` of the same role and text), truncated, or null."""
    bare = F.rtrim(text, F.lit(BLANKS))
    return F.when(bare == "", "blank").when(nth > 1, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def signatures(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, rows, gaps, blank, duplicate, truncated, illegal, signature) of each conversation; one shuffle."""
    space = lambda name: F.coalesce(F.col(name), F.lit(" "))
    plain = rows.select(F.col(conversation).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), space(role).alias("role"), space(text).alias("text"))
    nth = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    faulty = plain.repartition("conv_id").withColumn("nth", nth)
    faulty = faulty.withColumn("fault", fault_of(F.col("text"), F.col("nth")))
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("x")
    mark = F.when(F.col("fault") == "truncated", F.upper(letter)).when(F.col("fault").isNull(), letter).otherwise("-")
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    whole = faulty.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text", "nth", initial.alias("initial"), mark.alias("mark")))).alias("marked"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.size(F.collect_set("turn")), F.lit(0)).cast("bigint").alias("gaps"),
        count("blank"), count("duplicate"), count("truncated"),
    )
    pairs = F.transform(F.slice("marked", F.lit(2), F.greatest(F.size("marked") - 1, F.lit(0))), lambda r, i: F.concat(F.get("marked", i)["initial"], r["initial"]))
    return whole.select(
        "conv_id", F.transform("marked", lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))).alias("rows"), "gaps", "blank", "duplicate", "truncated",
        F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))).cast("bigint").alias("illegal"), F.array_join(F.transform("marked", lambda r: r["mark"]), "").alias("signature"),
    )


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired) of each conversation; ``repaired`` is its (role, text) rows after the edits."""
    bounded_batches(rows.sparkSession)
    marked = stage(signatures(rows, conversation, turn, role, text), "signatures")
    distinct = marked.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    solved = stage(distinct.mapInPandas(_solved, "signature string, n bigint, cost bigint, audit string, sources array<int>, roles array<string>"), "solved")
    many = solved.agg(F.sum("n")).head()[0] or 0
    often = (F.col("n") > many * HOT_SHARE) & (F.length("signature") <= HOT_LENGTH)
    hot, cold = F.broadcast(solved.filter(often).drop("n")), solved.filter(~often).drop("n")
    edited = marked.join(hot, "signature").unionByName(marked.join(hot.select("signature"), "signature", "left_anti").join(cold, "signature"))

    def replayed(place: Column, i: Column) -> Column:
        own = F.get("rows", place - 1)
        return F.struct(F.coalesce(F.get("roles", i), own["role"]).alias("role"), F.when(place > 0, own["text"]).otherwise("").alias("text"))

    return edited.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.transform("sources", replayed).alias("repaired"))
