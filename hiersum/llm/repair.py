"""Conversation structure repair: A* on the edit lattice.

A conversation's rows are repaired until their roles read ``(system? (user
assistant)+)?``, by initials.  A node of the lattice is a number of rows done
and the last role written; edits keep a row, give it the role that is due,
delete it, or insert an empty turn.  The heuristic is what the rows that are
left cost at least, as suffix sums: the deletion of each blank or duplicate
row, and the charge for each truncated one, which stays or costs more to
delete.  Nodes leave the queue by (cost plus heuristic, audit), so the first
way to a node is the cheapest, and of the cheapest the one whose audit comes
first; two ways to a node at one cost never extend each other, as only edits
that take a row are free.

Rows, texts and hashes stay in DataFrame operations.  What the search sees of
a row is a character, so a conversation of any length is a short string; it
goes through the search in pieces of ``PIECE`` rows from every role that the
piece before can end in, and pieces combine like matrices over (cost, audit).
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint, map_batches

#: Costs of the edits, and the charge for a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns whose numbers fall into one block of this many are sorted together, and rows of one search.
BLOCK, PIECE = 512, 512
#: Last role written: none yet, system, user, assistant; what may follow, and the role that an edit can write there.
NONE, SYSTEM, USER, ASSISTANT, OTHER = range(5)
FOLLOWS = {NONE: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
DUE = {NONE: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ENDS = (NONE, ASSISTANT)
LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Faults of a row, in the order in which they count.
SOUND, BLANK, DUPLICATE, CUT = range(4)

Way = tuple[int, str, str]  # cost, audit, plan


def search(rows: list[tuple[int, int, int]], start: int, last: bool) -> dict[int, Way]:
    """The best way through ``rows`` (role, fault, copies) from ``start`` to each role that it can end in.

    ``last``: nothing follows, so turns may be inserted at the end, and the
    first way to an end of the conversation is all there is.  A plan has a piece
    for each row: roles inserted before it, and K, D, or the new role (u, a).
    """
    n = len(rows)
    least = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        _, fault, copies = rows[i]
        least[i] = least[i + 1] + (DELETE * copies if fault in (BLANK, DUPLICATE) else (TRUNCATED if fault == CUT else 0) + DELETE * (copies - 1))
    queue: list[tuple[int, str, int, int, int, str]] = [(least[0], "", 0, start, 0, "")]
    done: set[tuple[int, int]] = set()
    ends: dict[int, Way] = {}
    while queue:
        _, audit, i, state, cost, plan = heapq.heappop(queue)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            if not last or state in ENDS:
                ends[state] = cost, audit, plan
                if last:
                    return ends
        due = DUE[state]
        if i < n or last:
            heapq.heappush(queue, (cost + INSERT + least[i], audit + "I", i, due, cost + INSERT, plan + " SUA"[due]))
        if i == n:
            continue
        role, fault, copies = rows[i]
        gone = DELETE * copies
        heapq.heappush(queue, (cost + gone + least[i + 1], audit + "D" * copies, i + 1, state, cost + gone, plan + "D,"))
        if fault in (SOUND, CUT):  # copies of a row that stays are duplicates
            stays, rest = cost + (TRUNCATED if fault == CUT else 0) + DELETE * (copies - 1), "D" * (copies - 1)
            if role in FOLLOWS[state]:
                heapq.heappush(queue, (stays + least[i + 1], audit + "K" + rest, i + 1, role, stays, plan + "K,"))
            heapq.heappush(queue, (stays + REROLE + least[i + 1], audit + "R" + rest, i + 1, due, stays + REROLE, plan + "  ua"[due] + ","))
    return ends


def solve(rows: list[tuple[int, int, int]], piece: int = PIECE) -> Way:
    """The best way through a whole conversation."""
    ways: dict[int, Way] = {NONE: (0, "", "")}
    for at in range(0, max(1, len(rows)), piece):
        after: dict[int, Way] = {}
        for state, (cost, audit, plan) in ways.items():
            for end, (more, edits, steps) in search(rows[at : at + piece], state, at + piece >= len(rows)).items():
                way = cost + more, audit + edits, plan + steps
                if end not in after or way < after[end]:
                    after[end] = way
        ways = after
    return min(ways.values())


def encode(role: int, fault: int) -> str:
    return chr(ord("A") + 4 * role + fault)


def decode(codes: str) -> list[tuple[int, int, int]]:
    """Rows (role, fault of the first copy, copies) of a code string."""
    out = []
    for letter, copies in re.findall(r"([A-Z])([0-9]*)", codes):
        k = ord(letter) - ord("A")
        out.append((k // 4, k % 4, int(copies or 1)))
    return out


def _code(role: Column, fault: Column, copies: Column) -> Column:
    initial = F.left(role, F.lit(1))
    number = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    return F.concat(F.chr(F.lit(ord("A")) + number * 4 + fault), F.when(copies > 1, copies.cast("string")).otherwise(""))


def faulty(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies, fault (of the first copy): one row for all rows that agree in all four.

    Null roles and texts are empty.  A row is a duplicate if its role and text stand in an earlier turn.
    """
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role"), "when": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))})
    rows = checkpoint(rows)
    again = rows.groupBy(F.col("conv_id").alias("of"), F.col("h1").alias("of1"), F.col("h2").alias("of2")).agg(F.count(F.lit(1)).alias("turns"), F.min("when").alias("first")).where("turns > 1")
    seen = rows.join(again, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h1") == F.col("of1")) & (F.col("h2") == F.col("of2")), "left")
    fault = (
        F.when(~F.rlike("text", F.lit(r"[^\x20\x09-\x0D]")), BLANK)
        .when(F.coalesce(F.col("when") > F.col("first"), F.lit(False)), DUPLICATE)
        .when(~F.rlike("text", F.lit(r"[.!?][\x20\x09-\x0D]*+\z")), CUT)
        .otherwise(SOUND)
    )
    return seen.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


SOLVED = "conv_id bigint, block bigint, first boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, plan string"


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block of a conversation (conv_id, blocks: array of block and codes); the first has what holds for all."""
    for batch in batches:
        out = []
        for conv_id, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = [decode(b["codes"]) for b in blocks]
            rows = [r for p in parts for r in p]
            blank = sum(c for _, f, c in rows if f == BLANK)
            duplicate = sum(c if f == DUPLICATE else c - 1 for _, f, c in rows if f != BLANK)
            illegal = sum(c - 1 for _, _, c in rows) + sum((a[0], b[0]) not in LEGAL for a, b in zip(rows, rows[1:], strict=False))
            cost, audit, plan = solve(rows)
            pieces, at = plan.split(","), 0  # one more than rows: what is inserted at the end
            for k, (b, p) in enumerate(zip(blocks, parts, strict=True)):
                end = at + len(p) + (k + 1 == len(blocks))
                facts = (blank, duplicate, sum(f == CUT for _, f, _ in rows), illegal, cost, audit) if k == 0 else (None,) * 6
                out.append((conv_id, b["block"], k == 0, *facts, ",".join(pieces[at:end])))
                at += len(p)
        kinds = (pa.int64(), pa.int64(), pa.bool_(), *(pa.int64(),) * 5, pa.string(), pa.string())
        names = [c.split()[0] for c in SOLVED.split(", ")]
        columns = list(zip(*out, strict=True)) if out else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _lines(rows: Column, plan: Column) -> Column:
    """The repaired lines of a block."""

    def one(row: Column, piece: Column) -> Column:
        added = F.transform(F.filter(F.split(piece, ""), lambda c: c.isin("U", "A")), lambda c: F.when(c == "U", "user:").otherwise("assistant:"))
        edit = F.right(piece, F.lit(1))
        role = F.when(edit == "K", row["role"]).when(edit == "u", "user").when(edit == "a", "assistant")
        return F.concat(added, F.when(role.isNotNull(), F.array(F.concat(role, F.lit(":"), row["text"]))).otherwise(F.array().cast("array<string>")))

    return F.flatten(F.zip_with(rows, F.split(plan, ","), one))


def repair(turns: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired: one row per conversation.

    ``turns`` has conv_id, turn, role and text; other columns are ignored.
    Rows go by turn, null first, rows of one turn by role and text, and equal
    rows follow one another.  A row's first fault counts: blank (nothing but
    spaces), duplicate (role and text stand in an earlier row), truncated (the
    last character but spaces is none of ``.!?``).  ``gaps``: turn numbers
    that are missing between the first and the last, zero without any.
    ``illegal``: neighbours whose initials are not su, ua or au.  A null role
    or text is empty, a null conv_id a conversation.  ``repaired`` has the
    lines ``role:text``.  An empty table gives an empty result.
    """
    rows = faulty(turns).withColumn("block", F.floor(F.col("turn") / BLOCK))
    item = F.struct("turn", "role", "text", _code(F.col("role"), F.col("fault"), F.col("copies")).alias("code"))
    blocks = rows.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(item)).alias("rows"))
    blocks = checkpoint(blocks.select("conv_id", "block", "rows", F.array_join("rows.code", "").alias("codes")))
    strings = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "codes"))).alias("blocks"))
    solved = map_batches(strings, _solved, SOLVED).withColumnsRenamed({"conv_id": "of", "block": "at"})
    planned = blocks.join(solved, F.col("conv_id").eqNullSafe(F.col("of")) & F.col("block").eqNullSafe(F.col("at")))
    turn = F.col("rows.turn")
    told = planned.select(
        "conv_id", "block", "first", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.array_min(turn).alias("low"), F.array_max(turn).alias("high"), F.size(F.filter(F.array_distinct(turn), lambda t: t.isNotNull())).alias("turns"),
        _lines(F.col("rows"), F.col("plan")).alias("lines"),
    )
    facts = [F.max(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost", "audit")]
    missing = (F.max("high").cast("decimal(20,0)") - F.min("low").cast("decimal(20,0)") + 1 - F.sum("turns")).try_cast("bigint")
    text = F.struct("block", F.when(F.size("lines") > 0, F.array_join("lines", "\n")).alias("lines"))
    whole = told.groupBy("conv_id").agg(F.when(F.max("high").isNull(), F.lit(0)).otherwise(missing).cast("bigint").alias("gaps"), *facts, F.sort_array(F.collect_list(text)).alias("blocks"))
    return whole.withColumn("repaired", F.array_join(F.filter(F.col("blocks.lines"), lambda s: s.isNotNull()), "\n")).drop("blocks")
