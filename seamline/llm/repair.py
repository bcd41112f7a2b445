"""Conversation structure repair: the cheapest edits that give a legal order of roles, by an auction shortest path.

Legal role initials are ``(s?(ua)+)?``: nothing, or an optional system turn, then user and assistant in turn. A conversation
spans a lattice: a node is (rows read, role last written), an arc an edit with a whole cost. Keep and Rerole read a row and
write a turn, Delete only reads, Insert only writes. The auction algorithm keeps a price per node, at most an arc's cost
above the price of the node it leads to, and a path from the origin. It looks at the end of the path: if all arcs there
cost more than the price says, the price rises to the cheapest and the path contracts by a node; otherwise the path
extends along an arc that the price matches. When the path reaches the end, the origin's price is the least cost, and all
arcs of all cheapest paths are tight. The repair is the path of tight arcs whose edits' initials come first in ASCII.

Blocks: a long conversation is cut into blocks of ``BLOCK`` rows, solved from the last to the first. The prices at the head
of a block are the costs of leaving the one before it, so a block's lattice is all that is solved at once; prices found
from one role hold for the next origin, which starts from them. Few patterns of rows are distinct, so a task keeps what it
solved (``KEPT`` blocks).

Spark: faults come from expressions and one window per (conversation, role, digest of the text); rows without texts, sorted
inside partitions, stream through the solver, which holds a letter per row of one conversation. Texts are shuffled once,
behind the audit of their conversation, and stream through the edits. No conversation is ever collected; its rows pass one
task in order, as its audit is one value and its digest is over their concatenation.

Defined cases: a null role or text is one space; null turns come first and are not counted as gaps; rows that tie on
``turn`` are ordered by role, then SHA-256 of the text, repeated rows are duplicates of the first; texts are equal if their SHA-256 is;
a null conv_id is one conversation; an empty table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seamline.llm.common import arrow_map

#: Costs of the edits, and of a truncated row that is not deleted.
DELETE, INSERT, KEEP, REROLE, TRUNCATED = 4, 3, 0, 3, 3
#: Rows per block, and solved blocks that a task remembers.
BLOCK = 64
KEPT = 1 << 16
#: Roles last written; what an inserted or renamed turn must be after each.
START, SYSTEM, USER, ASSISTANT = range(4)
THEN = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Roles that a kept row of an initial may follow, and what it leaves.
MAY = {"s": ((START,), SYSTEM), "u": ((START, SYSTEM, ASSISTANT), USER), "a": ((USER,), ASSISTANT)}
#: Costs of ending after each role.
END = (0, None, None, 0)

WHITE = " \t\n\x0b\x0c\r"


def arcs(rows: str, leave: tuple, last: bool) -> list[list[tuple]]:
    """Arcs (edit, cost, node) of every node 4 * rows read + role, edits in ASCII order; the last node is the end.

    ``rows``: a letter per row. ``x`` must be deleted; otherwise the role's initial (``o``: any other), in capitals if truncated.
    Inserts after the last row belong to the next block, if there is one.
    """
    end, out = 4 * len(rows) + 4, []
    for at in range(len(rows) + 1):
        row = rows[at : at + 1]
        initial, more = row.lower(), TRUNCATED if row.isupper() else 0
        for role in range(4):
            here = []
            if row:
                here.append(("D", DELETE, 4 * (at + 1) + role))
            if row or last:
                here.append(("I", INSERT, 4 * at + THEN[role]))
            if row and row != "x":
                if initial in MAY and role in MAY[initial][0]:
                    here.append(("K", KEEP + more, 4 * (at + 1) + MAY[initial][1]))
                here.append(("R", REROLE + more, 4 * (at + 1) + THEN[role]))
            if not row and leave[role] is not None:
                here.append(("", leave[role], end))
            out.append(here)
    return [*out, []]


def auction(graph: list[list[tuple]], prices: list[int], origin: int) -> None:
    """Raise ``prices`` until a path of tight arcs leads from the origin to the last node."""
    end, path = len(graph) - 1, [origin]
    while (at := path[-1]) != end:
        least, to = min((cost + prices[node], node) for _, cost, node in graph[at])
        if prices[at] < least:
            prices[at] = least
            if len(path) > 1:
                path.pop()
        else:
            path.append(to)


def trace(graph: list[list[tuple]], prices: list[int], origin: int) -> tuple[str, int]:
    """The least string of edits over tight arcs from the origin to the end, and the role it ends with."""
    end, dead = len(graph) - 1, set()
    path, edits, open_ = [origin], [], [iter(graph[origin])]
    while path[-1] != end:
        at = path[-1]
        for edit, cost, node in open_[-1]:
            if prices[at] == cost + prices[node] and node not in dead:
                path.append(node)
                edits.append(edit)
                open_.append(iter(graph[node]))
                break
        else:
            dead.add(path.pop())
            open_.pop()
            edits.pop()
    return "".join(edits), path[-2] % 4


@lru_cache(maxsize=KEPT)
def solve(rows: str, leave: tuple, last: bool, first: bool) -> tuple:
    """(least cost, edits, role left with) of a block from each role it may begin with."""
    graph = arcs(rows, leave, last)
    prices, out = [0] * len(graph), []
    for origin in (START,) if first else range(4):
        auction(graph, prices, origin)
        out.append((prices[origin], *trace(graph, prices, origin)))
    return tuple(out)


def repair(rows: str) -> tuple[int, str]:
    """Least cost and edits of a conversation, given as a letter per row."""
    starts = range(0, len(rows), BLOCK) or (0,)
    leave, cost, solved = END, 0, []
    for start in reversed(starts):
        found = solve(rows[start : start + BLOCK], leave, start == starts[-1], start == 0)
        solved.append(found)
        low = min(f[0] for f in found)
        cost, leave = cost + low, tuple(f[0] - low for f in found)
    role, edits = START, []
    for found in reversed(solved):
        _, piece, role = found[role]
        edits.append(piece)
    return cost, "".join(edits)


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256))


def _plain(turns: DataFrame, copy: str | None, live: str | None) -> DataFrame:
    """conv_id, turn, role and text without nulls in the last two, copy, live."""
    return turns.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        (F.col(copy) if copy else F.lit(0)).alias("copy"),
        (F.col(live) if live else F.lit(True)).alias("live"),
    )


def faults(turns: DataFrame) -> DataFrame:
    """Rows as from ``_plain``, without their texts: conv_id, turn, role, digest, copy, and ``code``, the row's letter and its role's initial.

    Letters: ``-`` a row that is not there, ``b`` blank, ``r`` duplicate, otherwise the initial, in capitals if truncated.
    """
    text, initial = F.col("text"), F.substring("role", 1, 1)
    compact = turns.select(
        "conv_id", "turn", "role", _digest().alias("digest"), "copy", "live",
        F.ltrim(text, F.lit(WHITE)).eqNullSafe("").alias("blank"),
        (~F.right(F.rtrim(text, F.lit(WHITE)), F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )
    nth = F.row_number().over(Window.partitionBy("conv_id", "live", "role", "digest").orderBy("turn", "copy"))
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    letter = F.when(~F.col("live"), "-").when(F.col("blank"), "b").when(F.col("nth") > 1, "r").when(F.col("cut"), F.upper(known)).otherwise(known)
    return compact.repartition("conv_id").withColumn("nth", nth).select("conv_id", "turn", "role", "digest", "copy", F.concat(letter, known).alias("code"))


def _auditing(kind):
    def run(batches):
        at, begun, done = None, False, []
        rows, turns, roles = [], [], []

        def finish():
            letters = "".join(rows)
            cost, audit = repair(letters.translate(HARD))
            gaps = turns[-1] - turns[0] + 1 - (1 + sum(a != b for a, b in zip(turns, turns[1:], strict=False))) if turns else 0
            illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
            done.append((at, gaps, letters.count("b"), letters.count("r"), sum(c.isupper() for c in letters), illegal, cost, audit))

        def out():
            columns = zip(*done, strict=True)
            block = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *[pa.int64()] * 6, pa.string()], strict=True)], names=AUDIT)
            done.clear()
            return block

        for b in batches:
            for who, turn, code in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not begun or who != at:
                    if begun:
                        finish()
                    at, begun = who, True
                    rows, turns, roles = [], [], []
                if code[0] != "-":
                    rows.append(code[0])
                    roles.append(code[1])
                    if turn is not None:
                        turns.append(turn)
            if done:
                yield out()
        if begun:
            finish()
            yield out()

    return run


HARD = str.maketrans("br", "xx")
AUDIT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


def audits(turns: DataFrame, copy: str | None = None, live: str | None = None) -> DataFrame:
    """One row per conversation: gaps, faults, illegal neighbours, least cost, and the edits' initials.

    ``copy`` names a column that orders repeated rows, ``live`` one that is false for rows that only keep their conversation in the result.
    """
    kind = turns.schema["conv_id"].dataType
    sorted_ = faults(_plain(turns, copy, live)).sortWithinPartitions("conv_id", "turn", "role", "digest", "copy").select("conv_id", "turn", "code")
    schema = f"conv_id {kind.simpleString()}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return arrow_map(sorted_, _auditing(_arrow(kind)), schema, 4096)


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _editing(kind):
    def run(batches):
        audit, at, role, place = "", 0, START, 0
        for b in batches:
            done = []

            def write(who, edit, name, text):
                nonlocal role, place
                role = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[name[0]]
                done.append((who, place, edit, name, text))  # noqa: B023
                place += 1

            def inserts(who):
                nonlocal at
                while audit[at : at + 1] == "I":
                    write(who, "I", NAMES[THEN[role]], "")
                    at += 1

            for who, tag, name, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if tag == 0:
                    audit, at, role, place = text, 0, START, 0
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        write(who, edit, name if edit == "K" else NAMES[THEN[role]], text)
                inserts(who)
            columns = list(zip(*done, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=REPAIRED)

    return run


REPAIRED = ["conv_id", "place", "edit", "role", "text"]


def repaired(turns: DataFrame, found: DataFrame, copy: str | None = None, live: str | None = None) -> DataFrame:
    """The repaired conversations' turns: conv_id, place (from 0), edit, role, text.

    A conversation's rows are neighbours in one partition, in order.
    """
    kind = turns.schema["conv_id"].dataType
    lead = found.select("conv_id", F.lit(0).alias("tag"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("copy"))
    rows = _plain(turns, copy, live).where("live").select("conv_id", F.lit(1).alias("tag"), "role", "text", "turn", _digest().alias("digest"), "copy")
    sorted_ = lead.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "tag", "turn", "role", "digest", "copy")
    schema = f"conv_id {kind.simpleString()}, place long, edit string, role string, text string"
    return arrow_map(sorted_.select("conv_id", "tag", "role", "text"), _editing(_arrow(kind)), schema)
