"""Repair of conversations by weighted CYK parsing of intervals.

A well-formed conversation is empty, or an optional system turn and then pairs of a user and an assistant turn.  The repair
grammar is in Chomsky normal form: a nonterminal [p, q] stands for turns that lead from state p to state q, with the rules
[p, q] -> [p, r] [r, q], and [p, q] -> a row under one edit.  Rows may be kept, get another role or be deleted; empty turns may
be inserted before and behind each row (the closure of a cell under insertion).  The cell of an interval holds the
cheapest (cost, audit) of each nonterminal; cells are combined bottom-up by span length.

Where the parts of [p, q] are cut makes no difference in this grammar: all bracketings derive the same turns.  So an
interval needs one of its splits, and the table holds the spans of 1, 2, 4, ... rows: as many cells as rows, not their square.

Costs tie only between audits of which neither starts with the other (the shorter one's continuation would be free
insertions), so the least audit of the whole is made of the least audits of its parts.

In Spark, a conversation of any length is cut into chunks of a fixed number of rows; each chunk's task parses its interval, and
one cell per chunk and conversation goes on to the upper levels of the table.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .common import batches_of, rows_of, written

BLANK = "\t\n\x0b\f\r "
ENDS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5  # costs; CUT: of a truncated turn that stays
START, SYSTEM, ASKED, PAIRED = range(4)  # nothing said yet, a system turn, a user turn without answer, a pair
GOES = {(START, "s"): SYSTEM, (START, "u"): ASKED, (SYSTEM, "u"): ASKED, (PAIRED, "u"): ASKED, (ASKED, "a"): PAIRED}
LEGAL = ("su", "ua", "au")
FINE, TRUNCATED, GONE = range(3)
INITIALS = "sua-"
CHUNK = 4096  # rows; a power of two, so that no chunk lies in two partitions of the ordered rows
PREFIX = 256

Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> tuple[Cell, dict]:
    """The cell of two neighbouring intervals, and the middle state of each of its entries."""
    cell, middle = {}, {}
    for (p, r), (cost, audit) in left.items():
        for q in range(4):
            if (other := right.get((r, q))) is not None:
                both = cost + other[0], audit + other[1]
                if (p, q) not in cell or both < cell[p, q]:
                    cell[p, q], middle[p, q] = both, r
    return cell, middle


def _insertions() -> Cell:
    """The empty interval, closed under insertion."""
    one = {(p, p): (0, "") for p in range(4)} | {(p, q): (INSERT, "I") for (p, role), q in GOES.items() if role != "s"}
    while (more := combine(one, one)[0]) != one:
        one = more
    return one


@lru_cache(None)
def row_cell(mark: str) -> Cell:
    """The cell of one row: its edits, closed under insertion on both sides."""
    initial, fault = read_mark(mark)
    cell: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault != GONE:
        extra = CUT if fault == TRUNCATED else 0
        for (p, role), q in GOES.items():
            edits = [(KEEP + extra, "K")] * (role == initial) + [(REROLE + extra, "R")] * (role != "s")
            for e in edits:
                cell[p, q] = min(cell.get((p, q), e), e)
    inserted = _insertions()
    return combine(combine(inserted, cell)[0], inserted)[0]


def mark_of(initial: str, fault: int) -> str:
    """One character for what decides a row's edits: its role's initial ("-": none that the grammar knows) and its fault."""
    return chr(97 + 3 * (INITIALS.index(initial) if initial and initial in INITIALS else 3) + fault)


def read_mark(mark: str) -> tuple[str, int]:
    i = ord(mark) - 97
    return INITIALS[i // 3], i % 3


def table(cells: list[Cell]) -> tuple[Cell, list[list[dict]]]:
    """The top cell, and for each level of the table the middle states of its combined cells (None: carried up)."""
    levels = []
    while len(cells) > 1:
        pairs = [combine(a, b) for a, b in zip(cells[::2], cells[1::2])]
        levels.append([m for _, m in pairs])
        cells = [c for c, _ in pairs] + ([cells[-1]] if len(cells) % 2 else [])
    return cells[0], levels


def derived(levels: list[list[dict]], p: int, q: int) -> list[tuple[int, int]]:
    """The nonterminal of each bottom cell in the derivation of [p, q]."""
    spans = [(p, q)]
    for level in reversed(levels):
        down = []
        for i, (a, b) in enumerate(spans):
            down += [(a, r), (r, b)] if i < len(level) and (r := level[i][a, b]) is not None else [(a, b)]
        spans = down
    return spans


def edited(audit: str, marks: str, state: int):
    """(row, role, inserted) of each turn that an audit leaves, in order; a kept row's role is None.

    An inserted turn belongs to the row that follows it in the audit's part, or else to the one before.
    """
    row = 0
    for letter in audit:
        if letter in "RI":
            initial = "a" if state == ASKED else "u"
            yield min(row, len(marks) - 1), "assistant" if initial == "a" else "user", letter == "I"
            state = GOES[state, initial]
        elif letter == "K":
            yield row, None, False
            state = GOES[state, read_mark(marks[row])[0]]
        row += letter != "I"


def ordered(conversations: DataFrame) -> DataFrame:
    """(pos, conv_id, turn, role, text), written: ``pos`` grows with conv_id, turn (null first), role, text.

    Rows are dealt by ranges of these, so that a long conversation spreads over tasks; rows that are equal but for what
    follows the first ``PREFIX`` code points of the text share a task.
    """
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    start = F.left("text", F.lit(PREFIX))
    # equal rows may lie in any order: where the prefix is the whole text, a number spreads them
    spread = F.when(F.length("text") <= PREFIX, F.monotonically_increasing_id()).otherwise(F.lit(0))
    dealt = (rows.withColumns({"_start": start, "_spread": spread})
             .repartitionByRange("conv_id", "turn", "role", "_start", "_spread").sortWithinPartitions("conv_id", "turn", "role", "text"))
    return written(dealt.select(F.monotonically_increasing_id().alias("pos"), "conv_id", "turn", "role", "text"), "turns")


def _faults(rows: DataFrame) -> DataFrame:
    """One group per chunk: its rows, and which of them are the first of their role and text in a conversation."""
    said = F.rtrim(F.col("text"), F.lit(BLANK))
    seen = rows.select("pos", "conv_id", F.col("turn").cast("long").alias("turn"), F.left("role", F.lit(1)).alias("initial"), "role",
                       F.md5(F.col("text").cast("binary")).alias("key"), (said == "").alias("blank"), (~F.right(said, F.lit(1)).isin(*ENDS)).alias("cut"))
    firsts = seen.where(~F.col("blank")).groupBy("conv_id", "role", "key").agg(F.min("pos").alias("pos"))
    columns = ["pos", "conv_id", "turn", "initial", "blank", "cut"]
    nothing = [F.lit(None).cast(seen.schema[c].dataType).alias(c) for c in columns[1:]]
    both = seen.select(*columns, F.lit(False).alias("first")).unionByName(firsts.select("pos", *nothing, F.lit(True).alias("first")))
    return both.withColumn("chunk", F.shiftright("pos", CHUNK.bit_length() - 1)).groupBy("chunk")


_PIECE = [("at", "long"), ("n", "long"), ("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("turns", "long"),
          ("least", "long"), ("most", "long"), ("first_initial", "string"), ("last_initial", "string"), ("marks", "string"),
          ("cell", "array<struct<p:int,q:int,cost:long,audit:string>>")]
_PIECES = "array<struct<at:long,state:int,audit:string,marks:string>>"
_REPORT = [(c, "long") for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]


def schemas(columns: list[tuple[str, str]]) -> tuple[StructType, pa.Schema]:
    spark_schema = StructType.fromDDL(", ".join(f"{n} {t}" for n, t in columns))
    return spark_schema, to_arrow_schema(spark_schema)


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def repair(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report, turns) of (conv_id, turn, role, text).

    ``report``: conv_id, gaps (numbers missing between the least and the largest turn), blank, duplicate, truncated (rows by
    their first fault), illegal (neighbours whose roles' initials don't follow each other), cost and audit of the cheapest
    repair, on ties the least audit.  ``turns``: conv_id, pos, seq, role, text of the repaired conversations; their
    order is that of pos and seq.

    Turns are ordered by turn (null first), then role, then text; null roles and texts count as empty; rows that repeat are
    turns of their own, and all but the first are duplicates; a null conv_id is a conversation like any other.  Other columns
    are not read; an empty table gives empty results.
    """
    rows = ordered(conversations)
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def parse_chunk(key, group):
        """A row for each conversation of the chunk."""
        group = group.sort_by([("pos", "ascending"), ("first", "ascending")])
        lines, pieces = [], []
        for pos, conv, turn, initial, blank, cut, first in rows_of(group.to_batches(), "pos", "conv_id", "turn", "initial", "blank", "cut", "first"):
            if first:
                lines[-1][-1] = True  # belongs to the row of the same pos
            else:
                lines.append([conv, pos, turn, initial, blank, cut, False])
        for conv, run in groupby(lines, lambda x: x[0]):
            run = list(run)
            initials = [x[3] for x in run]
            duplicate = [not x[4] and not x[6] for x in run]
            cut = [not x[4] and x[6] and x[5] for x in run]
            marks = "".join(mark_of(x[3], GONE if x[4] or d else TRUNCATED if c else FINE) for x, d, c in zip(run, duplicate, cut))
            turns = {x[2] for x in run} - {None}
            pieces.append((conv, run[0][1], len(run), sum(x[4] for x in run), sum(duplicate), sum(cut), illegal_pairs(initials), len(turns),
                           min(turns, default=None), max(turns, default=None), initials[0], initials[-1], marks,
                           [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in table([row_cell(m) for m in marks])[0].items()]))
        return pa.Table.from_batches([*batches_of(iter(pieces), piece_schema)], piece_schema)

    pieces_of, piece_schema = schemas([("conv_id", id_type), *_PIECE])
    pieces = _faults(rows).applyInArrow(parse_chunk, pieces_of)
    settled_of, settled_schema = schemas([("conv_id", id_type), *_REPORT, ("audit", "string"), ("pieces", _PIECES)])

    def settle(batches):
        """The upper levels of the table: the pieces of each conversation, which come in order."""
        names = ["conv_id", *[n for n, _ in _PIECE]]

        def out():
            for conv, run in groupby(rows_of(batches, *names), lambda x: x[0]):
                parts = [dict(zip(names, x)) for x in run]
                cells = [{(e["p"], e["q"]): (e["cost"], e["audit"]) for e in x["cell"]} for x in parts]
                top, levels = table(cells)
                (cost, audit), end = min((top[START, q], q) for q in (START, PAIRED) if (START, q) in top)
                chosen = [(x["at"], p, c[p, q][1], x["marks"]) for x, c, (p, q) in zip(parts, cells, derived(levels, START, end))]
                known = [x for x in parts if x["turns"]]
                met = sum(a["most"] == b["least"] for a, b in zip(known, known[1:]))  # a turn that lies in two pieces
                gaps = known[-1]["most"] - known[0]["least"] + 1 - sum(x["turns"] for x in known) + met if known else 0
                illegal = sum(x["illegal"] for x in parts) + sum(a["last_initial"] + b["first_initial"] not in LEGAL for a, b in zip(parts, parts[1:]))
                yield (conv, gaps, *[sum(x[k] for x in parts) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
                       [dict(zip(("at", "state", "audit", "marks"), c)) for c in chosen])

        return batches_of(out(), settled_schema, 2000, lambda x: 3 * len(x[7]))

    settled = written(pieces.repartition("conv_id").sortWithinPartitions("conv_id", "at").mapInArrow(settle, settled_of), "repairs")
    edits_of, edit_schema = schemas([("pos", "long"), ("seq", "int"), ("new_role", "string"), ("inserted", "boolean")])

    def apply(batches):
        def out():
            for at, state, audit, marks in rows_of(batches, "at", "state", "audit", "marks"):
                for seq, (row, role, inserted) in enumerate(edited(audit, marks, state)):
                    yield at + row, seq, role, inserted

        return batches_of(out(), edit_schema)

    edits = settled.select(F.explode("pieces").alias("x")).select("x.*").mapInArrow(apply, edits_of)
    turns = edits.join(rows.select("pos", "conv_id", "role", "text"), "pos").select(
        "conv_id", "pos", "seq", F.coalesce("new_role", "role").alias("role"), F.when(F.col("inserted"), F.lit("")).otherwise(F.col("text")).alias("text"))
    return settled.drop("pieces"), turns

