"""Repair of conversations whose turns are missing, repeated, cut off or in the wrong role.

A conversation should read ``(s?(ua)+)?`` in the initials of its roles. Turns may be
kept, given the role user or assistant, deleted, and empty turns of these roles may
be inserted; the cheapest edits are found by weighted CYK parsing. The nonterminals
of the grammar are pairs of states of that pattern (start, after s, after u, after
a): ``X_pq`` derives the spans whose turns can be edited so that they lead from
``p`` to ``q``. In Chomsky normal form the rules are ``X_pq -> X_pr X_rq`` and, for
one turn, ``X_pq -> turn`` with its cheapest edit, closed under insertions before
and behind it. A cell of a span holds the least (cost, audit) of every
nonterminal, audits compared as text.

Cells are combined bottom up by span length. Every split of a span gives the same
cell: no audit of a cell begins with another of the same cost, so the least of the
whole is made of the least of its parts, and insertions at the split belong to
either side. One split a span is therefore enough, and spans of 1, 2, 4, ... turns
suffice, within tasks as well as between them: a long conversation is parsed in
pieces by many tasks, whose cells (one a piece) are combined at the end.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
_LEGAL = {"su", "ua", "au"}
#: Turns whose cells are remembered by their kinds, and turns parsed at once.
REMEMBERED, AT_ONCE = 16, 4096
Cell = tuple  # 16 entries, of p * 4 + q: (cost, audit) or None


def _moves(initial: str) -> list[tuple[int, int]]:
    """State pairs that a turn of this role leads through."""
    return {"s": [(START, SYSTEM)], "u": [(START, USER), (SYSTEM, USER), (ASSISTANT, USER)], "a": [(USER, ASSISTANT)]}.get(initial, [])


def _least(entries: list[tuple[int, int, tuple[int, str]]]) -> Cell:
    cell: list[tuple[int, str] | None] = [None] * 16
    for p, q, entry in entries:
        if cell[p * 4 + q] is None or entry < cell[p * 4 + q]:
            cell[p * 4 + q] = entry
    return tuple(cell)


def combined(left: Cell, right: Cell) -> Cell:
    """The cell of two spans side by side: all rules ``X_pq -> X_pr X_rq``."""
    cell = []
    for p in (0, 4, 8, 12):
        ways = [(left[p + r], 4 * r) for r in STATES if left[p + r] is not None]
        for q in STATES:
            best = None
            for a, r in ways:
                b = right[r + q]
                if b is not None and (best is None or a[0] + b[0] <= best[0]):
                    entry = (a[0] + b[0], a[1] + b[1])
                    if best is None or entry < best:
                        best = entry
            cell.append(best)
    return tuple(cell)


_NOTHING = _least([(p, p, (0, "")) for p in STATES])
_INSERT = _least([(p, q, (INSERT, "I")) for role in "ua" for p, q in _moves(role)] + [(p, p, (0, "")) for p in STATES])
#: Insertions alone; three in a row never lead further than one.
_INSERTIONS = combined(_INSERT, _INSERT)


def terminal(kind: str) -> Cell:
    """The cell of one turn: an initial, capital if the turn is cut off, or ``x`` if it has to go."""
    entries = [(p, p, (DELETE, "D")) for p in STATES]
    if kind != "x":
        extra = CUT_OFF if kind.isupper() or kind == "_" else 0
        entries += [(p, q, (KEEP + extra, "K")) for p, q in _moves(kind.lower())]
        entries += [(p, q, (REROLE + extra, "R")) for role in "ua" for p, q in _moves(role)]
    return combined(combined(_INSERTIONS, _least(entries)), _INSERTIONS)


@lru_cache(maxsize=1 << 15)
def _remembered(kinds: str) -> Cell:
    if len(kinds) == 1:
        return terminal(kinds)
    half = 1 << (len(kinds) - 1).bit_length() - 1
    return combined(_remembered(kinds[:half]), _remembered(kinds[half:]))


def cell_of(kinds: str) -> Cell:
    """The cell of a span of turns, from shorter spans to longer ones."""
    if not kinds:
        return _NOTHING
    cells = [_remembered(kinds[i:i + REMEMBERED]) for i in range(0, len(kinds), REMEMBERED)]
    while len(cells) > 1:
        cells = [combined(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


class Piece:
    """What is known of consecutive turns of one conversation."""

    def __init__(self):
        self.waiting, self.spans = "", []  # kinds not parsed yet; (length, cell), lengths falling
        self.first = self.last = ""
        self.illegal = self.blank = self.duplicate = self.truncated = self.rows = 0
        self.low = self.high = None
        self.turns = 0

    def add_turn(self, turn) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn

    def add(self, turn, initial: str, blank: bool, first: bool, truncated: bool, copies: int) -> None:
        """``copies`` equal turns, of which the first is new to the conversation if ``first``."""
        self.add_turn(turn)
        self.illegal += copies - 1 + (self.rows > 0 and self.last + initial not in _LEGAL)
        self.first = self.first if self.rows else initial
        self.last, self.rows = initial, self.rows + copies
        goes = copies
        if blank:
            self.blank += copies
        else:
            goes -= first
            self.duplicate += goes
            if first:
                self.truncated += truncated
                self.waiting += (initial.upper() if initial != "-" else "_") if truncated else initial
        self.waiting += "x" * goes
        while len(self.waiting) >= AT_ONCE:
            self.push(AT_ONCE, cell_of(self.waiting[:AT_ONCE]))
            self.waiting = self.waiting[AT_ONCE:]

    def push(self, length: int, cell: Cell) -> None:
        while self.spans and self.spans[-1][0] <= length:
            before, left = self.spans.pop()
            length, cell = before + length, combined(left, cell)
        self.spans.append((length, cell))

    def cell(self) -> Cell:
        cell = cell_of(self.waiting)
        for _, left in reversed(self.spans):
            cell = combined(left, cell)
        return cell

    def follow(self, row: dict) -> None:
        """Take in the piece behind this one."""
        self.illegal += row["illegal"] + (self.rows > 0 and self.last + row["first"] not in _LEGAL)
        self.last, self.rows = row["last"], self.rows + row["rows"]
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + row[name])
        if row["turns"]:
            self.turns += row["turns"] - (row["low"] == self.high)
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        self.push(row["rows"], tuple(None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])))


_PIECE = {"piece": pa.int64(), "first": pa.string(), "last": pa.string(), "illegal": pa.int64(), "blank": pa.int64(),
          "duplicate": pa.int64(), "truncated": pa.int64(), "rows": pa.int64(), "low": pa.int64(), "high": pa.int64(),
          "turns": pa.int64(), "costs": pa.list_(pa.int64()), "audits": pa.list_(pa.string())}
_PIECE_SQL = ("piece long, first string, last string, illegal long, blank long, duplicate long, truncated long, rows long, "
              "low long, high long, turns long, costs array<long>, audits array<string>")
_PARSED = {"rows": pa.int64(), "gaps": pa.int64(), "blank": pa.int64(), "duplicate": pa.int64(), "truncated": pa.int64(),
           "illegal": pa.int64(), "cost": pa.int64(), "audit": pa.string()}
_PARSED_SQL = "rows long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.DataType, object, bool, dict]]:
    """(type of the id, id, whether a conversation begins, row) of batches sorted by conversation."""
    now = None
    for batch in batches:
        kind = batch.schema.field("conv_id").type
        for row in batch.to_pylist():
            begins = now != (row["conv_id"],)
            now = (row["conv_id"],)
            yield kind, row["conv_id"], begins, row


def _batched(rows: Iterator[tuple[pa.DataType, dict]], columns: dict[str, pa.DataType], size: int = 1000) -> Iterator[pa.RecordBatch]:
    waiting, kind = [], None
    for kind, row in rows:
        waiting.append(row)
        if len(waiting) >= size:
            yield pa.RecordBatch.from_pylist(waiting, pa.schema({"conv_id": kind, **columns}))
            waiting = []
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, pa.schema({"conv_id": kind, **columns}))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId()

    def done(conv, piece: Piece) -> dict:
        cell = piece.cell()
        return {"conv_id": conv, "piece": number, **{c: getattr(piece, c) for c in list(_PIECE)[1:11]},
                "costs": [e and e[0] for e in cell], "audits": [e and e[1] for e in cell]}

    def run():
        conv = piece = kind = None
        for kind, key, begins, row in _grouped(batches):
            if begins:
                if piece is not None:
                    yield kind, done(conv, piece)
                conv, piece = key, Piece()
            piece.add(row["turn"], row["initial"], row["blank"], row["is_first"], row["truncated"], row["copies"])
        if piece is not None:
            yield kind, done(conv, piece)

    yield from _batched(run(), _PIECE)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(conv, piece: Piece) -> dict:
        cell = piece.cell()
        cost, audit = min(e for e in (cell[START * 4 + START], cell[START * 4 + ASSISTANT]) if e is not None)
        gaps = piece.high - piece.low + 1 - piece.turns if piece.turns else 0
        return {"conv_id": conv, "rows": piece.rows, "gaps": gaps, "blank": piece.blank, "duplicate": piece.duplicate,
                "truncated": piece.truncated, "illegal": piece.illegal, "cost": cost, "audit": audit}

    def run():
        conv = piece = kind = None
        for kind, key, begins, row in _grouped(batches):
            if begins:
                if piece is not None:
                    yield kind, done(conv, piece)
                conv, piece = key, Piece()
            piece.follow(row)
        if piece is not None:
            yield kind, done(conv, piece)

    yield from _batched(run(), _PARSED)


def _turns(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                        F.coalesce(F.col(f"`{role_col}`"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(f"`{text_col}`"), F.lit(" ")).alias("text"))
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    return rows.withColumn("said", said)


def parse(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, rows, gaps, blank, duplicate, truncated, illegal, cost, audit``.

    Rows are read by turn (nulls first), ties by a digest of role and text. The
    first fault of a row counts: blank text; duplicate (an earlier row of the
    conversation has the same role and text, so all but one of repeated rows);
    truncated (the last visible character is not one of ``.!?``). ``gaps`` counts
    the turn numbers that are missing between the least and the greatest,
    ``illegal`` the neighbours whose initials are not su, ua or au. ``audit`` has a
    letter for each edit in order: K(eep), R(erole), D(elete), I(nsert). Null role
    and text count as one space; rows without conversation id form one
    conversation; an empty table gives an empty result; other columns are ignored.
    Equal rows are counted before they are shuffled, and only digests, initials
    and faults of the rows are sorted; a conversation of any length is parsed in
    the pieces that the range partitioning by (conversation, turn) makes.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    initial = F.substring("role", 1, 1)
    faults = rows.select(
        "conv_id", "turn", "said", F.when(initial.isin("s", "u", "a"), initial).otherwise("-").alias("initial"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"),
        (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"))
    counted = faults.groupBy(*faults.columns).agg(F.count(F.lit(1)).alias("copies"))
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = counted.groupBy(F.col("conv_id").alias("of"), F.col("said").alias("what")).agg(F.min(order).alias("first_turn"))
    known = counted.join(firsts, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("what")))
    known = known.withColumn("is_first", order == F.col("first_turn")).select(*counted.columns, "is_first")
    at = ["conv_id", "turn", "said"]
    kind = dict(rows.dtypes)["conv_id"]
    pieces = known.repartitionByRange(*at).sortWithinPartitions(*at).mapInArrow(_pieces, f"conv_id {kind}, {_PIECE_SQL}")
    return pieces.repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_whole, f"conv_id {kind}, {_PARSED_SQL}")


_EDITS = {"K": "keep", "R": "rerole", "D": "delete", "I": "insert"}


class Editor:
    """Applies an audit to the turns of a conversation in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state, self.steps = audit, 0, START, 0

    def _step(self, letter: str, role: str, text: str) -> dict:
        if letter in "RI":
            role, self.state = ("assistant", ASSISTANT) if self.state == USER else ("user", USER)
        elif letter == "K":
            self.state = {"s": SYSTEM, "u": USER, "a": ASSISTANT}[role[:1]]
        self.at += 1
        self.steps += 1
        return {"step": self.steps - 1, "edit": _EDITS[letter], "role": role, "text": text}

    def inserts(self) -> Iterator[dict]:
        while self.audit[self.at:self.at + 1] == "I":
            yield self._step("I", "", "")

    def turn(self, role: str, text: str) -> Iterator[dict]:
        yield from self.inserts()
        yield self._step(self.audit[self.at], role, text)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run():
        editor = conv = kind = None
        for kind, key, begins, row in _grouped(batches):
            if begins:
                if editor is not None:
                    yield from ((kind, {"conv_id": conv, **step}) for step in editor.inserts())
                conv, editor = key, Editor(row["audit"])  # the audit comes before the turns
                continue
            yield from ((kind, {"conv_id": conv, **step}) for step in editor.turn(row["role"], row["text"]))
        if editor is not None:
            yield from ((kind, {"conv_id": conv, **step}) for step in editor.inserts())

    yield from _batched(run(), {"step": pa.int64(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}, 200)


def repair(turns: DataFrame, parsed: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """Every edit of the turns by ``parsed`` (the result of `parse` for the same turns): ``conv_id, step, edit, role, text``.

    ``edit`` is keep, rerole, delete or insert, ``role`` and ``text`` are those of
    the repaired turn (of a deleted one, its own). ``step`` counts the edits of a
    conversation from 0. Rows of a conversation lie together in order of ``step``.
    Turns pass through a task as a stream; it holds one audit and a few turns.
    """
    rows = _turns(turns, conv_col, turn_col, role_col, text_col)
    both = rows.select("conv_id", F.lit(1).alias("part"), "turn", "said", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(
        parsed.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), *[
            F.lit(None).cast("string").alias(c) for c in ("said", "role", "text")], "audit"))
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "part", "turn", "said")
    return ordered.select("conv_id", "audit", "role", "text").mapInArrow(
        _edit, f"conv_id {dict(rows.dtypes)['conv_id']}, step long, edit string, role string, text string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def run():
        digest = conv = kind = None
        for kind, key, begins, row in _grouped(batches):
            if begins:
                if digest is not None:
                    yield kind, {"conv_id": conv, "turns": turns, "repaired_sha256": digest.hexdigest()}
                conv, digest, turns = key, hashlib.sha256(), 0
            if row["edit"] != "delete":
                digest.update((b"\n" if turns else b"") + f"{row['role']}:{row['text']}".encode())
                turns += 1
        if digest is not None:
            yield kind, {"conv_id": conv, "turns": turns, "repaired_sha256": digest.hexdigest()}

    yield from _batched(run(), {"turns": pa.int64(), "repaired_sha256": pa.string()})


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, turns, repaired_sha256`` of the result of `repair`, whose rows it reads as they lie: the repaired turns
    and the digest of their ``role:text``, joined by line ends."""
    return repaired.mapInArrow(_digest, f"conv_id {dict(repaired.dtypes)['conv_id']}, turns long, repaired_sha256 string")
