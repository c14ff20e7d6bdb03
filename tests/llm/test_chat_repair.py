"""Conversation repair against parsing of all spans by all splits, and against trying all edits."""

import hashlib
import itertools
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from barloom.llm import chat_repair as cr
from barloom.llm.queries import QUERIES

KINDS = "suaSUA-_x"


def every_split(kinds):
    """CYK over all spans, each by all its splits."""
    n, cells = len(kinds), {}
    for size in range(1, n + 1):
        for i in range(n - size + 1):
            if size == 1:
                cells[i, i + 1] = cr.terminal(kinds[i])
                continue
            made = [cr.combined(cells[i, k], cells[k, i + size]) for k in range(i + 1, i + size)]
            assert len(set(made)) == 1  # every split gives the same cell
            cells[i, i + size] = made[0]
    return cells[0, n] if n else cr._NOTHING


def by_trying(kinds):
    """(cost, audit) of the best of all edits with at most two insertions in a gap."""
    best = None

    def roles_fit(roles):
        return re.fullmatch("(s?(ua)+)?", roles) is not None

    per_turn = []
    for k in kinds:
        ways = [(2, "D", "")]
        if k != "x":
            extra = 5 if k.isupper() or k == "_" else 0
            ways += [(extra, "K", k.lower() if k not in "-_" else "?"), (1 + extra, "R", "u"), (1 + extra, "R", "a")]
        per_turn.append(ways)
    gaps = [[(0, "", ""), (5, "I", "u"), (5, "I", "a"), (10, "II", "ua"), (10, "II", "au")]] * (len(kinds) + 1)
    for chosen in itertools.product(*per_turn):
        for filled in itertools.product(*gaps):
            steps = [filled[0]] + [x for pair in zip(chosen, filled[1:]) for x in pair]
            entry = (sum(s[0] for s in steps), "".join(s[1] for s in steps))
            if (best is None or entry < best) and roles_fit("".join(s[2] for s in steps)):
                best = entry
    return best


def final(cell):
    return min(e for e in (cell[0], cell[3]) if e is not None)


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=KINDS, max_size=24))
def test_one_split_a_span_is_enough(kinds):
    assert cr.cell_of(kinds) == every_split(kinds)
    piece = cr.Piece()
    for part in re.findall(".{1,5}", kinds):
        piece.push(len(part), cr.cell_of(part))
    assert piece.cell() == cr.cell_of(kinds)


def test_all_edits_of_short_conversations():
    for n in range(4):
        for kinds in map("".join, itertools.product(KINDS if n < 3 else "suaUx", repeat=n)):
            assert final(cr.cell_of(kinds)) == by_trying(kinds), kinds


def plain(rows):
    """A conversation (turn, role, text), by a table over turns and states."""
    said = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, said(r)))
    blank = duplicate = truncated = illegal = 0
    seen, best = set(), {0: (0, "", ())}

    def inserted(best):
        for _ in range(2):
            for p, (cost, audit, out) in list(best.items()):
                role, q = ("assistant", 3) if p == 2 else ("user", 2)
                put(best, q, (cost + 5, audit + "I", (*out, f"{role}:")))
        return best

    def put(table, state, entry):
        if state not in table or entry[:2] < table[state][:2]:
            table[state] = entry

    best = inserted(best)
    for i, (_, role, text) in enumerate(rows):
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        goes = cut = False
        if not visible:
            blank, goes = blank + 1, True
        elif (role, text) in seen:
            duplicate, goes = duplicate + 1, True
        elif visible[-1] not in ".!?":
            truncated, cut = truncated + 1, True
        seen.add((role, text))
        illegal += i > 0 and rows[i - 1][1][:1] + role[:1] not in ("su", "ua", "au")
        after = {}
        for p, (cost, audit, out) in best.items():
            put(after, p, (cost + 2, audit + "D", out))
            if not goes:
                to = {"s": 1, "u": 2, "a": 3}.get(role[:1])
                if (p, to) in ((0, 1), (0, 2), (1, 2), (3, 2), (2, 3)):
                    put(after, to, (cost + 5 * cut, audit + "K", (*out, f"{role}:{text}")))
                new, q = ("assistant", 3) if p == 2 else ("user", 2)
                put(after, q, (cost + 1 + 5 * cut, audit + "R", (*out, f"{new}:{text}")))
        best = inserted(after)
    cost, audit, out = min((best[s] for s in (0, 3) if s in best), key=lambda e: e[:2])
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, blank, duplicate, truncated, illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def run(spark, frame):
    parsed = cr.parse(frame).cache()
    hashes = {r.conv_id: r.repaired_sha256 for r in cr.digests(cr.repair(frame, parsed)).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r.conv_id: (*(r[c] for c in names), hashes[r.conv_id]) for r in parsed.collect()}


ODD = ["", " ", "\t\n", "Yes.", "No!", "why? ", "cut", "dots...", "a.b", "é.", " ", "x" * 200_000 + "."]


def test_random_conversations(spark):
    rng = random.Random(5)
    rows = [(c, rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", "tool", "", "User", None]),
             rng.choice([*ODD, None])) for c in [None, *range(60)] for _ in range(rng.randint(1, 14))]
    rows += rows[::9]
    frame = spark.createDataFrame([(*r, "z", 3) for r in rows], "conv_id long, turn long, role string, text string, said string, part int")
    want = {}
    for conv, turn, role, text in rows:
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    assert run(spark, frame) == {c: plain(v) for c, v in want.items()}
    assert cr.parse(frame.where("false")).collect() == []


def test_a_long_conversation_in_many_pieces(spark):
    rng = random.Random(6)
    rows = [(1, i, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Fine.", f"t{i}.", f"t{i}"]))
            for i in range(6000)] + [(0, 0, "user", "a."), (2, 0, "user", "a.")] + [(3, 7, "user", "Same.")] * 9000
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    want = {}
    for conv, *row in rows:
        want.setdefault(conv, []).append(tuple(row))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert run(spark, frame) == {c: plain(v) for c, v in want.items()}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_query_against_plain_parsing(spark, sf_dir):
    conversations = {}
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        rows = conversations.setdefault(r.conv_id, [])
        fate = zlib.crc32(f"{' ' if r.conv_id is None else r.conv_id}:{' ' if r.turn is None else r.turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (r.role, r.text))
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(r.turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    got = QUERIES["op12_conversation_repair"](spark, sf_dir)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == {c: plain(v) for c, v in conversations.items()}
    assert got.count() == len(conversations)
