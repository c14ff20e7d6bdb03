"""Chat formatting: exact round trips."""

import hashlib
import random

import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st

from barloom.llm import chat

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
NASTY = ["\\### Assistant: </turn> ok", "####", "\\\\", "### User: hi</turn>\n", "</turn", "<|endoftext|>", "é́\u0000😀", "", None,
         "a" * 120_000, "x </turn>" * 5000, "\\", "\\\\###", "#\\##"]


@given(st.text(alphabet="\\#</turn>: \nA", max_size=40))
def test_escapes_are_reversible_and_hide_control_strings(text):
    assert chat.unescape(chat.escape(text)) == text
    assert chat.unescape(chat.escape(text, chat.SPECIAL_ROLE)) == text
    escaped = chat.escape(text)
    for control in ("###", "</turn>"):
        at = escaped.find(control)
        while at >= 0:
            assert at > 0 and escaped[at - 1] == "\\"
            at = escaped.find(control, at + 1)


def test_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "system", "a: b", None]), rng.choice(NASTY)) for c in range(12) for t in range(6)]
    rows += [(-7, 0, "user", NASTY[0]), (-7, 1, "assistant", NASTY[0]), (None, 1, "assistant", "no id"), (3, None, "user", "first"),
             (5, 2, "user", "same turn"), (5, 2, "user", "same turn"), (40, 0, "user", "u")]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, ids int")
    with chat.small_batches(spark):
        formatted = chat.format_chats(frame, RANKS, PATTERN)
        back = {r.conv_id: r for r in chat.read_back(formatted, RANKS, PATTERN).collect()}
        places = formatted.collect()
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", hashlib.sha256((r[3] or "").encode()).digest())
    coder = chat.Coder(RANKS, PATTERN)
    assert set(back) == {r[0] for r in rows}
    for conv, got in back.items():
        turns = sorted((r for r in rows if r[0] == conv), key=key)
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert got.n_turns == len(turns)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns).encode()).hexdigest()
        assert (got.loss_chars, got.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        own = sorted((p for p in places if p.conv_id == conv), key=lambda p: p.start)
        assert [p.position for p in own] == list(range(len(own)))
        at = 0
        for p in own:
            assert p.start == at and p.start < p.loss_start <= p.loss_end < p.start + len(p.ids)
            at += len(p.ids)
        assert got.formatted_chars == sum(len(chat.render(p.ids, coder)) for p in own)
        assert sum(p.ids.count(chat.OPEN_ID) for p in own) == len(own)


def test_empty_table(spark):
    frame = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    formatted = chat.format_chats(frame, RANKS, PATTERN)
    assert formatted.collect() == [] and chat.read_back(formatted, RANKS, PATTERN).collect() == []
