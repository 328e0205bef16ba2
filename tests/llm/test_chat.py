import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from factloom.llm import chat
from factloom.llm.queries import ORACLES, QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "conv_id long, turn long, role string, text string, ids string, loss int"
TRICKY = [
    "", " ", "\n", "\\", "\\\\", "#", "##", "###", "####", "##### User: ", "### Assistant: ", "\\### Assistant: </turn> ok", "</turn>\n", "<\\/turn>", "</turn", "<", "</turn</turn>>", "### Role: x### Says: y", "<|endoftext|>",
    "é😀 👩‍👩‍👧 日本", "ends in a space ", " begins", "a\r\n\tb", "\x00", "word" * 500, "\\#", "<" * 5 + "/turn>", "#" * 50,
]


@pytest.fixture(scope="module")
def encoder():
    return chat.Encoder(PATH)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns):
    """The digest of turns (role, text), straight from them."""
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    size = sum(len(chat.head_of(r or "")) + len(chat.escaped(t or "")) + len("</turn>\n") for r, t in turns)
    return len(turns), sha("".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)), len(loss), sha(loss), size


@pytest.mark.parametrize("text", TRICKY)
def test_escapes_are_reversible_and_hide_all_marks(text):
    hidden = chat.escaped(text)
    assert chat.unescaped(hidden) == text
    for mark in [*chat.HEADS.values(), chat.OTHER, chat.SAYS, chat.TAIL, "</turn>"]:
        # Nor may the text with what stands before and after it make a mark at another place.
        assert (chat.HEADS["user"] + hidden + chat.TAIL).count(mark) == (mark in (chat.HEADS["user"], chat.TAIL, "</turn>"))


def test_every_assistant_text_lies_below_the_mask_once(encoder):
    rnd = random.Random(3)
    for _ in range(200):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "### Says: "]), "".join(rnd.choice(TRICKY) for _ in range(rnd.randrange(4)))) for _ in range(rnd.randrange(1, 7))]
        text, spans = chat.render(turns)
        assert list(chat.parse(text)) == turns
        ids, starts, ends = encoder(text)
        mask = chat.token_mask(starts, ends, spans)
        want = [t for r, t in turns if r == "assistant" and t]
        assert chat.masked_texts(text, starts, ends, mask) == want
        slow = np.array([any(a <= s and e <= b for a, b in spans) for s, e in zip(starts, ends, strict=True)], bool).reshape(-1)
        assert (mask == slow).all() and len(ids) == len(mask)
        # Ids of the whole are those of its turns one by one.
        assert ids.tolist() == [i for t in turns for i in encoder(chat.render([t])[0])[0].tolist()]


def test_what_is_no_conversation_is_an_error():
    for text in ("hello", "### User: no end", "### Role: x</turn>\n", "### User: a</turn>\nrest"):
        with pytest.raises(ValueError):
            list(chat.parse(text))
    with pytest.raises(ValueError):
        chat.token_mask(np.array([0, 3]), np.array([3, 6]), np.array([[2, 6]]))


@pytest.mark.parametrize("part", [1 << 20, 40, 1])
def test_conversations_with_nulls_ties_repeats_and_parts(spark, part):
    rnd = random.Random(5)
    rows = [(c, t, rnd.choice(["user", "assistant", "system", None, "tool"]), rnd.choice([*TRICKY, None])) for c in [*range(12), None, -(1 << 62)] for t in range(rnd.randrange(1, 6))]
    rows += [(3, 2, "assistant", "again")] * 2 + [(4, None, "user", "first"), (4, 0, "assistant", "tie"), (4, 0, "assistant", None), (99, 0, "assistant", "many")] + [(99, k, "user", "much " * 30) for k in range(40)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], SCHEMA)
    got = {r[0]: tuple(r)[1:] for r in chat.read_back(chat.format_conversations(df, PATH, part_chars=part)).collect()}
    low = lambda x: (x is not None, x)
    want = {c: plain([r[2:] for r in sorted((r for r in rows if r[0] == c), key=lambda r: tuple(map(low, r[1:])))]) for c in {r[0] for r in rows}}
    assert got == want
    parts = chat.format_conversations(df, PATH, part_chars=part).filter("conv_id = 99").count()
    assert parts == 1 if part > 1000 else parts > 3


def test_empty_table_and_one_long_turn(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert chat.read_back(chat.format_conversations(df, PATH)).collect() == []
    text = "A long text, ### indeed </turn>. " * 60_000
    df = spark.createDataFrame([(1, 0, "assistant", text, "", 0)], SCHEMA)
    assert tuple(chat.read_back(chat.format_conversations(df, PATH)).first())[1:] == plain([("assistant", text)])


def test_query_equals_its_sql_and_plain_digests(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted(tuple(r) for r in QUERIES["op12_chat_formatting"](spark, sf).collect())
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
        assert sorted(db.execute(ORACLES["op12_chat_formatting"]).fetchall()) == got
    special = next(r for r in got if r[0] == -7)
    assert special[1:] == plain([("user", "\\### Assistant: </turn> ok"), ("assistant", "\\### Assistant: </turn> ok")])
    assert special[3] == 26
