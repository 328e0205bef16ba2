r"""Chat formatting: whole conversations as one text, encoded once, with a loss mask over the assistant's tokens.

A turn is written as a head for its role, the text, and a tail. Heads and tail are tokens of their own for the encoder,
so that no token lies on both sides of a text's border. Inside texts and names of roles, a backslash is doubled, the tail
is written `<\/turn>`, and each mark of a run of three or more `#` gets a backslash before it, so neither heads nor tails
occur there; taking away the backslash before each character gives the text back.

The encoder's spans of characters are sorted, as are the turns; binary search finds the tokens of each assistant text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import ship

HEADS = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}
OTHER, SAYS, TAIL = "### Role: ", "### Says: ", "</turn>\n"
#: A conversation of more characters than this is formatted in several parts, cut between turns.
PART = 1 << 20

_HEAD = re.compile("|".join(map(re.escape, [*HEADS.values(), OTHER])))
_ROLE_OF = {head: role for role, head in HEADS.items()}

SCHEMA = "conv_id long, part int, formatted string, ids array<int>, starts array<int>, ends array<int>, loss array<boolean>"


def escaped(text: str) -> str:
    text = text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>")
    return re.sub("#{3,}", lambda m: "\\#" * len(m[0]), text)


def unescaped(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def head_of(role: str) -> str:
    return HEADS.get(role) or f"{OTHER}{escaped(role)}{SAYS}"


def render(turns: list[tuple[str, str]]) -> tuple[str, np.ndarray]:
    """The conversation's text, and an array of start and end of each assistant text in it."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = head_of(role), escaped(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, TAIL]
        at += len(head) + len(body) + len(TAIL)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that a formatted text was made of; raises ValueError where it is none."""
    at = 0
    while at < len(formatted):
        head, end = _HEAD.match(formatted, at), formatted.find(TAIL, at)
        if not head or end < 0:
            raise ValueError(f"no turn at character {at}")
        body = formatted[head.end() : end]
        if head[0] == OTHER:
            role, mark, body = body.partition(SAYS)
            if not mark:
                raise ValueError(f"a role without a text at character {at}")
            yield unescaped(role), unescaped(body)
        else:
            yield _ROLE_OF[head[0]], unescaped(body)
        at = end + len(TAIL)


def token_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in one of the sorted spans. A token that crosses the border of a span is an error."""
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    some = first < last
    if (starts[first[some]] < spans[some, 0]).any() or (ends[last[some] - 1] > spans[some, 1]).any():
        raise ValueError("a token crosses the border of a text")
    change = np.zeros(len(starts) + 1, np.int8)
    np.add.at(change, first[some], 1)
    np.add.at(change, last[some], -1)
    return np.cumsum(change[:-1]).astype(bool)


def masked_texts(formatted: str, starts: np.ndarray, ends: np.ndarray, loss: np.ndarray) -> list[str]:
    """The text below each run of masked tokens, unescaped. Tokens that share a character count it once."""
    edges = np.flatnonzero(np.diff(np.r_[False, loss, False]))
    return [unescaped(formatted[starts[a] : ends[b - 1]]) for a, b in zip(edges[::2], edges[1::2], strict=True)]


class Encoder:
    """A tokenizer of the `tokenizers` library, whose heads and tail are tokens with new ids behind its vocabulary."""

    def __init__(self, path: str):
        from tokenizers import AddedToken, Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True  # special tokens' strings in a text are ordinary text
        self.model.add_tokens([AddedToken(x, normalized=False, single_word=False, lstrip=False, rstrip=False) for x in [*HEADS.values(), OTHER, SAYS, TAIL]])

    def __call__(self, formatted: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and start and end of each token in characters."""
        found = self.model.encode(formatted, add_special_tokens=False)
        spans = np.array(found.offsets, np.int64).reshape(-1, 2)
        return np.array(found.ids, np.int32), spans[:, 0], spans[:, 1]


@lru_cache(maxsize=2)
def _encoder(name: str) -> Encoder:
    return Encoder(SparkFiles.get(name))


def _parts(batches, most: int) -> Iterator[tuple[int | None, int, list[tuple[str, str]]]]:
    """Conversation, number of the part and turns of each part, from sorted rows."""
    own, part, turns, size = None, 0, [], 0
    begun = False
    for batch in batches:
        for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
            if begun and (conv != own or size >= most):
                yield own, part, turns
                part, turns, size = part + 1 if conv == own else 0, [], 0
            own, begun = conv, True
            turns.append((role or "", text or ""))
            size += len(turns[-1][1])
    if begun:
        yield own, part, turns


def format_conversations(turns: DataFrame, tokenizer: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART) -> DataFrame:
    """conv_id, part, formatted, ids, starts, ends (of each token, in characters of formatted) and loss (a mask over tokens).

    Rows of a conversation go by turn, a null turn first, equal ones by role and text. A null text or role counts as
    empty; roles other than system, user and assistant are written out in their head. Rows without conv_id are one
    conversation. A conversation of more than part_chars characters of text has several rows, part 0, 1, ..., each of whole
    turns: as heads and tails part the tokens, their ids are those of the whole. So memory is bounded by part_chars and the
    longest turn. Repeated rows are turns of their own, further columns are left out, an empty table gives an empty one.
    Rows come sorted by conversation and part within each partition, which read_back relies on.
    """
    name = ship(turns.sparkSession, tokenizer)

    def formatted(batches):
        encoder, rows, size = _encoder(name), [], 0
        for conv, part, own in _parts(batches, part_chars):
            whole, spans = render(own)
            ids, starts, ends = encoder(whole)
            rows.append((conv, part, whole, ids, starts.astype(np.int32), ends.astype(np.int32), token_mask(starts, ends, spans)))
            size += len(whole)
            if size >= part_chars:
                yield batch_of(rows)
                rows, size = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        kinds = [pa.int64(), pa.int32(), pa.string(), *[pa.list_(pa.int32())] * 3, pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "part", "formatted", "ids", "starts", "ends", "loss"])

    given = turns.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    return given.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(formatted, SCHEMA)


def read_back(formatted: DataFrame) -> DataFrame:
    r"""What the rows of format_conversations hold: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    turns_sha256 is of role, \n, text, \n of each turn, parsed from the formatted text; loss_chars and loss_sha256 are of
    the text below the loss mask. Digests go on from part to part, so that no conversation is held as a whole.
    """

    def read(batches):
        own, begun = None, False
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                if not begun or row["part"] == 0:
                    if begun:
                        rows.append(closed(own))
                    own, begun = {"conv": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "size": 0}, True
                for role, text in parse(row["formatted"]):
                    own["n"] += 1
                    own["turns"].update(f"{role}\n{text}\n".encode())
                for text in masked_texts(row["formatted"], *(np.array(row[c], np.int64) for c in ("starts", "ends")), np.array(row["loss"], bool)):
                    own["loss"].update(text.encode())
                    own["chars"] += len(text)
                own["size"] += len(row["formatted"])
            if rows:
                yield table_of(rows)
        if begun:
            yield table_of([closed(own)])

    def closed(x):
        return x["conv"], x["n"], x["turns"].hexdigest(), x["chars"], x["loss"].hexdigest(), x["size"]

    def table_of(rows):
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def escaped_sql(text: str) -> str:
    """SQL for the number of characters of a text when it is escaped."""
    gone = [f"length(replace({text}, '\\', ''))", f"length(replace({text}, '</turn>', '</turn'))", f"length(regexp_replace({text}, '#{{3,}}', '', 'g'))"]
    return f"(4 * length({text}) - {' - '.join(gone)})"
