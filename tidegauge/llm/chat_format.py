"""Conversations as training windows of a bounded number of tokens.

Prefix sums of the turns' tokens choose spans of whole turns; each window has the conversation's system turn again, a
limited history of the turns before its span, and its own turns. Only the assistant's text of its own turns is trained on:
what a window repeats is masked.

The template is `<|im_start|>role\\ntext<|im_end|>\\n`. In roles and texts a backslash becomes two, and `<|` becomes `<\\|`,
so that no control string can come from a text, and any text comes back as it was. In roles a newline becomes `\\n`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.bpe import text_tokens
from tidegauge.llm.common import batched, rows_of

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turns are dealt to tasks by blocks of this many turn numbers, so that a conversation of any length spreads out.
BLOCK = 1024

_UNESCAPED = {"\\\\": "\\", "\\|": "|", "\\n": "\n"}
_ESCAPE = re.compile(r"\\[\\|n]")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPE.sub(lambda m: _UNESCAPED[m[0]], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn in the template, and where its text starts and ends there."""
    head = START + escape(role).replace("\n", "\\n") + "\n"
    body = escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of what the template holds, in order."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, body = part.partition("\n")
        turns.append((unescape(head), unescape(body[: -len(END)])))
    return turns


_WINDOWS = pa.schema(
    [
        ("conv_id", pa.int64()), ("block", pa.int64()), ("window", pa.int32()), ("formatted", pa.string()), ("n_tokens", pa.int64()),
        ("own_from", pa.int32()), ("n_own", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ]
)
_WINDOWS_DDL = "conv_id long, block long, window int, formatted string, n_tokens long, own_from int, n_own int, loss array<struct<start: long, end: long>>"


class _Turn:
    __slots__ = ("role", "rendered", "start", "end", "tokens")

    def __init__(self, role: str, text: str, encoder):
        self.role = role
        self.rendered, self.start, self.end = render(role, text)
        # as rendered: escapes and the template count. A turn ends in a newline and begins with `<`, which the tokenizer parts,
        # so that turns' tokens add up to their window's
        self.tokens = encoder.count(self.rendered)


def _window(key: tuple, number: int, system: _Turn | None, history: list[_Turn], own: list[_Turn]) -> tuple:
    shown = [*([system] if system else []), *history, *own]
    loss, at, repeated = [], 0, len(shown) - len(own)
    for i, t in enumerate(shown):
        if i >= repeated and t.role == "assistant":
            loss.append({"start": at + t.start, "end": at + t.end})
        at += len(t.rendered)
    return (*key, number, "".join(t.rendered for t in shown), sum(t.tokens for t in shown), repeated, len(own), loss)


def _spans(path: str, budget: int, history_turns: int, history_tokens: int):
    """Windows of rows that come by conversation, block and turn; holds one window and its history at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = text_tokens(path)

        def rows() -> Iterator[tuple]:
            key, number, system, history, own = None, 0, None, [], []

            def closed() -> Iterator[tuple]:
                nonlocal number, history, own
                if own:
                    repeat, left = [], min(history_tokens, budget - (system.tokens if system else 0) - sum(t.tokens for t in own))
                    for t in reversed(history):
                        if len(repeat) == history_turns or t.tokens > left:
                            break
                        repeat.insert(0, t)
                        left -= t.tokens
                    yield _window(key, number, system, repeat, own)
                    number += 1
                    history = [*history, *own][-history_turns:] if history_turns else []
                    own = []

            for conv, block, kind, role, text in rows_of(batches, "conv_id", "block", "kind", "role", "text"):
                if (conv, block) != key:
                    yield from closed()
                    key, number, system, history, own = (conv, block), 0, None, [], []
                turn = _Turn(role or "", text or "", encoder)
                if kind == 0:
                    system = turn
                elif kind == 1:
                    history.append(turn)
                else:
                    # the first window of a conversation has its system turn among its own turns
                    if own and (system.tokens if system else 0) + sum(t.tokens for t in own) + turn.tokens > budget - history_tokens * bool(history):
                        first = own[0] if system is None and number == 0 and block == 0 and own[0].role == "system" else None
                        yield from closed()
                        system = system or first
                        history = [t for t in history if t is not system]
                    own.append(turn)
            yield from closed()

        yield from batched(rows(), _WINDOWS, 256)

    return run


def chat_windows(
    conversations: DataFrame, tokenizer_path: str, budget: int = 2048, history_turns: int = 2, history_tokens: int = 512,
    conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """Windows of each conversation, in order of block and window: conv_id, block, window, formatted, n_tokens, own_from, n_own, loss.

    The first own_from turns of a window repeat the system turn (a conversation's first turn, if its role is system) and at
    most history_turns turns of history_tokens before its span; then come n_own turns of its own. Each turn is an own turn
    of just one window. `loss` has the code point ranges of formatted to train on: the texts of own assistant turns. n_tokens
    are the tokens of formatted. Windows have at most `budget` of them, unless a single turn with the system turn has more:
    such a turn stays whole, in a window of its own.

    Null roles and texts are empty. Turns go by number, then role, then text; null numbers come first, and repeated rows are
    turns of their own. Rows without a conversation form one, whose id is null. Other columns aren't read. An empty table
    gives an empty result.
    """  # noqa: E501
    turns = conversations.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.withColumn("block", F.greatest(F.floor(F.coalesce("turn", F.lit(0)) / BLOCK), F.lit(0)).cast("long")).withColumn("kind", F.lit(2))
    # A block's last turns are history of the next block, and long conversations' system turns go to all their blocks.
    carried = turns.where(F.pmod("turn", F.lit(BLOCK)) >= BLOCK - history_turns).withColumns({"block": F.col("block") + 1, "kind": F.lit(1)})
    long_ = turns.where("block > 0").groupBy(F.col("conv_id").alias("long_id")).agg(F.collect_set("block").alias("blocks"))
    opening = F.struct("turn", "role", "text")
    first = turns.where("block = 0").join(long_, F.col("conv_id").eqNullSafe(F.col("long_id")))
    first = first.groupBy("conv_id", "blocks").agg(F.min(opening).alias("first")).where("first.role = 'system'")
    system = first.select("conv_id", F.col("first.turn").alias("turn"), F.col("first.role").alias("role"), F.col("first.text").alias("text"), F.explode("blocks").alias("block"), F.lit(0).alias("kind"))
    every = turns.unionByName(carried).unionByName(system)
    # a block that has only carried turns has no window of its own
    dealt = every.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "turn", "role", "text")
    return dealt.select("conv_id", "block", "kind", "role", "text").mapInArrow(_spans(tokenizer_path, budget, history_turns, history_tokens), _WINDOWS_DDL)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of each conversation, from its windows in order; holds one window at a time."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64())])

    def rows() -> Iterator[tuple]:
        key, n, turns, chars, loss, formatted, windows = None, 0, None, 0, None, 0, 0
        for conv, text, own_from, spans in rows_of(batches, "conv_id", "formatted", "own_from", "loss"):
            if turns is None or conv != key:
                if turns is not None:
                    yield key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows
                key, n, turns, chars, loss, formatted, windows = conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0
            own = parse(text)[own_from:]
            for role, said in own:
                turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
            for span in spans:
                said = unescape(text[span["start"] : span["end"]])
                chars += len(said)
                loss.update(said.encode("utf-8", "surrogatepass"))
            n, formatted, windows = n + len(own), formatted + len(text), windows + 1
        if turns is not None:
            yield key, n, turns.hexdigest(), chars, loss.hexdigest(), formatted, windows

    yield from batched(rows(), schema)


def window_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, read back from its windows: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows."""
    ordered = windows.select("conv_id", "block", "window", "formatted", "own_from", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "block", "window")
    return ordered.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
