"""Chat formatting in budgeted windows.

A conversation's turns are marked by a template and packed into windows of a token
budget. The running sum of the turns' tokens says where a window ends: always between
turns. Every window retains the system turn; a later one also repeats the last turns before
it, within a history budget. The loss mask covers the assistant texts that a window
has first: repeated ones are masked out, so each is a target once.

Conversations stream through tasks in turn order, and a task keeps one window's turns:
a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import sliced
from siltstone.llm.tokens import Pieces

START, END = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates and tokenizers take as control strings.
CONTROL = [
    "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|startoftext|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<|begin_of_text|>",
    "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<unk>", "<pad>",
]
_CONTROL = re.compile("|".join(re.escape(x) for x in CONTROL))
_ESCAPE = "␛"
_ESCAPED = re.compile(f"{_ESCAPE}(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(START)}(.*?)\n(.*?){re.escape(END)}\n", re.DOTALL)

_WINDOW = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int32()), ("text", pa.string()), ("n_turns", pa.int32()), ("n_context", pa.int32()),
    ("n_tokens", pa.int64()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
])
WINDOW = "conv_id long, window int, text string, n_turns int, n_context int, n_tokens long, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """Break every control string by an escape sign behind its first character; double the sign itself."""
    return _CONTROL.sub(lambda m: m[0][0] + _ESCAPE + m[0][1:], text.replace(_ESCAPE, _ESCAPE * 2))


def unescape(text: str) -> str:
    """Undo :func:`escape`; in a role, the sign before n stands for a line break."""
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def _marked(role: str, text: str) -> tuple[str, int, int]:
    """A formatted turn, and where its text starts and ends."""
    head = f"{START}{escape(role).replace(chr(10), _ESCAPE + 'n')}\n"
    body = escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + len(body)


class _Packer:
    """Windows of one conversation after another."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history, self.conv, self.open = budget, history, None, False

    def begin(self, conv: int | None) -> None:
        self.conv, self.open = conv, True
        self.window, self.system, self.span, self.past = 0, None, [], []
        self.used = 0

    def add(self, turn: tuple) -> Iterator[dict]:
        """``turn``: (role, text, tokens, marked, start, end)."""
        n = turn[2]
        if self.span and self.used + n > self.budget:
            yield self.emit()
            kept, total = [], 0
            for old in reversed([t for t in self.past + self.span if t is not self.system]):
                total += old[2]
                if total > self.history:
                    break
                kept.append(old)
            self.past, self.span = kept[::-1], []
            fixed = self.system[2] if self.system else 0
            while self.past and fixed + sum(t[2] for t in self.past) + n > self.budget:
                self.past.pop(0)
            self.used = fixed + sum(t[2] for t in self.past)
        if turn[0] == "system" and self.system is None:
            self.system = turn
        self.span.append(turn)
        self.used += n

    def emit(self) -> dict:
        retained = [self.system] if self.system and not any(t is self.system for t in self.span) else []
        context, at, loss = retained + self.past, 0, []
        for i, (role, _, _, marked, start, end) in enumerate(context + self.span):
            if i >= len(context) and role == "assistant":
                loss.append({"start": at + start, "end": at + end})
            at += len(marked)
        turns = context + self.span
        self.window += 1
        return {
            "conv_id": self.conv, "window": self.window - 1, "text": "".join(t[3] for t in turns), "n_turns": len(turns),
            "n_context": len(context), "n_tokens": sum(t[2] for t in turns), "loss": loss,
        }

    def close(self) -> Iterator[dict]:
        if self.open and self.span:
            yield self.emit()
        self.open = False


def chat_windows(turns: DataFrame, path: str, budget: int = 1024, history: int = 256) -> DataFrame:
    """Windows (conv_id, window, text, n_turns, n_context, n_tokens, loss) of ``turns`` (conv_id, turn, role, text).

    ``path``: byte-level tokenizer that measures turns. ``n_context`` turns at a window's start are
    retained or repeated; ``loss`` lists the spans, in code points of ``text``,
    under the loss mask. A turn is never cut: one that exceeds the budget with the
    system turn has a window without history to itself.

    Rows go by turn (null first), then role and text; repeated rows are turns of
    their own. Null texts and roles are empty. Rows without conv_id are one
    conversation. An empty table gives no windows; other columns are not
    read. A conversation's windows are consecutive, in order, in one partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, packer = Pieces(path, spaced=True), _Packer(budget, history)
        for batch in sliced(batches, 3):
            convs, roles, texts = (batch.column(i).to_pylist() for i in (0, 2, 3))
            marked = [_marked(r or "", t or "") for r, t in zip(roles, texts, strict=True)]
            counts = pieces.counts([m[0] for m in marked])
            out: list[dict] = []
            for conv, role, text, n, m in zip(convs, roles, texts, counts, marked, strict=True):
                if not packer.open or conv != packer.conv:
                    out += packer.close()
                    packer.begin(conv)
                out += packer.add((role or "", text or "", n, *m))
            yield pa.RecordBatch.from_pylist(out, schema=_WINDOW)
        yield pa.RecordBatch.from_pylist(list(packer.close()), schema=_WINDOW)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, WINDOW)


def read_back(text: str, context: int = 0) -> list[tuple[str, str]]:
    """(role, text) of the turns of a window, without the first ``context``."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(text)[context:]]


def window_digests(windows: DataFrame) -> DataFrame:
    """One row for each conversation of ``windows``, read back from their texts.

    Takes windows as :func:`chat_windows` leaves them: a conversation's in one
    partition, consecutive and in order; other orders are refused. Sort windows that come
    from files by conv_id and window within partitions by conv_id first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv: tuple | None = None
        n = loss_chars = size = expected = 0
        turns = loss = hashlib.sha256()
        out: list[tuple] = []
        for batch in batches:
            for w in batch.to_pylist():
                if w["window"] != 0 and (conv != (w["conv_id"],) or w["window"] != expected):
                    raise ValueError(f"window {w['window']} of conversation {w['conv_id']} stands out of order")
                expected = w["window"] + 1
                if w["window"] == 0:
                    if conv is not None:
                        out.append((*conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size))
                    conv, n, loss_chars, size, turns, loss = (w["conv_id"],), 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in read_back(w["text"], w["n_context"]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in w["loss"]:
                    target = unescape(w["text"][span["start"] : span["end"]])
                    loss_chars += len(target)
                    loss.update(target.encode())
                size += len(w["text"])
            yield _rows(out)
            out = []
        if conv is not None:
            yield _rows([(*conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), size)])

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_DIGEST.names, r, strict=True)) for r in rows], schema=_DIGEST)
