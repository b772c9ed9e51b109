"""Chat formatting into budgeted windows.

Conversations are streamed turn by turn, sorted inside a partition, so one of any length needs the memory
of a window. Prefix sums of turn tokens close a window at a turn's end; each window repeats the system
turn and as much history as fits, with the loss mask on new assistant texts only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
CONTROL = re.compile(r"\\|###|</turn>")
MARKED = re.compile(r"### ((?:\\.|[^\\:])*): ((?:[^\\<]|\\.|<(?!/turn>\n))*)</turn>\n", re.S)
ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")


def escape(text: str) -> str:
    """Control strings get a backslash in front, as does a backslash itself."""
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


class _Windows:
    """The open window of one conversation."""

    def __init__(self, conv, budget: int, history: int):
        self.conv, self.budget, self.history, self.number, self.seen = conv, budget, history, 0, 0
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []  # the latest turns within the history budget
        self.new: list[tuple[str, str, int]] = []
        self.size = 0  # tokens of the new turns: the prefix sum since the last cut

    def _head(self) -> list[tuple[str, str, int]]:
        head = [self.system] if self.system and self.number else []
        return head + (self.past if self.number else [])

    def add(self, role: str, text: str) -> tuple | None:
        turn = (role, text, len(text.split()) + 2)
        done = None
        if self.new and sum(t[2] for t in self._head()) + self.size + turn[2] > self.budget:
            done = self.close()
        if not self.seen and role == "system":
            self.system = turn
        self.seen += 1
        self.new.append(turn)
        self.size += turn[2]
        return done

    def close(self) -> tuple:
        head, parts, at, starts, ends = self._head(), [], 0, [], []
        for k, (role, text, _) in enumerate(head + self.new):
            opening = f"{OPEN}{escape(role).replace(':', chr(92) + ':')}: "
            body = escape(text)
            if k >= len(head) and role == "assistant":
                starts.append(at + len(opening))
                ends.append(at + len(opening) + len(body))
            parts.append(opening + body + CLOSE)
            at += len(parts[-1])
        row = (self.conv, self.number, len(head), "".join(parts), starts, ends)
        rest, past = self.history, []
        for turn in reversed([t for t in self.past + self.new if t is not self.system]):
            rest -= turn[2]
            if rest < 0:
                break
            past.insert(0, turn)
        self.number, self.past, self.new, self.size = self.number + 1, past, [], 0
        return row


def format_chats(
    turns: DataFrame, *, budget: int = 512, history: int = 128, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
) -> DataFrame:
    """(conv_id, window, n_repeated, formatted, loss_from, loss_to): windows of about `budget` word tokens.

    The first n_repeated turns of a window (system turn, history of at most `history` tokens) were in an
    earlier one and carry no loss. A turn over the budget gets a window of its own, whole. Null role or
    text: empty. Null conv_id: one conversation. Ties in turn are ordered by role, then text; repeated rows
    are turns of their own; other columns are ignored.
    """
    kind = dict(turns.select(F.col(conv_col).alias("c")).dtypes)["c"]
    columns = ["conv_id", "window", "n_repeated", "formatted", "loss_from", "loss_to"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_: _Windows | None = None
        for pdf in batches:
            rows = []
            for conv, known, role, text in zip(pdf["conv_id"], pdf["known"], pdf["role"], pdf["text"]):
                conv = conv if known else None
                if open_ is None or conv != open_.conv:
                    rows += [open_.close()] if open_ else []
                    open_ = _Windows(conv, budget, history)
                if done := open_.add(role, text):
                    rows.append(done)
            yield pd.DataFrame(rows, columns=columns)
        if open_:
            yield pd.DataFrame([open_.close()], columns=columns)

    dealt = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(conv_col).isNotNull().alias("known"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    ).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInPandas(run, f"conv_id {kind}, window int, n_repeated int, formatted string, loss_from array<long>, loss_to array<long>")


def read_back(windows: DataFrame) -> DataFrame:
    """One row per conversation, read from the windows of format_chats() in their order.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars and n_windows; repeated turns
    are skipped, so every turn and every assistant text counts once.
    """
    kind = dict(windows.dtypes)["conv_id"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = None  # conv, turns, digest, loss chars, digest, formatted, windows
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"]
        told = lambda s: (s[0], s[1], s[2].hexdigest(), s[3], s[4].hexdigest(), s[5], s[6])
        for pdf in batches:
            rows = []
            for conv, number, skip, text, starts, ends in pdf.itertuples(index=False):
                if number == 0:
                    rows += [told(state)] if state else []
                    state = [None if pd.isna(conv) else conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for m in list(MARKED.finditer(text))[skip:]:
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                for i, j in zip(starts, ends):
                    plain = unescape(text[i:j])
                    state[3] += len(plain)
                    state[4].update(plain.encode("utf-8", "surrogatepass"))
                state[5] += len(text)
                state[6] += 1
            yield pd.DataFrame(rows, columns=names)
        if state:
            yield pd.DataFrame([told(state)], columns=names)

    return windows.mapInPandas(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long")
