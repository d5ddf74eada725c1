"""Chat formatting in budgeted windows.

Method: the prefix sums of a conversation's turn tokens choose spans of whole turns. A window
holds the system turn (a conversation's leading system turn), then as many of the latest earlier
turns as fit ``HISTORY`` tokens, then new turns while the window's tokens stay within ``BUDGET``;
a new turn is never cut, so one that alone exceeds the budget gets a window of its own (flagged
``over``), with no history. Loss lies on the text of new assistant turns; repeated turns, the
system turn, other roles and the template are masked, so each assistant text is a target once.

Template: ``<turn ROLE>`` newline TEXT newline ``</turn>`` newline. In role and text a backslash
stands before each backslash and each ``<``, and in roles ``>`` and newline are written
``\\g`` and ``\\n``; an escaped text can't hold a control string, and ``parse`` restores it.

Rows stream through a task in (conversation, turn) order and only the current window and its
history are held, so conversations of any length work; turns that share a number are ordered by
role and text. Null text is empty, a null role is written as ``\\0``; a null turn number sorts
first; a null conv_id is a conversation of its own; repeated rows are repeated turns; an empty
table gives no window; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

BUDGET, HISTORY = 1024, 256
TARGET = "assistant"
_WINDOWS = "conv_id long, window int, text string, loss array<struct<start: int, end: int>>, n_repeated int, n_tokens int, over boolean"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\<")


def unescape(text: str) -> str:
    if "\\" not in text:
        return text
    out, i = [], 0
    while (j := text.find("\\", i)) >= 0:
        out += (text[i:j], text[j + 1 : j + 2])
        i = j + 2
    return "".join(out) + text[i:]


def _role_in(role: str | None) -> str:
    return "\\0" if role is None else escape(role).replace(">", "\\g").replace("\n", "\\n")


def _role_out(role: str) -> str | None:
    if role == "\\0":
        return None
    out, i = [], 0
    while i < len(role):
        if role[i] == "\\":
            out.append({"g": ">", "n": "\n"}.get(role[i + 1], role[i + 1]))
            i += 2
        else:
            out.append(role[i])
            i += 1
    return "".join(out)


def render(role: str | None, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its escaped text starts and ends."""
    head, body = f"<turn {_role_in(role)}>\n", escape(text)
    return f"{head}{body}\n</turn>\n", len(head), len(head) + len(body)


def parse(formatted: str) -> list[tuple[str | None, str, int, int]]:
    """(role, text, start, end) of each turn; start and end enclose the escaped text."""
    out, i = [], 0
    while i < len(formatted):
        if not formatted.startswith("<turn ", i):
            raise ValueError(f"no turn at {i}")
        at = formatted.index(">\n", i)
        start, close = at + 2, formatted.index("<", at + 2)
        while _escaped(formatted, close):
            close = formatted.index("<", close + 1)
        if not formatted.startswith("</turn>\n", close):
            raise ValueError(f"no end of turn at {close}")
        out.append((_role_out(formatted[i + 6 : at]), unescape(formatted[start : close - 1]), start, close - 1))
        i = close + len("</turn>\n")
    return out


def _escaped(text: str, at: int) -> bool:
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 1


class Windows:
    """The windows of one conversation, made while its turns arrive.

    ``sums`` are the prefix sums of the held turns' tokens: ``sums[k]`` stands before turn k, so a span
    of turns i to j holds ``sums[j] - sums[i]`` tokens, and a bisection finds where a span may begin.
    """

    def __init__(self, count, budget: int, history: int) -> None:
        self.count, self.budget, self.history = count, budget, history
        self.system: tuple | None = None
        self.fixed = 0  # tokens of the system turn
        self.turns: list[tuple] = []
        self.sums = [0]
        self.first = self.new = 0  # where the window begins, and its new turns
        self.seen = 0

    def _used(self) -> int:
        return self.fixed + self.sums[-1] - self.sums[self.first]

    def add(self, role: str | None, text: str) -> Iterator[tuple]:
        made = render(role, text)
        size = self.count(made[0])
        self.seen += 1
        if self.seen == 1 and role == "system":
            self.system, self.fixed = (made, role), size
            return
        if self.new < len(self.turns) and self._used() + size > self.budget:
            yield self._close()
            gone = bisect_left(self.sums, self.sums[-1] - self.history)
            del self.turns[:gone], self.sums[:gone]
            self.first, self.new = 0, len(self.turns)
        if self.new == len(self.turns):  # repeated turns give way to the first new one
            self.first = min(max(self.first, bisect_left(self.sums, self.fixed + self.sums[-1] + size - self.budget)), self.new)
        self.turns.append((made, role))
        self.sums.append(self.sums[-1] + size)

    def end(self) -> Iterator[tuple]:
        if self.new < len(self.turns) or self.system and self.seen == 1:
            yield self._close()

    def _close(self) -> tuple:
        turns = [*([self.system] if self.system else []), *self.turns[self.first :]]
        repeated = len(turns) - (len(self.turns) - self.new)
        text, loss, at = [], [], 0
        for k, ((made, a, b), role) in enumerate(turns):
            if k >= repeated and role == TARGET:
                loss.append((at + a, at + b))
            text.append(made)
            at += len(made)
        return "".join(text), loss, repeated, self._used(), self._used() > self.budget


def format_windows(conversations: DataFrame, tokenizer: str | None = None, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, loss spans, n_repeated (turns before the new ones), n_tokens, over.

    In the first window the system turn is new in content although it counts as repeated here;
    readers that want each turn once take all turns of window 0 and the new ones of the others.
    """
    path = tokenizer or tokens.default_path()
    rows = common.pick(conversations, conv_id="long", turn="long", role="string", text="string").withColumn("text", F.coalesce("text", F.lit("")))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        ids_of = tokens.encoder(path)
        now, last, number = None, object(), 0
        out: list[tuple] = []

        def emit(found: Iterator) -> None:
            nonlocal number
            for text, loss, repeated, used, over in found:
                out.append((last, number, text, [{"start": a, "end": b} for a, b in loss], repeated, used, over))
                number += 1

        def batch_of(rows: list[tuple]):
            kinds = [pa.int64(), pa.int32(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.int32(), pa.int32(), pa.bool_()]
            names = ["conv_id", "window", "text", "loss", "n_repeated", "n_tokens", "over"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            conv, role, text = (batch.column(i) for i in (0, 2, 3))
            for c, r, t in zip(conv.to_pylist(), role.to_pylist(), text):
                if now is None or c != last:
                    if now is not None:
                        emit(now.end())
                    now, last, number = Windows(lambda x: len(ids_of(x)), budget, history), c, 0
                emit(now.add(r, t.as_py()))
                if len(out) >= 1000:
                    yield batch_of(out)
                    out = []
        if now is not None:
            emit(now.end())
        yield batch_of(out)

    return dealt.mapInArrow(run, _WINDOWS)


def read_back(windows: DataFrame) -> DataFrame:
    """From the windows alone: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The windows of a conversation must lie together and in order, as ``format_windows`` gives them.
    """

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        state: dict | None = None
        out: list[tuple] = []

        def close() -> None:
            out.append((state["conv"], state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["size"]))

        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["window"] == 0:
                    if state is not None:
                        close()
                    state = {"conv": row["conv_id"], "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "size": 0}
                new = parse(row["text"])[row["n_repeated"] if row["window"] else 0 :]
                for role, text, _, _ in new:
                    state["turns"].update(f"{role or ''}\n{text}\n".encode())
                for span in row["loss"]:
                    text = unescape(row["text"][span["start"] : span["end"]])
                    state["loss"].update(text.encode())
                    state["chars"] += len(text)
                state["n"] += len(new)
                state["size"] += len(row["text"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)
                out = []
        if state is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return windows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
