"""Chat formatting by incremental black-box rendering.

A template is a function from turns (role, text) to a string; nothing else is known of it. Successive
prefixes of a conversation's turns are rendered and consecutive outputs compared: what a prefix adds
is the new turn's span. Where in it the text lies is found with two probe texts that differ in their
first and last character. If an output does not begin with the one before, the template rewrites
history; then there are no spans, and the row says so.

Every prefix of every conversation is rendered whole and compared with the one before, whatever its length. A
black box may rewrite at any one length, so nothing less can tell; the renderings of a conversation have about half
the product of its turns and its characters, and one conversation is one task's. All its turns and its
rendering are in that task's memory.

Who does not want to pay for that may give a ``budget``: then a conversation's renderings have at most so many characters more
than ``EFFORT`` times its text before a window of ``WINDOW`` turns moves, whose older half leaves if each turn of the newer half
(but the first, which may carry a header) adds the same when rendered with that half alone; if it does not, all
turns stay. Whole prefixes are rendered beside it whenever ``EFFORT`` times the text since the last pays for one, and at the
end. Where prefixes were left out and none of the others rewrites, ``rewrites`` is null (not known), never false. No query gives a budget.

Conversations are dealt by conv_id and sorted by turn within partitions. A conversation leaves in parts of ``WINDOW`` turns;
one that rewrites history leaves as one part, rendered whole, without spans.

Defined cases: a null text is empty, and so is a null role; turns with equal or null numbers are
ordered by number (nulls first), role, text; rows with a null conv_id form one conversation; repeated
rows are repeated turns; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, quiet, sized

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]
#: Turns of a part, and of the window under a budget, half of which leave it when it is full.
WINDOW = 64
#: Rendered characters that whole prefixes of one conversation may have: at first (None: as many as all prefixes have), and under a budget for each character of text.
BUDGET, EFFORT = None, 32
PART = "conv_id long, part int, formatted string, spans array<struct<turn:long,role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean>>, rewrites boolean"
SPAN = pa.struct([("turn", pa.int64()), ("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())])
PARTS = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("formatted", pa.string()), ("spans", pa.list_(SPAN)), ("rewrites", pa.bool_())])
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
BARRED, ESCAPED = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
TURN = re.compile(rf"{re.escape(OPEN)}([^\n]*)\n(.*?){re.escape(CLOSE)}\n", re.S)


def escaped(text: str) -> str:
    """No control string is left: every ``<|`` (with any number of backslashes between) gets one more backslash."""
    return BARRED.sub(r"<\\\1|", text) if "|" in text else text


def unescaped(text: str) -> str:
    return ESCAPED.sub(r"<\1|", text) if "|" in text else text


def marked(turns: list[Turn]) -> str:
    """The template of the query: each turn between control strings; a role is one line."""
    lines = {role: role_line(role) for role in {role for role, _ in turns}}
    return "".join([f"{OPEN}{lines[role]}\n{escaped(text)}{CLOSE}\n" for role, text in turns])


def role_line(role: str) -> str:
    return escaped(role).replace("\\", "\\\\").replace("\n", "\\n")


def role_of(line: str) -> str:
    return unescaped(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def read_back(formatted: str) -> Iterator[Turn]:
    """The turns of a text made by ``marked``; it must consist of nothing else."""
    at = 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text between turns")
        at = m.end()
        yield role_of(m[1]), unescaped(m[2])
    if at != len(formatted):
        raise ValueError("text after the last turn")


def added(template: Template, context: list[Turn], turns: list[Turn], before: str = "") -> list[str] | None:
    """What each turn adds to the rendering of those before it (of context: ``before``); None if the template rewrites history."""
    out, so_far = [], list(context)
    for turn in turns:
        so_far.append(turn)
        now = template(so_far)
        if not now.startswith(before):
            return None
        out.append(now[len(before) :])
        before = now
    return out


def frame(template: Template, context: list[Turn], role: str, before: str) -> tuple[str, str] | None:
    """What the template puts before and after the text of a turn, behind context and its rendering."""
    got = [added(template, context, [(role, probe)], before) for probe in ("Ax0", "Bx1")]
    if None in got:
        return None
    a, b = got[0][0], got[1][0]
    head = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    tail = next((k for k, (x, y) in enumerate(zip(a[::-1], b[::-1])) if x != y), len(a))
    return (a[:head], a[len(a) - tail :]) if head < len(a) else None


def within(around: tuple[str, str] | None, new: str) -> tuple[int, int] | None:
    """Where the text lies in what a turn added, if its frame is around it."""
    if around and len(new) >= len(around[0]) + len(around[1]) and new.startswith(around[0]) and new.endswith(around[1]):
        return len(around[0]), len(new) - len(around[1])
    return None


class Conversation:
    """One conversation while its turns come in: renders prefixes, hands out parts at its end."""

    def __init__(self, template: Template, loss_role: str, frames: dict, budget: int | None = None):
        self.template, self.loss_role, self.frames = template, loss_role, frames
        self.all: list[Turn] = []
        self.window: list[Turn] = []  # the turns that are rendered: all, unless a budget is spent
        self.before = ""  # their rendering
        self.adds: list[str] = []  # what each of them added
        self.held: list[tuple[str, str, tuple]] = []  # role, added, place of the text of each turn
        self.sum, self.size = hashlib.sha256(), 0
        self.credit = BUDGET if budget is None else budget  # characters that may be rendered; None: no bound
        self.whole, self.local = True, True  # whether every prefix was rendered whole; whether the window may move
        self.rewrites: bool | None = False

    def add(self, turn: Turn) -> None:
        self.all.append(turn)
        if self.rewrites:
            return
        self.window.append(turn)
        now = self.template(self.window)
        if not now.startswith(self.before):
            self.rewrites = True
            return
        new = now[len(self.before) :]
        self.held.append((turn[0], new, self.place(turn[0], new) or (None, None)))
        self.before = now
        if self.credit is not None:
            self.spend(new, now)

    def place(self, role: str, new: str) -> tuple[int, int] | None:
        key = (self.window[-2][0] if len(self.window) > 1 else None, role)
        got = within(self.frames.get(key), new)
        if got is None:
            around = frame(self.template, self.window[:-1], role, self.before)
            got = within(around, new)
            if len(self.frames) < 1000:
                self.frames[key] = around
        return got

    def spend(self, new: str, now: str) -> None:
        """Under a budget: whether the next prefix is rendered whole."""
        self.adds.append(new)
        self.sum.update(new.encode("utf-8", "surrogatepass"))
        self.size += len(new)
        self.credit += EFFORT * len(new)
        if self.whole:
            self.credit -= len(now)
            self.whole = self.credit > 0
            return
        if self.local and len(self.window) >= WINDOW:
            self.shift()
        if self.credit >= self.size:
            self.check()
            self.credit -= self.size

    def shift(self) -> None:
        """Let the older half go if the newer one is rendered alike without it."""
        newer = self.window[-(WINDOW // 2) :]
        alone = added(self.template, [], newer)
        if alone is None or alone[1:] != self.adds[1 - WINDOW // 2 :]:
            self.local = False
            return
        self.window, self.adds, self.before = newer, alone, "".join(alone)

    def check(self) -> None:
        """Compare the rendering of all turns so far with what they added one by one."""
        if len(self.window) < len(self.all):
            whole = self.template(self.all).encode("utf-8", "surrogatepass")
            self.rewrites |= hashlib.sha256(whole).digest() != self.sum.digest()

    def parts(self) -> Iterator[tuple[int, str, list[tuple], bool | None]]:
        """Number of the part, rendering, spans, and whether history was rewritten (null: not known)."""
        if not self.rewrites:
            self.check()
        if self.rewrites:
            yield 0, self.template(self.all), [], True
            return
        known = False if len(self.window) == len(self.all) else None
        for number, first in enumerate(range(0, max(1, len(self.held)), WINDOW)):
            at, held, spans = 0, self.held[first : first + WINDOW], []
            for k, (role, new, (start, end)) in enumerate(held):
                place = (None, None) if start is None else (at + start, at + end)
                spans.append((first + k, role, at, at + len(new), *place, role == self.loss_role and start is not None))
                at += len(new)
            yield number, "".join([new for _, new, _ in held]), spans, known


def rendered(template: Template, turns: list[Turn], loss_role: str = "assistant", *, budget: int | None = None) -> list[tuple[int, str, list[tuple], bool | None]]:
    """The parts of one conversation given whole."""
    return list(conversation_parts(Conversation(template, loss_role, {}, budget), iter(turns)))


def conversation_parts(one: Conversation, turns: Iterator[Turn]) -> Iterator[tuple[int, str, list[tuple], bool | None]]:
    for turn in turns:
        one.add(turn)
    yield from one.parts()


def format_conversations(turns: DataFrame, template: Template = marked, *, loss_role: str = "assistant", budget: int | None = None) -> DataFrame:
    """Parts of formatted conversations (columns conv_id, turn, role, text), in order within a partition.

    spans: of each turn, where it lies in its part, where its text lies, and whether it is learned. All
    parts of a conversation say whether it rewrites history; null only under a budget that was spent."""
    narrow(turns.sparkSession)

    @quiet
    def run(batches):
        frames: dict = {}

        def streamed():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)))

        def rows():
            for conv, group in groupby(streamed(), key=itemgetter(0)):
                for number, text, marks, rewrites in conversation_parts(Conversation(template, loss_role, frames, budget), ((role or "", text or "") for _, role, text in group)):
                    yield (conv, number, text, marks, rewrites), len(text) + 64 * len(marks)

        yield from sized(rows(), PARTS)

    base = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return base.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, PART)


def digests(parts: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its parts (as ``format_conversations`` leaves them, in order)."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("rewrites", pa.bool_())])

    class Sum:
        def __init__(self, conv):
            self.conv, self.n, self.chars, self.learned = conv, 0, 0, 0
            self.all, self.loss = hashlib.sha256(), hashlib.sha256()

        def add(self, formatted, marks, rewrites):
            self.chars += len(formatted)
            self.rewrites = rewrites
            for role, text in read_back(formatted):
                self.n += 1
                self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for mark in marks:
                if mark["loss"]:
                    text = unescaped(formatted[mark["text_start"] : mark["text_end"]])
                    self.learned += len(text)
                    self.loss.update(text.encode("utf-8", "surrogatepass"))

        def row(self):
            return (self.conv, self.n, self.all.hexdigest(), self.learned, self.loss.hexdigest(), self.chars, self.rewrites), 200

    def run(batches):
        def rows():
            of = None
            for batch in batches:
                for conv, number, formatted, marks, rewrites in zip(*(c.to_pylist() for c in batch.columns)):
                    if number == 0:
                        if of:
                            yield of.row()
                        of = Sum(conv)
                    of.add(formatted, marks, rewrites)
            if of:
                yield of.row()

        yield from sized(rows(), schema)

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean")
