"""Chat formatting by incremental black-box rendering.

A template is any function from turns to text.  Rendering successive turn
prefixes and comparing consecutive outputs shows where each turn's text lies:
if the longer output begins with the shorter one, the rest is the new turn's
span.  If it doesn't, the template rewrites history (drops or edits earlier
turns), its turns have no fixed spans, and the conversation is flagged at that
turn.  Two probe renderings of the new turn with different one-letter texts
give the ends of its body, without knowing the template.

A template is rendered on whole prefixes, as no window shows what it does with
more turns than the window holds: all turns are kept and the work grows with
the square of a conversation's turns.  So is the built-in one.  Templates that
a caller declares by :func:`turn_local` write each turn from the turns near it alone.  Only for these, prefixes are
rendered over a window that holds the first turn and the latest ``window``
turns.  When the window moves, the latest turn is rendered under the old and
the new window; if the two spans differ, the declaration is wrong and the run
fails.  Each time a conversation's turns have doubled, and at its end, the
whole prefix is rendered too; if it is not what the windows gave, bisection
finds the turn where history was rewritten and the conversation is flagged
there.  So the declaration saves work (n log n instead of n squared) and
decides nothing.  This holds for the first ``whole_chars`` formatted characters
of a conversation, which bound a task's memory; later turns are checked by the
windows alone.  Rows stream through a task in order.  A conversation's turns
share one partition: they are one ordered text.

The built-in template marks turns with ``### role: `` and `` </turn>`` and
escapes control strings inside texts with backslashes; :func:`unescape`
reverts that exactly.

Defined cases: a null role or text is empty; ties of turn are ordered by role,
then text; repeated rows are turns of their own; rows with a null conv_id form
one conversation; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscope.llm import common

START, END = "### ", " </turn>\n"
_CONTROL = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(.)", re.S)
#: A rendered turn: role up to the first bare colon, then body up to the first bare end mark.
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.|<(?!/turn>))*) </turn>\n", re.S)

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]


def escape(s: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s)


def turn_local(template: Template) -> Template:
    """Declares that the text of a turn depends on nothing but the first turn
    and the few turns before it, and that it stays when turns are added.
    Whole prefixes are still compared, only less often."""
    template.turn_local = True
    return template


def turn_template(turns: list[Turn]) -> str:
    return "".join(f"{START}{escape(role)}: {escape(text)}{END}" for role, text in turns)


def parse(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, body start, body end) of each turn that the built-in
    template rendered; raises if anything else is in the text."""
    at = 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        yield unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)
        at = m.end()


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid)
    return lo


class Spans:
    """Feeds one conversation turn by turn and tells each turn's new text."""

    def __init__(self, template: Template, window: int = 32):
        self.template, self.window = template, window
        self.whole = not getattr(template, "turn_local", False)
        self.turns: list[Turn] = []  # the rendered prefix: all turns, or the first and the latest ones
        self.shown = template([])
        self.opening = self.shown    # what the template writes before any turn

    def add(self, turn: Turn) -> tuple[str, int, int] | None:
        """(new text, body start, body end) of the next turn, offsets inside
        the new text; None if the output for the longer prefix does not
        begin with that for the shorter one."""
        longer = self.template([*self.turns, turn])
        if not longer.startswith(self.shown):
            return None
        new = longer[len(self.shown):]
        probes = [self.template([*self.turns, (turn[0], x)])[len(self.shown):] for x in "xy"]
        head = common_prefix(*probes)
        tail = common_prefix(probes[0][head + 1:][::-1], probes[1][head + 1:][::-1])
        self.turns.append(turn)
        self.shown = longer
        if not self.whole and len(self.turns) > 2 * self.window:
            self._move(new)
        return new, head, len(new) - tail

    def _move(self, new: str) -> None:
        short = [self.turns[0], *self.turns[-self.window:]]
        before, after = self.template(short[:-1]), self.template(short)
        if not after.startswith(before) or after[len(before):] != new:
            raise ValueError(f"the template was declared turn-local, but a turn's text depends on more than the latest {self.window} turns")
        self.turns, self.shown = short, after


class Conversation:
    """The chunks of one conversation while its turns come in.  Under a
    declared template, chunks are held until the whole prefix that ends with
    them has been rendered once and is what the windows gave: when the number
    of turns has doubled, and at the end."""

    def __init__(self, key, template: Template, window: int, chunk_chars: int, whole_chars: int):
        self.key, self.template, self.chunk_chars, self.whole_chars = key, template, chunk_chars, whole_chars
        self.state = Spans(template, window)
        self.n = self.chunk = 0
        self.rewritten: int | None = None
        self.parts, self.spans, self.size = [self.state.opening], [], len(self.state.opening)
        self.held: list[tuple] = []
        self.turns: list[Turn] | None = None if self.state.whole else []
        self.chars, self.due, self.confirmed = 0, 2 * window + 2, 0
        self.digest = hashlib.sha256(self.state.opening.encode())
        self.marks: list[bytes] = []  # digest of the text up to each turn that is not confirmed yet

    def add(self, turn: Turn) -> list[tuple]:
        """The chunks that are ready."""
        got = None if self.rewritten is not None else self.state.add(turn)
        if got is not None:
            new, a, b = got
            self.spans.append({"turn": self.n, "role": turn[0], "start": self.size, "end": self.size + len(new), "body_start": self.size + a, "body_end": self.size + b})
            self.parts.append(new)
            self.size += len(new)
            if self.turns is not None:
                self.turns.append(turn)
                self.chars += len(new)
                self.digest.update(new.encode())
                self.marks.append(self.digest.digest())
        elif self.rewritten is None:
            self.rewritten = self.n
        self.n += 1
        if self.size >= self.chunk_chars:
            self._cut()
        if self.turns is not None and (len(self.turns) >= self.due or self.chars > self.whole_chars):
            self._confirm()
            self.due = 2 * len(self.turns)
            if self.rewritten is not None or self.chars > self.whole_chars:
                self.turns = None
        return self._ready() if self.turns is None or not self.marks else []

    def finish(self) -> list[tuple]:
        if self.turns is not None:
            self._confirm()
        self._cut()
        return self._ready()

    def _ready(self) -> list[tuple]:
        out, self.held = self.held, []
        return out

    def _cut(self) -> None:
        self.held.append((self.key, self.chunk, "".join(self.parts), self.spans, self.rewritten))
        self.chunk, self.parts, self.size, self.spans = self.chunk + 1, [], 0, []

    def _agrees(self, n: int) -> bool:
        return hashlib.sha256(self.template(self.turns[:n]).encode()).digest() == self.marks[n - self.confirmed - 1]

    def _confirm(self) -> None:
        """Compares with the whole prefix, unless whole prefixes were rendered
        anyway; if it differs, bisects for the first turn where it does."""
        n = len(self.turns)
        if self.marks and len(self.state.turns) < n and not self._agrees(n):
            lo, hi = self.confirmed, n
            while hi - lo > 1:
                mid = (lo + hi) // 2
                lo, hi = (mid, hi) if self._agrees(mid) else (lo, mid)
            self._drop_from(hi - 1)
        self.confirmed, self.marks = n, []

    def _drop_from(self, turn: int) -> None:
        """Takes back the text and the spans of ``turn`` and of all after it."""
        self._cut()
        while len(self.held) > 1 and all(s["turn"] >= turn for s in self.held[-1][3]):
            self.held.pop()
        _, self.chunk, text, spans, _ = self.held.pop()
        late = [s["start"] for s in spans if s["turn"] >= turn]
        text = text[:late[0]] if late else text
        self.parts, self.size, self.spans = [text], len(text), [s for s in spans if s["turn"] < turn]
        self.rewritten = turn


def format_rows(rows: Iterable[tuple], template: Template, window: int, chunk_chars: int, whole_chars: int = 1 << 26) -> Iterator[tuple]:
    """Ordered (conv, role, text) rows -> chunk rows (conv, chunk, text,
    spans, rewritten_at).  A span is (turn, role, start, end, body_start,
    body_end), offsets inside the chunk's text."""
    state = None
    for key, role, text in rows:
        if state is None or key != state.key:
            if state is not None:
                yield from state.finish()
            state = Conversation(key, template, window, chunk_chars, whole_chars)
        yield from state.add((role, text))
    if state is not None:
        yield from state.finish()


_SPAN = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()),
                            ("body_start", pa.int64()), ("body_end", pa.int64())]))


def format_conversations(rows: DataFrame, template: Template = turn_template, conv_col: str = "conv_id", turn_col: str = "turn",
                         role_col: str = "role", text_col: str = "text", window: int = 32, chunk_chars: int = 1 << 18,
                         whole_chars: int = 1 << 26) -> DataFrame:
    """Chunk rows ``conv_id, chunk, text, spans, rewritten_at``.  The chunks
    of a conversation, joined by their numbers, are its formatted text;
    ``rewritten_at`` is the first turn (from 0) where the template rewrote
    history: from there on the conversation has no text and no spans.
    ``window`` holds for templates declared :func:`turn_local`; others are
    rendered on whole prefixes.  Up to ``whole_chars`` formatted characters
    the declaration only saves work, see :class:`Conversation`."""
    kind = rows.schema[conv_col].dataType.simpleString()
    keyed = common.pick(rows, conv=conv_col, turn=turn_col, role=role_col, text=text_col)
    ordered = keyed.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text").select("conv", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind_of = None

        def stream():
            nonlocal kind_of
            for b in batches:
                kind_of = b.schema.field("conv").type
                yield from zip(b.column("conv").to_pylist(), common.texts(b, "role"), common.texts(b, "text"))

        out, size = [], 0
        for row in format_rows(stream(), template, window, chunk_chars, whole_chars):
            out.append(row)
            size += len(row[2]) + 256
            if size >= 4 << 20:
                yield _chunks(out, kind_of)
                out, size = [], 0
        if out:
            yield _chunks(out, kind_of)

    return ordered.mapInArrow(run, f"conv_id {kind}, chunk bigint, text string, spans array<struct<turn:bigint,role:string,start:bigint,"
                                   "end:bigint,body_start:bigint,body_end:bigint>>, rewritten_at bigint")


def _chunks(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), _SPAN, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["conv_id", "chunk", "text", "spans", "rewritten_at"])


def read_back(chunks: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Parse formatted chunks of the built-in template and digest them: one
    row per conversation.  The loss mask is the bodies of turns of
    ``loss_roles``, taken from the spans, not from the parse."""
    kind = chunks.schema["conv_id"].dataType.simpleString()
    ordered = chunks.select("conv_id", "chunk", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "chunk")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out, kind_of = None, [], None
        for b in batches:
            kind_of = b.schema.field("conv_id").type
            for conv, text, spans in zip(b.column("conv_id").to_pylist(), b.column("text").to_pylist(), b.column("spans").to_pylist()):
                if open_ is None or open_.conv != conv:
                    if open_ is not None:
                        out.append(open_.row())
                    open_ = _Digest(conv)
                open_.feed(text, spans, loss_roles)
                if len(out) >= 5000:
                    yield _digests(out, kind_of)
                    out = []
        if open_ is not None:
            out.append(open_.row())
        if out:
            yield _digests(out, kind_of)

    return ordered.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


class _Digest:
    def __init__(self, conv):
        self.conv, self.n_turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, text: str, spans: list[dict], loss_roles) -> None:
        self.chars += len(text)
        for role, said, _, _ in parse(text):
            self.n_turns += 1
            self.turns.update(f"{role}\n{said}\n".encode())
        for s in spans:
            if s["role"] in loss_roles:
                body = unescape(text[s["body_start"]:s["body_end"]])
                self.loss_chars += len(body)
                self.loss.update(body.encode())

    def row(self) -> tuple:
        return (self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def _digests(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)],
                                      names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def with_probe(rows: DataFrame, conv_id: int = -7) -> DataFrame:
    """``rows`` (conv_id, turn, role, text) plus a conversation whose texts
    hold the template's own control strings."""
    said = r"\### Assistant: </turn> ok"
    probe = rows.sparkSession.createDataFrame([(conv_id, 0, "user", said), (conv_id, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text").unionByName(probe)
