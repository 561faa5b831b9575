"""Quality rules as a short-circuit cascade.

Each rule rejects a document from a few counts of its text.  The counts come
from extractors of very different cost (a byte count, a split into words, a
search for repeated windows).  On a bounded sample the cascade measures each
rule's cost and share of rejections, then runs the rules in order of
rejections per cost; a document that a rule rejects is not looked at by the
rules after it.  The verdict is the same in any order, only the cost differs.

Words are runs of anything but the six ASCII spaces.  All counts are exact and
over whole texts.

Defined cases: a null or empty text has no words and fails; every row gives
one row, repeated rows and null ids included; an empty table gives none; only
the id and text columns are read.
"""

from __future__ import annotations

import operator
import time
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscope.llm import common

WINDOW = 8
SYMBOLS = b"#*$%&|<>"


def _table(members: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(members)] = True
    return t


_IS_SPACE = _table(common.WORD_SPACES)
_IS_SYMBOL = _table(SYMBOLS)
_IS_HEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])  # first byte of a code point
_IS_PLAIN = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])  # ASCII, not a letter


class Text:
    """One document; each count is taken when first asked for."""

    def __init__(self, raw: bytes):
        self.raw = raw

    def __getattr__(self, name: str):
        value = EXTRACTORS[name](self)
        setattr(self, name, value)
        return value


def _repeat_words(t: Text) -> int:
    """Words inside WINDOW-word windows that occur twice or more, first occurrence included."""
    n = t.n_words - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in t.words], dtype=np.uint64)
    if len(number) == t.n_words:
        return 0
    # equal neighbours of a window's first two words are needed before the window can repeat: compare exact pairs, then fours, then eights
    rank = ids
    for _ in range(WINDOW.bit_length() - 1):
        step = 1 << _
        pair = rank[:-step] * np.uint64(len(rank) + 1) + rank[step:]
        _values, rank = np.unique(pair, return_inverse=True)
        if len(_values) == len(pair):
            return 0
        rank = rank.astype(np.uint64)
    hit = np.bincount(rank.astype(np.int64))[rank.astype(np.int64)] > 1
    cover = np.zeros(t.n_words + 1, np.int64)
    at = np.flatnonzero(hit)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    return int((np.cumsum(cover)[:-1] > 0).sum())


#: name -> count of a Text
EXTRACTORS: dict[str, Callable] = {
    "bytes": lambda t: np.frombuffer(t.raw, np.uint8),
    "space": lambda t: _IS_SPACE[t.bytes],
    "word_chars": lambda t: int(np.count_nonzero(_IS_HEAD[t.bytes] & ~t.space)),
    "n_symbols": lambda t: int(np.count_nonzero(_IS_SYMBOL[t.bytes])),
    "n_plain": lambda t: int(np.count_nonzero(_IS_PLAIN[t.bytes] & ~t.space)),
    "words": lambda t: t.raw.split(),
    "n_words": lambda t: len(t.words),
    "lines": lambda t: [x for x in t.raw.split(b"\n") if x.strip()],
    "n_lines": lambda t: len(t.lines),
    "n_dup_lines": lambda t: len(t.lines) - len(set(t.lines)),
    "n_repeat_words": _repeat_words,
    "n_stutters": lambda t: sum(map(operator.eq, t.words, t.words[1:])),
}


@dataclass(frozen=True)
class Rule:
    name: str
    fails: Callable[[Text], bool]


#: The two base rules, then the method's own.
RULES = (
    Rule("few_words", lambda t: t.n_words < 20),
    Rule("repeated_windows", lambda t: 100 * t.n_repeat_words > 30 * t.n_words),
    Rule("symbols", lambda t: 10 * t.n_symbols > t.n_words),
    Rule("word_length", lambda t: 2 * t.word_chars < 5 * t.n_words or t.word_chars > 14 * t.n_words),
    Rule("duplicate_lines", lambda t: t.n_dup_lines >= 3 and 10 * t.n_dup_lines > 3 * t.n_lines),
    Rule("stutter", lambda t: 10 * t.n_stutters > 3 * t.n_words),
    Rule("not_letters", lambda t: 10 * t.n_plain > 4 * t.word_chars),
)
BASE = RULES[:2]


def estimate(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 2000) -> list[dict]:
    """Cost (seconds) and rejections of each rule on a sample of about
    ``sample_rows`` rows.  Each rule is timed on its own, from the raw text."""
    total = docs.count()
    if not total:
        return [{"rule": r.name, "seconds": 0.0, "rejected": 0, "seen": 0} for r in rules]
    bound = int(min(1.0, sample_rows / total) * (2**31 - 1))
    sample = common.pick(docs, text=text_col).filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(2**31)) <= bound).limit(4 * sample_rows)

    def measure(batch: pa.RecordBatch):
        raw = common.text_bytes(batch)
        rows = []
        for r in rules:
            began = time.process_time()
            rejected = sum(r.fails(Text(x)) for x in raw)
            rows.append((r.name, time.process_time() - began, rejected, len(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["rule", "seconds", "rejected", "seen"])

    measured = common.map_batches(sample, measure, "rule string, seconds double, rejected bigint, seen bigint")
    found = {r["rule"]: r.asDict() for r in measured.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "rejected", "seen")]).collect()}
    return [found.get(r.name, {"rule": r.name, "seconds": 0.0, "rejected": 0, "seen": 0}) for r in rules]


def cascade(docs: DataFrame, rules=RULES, text_col: str = "text", sample_rows: int = 2000) -> list[Rule]:
    """The rules by rejections per second on the sample, ties as given."""
    gain = {m["rule"]: m["rejected"] / max(m["seconds"], 1e-9) for m in estimate(docs, rules, text_col, sample_rows)}
    return sorted(rules, key=lambda r: -gain[r.name])


def first_failure(t: Text, order: list[Rule]) -> str | None:
    """Name of the first rule that rejects the text; the rest are not run."""
    return next((r.name for r in order if r.fails(t)), None)


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """One row per document: ``id``, the base counts, ``base_failed``,
    ``kept`` and ``rejected_by`` (the first rule of the cascade that failed)."""
    order = [r.name for r in cascade(docs, RULES, text_col, sample_rows)]
    kind = docs.schema[id_col].dataType.simpleString()
    counts = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    def scan(batch: pa.RecordBatch):
        rules = _named(order)
        docs = [Text(x) for x in common.text_bytes(batch)]
        why = [first_failure(t, rules) for t in docs]
        base = [any(r.fails(t) for r in BASE) for t in docs]
        columns = [pa.array([getattr(t, c) for t in docs], pa.int64()) for c in counts]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), *columns, pa.array(base, pa.bool_()), pa.array([w is None and not b for w, b in zip(why, base)], pa.bool_()), pa.array(why, pa.string())],
            names=["id", *counts, "base_failed", "kept", "rejected_by"])

    longs = ", ".join(f"{c} bigint" for c in counts)
    return common.map_batches(common.pick(docs, id=id_col, text=text_col), scan, f"id {kind}, {longs}, base_failed boolean, kept boolean, rejected_by string")


def keep_good(docs: DataFrame, text_col: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs`` that no rule rejects, all columns as they are.
    No shuffle; each text is read only as far as the cascade needs it."""
    order = [r.name for r in cascade(docs, RULES, text_col, sample_rows)]

    def scan(batch: pa.RecordBatch):
        rules = _named(order)
        mask = [first_failure(Text(x), rules) is None for x in common.text_bytes(batch, text_col)]
        yield batch.filter(pa.array(mask, pa.bool_()))

    return common.map_batches(docs, scan, docs.schema)


def _named(order: list[str]) -> list[Rule]:
    by_name = {r.name: r for r in RULES}
    return [by_name[n] for n in order]
