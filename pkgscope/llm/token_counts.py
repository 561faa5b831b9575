"""Token counts by prefix dynamic programming.

For a pair-merging vocabulary every prefix of a text has one encoding, and
the last token of that encoding follows from the earlier prefixes: a token t
that ends at place k is the last one exactly if, with u the last token of the
prefix before t, the text u + t alone is encoded as [u, t].  So one pass over
the places gives, for every prefix, its last token and its exact token count.
With the counts stored, the number of tokens of any prefix, the longest
prefix within a budget and a truncation point are lookups.

Two facts of the vocabulary cut the text into stretches that never share a
token: no piece holds a blank after another character, and characters that
occur in no longer piece stand alone.  Both are read from the vocabulary, not
assumed.  Equal stretches share one table per worker (bounded memory).

The counts are those of the sentencepiece library without begin and end
tokens: a blank is put before the text, blanks become U+2581, characters
without a piece become their UTF-8 bytes.  The model must do nothing else to
the text; :class:`PrefixCounter` refuses one that does.

Defined cases: a null text is empty and has no tokens; every row gives one
row; an empty table gives none; only the id and text columns are read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from pkgscope.llm import common

BLANK = "▁"


class PrefixCounter:
    """The tables of one vocabulary file."""

    def __init__(self, model_path: str, cache_entries: int = 800_000):
        sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
        if sp.encode("a  b Ａ ", out_type=str)[0] != BLANK + "a" or "".join(sp.encode("a  b ", out_type=str)) != f"{BLANK}a{BLANK}{BLANK}b{BLANK}":
            raise ValueError("the model changes blanks; prefixes of its text are not prefixes of the given text")
        normal = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in normal}
        joint = [p for p in self.rank if len(p) > 1]
        if any(p[i] != BLANK and BLANK in p[i + 1:] for p in joint for i in range(len(p))):
            raise ValueError("a piece holds a blank after another character")
        inner = {c for p in joint for c in p} - {BLANK}
        if not all(c in self.rank for c in inner):
            raise ValueError("a character of a longer piece is no piece itself")
        #: stretches: blanks with the joinable characters after them, or one character that stands alone
        self.stretch = re.compile(f"{BLANK}*[{re.escape(''.join(sorted(inner)))}]+|{BLANK}+|.", re.S)
        self.pieces = ahocorasick.Automaton()
        #: per piece, the symbols at its right and left end while it is built, each with the rank of the merge that ends it
        self.right: list[list[tuple[str, float]]] = []
        self.left: list[list[tuple[str, float]]] = []
        for p in self.rank:
            ends = self._ends(p)
            if ends:  # a piece that its own text isn't merged to never is a token
                self.pieces.add_word(p, (len(p), len(self.right)))
                self.left.append(ends[0])
                self.right.append(ends[1])
        self.pieces.make_automaton()
        self.tables: dict[str, Sequence[int]] = {}
        self.pairs: dict[int, bool] = {}
        self.cache_entries = cache_entries

    def _ends(self, piece: str):
        """(left, right) end symbols of a piece over time, or None if merging its text gives something else."""
        parts, rank = list(piece), self.rank
        left, right, done = [[parts[0], math.inf]], [[parts[-1], math.inf]], -math.inf
        while len(parts) > 1:
            r, i = min(((rank[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in rank), default=(None, 0))
            if r is None:
                return None
            if r < done:
                raise ValueError(f"a merge inside {piece!r} outranks a piece it is made of")
            done = r
            for side, hit in ((left, i == 0), (right, i == len(parts) - 2)):
                if hit:
                    side[-1][1] = r
                    side.append([parts[i] + parts[i + 1], math.inf])
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [tuple(x) for x in left], [tuple(x) for x in right]

    def _splits(self, u: int, t: int) -> bool:
        """True if the text of pieces u and t is encoded as u, t: at no time
        do the symbols that meet between them merge.  Of equal merges the left one goes first."""
        a, b, i, j, rank = self.right[u], self.left[t], 0, 0, self.rank
        while True:
            m = rank.get(a[i][0] + b[j][0])
            if m is not None and m < a[i][1] and m <= b[j][1]:
                return False
            if a[i][1] == b[j][1] == math.inf:
                return True
            if a[i][1] <= b[j][1]:
                i += 1
            else:
                j += 1

    def table(self, s: str) -> Sequence[int]:
        """Token counts of all prefixes of a stretch, by their lengths from 1."""
        counts = self.tables.get(s)
        if counts is None:
            if len(self.tables) > self.cache_entries:
                self.tables.clear()
            counts = self.tables[s] = self._solve(s)
        return counts

    def _solve(self, s: str) -> Sequence[int]:
        if len(s) == 1:
            return (1 if s in self.rank else len(s.encode()),)
        last, counts = [-1] * (len(s) + 1), [0] * (len(s) + 1)
        pairs = self.pairs
        for end, (size, t) in self.pieces.iter(s):  # every piece that ends at each place, place by place
            k = end + 1
            if counts[k]:
                continue
            u = last[k - size]
            if k > size:
                key = u << 32 | t
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) > 2 * self.cache_entries:
                        pairs.clear()
                    fits = pairs[key] = self._splits(u, t)
                if not fits:
                    continue
            last[k] = t
            counts[k] = counts[k - size] + 1
        return bytes(counts[1:]) if counts[-1] < 256 else tuple(counts[1:])  # bytes: the smallest sequence of small numbers

    def shown(self, text: str) -> str:
        """The text as the pieces see it."""
        return BLANK + text.replace(" ", BLANK) if text else ""

    def count(self, text: str) -> int:
        """Tokens of the whole text: the count stored at its last prefix."""
        known, table = self.tables.get, self.table
        n = 0
        for s in self.stretch.findall(self.shown(text)):
            n += (known(s) or table(s))[-1]
        return n

    def prefix_counts(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 0, 1, ... len(text) characters."""
        parts, base = [], 0
        for s in self.stretch.findall(self.shown(text)):
            counts = np.array(list(self.table(s)), np.int64) + base
            parts.append(counts)
            base = int(counts[-1])
        if not parts:
            return np.zeros(1, np.int64)
        counts = np.concatenate(parts)  # counts[0] is the put-in blank alone, which an empty prefix doesn't have
        counts[0] = 0
        return counts

    def longest_prefix(self, text: str, budget: int) -> int:
        """Most characters whose own encoding has at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_held: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    if model_path not in _held:
        _held[model_path] = PrefixCounter(model_path)
    return _held[model_path]


def token_counts(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row.  No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        c = counter(model_path)
        raw = common.text_bytes(batch)
        n = [c.count(t.decode()) for t in raw]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                                         names=["id", "n_bytes", "n_tokens", "over_limit"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")


def prefix_tables(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, counts``: the stored table, one count per prefix length from 0."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        c = counter(model_path)
        for i in range(batch.num_rows):
            counts = c.prefix_counts(batch.column("text")[i].as_py() or "")
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(i, 1), pa.array([counts], pa.list_(pa.int64()))], names=["id", "counts"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), run, f"id {kind}, counts array<bigint>")


def truncate(docs: DataFrame, model_path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_chars, text``: the longest prefix within ``budget`` tokens."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        c = counter(model_path)
        text = common.texts(batch)
        n = [c.longest_prefix(t, budget) for t in text]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array([t[:k] for t, k in zip(text, n)])], names=["id", "n_chars", "text"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), run, f"id {kind}, n_chars bigint, text string")
