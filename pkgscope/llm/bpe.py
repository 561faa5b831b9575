"""Byte-level BPE encoding and decoding as a monoid tree reduction.

A piece of text is encoded by halves: short pieces directly (each match of the
pre-tokenisation pattern separately), longer ones by joining the tokens of
their halves.  A join re-encodes a window around the cut and replaces the
tokens it covers; the window starts small and grows until both of its ends
are places where every text splits, whatever stands before or after.  Such a
place is a non-space followed by a space or line break, a letter followed by a
digit or mark, and so on: no match of the pattern can hold both characters,
and no match decides by looking past it, so the tokens outside the window are
provably those of the whole text.  A text without such places is re-encoded
whole.  The join is associative, so the tree's shape does not matter.

Decoding maps ids to bytes and concatenates up the same kind of tree.

Defined cases: a null text is empty and gives no ids; every row gives one
row; an empty table gives none; only the id and text columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from pkgscope.llm import common

LEAF = 1 << 9    # code points encoded directly
REACH = 64       # first window, code points on each side of the cut

#: Between these two characters every text splits (see the module's text): a
#: visible ASCII character or letter before a blank or line break; a letter or
#: digit before another class.  "'" is left out on the left: contractions.
SAFE = regex.compile(r"(?<=[!-~\p{L}])(?=[ \n\r\t])|(?<=[A-Za-z])(?=[0-9!-&(-/:-@\[-`{-~])|(?<=[0-9])(?=[A-Za-z!-/:-@\[-`{-~])")


@dataclass
class Piece:
    """Tokens of a stretch of text: the monoid's element."""

    text: str
    ids: list[int]


class TreeCodec:
    """Encoder and decoder of one vocabulary file, one per worker."""

    def __init__(self, ranks_path: str, pattern: str, leaf: int = LEAF, reach: int = REACH):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.lib = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.direct = self.lib.encode_ordinary
        self.leaf, self.reach = leaf, reach

    def encode(self, text: str) -> list[int]:
        return self._tree(text).ids

    def _tree(self, text: str) -> Piece:
        if len(text) <= self.leaf:
            return Piece(text, self.direct(text))
        half = len(text) // 2
        return self.join(self._tree(text[:half]), self._tree(text[half:]))

    def join(self, left: Piece, right: Piece) -> Piece:
        if not left.text or not right.text:
            return left if left.text else right
        a = self._left_edge(left.text)
        b = self._right_edge(right.text)
        window = self.direct(left.text[a:] + right.text[:b])
        before = self._drop_tail(left.ids, len(left.text[a:].encode()))
        after = self._drop_head(right.ids, len(right.text[:b].encode()))
        return Piece(left.text + right.text, left.ids[:before] + window + right.ids[after:])

    def _left_edge(self, text: str) -> int:
        """The last safe place before the cut, sought within a growing reach, or 0."""
        reach = self.reach
        while True:
            lo = max(0, len(text) - reach)
            places = [m.start() for m in SAFE.finditer(text, max(lo, 1), len(text)) if 0 < m.start() < len(text)]
            if places:
                return places[-1]
            if lo == 0:
                return 0
            reach *= 2

    def _right_edge(self, text: str) -> int:
        """The first safe place after the cut, or the end.  A match covers a
        look ahead of at most two characters, which lie inside the window's
        text or right at a place where the pattern splits."""
        m = SAFE.search(text, 1)
        return m.start() if m else len(text)

    def _drop_tail(self, ids: list[int], n_bytes: int) -> int:
        k = len(ids)
        while n_bytes > 0:
            k -= 1
            n_bytes -= len(self.bytes_of[ids[k]])
        assert n_bytes == 0, "a safe place lies inside a token"
        return k

    def _drop_head(self, ids: list[int], n_bytes: int) -> int:
        k = 0
        while n_bytes > 0:
            n_bytes -= len(self.bytes_of[ids[k]])
            k += 1
        assert n_bytes == 0, "a safe place lies inside a token"
        return k

    def decode(self, ids, leaf: int = 1 << 15) -> bytes:
        """Bytes of the ids, concatenated up a tree of halves."""
        if len(ids) <= leaf:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)


def little_endian(ids: list[int]) -> bytes:
    """Ids as unsigned 32-bit integers."""
    return np.array(ids, dtype="<u4").tobytes()


_held: dict[tuple, TreeCodec] = {}


def codec(ranks_path: str, pattern: str, leaf: int = LEAF) -> TreeCodec:
    key = (ranks_path, pattern, leaf)
    if key not in _held:
        _held[key] = TreeCodec(*key)
    return _held[key]


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF,
           max_rows: int = 1000) -> DataFrame:
    """``id, ids`` (array<int>) of every row.  No shuffle."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        c = codec(ranks_path, pattern, leaf)
        for part in _slices(batch, max_rows):
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array([np.array(c.encode(t), np.int32) for t in common.texts(part)], pa.list_(pa.int32()))], names=["id", "ids"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), run, f"id {kind}, ids array<int>")


def decode(encoded: DataFrame, ranks_path: str, pattern: str, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, bytes`` of every row of ids; null ids give no bytes."""
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        c = codec(ranks_path, pattern)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([c.decode(x or []) for x in batch.column("ids").to_pylist()], pa.binary())], names=["id", "bytes"])

    return common.map_batches(common.pick(encoded, id=id_col, ids=ids_col), run, f"id {kind}, bytes binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every row in one pass and return only digests:
    ``id, n_tokens, ids_sha256, decoded_sha256``."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        c = codec(ranks_path, pattern)
        rows = []
        for t in common.texts(batch):
            ids = c.encode(t)
            rows.append((len(ids), hashlib.sha256(little_endian(ids)).hexdigest(), hashlib.sha256(c.decode(ids)).hexdigest()))
        n, a, b = zip(*rows)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), run, f"id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _slices(batch: pa.RecordBatch, rows: int):
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))
