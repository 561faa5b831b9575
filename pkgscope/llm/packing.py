"""Packing by concatenate and cut.

Pass 1 tokenises every document, appends the end id, and stores the ids with
the document's start inside its partition; the partitions' token totals are
summed to give each partition's global offset (the second prefix sum).  Pass
2 turns every document into pieces by cutting at the multiples of the window
length: the piece's sequence is its global position divided by the window,
its offset the remainder.  No rows are sorted or grouped; what goes through
the driver is one number a partition.  Windows that no partition border
crosses are complete within one partition; the others are put together from
their boundary pieces by :func:`sequences`.

All windows are full but the last, so padding is less than one window in all.

Ids are those of the tokenizers library for the vocabulary file, special
strings in a text included; they are made by tiktoken from the same file's
vocabulary, which splits and merges alike (tested over every code point) and
is several times faster.

Defined cases: a null or empty text is one document of the end id alone; every
row is a document of its own, repeated rows included; an empty table gives no
pieces; only the id and text columns are read.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pkgscope.llm import common
from pkgscope.session import cut_lineage


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    visible Latin-1 characters for themselves, the other bytes for the
    characters from U+0100 on, in order."""
    visible = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids as the tokenizers library gives them for a byte-level vocabulary file."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _byte_of()
        ranks = {bytes(to_byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.special}
        self.lib = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.lib.encode(text, allowed_special="all")
        return self.lib.encode_ordinary(text)


_held: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _held:
        _held[path, pattern] = Encoder(path, pattern)
    return _held[path, pattern]


def tokenised(docs: DataFrame, path: str, pattern: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pass 1: ``id, part, start, n, ids``; ``start`` counts the tokens of the
    partition's earlier rows.  ids: little-endian, 2 bytes each if all ids
    of the vocabulary fit, else 4."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = common.pick(docs, id=id_col, text=text_col).withColumn("part", F.spark_partition_id())

    def run(batches):
        enc = encoder(path, pattern)
        form = np.dtype("<u2") if max(enc.lib.n_vocab, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        start = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            starts, sizes, ids = [], [], []
            for t in common.texts(batch):
                x = np.array([*enc.encode(t), end_id], form)
                starts.append(start)
                sizes.append(len(x))
                ids.append(x.tobytes())
                start += len(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("part"), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                                             names=["id", "part", "start", "n", "ids"])

    return rows.mapInArrow(run, f"id {kind}, part int, start bigint, n bigint, ids binary")


def partition_offsets(stored: DataFrame) -> dict[int, int]:
    """Global offset of each partition: the exclusive sum of the totals."""
    totals = stored.groupBy("part").agg(F.max(F.col("start") + F.col("n")).alias("total")).collect()
    offsets, at = {}, 0
    for r in sorted(totals, key=lambda r: r["part"]):
        offsets[r["part"]] = at
        at += r["total"]
    return offsets


def cut(at: int, n: int, window: int) -> list[tuple[int, int, int, int]]:
    """(start, length, sequence, offset) of the pieces of a document of n
    tokens whose first token has the global position ``at``."""
    out, start = [], 0
    while start < n:
        sequence, offset = divmod(at + start, window)
        length = min(window - offset, n - start)
        out.append((start, length, sequence, offset))
        start += length
    return out


def pack(docs: DataFrame, path: str, pattern: str, window: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
         with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id, start, length, ids_crc32, n (the document's
    tokens), sequence_id, offset`` and, if asked for, ``ids`` (array<int>)."""
    stored = cut_lineage(tokenised(docs, path, pattern, end_id, id_col, text_col))
    offsets = docs.sparkSession.sparkContext.broadcast(partition_offsets(stored))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batch: pa.RecordBatch):
        base = offsets.value
        rows, pieces, at_row = [], [], []
        for i, (part, start, n, raw) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("part", "start", "n", "ids")))):
            ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
            for first, length, sequence, offset in cut(base[part] + start, n, window):
                x = ids[first:first + length]
                rows.append((first, length, zlib.crc32(x.tobytes()), n, sequence, offset))
                at_row.append(i)
                if with_ids:
                    pieces.append(x.astype(np.int32))
        columns = [batch.column("id").take(pa.array(at_row)), *(pa.array(c, pa.int64()) for c in zip(*rows))]
        names = ["id", "start", "length", "ids_crc32", "n", "sequence_id", "offset"]
        if with_ids:
            columns, names = [*columns, pa.array(pieces, pa.list_(pa.int32()))], [*names, "ids"]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    longs = "start bigint, length bigint, ids_crc32 bigint, n bigint, sequence_id bigint, offset bigint"
    return common.map_batches(stored, run, f"id {kind}, {longs}" + ", ids array<int>" * with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, ids`` of every window, from pieces with ids.  A group is
    one window, so at most its length in tokens."""
    group = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(group, lambda p: p["ids"])).alias("ids"))
