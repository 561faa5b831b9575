"""SimHash near-dedup by anchor-point covering.

A 64-bit fingerprint is cut into segments of 32, 16 or 8 bits.  Two
fingerprints that differ in at most ``max_bits`` bits differ in at most
``max_bits // segments`` (0 or 1) bits of some segment.  Within a segment the
anchors are a covering code: the perfect Hamming code on all bits but one,
times that free bit, with covering radius 1.  Each fingerprint has a home
anchor (within the radius) and is replicated to every anchor within radius +
1; of a pair that differs in at most one bit of the segment, either one meets
the other at its home anchor, so comparing homes with replicas per anchor
loses no pair.  A segment of 32 bits has 2**27 anchors and about 17 replicas.

Only distinct fingerprints are replicated, so copies of one text cost one
row.  Links go through a star-contraction of connected components; nothing
but a row count reaches the driver.

Defined cases: null text or a text without words has fingerprint zero and is
linked like any other; every row gives one row, repeated rows included; a null
id never is a component's id unless its component has no other; an empty
table gives no rows; only the id and text columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pkgscope.llm import common
from pkgscope.session import cut_lineage

SEED = 42


def fingerprint(raw: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of one UTF-8 text: a bit is set if it is set
    in over half the XXH64 values of the shingles (repeats included)."""
    tokens = raw.lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    n = len(tokens)
    if not n:
        return 0
    if n <= words:
        return xxhash.xxh64_intdigest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[:n - words + 1].tolist(), ends[words - 1:].tolist())]
    return majority(np.array(hashes, dtype=np.uint64))


def majority(hashes: np.ndarray, block: int = 1 << 15) -> int:
    """Bits set in over half the values, counted in blocks of bounded size."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), block):
        part = hashes[i:i + block].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``id, fp``: the fingerprint of every row as a (signed) long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def scan(batch: pa.RecordBatch):
        fps = np.array([fingerprint(t, words) for t in common.text_bytes(batch)], dtype=np.uint64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps.view(np.int64))], names=["id", "fp"])

    return common.map_batches(common.pick(docs, id=id_col, text=text_col), scan, f"id {kind}, fp bigint")


def segment_width(max_bits: int) -> int:
    """Widest segment with at most one differing bit guaranteed in some segment."""
    for width in (32, 16, 8):
        if 0 <= max_bits // (64 // width) <= 1:
            return width
    raise ValueError("max_bits must be from 0 to 15")


def _segments(width: int):
    """(number, segment value) as SQL over column fp."""
    return [(k, f"(shiftrightunsigned(fp, {k * width}) & {(1 << width) - 1}L)") for k in range(64 // width)]


def _syndrome(value: str, width: int) -> str:
    """SQL: exclusive or of the positions 1..width-1 of the set bits (bit p-1
    is position p); the last bit is the free one."""
    r = width.bit_length() - 1
    masks = [sum(1 << (p - 1) for p in range(1, width) if p >> j & 1) for j in range(r)]
    return " + ".join(f"(bit_count({value} & {m}L) % 2) * {1 << j}" for j, m in enumerate(masks))


def anchor_columns(fps: DataFrame, width: int) -> DataFrame:
    """One row per fingerprint and segment: ``fp, seg, v`` (segment value), ``s`` (syndrome)."""
    rows = ", ".join(f"named_struct('seg', {k}L, 'v', {v}, 's', {_syndrome(v, width)})" for k, v in _segments(width))
    return fps.selectExpr("fp", f"inline(array({rows}))")


def _key(value: str, width: int) -> str:
    return f"shiftleft(seg, {width}) | ({value})"


def homes(anchors: DataFrame, width: int) -> DataFrame:
    """Every fingerprint at the anchor nearest to it in each segment."""
    return anchors.selectExpr(_key("v ^ IF(s = 0, 0L, shiftleft(1L, s - 1))", width) + " AS anchor", "fp")


def replicas(anchors: DataFrame, width: int) -> DataFrame:
    """Every fingerprint at all anchors within covering radius + 1."""
    free = 1 << (width - 1)
    flip = lambda p: f"IF({p} = 0, 0L, shiftleft(1L, {p} - 1))"
    nearest = f"v ^ {flip('s')}"
    # a word at distance 1 from its anchor has the others at distance 2: two positions whose exclusive or is the syndrome
    pairs = f"transform(filter(sequence(1, {width - 1}), i -> i < (i ^ s)), i -> v ^ {flip('i')} ^ {flip('(i ^ s)')})"
    near = f"IF(s = 0, array({nearest}, {nearest} ^ {free}L), concat(array({nearest}, {nearest} ^ {free}L), {pairs}))"
    return anchors.selectExpr("fp", "seg", f"explode({near}) AS a").selectExpr(_key("a", width) + " AS anchor", "fp")


def links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """``a, b`` (a < b): all pairs of distinct fingerprints of ``fps`` (one
    row each) within ``max_bits`` bits."""
    width = segment_width(max_bits)
    anchors = anchor_columns(fps, width)
    x, y = homes(anchors, width).alias("x"), replicas(anchors, width).alias("y")
    near = x.hint("merge").join(y, F.expr(f"x.anchor = y.anchor AND x.fp < y.fp AND bit_count(x.fp ^ y.fp) <= {int(max_bits)}"))
    return near.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (a, b): root is the smallest
    node of its connected component.  Alternating large and small stars; each
    round is checkpointed in the shared folder and only a count is collected."""
    e = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    while not _is_forest_of_stars(e):
        e = cut_lineage(_small_star(_large_star(e)))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select("v", "v").distinct())


def _is_forest_of_stars(e: DataFrame) -> bool:
    """No centre hangs on another node, and no node hangs on two centres."""
    chained = e.join(e.select(F.col("v").alias("c")).distinct(), F.col("u") == F.col("c"), "left_semi")
    twice = e.groupBy("u").count().filter("count > 1").select("u")
    return chained.select("u").union(twice).limit(1).count() == 0


def _large_star(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")).withColumnRenamed("u", "k")
    return both.join(low, both.u == low.k).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
    moved = e.join(low, e.u == low.k).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
    return moved.union(low.select(F.col("k"), F.col("m"))).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``id, fp`` (long), ``component`` (smallest id
    that links lead to, itself included)."""
    prints = cut_lineage(fingerprints(docs, id_col, text_col, words))
    return prints.alias("p").join(fingerprint_components(prints, max_bits).alias("c"), F.col("p.fp") == F.col("c.fp")).select(
        "p.id", "p.fp", "c.component")


def fingerprint_components(prints: DataFrame, max_bits: int) -> DataFrame:
    """``fp, component``: one row per distinct fingerprint of ``prints`` (id, fp)."""
    nodes = cut_lineage(prints.groupBy("fp").agg(F.min("id").alias("lo")))
    roots = components(links(nodes.select("fp"), max_bits))
    rooted = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "lo", F.coalesce("root", "fp").alias("root"))
    rooted = cut_lineage(rooted)
    lowest = rooted.groupBy("root").agg(F.min("lo").alias("component"))
    return cut_lineage(rooted.join(lowest, "root").select("fp", "component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 3) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null last),
    then the smallest row hash; of fully equal rows one stays.  All columns
    stay as they are."""
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = lambda i, h: F.concat_ws(":", i.cast("string"), h.cast("string"))  # noqa: E731  a null id leaves the hash alone
    pair = F.struct(F.col(f"`{id_col}`").alias("id"), mark.alias("h"))
    prints = cut_lineage(fingerprints(docs.select(pair.alias("id"), F.col(f"`{text_col}`").alias("text")), "id", "text", words))
    # the smallest struct would be one with a null id: put "is null" first
    nodes = prints.select(F.struct(F.col("id.id").isNull().alias("none"), F.col("id.id").alias("id"), F.col("id.h").alias("h")).alias("id"), "fp")
    kept = fingerprint_components(nodes, max_bits).select(key(F.col("component.id"), F.col("component.h")).alias("key")).distinct()
    rows = docs.select(key(F.col(f"`{id_col}`"), mark).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    nth = F.row_number().over(Window.partitionBy("key").orderBy("key"))  # fully equal rows share a key
    return rows.join(kept, "key", "left_semi").withColumn("nth", nth).filter("nth = 1").select("row.*")
