"""Readers for the reference's file inputs (S1-S7, S21-S25), all as Spark
scans: CSV rankings, release metadata JSON, name lists, source trees,
wheel archives and HTML listings."""

from __future__ import annotations

import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgscope.functions import versions as V

# --- fixed values: patterns of the HTML listings ---
VERSION_LINK = r'href="(\d+\.\d+\.\d+)/"'
ANCHOR = r'<a\s+href="([^"]*)"[^>]*>\s*(?:<code[^>]*>)?([^<]*)'

RELEASES_SCHEMA = (
    "info struct<name:string,requires_python:string,requires_dist:array<string>>, "
    "releases map<string,array<struct<filename:string,url:string,upload_time:string>>>"
)


def ranked_packages(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(project, num_downloads) CSV, missing downloads as 0, most
    downloaded first (explicit order rather than file order)."""
    df = spark.read.csv(path, header=True, schema="project string, num_downloads long").fillna({"num_downloads": 0})
    df = df.orderBy(F.col("num_downloads").desc(), F.col("project"))
    return df.limit(limit) if limit else df


def rank_by_dependents(df: DataFrame, platform: str = "Pypi", limit: int = 10000) -> DataFrame:
    """Packages of one platform by dependent count, top ``limit``."""
    return (
        df.where(F.col("Platform") == platform)
        .orderBy(F.col("Dependent Projects Count").desc(), F.col("Name"))
        .limit(limit)
        .select(F.col("Name").alias("name"), F.col("Dependent Projects Count").alias("dependents"),
                F.col("Dependent Repositories Count").alias("repositories"))
    )


def release_metadata(spark: SparkSession, path: str, one_per_file: bool = True) -> DataFrame:
    """S3: package metadata JSON (one object per file, or one per line) with an explicit schema."""
    return spark.read.schema(RELEASES_SCHEMA).json(path, multiLine=one_per_file).withColumn("pkg", F.col("info.name"))


def release_files(meta: DataFrame) -> DataFrame:
    """One row per released file; versions without files disappear (the
    inner explode drops empty arrays)."""
    return (
        meta.select("pkg", F.explode("releases").alias("ver", "files"))
        .select("pkg", "ver", F.posexplode("files").alias("file_ord", "f"))
        .select("pkg", "ver", "file_ord", "f.filename", "f.url",
                F.to_timestamp("f.upload_time").alias("upload_time"))
    )


def requirement_rows(meta: DataFrame) -> DataFrame:
    """Requirement rows of package metadata with name, specifier,
    marker and extras parsed by column expressions."""
    r = meta.select("pkg", F.col("info.requires_python").alias("require_python"),
                    F.posexplode_outer("info.requires_dist").alias("req_id", "requires_dist"))
    return r.select(
        "pkg", "require_python", "req_id", "requires_dist",
        V.requirement_name(F.col("requires_dist")).alias("dep"),
        V.requirement_spec(F.col("requires_dist")).alias("spec"),
        F.nullif(F.trim(F.regexp_extract("requires_dist", r";(.*)$", 1)), F.lit("")).alias("marker"),
        F.split(F.regexp_extract("requires_dist", r"^[^\[;(]*\[([^\]]*)\]", 1), r"\s*,\s*").alias("extras"),
    )


def plain_requirements(reqs: DataFrame) -> DataFrame:
    """Requirement rows without marker and without extras (report use)."""
    return reqs.where(F.col("requires_dist").isNotNull() & F.col("marker").isNull() & F.forall("extras", lambda e: e == ""))


def name_lists(spark: SparkSession, path_glob: str) -> DataFrame:
    """``<lib>-<ver>.txt`` name lists, one name per line; library and
    version from the file name split at the last dash."""
    df = spark.read.text(path_glob).where(F.trim("value") != "")
    fn = F.regexp_extract(F.col("_metadata.file_name"), r"([^/]*)$", 1)
    return df.select(
        F.regexp_extract(fn, r"^(.*)-([^-]+)\.txt$", 1).alias("lib"),
        F.regexp_extract(fn, r"^(.*)-([^-]+)\.txt$", 2).alias("ver"),
        F.trim("value").alias("name"),
    )


def source_tree(spark: SparkSession, root: str, files: str = "*.py") -> DataFrame:
    """Every ``*.py`` below ``root`` as (path, src), whole text per file."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).option("wholetext", "true")
        .text(root)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("src"))
    )


#: What an archive is read for: sources, metadata and top levels.
WANTED = re.compile(r"\.pyi?$|\.dist-info/(METADATA|top_level\.txt)$")
_MEMBERS = "archive string, member string, src string, error string"


def _members(path: str, content: bytes) -> Iterator[tuple]:
    """(archive, member, text, error) of a wheel, one member in memory at a time."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for name in z.namelist():
                if WANTED.search(name):
                    yield path, name, z.read(name).decode("utf-8", errors="ignore"), None
    except (zipfile.BadZipFile, zlib.error, EOFError, NotImplementedError, RuntimeError, OSError, struct.error) as broken:
        yield path, None, None, f"{type(broken).__name__}: {broken}"  # quarantined, see S25


def unpacked(archives: DataFrame, batch_bytes: int = 4 << 20) -> DataFrame:
    """Members (.py, .pyi, METADATA, top_level.txt) of wheel archives
    (path, content); a bad archive gives one row with ``error`` instead of
    failing the job.  Rows leave in batches of about ``batch_bytes`` of text,
    so a worker holds one batch of archives and one of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                for row in _members(path.as_py(), content.as_py() or b""):
                    rows.append(row)
                    size += len(row[2] or "") + 200
                    if size >= batch_bytes:
                        yield _text_rows(rows)
                        rows, size = [], 0
        if rows:
            yield _text_rows(rows)

    return archives.select("path", "content").mapInArrow(run, _MEMBERS)


def _text_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["archive", "member", "src", "error"])


def wheel_sources(spark: SparkSession, path_glob: str) -> DataFrame:
    """:func:`unpacked` of the archives that match a path."""
    return unpacked(spark.read.format("binaryFile").load(path_glob))


def wheel_name(archive: Column) -> Column:
    """Package and version from a wheel's file name ``<pkg>-<ver>-...whl`` -> struct(pkg, ver)."""
    file = F.substring_index(archive, "/", -1)
    return F.struct(F.split_part(file, F.lit("-"), F.lit(1)).alias("pkg"), F.split_part(file, F.lit("-"), F.lit(2)).alias("ver"))


def metadata_requirements(members: DataFrame) -> DataFrame:
    """``Requires-Dist`` / ``Requires-Python`` lines of wheel METADATA."""
    md = members.where(F.col("member").endswith(".dist-info/METADATA"))
    return md.select(
        "archive",
        F.regexp_extract("src", r"(?m)^Requires-Python:\s*(.*)$", 1).alias("require_python"),
        F.posexplode(F.regexp_extract_all("src", F.lit(r"(?m)^Requires-Dist:\s*(.*)$"), F.lit(1))).alias("req_id", "requires_dist"),
    )


def version_links(html: Column) -> Column:
    """Versions linked as ``href="X.Y.Z/"``."""
    return F.regexp_extract_all(html, F.lit(VERSION_LINK), F.lit(1))


def anchors(html: Column) -> Column:
    """ARRAY<STRUCT<href, text>> of the anchors of a page (the text
    inside an optional ``<code>``)."""
    return F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(1)).alias("href"),
        F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(2)).alias("text"),
    )


def module_index(pages: DataFrame, prefix: str) -> DataFrame:
    """Names linked from an index page under ``prefix`` that hold no dot."""
    a = pages.select("page_id", F.explode(anchors(F.col("html"))).alias("a"))
    return a.where(F.col("a.href").startswith(prefix) & ~F.col("a.text").contains(".")).select(
        "page_id", F.col("a.href").alias("href"), F.col("a.text").alias("name"))


def wheel_modules(members: DataFrame) -> DataFrame:
    """Modules of wheel archives from member paths.

    Top levels come from ``*.dist-info/top_level.txt``, else from the package
    in the archive's own file name.  A
    top level that is a directory contributes every ``.py`` (not ending in
    ``setup.py``) and ``.pyi`` file whose directories below the top level all
    hold an ``__init__.py``; a top level ``T.py`` / ``T.pyi`` is a single-file
    package.  -> archive, top_level, module, src_kind, src (one row per file;
    a module may have both a .py and a .pyi row, .py first)."""
    tl_files = members.where(F.col("member").endswith(".dist-info/top_level.txt"))
    tops = tl_files.select("archive", F.explode(F.split(F.trim("src"), r"\s*\n\s*")).alias("top_level")) \
        .where(F.col("top_level") != "")
    fallback = members.select("archive").distinct().join(tl_files.select("archive"), "archive", "left_anti")
    tops = tops.unionByName(fallback.withColumn("top_level", wheel_name(F.col("archive"))["pkg"])).distinct()
    files = members.where(F.col("member").rlike(r"\.pyi?$")).select(
        "archive", "member", "src", F.regexp_extract("member", r"\.(pyi?)$", 1).alias("src_kind"),
        F.split("member", "/").alias("_p"))
    f = files.join(tops, files["archive"] == tops["archive"]).drop(tops["archive"])
    in_dir = (F.size("_p") > 1) & (F.col("_p")[0] == F.col("top_level"))
    single = (F.size("_p") == 1) & (F.regexp_replace(F.col("_p")[0], r"\.pyi?$", "") == F.col("top_level"))
    f = f.where(in_dir | single).where(~F.col("member").endswith("setup.py"))
    # every directory strictly below the top level must hold an __init__.py
    need = (
        f.where(F.size("_p") > 2)
        .select("archive", "member", F.explode(F.sequence(F.lit(2), F.size("_p") - 1)).alias("_d"), "_p")
        .select("archive", "member", F.concat(F.array_join(F.slice("_p", 1, F.col("_d")), "/"), F.lit("/__init__.py")).alias("_init"))
    )
    missing = need.join(members.select("archive", F.col("member").alias("_init")), ["archive", "_init"], "left_anti") \
        .select("archive", "member").distinct()
    f = f.join(missing, ["archive", "member"], "left_anti")
    module = F.regexp_replace(F.array_join("_p", "."), r"\.pyi?$", "")
    return f.select("archive", "top_level", module.alias("module"), "src_kind", "src")
