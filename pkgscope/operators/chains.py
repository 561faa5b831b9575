"""Access chains of client code (A6-A11) from parsed client events.

events: c_pkg, c_ver, src_file, ev ('import' | 'call' | 'alias' | 'failed'),
text, target, line (see ``parse.parse_clients``).
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FILE = ["c_pkg", "c_ver", "src_file"]
IDENTIFIER = r"^[\p{L}\p{Nl}_][\p{L}\p{Nl}\p{Mn}\p{Mc}\p{Nd}\p{Pc}]*$"


_RESOLVED = "c_pkg string, c_ver string, src_file string, call string, lines array<int>"


def _files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(file, its rows) of batches sorted by file."""
    rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
    for file, own in itertools.groupby(rows, key=lambda r: r[:3]):
        yield file, [r[3:] for r in own]


def _rewritten(call: str, aliases: dict[str, set[str]]) -> Iterator[str]:
    """The texts that one substitution of the first segment makes of a call."""
    first, dot, rest = call.partition(".")
    name, called, args = first, "", ""
    if first not in aliases and first.endswith(")"):
        name, called, args = first.partition("(")
    for target in aliases.get(name, ()):
        if target not in call:
            yield target + called + args.partition("(")[0] + dot + rest


def _closure(events: list[tuple], rounds: int) -> dict[str, set[int]]:
    """Lines of every call text of a file after the substitution rounds."""
    calls: dict[str, set[int]] = defaultdict(set)
    aliases: dict[str, set[str]] = defaultdict(set)
    for kind, text, target, line in events:
        if kind == "call":
            calls[text].add(line)
        elif target is not None:
            aliases[text].add(target)
    for _ in range(rounds if aliases else 0):
        derived = [(new, set(lines)) for call, lines in calls.items() for new in _rewritten(call, aliases)]
        known = len(calls)
        for new, lines in derived:
            calls[new] |= lines
        if len(calls) == known:
            break
    return calls


def substitute_aliases(events: DataFrame, rounds: int = 5) -> DataFrame:
    """Up to ``rounds`` rounds of alias substitution on the first segment
    of every call text, per file.  A round adds ``target + rest`` (line sets
    merged) for every alias of the first segment whose target text does not
    occur in the call; a call whose first segment is ``name(args)`` uses the
    alias of ``name``.  A file takes another round only while the previous
    one added new texts.  -> c_pkg, c_ver, src_file, call, lines

    The rounds are a fixed point within one file: its events meet in one task
    (the only shuffle) and a worker holds one file's texts at a time."""
    rows = events.where(F.col("ev").isin("call", "alias")).select(*FILE, "ev", "text", "target", F.col("line").cast("int").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((*file, call, sorted(lines)) for file, own in _files(batches) for call, lines in _closure(own, rounds).items())
        while part := list(itertools.islice(found, 5000)):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), [*[pa.string()] * 4, pa.list_(pa.int32())])],
                                             names=[*FILE, "call", "lines"])

    return rows.repartition(*FILE).sortWithinPartitions(*FILE).mapInArrow(run, _RESOLVED)


def render_call(name: Column, argstr: Column) -> Column:
    """``name(args)`` with the argument text re-read like a stored
    pattern: positional ``*`` count, ``...`` for starred, sorted keywords, ``**``."""
    toks = F.filter(F.split(argstr, ","), lambda t: t != "")
    kw = F.array_sort(F.array_distinct(F.transform(F.filter(toks, lambda t: t.contains("=")),
                                                   lambda t: F.concat(F.split(t, "=")[0], F.lit("=*")))))
    n_pos = F.size(F.filter(toks, lambda t: ~t.contains("=") & ~t.contains("**") & ~t.contains("^^^")))
    star = F.exists(toks, lambda t: ~t.contains("=") & ~t.contains("**") & t.contains("^^^"))
    addl = F.exists(toks, lambda t: ~t.contains("=") & t.contains("**"))
    items = F.concat(
        F.array_repeat(F.lit("*"), n_pos),
        F.when(star, F.array(F.lit("..."))).otherwise(F.array().cast("array<string>")),
        kw,
        F.when(addl, F.array(F.lit("**"))).otherwise(F.array().cast("array<string>")),
    )
    return F.concat(name, F.lit("("), F.array_join(items, ","), F.lit(")"))


def chain_items(call: Column) -> Column:
    """ARRAY<STRUCT<text, is_call, name, n_args, kwargs, starargs, addl_kwargs, ok>>."""
    def item(x):
        is_call = x.endswith(")")
        has_paren = x.contains("(")
        argstr = F.regexp_replace(F.try_element_at(F.split(x, r"\("), F.lit(2)), r".$", "")
        toks = F.filter(F.split(argstr, ","), lambda t: t != "")
        return F.struct(
            x.alias("text"), is_call.alias("is_call"),
            F.when(is_call, F.substring_index(x, "(", 1)).otherwise(x).alias("name"),
            F.when(is_call, F.size(F.filter(toks, lambda t: ~t.contains("=") & ~t.contains("**") & ~t.contains("^^^"))))
            .alias("n_args"),
            F.when(is_call, F.array_sort(F.array_distinct(F.transform(F.filter(toks, lambda t: t.contains("=")),
                                                                      lambda t: F.split(t, "=")[0])))).alias("kwargs"),
            F.when(is_call, F.exists(toks, lambda t: ~t.contains("=") & ~t.contains("**") & t.contains("^^^"))).alias("starargs"),
            F.when(is_call, F.exists(toks, lambda t: ~t.contains("=") & t.contains("**"))).alias("addl_kwargs"),
            F.when(is_call, has_paren).otherwise(x.rlike(IDENTIFIER)).alias("ok"),
            F.when(is_call, render_call(F.substring_index(x, "(", 1), argstr)).otherwise(x).alias("rendered"),
        )
    return F.transform(F.split(call, r"\."), item)


def access_chains(events: DataFrame, module_filter: DataFrame | None = None, rounds: int = 5) -> DataFrame:
    """Chains of each file that start with an imported name (raw
    prefix), optionally with a module filter (raw prefix), whose plain
    segments are identifiers.  -> c_pkg, c_ver, src_file, call (raw text),
    chain (rendered), items, lines.  A module filter is a table of
    (c_pkg, c_ver, module) prefixes."""
    resolved = substitute_aliases(events, rounds)
    imports = events.where(F.col("ev") == "import").select(*FILE, F.col("text").alias("_imp")).distinct()
    kept = resolved.join(imports, [resolved[c] == imports[c] for c in FILE]
                         + [resolved["call"].startswith(imports["_imp"])], "left_semi")
    if module_filter is not None:
        mf = module_filter.select("c_pkg", "c_ver", F.col("module").alias("_m")).distinct()
        kept = kept.join(mf, [kept["c_pkg"] == mf["c_pkg"], kept["c_ver"] == mf["c_ver"],
                              kept["call"].startswith(mf["_m"])], "left_semi")
    items = kept.withColumn("items", chain_items(F.col("call")))
    return (
        items.where(F.forall("items", lambda i: i["ok"]))
        .select(*FILE, "call", F.array_join(F.transform("items", lambda i: i["rendered"]), ".").alias("chain"),
                "items", "lines")
    )
