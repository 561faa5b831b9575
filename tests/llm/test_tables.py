"""Operators that join, group or search, against brute force; edge cases of all."""

import gzip
import hashlib
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pkgscope.llm import bpe, chat, langid, packing, quality, queries, secrets, simhash, token_counts, topk, warc
from tests.conftest import SF

JSON = P.path("byte_bpe_50k.json")


# --- SimHash

def plain_fingerprint(text):
    words = [w for w in re.split("[ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps):
    """id of the smallest linked row of each row, over all pairs."""
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_near_duplicates_equal_brute_force(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    fps = [plain_fingerprint(r["text"]) for r in rows]
    want = {(r["doc_id"], f"{f:016x}", rows[c]["doc_id"]) for r, f, c in zip(rows, fps, plain_components(fps))}
    assert {tuple(r) for r in queries.op2_simhash_near_dedup(spark, SF).collect()} == want


@pytest.mark.parametrize("max_bits", [0, 1, 3, 5, 7, 12])
def test_links_lose_no_pair(spark, max_bits):
    rng = np.random.default_rng(max_bits)
    centre = rng.integers(0, 2**63, 8, dtype=np.uint64)
    values = set(centre.tolist()) | {0, 2**64 - 1, 2**63}
    for _ in range(150):  # clusters around a few centres, one of them dense
        x = int(rng.choice(centre[:3]))
        for b in rng.choice(64, rng.integers(0, max_bits + 3), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    values = sorted(values)
    signed = [(v - 2**64 if v >= 2**63 else v,) for v in values]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame(signed, "fp bigint"), max_bits).collect()}
    want = {tuple(sorted((a[0], b[0]))) for i, a in enumerate(signed) for b in signed[:i] if bin((a[0] ^ b[0]) & (2**64 - 1)).count("1") <= max_bits}
    assert got == want and (want or not max_bits)


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 40)] + [(1039, 2000), (500, 2000)]
    got = dict(map(tuple, simhash.components(spark.createDataFrame(chain[::-1] + star, "a bigint, b bigint")).collect()))
    assert {v for k, v in got.items() if k <= 60} == {0} and {v for k, v in got.items() if k > 60} == {500} and len(got) == 61 + 42


def test_one_document_of_each_group_stays(odd):
    got = simhash.keep_one(odd).collect()
    texts = [r["text"] for r in got]
    assert len([t for t in texts if t and t.startswith("the cat")]) == 1
    assert [r["doc_id"] for r in got if not (r["text"] or "").split()] == [0]  # fingerprint zero: the smallest id, null last
    assert len(got) == len(set(simhash.fingerprint((t or "").encode()) for t in texts))


# --- WARC

@pytest.mark.parametrize("archive_bytes", [1 << 30, 4000])  # the second puts the longer payloads in files of their own
def test_archives_hold_every_capture(spark, tmp_path, archive_bytes):
    big = "<p>" + "x" * 1200
    rows = [(1, "http://a/ b\r\nX: y", big), (2, None, big), (3, "http://c", big + "é"), (4, "http://d", "small"), (5, "http://e", "small"), (6, "http://f", None),
            (2, None, big), (None, "http://g", big), (None, "http://h", "WARC/1.1\r\n\r\n"), (7, "http://i", "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc" * 40)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit("clash"))
    path = str(tmp_path / "w")
    warc.write_archives(pages, path, records_per_file=3 if archive_bytes > 4000 else 4, archive_bytes=archive_bytes)
    got = warc.captures_of(spark, path).collect()
    key = lambda r: (r[0] is None, r[0], r[1])
    have = sorted(((r["page_id"], r["response"]["payload_digest"], r["response"]["type"], r["refers_to"], r["response"]["payload_bytes"]) for r in got), key=key)
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = []
    for p, _, t in rows:
        again = t == big and p != 2
        want.append((p, sha(t), "revisit" if again else "response", 2 if again else None, len((t or "").encode())))
    assert have == sorted(want, key=key)
    for r in got:
        assert r["request"]["block"].startswith("GET ") and "payload-bytes" in r["metadata"]["block"] and r["n_request"] >= 1
        if r["response"]["type"] == "response":
            assert sha(r["response"]["block"]) == r["response"]["payload_digest"]


def test_broken_archives_raise():
    with pytest.raises(ValueError):
        list(warc.parse_records(b"WARC/1.1\r\nContent-Length: 10\r\n\r\nabc"))
    with pytest.raises(ValueError):
        list(warc.parse_records(b"nothing"))
    with pytest.raises(ValueError):
        list(warc.parse_records(warc.unpack(gzip.compress(b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc")[:-9])))


@pytest.mark.parametrize("step", [1, 7, 1 << 16])
def test_archives_in_chunks(step):
    record = lambda i: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % (3 * i) + b"a\r\n" * i + b"\r\n\r\n"
    plain = b"".join(map(record, range(40)))
    packed = gzip.compress(plain[:500]) + gzip.compress(plain[500:])  # a record across two members
    for data in (plain, packed):
        got = list(warc.parse_records(warc.unpack(data, step)))
        assert [b for _, b in got] == [b"a\r\n" * i for i in range(40)]
    assert [h["content-length"] for h, _ in warc.parse_records(plain)] == [str(3 * i) for i in range(40)]


def test_records_without_partners(spark):
    records = spark.createDataFrame([("r1", "response", None, None, None, 1, "d", "x"), ("q1", "request", None, "r9", None, 1, None, "GET"), ("m1", "metadata", None, "r1", None, 1, None, "a"),
                                     ("m0", "metadata", None, "r1", None, 1, None, "b")], warc.RECORD_SCHEMA)
    (r,) = warc.transactions(records).collect()
    assert r["request"] is None and r["metadata"]["record_id"] == "m0" and (r["n_request"], r["n_metadata"]) == (0, 2)


# --- chat

def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_conversations_read_back(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    want = {}
    for r in rows:
        want.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    want[-7] = [(role, r"\### Assistant: </turn> ok") for role in ("user", "assistant")]
    got = queries.op5_chat_formatting(spark, SF).collect()
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))
        assert r["formatted_chars"] == len(chat.turn_template(turns))


def test_odd_turns_round_trip(spark):
    texts = [None, "", "\\", "###", "####", " </turn>\n", "</turn", "a: b", "### user: hi </turn>\n", "\\\\### \\", "é👍" * 50]
    rows = [(1, i, ["user", "assistant", None, "a: b"][i % 4], t) for i, t in enumerate(texts)] + [(None, 0, "assistant", "x"), (None, 0, "assistant", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("conv", F.lit(1))
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df, window=2, chunk_chars=10)).collect()}
    turns = [(r[2] or "", r[3] or "") for r in rows[:-2]]
    assert got[1]["turns_sha256"] == sha("".join(f"{a}\n{b}\n" for a, b in turns)) and got[1]["n_turns"] == len(texts)
    assert got[1]["loss_sha256"] == sha("".join(t for role, t in turns if role == "assistant"))
    assert got[None]["n_turns"] == 2 and got[None]["loss_chars"] == 2


def run_template(template, turns, window):
    return list(chat.format_rows([(1, *t) for t in turns], template, window, 1 << 20))


TURNS = [("user" if i % 2 else "assistant", f"text {i % 7} " * (i % 3)) for i in range(41)]


@pytest.mark.parametrize("template", [
    lambda ts: "<s>" + "".join(f"[{r}]{t}[/]" for r, t in ts),                                                    # an opening before the first turn
    lambda ts: "".join(f"[{r}{'=' if i and ts[i - 1][0] == r else ''}]{t}" for i, (r, t) in enumerate(ts)),     # looks one turn back
    lambda ts: "".join(f"[{i}:{r}]{t}\n" for i, (r, t) in enumerate(ts))])                                        # needs whole prefixes
def test_windows_give_the_whole_rendering(template):
    for window in (2, 5, 100):
        (row,) = run_template(template, TURNS, window)
        assert row[2] == template(TURNS) and row[4] is None
        assert [row[2][s["body_start"]:s["body_end"]] for s in row[3]] == [t for _, t in TURNS]


def test_rewriting_templates_are_flagged():
    drops = lambda ts: "".join(f"[{r}]{t if r == 'user' or i == len(ts) - 1 else ''}" for i, (r, t) in enumerate(ts))
    (row,) = run_template(drops, [("user", "a"), ("assistant", "b"), ("user", "c"), ("assistant", "d")], 8)
    assert row[4] == 2 and len(row[3]) == 2


LONG = [("user" if i % 2 else "assistant", f"text {i}") for i in range(150)]


@pytest.mark.parametrize("template, at", [
    (lambda ts: "".join(f"[{r}]{t}" for r, t in ts[-100:]), 100),                                                 # keeps the last hundred turns
    (lambda ts: "".join(f"[{r}]{t if i > len(ts) - 90 else t[:4]}" for i, (r, t) in enumerate(ts)), 89),          # cuts old turns short
    (lambda ts: "".join(f"[{r}]{t}" for r, t in ts if len(ts) < 121 or r == "user"), 120)])                       # drops a role from long conversations
def test_templates_that_rewrite_long_conversations_are_flagged(template, at):
    for window in (2, 32):
        (row,) = run_template(template, LONG, window)
        assert row[4] == at and len(row[3]) == at and row[2] == template(LONG[:at])


def test_templates_that_look_far_back():
    far = lambda ts: "".join(f"[{r}]{t}{ts[i - 70][1] if i >= 70 else ''}\n" for i, (r, t) in enumerate(ts))
    (row,) = run_template(far, LONG, 32)
    assert row[2] == far(LONG) and row[4] is None and len(row[3]) == 150
    with pytest.raises(ValueError, match="declared turn-local"):
        run_template(chat.turn_local(lambda ts: "".join(f"[{i}:{r}]{t}" for i, (r, t) in enumerate(ts))), LONG, 32)


@pytest.mark.parametrize("window", [2, 5, 100])
def test_windows_of_declared_templates(window):
    looks_back = chat.turn_local(lambda ts: "<s>" + "".join(f"[{r}{'=' if i and ts[i - 1][0] == r else ''}]{t}" for i, (r, t) in enumerate(ts)))
    (row,) = run_template(looks_back, TURNS, window)
    assert row[2] == looks_back(TURNS) and row[4] is None


@pytest.mark.parametrize("template, at", [
    (lambda ts: "".join(f"[{r}]{t}" for r, t in ts[-80:]), 80),
    (lambda ts: "".join(f"[{r}]{t if i > len(ts) - 90 else t[:4]}" for i, (r, t) in enumerate(ts)), 89),
    (lambda ts: "<s>" + "".join(f"[{r}]{t}" for r, t in ts if len(ts) < 299 or r == "user"), 298),
    (lambda ts: "".join(f"[{r}]{t}" for r, t in ts), None)])
@pytest.mark.parametrize("chunk_chars", [1, 64, 1 << 20])
def test_declarations_do_not_hide_rewritten_history(template, at, chunk_chars):
    turns = [("user" if i % 2 else "assistant", f"text {i}") for i in range(300)]
    rows = [(c, *t) for c in (1, 2) for t in turns] + [(3, "user", "hello")]
    got = list(chat.format_rows(rows, chat.turn_local(template), 32, chunk_chars))
    for conv in (1, 2):
        mine = [r for r in got if r[0] == conv]
        assert [r[1] for r in mine] == list(range(len(mine))) and mine[-1][4] == at
        assert "".join(r[2] for r in mine) == template(turns[:at])
        bodies = [r[2][s["body_start"]:s["body_end"]] for r in mine for s in r[3]]
        assert bodies == [t for _, t in turns[:at]]
    assert [r[2:] for r in got if r[0] == 3][0][0] == template([("user", "hello")])


def test_conversations_beyond_the_compared_length_stream():
    turns = [(1, "user" if i % 2 else "assistant", f"text {i}") for i in range(3000)]
    got = list(chat.format_rows(turns, chat.turn_template, 4, 1 << 10, whole_chars=5000))
    assert "".join(r[2] for r in got) == chat.turn_template([t[1:] for t in turns]) and got[-1][4] is None


# --- exact top-k

def test_top_k_equals_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(i, (rng.normal(size=9) * 2).round(2).tolist(), i) for i in range(260)]
    rows[7] = (7, None, 0)
    rows[50] = (50, rows[51][1], 0)                       # ties
    rows[52] = (52, rows[51][1], 0)
    rows[60] = (60, [float("nan")] + [0.0] * 8, 0)
    rows[61] = (61, [None] + [0.0] * 8, 0)
    rows[62] = (62, [float("inf")] + [0.0] * 8, 0)
    rows[63] = (63, [1e7] * 9, 0)  # sums beyond 2**53
    rows += [(None, [1.0] * 9, 0), rows[3], (300, [1.0, 2.0], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, rank int")
    fine = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    asked = {i: v for i, v in fine if i % 10 == 0}
    want = set()
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in fine if i != q and len(w) == len(v))
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:5])}
    for block_rows, levels, blocks in ((2048, (1, 4, 16), 32), (7, (1, 2, 9), 2), (7, (1,), 1)):
        got = [tuple(r) for r in topk.top_k(df, df.filter("vec_id % 10 = 0"), 5, block_rows=block_rows, levels=levels, blocks_per_plan=blocks).collect()]
        assert set(got) == want and len(got) == len(want)


def test_bounds_hold():
    rng = np.random.default_rng(2)
    x, q = np.floor(rng.normal(size=(40, 13)) * 90), np.floor(rng.normal(size=(30, 13)) * 90)
    for a, b in zip(topk.Stats(q, (1, 3, 13)).levels, topk.Stats(x, (1, 3, 13)).levels):
        assert (a @ b.T >= q @ x.T - 1e-6).all()


# --- packing

def test_pieces_hold_every_id_once(odd):
    library = Tokenizer.from_file(JSON)
    window = 64
    pieces = packing.pack(odd, JSON, P.PATTERN, window).cache()
    rows = pieces.collect()
    ends = {}
    for r in rows:
        assert r["length"] >= 1 and r["offset"] + r["length"] <= window
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    total = sum(r["length"] for r in rows)
    assert sorted(ends) == list(range(-(-total // window)))
    for s, parts in ends.items():  # gapless from 0, full but the last
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == (window if s < max(ends) else total - window * max(ends))
    want = sorted([*library.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in odd.select("text").collect())
    stream = [i for r in packing.sequences(pieces).orderBy("sequence_id").collect() for i in r["ids"]]
    assert len(stream) == total == sum(map(len, want))
    by_place = sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))
    docs, current = [], []
    for r in by_place:
        assert r["start"] == len(current)
        current += r["ids"]
        if len(current) == r["n"]:
            docs.append(current)
            current = []
    assert sorted(docs) == want and not current


# --- all operators on empty tables and clashing names

def operators(df):
    return {
        "secrets": lambda: secrets.find_secrets(df), "redact": lambda: secrets.redact(df), "simhash": lambda: simhash.near_duplicates(df), "keep_one": lambda: simhash.keep_one(df),
        "quality": lambda: quality.quality(df), "keep_good": lambda: quality.keep_good(df), "bpe": lambda: bpe.encode(df, P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
        "langid": lambda: langid.predict(df, langid.fit(df)), "keep_known": lambda: langid.keep_known(df),
        "tokens": lambda: token_counts.token_counts(df, P.path("piece_bpe_32k.model")), "prefixes": lambda: token_counts.prefix_tables(df, P.path("piece_bpe_32k.model")),
        "pack": lambda: packing.pack(df, JSON, P.PATTERN)}


@pytest.mark.parametrize("name", operators(None))
def test_empty_and_clashing_tables(docs, clashing, odd, name):
    assert operators(docs([]))[name]().count() == 0
    rows = operators(clashing)[name]().collect()
    assert len(rows) == 2 or name in ("keep_good", "keep_known")
    n = len(operators(odd)[name]().collect())
    assert n == odd.count() or name in ("keep_one", "keep_good", "keep_known", "pack")


def test_empty_tables_of_other_kinds(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    warc.write_archives(pages, str(tmp_path / "none"))
    assert warc.captures_of(spark, str(tmp_path / "none")).count() == 0
    turns = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert chat.read_back(chat.format_conversations(turns)).count() == 0
    vectors = spark.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert topk.top_k(vectors, vectors).count() == 0


# --- pipeline

def test_pipeline_equals_its_operators_one_by_one(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in docs.collect()}
    model = langid.fit(docs)
    kept = {i: r["text"] for i, r in rows.items() if (p := model.predict((r["text"] or "").encode()))[0] != "und" and p[1] >= 0.2}
    kept = {i: t for i, t in kept.items() if not any(rule.fails(quality.Text((t or "").encode())) for rule in quality.RULES)}
    ids = sorted(kept)
    group = plain_components([plain_fingerprint(kept[i]) for i in ids])
    kept = {ids[g]: kept[ids[g]] for g in group}
    clean = {i: secrets._replace(t, secrets.Scanner().spans(t)[1], "[REDACTED]") for i, t in kept.items()}
    library = Tokenizer.from_file(JSON)
    want = {i: [*library.encode(t, add_special_tokens=False).ids, 1] for i, t in clean.items()}
    got = {}
    for r in corpus_pipeline.run(spark, SF).orderBy("doc_id", "start").collect():
        part = want[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes()) and r["start"] == got.get(r["doc_id"], 0)
        got[r["doc_id"]] = r["start"] + r["length"]
    assert got == {i: len(v) for i, v in want.items()}


def test_pipeline_gives_the_packed_sequences(spark):
    pieces = corpus_pipeline.run(spark, SF)
    rows = pieces.collect()
    assert rows and all(len(r["ids"]) == r["length"] and zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"] for r in rows)
    got = {r["sequence_id"]: r["ids"] for r in packing.sequences(pieces).collect()}
    assert sorted(got) == list(range(len(got))) and {len(v) for k, v in got.items() if k < len(got) - 1} == {2048}
    assert sum(map(len, got.values())) == sum(r["length"] for r in rows)


def test_stages_keep_the_columns(spark, docs):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, df, SF).columns == df.columns, name


def test_sql_of_registered_queries_runs():
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for sql in queries.ORACLES.values():
        assert con.execute(sql).fetchall()
