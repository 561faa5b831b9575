"""Landing files stay small, large landing files are parsed by all cores, and the keys seen stand on disk."""

import glob

from pyspark.sql import functions as F

from pkgscope.operators import parse as P
from pkgscope.streaming import incremental as T


def test_landing_files_grow_in_number_not_in_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(T, "FILE_ROWS", 100)
    assert T.stage_files(spark.range(50), str(tmp_path / "few"), 4, "id") == 4
    assert T.stage_files(spark.range(1000), str(tmp_path / "many"), 4, "id") == 10
    assert len(glob.glob(str(tmp_path / "many" / "*.parquet"))) == 10 and spark.read.parquet(str(tmp_path / "many")).count() == 1000


def test_one_landing_file_is_parsed_by_several_tasks(spark, tmp_path, monkeypatch):
    src = spark.range(64).select(F.lit("p").alias("pkg"), F.lit("1.0").alias("ver"), F.concat(F.lit("p.m"), "id").alias("module"), F.lit("V = 1\n").alias("src"))
    T.stage_files(src.coalesce(1), str(tmp_path / "landing"), 1, "module")
    seen, parse = [], P.parse_sources
    monkeypatch.setattr(P, "parse_sources", lambda df: seen.append(df.rdd.getNumPartitions()) or parse(df))
    T.incremental_catalogue(spark, str(tmp_path / "landing"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert seen == [spark.sparkContext.defaultParallelism]
    assert spark.read.parquet(str(tmp_path / "out")).count() == 64


def test_keys_seen_stand_on_disk_and_settings_are_given_back(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", "1", "u.f", "f.py", 1, "MATCH")] * 2, "c_pkg string, u_pkg string, u_ver string, api string, src_file string, n_lines int, status string")
    before = {k: spark.conf.get(k, None) for k in T.ON_DISK}
    T.stage_files(rows, str(tmp_path / "landing"), 1, "c_pkg")
    for name, key in (("guarded", rows.columns), ("plain", None)):
        T.incremental_usage(spark, str(tmp_path / "landing"), str(tmp_path / name), str(tmp_path / f"{name}-state"), row_key=key)
        assert ("RocksDB" in (tmp_path / f"{name}-state" / "offsets" / "0").read_text()) == (key is not None)
    assert {k: spark.conf.get(k, None) for k in T.ON_DISK} == before
    assert T.usage_totals(spark, str(tmp_path / "guarded")).first().files == 1
    assert T.usage_totals(spark, str(tmp_path / "plain")).first().files == 2
