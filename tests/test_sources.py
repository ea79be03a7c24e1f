"""Records, sinks and the entry contract."""

import gzip
import json
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sigspark.sources import records, tables

from conftest import ROOT, TINY


def test_records_span_lines_and_keep_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b'message_id,message_body\r\n12345,"one, ""two""\nand more\n7,not a record"\r\n99999999,plain\n1234567890123,too long an id\n54321,\n')
    (tmp_path / "b.csv").write_bytes(b"")
    got = sorted((r.message_id, r.message_body) for r in records.read_records(spark, str(tmp_path)).collect())
    assert got == [(12345, 'one, "two"\nand more\n7,not a record'), (54321, ""), (99999999, "plain\n1234567890123,too long an id")]


def test_lines_are_cut_anywhere():
    import io

    data = b"".join(b"%d,body %d\n" % (10_000 + i, i) for i in range(500))
    for size in (1, 7, 64, 1 << 20):
        assert [k for k, _ in records.records(records._lines(io.BytesIO(data), size))] == list(range(10_000, 10_500))


def test_atomic_files(tmp_path):
    path = str(tmp_path / "x.json")
    tables.write_json(path, {"b": 1, "a": [2]})
    assert json.load(open(path)) == {"a": [2], "b": 1} and os.listdir(tmp_path) == ["x.json"]
    tables.write_gzip(path + ".gz", b"data")
    first = open(path + ".gz", "rb").read()
    tables.write_gzip(path + ".gz", b"data")
    assert open(path + ".gz", "rb").read() == first and gzip.decompress(first) == b"data"


def test_dynamic_overwrite_keeps_other_years(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.createDataFrame([("2020-01-01", 1), ("2021-01-01", 2)], "d string, v int").select(F.col("d").cast("date").alias("date"), "v")
    tables.write_by_year(rows, path)
    tables.write_by_year(rows.where("v = 2").withColumn("v", F.lit(3)), path)
    assert sorted((r.year, r.v) for r in tables.read_years(spark, path).collect()) == [(2020, 1), (2021, 3)]


def test_plans_push_filters_and_prune_columns(spark):
    plan = spark.read.parquet(f"{TINY}/lineitem.parquet").where("l_quantity > 49").select("l_orderkey")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,49.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_entry_has_rows(spark):
    sys.path.insert(0, ROOT)
    import __spark_entry__

    assert not __spark_entry__.entry(spark).isEmpty()
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_imports_without_the_training_data_operators(tmp_path):
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_text(open(f"{ROOT}/{name}").read())
    ignore = lambda d, names: {"llm", "__pycache__"} & set(names)
    import shutil

    shutil.copytree(f"{ROOT}/sigspark", tmp_path / "sigspark", ignore=ignore)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not any(n.startswith('op') or n == 'pipeline' for n in q); import bench"
    env = os.environ | {"PYTHONPATH": str(tmp_path), "PYTHONDONTWRITEBYTECODE": "1"}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True).stderr == ""


def test_bundles_are_checked_and_registries_complete(spark, tmp_path):
    from sigspark.plans import registry

    path = str(tmp_path / "b")
    p = spark.createDataFrame([(1, "2020-01-01", 7, 0.5, 0.1)], "code int, date string, permno long, x double, y double")
    tables.write_bundle(p, path, ["x"], ["y"])
    assert tables.load_bundle(spark, path)[1]["n"] == 1
    spark.read.parquet(f"{path}/rows").write.mode("append").parquet(f"{path}/rows")
    with pytest.raises(ValueError):
        tables.load_bundle(spark, path)
    study = registry.studies()["linear"]
    assert registry.complete([study[0]["model_id"]], study) == [s["model_id"] for s in study[1:]]
    pairs = registry.declared_contrasts(study)
    sizes = {p[1]: p[4] for p in pairs}
    # 72 against core, 24 text-and-all against all; 72 against least squares; 64 against 504 sessions
    assert sizes == {"feature": 96, "estimator": 72, "history": 64} and len(pairs) == 232
    assert ("ridge_core_raw_252-ols_core_raw_252", "estimator", "ridge_core_raw_252", "ols_core_raw_252", 72) in pairs
    with pytest.raises(ValueError):
        registry.declared_contrasts([*study, study[0]])
    with pytest.raises(ValueError):
        registry.complete(["made_up"], study)
    with pytest.raises(ValueError):
        registry.require_before("2023-01-03", "2023-01-01")
