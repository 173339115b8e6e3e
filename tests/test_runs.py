"""Folders of runs, the manifest, the configuration and the embedding beyond the driver's Gram matrix."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import communities as C
from tessera.sources import runs as R


def test_state(spark, tmp_path):
    ids = spark.range(10).select(F.col("id").alias("example_id"))
    d, now = f"file://{tmp_path}", R.state(ids, 64)
    assert now["N"] == 10 and len(now["ex_hash"]) == 16 and now == R.state(ids.repartition(3), 64)
    assert R.state_valid(spark, d, now) and json.load(open(tmp_path / R.STATE)) == now
    other = R.state(spark.range(1, 11).select(F.col("id").alias("example_id")), 64)
    assert other != now and not R.state_valid(spark, d, other) and not R.state_valid(spark, d, R.state(ids, 65))
    R.write_json(spark, f"{d}/{R.MANIFEST}", {"config": 1, "extraction_state": other})
    assert R.state_valid(spark, d, other) and not R.state_valid(spark, d, now)
    R.write_state(spark, d, now)
    assert json.load(open(tmp_path / R.MANIFEST)) == {"config": 1, "extraction_state": now}
    (tmp_path / R.MANIFEST).write_text("{broken")
    os.path.exists(tmp_path / f".{R.MANIFEST}.crc") and os.remove(tmp_path / f".{R.MANIFEST}.crc")
    assert R.state_valid(spark, d, now) and not R.state_valid(spark, d, other)


def test_resolve(spark, tmp_path):
    d = f"file://{tmp_path}"
    rows = lambda n: spark.range(n).select(F.col("id").alias("row_idx"))
    first = R.resolve(spark, d, "run", 3, stamp="1")
    assert first == f"{d}/run_seed3_1" and R.progress(spark, first) == 0 and R.resolve(spark, d, "run", 3, use=False, stamp="2").endswith("run_seed3_2")
    assert R.resolve(spark, d, "run", 3) == f"{d}/run_seed3_2"
    rows(4).write.parquet(f"{first}/examples")
    assert R.progress(spark, first) == 1 and R.resolve(spark, d, "run", 3) == first
    two = f"{d}/run_seed3_2"
    rows(4).write.parquet(f"{two}/chunks/chunk_0")
    rows(3).write.parquet(f"{two}/chunks/chunk_1")
    os.remove(tmp_path / "run_seed3_2/chunks/chunk_1/_SUCCESS")
    assert R.progress(spark, two) == 4 and R.resolve(spark, d, "run", 3) == two
    assert R.compact(spark, [f"{two}/chunks/chunk_0"], f"{two}/features", 1).count() == 4 and R.progress(spark, two) == 1_000_004
    assert R.folders(spark, f"{two}/chunks") == ["chunk_1"]
    os.remove(tmp_path / "run_seed3_2/features/_SUCCESS")
    assert R.progress(spark, two) == 0 and R.resolve(spark, d, "other", 0, stamp="x").endswith("other_seed0_x")


def test_manifest_and_reread(spark, tmp_path):
    d = f"file://{tmp_path}"
    got = R.write_manifest(spark, d, {"tau": 0.01}, {"n": 20}, {"b1": spark.range(20).orderBy(F.desc("id"))})
    assert got == json.load(open(tmp_path / R.MANIFEST)) and [r["id"] for r in got["top"]["b1"]] == list(range(19, 9, -1))
    hot = R.Reread(spark)
    one = hot.json(f"{d}/{R.MANIFEST}")
    assert hot.json(f"{d}/{R.MANIFEST}") is one and hot.table(f"{d}/none") is None
    R.write_json(spark, f"{d}/{R.MANIFEST}", {"new": 1})
    os.utime(tmp_path / R.MANIFEST, (1, 1))
    assert hot.json(f"{d}/{R.MANIFEST}") == {"new": 1}
    spark.range(2).write.parquet(f"{d}/t")
    t = hot.table(f"{d}/t")
    assert t.count() == 2 and hot.table(f"{d}/t") is t
    spark.range(5).write.mode("overwrite").parquet(f"{d}/t")
    os.utime(tmp_path / "t/_SUCCESS", (2, 2))
    assert hot.table(f"{d}/t").count() == 5


def test_embedding_on_both_ways(spark):
    rng = np.random.default_rng(0)
    a = np.where(rng.random((60, 12)) < 0.5, rng.normal(size=(60, 12)), 0.0)
    cells = spark.createDataFrame([(int(i), int(j) * 3, float(a[i, j])) for i, j in zip(*np.nonzero(a), strict=True)], "row_idx long, feature int, x double")
    one, two = C.svd_embedding(cells, 4, 60), C.svd_embedding(cells, 4, 60, widest=5)
    assert list(one.index) == list(two.index) == [3 * j for j in range(12)] and one.shape == two.shape == (12, 4)
    assert np.allclose(one.to_numpy(), two.to_numpy(), atol=1e-6)
    assert np.allclose(np.linalg.norm(two.to_numpy(), axis=0), np.linalg.svd(a)[1][:4])
    assert C.svd_embedding(cells, 1, 60, widest=5).shape[0] == 12


def test_config_from_files_and_options():
    from tessera.plans.config import from_dict, parse

    cfg = from_dict({"tau": 0.05, "n_top": 50})
    assert cfg.tau == 0.05 and cfg.seed == 0
    with pytest.raises(TypeError):
        from_dict({"unknown": 1})
    for bad in ({"silent_percent": 100}, {"n_top": 0}, {"tau": -1}, {"gamma": 0}, {"min_p": 1.5}, {"svd_rank": 0}, {"min_data_cluster": 0}):
        with pytest.raises(ValueError):
            from_dict(bad)
    args, cfg = parse(["--config", "", "--set", "seed=7", "--set", "weighted=true", "--force-rerun", "--features", "f", "--examples", "e", "--out", "o"])
    assert cfg.seed == 7 and cfg.weighted is True and args.force_rerun
    with pytest.raises(SystemExit):
        parse(["--set", "nothing", "--features", "f", "--examples", "e", "--out", "o"])
