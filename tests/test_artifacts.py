"""Typed JSON artifacts, the gate decided again, and manifests against a listing."""

import pytest
from pyspark.sql import functions as F

from sightline.operators import decisions
from sightline.sources import artifacts

SCHEMA = "slice string, map double, n long, parts array<double>, one struct<x:double,y:string>, by map<string,double>"


def test_artifacts_keep_types_and_hold_no_numbers_that_json_lacks(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [("day", 0.5, 3, [1.0, nan], (inf, "a"), {"k": nan, "j": 2.0}), ("fog", nan, None, None, None, None)]
    path = str(tmp_path / "maps")
    df = spark.createDataFrame(rows, SCHEMA)
    artifacts.write_artifact(df, path)
    assert "NaN" not in "".join(p.read_text() for p in (tmp_path / "maps" / "rows").glob("part-*"))
    back = artifacts.read_artifact(spark, path, df.schema)
    assert back.dtypes == df.dtypes
    got = {r.slice: r for r in back.collect()}
    assert (got["day"].map, got["day"].n, got["day"].parts, tuple(got["day"].one), got["day"].by) == (0.5, 3, [1.0, None], (None, "a"), {"k": None, "j": 2.0})
    assert got["fog"].asDict() == {"slice": "fog", "map": None, "n": None, "parts": None, "one": None, "by": None}
    with pytest.raises(ValueError, match="instead of"):
        artifacts.read_artifact(spark, path, df.withColumn("n", F.col("n").cast("int")).schema)
    with pytest.raises(ValueError, match="exists"):
        artifacts.write_artifact(df, path)


def test_a_gate_decided_again_says_the_same(spark, tmp_path):
    deltas = spark.createDataFrame([("overall", 0.01, 0.0), ("night", 0.05, 0.01)], "slice string, delta double, ci_low double")
    base, cand = (spark.createDataFrame([("overall", m, True), ("day", m, True), ("dawn", float("nan"), True)], "slice string, map double, gated boolean") for m in (0.5, 0.51))
    stored = artifacts.write_gate(deltas, base, cand, ["night"], str(tmp_path / "gate"))
    again = artifacts.gate_again(spark, str(tmp_path / "gate"), ["night"])
    assert sorted(map(str, stored.collect())) == sorted(map(str, again.collect())) and decisions.decide(again).first().promote
    assert not decisions.decide(artifacts.gate_again(spark, str(tmp_path / "gate"), ["night", "fog"])).first().promote


def test_samples_without_a_listed_image_drop_and_bytes_are_not_read(spark, tmp_path):
    for name in ("a/1.jpg", "b/1.jpg", "b/2.png", "b/3.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    listing = artifacts.listed(spark, str(tmp_path))
    plan = listing._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    samples = spark.createDataFrame([("1", "old/1.jpg", 5), ("2", "2.png", 5), ("3", "3.txt", 5), ("4", "4.jpg", 5)], "id string, image string, name int")
    got = {r.id: r.image for r in artifacts.with_images(samples.drop("name"), listing).collect()}
    assert set(got) == {"1", "2"} and got["1"].endswith("/a/1.jpg")


def test_relative_images_are_seen_from_the_manifest(spark):
    rows = [("a.jpg",), ("./x/b.jpg",), ("/abs/c.jpg",), ("hdfs://h/d.jpg",), (None,)]
    got = artifacts.resolved(spark.createDataFrame(rows, "image string"), "/data/set/manifest.jsonl").collect()
    assert [r.image for r in got] == ["/data/set/a.jpg", "/data/set/x/b.jpg", "/abs/c.jpg", "hdfs://h/d.jpg", None]
