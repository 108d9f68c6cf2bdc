"""Manifests, nested records, predictions and splits as files."""

import json

import pytest

from sightline.operators import decisions
from sightline.sources import files, tables


def line(k, **more):
    return json.dumps({"id": f"{k}", "image": f"{k}.jpg", "width": 10, "height": 10, "boxes": [{"cls": 1, "x1": 0.5, "y1": 1, "x2": 3, "y2": 4, "occluded": False, "truncated": True}], "attrs": {"weather": "clear"}} | more)


def test_a_manifest_reads_back_and_names_its_bad_line(spark, tmp_path):
    good, bad = tmp_path / "good.jsonl", tmp_path / "bad.jsonl"
    good.write_text("\n".join([line(1), "", "  ", line(2)]) + "\n")
    rows = files.read_manifest(spark, str(good))
    assert [(r.id, r.boxes[0].x1, r.attrs["weather"]) for r in rows.orderBy("id").collect()] == [("1", 0.5, "clear"), ("2", 0.5, "clear")]
    assert files.write_manifest(rows, str(tmp_path / "out")) == 2
    again = files.read_manifest(spark, str(tmp_path / "out"))
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.collect()))
    bad.write_text("\n".join([line(1), "", line(2), '{"id": "3", "width": ', line(4)]))
    with pytest.raises(ValueError, match="bad.jsonl, line 4"):
        files.read_manifest(spark, str(bad))


def test_nested_records_become_samples(spark, tmp_path):
    box = lambda label, *b: {"label": label, "bounding_box": list(b)}
    record = {
        "filepath": "a/b/abc-1.jpg", "metadata": {"width": 100, "height": 50}, "timeofday": {"label": "dawn/dusk"}, "weather": {"label": "partly cloudy"},
        "detections": {"detections": [box("other person", 0.1, 0.1, 0.5, 0.5), box("motorcycle", 0.9, 0.5, 0.5, 0.9), box("car", 0.1, 0.1, 0.039, 0.5), box("train", 0, 0, 1, 1)]},
    }
    path = tmp_path / "records.json"
    path.write_text(json.dumps({"samples": [record, {"filepath": "x.png"}]}, indent=1))
    got = {r.id: r for r in files.read_records(spark, str(path), "root/").collect()}
    assert [(b.cls, b.x1, b.y1, b.x2, b.y2) for b in got["abc-1"].boxes] == [(0, 10.0, 5.0, 60.0, 30.0), (5, 90.0, 25.0, 100.0, 50.0)]
    assert got["abc-1"].attrs == {"timeofday": "dawn", "weather": "partly_cloudy", "scene": "undefined", "source": "real"} and got["abc-1"].image == "root/abc-1.jpg"
    assert (got["x"].width, got["x"].height, got["x"].boxes, got["x"].attrs["timeofday"]) == (1280, 720, [], "undefined")


def test_predictions_of_other_models_stay(spark, tmp_path):
    path = str(tmp_path / "p")
    for model, n in (("a", 2), ("b", 3), ("a", 4)):
        files.write_predictions(spark.range(n).withColumnRenamed("id", "image_id"), model, path)
    assert files.read_predictions(spark, path, "a").count() == 4 and files.read_predictions(spark, path, "b").count() == 3


def test_pairs_need_the_same_images_and_headlines_name_slices_once(spark):
    a, b = (spark.range(n).withColumnRenamed("id", "image_id") for n in (3, 4))
    decisions.require_same_images(a, a)
    with pytest.raises(ValueError, match="image 3"):
        decisions.require_same_images(a, b)
    maps = spark.createDataFrame([("night", 0.5), ("overall", 0.25), ("fog", 1.0)], "slice string, map double")
    assert decisions.headline(maps, ["overall", "night", "overall", "snowy"]).collect() == [(0.25, 0.5, None)]


def test_views_read_small_splits_unless_a_size_is_set(spark):
    name = "spark.sql.files.maxPartitionBytes"
    spark.conf.unset(name)
    tables.Views(spark, "/root/testdata/sf0.001")
    assert int(spark.conf.get(name)) == tables.SPLIT
    spark.conf.set(name, "5000000")
    tables.Views(spark, "/root/testdata/sf0.001")
    try:
        assert spark.conf.get(name) == "5000000"
    finally:
        spark.conf.unset(name)
