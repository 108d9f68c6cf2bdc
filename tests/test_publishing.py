"""Publishing a run, prompts, targets of last resort, arms and places."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sightline.functions.hashing import seeded
from sightline.functions.ordering import numbered
from sightline.operators import synthesis
from sightline.schema import PROMPT_RECIPES
from sightline.sources import files, publishing

HOME = "/srv/lab one"


def run_folder(root):
    texts = {
        "status.json": json.dumps({"pid": 12, "log": f"{HOME}/log.txt", "note": "the \"pid\": 3 in a text stays"}), "config.json": "{}\n", "secret.json": "{}",
        "eval/baseline.json": json.dumps({"model": {"name": "m", "weights": f"{HOME}/w/best.pt"}, "map": 0.25}, indent=1),
        "eval/deeper/x.json": "{}", "mine/mined.json": json.dumps({"summary": {"errors": 3}, "errors": [1, 2, 3]}), "gate/gate.json": '{"candidate": "arm b", "promote": true}',
        "report/index.md": f"# At {HOME}/r\nZürich — ok\n", "metrics.jsonl": f'{{"at": "{HOME}"}}\n{{"at": "C:\\\\x\\\\y"}}\n',
    }
    for name, text in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text, encoding="utf-8")
    for name in ("baseline/weights.pt", "retrain/arm b/weights.pt", "retrain/other/weights.pt", "analyze/thumbs/a/1.jpg", "report/fig.png"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(b"\x00\xff" + name.encode())


def test_a_run_is_published_without_the_paths_of_its_machine(spark, tmp_path):
    run, out = tmp_path / "run 1", tmp_path / "out"
    run_folder(run)
    roots = {HOME: "<workspace>", "C:\\x": "<repo>"}
    names = publishing.publish(spark, str(run), str(out), roots)
    there = sorted(os.path.relpath(os.path.join(d, f), out) for d, _, fs in os.walk(out) for f in fs if not f.endswith(".crc"))
    assert there == names == sorted([
        "status.json", "config.json", "eval/baseline.json", "mine/mined_summary.json", "gate/gate.json", "report/index.md", "metrics.jsonl",
        "weights/baseline.pt", "weights/arm b.pt", "analyze/thumbs/a/1.jpg", "report/fig.png",
    ])
    text = lambda n: (out / n).read_text(encoding="utf-8")
    assert json.loads(text("status.json")) == {"log": "<workspace>/log.txt", "note": "the \"pid\": 3 in a text stays"}
    assert json.loads(text("eval/baseline.json")) == {"model": {"name": "m", "weights": "best.pt"}, "map": 0.25}
    assert json.loads(text("mine/mined_summary.json")) == {"errors": 3}
    assert text("report/index.md") == "# At <workspace>/r\nZürich — ok\n" and text("config.json") == "{}\n"
    assert text("metrics.jsonl") == '{"at": "<workspace>"}\n{"at": "<repo>\\\\y"}\n'
    assert (out / "weights/arm b.pt").read_bytes() == b"\x00\xffretrain/arm b/weights.pt"
    assert not any(HOME in text(n) for n in names if n.endswith(publishing.TEXTS))
    with pytest.raises(ValueError, match="exists"):
        publishing.publish(spark, str(run), str(out), roots)
    (run / "status.json").unlink()
    assert "status.json" not in publishing.publish(spark, str(run), str(out), roots, replace=True) and not (out / "status.json").exists()
    assert [n for n in os.listdir(tmp_path) if n.startswith("_staged")] == []


def test_texts_of_one_name_are_refused_and_an_empty_folder_has_none(spark, tmp_path):
    with pytest.raises(Exception, match="one name"):
        publishing.write_texts(spark.createDataFrame([("a.txt", "1"), ("a.txt", "2")], "file string, text string").repartition(2), str(tmp_path / "x"))
    (tmp_path / "empty").mkdir()
    assert publishing.read_texts(spark, str(tmp_path / "empty")).count() == 0


def test_prompts_name_scene_and_condition(spark):
    rows = spark.createDataFrame([(k, c, s) for k, (c, s) in enumerate([(c, s) for c in PROMPT_RECIPES for s in ("highway", "moon", None)])], "k int, condition string, scene string")
    got = synthesis.prompts(rows, F.col("k")).collect()
    assert len(got) == 18
    for r in got:
        scene = "highway" if r.scene == "highway" else "city street"
        assert any(r.prompt == f"a realistic dashcam photo of a {scene} {x}, photorealistic, 4k, sharp focus, natural colors" for x in PROMPT_RECIPES[r.condition])
        assert r.negative_prompt.startswith("cartoon, ") and ", ," not in r.negative_prompt
    many = synthesis.prompts(spark.range(300).select("id", F.lit("night").alias("condition"), F.lit("tunnel").alias("scene")), F.col("id"))
    assert many.select("prompt").distinct().count() == 3
    with pytest.raises(Exception, match="no recipe for the condition hail"):
        synthesis.prompts(spark.createDataFrame([("hail", "x")], "condition string, scene string"), F.lit(1)).collect()


def test_violated_slices_stand_in_for_missing_targets(spark):
    violated = spark.createDataFrame([("night",), ("rainy",), ("overall",), ("snowy",), ("dawn",)], "slice string")
    none = synthesis.fallback_targets(violated).limit(0)
    got = {r.condition: r for r in synthesis.targets_or_fallback(none, violated).collect()}
    assert set(got) == {"night", "rain", "snow", "dusk"} and (got["dusk"].name, got["dusk"].classes, got["dusk"].cluster) == ("SLO slice dawn (fallback)", [2, 0], None)
    own = spark.createDataFrame([(3, "fog", [1], 4.0, "mode")], none.schema)
    assert [r.condition for r in synthesis.targets_or_fallback(own, violated).collect()] == ["fog"]


def test_an_arm_reads_its_own_rows(spark, tmp_path):
    path = str(tmp_path / "arms")
    df = spark.createDataFrame([(1, "real"), (2, "real"), (3, "augment")], "image_id int, arm string")
    schema = df.drop("arm").schema
    assert files.arm_extra(spark, path, "real", schema).count() == 0
    df.write.partitionBy("arm").parquet(path)
    assert [files.arm_extra(spark, path, a, schema).count() for a in ("real", "augment", "baseline_ft")] == [2, 1, 0] and schema.names == ["image_id"]


def test_places_follow_the_order_in_every_group(spark):
    rows = [("hot", k) for k in range(900)] + [("small", 5), (None, 1), (None, 2)]
    df = spark.createDataFrame(rows, "g string, k int").repartition(5)
    got = numbered(df, "g", seeded(1, F.col("k")), "k").withColumn("h", seeded(1, F.col("k"))).collect()
    for g in ("hot", "small", None):
        mine = sorted((r for r in got if r.g == g), key=lambda r: (r.h, r.k))
        assert [r.pos for r in mine] == list(range(len(mine))) and len(mine) == sum(x == g for x, _ in rows)
    with pytest.raises(ValueError, match="pos"):
        numbered(df.withColumn("pos", F.lit(1)), "g", "k")
