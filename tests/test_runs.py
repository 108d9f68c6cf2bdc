"""The stages of a run, its settings, and the command line."""

import shutil

import pytest

from sightline import runs
from sightline.__main__ import main
from sightline.config import parsed, settings
from sightline.operators import average_precision, report, tide
from sightline.sources import artifacts
from tests.test_evaluation import SAMPLES, frames, random_scene

FEW = {"gate.replicates": 20, "mining.tp_sample": 5}


@pytest.fixture(scope="module")
def tables(spark):
    det, gt = random_scene(3, 40)
    d, g = frames(spark, det, gt)
    samples = spark.createDataFrame([(i, i, 400, 300, ("day", "night")[i % 2], "clear", "highway") for i in range(40)], SAMPLES)
    return runs.Tables(samples, g, d.filter("det_id % 3 > 0"), d)


def test_a_document_holds_what_its_parts_say(tables):
    t = tables
    rows = {r.slice: r for r in report.document(t.samples, t.det["candidate"], t.gt).collect()}
    assert set(rows) == {"overall", "day", "night", "clear", "highway"}
    alone = tide.summary(tide.records(t.samples, t.det["candidate"], t.gt)).first()
    assert rows["overall"].errors.asDict() == alone.asDict() and rows["clear"].errors is None
    assert rows["day"].n_images == 20 and not rows["day"].gated and rows["overall"].gated
    assert rows["overall"].n_gt == t.gt.count() == rows["day"].n_gt + rows["night"].n_gt
    for r in rows.values():
        assert r["map"] == pytest.approx(sum(c.ap for c in r.per_class) / len(r.per_class)) and [c.cls for c in r.per_class] == sorted(c.cls for c in r.per_class)
    without = report.summary(t.det["candidate"], t.gt.limit(0), average_precision.slice_membership(t.samples)).filter("slice = 'day'").first()
    assert (without["map"], without.per_class, without.n_images, without.n_gt) == (None, None, 20, 0)


def test_a_stopped_run_goes_on(spark, tables, tmp_path):
    folder = str(tmp_path / "run")
    assert runs.run(tables, folder, FEW, until="mine") == ["evaluate", "mine"]
    assert runs.run(tables, folder, FEW) == ["intervals", "gate"] and runs.run(tables, folder, FEW) == []
    checks = sorted(map(str, artifacts.read_artifact(spark, f"{folder}/gate/checks").collect()))
    assert checks == sorted(map(str, artifacts.gate_again(spark, f"{folder}/gate", ["night"]).collect())) and any("night gain" in c for c in checks)
    shutil.rmtree(f"{folder}/gate/checks")  # a gate that was stopped before its end
    assert runs.run(tables, folder, FEW) == ["gate"]
    assert sorted(map(str, artifacts.read_artifact(spark, f"{folder}/gate/checks").collect())) == checks
    with pytest.raises(ValueError, match="gate.replicates"):
        runs.run(tables, folder, FEW | {"gate.replicates": 21})
    names = runs.publish(spark, folder, str(tmp_path / "out"), {str(tmp_path): "<here>"})
    assert any(n.startswith("gate/checks/rows/") for n in names) and not any(n.startswith("mine/rows") for n in names)
    assert artifacts.read_artifact(spark, str(tmp_path / "out" / "eval" / "candidate")).count() == 5


def test_the_command_line_says_the_verdict(spark, tables, tmp_path, capsys):
    paths = {"samples": tables.samples, "gt": tables.gt, **tables.det}
    for name, df in paths.items():
        df.write.parquet(str(tmp_path / name))
    options = [x for name in paths for x in (f"--{name}", str(tmp_path / name))]
    folder = str(tmp_path / "run")
    code = main(["run", *options, "--set", "gate.replicates=20", folder])
    said = capsys.readouterr().out
    assert "done now: evaluate, mine, intervals, gate" in said and said.strip().endswith("promote" if code == 0 else "reject") and code in (0, 3)
    assert main(["gate", folder]) == code and main(["gate", "--target", "dawn", folder]) == 3
    with pytest.raises(ValueError, match="no setting"):
        main(["run", *options, "--set", "gate.replicate=20", folder])


@pytest.mark.parametrize("given,says", [
    ({"gate.replicates": 0}, "at least 1"), ({"gate.replicates": 2.5}, "is a int"), ({"gate.replicates": True}, "is a int"), ({"gate.targets": ["overall"]}, "names out of"),
    ({"gate.targets": ["night", "night"]}, "each once"), ({"gate.targets": "night"}, "is a list"), ({"gate.level": 1}, "excluded"), ({"gate": {}}, "no setting gate"), ({"evaluation.confidence": 1.5}, "between 0 and 1"),
])
def test_settings_are_strict(given, says):
    with pytest.raises(ValueError, match=says):
        settings(given)


def test_settings_have_defaults_and_come_from_text():
    assert settings(parsed(['gate.targets=["dawn"]', "evaluation.confidence=1"])) == settings() | {"gate.targets": ["dawn"], "evaluation.confidence": 1.0}
    for bad in ("gate.seed", "gate.seed=x"):
        with pytest.raises(ValueError):
            parsed([bad])
