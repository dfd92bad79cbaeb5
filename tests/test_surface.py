import json

import pytest
from flowmill import cli
from flowmill.lang.syntax import DocumentError
from flowmill.plans.calibration import Calibration
from flowmill.plans.fluent import PipelineBuilder, expression

SF = "/root/testdata/sf0.001"


def test_commands(spark, tmp_path, capsys):
    doc, env = tmp_path / "d.flow", tmp_path / "env"
    env.write_text(f"# places\nexport LAKE={SF}\nOUT='file://{tmp_path}/out'\n")
    doc.write_text('define { lake = env("LAKE") } connection "lake" { driver = "parquet" url = define.lake } connection "out" { driver = "parquet" url = env("OUT") } pipeline "p" { from { connection = connection.lake table = "region" } to { connection = connection.out table = "r" } }')
    call = lambda c, *more: (cli.main([c, str(doc), "-e", str(env), "--state", f"{tmp_path}/state", *more], spark), json.loads(capsys.readouterr().out))
    assert call("ping") == (0, {"lake/region": "ok"})
    assert call("plan", "--samples", "1")[1]["pipelines"]["p"]["source"]["rows"] == 5
    code, out = call("apply", "--integrity")
    assert code == 0 and out["results"]["p"]["rows"] == 5
    assert call("verify") == (0, {"p/r": {"status": "match", "rows": 5}})
    assert call("status")[1]["pipelines"] == {"p": "completed"}
    assert call("reset")[0] == 0 and call("verify")[0] == 1
    doc.write_text("pipeline {")
    assert cli.main(["plan", str(doc)], spark) == 2


def test_fluent(spark):
    frames = {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "customer")}
    b = PipelineBuilder("orders").join("c", ("orders.o_custkey", "c.c_custkey"), "customer").where("orders.o_totalprice > 100000")
    out = b.select(key="orders.o_orderkey", who="upper(c.c_name)").check("low", "key < 500", "skip").build(frames | {"customer": frames["customer"]})
    want = frames["orders"].where("o_totalprice > 100000 and o_orderkey < 500").count()
    assert out.ok.count() == want and out.ok.columns == ["key", "who"] and out.skipped.count() > 0
    with pytest.raises(DocumentError):
        expression("1 +")
    with pytest.raises(DocumentError):
        expression("1 2")


def test_calibration(tmp_path):
    c = Calibration(f"{tmp_path}/c.json")
    c.observe("a", "b", 100, 1.0)
    c.observe("a", "b", 200, 1.0)
    c.observe("a", "b", 0, 1.0)
    assert abs(Calibration(c.path).rate("a", "b", 1.0) - 130) < 1e-9 and c.rate("x", "y", 7.0) == 7.0
