import json
import os

import pytest
from flowmill import cli
from flowmill.functions.plugins import Plugin, check_plugin
from flowmill.plans.engine import Engine


class Pages:
    """Numbers below 25 in pages of 4, by two tasks."""

    schema = "id long, name string"

    def partitions(self, options):
        return [0, 13]

    def fetch(self, cursor, options):
        end = 13 if cursor < 13 else 25
        rows = [{"id": i, "name": f"{options['word']}{i}"} for i in range(cursor, min(cursor + 4, end))]
        return rows, cursor + 4 if cursor + 4 < end else None


class Folder:
    def __init__(self, path, broken=False):
        self.path, self.broken = path, broken

    def prepare(self, table, mode, options):
        os.makedirs(self.path)

    def write_batch(self, table, batch, number):
        if self.broken:
            raise OSError("disk full")
        batch.to_json(f"{self.path}/{number}.json", orient="records")

    def finalize(self, table, ok):
        with open(f"{self.path}/done", "w") as f:
            f.write(f"{table} {ok}")


@pytest.mark.parametrize("broken", [False, True])
def test_pages_to_batches(spark, tmp_path, broken):
    text = 'plugin "pages" { path = "given" } plugin "folder" { path = "given" } connection "api" { driver = "python" url = "x" plugin = "pages" word = "n" } connection "out" { driver = "python" url = "x" plugin = "folder" } pipeline "p" { from { connection = connection.api table = "numbers" } to { connection = connection.out table = "t" } where { numbers.id >= 5 } }'
    engine = Engine(spark, env={}, state_dir=f"{tmp_path}/state", plugins={"pages": Pages(), "folder": Folder(f"{tmp_path}/out", broken)})
    run = engine.apply(text)
    assert run.ok is not broken and open(f"{tmp_path}/out/done").read() == f"t {not broken}"
    if not broken:
        rows = [r for name in os.listdir(f"{tmp_path}/out") if name != "done" for r in json.load(open(f"{tmp_path}/out/{name}"))]
        assert sorted((r["id"], r["name"]) for r in rows) == [(i, f"n{i}") for i in range(5, 25)]


def test_plugin_command(tmp_path, capsys):
    path = tmp_path / "double.py"
    path.write_text("from flowmill.functions.plugins import Plugin\nplugin = Plugin(lambda x: x * 2, returns='i64', inputs={'x': 'i64'})\n")
    assert cli.main(["plugin", str(path), "--input", '{"x": [1, 4]}']) == 0
    assert json.loads(capsys.readouterr().out)["result"] == [2, 8]
    assert check_plugin(Plugin(lambda x: x, "other", "number", {"y": "i64"})) == ["there is no kind other", "returns number, which is no type", "run has no argument y"]
    path.write_text("x = 1")
    assert cli.main(["plugin", str(path)]) == 2


def test_pause_and_resume(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    part = lambda name, after="": f'pipeline "{name}" {{ {after} from {{ connection = connection.lake table = "t" }} to {{ connection = connection.lake table = "{name}" }} }}'
    text = f'connection "lake" {{ driver = "parquet" url = "file://{tmp_path}" }} ' + part("a") + part("b", 'after = ["a"]')
    engine = Engine(spark, env={}, state_dir=f"{tmp_path}/state")
    engine.listeners.append(lambda event, d: engine.pause(text) if event == "pipeline_finished" and d["pipeline"] == "a" else None)
    run = engine.apply(text)
    assert [run.results[n].status for n in "ab"] == ["completed", "paused"] and not run.ok
    again = Engine(spark, env={}, state_dir=f"{tmp_path}/state").resume(text)
    assert again.ok and spark.read.parquet(f"{tmp_path}/b.parquet").count() == 3 and spark.read.parquet(f"{tmp_path}/a.parquet").count() == 3
