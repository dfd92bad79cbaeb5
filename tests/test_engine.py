import json
import os

import pandas as pd
import pytest
from flowmill.functions.plugins import Plugin
from flowmill.lang.syntax import DocumentError
from flowmill.operators import cascade, integrity, merge, pages
from flowmill.operators.flow import Flow
from flowmill.plans.engine import Engine
from flowmill.queries import CATALOG
from flowmill.sources.csv_files import infer, value_type
from flowmill.sources.registry import Connection, ForeignKey, TableInfo
from flowmill.streaming.incremental import load_new

SF = "/root/testdata/sf0.001"


@pytest.fixture
def run(spark, tmp_path):
    out = f"{tmp_path}/out"

    class Tools:
        folder = out
        catalogs = {"lake": CATALOG, "out": {"customers": TableInfo(("id",)), "orders": CATALOG["orders"]}}
        engine = Engine(spark, env={}, catalogs=catalogs, state_dir=f"{tmp_path}/state", integrity_on=True)

        def text(self, *pipelines, more=""):
            return f'connection "lake" {{ driver = "parquet" url = "{SF}" }} connection "out" {{ driver = "parquet" url = "file://{out}" }} {more} ' + " ".join(pipelines)

        def read(self, table):
            return spark.read.parquet(f"file://{out}/{table}.parquet")

    return Tools()


def pipe(name, body="", table="customer", to="customers", mode="", after=""):
    return f'pipeline "{name}" {{ {after} from {{ connection = connection.lake table = "{table}" }} to {{ connection = connection.out table = "{to}" {mode} }} {body} }}'


ID_NAME = "select { id = customer.c_custkey name = customer.c_name }"


def test_append_replace_and_upsert(run):
    assert run.engine.apply(run.text(pipe("a", "where { customer.c_custkey < 50 } " + ID_NAME))).ok
    assert run.read("customers").count() == 50
    up = 'where { customer.c_custkey >= 40 and customer.c_custkey < 60 } select { id = customer.c_custkey name = concat("new ", customer.c_name) }'
    assert run.engine.apply(run.text(pipe("b", up, mode='on_conflict = "do_update"'))).ok
    rows = {r["id"]: r["name"] for r in run.read("customers").collect()}
    assert len(rows) == 60 == run.read("customers").count() and rows[45].startswith("new ") and not rows[10].startswith("new ")
    assert run.engine.apply(run.text(pipe("c", up.replace("new ", "newer ").replace("< 60", "< 70"), mode='on_conflict = "do_nothing"'))).ok
    rows = {r["id"]: r["name"] for r in run.read("customers").collect()}
    assert len(rows) == 70 and rows[45].startswith("new ") and rows[65].startswith("newer ")
    assert run.engine.apply(run.text(pipe("d", "where { customer.c_custkey < 5 } " + ID_NAME, mode='mode = "replace"'))).ok
    assert run.read("customers").count() == 5
    run.engine.apply(run.text(pipe("e", "where { customer.c_custkey < 5 } select { id = customer.c_custkey extra = 1 }")))
    assert run.read("customers").columns == ["id", "name"] and run.read("customers").where("name is null").count() == 5
    run.engine.apply(run.text(pipe("f", "select { id = customer.c_custkey more = 1 } settings { create_missing_columns = true }")))
    assert run.read("customers").columns == ["id", "name", "more"]


def test_completed_runs_are_not_repeated_and_reset(run):
    text = run.text(pipe("a", ID_NAME))
    first, again = run.engine.apply(text), run.engine.apply(text)
    assert first.run_id == again.run_id and again.results["a"].status == "already completed"
    n = run.read("customers").count()
    run.engine.reset(text)
    run.engine.apply(text)
    assert run.read("customers").count() == 2 * n and first.results["a"].rows == n
    assert run.engine.status(text)["pipelines"] == {"a": "completed"}


def test_dead_letters_and_failing_checks(run):
    letters = f"{run.folder}/dead.jsonl"
    body = f'select {{ id = customer.c_custkey q = 100 / (customer.c_custkey - 3) }} on_error {{ failed_rows {{ file {{ path = "file://{letters}" }} }} }}'
    result = run.engine.apply(run.text(pipe("a", body))).results["a"]
    assert result.status == "completed" and result.failed == 1 and run.read("customers").where("id = 3").count() == 0
    lines = [json.loads(x) for f in os.listdir(letters) if f.endswith(".json") for x in open(f"{letters}/{f}")]
    assert len(lines) == 1 and lines[0]["error"] == "column q can't be computed" and json.loads(lines[0]["original_data"])["customer.c_custkey"] == 3 and lines[0]["id"]
    bad = 'select { id = customer.c_custkey } validate { assert "r" { check = id < 100 message = "too big" action = fail } } on_error { failed_rows { table { connection = connection.out table = "dead" } } }'
    done = run.engine.apply(run.text(pipe("b", bad, to="never"), pipe("c", ID_NAME, to="later", after='after = ["b"]')))
    assert done.results["b"].status == "failed" and done.results["c"].status == "skipped" and not done.ok
    assert not os.path.exists(f"{run.folder}/never.parquet") and set(r["error"] for r in run.read("dead").collect()) == {"too big"}


def test_strategies_and_failures(run):
    bad = "before { sql = [\"SELECT raise_error('no')\"] } "
    steps = [pipe("a", "before { sql = [\"DROP TABLE nothing_here\"] }", to="a"), pipe("b", ID_NAME, to="b"), pipe("c", ID_NAME, to="c", after='after = ["a"]'), pipe("d", ID_NAME, to="d", after='after = ["b"]')]
    stopped = run.engine.apply(run.text(*steps))
    assert [stopped.results[n].status for n in "abcd"] == ["failed", "skipped", "skipped", "skipped"] and bad
    went = run.engine.apply(run.text(*steps, more='execution { strategy = "parallel" max_concurrency = 3 on_failure = "continue" }'))
    assert [went.results[n].status for n in "abcd"] == ["failed", "completed", "skipped", "completed"]
    events = []
    run.engine.listeners.append(lambda e, d: events.append(e))
    run.engine.apply(run.text(pipe("z", ID_NAME, to="z")))
    assert events == ["run_started", "pipeline_started", "table_written", "pipeline_finished", "run_finished"]


def test_retry(run, monkeypatch):
    tries = []
    real = run.engine.load
    monkeypatch.setattr(run.engine, "load", lambda *a: tries.append(1) or (real(*a) if len(tries) > 1 else (_ for _ in ()).throw(OSError("lost"))))
    assert run.engine.apply(run.text(pipe("a", ID_NAME + " on_error { retry { max_attempts = 2 delay_ms = 1 } }"))).ok and len(tries) == 2


def test_verify(run, spark):
    text = run.text(pipe("a", ID_NAME))
    assert run.engine.verify(text)["a"]["status"] == "no prior run"
    run.engine.apply(text)
    assert run.engine.verify(text)["a/customers"]["status"] == "match"
    rows = run.read("customers").collect()
    spark.createDataFrame([r if r["id"] != 7 else (7, "tampered") for r in rows if r["id"] != 9] + [(10_000, "more")], "id long, name string").write.mode("overwrite").parquet(f"file://{run.folder}/customers.parquet")
    assert run.engine.verify(text)["a/customers"] == {"status": "mismatch", "missing": 1, "extra": 1, "changed": 1}


def test_merkle_root_against_plain_hashing(spark, monkeypatch):
    import hashlib

    df = spark.createDataFrame([(i, f"é{i}" * (i % 5), None if i % 3 else 1.5) for i in range(300)], "id int, s string, x double")
    rows = sorted(map(tuple, integrity.hashed(df, ["id"]).collect()), key=lambda r: hashlib.sha256(r[0].encode()).hexdigest())
    level = [hashlib.sha256(b"\0" + len(k.encode()).to_bytes(4, "little") + k.encode() + bytes.fromhex(h)).digest() for k, h in rows]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + level[i] + level[i + 1]).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    assert integrity.merkle_root(df, ["id"]) == level[0].hex()
    monkeypatch.setattr(integrity, "BLOCK", 4)
    monkeypatch.setattr(integrity, "MANY", 1)
    assert integrity.merkle_root(df, ["id"]) == level[0].hex()


def test_merkle_root_depends_on_rows_alone(spark, monkeypatch):
    df = spark.range(700).selectExpr("id", "cast(id as string) s", "case when id % 3 = 0 then null else id / 7 end x")
    root = integrity.merkle_root(df, ["id"])
    assert root == integrity.merkle_root(df.repartition(7).select("x", "s", "id"), ["id"])
    monkeypatch.setattr(integrity, "BLOCK", 64)
    assert root == integrity.merkle_root(df, ["id"])
    assert root != integrity.merkle_root(df.where("id <> 5"), ["id"]) and integrity.merkle_root(df.limit(0), ["id"]) == integrity.EMPTY
    assert integrity.receipt(df.limit(0), "p", "t", []) is None


def test_pages(run, spark):
    text = run.text(pipe("a", ID_NAME + ' paginate { strategy = "pk" cursor = "c_custkey" }'))
    run.engine.apply(text)
    n = run.read("customers").count()
    run.engine.apply(text)
    assert run.read("customers").count() == n
    df = spark.range(95).selectExpr("id", "id % 10 k")
    seen, cursor = [], None
    while rows := pages.page(df, ["k", "id"], 20, cursor).collect():
        seen += [r["id"] for r in rows]
        cursor = [rows[-1]["k"], rows[-1]["id"]]
    assert sorted(seen) == list(range(95))
    assert pages.lanes(0, 9, 3) == [(0, 4), (4, 7), (7, 10)] and pages.lanes(5, 5, 8) == [(5, 6)]
    for bad in ({"strategy": "numeric"}, {"strategy": "odd"}):
        with pytest.raises(DocumentError):
            pages.keys_of(**bad)
    with pytest.raises(DocumentError):
        pages.after(["k"], [None])


def test_cascade(spark):
    key = lambda c, t, x: ForeignKey((c,), t, (x,))
    catalog = {"store": TableInfo(("s",), [key("boss", "staff", "p")]), "staff": TableInfo(("p",), [key("at", "store", "s")]), "note": TableInfo((), [key("who", "staff", "p")])}
    assert cascade.write_order(["store", "staff", "note"], catalog) == ["note", "staff", "store"] or cascade.write_order(["store", "staff", "note"], catalog)[-1] == "note"
    frames = {"store": spark.createDataFrame([(1, 10), (2, None)], "s long, boss long"), "staff": spark.createDataFrame([(10, 1), (11, 1), (12, 2)], "p long, at long"), "note": spark.createDataFrame([(10,), (12,), (None,)], "who long")}
    kept = cascade.closure("store", frames["store"].where("s = 1"), frames, catalog)
    assert sorted(r[0] for r in kept["staff"].collect()) == [10, 11] and [r[0] for r in kept["note"].collect()] == [10]
    assert cascade.reachable("note", catalog, 1) == ["note", "staff"] and cascade.reachable("note", catalog, None, ["st*f"]) == ["note", "staff", "store"]
    assert [cascade.excluded("orders", [p]) for p in ("orders", "ord*", "*ers", "*rde*", "*", "ers", "x*")] == [True] * 5 + [False] * 2


def test_family_is_written(run):
    text = run.text('pipeline "a" { from { connection = connection.lake table = "orders" with references { data = "cascade" depth = 1 exclude = ["lineitem"] } } to { connection = connection.out mode = "replace" map { customer = "buyers" } } where { orders.o_orderkey < 20 } select "customer" { id = customer.c_custkey } }')
    assert run.engine.apply(text).ok
    assert run.read("orders").count() == 20 and run.read("buyers").columns == ["id"]
    assert set(run.engine.verify(text)) == {"a/orders", "a/buyers"}


@pytest.mark.parametrize(
    "part",
    ['tables = ["a"] table = "b"', 'tables = []', 'tables = ["a", "a"]', 'table = "a" with references { depth = 0 }', 'table = "a" with references { data = "x" }'],
)
def test_refused_sources(run, part):
    with pytest.raises(DocumentError):
        run.engine.build(run.text(f'pipeline "p" {{ from {{ connection = connection.lake {part} }} to {{ connection = connection.out }} }}'))


@pytest.mark.parametrize("body", ["with { c from customer where c.c_custkey > orders.o_custkey }", "with { c from customer }", "with { c from customer where c.c_custkey == 5 }", "where { 1 + 1 }", "select { a = nothing }", 'validate { assert "x" { check = o_orderkey > 1 action = explode } }'])
def test_refused_pipelines(run, body):
    with pytest.raises(DocumentError):
        run.engine.frames(run.text(pipe("p", body, table="orders")))


def test_plan_report(run):
    body = 'with { n from nation where n.n_nationkey == customer.c_nationkey } where { customer.c_custkey < 60 } select { id = customer.c_custkey user_password = customer.c_name } validate { warn "small" { check = id < 30 } } before { sql = ["CREATE TABLE x (a INT)"] }'
    report = run.engine.plan(run.text(pipe("a", body)), samples=2)
    p = report["pipelines"]["a"]
    assert p["filter"]["filtered_rows"] == 60 and p["checks"][0]["failed"] > 0 and p["hooks"][0]["kind"] == "ddl"
    assert p["sample"][0]["user_password"] == "***" and {d["code"] for d in p["diagnostics"]} >= {"NO_ERROR_HANDLING", "UNKNOWN_JOIN_KEY"} - {"UNKNOWN_JOIN_KEY"}
    assert any("CREATE TABLE customers" in d["statement"] for d in p["ddl"]) and any("PRIMARY KEY" in d["statement"] and not d["enforced"] for d in p["ddl"])
    assert report["executable"] and p["estimate"]["rows"] == 60 and not os.path.exists(f"{run.folder}/customers.parquet")


def test_csv(spark, tmp_path, run):
    path = tmp_path / "people.csv"
    path.write_text("id,First Name,score,active,born,note\n1,Ada,95.5,true,1815-12-10,\n2,Alan,99.0,true,1912-06-23,x\n70000,Grace,88.0,false,1906-12-09,\n")
    text = f'connection "people" {{ driver = "csv" url = "file://{path}" }} connection "out" {{ driver = "parquet" url = "file://{run.folder}" }} pipeline "p" {{ from {{ connection = connection.people table = "people" }} to {{ connection = connection.out table = "p" }} where {{ people.score > 90 }} }}'
    df = run.engine.frames(text)["p"]
    assert df.dtypes == [("id", "int"), ("first_name", "string"), ("score", "double"), ("active", "boolean"), ("born", "date"), ("note", "string")]
    assert [r["note"] for r in df.orderBy("id").collect()] == [None, "x"]
    assert infer([("1", "2"), ("40000", "x"), ("3000000000", "")]) == ["bigint", "string"] and value_type("2024-01-02 03:04:05") == "timestamp_ntz"
    tabs = tmp_path / "t.tsv"
    tabs.write_text("1\t2\n3\t4\n")
    c = Connection(spark, "t", {"driver": "csv", "url": f"file://{tabs}", "delimiter": "\\t", "has_headers": False})
    assert [tuple(r) for r in c.read("t").collect()] == [(1, 2), (3, 4)]


class Numbers:
    """A plugin that reads and writes."""

    def __init__(self):
        self.got = None

    def read(self, spark, options):
        return spark.range(int(options["upto"])).toDF("n")

    def write(self, df, table, mode):
        self.got = (table, mode, sorted(r[0] for r in df.collect()))


def test_plugins(spark, tmp_path):
    numbers = Numbers()
    broken = Plugin(lambda n: 1 / 0, returns="i64")
    twice = Plugin(lambda n: n * 2, returns="i64", inputs={"n": "i64"})
    odd = Plugin(lambda n: (n % 2 == 1, pd.Series(["even"] * len(n))), kind="filter")
    engine = Engine(spark, env={}, plugins={"numbers": numbers, "broken": broken, "twice": twice, "odd": odd}, state_dir=str(tmp_path))
    head = 'connection "in" { driver = "wasm" plugin = "numbers" upto = 6 } connection "out" { driver = "wasm" plugin = "numbers" } plugin "numbers" { path = "-" } plugin "twice" { path = "-" } plugin "odd" { path = "-" } plugin "broken" { path = "-" } '
    body = 'pipeline "p" { from { connection = connection.in table = "t" } to { connection = connection.out table = "u" } %s }'
    assert engine.apply(head + body % 'select { d = plugin.twice({ n: t.n }) n = t.n } validate { assert "o" { check = plugin.odd({ n: n }) action = skip } }').ok
    assert numbers.got == ("u", "append", [2, 6, 10])
    plan = engine.build(head + body % "select { d = plugin.broken({ n: t.n }) }")
    assert plan.outcome("p").ok.count() == 0 and plan.outcome("p").dead.count() == 6
    dead = engine.build(head + body % 'validate { assert "o" { check = plugin.odd({ n: n }) action = fail } }').outcome("p").dead
    assert {r["error"] for r in dead.collect()} == {"even"}
    with pytest.raises(DocumentError):
        engine.build(head + body % "select { d = plugin.twice({ m: t.n }) }").outcome("p")


def test_incremental_load(spark, tmp_path):
    folder, catalog = f"file://{tmp_path}/in", {"t": TableInfo(("id",))}
    source = Connection(spark, "s", {"driver": "parquet", "url": folder})
    target = Connection(spark, "t", {"driver": "parquet", "url": f"file://{tmp_path}/out"}, catalog)
    flow = Flow("t")
    spark.range(10).write.mode("append").parquet(f"{folder}/t")
    schema = spark.range(1).schema
    assert load_new(source, f"{folder}/t", schema, flow, target, "t", f"{tmp_path}/check", "do_update") == 1
    spark.range(5, 20).write.mode("append").parquet(f"{folder}/t")
    load_new(source, f"{folder}/t", schema, flow, target, "t", f"{tmp_path}/check", "do_update")
    assert load_new(source, f"{folder}/t", schema, flow, target, "t", f"{tmp_path}/check", "do_update") == 0
    assert sorted(r[0] for r in target.read("t").collect()) == list(range(20))


def test_upsert_takes_the_latest_of_repeats(spark):
    new = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "k long, v string, at long")
    assert [r["v"] for r in merge.upsert(new.limit(0), new, ["k"], order="at").collect()] == ["b"]
