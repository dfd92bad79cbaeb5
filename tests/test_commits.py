"""What is written once: loads that fail after a write, rows that come during a load, and databases."""

import json

import pytest
from flowmill import cli
from flowmill.lang.syntax import DocumentError
from flowmill.operators import merge
from flowmill.plans.engine import Engine
from flowmill.sources import jdbc, sinks
from flowmill.sources.registry import Connection, TableInfo, catalog_of


@pytest.fixture
def lake(spark, tmp_path):
    class Lake:
        url, state = f"file://{tmp_path}/lake", f"{tmp_path}/state"

        def put(self, table, rows, schema, mode="overwrite"):
            spark.createDataFrame(rows, schema).write.mode(mode).parquet(f"{self.url}/{table}.parquet")

        def read(self, table):
            return sorted(map(tuple, spark.read.parquet(f"{self.url}/{table}.parquet").collect()), key=str)

        def engine(self, **more):
            return Engine(spark, env={}, state_dir=self.state, **more)

        def text(self, body="", to="copy", mode=""):
            return f'connection "lake" {{ driver = "parquet" url = "{self.url}" }} pipeline "p" {{ from {{ connection = connection.lake table = "t" }} to {{ connection = connection.lake table = "{to}" {mode} }} {body} }}'

    return Lake()


RETRY = 'on_error { retry { max_attempts = 3 delay_ms = 1 } }'


def test_failure_after_the_write_repeats_nothing(lake, monkeypatch):
    lake.put("t", [(1, "a"), (2, "b"), (3, None)], "id int, name string")
    engine, calls = lake.engine(integrity_on=True), []
    good = engine.receipt

    def receipt(*args):
        calls.append(1)
        if len(calls) < 3:
            raise OSError("lost after the write")
        return good(*args)

    monkeypatch.setattr(engine, "receipt", receipt)
    check = 'validate { assert "named" { check = t.name is not null action = skip } } '
    run = engine.apply(lake.text(check + RETRY))
    assert run.ok and len(calls) == 3 and (run.results["p"].rows, run.results["p"].skipped) == (2, 1)
    assert lake.read("copy") == [(1, "a"), (2, "b")]


def test_a_later_run_goes_on_where_one_failed(lake, monkeypatch):
    lake.put("t", [(1,), (2,)], "id int")
    engine = lake.engine(integrity_on=True)
    with monkeypatch.context() as m:
        m.setattr(engine, "receipt", lambda *a: 1 / 0)
        assert engine.apply(lake.text()).results["p"].status == "failed"
    assert lake.read("copy") == [(1,), (2,)]
    again = lake.engine(integrity_on=True).apply(lake.text())
    assert again.ok and again.results["p"].rows == 2 and lake.read("copy") == [(1,), (2,)]
    assert lake.engine().verify(lake.text())["p/copy"]["status"] == "match"


def test_dead_letters_are_written_once(lake, monkeypatch):
    lake.put("t", [(1, 0), (2, 2)], "id int, n int")
    engine, real, failures = lake.engine(), sinks.write, []

    def write(connection, table, *rest):
        if table == "copy" and not failures:
            failures.append(1)
            raise OSError("no write yet")
        return real(connection, table, *rest)

    monkeypatch.setattr(sinks, "write", write)
    body = 'select { id = t.id q = 4 / t.n } on_error { retry { max_attempts = 2 delay_ms = 1 } failed_rows { table { connection = connection.lake table = "dead" } } }'
    run = engine.apply(lake.text(body))
    assert run.ok and run.results["p"].failed == 1 and run.results["p"].rows == 1 and failures
    assert len(lake.read("copy")) == 1 and len(lake.read("dead")) == 1


def test_rows_that_come_during_a_load_are_the_next_ones(lake, monkeypatch):
    lake.put("t", [(1,), (2,), (None,)], "id int")
    engine, real = lake.engine(), sinks.write

    def write(*args):
        real(*args)
        lake.put("t", [(3,), (4,), (5,)], "id int", "append")

    text = lake.text('paginate { strategy = "pk" cursor = "id" }')
    with monkeypatch.context() as m:
        m.setattr(sinks, "write", write)
        assert engine.apply(text).results["p"].rows == 3
    assert engine.apply(text).results["p"].rows == 3
    assert engine.apply(text).results["p"].rows == 0
    assert lake.read("copy") == [(1,), (2,), (3,), (4,), (5,), (None,)]


def test_time_cursor_in_a_zone(lake, spark):
    rows = "select cast(t as timestamp_ntz) at, id from values ('2024-01-01 10:00:00', 1), ('2024-01-01 11:00:00', 2) x(t, id)"
    spark.sql(rows).write.parquet(f"{lake.url}/t.parquet")
    engine, text = lake.engine(), lake.text('paginate { strategy = "timestamp" cursor = "at" tiebreaker = "id" timezone = "Europe/Berlin" }')
    assert engine.apply(text).results["p"].rows == 2
    assert engine.status(text)["cursors"]["p"] == ["2024-01-01 10:00:00", 2]
    spark.sql("select timestamp_ntz'2024-01-01 11:00:00' at, 3 id").write.mode("append").parquet(f"{lake.url}/t.parquet")
    assert engine.apply(text).results["p"].rows == 1


def test_repeated_keys_give_the_same_row_every_time(spark):
    new = [(1, "b", 2), (1, "c", 1), (1, None, 9), (None, "x", 0)]
    for rows in (new, new[::-1]):
        got = merge.latest(spark.createDataFrame(rows, "id int, name string, n int").repartition(3), ["id"]).collect()
        assert sorted(map(tuple, got), key=str) == [(1, "c", 1), (None, "x", 0)]
    by_n = merge.latest(spark.createDataFrame(new, "id int, name string, n int"), ["id"], "n").collect()
    assert sorted(map(tuple, by_n), key=str) == [(1, None, 9), (None, "x", 0)]


def test_upsert_needs_keys_and_finds_them(lake, spark, tmp_path):
    lake.put("t", [(1, "new"), (2, "new")], "id int, name string")
    lake.put("copy", [(1, "old"), (3, "old")], "id int, name string")
    text = lake.text(mode='on_conflict = "do_update"')
    with pytest.raises(DocumentError, match="keys of copy"):
        lake.engine().apply(text)
    (tmp_path / "doc.smql").write_text(text)
    (tmp_path / "catalog.json").write_text(json.dumps({"lake": {"copy": {"primary_key": "id"}}}))
    assert cli.main(["apply", str(tmp_path / "doc.smql"), "--state", lake.state, "--catalog", str(tmp_path / "catalog.json")], spark) == 0
    assert lake.read("copy") == [(1, "new"), (2, "new"), (3, "old")]
    (tmp_path / "lake" / "catalog.json").write_text(json.dumps({"copy": {"primary_key": ["id"]}}))
    lake.put("t", [(3, "newer")], "id int, name string")
    assert lake.engine().apply(text + " ").ok is True and lake.engine().build(text).steps["p"].target.catalog["copy"].primary_key == ("id",)
    with pytest.raises(DocumentError):
        catalog_of({"t": {"primary": "id"}})


def test_truncate_and_drop(lake, spark):
    lake.put("t", [(1,)], "id int")
    c = Connection(spark, "lake", {"driver": "parquet", "url": lake.url})
    sinks.truncate(c, "t")
    assert lake.read("t") == []
    sinks.drop(c, "t")
    assert not c.exists("t")
    sinks.drop(c, "t", if_exists=True)
    with pytest.raises(DocumentError):
        sinks.drop(c, "t")


def test_a_database(lake, spark):
    """The engine embedded in Spark's own jars stands for any database with a JDBC driver."""
    url = f"jdbc:derby:memory:{lake.state.replace('/', '_')}"
    given = {"driver": "jdbc", "url": url + ";create=true"}
    jdbc.execute(spark, given, [
        "create table up (a int not null, b int not null, twice generated always as (a * 2), primary key (b, a))",
        "create table t (id int not null primary key, name varchar(20) not null, a int, b int, constraint u unique (name), constraint f foreign key (b, a) references up (b, a))",
        "create index by_a on t (a)",
        "insert into t (id, name) values (1, 'old'), (2, 'stays')",
    ])
    c = Connection(spark, "db", given)
    found = c.introspected()
    t = found["T"]
    assert found["UP"].primary_key == ("B", "A") and t.primary_key == ("ID",) and found["UP"].generated == ("TWICE",) and ("NAME",) in t.unique
    assert [(k.columns, k.table, k.target) for k in t.foreign_keys] == [(("B", "A"), "UP", ("B", "A"))] and ("A",) in t.indexes.values()
    assert c.lanes("T", "ID", 2).count() == 2
    c.catalog = {"T": TableInfo(("ID",))}
    rows = spark.createDataFrame([(1, "new"), (3, "third"), (3, "again")], "ID int, NAME string")
    sinks.write(c, "T", rows, on_conflict="do_nothing")
    assert sorted((r["ID"], r["NAME"]) for r in c.read("T").collect()) == [(1, "old"), (2, "stays"), (3, "third")]
    sinks.write(c, "T", rows, on_conflict="do_update")
    assert sorted((r["ID"], r["NAME"]) for r in c.read("T").collect()) == [(1, "new"), (2, "stays"), (3, "third")]
    text = f'connection "lake" {{ driver = "parquet" url = "{lake.url}" }} connection "db" {{ driver = "jdbc" url = "{given["url"]}" }} pipeline "p" {{ from {{ connection = connection.lake table = "t" }} to {{ connection = connection.db table = "T" on_conflict = "do_update" }} before {{ sql = ["delete from t where id = 2"] }} }}'
    lake.put("t", [(9, "nine")], "ID int, NAME string")
    run = lake.engine().apply(text)
    assert run.ok, run.results
    assert sorted((r["ID"], r["NAME"]) for r in c.read("T").collect()) == [(1, "new"), (3, "third"), (9, "nine")]
    sinks.truncate(c, "T")
    assert c.read("T").count() == 0
    sinks.drop(c, "T")
    assert "T" not in c.introspected()


def test_merge_statements():
    args = ("t", "s", ["id", "a"], ["id"])
    assert jdbc.upsert_statements("postgres", *args, "do_update")[0].endswith("ON CONFLICT (id) DO UPDATE SET a = EXCLUDED.a")
    assert jdbc.upsert_statements("postgres", *args, "do_nothing")[0].endswith("DO NOTHING")
    assert jdbc.upsert_statements("mysql", *args, "do_update")[0].endswith("ON DUPLICATE KEY UPDATE a = VALUES(a)")
    assert jdbc.upsert_statements("mysql", *args, "do_nothing")[0].startswith("INSERT IGNORE")


def test_difference_by_hashes(spark):
    a = [(1, "x", None), (2, None, "x"), (3, "s", "t"), (3, "s", "t"), (None, "n", "n"), (4, "only", "here"), (6, None, "v")]
    b = [(1, "x", None), (2, "x", None), (3, "s", "t"), (None, "n", "n"), (5, "only", "there"), (6, "v", None)]
    one, two = (spark.createDataFrame(x, f"id {t}, p string, q string") for x, t in ((a, "int"), (b, "long")))
    got = sorted(map(tuple, merge.difference(one, two, ["id"]).collect()))
    assert got == [(2, "changed"), (4, "missing"), (5, "extra"), (6, "changed")]
    assert merge.difference(one, one.repartition(3), ["id"]).count() == 0


def test_keys_of_several_columns_in_a_cascade(spark):
    from flowmill.operators import cascade
    from flowmill.sources.registry import ForeignKey

    catalog = {"lines": TableInfo(("a", "b", "n"), [ForeignKey(("a", "b"), "heads", ("x", "y"))]), "heads": TableInfo(("x", "y"))}
    heads = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, None)], "x int, y int")
    lines = spark.createDataFrame([(1, 1, 0), (1, 2, 0), (2, 2, 0), (2, None, 0)], "a int, b int, n int")
    down = cascade.closure("heads", heads.where("y = 1"), {"heads": heads, "lines": lines}, catalog)
    assert sorted(map(tuple, down["lines"].collect())) == [(1, 1, 0)]
    up = cascade.closure("lines", lines.where("a = 1"), {"heads": heads, "lines": lines}, catalog)
    assert sorted(map(tuple, up["heads"].collect())) == [(1, 1), (1, 2)]


@pytest.mark.parametrize("condition", ["t.a + 1 > 2", 'lower(t.b) == "x"', "t.a == t.c", 't.a > 1 or lower(t.b) == "y"'])
def test_strict_where(lake, condition):
    lake.put("t", [(1, "x", 2), (3, "y", 3)], "a int, b string, c int")
    with pytest.raises(DocumentError, match="where takes"):
        lake.engine(strict=True).frames(lake.text(f"where {{ {condition} }}"))
    assert lake.engine(strict=True).frames(lake.text("where { (t.a > 1 and t.b is not null) or 5 < t.c }"))["p"].count() == 1
    lake.engine().frames(lake.text(f"where {{ {condition} }}"))
