"""What a plan says before it runs."""

import pytest
from flowmill.plans import report
from flowmill.plans.engine import Engine
from flowmill.sources.registry import ForeignKey, TableInfo
from flowmill.sources.types import conversion
from pyspark.sql import types as T


@pytest.fixture
def lake(spark, tmp_path):
    url = f"file://{tmp_path}/lake"
    put = lambda table, rows, schema: spark.createDataFrame(rows, schema).write.parquet(f"{url}/{table}.parquet")
    put("t", [(i, i % 7, "x") for i in range(300)], "id long, k int, name string")
    put("small", [(0, "zero")], "k int, label string")
    put("none", [], "id long")
    put("old", [(1, 1, 1)], "id int, name int, k long")

    def plan(body="", table="t", to="copy", mode="", catalog=None, more="", **given):
        text = f'connection "lake" {{ driver = "parquet" url = "{url}" }} {more} pipeline "p" {{ from {{ connection = connection.lake table = "{table}" }} to {{ connection = connection.lake table = "{to}" {mode} }} {body} }}'
        engine = Engine(spark, env={}, catalogs={"lake": catalog or {}}, state_dir=f"{tmp_path}/state", plugins=given)
        return engine.plan(text, samples=3)

    return plan


def codes(got):
    return {d["code"] for d in got["pipelines"]["p"]["diagnostics"]}


INFO = TableInfo(("id",), indexes={"by_k": ("k",)})
JOIN = "with { small from small where small.k == t.k }"


def test_source_target_and_filter(lake, monkeypatch):
    assert codes(lake()) >= {"TABLE_WILL_BE_CREATED", "FULL_SCAN", "NO_ERROR_HANDLING"}
    assert codes(lake(table="none")) >= {"EMPTY_SOURCE"}
    assert codes(lake("where { t.id < 0 }")) >= {"EMPTY_AFTER_FILTER"}
    assert codes(lake("where { t.id < 1 }")) >= {"HIGHLY_SELECTIVE_FILTER"}
    assert codes(lake('where { t.name == "x" }', catalog={"t": INFO})) >= {"UNINDEXED_FILTER"}
    assert "UNINDEXED_FILTER" not in codes(lake("where { t.k == 3 }", catalog={"t": INFO}))
    assert codes(lake(catalog={"t": TableInfo()})) >= {"NO_PRIMARY_KEY"}
    monkeypatch.setattr(report, "LIMITS", report.LIMITS | {"large_rows": 1, "page_rows": 1, "check_rows": 1, "memory_mb": 0, "latency_ms": -1, "long_s": 0})
    got = codes(lake(to="old", mode='mode = "replace"'))
    assert got >= {"DESTRUCTIVE_MODE", "LARGE_TRUNCATE", "LARGE_DATASET", "MISSING_PAGINATION", "NO_VALIDATIONS", "HIGH_MEMORY_USAGE", "HIGH_LATENCY", "LONG_MIGRATION"}
    monkeypatch.setattr(report, "LIMITS", report.LIMITS | {"very_large_rows": 1, "very_long_s": 0})
    assert codes(lake()) >= {"VERY_LARGE_DATASET", "VERY_LONG_MIGRATION"}


def test_joins(lake, monkeypatch):
    assert codes(lake(JOIN)) >= {"LOW_JOIN_MATCH_RATE", "UNKNOWN_JOIN_KEY"}
    keys = TableInfo(("label",), [ForeignKey(("k",), "t", ("k",))])
    assert codes(lake(JOIN, catalog={"small": keys})) >= {"UNINDEXED_JOIN"}
    monkeypatch.setattr(report, "LIMITS", report.LIMITS | {"large_rows": 1, "joins": 1})
    assert codes(lake(JOIN)) >= {"LARGE_LOOKUP_TABLE", "MANY_JOINS"}


def test_mapping_and_pages(lake):
    got = lake("select { twice = t.id * 2 }", to="old")
    columns = {c["name"]: c for c in got["pipelines"]["p"]["columns"]}
    assert columns["id"]["conversion"]["safe"] is False and columns["k"]["conversion"]["how"] == "implicit" if "id" in columns else columns["twice"]["kind"] == "computed"
    assert codes(lake(to="old")) >= {"UNSAFE_TYPE_CONVERSION"}
    assert codes(lake('paginate { strategy = "default" }')) >= {"OFFSET_PAGINATION"}
    assert codes(lake('paginate { strategy = "pk" cursor = "name" }', catalog={"t": INFO})) >= {"UNINDEXED_CURSOR"}
    many = " ".join(f"c{i} = t.k + {i}" for i in range(20))
    assert codes(lake("select { " + many + " }")) >= {"MANY_COMPUTED_COLUMNS"}
    assert codes(lake(mode='on_conflict = "do_update"', catalog={"copy": TableInfo()})) >= {"MISSING_CONFLICT_KEYS"}


def test_statistics_of_a_sample(lake):
    about = lake()["pipelines"]["p"]["sample_statistics"]
    assert about["rows"] == 3 and about["columns"]["name"] == {"nulls": 0, "distinct": 1, "least": "x", "greatest": "x"}


def test_what_can_not_run(lake):
    got = lake(table="nowhere")
    assert codes(got) == {"CONNECTION_FAILED"} and not got["executable"]
    assert lake()["executable"]


@pytest.mark.parametrize(
    ("have", "want", "how", "safe"),
    [
        (T.IntegerType(), T.LongType(), "implicit", True), (T.LongType(), T.ShortType(), "explicit", False), (T.DoubleType(), T.LongType(), "explicit", False),
        (T.DoubleType(), T.FloatType(), "explicit", False), (T.FloatType(), T.DoubleType(), "implicit", True), (T.DecimalType(10, 2), T.DecimalType(12, 4), "implicit", True),
        (T.DecimalType(10, 4), T.DecimalType(10, 2), "explicit", False), (T.TimestampType(), T.DateType(), "explicit", False), (T.DateType(), T.StringType(), "date_format", False),
        (T.StringType(), T.TimestampType(), "to_timestamp", True), (T.StringType(), T.BooleanType(), "explicit", True), (T.BinaryType(), T.StringType(), "decode", True), (T.ArrayType(T.LongType()), T.StringType(), "to_json", False),
    ],
)
def test_conversion(have, want, how, safe):
    got = conversion(have, want)
    assert (got["how"], got["safe"]) == (how, safe) and conversion(have, have) is None
