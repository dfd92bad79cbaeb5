import pytest
from flowmill.plans.builder import Settings
from flowmill.sources import sinks
from flowmill.sources.registry import ForeignKey, TableInfo
from flowmill.sources.types import coerced, spark_type
from pyspark.sql import functions as F
from pyspark.sql import types as T


@pytest.mark.parametrize(
    ("declared", "simple", "fidelity"),
    [
        ("INT", "int", "lossless"), ("int(10) unsigned", "bigint", "equivalent"), ("BIGINT UNSIGNED", "decimal(20,0)", "equivalent"), ("tinyint(1)", "boolean", "equivalent"), ("tinyint(4)", "tinyint", "lossless"),
        ("decimal(12,2)", "decimal(12,2)", "lossless"), ("numeric", "decimal(38,18)", "lossy"), ("decimal(60,4)", "decimal(38,4)", "lossy"), ("varchar(20)", "string", "lossless"), ("timestamp with time zone", "timestamp", "lossless"),
        ("timestamp(3)", "timestamp_ntz", "lossless"), ("datetime", "timestamp_ntz", "lossless"), ("uuid", "string", "equivalent"), ("integer[]", "array<int>", "lossless"), ("enum('a','b')", "string", "equivalent"), ("tsvector", "string", "best effort"),
    ],
)
def test_types(declared, simple, fidelity):
    got = spark_type(declared)
    assert got.dtype.simpleString() == simple and got.fidelity == fidelity


def test_coercion(spark):
    df = spark.createDataFrame([("yes", "12.9", 3.7), ("OFF", "x", -3.7), ("maybe", None, None)], "b string, n string, x double")
    rows = df.select(coerced(F.col("b"), T.StringType(), T.BooleanType()), coerced(F.col("n"), T.StringType(), T.LongType()), coerced(F.col("x"), T.DoubleType(), T.IntegerType())).collect()
    assert [tuple(r) for r in rows] == [(True, 12, 3), (False, None, -3), (None, None, None)]


def test_ddl_order_and_switches():
    schema = T.StructType([T.StructField(n, T.LongType()) for n in ("id", "ref", "kind")])
    info = TableInfo(("id",), [ForeignKey(("ref",), "other", ("id",)), ForeignKey(("gone",), "other", ("id",))], unique=[("ref",)], checks=["id > 0"], indexes={"i": ("kind",)}, sequences=("id",), enums={"kind": ("a", "b")})
    words = lambda **s: [" ".join(x["statement"].split()[:2] + [w for w in ("ENUM", "PRIMARY", "FOREIGN", "UNIQUE", "CHECK") if w in x["statement"]]) for x in sinks.ddl("t", schema, info, Settings(**s), {"other": "o2"})]
    assert words() == ["CREATE TYPE ENUM", "CREATE TABLE", "CREATE SEQUENCE", "ALTER TABLE PRIMARY", "CREATE INDEX", "ALTER TABLE FOREIGN", "ALTER TABLE UNIQUE", "ALTER TABLE CHECK"]
    assert words(skip_pk=True, skip_fk=True, skip_idx=True, skip_seq=True, skip_unique=True, skip_check=True) == ["CREATE TYPE ENUM", "CREATE TABLE"]
    assert any("REFERENCES o2" in x["statement"] for x in sinks.ddl("t", schema, info, Settings(), {"other": "o2"}))
    assert [x["statement"] for x in sinks.ddl("t", schema, info, Settings(), existing=["id", "ref"])] == ["ALTER TABLE t ADD COLUMNS (kind BIGINT)"]


def test_csv_json_and_booleans(spark, tmp_path):
    from flowmill.sources import csv_files

    (tmp_path / "t.csv").write_text('id,flag,bit,doc,mixed\n1,true,0,"{""b"": 1, ""a"": [2]}",1\n2,0,1,5,x\n3,1,1,"[1]","{""a"": 1}"\n')
    got = csv_files.read(spark, {"url": f"file://{tmp_path}/t.csv"})
    assert [t for _, t in got.dtypes] == ["smallint", "boolean", "smallint", "string", "string"]
    rows = [tuple(r) for r in got.orderBy("id").collect()]
    assert rows == [(1, True, 0, '{"a":[2],"b":1}', "1"), (2, False, 1, "5", "x"), (3, True, 1, "[1]", '{"a": 1}')]
    assert csv_files.infer([("{bad", "true"), ("5", "7")]) == ["string", "string"]
