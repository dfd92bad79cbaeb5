"""Queries over the supplied tables, one for each operator, with SQL for those that SQL can express.

Most are documents of the pipeline language; the rest call operators from Python.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowmill.functions.plugins import Plugin
from flowmill.operators import cascade, integrity, merge, pages
from flowmill.plans import report
from flowmill.plans.builder import Builder, Plan
from flowmill.sources import sinks
from flowmill.sources.registry import Catalog, ForeignKey, TableInfo

Query = Callable[[SparkSession, str], DataFrame]


def _key(column: str, table: str, target: str) -> ForeignKey:
    return ForeignKey((column,), table, (target,))


#: Keys of the supplied tables; Parquet has none.
CATALOG: Catalog = {
    "region": TableInfo(("r_regionkey",)),
    "nation": TableInfo(("n_nationkey",), [_key("n_regionkey", "region", "r_regionkey")]),
    "customer": TableInfo(("c_custkey",), [_key("c_nationkey", "nation", "n_nationkey")]),
    "supplier": TableInfo(("s_suppkey",), [_key("s_nationkey", "nation", "n_nationkey")]),
    "part": TableInfo(("p_partkey",)),
    "orders": TableInfo(("o_orderkey",), [_key("o_custkey", "customer", "c_custkey")], checks=["o_totalprice >= 0"]),
    "lineitem": TableInfo((), [_key("l_orderkey", "orders", "o_orderkey"), _key("l_partkey", "part", "p_partkey"), _key("l_suppkey", "supplier", "s_suppkey")]),
    "events": TableInfo(("event_id",)),
}

PLUGINS = {
    "with_tax": Plugin(lambda price, rate: price * (1 + rate), returns="f64", inputs={"price": "f64", "rate": "f64"}),
    "grade": Plugin(lambda total: pd.cut(total, [-1e18, 50_000, 200_000, 1e18], labels=["low", "middle", "high"]).astype(object), returns="string"),
    "initials": Plugin(lambda name: name.str.slice(0, 3), returns="string"),
    "cheap": Plugin(lambda price: (price < 40_000, pd.Series(["too dear"] * len(price))), kind="filter"),
    "small": Plugin(lambda quantity: quantity < 30, kind="filter"),
    "untaxed": Plugin(lambda tax: tax < 0.05, kind="filter"),
}


def document(sf_dir: str, body: str, table: str = "orders", more: str = "") -> str:
    return f"""
    connection "lake" {{ driver = "parquet" url = "{sf_dir}" }}
    connection "out" {{ driver = "view" url = "" }}
    {more}
    pipeline "q" {{
      from {{ connection = connection.lake table = "{table}" }}
      to {{ connection = connection.out table = "q_out" }}
      {body}
    }}"""


def planned(spark: SparkSession, text: str, env: dict[str, str] | None = None) -> Plan:
    return Builder(spark, env or {}, {"lake": CATALOG}, plugins=PLUGINS).build(text)


def piped(body: str, table: str = "orders", part: str = "ok", more: str = "", env: dict[str, str] | None = None) -> Query:
    """A pipeline's rows: `ok`, `dead`, `skipped` or `warned`."""
    return lambda spark, sf: getattr(planned(spark, document(sf, body, table, more), env).outcome("q"), part)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FACT_ORDERS = """
  with {
    customer from customer where customer.c_custkey == orders.o_custkey
    nation from nation where nation.n_nationkey == customer.c_nationkey
  }
  where "open" { orders.o_totalprice > 1000 }
  select {
    order_key = orders.o_orderkey
    nation = nation.n_name
    order_year = year(orders.o_orderdate)
    tier = when { orders.o_totalprice > 200000 then "enterprise" orders.o_totalprice > 50000 then "business" else "standard" }
  }"""

CHECKS = """
  select { key = orders.o_orderkey price = orders.o_totalprice status = orders.o_orderstatus }
  validate {
    %s
  }"""

_MAYBE = "maybe = when { orders.o_orderkey < 100 then orders.o_custkey else null }"

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLE_SQL[name] = sql


# -- scans, projection, where

add("fact_orders", piped(FACT_ORDERS), "SELECT o_orderkey AS order_key, n_name AS nation, year(o_orderdate) AS order_year, CASE WHEN o_totalprice > 200000 THEN 'enterprise' WHEN o_totalprice > 50000 THEN 'business' ELSE 'standard' END AS tier FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_totalprice > 1000")
add("scan_full_copy", piped(""), "SELECT * FROM orders")
add("project_rename", piped("select { id = customer.c_custkey name = c_name }", "customer"), "SELECT c_custkey AS id, c_name AS name FROM customer")
add("multi_target_rename", piped("select { a = orders.o_orderkey b = orders.o_orderkey }"), "SELECT o_orderkey AS a, o_orderkey AS b FROM orders")
add("where_and_or", piped('where "one" { orders.o_totalprice > 100000 && orders.o_orderstatus == "F" || orders.o_orderpriority == "1-URGENT" } where { orders.o_orderkey < 5000 }'), "SELECT * FROM orders WHERE (o_totalprice > 100000 AND o_orderstatus = 'F' OR o_orderpriority = '1-URGENT') AND o_orderkey < 5000")
add("where_null", piped("where { orders.o_orderkey is not null } where { orders.o_custkey is null or orders.o_custkey > 700 }"), "SELECT * FROM orders WHERE o_orderkey IS NOT NULL AND (o_custkey IS NULL OR o_custkey > 700)")
add("where_date_literal", piped('where { orders.o_orderdate >= define.since and orders.o_orderdate < "1999-06-01" }', more='define { since = "1998-01-01" }'), "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_orderdate < TIMESTAMP '1999-06-01'")
add("where_in_parens", piped("where { (orders.o_custkey < 100 or orders.o_custkey > 1400) and (orders.o_totalprice <= 90000) }"), "SELECT * FROM orders WHERE (o_custkey < 100 OR o_custkey > 1400) AND o_totalprice <= 90000")
add("where_column_to_column", piped("where { lineitem.l_suppkey == lineitem.l_linenumber }", "lineitem"), "SELECT * FROM lineitem WHERE l_suppkey = l_linenumber")

# -- expressions

add("arith_int", piped("select { key = o_orderkey s = o_orderkey + o_custkey * 3 - 7 d = o_custkey - o_orderkey - 1 }"), "SELECT o_orderkey AS key, o_orderkey + o_custkey * 3 - 7 AS s, o_custkey - o_orderkey - 1 AS d FROM orders")
add("arith_float", piped("select { key = l_orderkey net = l_extendedprice * (1 - l_discount) q = l_quantity / 7 }", "lineitem"), "SELECT l_orderkey AS key, l_extendedprice * (1 - l_discount) AS net, l_quantity / 7 AS q FROM lineitem")
add("div_int_trunc", piped("select { key = o_orderkey q = (o_custkey - 500) / 7 }"), "SELECT o_orderkey AS key, (o_custkey - 500) // 7 AS q FROM orders")
add("div_zero_dead_letters", lambda spark, sf: piped("select { key = o_orderkey q = 1000 / (o_custkey - 5) }", part="dead")(spark, sf).select("stage", "error", F.get_json_object("original_data", "$['orders.o_orderkey']").cast("long").alias("key")), "SELECT 'transform' AS stage, 'column q can''t be computed' AS error, o_orderkey AS key FROM orders WHERE o_custkey = 5")
add("div_zero_rows_left", piped("select { key = o_orderkey q = 1000 / (o_custkey - 5) }"), "SELECT o_orderkey AS key, 1000 // (o_custkey - 5) AS q FROM orders WHERE o_custkey <> 5")
add("div_zero_float", piped("select { key = o_orderkey q = o_totalprice / (o_custkey - o_custkey) }"), "SELECT o_orderkey AS key, CASE WHEN o_totalprice = 0 THEN 'NaN'::DOUBLE ELSE 'Infinity'::DOUBLE END AS q FROM orders")
add("overflow_rows_left", piped("select { key = o_orderkey big = (o_orderkey + 1) * 9000000000000000 }"), "SELECT o_orderkey AS key, (o_orderkey + 1) * 9000000000000000 AS big FROM orders WHERE o_orderkey + 1 <= 1024")
add("eq_null_safe", piped(f"select {{ key = o_orderkey {_MAYBE} same = maybe == o_custkey none = maybe == null }}"), "SELECT o_orderkey AS key, CASE WHEN o_orderkey < 100 THEN o_custkey END AS maybe, o_orderkey < 100 AS same, o_orderkey >= 100 AS none FROM orders")
add("ne_null_safe", piped(f"select {{ key = o_orderkey {_MAYBE} other = maybe != o_custkey }}"), "SELECT o_orderkey AS key, CASE WHEN o_orderkey < 100 THEN o_custkey END AS maybe, o_orderkey >= 100 AS other FROM orders")
add("and_strict_null", piped(f"select {{ key = o_orderkey {_MAYBE} v = maybe > 10 and o_orderkey < 50 }}"), "SELECT key, maybe, CASE WHEN maybe IS NOT NULL THEN maybe > 10 AND key < 50 END AS v FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey < 100 THEN o_custkey END AS maybe FROM orders)")
add("or_strict_null", piped(f"select {{ key = o_orderkey {_MAYBE} v = maybe > 10 || o_orderkey >= 0 }}"), "SELECT key, maybe, CASE WHEN maybe IS NOT NULL THEN true END AS v FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey < 100 THEN o_custkey END AS maybe FROM orders)")
add("compare_null", piped(f"select {{ key = o_orderkey {_MAYBE} v = maybe >= 20 n = maybe is null }}"), "SELECT key, maybe, maybe >= 20 AS v, maybe IS NULL AS n FROM (SELECT o_orderkey AS key, CASE WHEN o_orderkey < 100 THEN o_custkey END AS maybe FROM orders)")
add("float_equality", piped("select { key = l_orderkey e = l_discount * 3 == l_discount + l_discount + l_discount }", "lineitem"), "SELECT l_orderkey AS key, abs(l_discount * 3 - (l_discount + l_discount + l_discount)) < 2.220446049250313e-16 AS e FROM lineitem")
add("when_tier", piped('select { key = o_orderkey tier = when { o_totalprice > 200000 then "a" o_totalprice > 50000 then "b" else "c" } }'), "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'a' WHEN o_totalprice > 50000 THEN 'b' ELSE 'c' END AS tier FROM orders")
add("when_no_else", piped('select { key = o_orderkey tier = when { o_totalprice > 200000 then "a" o_orderstatus == "F" then "f" } }'), "SELECT o_orderkey AS key, CASE WHEN o_totalprice > 200000 THEN 'a' ELSE 'f' END AS tier FROM orders WHERE o_totalprice > 200000 OR o_orderstatus = 'F'")
add("computed_chain", piped("select { key = o_orderkey a = o_custkey * 2 b = a + 1 c = when { b > 1000 then b - a else a } }"), "SELECT o_orderkey AS key, o_custkey * 2 AS a, o_custkey * 2 + 1 AS b, CASE WHEN o_custkey * 2 + 1 > 1000 THEN 1 ELSE o_custkey * 2 END AS c FROM orders")
add("fn_lower_upper_trim", piped('select { key = c_custkey l = lower(c_name) u = upper(c_mktsegment) t = trim(concat("\\t ", c_name, " ")) }', "customer"), "SELECT c_custkey AS key, lower(c_name) AS l, upper(c_mktsegment) AS u, trim(c_name) AS t FROM customer")
add("fn_lower_null", piped("select { key = o_orderkey s = when { o_orderkey < 50 then o_orderstatus else null } l = lower(s) }"), "SELECT o_orderkey AS key, o_orderstatus AS s, lower(o_orderstatus) AS l FROM orders WHERE o_orderkey < 50")
add("fn_concat", piped('select { key = c_custkey s = concat(c_name, "/", c_nationkey, "/", null, true) }', "customer"), "SELECT c_custkey AS key, c_name || '/' || c_nationkey || '/' || 'true' AS s FROM customer")
add("string_plus", piped('select { key = c_custkey s = c_name + "-" + c_mktsegment }', "customer"), "SELECT c_custkey AS key, c_name || '-' || c_mktsegment AS s FROM customer")
add("fn_coalesce", piped(f"select {{ key = o_orderkey {_MAYBE} v = coalesce(maybe, o_orderkey) }}"), "SELECT o_orderkey AS key, CASE WHEN o_orderkey < 100 THEN o_custkey END AS maybe, CASE WHEN o_orderkey < 100 THEN o_custkey ELSE o_orderkey END AS v FROM orders")
add("fn_date_parts", piped("select { key = o_orderkey d = date(o_orderdate) y = year(o_orderdate) m = month(o_orderdate) q = quarter(o_orderdate) }"), "SELECT o_orderkey AS key, o_orderdate::DATE AS d, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q FROM orders")
add("fn_env", piped('select { key = o_orderkey r = o_custkey + define.extra w = env("WHERE", "here") }', more='define { extra = env("EXTRA", 5) }', env={"EXTRA": "12"}), "SELECT o_orderkey AS key, o_custkey + 12 AS r, 'here' AS w FROM orders")
add("fn_now", lambda spark, sf: piped("select { key = o_orderkey t = now() }")(spark, sf).select("key", F.col("t").isNotNull().alias("told")), "SELECT o_orderkey AS key, true AS told FROM orders")
add("compare_dates", piped('select { key = o_orderkey late = o_orderdate >= "1999-01-01" }'), "SELECT o_orderkey AS key, o_orderdate >= TIMESTAMP '1999-01-01' AS late FROM orders")

# -- joins

add("join_single", piped("with { customer from customer where customer.c_custkey == orders.o_custkey } select { key = orders.o_orderkey who = customer.c_name }"), "SELECT o_orderkey AS key, c_name AS who FROM orders JOIN customer ON c_custkey = o_custkey")
add("join_multi", piped("with { c from customer where orders.o_custkey == c.c_custkey n from nation where c.c_nationkey == n.n_nationkey r from region where n.n_regionkey == r.r_regionkey } select { key = o_orderkey n = n.n_name r = r.r_name }"), "SELECT o_orderkey AS key, n_name AS n, r_name AS r FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON n_regionkey = r_regionkey")
add("join_fanout", piped("with { l from lineitem where l.l_orderkey == orders.o_orderkey } select { key = o_orderkey line = l.l_linenumber q = l.l_quantity }"), "SELECT o_orderkey AS key, l_linenumber AS line, l_quantity AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
add("join_no_select", piped("with { customer from customer where customer.c_custkey == orders.o_custkey }"), "SELECT orders.* FROM orders JOIN customer ON c_custkey = o_custkey")
add("join_filter_nested", piped('with { c from customer where c.c_custkey == orders.o_custkey } where { c.c_mktsegment == "BUILDING" and (orders.o_totalprice > 50000 or c.c_acctbal < 0) } select { key = o_orderkey bal = c.c_acctbal }'), "SELECT o_orderkey AS key, c_acctbal AS bal FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND (o_totalprice > 50000 OR c_acctbal < 0)")
add("key_probe_semi_join", lambda spark, sf: read(spark, sf, "customer").join(read(spark, sf, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("c_custkey")).distinct(), "c_custkey", "left_semi"), "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")

# -- validation

_BOTH = 'assert "dear" { check = price > 50000 message = "cheap" action = %s } assert "status" { check = status != "F" action = %s }'
add("validate_skip", piped(CHECKS % (_BOTH % ("skip", "skip"))), "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'F'")
add("validate_skipped_rows", piped(CHECKS % (_BOTH % ("skip", "warn")), part="skipped"), "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE NOT o_totalprice > 50000")
add("validate_warn", piped(CHECKS % 'warn "dear" { check = price > 50000 }', part="warned"), "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE NOT o_totalprice > 50000")
add("validate_default_warns", piped(CHECKS % 'assert "dear" { check = price > 50000 }'), "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders")
add("validate_fail_dead_letters", lambda spark, sf: piped(CHECKS % (_BOTH % ("fail", "skip")), part="dead")(spark, sf).select("pipeline", "stage", "error", F.get_json_object("original_data", "$['orders.o_orderkey']").cast("long").alias("key")), "SELECT 'q' AS pipeline, 'validate' AS stage, 'cheap' AS error, o_orderkey AS key FROM orders WHERE NOT o_totalprice > 50000")
add("validate_first_rule_wins", piped(CHECKS % (_BOTH % ("warn", "skip"))), "SELECT o_orderkey AS key, o_totalprice AS price, o_orderstatus AS status FROM orders WHERE NOT o_totalprice > 50000 OR o_orderstatus <> 'F'")
add("validate_null_fails", piped(f'select {{ key = o_orderkey {_MAYBE} }} validate {{ assert "m" {{ check = maybe > 20 action = skip }} }}'), "SELECT o_orderkey AS key, o_custkey AS maybe FROM orders WHERE o_orderkey < 100 AND o_custkey > 20")
add("validate_unselected_column", piped('select { key = o_orderkey } validate { assert "p" { check = orders.o_totalprice > 90000 action = skip } }'), "SELECT o_orderkey AS key FROM orders WHERE o_totalprice > 90000")

# -- sinks as frames


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal")
    return c.where("c_custkey < 500"), c.where("c_custkey >= 300 and c_custkey < 900").withColumn("c_name", F.lit("new"))


_HALVES = "old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey < 500), new AS (SELECT c_custkey, 'new' AS c_name, c_acctbal FROM customer WHERE c_custkey >= 300 AND c_custkey < 900)"
add("upsert_update", lambda spark, sf: merge.upsert(*_halves(spark, sf), ["c_custkey"]), f"WITH {_HALVES} SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)")
add("upsert_ignore", lambda spark, sf: merge.upsert(*_halves(spark, sf), ["c_custkey"], "do_nothing"), f"WITH {_HALVES} SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)")
add("append_without_key", lambda spark, sf: merge.upsert(*_halves(spark, sf), []), f"WITH {_HALVES} SELECT * FROM old UNION ALL SELECT * FROM new")
add("write_fitting_columns", lambda spark, sf: merge.fitting(read(spark, sf, "customer"), ["c_custkey", "C_NAME", "absent"]), 'SELECT c_custkey, c_name AS "C_NAME" FROM customer')
add("last_write_wins", lambda spark, sf: merge.latest(read(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id"), "SELECT user_id, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
add("verify_diff", lambda spark, sf: merge.difference(_halves(spark, sf)[0], _halves(spark, sf)[1], ["c_custkey"]), f"WITH {_HALVES} SELECT coalesce(old.c_custkey, new.c_custkey) AS c_custkey, CASE WHEN new.c_custkey IS NULL THEN 'missing' WHEN old.c_custkey IS NULL THEN 'extra' ELSE 'changed' END AS status FROM old FULL JOIN new ON old.c_custkey = new.c_custkey WHERE old.c_custkey IS NULL OR new.c_custkey IS NULL OR old.c_name <> new.c_name")


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All customers but for a segment on either side; another segment has changed."""
    c = read(spark, sf, "customer")
    changed = F.when(F.col("c_mktsegment") == "AUTOMOBILE", F.lit("new")).otherwise(F.col("c_name"))
    old, new = c.where("c_mktsegment <> 'BUILDING'"), c.where("c_mktsegment <> 'MACHINERY'")
    return old.select("c_custkey", "c_name", "c_acctbal"), new.select("c_custkey", changed.alias("c_name"), "c_acctbal")


_SIDES = "old AS (SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'), new AS (SELECT c_custkey, CASE WHEN c_mktsegment = 'AUTOMOBILE' THEN 'new' ELSE c_name END AS c_name, c_acctbal FROM customer WHERE c_mktsegment <> 'MACHINERY')"
add("upsert_update_whole", lambda spark, sf: merge.upsert(*_sides(spark, sf), ["c_custkey"]), ORACLE_SQL["upsert_update"].replace(_HALVES, _SIDES))
add("upsert_ignore_whole", lambda spark, sf: merge.upsert(*_sides(spark, sf), ["c_custkey"], "do_nothing"), ORACLE_SQL["upsert_ignore"].replace(_HALVES, _SIDES))
add("append_without_key_whole", lambda spark, sf: merge.upsert(*_sides(spark, sf), []), ORACLE_SQL["append_without_key"].replace(_HALVES, _SIDES))
add("verify_diff_whole", lambda spark, sf: merge.difference(*_sides(spark, sf), ["c_custkey"]), ORACLE_SQL["verify_diff"].replace(_HALVES, _SIDES))

# -- pages

add("offset_page", lambda spark, sf: pages.offset_page(read(spark, sf, "orders"), ["o_orderkey"], 100, 250), "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 250")
add("pk_page", lambda spark, sf: pages.page(read(spark, sf, "orders"), ["o_orderkey"], 100, [500]), "SELECT * FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100")
add("numeric_page", lambda spark, sf: pages.page(read(spark, sf, "orders"), pages.keys_of("numeric", "o_custkey", "o_orderkey"), 100, [50, 700]), "SELECT * FROM orders WHERE o_custkey > 50 OR (o_custkey = 50 AND o_orderkey > 700) ORDER BY o_custkey, o_orderkey LIMIT 100")
add("timestamp_page", lambda spark, sf: pages.page(read(spark, sf, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")), pages.keys_of("timestamp", "o_orderdate", "o_orderkey"), 100, [pd.Timestamp("1998-03-01").to_pydatetime(), 0]), "SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-03-01' OR (o_orderdate = TIMESTAMP '1998-03-01' AND o_orderkey > 0) ORDER BY o_orderdate, o_orderkey LIMIT 100")
add("keyset_page", lambda spark, sf: pages.page(read(spark, sf, "customer"), ["c_nationkey", "c_mktsegment", "c_custkey"], 50, [7, "BUILDING", 100]), "SELECT * FROM customer WHERE (c_nationkey, c_mktsegment, c_custkey) > (7, 'BUILDING', 100) ORDER BY c_nationkey, c_mktsegment, c_custkey LIMIT 50")


def _lane_counts(spark: SparkSession, sf: str) -> DataFrame:
    orders = read(spark, sf, "orders")
    lo, hi = orders.agg(F.min("o_orderkey"), F.max("o_orderkey")).first()
    ranges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pages.lanes(lo, hi, 4))], "lane int, lo long, hi long")
    hit = (F.col("o_orderkey") >= F.col("lo")) & (F.col("o_orderkey") < F.col("hi"))
    return orders.join(F.broadcast(ranges), hit).groupBy("lane").agg(F.count("*").alias("n"))  # four rows


add("lane_ranges", _lane_counts, "WITH r AS (SELECT min(o_orderkey) AS lo, max(o_orderkey) - min(o_orderkey) + 1 AS n FROM orders), k AS (SELECT o_orderkey - lo AS k, n // 4 AS each, n % 4 AS more FROM orders, r) SELECT CAST(CASE WHEN k < more * (each + 1) THEN k // (each + 1) ELSE more + (k - more * (each + 1)) // each END AS INTEGER) AS lane, count(*) AS n FROM k GROUP BY 1")
add("key_range", lambda spark, sf: read(spark, sf, "orders").agg(F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi")), "SELECT min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders")
add("row_count_filtered", lambda spark, sf: piped('where { orders.o_orderstatus == "O" }')(spark, sf).agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'")
add("sample_by_id", lambda spark, sf: pages.sample(read(spark, sf, "orders"), "by_id", key="o_orderkey", ids=[1, 5, 900, -4]), "SELECT * FROM orders WHERE o_orderkey IN (1, 5, 900, -4)")
add("sample_random", lambda spark, sf: pages.sample(read(spark, sf, "orders"), "random", 20, seed=1))
add("sample_first", lambda spark, sf: pages.sample(read(spark, sf, "orders"), "first", 20))

# -- several tables


def _fan_out(spark: SparkSession, sf: str) -> DataFrame:
    text = f"""
    connection "lake" {{ driver = "parquet" url = "{sf}" }}
    connection "out" {{ driver = "view" url = "" }}
    pipeline "all" {{
      from {{ connection = connection.lake tables = ["region", "nation", "supplier"] }}
      to {{ connection = connection.out map {{ region = "regions" }} }}
      select "nation" {{ key = nation.n_nationkey name = upper(nation.n_name) }}
    }}"""
    plan = planned(spark, text)
    out = None
    for name, step in plan.steps.items():
        df = plan.outcome(name).ok
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("pipeline"), F.lit(step.target_table).alias("table"), F.lit(len(df.columns)).alias("columns"), "n")
        out = one if out is None else out.union(one)
    return out


add("fanout_tables", _fan_out, "SELECT 'all:region' AS pipeline, 'regions' AS \"table\", 2 AS columns, count(*) AS n FROM region UNION ALL SELECT 'all:nation', 'nation', 2, count(*) FROM nation UNION ALL SELECT 'all:supplier', 'supplier', 4, count(*) FROM supplier")


def _family(options: str, table: str | None = None, root: str = "orders.o_orderkey < 40") -> Query:
    def query(spark: SparkSession, sf: str) -> DataFrame:
        text = document(sf, f"where {{ {root} }}").replace('table = "orders" }', f'table = "orders" with references {{ {options} }} }}')
        family = {("orders" if t == "q_out" else t): o.ok for t, o in planned(spark, text).family("q").items()}
        if table:
            return family[table]
        out = None
        for t, df in family.items():
            one = df.agg(F.count("*").alias("n")).select(F.lit(t).alias("table"), "n")
            out = one if out is None else out.union(one)
        return out

    return query


_CASCADE = "o AS (SELECT * FROM orders WHERE o_orderkey < 40), l AS (SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o)), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), r AS (SELECT * FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM n)), p AS (SELECT * FROM part WHERE p_partkey IN (SELECT l_partkey FROM l)), s AS (SELECT * FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM l))"
_COUNT = "SELECT '{0}' AS \"table\", count(*) AS n FROM {1}"
_counts = lambda *pairs: f"WITH {_CASCADE} " + " UNION ALL ".join(_COUNT.format(*p) for p in pairs)
add("cascade_lineitem", _family('data = "cascade"', "lineitem"), f"WITH {_CASCADE} SELECT * FROM l")
add("cascade_part", _family('data = "cascade"', "part"), f"WITH {_CASCADE} SELECT * FROM p")
add("cascade_depth", _family('data = "cascade" depth = 1'), _counts(("orders", "o"), ("lineitem", "l"), ("customer", "c")))
add("cascade_exclude", _family('data = "cascade" exclude = ["line*", "region"]'), "WITH o AS (SELECT * FROM orders WHERE o_orderkey < 40), c AS (SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM o)), n AS (SELECT * FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM c)), s AS (SELECT * FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM n)) SELECT 'orders' AS \"table\", count(*) AS n FROM o UNION ALL SELECT 'customer', count(*) FROM c UNION ALL SELECT 'nation', count(*) FROM n UNION ALL SELECT 'supplier', count(*) FROM s")
add("cascade_schema_only", _family('data = "schema_only" depth = 1'), "SELECT 'orders' AS \"table\", count(*) AS n FROM orders WHERE o_orderkey < 40 UNION ALL SELECT 'lineitem', 0 UNION ALL SELECT 'customer', 0")
_FINISHED = 'orders.o_orderstatus == "F"'
for _name, _options, _table in (("lineitem", 'data = "cascade"', "lineitem"), ("part", 'data = "cascade"', "part"), ("depth", 'data = "cascade" depth = 1', None), ("exclude", 'data = "cascade" exclude = ["line*", "region"]', None), ("schema_only", 'data = "schema_only" depth = 1', None)):
    add(f"cascade_{_name}_whole", _family(_options, _table, _FINISHED), ORACLE_SQL[f"cascade_{_name}"].replace("o_orderkey < 40", "o_orderstatus = 'F'"))
add("table_write_order", lambda spark, sf: spark.createDataFrame([(i, t) for i, t in enumerate(cascade.write_order(cascade.reachable("orders", CATALOG), CATALOG))], "place int, name string"), """
    WITH RECURSIVE edges(child, parent) AS (VALUES ('lineitem', 'orders'), ('lineitem', 'part'), ('lineitem', 'supplier'), ('orders', 'customer'), ('customer', 'nation'), ('supplier', 'nation'), ('nation', 'region')),
    depth(name, d) AS (SELECT parent, 0 FROM edges WHERE parent NOT IN (SELECT child FROM edges) UNION SELECT child, d + 1 FROM edges JOIN depth ON parent = name)
    SELECT (row_number() OVER (ORDER BY max(d), name) - 1)::int AS place, name FROM depth GROUP BY name""")

# -- reports, integrity, plugins

_RATES = CHECKS % (_BOTH % ("skip", "skip"))
add("selectivity", lambda spark, sf: (lambda p: report.selectivity(p, p.steps["q"]))(planned(spark, document(sf, 'where { orders.o_orderstatus == "O" }'))), "SELECT count(*) AS total_rows, count(*) FILTER (o_orderstatus = 'O') AS filtered_rows, count(*) FILTER (o_orderstatus = 'O') / count(*) AS selectivity FROM orders")
add("check_rates", lambda spark, sf: (lambda p: report.check_rates(p, p.steps["q"]))(planned(spark, document(sf, _RATES))), "SELECT 'dear' AS \"check\", count(*) FILTER (NOT o_totalprice > 50000) AS failed, count(*) AS sampled FROM orders UNION ALL SELECT 'status', count(*) FILTER (o_orderstatus = 'F'), count(*) FROM orders")
add("constraint_violations", lambda spark, sf: sinks.violations(read(spark, sf, "orders"), CATALOG["orders"], lambda t: read(spark, sf, t)), "SELECT 'primary_key(o_orderkey)' AS \"constraint\", (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)) AS violations UNION ALL SELECT 'foreign_key(o_custkey)', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'check(o_totalprice >= 0)', count(*) FROM orders WHERE o_totalprice < 0")
_TYPED = {"o_orderkey": "o_orderkey", "price": "cast(o_totalprice AS decimal(18, 2))", "total": "o_totalprice", "done": "o_orderstatus = 'F'", "at": "o_orderdate", "day": "cast(o_orderdate AS date)", "urgent": "CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority END"}
#: The bytes of each column's value as DuckDB writes them.
_BYTES = {"o_orderkey": "'i' || o_orderkey", "price": "'d' || rtrim(rtrim(price::varchar, '0'), '.')", "total": "'f' || total", "done": "'i' || done::int", "at": "'t' || epoch_us(\"at\")", "day": "'t' || (day - date '1970-01-01')", "urgent": "coalesce('s' || urgent, 'n')"}
_LONG = {n: f"length({x}) || ':' || {x}" for n, x in _BYTES.items()}
add(
    "row_hashes",
    lambda spark, sf: integrity.hashed(read(spark, sf, "orders").selectExpr(*[f"{e} AS {n}" for n, e in _TYPED.items()]), ["o_orderkey"]),
    f"WITH t AS (SELECT {', '.join(f'{e} AS "{n}"' for n, e in _TYPED.items())} FROM orders) SELECT {_LONG['o_orderkey']} AS row_key, sha256({' || '.join(_LONG[n] for n in sorted(_LONG))}) AS row_hash FROM t",
)
add("merkle_root", lambda spark, sf: spark.createDataFrame([(integrity.merkle_root(read(spark, sf, "orders"), ["o_orderkey"]),)], "root string"))
add("plugin_transform", piped('select { key = l_orderkey gross = plugin.with_tax({ price: lineitem.l_extendedprice, rate: lineitem.l_tax }) }', "lineitem", more='plugin "with_tax" { path = "-" }'), "SELECT l_orderkey AS key, l_extendedprice * (1 + l_tax) AS gross FROM lineitem")
add("plugin_filter", piped('select { key = l_orderkey } validate { assert "cheap" { check = plugin.cheap({ price: lineitem.l_extendedprice }) action = skip } }', "lineitem", more='plugin "cheap" { path = "-" }'), "SELECT l_orderkey AS key FROM lineitem WHERE l_extendedprice < 40000")


def _run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    outcome = planned(spark, document(sf, CHECKS % (_BOTH % ("skip", "warn")))).outcome("q")
    out = None
    for name in ("ok", "skipped", "warned", "dead"):
        one = getattr(outcome, name).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
        out = one if out is None else out.union(one)
    return out


add("run_metrics", _run_metrics, "SELECT 'ok' AS part, count(*) FILTER (o_totalprice > 50000) AS n FROM orders UNION ALL SELECT 'skipped', count(*) FILTER (NOT o_totalprice > 50000) FROM orders UNION ALL SELECT 'warned', count(*) FILTER (o_totalprice > 50000 AND o_orderstatus = 'F') FROM orders UNION ALL SELECT 'dead', 0")

# -- the published workloads' shapes

HEAVY = """
  select {
    id = orders.o_orderkey
    customer = orders.o_custkey
    net = orders.o_totalprice * 0.8
    tax = orders.o_totalprice * 0.2
    gross = net + tax
    gap = gross - orders.o_totalprice
    each = orders.o_totalprice / 12
    code = concat("O-", orders.o_orderkey, "-", orders.o_custkey)
    status = lower(orders.o_orderstatus)
    urgency = upper(trim(orders.o_orderpriority))
    day = date(orders.o_orderdate)
    y = year(orders.o_orderdate)
    m = month(orders.o_orderdate)
    q = quarter(orders.o_orderdate)
    tier = when { orders.o_totalprice > 200000 then "enterprise" orders.o_totalprice > 50000 then "business" else "standard" }
    shipped = when { orders.o_orderstatus == "F" then true else false }
    bucket = orders.o_custkey / 100
    spread = orders.o_orderkey * 3 + orders.o_custkey * 7
    big = orders.o_totalprice >= 100000 and orders.o_custkey > 10
  }"""
add("heavy_columns", piped(HEAVY), """
SELECT o_orderkey AS id, o_custkey AS customer, o_totalprice * 0.8::DOUBLE AS net, o_totalprice * 0.2::DOUBLE AS tax,
    o_totalprice * 0.8::DOUBLE + o_totalprice * 0.2::DOUBLE AS gross, o_totalprice * 0.8::DOUBLE + o_totalprice * 0.2::DOUBLE - o_totalprice AS gap,
    o_totalprice / 12 AS each, 'O-' || o_orderkey || '-' || o_custkey AS code, lower(o_orderstatus) AS status, upper(trim(o_orderpriority)) AS urgency,
    o_orderdate::DATE AS day, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q,
    CASE WHEN o_totalprice > 200000 THEN 'enterprise' WHEN o_totalprice > 50000 THEN 'business' ELSE 'standard' END AS tier,
    o_orderstatus = 'F' AS shipped, o_custkey // 100 AS bucket, o_orderkey * 3 + o_custkey * 7 AS spread, o_totalprice >= 100000 AND o_custkey > 10 AS big
FROM orders""")
add("three_plugins", piped("""
  select { key = l_orderkey gross = plugin.with_tax({ price: l_extendedprice, rate: l_tax }) grade = plugin.grade({ total: l_extendedprice }) flag = plugin.initials({ name: l_linestatus }) }""", "lineitem", more='plugin "with_tax" { path = "-" } plugin "grade" { path = "-" } plugin "initials" { path = "-" }'), "SELECT l_orderkey AS key, l_extendedprice * (1 + l_tax) AS gross, CASE WHEN l_extendedprice <= 50000 THEN 'low' WHEN l_extendedprice <= 200000 THEN 'middle' ELSE 'high' END AS grade, l_linestatus[1:3] AS flag FROM lineitem")
add("three_plugin_filters", piped("""
  select { key = l_orderkey line = l_linenumber part = l_partkey supplier = l_suppkey quantity = l_quantity price = l_extendedprice discount = l_discount tax = l_tax }
  validate { assert "a" { check = plugin.cheap({ price: l_extendedprice }) action = skip } assert "b" { check = plugin.small({ quantity: l_quantity }) action = skip } assert "c" { check = plugin.untaxed({ tax: l_tax }) action = skip } }""", "lineitem", more='plugin "cheap" { path = "-" } plugin "small" { path = "-" } plugin "untaxed" { path = "-" }'), "SELECT l_orderkey AS key, l_linenumber AS line, l_partkey AS part, l_suppkey AS supplier, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax FROM lineitem WHERE l_extendedprice < 40000 AND l_quantity < 30 AND l_tax < 0.05")
