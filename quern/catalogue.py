"""One query for each operator over the driver's tables, and the SQL that states its result.

QUERIES maps a name to (spark, folder) -> DataFrame; ORACLE_SQL to DuckDB SQL
over the same tables.  Every query runs over whole tables; a limit is only where
a page is the feature.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .database import Database
from .functions.jsonschema import valid
from .functions.paths import Resolver
from .operators import fold, joins, metrics
from .operators.projection import iso, shape
from .plans.planner import query, selected, together
from .plans.spec import read
from .sources.catalog import tables
from .sources.log import BEGIN, COMMIT, DELETE, DROP, EXPIRY, INSERT
from .streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
K = "CAST({0} AS VARCHAR) AS _key, CAST(1 AS BIGINT) AS _v"


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def ask(name: str, body: dict, sql: str, flat: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A read request over the tables as collections; ``flat`` takes structs apart for the comparison."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(tables(spark, folder), body)
        return flat(df) if flat else df

    add(name, run, sql)


def whole(name: str, body: dict, sql: str, select: list[str]) -> None:
    """A request's scan, keys, joins and where without its page: all rows."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        catalog, spec = tables(spark, folder), read(body)
        return selected(catalog[spec.collection].documents(), spec, catalog).selectExpr(*select)

    add(name, run, sql)


def shaped(name: str, body: dict, sql: str, flat: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """A request without its page: all rows, in the request's shape."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        catalog, spec = tables(spark, folder), read(body)
        df = shape(selected(catalog[spec.collection].documents(), spec, catalog), spec.fields, spec.excluded, [])
        return flat(df) if flat else df

    add(name, run, sql)


ORDERS = "o_orderkey, o_orderstatus, o_totalprice"
F3 = ["o_orderkey", "o_orderstatus", "o_totalprice"]

# scans and keys
ask("scan_newest_first", {"collection": "orders", "fields": F3}, f"SELECT {K.format('o_orderkey')}, {ORDERS} FROM orders ORDER BY o_orderkey DESC LIMIT 100")
ask("scan_oldest_first", {"collection": "orders", "order": "asc", "fields": F3, "count": 50}, f"SELECT {K.format('o_orderkey')}, {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 50")
ask("scan_offset", {"collection": "orders", "order": "asc", "fields": F3, "count": 50, "offset": 20}, f"SELECT {K.format('o_orderkey')}, {ORDERS} FROM orders ORDER BY o_orderkey LIMIT 50 OFFSET 20")
ask("keys_batch", {"collection": "orders", "keys": ["1", "5", "17", "42", "42", "none"], "fields": F3}, f"SELECT {K.format('o_orderkey')}, {ORDERS} FROM orders WHERE o_orderkey IN (1, 5, 17, 42)")
ask("keys_single", {"collection": "customer", "keys": "7", "fields": ["c_name", "c_acctbal"]}, "SELECT CAST(1 AS BIGINT) AS _v, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
ask("keys_where", {"collection": "customer", "keys": ["7", "8", "9", "10"], "where": {"c_acctbal": {"$gt": 0}}, "fields": ["c_acctbal"]}, f"SELECT {K.format('c_custkey')}, c_acctbal FROM customer WHERE c_custkey IN (7, 8, 9, 10) AND c_acctbal > 0")
shaped("key_prefix_scope", {"collection": "orders", "_allowed_prefixes": ["12", "7"], "fields": ["o_totalprice"]}, f"SELECT {K.format('o_orderkey')}, o_totalprice FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '12') OR starts_with(CAST(o_orderkey AS VARCHAR), '7')")
ask("prefix_where_sort", {"collection": "orders", "_allowed_prefixes": ["1"], "where": {"o_orderstatus": "F"}, "sort": {"field": "o_totalprice", "order": "desc"}, "fields": ["o_totalprice"], "count": 30}, f"SELECT {K.format('o_orderkey')}, o_totalprice FROM orders WHERE starts_with(CAST(o_orderkey AS VARCHAR), '1') AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 30")

# predicates, over whole tables
whole("where_eq_ci", {"collection": "orders", "where": {"o_orderstatus": {"$eq": "f"}}}, "SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderstatus) = 'f'", ["o_orderkey", "o_orderstatus"])
whole("where_implicit_eq", {"collection": "customer", "where": {"c_mktsegment": "building"}}, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", ["c_custkey"])
whole("where_eq_number", {"collection": "part", "where": {"p_size": 24}}, "SELECT p_partkey, p_size FROM part WHERE p_size = 24", ["p_partkey", "p_size"])
whole("where_eq_double", {"collection": "lineitem", "where": {"l_discount": {"$equals": 0.05}}}, "SELECT l_orderkey, l_linenumber, l_discount FROM lineitem WHERE abs(l_discount - 0.05) < 2.220446049250313e-16", ["l_orderkey", "l_linenumber", "l_discount"])
whole("where_ne", {"collection": "orders", "where": {"o_orderstatus": {"$ne": "F"}}}, "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND lower(o_orderstatus) <> 'f'", ["o_orderkey"])
whole("where_gt", {"collection": "customer", "where": {"c_acctbal": {"$gt": 5000}}}, "SELECT c_custkey FROM customer WHERE c_acctbal > 5000", ["c_custkey"])
whole("where_range", {"collection": "orders", "where": {"o_totalprice": {"$gte": 100000, "$lessThanOrEqual": 200000}}}, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 100000 AND 200000", ["o_orderkey", "o_totalprice"])
whole("where_lt", {"collection": "part", "where": {"p_size": {"$lt": 5}}}, "SELECT p_partkey FROM part WHERE p_size < 5", ["p_partkey"])
whole("where_in", {"collection": "customer", "where": {"c_mktsegment": {"$in": ["building", "MACHINERY"]}}}, "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')", ["c_custkey", "c_mktsegment"])
whole("where_in_numbers", {"collection": "part", "where": {"p_size": {"$oneOf": [1, 2, 3]}}}, "SELECT p_partkey FROM part WHERE p_size IN (1, 2, 3)", ["p_partkey"])
whole("where_nin", {"collection": "customer", "where": {"c_mktsegment": {"$nin": ["building"]}}}, "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) NOT IN ('building')", ["c_custkey"])
whole("where_contains_string", {"collection": "part", "where": {"p_name": {"$contains": "WIDGET"}}}, "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'widget')", ["p_partkey", "p_name"])
whole("where_or", {"collection": "orders", "where": {"$or": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 400000}}]}}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' OR o_totalprice > 400000", ["o_orderkey"])
whole("where_and", {"collection": "orders", "where": {"$and": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 50000}}]}}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000", ["o_orderkey"])
whole("where_array_form", {"collection": "orders", "where": [{"o_orderstatus": "O"}, {"o_totalprice": {"$lt": 50000}}]}, "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice < 50000", ["o_orderkey"])
whole("where_nested_logic", {"collection": "orders", "where": {"$or": [{"$and": [{"o_orderstatus": "F"}, {"o_totalprice": {"$gt": 300000}}]}, {"o_orderpriority": {"$ct": "urgent"}}]}}, "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 300000) OR contains(lower(o_orderpriority), 'urgent')", ["o_orderkey"])
whole("where_or_empty", {"collection": "orders", "where": {"$or": []}}, "SELECT o_orderkey FROM orders WHERE false", ["o_orderkey"])
whole("where_in_empty", {"collection": "orders", "where": {"o_orderstatus": {"$in": []}}}, "SELECT o_orderkey FROM orders WHERE false", ["o_orderkey"])
whole("where_nin_empty", {"collection": "region", "where": {"r_name": {"$nin": []}}}, "SELECT r_regionkey FROM region", ["r_regionkey"])
whole("where_type_mismatch", {"collection": "orders", "where": {"o_totalprice": {"$eq": "100"}}}, "SELECT o_orderkey FROM orders WHERE false", ["o_orderkey"])
whole("where_variant_path", {"collection": "props", "where": {"k": {"$gt": 50}}}, "SELECT CAST(event_id AS VARCHAR) AS _key FROM events WHERE CAST(props->>'k' AS DOUBLE) > 50", ["_key"])
whole("where_variant_mismatch", {"collection": "props", "where": {"k": {"$contains": "5"}}}, "SELECT CAST(event_id AS VARCHAR) AS _key FROM events WHERE false", ["_key"])
ask("where_seq_cursor", {"collection": "orders", "where": {"_seq": {"$lt": 100}}, "fields": ["_seq"], "count": 40}, f"SELECT {K.format('o_orderkey')}, o_orderkey AS _seq FROM orders WHERE o_orderkey < 100 ORDER BY o_orderkey DESC LIMIT 40")
ask("where_page", {"collection": "orders", "where": {"o_orderstatus": "F"}, "fields": ["o_totalprice"], "count": 25, "offset": 10}, f"SELECT {K.format('o_orderkey')}, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey DESC LIMIT 25 OFFSET 10")


def _with_arrays(spark: SparkSession, folder: str, where: dict, raw: bool) -> DataFrame:
    from .functions.predicates import compile_where

    part = spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", F.split("p_name", " ").alias("tags"), F.struct("p_brand", F.struct("p_size").alias("more")).alias("info"))
    return part.where(compile_where(where, Resolver(part), raw)).select("p_partkey")


add("where_contains_array", lambda s, d: _with_arrays(s, d, {"tags": {"$contains": "COL"}}, True), "SELECT p_partkey FROM part WHERE len(list_filter(string_split(p_name, ' '), lambda x: contains(lower(x), 'col'))) > 0")
add("where_contains_element", lambda s, d: _with_arrays(s, d, {"tags": {"$contains": "cold"}}, False), "SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'cold')")
add("where_nested_path", lambda s, d: _with_arrays(s, d, {"info.more.p_size": {"$gte": 40}}, True), "SELECT p_partkey FROM part WHERE p_size >= 40")

# sorts
ask("sort_top_n_desc", {"collection": "orders", "where": {"o_orderstatus": "f", "o_totalprice": {"$gte": 100000}}, "sort": [{"field": "o_totalprice", "order": "desc"}], "fields": ["o_orderstatus", "o_totalprice"], "count": 10}, f"SELECT {K.format('o_orderkey')}, o_orderstatus, o_totalprice FROM orders WHERE lower(o_orderstatus) = 'f' AND o_totalprice >= 100000 ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 10")
ask("sort_top_n_asc", {"collection": "customer", "sort": "c_acctbal", "fields": ["c_acctbal"], "count": 20}, f"SELECT {K.format('c_custkey')}, c_acctbal FROM customer ORDER BY c_acctbal, CAST(c_custkey AS VARCHAR) LIMIT 20")
ask("sort_string", {"collection": "customer", "sort": {"field": "c_name", "order": "DESC"}, "fields": ["c_name"], "count": 20}, f"SELECT {K.format('c_custkey')}, c_name FROM customer ORDER BY c_name DESC, CAST(c_custkey AS VARCHAR) LIMIT 20")
ask("sort_multi", {"collection": "orders", "sort": ["o_orderstatus", {"field": "o_totalprice", "order": "desc"}], "fields": ["o_orderstatus", "o_totalprice"], "count": 30}, f"SELECT {K.format('o_orderkey')}, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 30")
ask("sort_page_2", {"collection": "orders", "sort": {"field": "o_totalprice", "order": "desc"}, "fields": ["o_totalprice"], "count": 20, "offset": 20}, f"SELECT {K.format('o_orderkey')}, o_totalprice FROM orders ORDER BY o_totalprice DESC, CAST(o_orderkey AS VARCHAR) LIMIT 20 OFFSET 20")
ask("sort_nulls_desc_first", {"collection": "documents", "joins": [{"label": {"from": "labels", "on": "label_ref", "fields": ["quality"]}}], "sort": {"field": "label.quality", "order": "desc"}, "fields": ["n_chars"], "count": 50}, f"SELECT {K.format('d.doc_id')}, n_chars, quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id ORDER BY quality DESC NULLS FIRST, d.doc_id LIMIT 50", lambda df: df.select("_key", "_v", "n_chars", F.col("label.quality").alias("quality")))
ask("sort_variant", {"collection": "props", "sort": {"field": "k", "order": "desc"}, "count": 30}, f"SELECT {K.format('event_id')}, CAST(props->>'k' AS BIGINT) AS k FROM events WHERE props->>'k' IS NOT NULL ORDER BY CAST(props->>'k' AS DOUBLE) DESC, CAST(event_id AS VARCHAR) LIMIT 30", lambda df: df.select("_key", "_v", F.try_variant_get("doc", "$.k", "long").alias("k")))

# projections
shaped("project_fields", {"collection": "part", "fields": ["p_name", "p_brand", "absent"]}, f"SELECT {K.format('p_partkey')}, p_name, p_brand FROM part")
shaped("project_empty", {"collection": "part", "fields": []}, f"SELECT {K.format('p_partkey')} FROM part")
shaped("exclude_fields", {"collection": "customer", "excludedFields": ["c_name", "c_mktsegment", "nation_ref", "_v"]}, f"SELECT {K.format('c_custkey')}, c_custkey, c_nationkey, c_acctbal FROM customer")
ask("project_system", {"collection": "region", "fields": ["_seq", "_createdAt", "r_name"]}, f"SELECT {K.format('r_regionkey')}, CAST(r_regionkey AS BIGINT) AS _seq, '1970-01-01T00:00:00Z' AS _createdAt, r_name FROM region")
shaped("project_variant", {"collection": "props", "fields": ["k"]}, f"SELECT {K.format('event_id')}, CAST(props->>'k' AS BIGINT) AS k FROM events", lambda df: df.select("_key", "_v", F.try_variant_get("doc", "$.k", "long").alias("k")))


def _nested(spark: SparkSession, folder: str, fields=None, excluded=None) -> DataFrame:
    catalog = tables(spark, folder)
    orders = catalog["orders"].documents()
    nested = orders.select("_key", "_v", "_seq", F.struct(F.struct("o_orderstatus", "o_totalprice").alias("a"), F.struct("o_orderpriority").alias("b")).alias("doc1"))
    return shape(nested, fields, excluded, [])


add("project_nested", lambda s, d: _nested(s, d, fields=("doc1.a.o_totalprice", "doc1.b")).select("_key", F.col("doc1.a.o_totalprice").alias("price"), F.col("doc1.b.o_orderpriority").alias("priority")), "SELECT CAST(o_orderkey AS VARCHAR) AS _key, o_totalprice AS price, o_orderpriority AS priority FROM orders")
add("exclude_nested", lambda s, d: _nested(s, d, excluded=("doc1.a.o_totalprice", "doc1.b.o_orderpriority")).select("_key", F.to_json("doc1").alias("left_over")), """SELECT CAST(o_orderkey AS VARCHAR) AS _key, '{"a":{"o_orderstatus":"' || o_orderstatus || '"}}' AS left_over FROM orders""")
add("timestamp_format", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", iso(F.unix_millis(F.col("ts").cast("timestamp"))).alias("at")), "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")

# joins
CUST = {"cust": {"from": "customer", "on": "customer_ref"}}
whole("join_lookup", {"collection": "orders", "joins": [CUST]}, "SELECT o_orderkey, c_name, CAST(1 AS BIGINT) AS cust_v FROM orders LEFT JOIN customer ON o_custkey = c_custkey", ["o_orderkey", "cust.c_name AS c_name", "cust._v AS cust_v"])
whole("join_projected", {"collection": "orders", "joins": [{"cust": {"from": "customer", "on": "customer_ref", "fields": ["c_mktsegment"]}}]}, "SELECT o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey", ["o_orderkey", "cust.c_mktsegment AS c_mktsegment"])
whole("join_double", {"collection": "lineitem", "joins": [{"p": {"from": "part", "on": "part_ref", "fields": ["p_brand"]}}, {"s": {"from": "supplier", "on": "supplier_ref", "fields": ["s_name"]}}]}, "SELECT l_orderkey, l_linenumber, p_brand, s_name FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey", ["l_orderkey", "l_linenumber", "p.p_brand AS p_brand", "s.s_name AS s_name"])
whole("join_chained", {"collection": "orders", "joins": [CUST, {"nat": {"from": "nation", "on": "cust.nation_ref"}}, {"reg": {"from": "region", "on": "nat.region_ref"}}]}, "SELECT o_orderkey, n_name, r_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey", ["o_orderkey", "nat.n_name AS n_name", "reg.r_name AS r_name"])
whole("join_where_joined", {"collection": "orders", "joins": [CUST], "where": {"cust.c_mktsegment": "automobile", "o_totalprice": {"$gt": 200000}}}, "SELECT o_orderkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'automobile' AND o_totalprice > 200000", ["o_orderkey"])
ask("join_sort_joined", {"collection": "orders", "joins": [CUST], "sort": {"field": "cust.c_acctbal", "order": "desc"}, "fields": ["o_totalprice"], "count": 20}, f"SELECT {K.format('o_orderkey')}, o_totalprice, c_acctbal FROM orders LEFT JOIN customer ON o_custkey = c_custkey ORDER BY c_acctbal DESC NULLS FIRST, o_orderkey LIMIT 20", lambda df: df.select("_key", "_v", "o_totalprice", F.col("cust.c_acctbal").alias("c_acctbal")))
whole("join_unmatched", {"collection": "documents", "joins": [{"label": {"from": "labels", "on": "label_ref"}}]}, "SELECT d.doc_id, l.toxic AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id", ["doc_id", "label.toxic AS toxic"])
whole("join_ne_unmatched", {"collection": "documents", "joins": [{"label": {"from": "labels", "on": "label_ref"}}], "where": {"label.toxic": {"$ne": 0}}}, "SELECT d.doc_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.toxic IS NULL OR l.toxic <> 0", ["doc_id"])


def _key_list(spark: SparkSession, folder: str) -> DataFrame:
    catalog = tables(spark, folder)
    keys = catalog["orders"].documents().where("o_totalprice > 450000").select(F.col("customer_ref").alias("_key"))
    return joins.listed(catalog["customer"].documents(), keys).select("c_custkey", "c_name")


add("join_key_list_semi", _key_list, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")


def _extends(spark: SparkSession, folder: str) -> DataFrame:
    catalog = tables(spark, folder)
    docs = catalog["orders"].documents().select("o_orderkey", F.concat(F.lit("customer."), "customer_ref").alias("ref"))
    return fold.embed(docs, "ref", catalog["customer"].documents(), "name", "_key", "c_name")


add("extends_embed", _extends, "SELECT o_orderkey, c_name AS name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")

# counts and metrics
add("stats_one", lambda s, d: metrics.stats_one(tables(s, d)["orders"].documents(), "orders"), "SELECT 'orders' AS collection, count(*) AS count FROM orders")
add("stats_all", lambda s, d: metrics.stats_all({n: tables(s, d)[n].documents() for n in ("orders", "customer", "part", "lineitem")}), "WITH c AS (SELECT 'orders' AS collection, count(*) AS n FROM orders UNION ALL SELECT 'customer', count(*) FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'lineitem', count(*) FROM lineitem) SELECT collection, n AS count FROM c UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT) FROM c")


def _metric(name: str, collection: str, what: dict, where, sql: str) -> None:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = metrics.metric(tables(spark, folder)[collection].documents(), what, where)
        return out if what["type"] == "COUNT" else out.select(F.round("result", 2).alias("result"))

    add(name, run, sql)


_metric("metric_count", "lineitem", {"type": "COUNT"}, None, "SELECT count(*) AS result FROM lineitem")
_metric("metric_count_where", "orders", {"type": "COUNT"}, {"o_orderstatus": "f"}, "SELECT count(*) AS result FROM orders WHERE lower(o_orderstatus) = 'f'")
_metric("metric_sum", "lineitem", {"type": "SUM", "field": "l_quantity"}, None, "SELECT round(sum(CAST(l_quantity AS DOUBLE)), 2) AS result FROM lineitem")
_metric("metric_avg", "customer", {"type": "AVG", "field": "c_acctbal"}, {"c_mktsegment": "building"}, "SELECT round(avg(c_acctbal), 2) AS result FROM customer WHERE lower(c_mktsegment) = 'building'")
_metric("metric_min", "part", {"type": "MIN", "field": "p_retailprice"}, None, "SELECT round(min(p_retailprice), 2) AS result FROM part")
_metric("metric_max", "orders", {"type": "MAX", "field": "o_totalprice"}, {"o_orderstatus": {"$ne": "P"}}, "SELECT round(max(o_totalprice), 2) AS result FROM orders WHERE lower(o_orderstatus) <> 'p'")
add("metrics_one_pass", lambda s, d: metrics.many_metrics(tables(s, d)["orders"].documents(), {"n": ({"type": "COUNT"}, None), "open": ({"type": "COUNT"}, {"o_orderstatus": "o"}), "top": ({"type": "MAX", "field": "o_totalprice"}, {"o_orderstatus": "f"})}), "SELECT count(*) AS n, count(*) FILTER (WHERE lower(o_orderstatus) = 'o') AS open, max(o_totalprice) FILTER (WHERE lower(o_orderstatus) = 'f') AS top FROM orders")


# the log: orders are inserted, every third is written again, every fifth deleted, in committed and open transactions
def _log(spark: SparkSession, folder: str) -> DataFrame:
    o = spark.read.parquet(f"{folder}/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    n = 10_000_000

    def rows(df: DataFrame, cmd: str, base: int, v: int, times: float, tx: str | None) -> DataFrame:
        value = F.to_json(F.struct((F.col("o_totalprice") * times).alias("price"))) if cmd == INSERT else F.lit(None).cast("string")
        batch = F.when(F.col("k").isNotNull(), F.concat(F.lit(tx), F.lit("-"), F.lit(base // n).cast("string"))) if tx else F.lit(None).cast("string")
        return df.select((F.col("k") + base).alias("ord"), batch.alias("tx_id"), F.lit(cmd).alias("cmd"), F.when(F.col("k") % 2 == 0, "even").otherwise("odd").alias("collection"), F.col("k").cast("string").alias("key"), value.alias("value"), F.lit(v).cast("long").alias("v"), F.col("k").alias("seq"), F.lit(0).cast("long").alias("created"), (F.col("k") + base).alias("_t"))

    third, fifth, ninth = o.where("k % 3 = 0"), o.where("k % 5 = 0"), o.where("k % 9 = 0")
    one = lambda cmd, ord_, tx, coll=None, value=None: spark.range(1).select(F.lit(ord_).cast("long").alias("ord"), F.when(F.col("id") >= 0, F.lit(tx)).cast("string").alias("tx_id"), F.lit(cmd).alias("cmd"), F.lit(coll).cast("string").alias("collection"), F.lit(None).cast("string").alias("key"), F.lit(value).cast("string").alias("value"), *[F.lit(None).cast("long").alias(c) for c in ("v", "seq", "created")], F.lit(ord_).cast("long").alias("_t"))
    parts = [rows(o, INSERT, 0, 1, 1.0, None), one(BEGIN, n - 1, "a-1"), rows(third, INSERT, n, 2, 2.0, "a"), one(COMMIT, 2 * n - 1, "a-1"), rows(fifth, DELETE, 2 * n, 0, 0.0, None), one(BEGIN, 3 * n - 1, "b-3"), rows(ninth, INSERT, 3 * n, 3, 3.0, "b")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _prices(state: DataFrame) -> DataFrame:
    return state.select("collection", "key", "v", F.round(F.get_json_object("value", "$.price").cast("double"), 2).alias("price"))


_FOLD = "SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'even' ELSE 'odd' END AS collection, CAST(o_orderkey AS VARCHAR) AS key, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS v, round(o_totalprice * CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END, 2) AS price FROM orders"
add("upsert_fold", lambda s, d: _prices(fold.fold(_log(s, d))), f"{_FOLD} WHERE o_orderkey % 5 <> 0")
add("tx_committed_only", lambda s, d: fold.committed(_log(s, d)).groupBy("cmd").agg(F.count("*").alias("n")), "SELECT 'INSERT' AS cmd, count(*) + count(*) FILTER (WHERE o_orderkey % 3 = 0) AS n FROM orders UNION ALL SELECT 'DELETE', count(*) FILTER (WHERE o_orderkey % 5 = 0) FROM orders")


def _dropped(spark: SparkSession, folder: str, cmd: str, value: str | None) -> DataFrame:
    end = spark.range(1).select(F.lit(25_000_000_000).cast("long").alias("ord"), F.lit(None).cast("string").alias("tx_id"), F.lit(cmd).alias("cmd"), F.lit("even").alias("collection"), F.lit(None).cast("string").alias("key"), F.lit(value).cast("string").alias("value"), *[F.lit(None).cast("long").alias(c) for c in ("v", "seq", "created")], F.lit(0).cast("long").alias("_t"))
    return fold.fold(_log(spark, folder).unionByName(end), 1000)


add("drop_fold", lambda s, d: _prices(_dropped(s, d, DROP, None)), f"{_FOLD} WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1")
add("ttl_evicts", lambda s, d: _prices(_dropped(s, d, EXPIRY, "999")), f"{_FOLD} WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1")
add("ttl_restores", lambda s, d: _prices(_dropped(s, d, EXPIRY, "1001")), f"{_FOLD} WHERE o_orderkey % 5 <> 0")
add("pitr_to_time", lambda s, d: _prices(fold.fold(fold.until(_log(s, d), to_time=19_999_999))), _FOLD)
add("pitr_to_seq", lambda s, d: _prices(fold.fold(fold.until(_log(s, d), to_seq=100))), f"{_FOLD.replace('THEN 2', 'THEN 1')} ORDER BY o_orderkey LIMIT 100")
add("update_merge", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", fold.merge(F.col("props"), F.to_json(F.struct(F.col("event_type").alias("type")))).alias("doc")).select("event_id", F.get_json_object("doc", "$.k").alias("k"), F.get_json_object("doc", "$.type").alias("type")), "SELECT event_id, props->>'k' AS k, event_type AS type FROM events")
add("capped_keep", lambda s, d: fold.capped(fold.fold(_log(s, d)).where("collection = 'odd'"), 30).select("key"), "SELECT CAST(o_orderkey AS VARCHAR) AS key FROM orders WHERE o_orderkey % 5 <> 0 AND o_orderkey % 2 = 1 ORDER BY o_orderkey DESC LIMIT 30")


def _delete(spark: SparkSession, folder: str, where: dict | None, n: int, newest: bool) -> DataFrame:
    from .functions.predicates import compile_where

    docs = tables(spark, folder)["orders"].documents()
    gone = docs.where(compile_where(where, Resolver(docs), True)) if where else docs
    gone = gone.orderBy(F.desc("_seq") if newest else F.asc("_seq")).limit(n).select("_key")
    return docs.join(gone, "_key", "left_anti").select("o_orderkey")


add("delete_where_oldest", lambda s, d: _delete(s, d, {"o_orderstatus": "F"}, 100, False), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100)")
add("delete_n_newest", lambda s, d: _delete(s, d, None, 50, True), "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 50)")
add("schema_validate", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", valid(F.parse_json("props"), {"type": "object", "required": ["k"], "properties": {"k": {"type": "integer", "minimum": 10, "maximum": 90}}}).alias("ok")), "SELECT event_id, CAST(props->>'k' AS BIGINT) BETWEEN 10 AND 90 AS ok FROM events")

# the feed, idle expiry and the sliding window
add("change_feed", lambda s, d: feed.events(fold.committed(_log(s, d))).groupBy("event", "collection", F.col("new_v").isNull().alias("deleted")).agg(F.count("*").alias("n")), "WITH e AS (SELECT o_orderkey % 2 AS c, false AS deleted FROM orders UNION ALL SELECT o_orderkey % 2, false FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey % 2, true FROM orders WHERE o_orderkey % 5 = 0) SELECT 'change' AS event, CASE WHEN c = 0 THEN 'even' ELSE 'odd' END AS collection, deleted, count(*) AS n FROM e GROUP BY c, deleted")
add("idle_expiry", lambda s, d: feed.idle_expiry(s.read.parquet(f"{d}/events.parquet").select(F.col("ts").alias("at"), F.col("event_type").alias("collection")), "10 minutes").select("collection", F.unix_seconds(F.col("expires_at").cast("timestamp")).alias("expires_at"), "writes"), "WITH g AS (SELECT event_type AS collection, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)), n AS (SELECT *, sum(fresh) OVER (PARTITION BY collection ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT collection, CAST(floor(epoch(max(ts) + INTERVAL 10 MINUTE)) AS BIGINT) AS expires_at, count(*) AS writes FROM n GROUP BY collection, run")
add("rate_limit", lambda s, d: feed.rate_limited(s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts"), 86_400, 3).select("event_id", "limited"), "SELECT event_id, (SELECT count(*) FROM events o WHERE o.user_id = e.user_id AND o.ts < e.ts AND o.ts > e.ts - INTERVAL 86400 SECOND) >= 3 AS limited FROM events e")


# writes through the request interface, over an in-memory log
def _written(spark: SparkSession, folder: str) -> Database:
    """All customers as documents, the first third of the keys (by remainder) written twice."""
    db = Database(spark, clock=lambda: 1_000_000)
    rows = spark.read.parquet(f"{folder}/customer.parquet").select(F.col("c_custkey").cast("string").alias("key"), F.to_json(F.struct("c_name", "c_acctbal")).alias("value"), F.col("c_custkey").alias("at"))
    last = rows.agg(F.max("at")).first()[0]
    db.insert("customers", rows, last + 1)
    db.insert("customers", rows.where("at % 3 = 0"), last + 1)
    return db


def _state(db: Database) -> DataFrame:
    return db.state("customers").select("key", "v", F.get_json_object("value", "$.c_name").alias("c_name"), F.get_json_object("value", "$.c_acctbal").cast("double").alias("c_acctbal"), F.get_json_object("value", "$.tag").alias("tag"))


def _updated(spark: SparkSession, folder: str, guards: bool) -> DataFrame:
    """Tags by update; with guards each key guards its version, and the first (in the order of keys as text) that isn't at 1 ends it."""
    db = _written(spark, folder)
    answer = db.request("update", {"collection": "customers", "data": {str(k): {"tag": "new"} | ({"_v": 1} if guards else {}) for k in range(10, 60)}})
    return _state(db).withColumn("answer", F.lit(answer.get("statusCode", 200)))


def _deleted(spark: SparkSession, folder: str) -> DataFrame:
    db = _written(spark, folder)
    db.delete({"collection": "customers", "keys": [str(k) for k in range(1, 90, 2)] + ["none"]})
    return _state(db).drop("tag")


_V = "CAST(CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS BIGINT)"
add("set_versions", lambda s, d: _state(_written(s, d)).drop("tag"), f"SELECT CAST(c_custkey AS VARCHAR) AS key, {_V} AS v, c_name, c_acctbal FROM customer")
add("update_keys", lambda s, d: _updated(s, d, False), f"SELECT CAST(c_custkey AS VARCHAR) AS key, {_V} + CASE WHEN c_custkey BETWEEN 10 AND 59 THEN 1 ELSE 0 END AS v, c_name, c_acctbal, CASE WHEN c_custkey BETWEEN 10 AND 59 THEN 'new' END AS tag, 200 AS answer FROM customer")
add("update_conflict", lambda s, d: _updated(s, d, True), f"WITH t AS (SELECT *, {_V} AS v0, c_custkey BETWEEN 10 AND least(59, (SELECT min(c_custkey) FROM customer WHERE c_custkey BETWEEN 10 AND 59 AND c_custkey % 3 = 0) - 1) AS hit FROM customer) SELECT CAST(c_custkey AS VARCHAR) AS key, v0 + CASE WHEN hit THEN 1 ELSE 0 END AS v, c_name, c_acctbal, CASE WHEN hit THEN 'new' END AS tag, 409 AS answer FROM t")
add("delete_keys", _deleted, f"SELECT CAST(c_custkey AS VARCHAR) AS key, {_V} AS v, c_name, c_acctbal FROM customer WHERE NOT (c_custkey < 90 AND c_custkey % 2 = 1)")
_SHARED = [{"collection": "orders", "where": {"o_orderstatus": "F"}, "count": 20}, {"collection": "orders", "where": {"o_totalprice": {"$gt": 300000}}, "order": "asc", "offset": 5, "count": 10}, {"collection": "orders", "count": 15}]
add("scans_one_pass", lambda s, d: together([read(b) for b in _SHARED], tables(s, d)).select("request", "place", "o_orderkey"), """
WITH r AS (
    SELECT 0 AS request, o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) AS place FROM orders WHERE lower(o_orderstatus) = 'f'
    UNION ALL SELECT 1, o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 5 FROM orders WHERE o_totalprice > 300000
    UNION ALL SELECT 2, o_orderkey, row_number() OVER (ORDER BY o_orderkey DESC) FROM orders)
SELECT request, CAST(place AS INTEGER) AS place, o_orderkey FROM r WHERE place > 0 AND place <= CASE request WHEN 0 THEN 20 WHEN 1 THEN 10 ELSE 15 END""")
add("schema_composed", lambda s, d: s.read.parquet(f"{d}/events.parquet").select("event_id", valid(F.parse_json("props"), {"required": ["k"], "properties": {"k": {"$ref": "#/definitions/n"}}, "definitions": {"n": {"oneOf": [{"multipleOf": 2}, {"minimum": 50}], "not": {"const": 60}}}}).alias("ok")), "SELECT event_id, ((CAST(props->>'k' AS BIGINT) % 2 = 0) <> (CAST(props->>'k' AS BIGINT) >= 50)) AND CAST(props->>'k' AS BIGINT) <> 60 AS ok FROM events")


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return QUERIES["sort_top_n_desc"](spark, folder)
