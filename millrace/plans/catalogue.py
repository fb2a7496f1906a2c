"""The relational queries by name: a DataFrame or Spark SQL form, and DuckDB SQL for the same rows.

Tables are read through `sources.files`; Catalyst pushes filters and column lists to the
scans, and adaptive execution picks join strategies from sizes.  Every computed column is
named, sums of integers are doubles, NULL placement is always written out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.database import ConstraintError, Database
from millrace.functions.scalar import call
from millrace.operators.relational import aggregate, index_range, join, limit_offset, not_in, order_by, total
from millrace.sources.files import TABLES, register, shared_folder, table, values

Query = Callable[[SparkSession, str], DataFrame]
_FOUND: dict[str, tuple[Query, str]] = {}


class Tables:
    """Attribute access to the tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return table(self.spark, self.folder, name)


def query(name: str, sql: str):
    """Register a query of Tables under a name, with its DuckDB SQL."""

    def keep(build: Callable[[Tables], DataFrame]):
        _FOUND[name] = (lambda spark, folder: build(Tables(spark, folder)), sql)
        return build

    return keep


def sql_query(name: str, text: str, duck: str | None = None) -> None:
    """Register a query that is the same text for both engines, or nearly."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        register(spark, folder, [t for t in TABLES if t in text])
        return spark.sql(text)

    _FOUND[name] = (run, duck or text)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by what they ordered: join, filter, group, having, order, limit."""
    return _FOUND["complex_report"][0](spark, sf_dir)


def queries() -> dict[str, Query]:
    return {name: run for name, (run, _) in _FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _FOUND.items()}


@query("scan_project", """SELECT c_custkey, c_name AS name, c_acctbal + 10 AS more FROM customer""")
def _scan_project(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.col("c_name").alias("name"), (F.col("c_acctbal") + 10).alias("more"))


@query("scan_star", """SELECT * FROM nation""")
def _scan_star(t: Tables) -> DataFrame:
    return t.nation


@query("scan_distinct_star", """SELECT DISTINCT * FROM (SELECT * FROM nation UNION ALL SELECT * FROM nation)""")
def _scan_distinct_star(t: Tables) -> DataFrame:
    return t.nation.union(t.nation).distinct()


@query("qualified_star", """SELECT r.*, n.n_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey""")
def _qualified_star(t: Tables) -> DataFrame:
    return t.nation.alias("n").join(t.region.alias("r"), F.col("n.n_regionkey") == F.col("r.r_regionkey")).select("r.*", "n_name")


@query("filter_cmp", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_orderstatus <> 'P' AND o_custkey < 500 AND o_orderkey > 10""")
def _filter_cmp(t: Tables) -> DataFrame:
    return t.orders.filter((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "P") & (F.col("o_custkey") < 500) & (F.col("o_orderkey") > 10)).select("o_orderkey", "o_totalprice")


@query("filter_and_or_not", """SELECT p_partkey, p_size, p_retailprice FROM part WHERE (p_size < 10 OR p_size > 40) AND NOT (p_retailprice > 1500)""")
def _filter_and_or_not(t: Tables) -> DataFrame:
    return t.part.filter(((F.col("p_size") < 10) | (F.col("p_size") > 40)) & ~(F.col("p_retailprice") > 1500)).select("p_partkey", "p_size", "p_retailprice")


@query("filter_between", """SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 20""")
def _filter_between(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_size").between(10, 20)).select("p_partkey", "p_size")


@query("filter_not_between", """SELECT p_partkey, size FROM (SELECT p_partkey, nullif(p_size, 7) AS size FROM part) WHERE size NOT BETWEEN 10 AND 20""")
def _filter_not_between(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("NULLIF", "p_size", F.lit(7)).alias("size")).filter(~F.col("size").between(10, 20))


@query("filter_in", """SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def _filter_in(t: Tables) -> DataFrame:
    return t.orders.filter(F.col("o_orderstatus").isin("F", "O")).select("o_orderkey", "o_orderstatus")


@query("filter_not_in", """SELECT o_orderkey, st FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS st FROM orders) WHERE st NOT IN ('P', 'X')""")
def _filter_not_in(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", call("NULLIF", "o_orderstatus", F.lit("F")).alias("st")).filter(~F.col("st").isin("P", "X"))


@query("filter_is_null", """SELECT p_partkey, size FROM (SELECT p_partkey, nullif(p_size, 7) AS size FROM part) WHERE size IS NULL""")
def _filter_is_null(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("NULLIF", "p_size", F.lit(7)).alias("size")).filter(F.col("size").isNull())


@query("filter_is_not_null", """SELECT p_partkey, size FROM (SELECT p_partkey, nullif(p_size, 7) AS size FROM part) WHERE size IS NOT NULL""")
def _filter_is_not_null(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("NULLIF", "p_size", F.lit(7)).alias("size")).filter(F.col("size").isNotNull())


@query("filter_is_true", """SELECT p_partkey, coalesce(big, false) AS sure FROM (SELECT p_partkey, nullif(p_size, 7) > 20 AS big FROM part) WHERE big IS TRUE OR big IS NULL""")
def _filter_is_true(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", (call("NULLIF", "p_size", F.lit(7)) > 20).alias("big")).filter(F.col("big").eqNullSafe(True) | F.col("big").isNull()).select("p_partkey", F.coalesce("big", F.lit(False)).alias("sure"))


@query("filter_like", """SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type LIKE '_%'""")
def _filter_like(t: Tables) -> DataFrame:
    return t.part.filter(F.col("p_name").like("%a%") & F.col("p_type").like("_%")).select("p_partkey", "p_name")


@query("filter_not_like", """SELECT p_partkey, p_brand FROM part WHERE p_brand NOT LIKE '%1'""")
def _filter_not_like(t: Tables) -> DataFrame:
    return t.part.filter(~F.col("p_brand").like("%1")).select("p_partkey", "p_brand")


@query("filter_ilike", """SELECT c_custkey, starts_with(c_name, 'C') AS starts, ends_with(c_name, '1') AS ends, contains(c_name, '0') AS has FROM customer WHERE c_mktsegment ILIKE 'b%'""")
def _filter_ilike(t: Tables) -> DataFrame:
    return t.customer.filter(call("ILIKE", F.col("c_mktsegment"), "b%")).select("c_custkey", F.startswith("c_name", F.lit("C")).alias("starts"), F.endswith("c_name", F.lit("1")).alias("ends"), F.contains("c_name", F.lit("0")).alias("has"))


@query("arith_expr", """SELECT l_orderkey, round(l_extendedprice * (1 - l_discount) + -l_tax, 4) AS net, CAST(l_linenumber * 3 - 1 AS BIGINT) AS m FROM lineitem WHERE l_orderkey < 200""")
def _arith_expr(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_orderkey < 200").select("l_orderkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) + -F.col("l_tax"), 4).alias("net"), (F.col("l_linenumber") * 3 - 1).cast("bigint").alias("m"))


@query("int_div_mod", """SELECT o_orderkey, o_custkey // 7 AS d, o_custkey % 7 AS m, (-o_custkey) % 7 AS neg FROM orders""")
def _int_div_mod(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.expr("o_custkey div 7").alias("d"), (F.col("o_custkey") % 7).alias("m"), F.expr("(-o_custkey) % 7").alias("neg"))


@query("try_divide", """SELECT p_partkey, round(p_retailprice / nullif(p_size % 5, 0), 6) AS q FROM part""")
def _try_divide(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(call("TRY_DIVIDE", F.col("p_retailprice"), F.col("p_size") % 5), 6).alias("q"))


@query("concat_op", """SELECT n_nationkey, n_name || '-' || nullif(n_name, 'NATION_3') AS s FROM nation""")
def _concat_op(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", F.concat(F.col("n_name"), F.lit("-"), call("NULLIF", "n_name", F.lit("NATION_3"))).alias("s"))


@query("fn_length", """SELECT p_partkey, CAST(length(p_name) AS BIGINT) AS n, CAST(length(p_type) AS BIGINT) AS m FROM part""")
def _fn_length(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("LENGTH", "p_name").alias("n"), call("CHAR_LENGTH", "p_type").alias("m"))


@query("fn_upper_lower", """SELECT p_partkey, upper(p_name) AS u, lower(p_type) AS l FROM part""")
def _fn_upper_lower(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("UPPER", "p_name").alias("u"), call("LOWER", "p_type").alias("l"))


@query("fn_trim", """SELECT n_nationkey, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r, trim(' ' || n_name || ' ') AS b FROM nation""")
def _fn_trim(t: Tables) -> DataFrame:
    return t.nation.select("n_nationkey", call("LTRIM", F.concat(F.lit("  "), "n_name")).alias("l"), call("RTRIM", F.concat("n_name", F.lit("  "))).alias("r"), call("TRIM", F.concat(F.lit(" "), "n_name", F.lit(" "))).alias("b"))


@query("fn_concat", """SELECT p_partkey, concat(p_brand, '/', p_type) AS s FROM part""")
def _fn_concat(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("CONCAT", F.col("p_brand"), F.lit("/"), F.col("p_type")).alias("s"))


@query("fn_abs", """SELECT c_custkey, abs(c_acctbal) AS a FROM customer""")
def _fn_abs(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", call("ABS", "c_acctbal").alias("a"))


@query("fn_round", """SELECT c_custkey, round(c_acctbal) AS r FROM customer""")
def _fn_round(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", call("ROUND", "c_acctbal").alias("r"))


@query("fn_ceil_floor", """SELECT c_custkey, ceil(c_acctbal) AS c, ceil(c_acctbal) AS cc, floor(c_acctbal) AS f FROM customer""")
def _fn_ceil_floor(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", call("CEIL", "c_acctbal").alias("c"), call("CEILING", "c_acctbal").alias("cc"), call("FLOOR", "c_acctbal").alias("f"))


@query("fn_sqrt", """SELECT p_partkey, round(sqrt(p_size), 9) AS s FROM part""")
def _fn_sqrt(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.round(call("SQRT", "p_size"), 9).alias("s"))


@query("fn_coalesce", """SELECT p_partkey, coalesce(nullif(p_size, 7), -1) AS s FROM part""")
def _fn_coalesce(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("COALESCE", call("NULLIF", "p_size", F.lit(7)), F.lit(-1)).alias("s"))


@query("fn_nullif", """SELECT p_partkey, nullif(p_brand, 'Brand#1') AS b FROM part""")
def _fn_nullif(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", call("NULLIF", "p_brand", F.lit("Brand#1")).alias("b"))


@query("fn_cast", """SELECT p_partkey, CAST(p_size AS DOUBLE) AS d, CAST(p_partkey AS VARCHAR) AS s, CAST(p_size % 2 AS BOOLEAN) AS odd FROM part""")
def _fn_cast(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_size").cast("double").alias("d"), F.col("p_partkey").cast("string").alias("s"), (F.col("p_size") % 2).cast("boolean").alias("odd"))


@query("case_searched", """SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'middle' ELSE 'large' END AS k FROM part""")
def _case_searched(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.when(F.col("p_size") < 10, "small").when(F.col("p_size") < 30, "middle").otherwise("large").alias("k"))


@query("case_simple", """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 END AS k FROM orders""")
def _case_simple(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 2).alias("k"))


@query("join_inner_equi", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def _join_inner_equi(t: Tables) -> DataFrame:
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_left", """SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 300000) ON c_custkey = o_custkey""")
def _join_left(t: Tables) -> DataFrame:
    return join(t.customer, t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("join_right", """SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 300000) RIGHT JOIN customer ON c_custkey = o_custkey""")
def _join_right(t: Tables) -> DataFrame:
    return join(t.orders.filter("o_totalprice > 300000"), t.customer, F.col("c_custkey") == F.col("o_custkey"), "right").select("c_custkey", "o_orderkey")


@query("join_full", """SELECT c_custkey, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey % 3 = 0) FULL JOIN (SELECT * FROM orders WHERE o_orderkey % 5 = 0) ON c_custkey = o_custkey""")
def _join_full(t: Tables) -> DataFrame:
    return join(t.customer.filter("c_custkey % 3 = 0"), t.orders.filter("o_orderkey % 5 = 0"), F.col("c_custkey") == F.col("o_custkey"), "full").select("c_custkey", "o_orderkey")


@query("join_cross", """SELECT r_name, n_name FROM region CROSS JOIN nation""")
def _join_cross(t: Tables) -> DataFrame:
    return join(t.region, t.nation, how="cross").select("r_name", "n_name")


@query("join_theta", """SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""")
def _join_theta(t: Tables) -> DataFrame:
    return t.nation.alias("a").join(t.nation.alias("b"), F.col("a.n_nationkey") < F.col("b.n_nationkey")).select(F.col("a.n_name").alias("x"), F.col("b.n_name").alias("y"))


@query("join_null_keys", """SELECT a.k FROM (SELECT DISTINCT nullif(p_size, 7) AS k FROM part) a JOIN (SELECT DISTINCT nullif(p_size, 7) AS k FROM part) b ON a.k = b.k""")
def _join_null_keys(t: Tables) -> DataFrame:
    return t.part.select(call("NULLIF", "p_size", F.lit(7)).alias("k")).distinct().alias("a").join(t.part.select(call("NULLIF", "p_size", F.lit(7)).alias("k")).distinct().alias("b"), F.col("a.k") == F.col("b.k")).select(F.col("a.k").alias("k"))


@query("join_self", """SELECT a.c_nationkey AS nation, count(*) AS pairs FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment = b.c_mktsegment GROUP BY a.c_nationkey""")
def _join_self(t: Tables) -> DataFrame:
    # each pair of distinct keys of a group once: n (n - 1) / 2, from counts instead of the pairs
    each = t.customer.where("c_nationkey IS NOT NULL AND c_mktsegment IS NOT NULL AND c_custkey IS NOT NULL").groupBy("c_nationkey", "c_mktsegment", "c_custkey").agg(F.count(F.lit(1)).alias("m"))
    groups = each.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("m")).alias("same"))
    return groups.groupBy(F.col("c_nationkey").alias("nation")).agg(F.sum(F.expr("(n * n - same) div 2")).alias("pairs")).where("pairs > 0")


@query("join_three_way", """SELECT c_custkey, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def _join_three_way(t: Tables) -> DataFrame:
    return t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")


@query("join_semi", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)""")
def _join_semi(t: Tables) -> DataFrame:
    return join(t.customer, t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "semi").select("c_custkey")


@query("join_anti", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)""")
def _join_anti(t: Tables) -> DataFrame:
    return join(t.customer, t.orders.filter("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "anti").select("c_custkey")


@query("agg_global", """SELECT count(*) AS n, round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders""")
def _agg_global(t: Tables) -> DataFrame:
    return aggregate(t.orders, [], n=F.count(F.lit(1)), s=F.round(total("o_totalprice"), 2), a=F.round(F.avg("o_totalprice"), 4), lo=F.min("o_totalprice"), hi=F.max("o_totalprice"))


@query("agg_global_empty", """SELECT count(*) AS n, sum(o_totalprice) AS s, min(o_orderstatus) AS lo FROM orders WHERE o_orderkey < 0""")
def _agg_global_empty(t: Tables) -> DataFrame:
    return aggregate(t.orders.filter("o_orderkey < 0"), [], n=F.count(F.lit(1)), s=total("o_totalprice"), lo=F.min("o_orderstatus"))


@query("agg_group_by", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS q, CAST(sum(l_linenumber) AS DOUBLE) AS lines, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def _agg_group_by(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_returnflag", "l_linestatus"], n=F.count(F.lit(1)), q=F.round(total("l_quantity"), 2), lines=total("l_linenumber"), d=F.round(F.avg("l_discount"), 6))


@query("agg_group_expr", """SELECT p_size % 10 AS bucket, count(*) AS n FROM part GROUP BY p_size % 10""")
def _agg_group_expr(t: Tables) -> DataFrame:
    return aggregate(t.part, [(F.col("p_size") % 10).alias("bucket")], n=F.count(F.lit(1)))


@query("agg_group_null", """SELECT k, count(*) AS n FROM (SELECT nullif(p_size, 7) AS k FROM part) GROUP BY k""")
def _agg_group_null(t: Tables) -> DataFrame:
    return aggregate(t.part.select(call("NULLIF", "p_size", F.lit(7)).alias("k")), ["k"], n=F.count(F.lit(1)))


@query("agg_min_max_text", """SELECT p_brand, min(p_name) AS lo, max(p_name) AS hi FROM part GROUP BY p_brand""")
def _agg_min_max_text(t: Tables) -> DataFrame:
    return aggregate(t.part, ["p_brand"], lo=F.min("p_name"), hi=F.max("p_name"))


@query("agg_count_distinct", """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS prices FROM orders GROUP BY o_orderstatus""")
def _agg_count_distinct(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_orderstatus"], customers=F.count_distinct("o_custkey"), prices=F.sum_distinct("o_custkey").cast("double"))


@query("agg_count_nulls", """SELECT p_brand, count(*) AS rows, count(s) AS known FROM (SELECT p_brand, nullif(p_size, 7) AS s FROM part) GROUP BY p_brand""")
def _agg_count_nulls(t: Tables) -> DataFrame:
    return aggregate(t.part.select("p_brand", call("NULLIF", "p_size", F.lit(7)).alias("s")), ["p_brand"], rows=F.count(F.lit(1)), known=F.count("s"))


@query("agg_having", """SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING count(*) > 10 AND round(sum(o_totalprice), 2) > 100000""")
def _agg_having(t: Tables) -> DataFrame:
    return aggregate(t.orders, ["o_custkey"], n=F.count(F.lit(1)), s=F.round(total("o_totalprice"), 2)).filter("n > 10 AND s > 100000")


@query("agg_expr_over_agg", """SELECT l_returnflag, round(sum(l_quantity) / count(*) + 1, 6) AS share, max(l_discount) - min(l_discount) AS spread FROM lineitem GROUP BY l_returnflag""")
def _agg_expr_over_agg(t: Tables) -> DataFrame:
    return aggregate(t.lineitem, ["l_returnflag"], share=F.round(total("l_quantity") / F.count(F.lit(1)) + 1, 6), spread=F.max("l_discount") - F.min("l_discount"))


@query("distinct_multi", """SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem""")
def _distinct_multi(t: Tables) -> DataFrame:
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("distinct_nulls", """SELECT DISTINCT nullif(p_size, 7) AS k FROM part""")
def _distinct_nulls(t: Tables) -> DataFrame:
    return t.part.select(call("NULLIF", "p_size", F.lit(7)).alias("k")).distinct()


@query("sort_multi_limit", """SELECT o_orderkey, o_orderstatus FROM orders ORDER BY o_orderstatus DESC NULLS FIRST, o_totalprice ASC NULLS LAST, o_orderkey LIMIT 25""")
def _sort_multi_limit(t: Tables) -> DataFrame:
    return limit_offset(order_by(t.orders, ("o_orderstatus", False), ("o_totalprice", True), "o_orderkey"), 25).select("o_orderkey", "o_orderstatus")


@query("sort_nulls_top", """SELECT p_partkey, nullif(p_size, 7) AS s FROM part ORDER BY s DESC NULLS FIRST, p_partkey LIMIT 60""")
def _sort_nulls_top(t: Tables) -> DataFrame:
    return limit_offset(order_by(t.part.select("p_partkey", call("NULLIF", "p_size", F.lit(7)).alias("s")), ("s", False), "p_partkey"), 60)


@query("sort_unselected", """SELECT c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 7""")
def _sort_unselected(t: Tables) -> DataFrame:
    return order_by(t.customer, ("c_acctbal", False), "c_custkey").limit(7).select("c_name")


@query("sort_by_aggregate", """SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 15""")
def _sort_by_aggregate(t: Tables) -> DataFrame:
    return order_by(aggregate(t.orders, ["o_custkey"], n=F.count(F.lit(1))), ("n", False), "o_custkey").limit(15)


@query("limit_offset", """SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 95""")
def _limit_offset(t: Tables) -> DataFrame:
    return limit_offset(order_by(t.customer, "c_custkey"), 10, 95).select("c_custkey")


@query("offset_only", """SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20""")
def _offset_only(t: Tables) -> DataFrame:
    return limit_offset(order_by(t.nation, "n_nationkey"), offset=20).select("n_nationkey")


@query("limit_zero", """SELECT * FROM nation LIMIT 0""")
def _limit_zero(t: Tables) -> DataFrame:
    return t.nation.limit(0)


@query("values_rows", """SELECT * FROM (VALUES (1, 'a'), (2, NULL), (3, 'c')) AS x(k, v)""")
def _values_rows(t: Tables) -> DataFrame:
    return values(t.spark, [(1, "a"), (2, None), (3, "c")], "k int, v string")


@query("empty_relation", """SELECT 1 + 1 AS two""")
def _empty_relation(t: Tables) -> DataFrame:
    return t.spark.range(1).select((F.lit(1) + 1).alias("two"))


@query("index_range_scan", """SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 200000""")
def _index_range_scan(t: Tables) -> DataFrame:
    return index_range(t.orders, "o_totalprice", 100000.0, 200000.0, high_inclusive=False).select("o_orderkey", "o_totalprice")


@query("index_seek", """SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey = 77""")
def _index_seek(t: Tables) -> DataFrame:
    return index_range(t.orders, "o_orderkey", 77, 77).select("o_orderkey", "o_custkey")


def engine(name: str, sql: str, *statements: str, result: str = "SELECT * FROM t") -> None:
    """Register statements that run one after another on a database of their own, then a query of it.

    The database lies below the session's shared folder.  It begins with the table nation as
    `n`, with its key, and an empty table `t` of the same columns.
    """

    def run(spark: SparkSession, folder: str) -> DataFrame:
        db = Database.create(spark, f"{shared_folder(spark)}/{name}")
        db.execute_batch([
            "CREATE TABLE n (n_nationkey INT PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INT)",
            "CREATE TABLE t (n_nationkey INT PRIMARY KEY, n_name TEXT NOT NULL, n_regionkey INT)",
        ])
        db.append("n", table(spark, folder, "nation").select("n_nationkey", "n_name", "n_regionkey"))
        for statement in statements:
            try:
                db.execute(statement)
            except ConstraintError:
                if not statement.startswith("INSERT INTO t VALUES (0"):  # the one that must be refused
                    raise
        return db.execute(result).rows

    _FOUND[name] = (run, sql)


_COPY = "INSERT INTO t SELECT * FROM n"
engine("insert_values", "SELECT * FROM (VALUES (1, 'a', 5), (2, 'b', NULL)) AS x(n_nationkey, n_name, n_regionkey)", "INSERT INTO t VALUES (1, 'a', 5), (2, 'b', NULL)", result="SELECT CAST(n_nationkey AS INT) AS n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM t")
engine("insert_select", "SELECT * FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation WHERE n_regionkey = 1", _COPY, "INSERT INTO t SELECT n_nationkey + 100, n_name, n_regionkey FROM n WHERE n_regionkey = 1")
engine("insert_defaults", "SELECT n_nationkey, n_name, 7 AS n_regionkey FROM nation", "ALTER TABLE t ALTER COLUMN n_regionkey SET DEFAULT 7", "INSERT INTO t (n_name, n_nationkey) SELECT n_name, n_nationkey FROM n", result="SELECT n_nationkey, n_name, CAST(n_regionkey AS INT) AS n_regionkey FROM t")
engine("update_where", "SELECT n_nationkey, CASE WHEN n_regionkey = 2 THEN n_name || '!' ELSE n_name END AS n_name, n_regionkey FROM nation", _COPY, "UPDATE t SET n_name = n_name || '!' WHERE n_regionkey = 2")
engine("update_all", "SELECT n_nationkey, n_name, n_regionkey + 10 AS n_regionkey FROM nation", _COPY, "UPDATE t SET n_regionkey = n_regionkey + 10")
engine("delete_where", "SELECT * FROM nation WHERE NOT coalesce(n_regionkey > 2, false)", _COPY, "DELETE FROM t WHERE n_regionkey > 2")
engine("delete_all", "SELECT * FROM nation WHERE false", _COPY, "DELETE FROM t")
engine("constraint_refused", "SELECT * FROM nation", _COPY, "INSERT INTO t VALUES (0, 'again', 1)")
engine("alter_add_column", "SELECT n_nationkey, n_name, n_regionkey, 'new' AS note FROM nation", _COPY, "ALTER TABLE t ADD COLUMN note TEXT DEFAULT 'new'")
engine("alter_drop_column", "SELECT n_nationkey, n_name FROM nation", _COPY, "ALTER TABLE t DROP COLUMN n_regionkey")
engine("unique_index_seek", "SELECT n_nationkey, n_name FROM nation WHERE n_name >= 'NATION_2'", _COPY, "CREATE UNIQUE INDEX by_name ON t (n_name)", result="SELECT n_nationkey, n_name FROM t WHERE n_name >= 'NATION_2'")
engine("drop_table", "SELECT count(*) AS n FROM nation", "DROP TABLE t", "CREATE TABLE t (k BIGINT)", "INSERT INTO t SELECT n_nationkey FROM n", result="SELECT count(*) AS n FROM t")


@query("set_union", """SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier""")
def _set_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("set_intersect", """SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier""")
def _set_intersect(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("set_except", """SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation""")
def _set_except(t: Tables) -> DataFrame:
    return t.part.select(F.col("p_size").alias("k")).subtract(t.nation.select("n_nationkey"))


@query("agg_rollup", """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)""")
def _agg_rollup(t: Tables) -> DataFrame:
    return t.customer.rollup("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


@query("window_rank", """SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS INTEGER) AS place FROM orders""")
def _window_rank(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")).alias("place"))


sql_query("subquery_from", """SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS x WHERE n > 12""")

sql_query("join_comma_where", """SELECT c_custkey, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal > 5000""")

sql_query("subquery_in", """SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")

@query("subquery_not_in", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000)""")
def _subquery_not_in(t: Tables) -> DataFrame:
    return not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_totalprice > 250000"), "o_custkey")


@query("subquery_not_in_null", """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 5) FROM orders WHERE o_orderkey < 100)""")
def _subquery_not_in_null(t: Tables) -> DataFrame:
    return not_in(t.customer.select("c_custkey"), "c_custkey", t.orders.filter("o_orderkey < 100").select(call("NULLIF", "o_custkey", F.lit(5)).alias("k")), "k")


sql_query("subquery_exists", """SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")

sql_query("subquery_not_exists", """SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)""")

sql_query("subquery_scalar", """SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)""")

sql_query("subquery_correlated", """SELECT o_orderkey FROM orders AS a WHERE o_totalprice >= (SELECT max(b.o_totalprice) FROM orders AS b WHERE b.o_custkey = a.o_custkey)""")

sql_query("cte_single", """WITH big AS (SELECT * FROM orders WHERE o_totalprice > 300000) SELECT o_orderstatus, count(*) AS n FROM big GROUP BY o_orderstatus""")

# both sides are counted by key before they meet
sql_query(
    "cte_multiple",
    """WITH f AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY o_custkey) SELECT f.o_custkey AS k, f.n * o.n AS n FROM f JOIN o ON f.o_custkey = o.o_custkey""",
    """WITH f AS (SELECT * FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT * FROM orders WHERE o_orderstatus = 'O') SELECT f.o_custkey AS k, count(*) AS n FROM f JOIN o ON f.o_custkey = o.o_custkey GROUP BY f.o_custkey""",
)

sql_query("cte_recursive", """WITH RECURSIVE up(k) AS (SELECT 1 AS k UNION ALL SELECT k + 1 FROM up WHERE k < 40) SELECT k, k * k AS square FROM up""")

sql_query("is_distinct_from", """SELECT p_partkey FROM part WHERE nullif(p_size, 7) IS NOT DISTINCT FROM NULL""")

sql_query("three_valued_logic", """SELECT p_partkey, (nullif(p_size, 7) > 3 AND p_size < 2) AS a, (nullif(p_size, 7) > 3 OR p_size > 2) AS o, NOT (nullif(p_size, 7) > 3) AS n FROM part""")

sql_query("filter_is_false", """SELECT p_partkey FROM part WHERE (nullif(p_size, 7) > 20) IS FALSE""")

sql_query("unary_plus_minus", """SELECT p_partkey, +p_size AS a, -(-p_size) AS b, - p_size + 3 * 2 AS c FROM part""")

sql_query("precedence_and_comments", """SELECT p_partkey, 1 + p_size * 2 - 4 AS a, p_size > 3 OR p_size < 2 AND p_size = 100 AS b -- AND binds first
FROM part -- the end""")

sql_query("agg_cube", """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY CUBE (c_nationkey, c_mktsegment)""")

sql_query("agg_grouping_sets", """SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_nationkey), (c_mktsegment), ())""")

sql_query("agg_filter", """SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS n FROM orders GROUP BY o_orderstatus""")


@query("join_merge", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def _join_merge(t: Tables) -> DataFrame:
    return t.orders.hint("merge").join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("join_shuffled_hash", """SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey""")
def _join_shuffled_hash(t: Tables) -> DataFrame:
    return t.orders.join(t.customer.hint("shuffle_hash"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


sql_query("complex_report", """SELECT c_name, n_name, count(*) AS orders_made, round(sum(o_totalprice), 2) AS spent FROM customer JOIN orders ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus <> 'P' AND c_acctbal > 0 GROUP BY c_name, n_name HAVING count(*) > 5 ORDER BY spent DESC, c_name LIMIT 20""")

sql_query("pricing_summary", """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""")

sql_query("revenue_by_nation", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE l_discount BETWEEN 0.02 AND 0.08 GROUP BY n_name""")

sql_query("top_parts", """SELECT p_brand, count(*) AS n, round(max(l_extendedprice), 2) AS top FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_size IN (3, 9, 14, 23) GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 10""")
