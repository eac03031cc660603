"""Relational queries by the DataFrame API, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators.positions import positions
from ..session import table

c = F.col
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, d: str) -> DataFrame:
            return f(lambda name: table(spark, d, name))

        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# -- scan, filter, project, sort, limit -----------------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_all(t):
    return t("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000 AND c_custkey <> 7 AND c_nationkey <= 20")
def filter_cmp(t):
    return t("customer").where((c("c_acctbal") > 5000) & (c("c_custkey") != 7) & (c("c_nationkey") <= 20)).select("c_custkey", "c_acctbal")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, -l_quantity AS neg, l_returnflag || '-' || l_linestatus AS flags FROM lineitem")
def project_arith(t):
    charge = c("l_extendedprice") * (1 - c("l_discount")) * (1 + c("l_tax"))
    return t("lineitem").select("l_orderkey", "l_linenumber", charge.alias("charge"), (-c("l_quantity")).alias("neg"), F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("flags"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_acctbal BETWEEN 1000 AND 2000 AND c_nationkey IN (1, 3, 5, 7) AND c_mktsegment NOT IN ('BUILDING')")
def filter_between_in(t):
    return t("customer").where(c("c_acctbal").between(1000, 2000) & c("c_nationkey").isin(1, 3, 5, 7) & ~c("c_mktsegment").isin("BUILDING")).select("c_custkey", "c_nationkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%' OR c_name LIKE '%99_'")
def filter_like(t):
    return t("customer").where(c("c_name").like("Customer#00000001%") | c("c_name").like("%99_")).select("c_custkey", "c_name")


@query("SELECT id, source_type FROM sources WHERE metadata IS NULL AND content IS NOT NULL")
def filter_null(t):
    return t("sources").where(c("metadata").isNull() & c("content").isNotNull()).select("id", "source_type")


@query("SELECT id, (user_id > 'usr_00000100') AND (action > 'm') AS a, (user_id > 'usr_00000100') OR (action > 'm') AS b, NOT (action > 'm') AS n FROM behavior_events WHERE (user_id > 'usr_00000100') OR (action = '')")
def filter_logic_3vl(t):
    u, a = c("user_id") > "usr_00000100", c("action") > "m"
    return t("behavior_events").where(u | (c("action") == "")).select("id", (u & a).alias("a"), (u | a).alias("b"), (~a).alias("n"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'final' WHEN 'O' THEN 'open' END AS status FROM orders")
def case_simple(t):
    return t("orders").select("o_orderkey", F.when(c("o_orderstatus") == "F", "final").when(c("o_orderstatus") == "O", "open").alias("status"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'medium' ELSE 'small' END AS size_class FROM orders")
def case_searched(t):
    return t("orders").select("o_orderkey", F.when(c("o_totalprice") > 300000, "large").when(c("o_totalprice") > 100000, "medium").otherwise("small").alias("size_class"))


@query("SELECT o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_orderkey AS DOUBLE) AS d, CAST(o_orderdate AS DATE) AS day, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS b, CAST('true' AS BOOLEAN) AS t FROM orders")
def cast_types(t):
    return t("orders").select("o_orderkey", c("o_orderkey").cast("string").alias("s"), c("o_orderkey").cast("double").alias("d"), c("o_orderdate").cast("date").alias("day"), c("o_orderkey").cast("string").cast("bigint").alias("b"), F.lit("true").cast("boolean").alias("t"))


@query(
    "WITH e AS (SELECT id, min(user_id) AS user_id FROM entities GROUP BY id) SELECT id, user_id, row_number() OVER (ORDER BY user_id ASC NULLS LAST, id) AS up, row_number() OVER (ORDER BY user_id DESC NULLS FIRST, id) AS down FROM e"
)
def sort_nulls(t):
    """All rows, with their places in ascending order (nulls last) and in descending order (nulls first)."""
    rows = t("entities").groupBy("id").agg(F.min("user_id").alias("user_id"))
    up = positions(rows, [F.asc_nulls_last("user_id"), F.asc("id")], "up")
    return positions(up, [F.desc_nulls_first("user_id"), F.asc("id")], "down")


@query("SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier ORDER BY s_nationkey ASC NULLS LAST, s_acctbal DESC NULLS FIRST, s_suppkey LIMIT 50")
def sort_multi(t):
    return t("supplier").select("s_suppkey", "s_nationkey", "s_acctbal").orderBy(F.asc_nulls_last("s_nationkey"), F.desc_nulls_first("s_acctbal"), "s_suppkey").limit(50)


@query("SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 10")
def limit_offset(t):
    return t("customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(20)


@query("SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
def select_distinct(t):
    return t("customer").select("c_mktsegment", "c_nationkey").distinct()


# -- functions --------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, abs(CAST(s_acctbal AS DOUBLE)) AS a, CAST(floor(s_acctbal) AS DOUBLE) AS f, CAST(ceil(s_acctbal) AS DOUBLE) AS ce, round(power(CAST(s_nationkey AS DOUBLE), 2.0), 6) AS p, round(sqrt(abs(s_acctbal)), 6) AS q FROM supplier")
def fn_math(t):
    return t("supplier").select("s_suppkey", S.abs_(c("s_acctbal")).alias("a"), S.floor_(c("s_acctbal")).alias("f"), S.ceil_(c("s_acctbal")).alias("ce"), F.round(S.power(c("s_nationkey"), F.lit(2)), 6).alias("p"), F.round(S.sqrt(F.abs("s_acctbal")), 6).alias("q"))


@query("SELECT s_suppkey, floor(s_acctbal * 10.0 + 0.5) / 10.0 AS r1, floor(-2.5 + 0.5) AS half_down, floor(s_acctbal + 0.5) AS r0 FROM supplier")
def fn_round_half_up(t):
    return t("supplier").select("s_suppkey", S.round_half_up(c("s_acctbal"), 1).alias("r1"), S.round_half_up(F.lit(-2.5)).alias("half_down"), S.round_half_up(c("s_acctbal")).alias("r0"))


@query("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_name) AS n, trim('  ' || p_type || ' ') AS tr, substring(p_name, 2, 5) AS sub, concat(p_brand, '/', p_type) AS cc FROM part")
def fn_string(t):
    return t("part").select("p_partkey", F.upper("p_name").alias("u"), F.lower("p_brand").alias("l"), S.length(c("p_name")).alias("n"), F.trim(F.concat(F.lit("  "), "p_type", F.lit(" "))).alias("tr"), S.substring(c("p_name"), 2, 5).alias("sub"), S.concat(c("p_brand"), F.lit("/"), c("p_type")).alias("cc"))


@query("SELECT id, coalesce(user_id, action, 'none') AS who, nullif(action, '') AS act, coalesce(nullif(user_id, ''), '?') AS u FROM behavior_events")
def fn_null(t):
    return t("behavior_events").select("id", F.coalesce("user_id", "action", F.lit("none")).alias("who"), F.nullif("action", F.lit("")).alias("act"), F.coalesce(F.nullif("user_id", F.lit("")), F.lit("?")).alias("u"))


@query("SELECT o_orderkey, o_orderkey // 7 AS q, (-o_orderkey) // 7 AS nq FROM orders")
def op_int_div(t):
    return t("orders").select("o_orderkey", S.int_div(c("o_orderkey"), F.lit(7)).alias("q"), S.int_div(-c("o_orderkey"), F.lit(7)).alias("nq"))


@query("SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) % 7.0 AS m, round(o_totalprice % 1000.0, 4) AS mp FROM orders")
def op_mod(t):
    return t("orders").select("o_orderkey", S.mod(c("o_orderkey"), F.lit(7)).alias("m"), F.round(S.mod(c("o_totalprice"), F.lit(1000.0)), 4).alias("mp"))


# -- joins ------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def join_inner(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey")).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT a.l_orderkey, a.l_linenumber, b.l_quantity AS q FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber AND a.l_quantity < b.l_quantity + 1 WHERE a.l_discount > 0.05")
def join_multi_key(t):
    a = t("lineitem").where("l_discount > 0.05").select("l_orderkey", "l_linenumber", c("l_quantity").alias("qa"))
    b = t("lineitem").select("l_orderkey", "l_linenumber", c("l_quantity").alias("q"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where(c("qa") < c("q") + 1).select("l_orderkey", "l_linenumber", "q")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000")
def join_left(t):
    return t("customer").join(t("orders").where("o_totalprice > 400000"), c("c_custkey") == c("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 8000")
def join_right(t):
    return t("supplier").where("s_acctbal > 8000").join(t("nation"), c("s_nationkey") == c("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) c FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) s ON c_custkey = s_suppkey")
def join_full(t):
    return t("customer").where("c_acctbal > 9000").join(t("supplier").where("s_acctbal > 5000"), c("c_custkey") == c("s_suppkey"), "full").select("c_custkey", "s_suppkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    return t("region").crossJoin(t("nation")).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation a JOIN region b ON a.n_regionkey > b.r_regionkey")
def join_theta(t):
    return t("nation").join(t("region"), c("n_regionkey") > c("r_regionkey")).select(c("n_nationkey").alias("a"), c("r_regionkey").alias("b"))


@query("SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) JOIN (SELECT n_regionkey AS k, n_name FROM nation) USING (k)")
def join_using(t):
    return t("region").select(c("r_regionkey").alias("k"), "r_name").join(t("nation").select(c("n_regionkey").alias("k"), "n_name"), ["k"])


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def join_self(t):
    a, b = t("supplier").alias("a"), t("supplier").alias("b")
    return a.join(b, (c("a.s_nationkey") == c("b.s_nationkey")) & (c("a.s_suppkey") < c("b.s_suppkey"))).select(c("a.s_suppkey").alias("a"), c("b.s_suppkey").alias("b"))


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def join_semi(t):
    return t("customer").join(t("orders").where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(t):
    return t("customer").join(t("orders").where("o_totalprice > 200000"), c("c_custkey") == c("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT r_name, c_mktsegment, round(sum(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def join_4way(t):
    geo = t("nation").join(t("region"), c("n_regionkey") == c("r_regionkey")).select("n_nationkey", "r_name")
    cust = t("customer").join(geo, c("c_nationkey") == c("n_nationkey")).select("c_custkey", "r_name", "c_mktsegment")
    # orders are added up by customer before they meet the rest: one row a customer is shuffled on
    spent = t("orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    return cust.join(spent, c("c_custkey") == c("o_custkey")).groupBy("r_name", "c_mktsegment").agg(F.round(F.sum("spent"), 2).alias("total"))


# -- aggregates and windows -------------------------------------------------------------------------------------


@query("SELECT count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS q, round(avg(l_extendedprice), 4) AS p, min(l_shipdate) AS lo, max(l_shipdate) AS hi FROM lineitem")
def agg_global(t):
    return t("lineitem").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"), F.round(F.avg("l_extendedprice"), 4).alias("p"), F.min("l_shipdate").alias("lo"), F.max("l_shipdate").alias("hi"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY 1, 2")
def agg_group(t):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(c("l_extendedprice") * (1 - c("l_discount"))), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("disc"))


@query("SELECT o_orderpriority, count(DISTINCT o_custkey) AS n, CAST(sum(DISTINCT o_custkey) AS DOUBLE) AS s FROM orders GROUP BY 1")
def agg_distinct(t):
    return t("orders").groupBy("o_orderpriority").agg(F.count_distinct("o_custkey").alias("n"), F.sum_distinct("o_custkey").cast("double").alias("s"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12")
def agg_having(t):
    return t("orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).where("n > 12")


@query("SELECT year(o_orderdate) AS y, month(o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2")
def agg_expr_key(t):
    return t("orders").groupBy(F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_mktsegment, round(sum(c_acctbal) / count(*), 6) AS mean, round((max(c_acctbal) - min(c_acctbal)) * 2, 4) AS spread FROM customer GROUP BY 1")
def agg_post_arith(t):
    return t("customer").groupBy("c_mktsegment").agg(F.round(F.sum("c_acctbal") / F.count(F.lit(1)), 6).alias("mean"), F.round((F.max("c_acctbal") - F.min("c_acctbal")) * 2, 4).alias("spread"))


@query("SELECT count(*) AS n, count(c_acctbal) AS k, CAST(sum(c_acctbal) AS DOUBLE) AS s, max(c_name) AS m FROM customer WHERE c_custkey < 0")
def agg_empty(t):
    return t("customer").where("c_custkey < 0").agg(F.count(F.lit(1)).alias("n"), F.count("c_acctbal").alias("k"), F.sum("c_acctbal").alias("s"), F.max("c_name").alias("m"))


@query("SELECT o_custkey, o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS dr, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def win_rank(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    return t("orders").select("o_custkey", "o_orderkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")).alias("rn"))


@query("SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
def win_running_sum(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return t("orders").select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("running"))


@query("SELECT c_custkey, round(c_acctbal - avg(c_acctbal) OVER (PARTITION BY c_nationkey), 4) AS diff, count(*) OVER (PARTITION BY c_nationkey) AS peers FROM customer")
def win_agg_partition(t):
    # the partition's aggregates are joined back instead of a window: few nations would leave few tasks
    per = t("customer").groupBy("c_nationkey").agg(F.avg("c_acctbal").alias("mean"), F.count(F.lit(1)).alias("peers"))
    return t("customer").join(per, "c_nationkey").select("c_custkey", F.round(c("c_acctbal") - c("mean"), 4).alias("diff"), "peers")


# -- sets, subqueries, common table expressions -----------------------------------------------------------------


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t("customer").select(c("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t("customer").select(c("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 3000")
def intersect(t):
    return t("customer").select(c("c_nationkey").alias("k")).intersect(t("supplier").where("s_acctbal > 3000").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def except_(t):
    return t("customer").select(c("c_custkey").alias("k")).subtract(t("orders").where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t("customer").select(c("c_nationkey").alias("k")).exceptAll(t("supplier").select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t("customer").select(c("c_nationkey").alias("k")).intersectAll(t("supplier").select("s_nationkey"))


def _sql(name: str, spark_sql: str, oracle: str | None = None, tables: tuple[str, ...] = ("customer", "orders", "nation", "region", "supplier")) -> None:
    """A query that is run as SQL text by the dialect's front end."""
    from ..sources.catalog import Catalog
    from ..sql.frontend import Engine

    def run(spark: SparkSession, d: str) -> DataFrame:
        cat = Catalog(spark)
        for n in tables:
            cat.register(n, table(spark, d, n))
        return Engine(spark, cat).query(spark_sql)

    QUERIES[name] = run
    ORACLE[name] = oracle or spark_sql


_sql("cte", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE s > 1000000) SELECT c_name, round(s, 2) AS s FROM top JOIN customer ON c_custkey = o_custkey")
_sql("subquery_from", "SELECT t.k, t.n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey) AS t WHERE t.n > 8")
_sql("subquery_in", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000) AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
_sql("subquery_exists", "SELECT s_suppkey FROM supplier WHERE EXISTS (SELECT 1 FROM customer WHERE c_nationkey = s_nationkey AND c_acctbal > 9000)")
_sql("subquery_scalar", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)")
_sql("lateral", "SELECT n_name, t.c_custkey, t.c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey ORDER BY c_acctbal DESC, c_custkey LIMIT 2) AS t")
_sql("natural_join", "SELECT k, a, b FROM (SELECT n_regionkey AS k, n_name AS a FROM nation) AS x NATURAL JOIN (SELECT r_regionkey AS k, r_name AS b FROM region) AS y")
_sql(
    "sql_frontend_flagship",
    'SELECT c.c_mktsegment AS \'segment\', count(*) AS n, round(sum(o.o_totalprice), 2) AS "revenue", sum(o.o_orderkey) / count(*) AS mean_key FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000.5 GROUP BY c.c_mktsegment ORDER BY "revenue" DESC OFFSET 1 LIMIT 3',
    "SELECT c.c_mktsegment AS segment, count(*) AS n, round(sum(o.o_totalprice), 2) AS revenue, CAST(sum(o.o_orderkey) AS DOUBLE) / count(*) AS mean_key FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 1000.5 GROUP BY 1 ORDER BY revenue DESC LIMIT 3 OFFSET 1",
)
_sql("sql_sum_int", "SELECT o_orderstatus, SUM(o_custkey) AS total, SUM(o_custkey) / COUNT(*) AS mean, COUNT(*) / 7 AS sevenths FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, CAST(sum(o_custkey) AS DOUBLE) AS total, CAST(sum(o_custkey) AS DOUBLE) / count(*) AS mean, count(*) // 7 AS sevenths FROM orders GROUP BY 1")
_sql("sql_mod", "SELECT o_orderkey, o_orderkey % 7 AS m, -o_orderkey % 5 AS n, o_orderkey / 3 AS third, o_totalprice / 3 AS part, (o_orderkey + 1) / 2 * 2 AS even FROM orders", "SELECT o_orderkey, CAST(o_orderkey AS DOUBLE) % 7 AS m, CAST(-o_orderkey AS DOUBLE) % 5 AS n, o_orderkey // 3 AS third, o_totalprice / 3 AS part, (o_orderkey + 1) // 2 * 2 AS even FROM orders")
_sql("sql_round", "SELECT c_custkey, ROUND(c_acctbal) AS r, ROUND(c_custkey - 3.5) AS h, ROUND(c_acctbal / 7, 2) AS d, ABS(c_custkey - 70) AS a, FLOOR(c_acctbal) AS f, CEIL(c_custkey / 2.0) AS k FROM customer", "SELECT c_custkey, floor(c_acctbal + 0.5)::DOUBLE AS r, floor(CAST(c_custkey AS DOUBLE) - 3.5 + 0.5) AS h, floor(c_acctbal / 7 * 100 + 0.5) / 100 AS d, abs(c_custkey - 70)::DOUBLE AS a, floor(c_acctbal)::DOUBLE AS f, ceil(c_custkey / 2.0)::DOUBLE AS k FROM customer")
_sql("sql_decimal_div", "SELECT o_orderkey, CAST(CAST(o_orderkey AS DECIMAL(12,2)) / 2 AS DOUBLE) AS half, o_orderkey / 2 AS whole, 'a OFFSET 5 LIMIT 3' AS s FROM orders", "SELECT o_orderkey, o_orderkey / 2.0::DOUBLE AS half, o_orderkey // 2 AS whole, 'a OFFSET 5 LIMIT 3' AS s FROM orders")
_sql("values_no_from", "SELECT 1 AS one, 'it''s' AS s, 2.5 AS d", "SELECT 1 AS one, 'it''s' AS s, CAST(2.5 AS DOUBLE) AS d")


@query(
    """SELECT 'o_orderkey' AS column_name, count(*) AS n_rows, count(DISTINCT o_orderkey) AS n_distinct, count(*) - count(o_orderkey) AS n_null FROM orders
UNION ALL SELECT 'o_custkey', count(*), count(DISTINCT o_custkey), count(*) - count(o_custkey) FROM orders
UNION ALL SELECT 'o_orderstatus', count(*), count(DISTINCT o_orderstatus), count(*) - count(o_orderstatus) FROM orders"""
)
def table_stats(t):
    from ..sources.catalog import statistics

    return statistics(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus"))


QUERIES["except"] = QUERIES.pop("except_")
ORACLE["except"] = ORACLE.pop("except_")


def csv_infer(spark: SparkSession, d: str) -> DataFrame:
    """The nations written as CSV text and read back with inferred types."""
    from ..sources.csv import read_csv_string

    rows = table(spark, d, "nation").orderBy("n_nationkey").collect()  # a fixed table of 25 rows
    return read_csv_string(spark, "n_nationkey,n_name,n_regionkey\n" + "\n".join(f'{r.n_nationkey},"{r.n_name}",{r.n_regionkey}' for r in rows))


QUERIES["csv_infer"] = csv_infer
ORACLE["csv_infer"] = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
