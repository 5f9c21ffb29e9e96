"""The relational surface: one query an operator family, as Spark SQL, with its DuckDB form.

Where both dialects agree a query is written once. Tables are temporary views made for the call from the
Parquet files, so Catalyst sees scans and prunes columns, partitions and row groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events embeddings".split()

#: Name -> SQL that Spark and DuckDB read alike, or (Spark, DuckDB).
SQL: dict[str, str | tuple[str, str]] = {
    "project_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority, length(o_orderpriority) AS n FROM orders",
    "filter_predicates": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 90000 AND o_orderstatus IN ('F', 'O') AND o_orderpriority LIKE '%U%' AND o_custkey IS NOT NULL AND o_orderstatus IS DISTINCT FROM 'P'",
    "filter_regex": ("SELECT p_partkey, p_name FROM part WHERE p_type RLIKE '^[A-M].*' OR p_name ILIKE '%9%'", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_type, '^[A-M].*') OR p_name ILIKE '%9%'"),
    "join_inner": "SELECT n.n_name, r.r_name, count(*) AS customers FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey GROUP BY n.n_name, r.r_name",
    "join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 300000 GROUP BY c.c_custkey",
    "join_full": "SELECT s.s_suppkey, c.c_custkey FROM supplier s FULL OUTER JOIN customer c ON s.s_suppkey = c.c_custkey",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000", "SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"),
    "subquery_exists": "SELECT s_suppkey FROM supplier s WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = s.s_suppkey AND l.l_quantity > 45)",
    "subquery_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "subquery_scalar": "SELECT o_orderkey FROM orders o WHERE o_totalprice > (SELECT 1.5 * avg(o_totalprice) FROM orders i WHERE i.o_orderstatus = o.o_orderstatus)",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_theta": "SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    # Spark numbers the rows of a lateral ORDER BY ... LIMIT in a window without that order, in which fetched shuffle blocks fall as they come; so the window is written out
    "join_lateral": (
        "SELECT c.c_custkey, t.o_orderkey FROM customer c JOIN (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM orders) t ON t.o_custkey = c.c_custkey AND t.place <= 2",
        "SELECT c.c_custkey, t.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2) t",
    ),
    "agg_basic": "SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS s, min(l_shipdate) AS lo, max(l_extendedprice) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "agg_statistics": "SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS co, median(l_quantity) AS md FROM lineitem GROUP BY l_returnflag",
    "agg_by_extreme": "SELECT o_custkey, max_by(o_orderkey, o_totalprice) AS dearest, min_by(o_orderkey, o_totalprice) AS cheapest, bool_or(o_orderstatus = 'F') AS f, bool_and(o_totalprice > 1000) AS g FROM orders GROUP BY o_custkey",
    "agg_list": ("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey"),
    "agg_distinct_filter": "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS big FROM events GROUP BY event_type",
    "agg_grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, grouping(l_returnflag) AS g FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "agg_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "agg_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "agg_group_by_all": "SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_quantiles": "SELECT l_returnflag, percentile_cont(0.25) WITHIN GROUP (ORDER BY l_extendedprice) AS c, percentile_disc(0.5) WITHIN GROUP (ORDER BY l_quantity) AS d FROM lineitem GROUP BY l_returnflag",
    "window_ranking": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(4) OVER w AS nt, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)",
    "window_offsets": "SELECT event_id, lag(value, 1) OVER w AS before, lead(event_type, 2) OVER w AS later, first_value(value) OVER w AS f, nth_value(event_id, 2) OVER w AS n2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "window_rows_frame": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s FROM events",
    "window_range_interval": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "window_ignore_nulls": ("SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events", "SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS v FROM events"),
    "window_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 2", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2"),
    "window_exclude_current": ("SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey) - o_totalprice, 2) AS others FROM orders", "SELECT o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0), 2) AS others FROM orders"),
    "sort_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    "sort_nulls": ("SELECT c, rn FROM (SELECT c, row_number() OVER (ORDER BY c ASC NULLS LAST, k) AS rn FROM (SELECT nullif(n_regionkey, 2) AS c, n_nationkey AS k FROM nation))",) * 2,
    "set_union": "SELECT o_custkey AS k FROM orders UNION SELECT s_suppkey FROM supplier",
    "set_union_all": "SELECT n_name AS x FROM nation UNION ALL SELECT r_name FROM region",
    "set_intersect_all": "SELECT l_suppkey AS k FROM lineitem INTERSECT ALL SELECT s_suppkey FROM supplier",
    "set_except_all": "SELECT c_custkey AS k FROM customer EXCEPT ALL SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "cte_recursive": "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 40) SELECT n, n * n AS sq FROM t",
    "pivot": ("SELECT * FROM (SELECT event_type, user_id FROM events) PIVOT (count(1) FOR event_type IN ('click' AS click, 'view' AS view, 'purchase' AS purchase))", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY user_id"),
    "unpivot": ("SELECT o_orderkey, k, v FROM (SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS cust, o_totalprice AS price FROM orders) UNPIVOT (v FOR k IN (cust, price))", "SELECT o_orderkey, 'cust' AS k, CAST(o_custkey AS DOUBLE) AS v FROM orders UNION ALL SELECT o_orderkey, 'price', o_totalprice FROM orders"),
    "fn_string": "SELECT p_partkey, concat(p_brand, '-', p_type) AS c, substr(p_name, 2, 4) AS s, upper(p_name) AS u, trim(p_type) AS t, replace(p_type, 'E', '_') AS r, lpad(CAST(p_size AS VARCHAR(9)), 5, '0') AS l, length(p_name) AS n, p_name LIKE 'p%' AS w, reverse(p_brand) AS v FROM part",
    "fn_datetime": ("SELECT event_id, date_trunc('hour', ts) AS h, extract(year FROM ts) AS y, extract(month FROM ts) AS m, dayofmonth(ts) AS d, ts + INTERVAL 90 MINUTE AS later, date_format(ts, 'yyyy-MM-dd HH:mm') AS f, datediff(ts, DATE '2024-01-01') AS days FROM events", "SELECT event_id, date_trunc('hour', ts) AS h, CAST(extract(year FROM ts) AS INT) AS y, CAST(extract(month FROM ts) AS INT) AS m, CAST(day(ts) AS INT) AS d, ts + INTERVAL 90 MINUTE AS later, strftime(ts, '%Y-%m-%d %H:%M') AS f, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INT) AS days FROM events"),
    "fn_math": "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, CAST(floor(l_extendedprice) AS BIGINT) AS f, CAST(ceil(l_tax * 100) AS BIGINT) AS c, round(sqrt(l_quantity), 6) AS q, round(ln(l_extendedprice), 6) AS n, l_orderkey % 7 AS m, greatest(l_discount, l_tax) AS g, l_linenumber & 3 AS b FROM lineitem",
    "fn_array": ("SELECT vec_id, size(embedding) AS n, embedding[0] AS first, round(aggregate(embedding, 0D, (a, x) -> a + x), 4) AS s, size(filter(embedding, x -> x > 0)) AS pos, element_at(array_sort(embedding), 1) AS least FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INT) AS n, embedding[1] AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS s, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT) AS pos, list_min(embedding) AS least FROM embeddings"),
    "fn_unnest": ("SELECT vec_id, pos, v FROM embeddings LATERAL VIEW posexplode(slice(embedding, 1, 3)) t AS pos, v", "SELECT vec_id, CAST(pos - 1 AS INT) AS pos, embedding[pos] AS v FROM embeddings, (SELECT unnest([1, 2, 3]) AS pos)"),
    "fn_struct_map": ("SELECT n_nationkey, s.a AS a, s.b AS b, element_at(map(n_name, n_regionkey), n_name) AS m FROM (SELECT n_nationkey, n_name, n_regionkey, named_struct('a', n_name, 'b', n_regionkey * 2) AS s FROM nation)", "SELECT n_nationkey, s.a AS a, s.b AS b, m[n_name] AS m FROM (SELECT n_nationkey, n_name, MAP {n_name: n_regionkey} AS m, {'a': n_name, 'b': n_regionkey * 2} AS s FROM nation)"),
    "fn_json": ("SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k FROM events", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events"),
    "fn_binary": ("SELECT n_nationkey, hex(n_name) AS h, octet_length(encode(n_name, 'UTF-8')) AS o FROM nation", "SELECT n_nationkey, hex(encode(n_name)) AS h, CAST(octet_length(encode(n_name)) AS INT) AS o FROM nation"),
    "fn_conditional": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'low' ELSE 'high' END AS band, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS seg, TRY_CAST(c_name AS INT) AS t FROM customer",
}


def _query(text: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        for name in TABLES:
            if name in text:
                spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
        return spark.sql(text)

    return run


QUERIES = {f"sql_{k}": _query(v if isinstance(v, str) else v[0]) for k, v in SQL.items()}
ORACLES = {f"sql_{k}": v if isinstance(v, str) else v[1] for k, v in SQL.items()}
