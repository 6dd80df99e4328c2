"""The catalogue of queries over the driver's tables: one text in the PostgreSQL dialect each, which the engine rewrites for
Spark, and the SQL that checks it (the same text where that runs there as it is).

Sums of prices go through DECIMAL, so they do not depend on the order of rows; counts and lengths are cast to BIGINT."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from querywright.operators.facts import mentions
from querywright.plans.dml import after, returning
from querywright.plans.parser import parse
from querywright.plans.spark_sql import run
from querywright.session import TABLES, load_tables

M = "CAST(sum(CAST({} AS DECIMAL(12,2))) AS DOUBLE PRECISION)"
TOTAL, SPENT = M.format("o_totalprice"), M.format("l_extendedprice")

#: name -> text for both sides, or (text, text that checks it).
QUERIES: dict[str, str | tuple[str, str]] = {
    # projections, filters, predicates
    "proj_filter": "SELECT p_partkey, p_name AS name, p_retailprice * 2 AS doubled FROM part WHERE p_size > 25 AND p_retailprice < 1500",
    "star_qualified": "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey",
    "pred_in_between_like": "SELECT p_partkey, p_brand, p_size FROM part WHERE p_size BETWEEN 5 AND 20 AND p_brand IN ('Brand#11', 'Brand#12', 'Brand#23', 'Brand#34') AND p_type LIKE '%A%' AND p_size NOT IN (7, 9)",
    "pred_ilike_not": "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND NOT p_type LIKE '%B%' AND p_name NOT ILIKE '%zzz%'",
    "pred_null_truth": "SELECT o_orderkey, (nullif(o_orderstatus, 'O') IS NULL) AS is_open, ((o_totalprice > 1000) IS TRUE) AS big, ((nullif(o_orderstatus, 'F') = 'O') IS UNKNOWN) AS unknown_, ((o_totalprice < 500) IS NOT FALSE) AS small_ FROM orders",
    "pred_distinct_from": "SELECT o_orderkey, (nullif(o_orderstatus, 'O') IS DISTINCT FROM nullif(o_orderpriority, '1-URGENT')) AS differs, (o_orderstatus IS NOT DISTINCT FROM 'F') AS is_f FROM orders",
    "pred_similar": ("SELECT p_partkey FROM part WHERE p_brand SIMILAR TO 'Brand#(1|2)_'", "SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).')"),
    "pred_regex": ("SELECT p_partkey FROM part WHERE p_brand ~ '#[12]3$' OR p_name ~* '^A'", "SELECT p_partkey FROM part WHERE regexp_matches(p_brand, '#[12]3$') OR regexp_matches(p_name, '^A', 'i')"),
    "arithmetic": "SELECT p_partkey, p_size + 1 AS a, p_size - 3 AS b, p_size * 2 AS c, p_size % 7 AS d, -p_size AS e, p_retailprice / 4 AS f FROM part",
    "arithmetic_integer": ("SELECT p_partkey, p_size / 7 AS a, -p_size / 7 AS b, (p_size + 1) / 2 AS c, p_size / 2.0::double precision AS d, CASE WHEN p_size / 10 = 2 THEN p_size / 3 ELSE 0 END AS e, 7 / 2 AS f FROM part WHERE p_size / 5 > 1", "SELECT p_partkey, CAST(p_size // 7 AS BIGINT) AS a, CAST(-(p_size // 7) AS BIGINT) AS b, CAST((p_size + 1) // 2 AS BIGINT) AS c, p_size / 2.0 AS d, CAST(CASE WHEN p_size // 10 = 2 THEN p_size // 3 ELSE 0 END AS BIGINT) AS e, CAST(3 AS BIGINT) AS f FROM part WHERE p_size // 5 > 1"),
    "arithmetic_bits": ("SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS b, p_size # 5 AS c, ~p_size AS d, p_size << 2 AS e, p_size >> 1 AS f FROM part", "SELECT p_partkey, p_size & 12 AS a, p_size | 3 AS b, xor(p_size, 5) AS c, ~p_size AS d, p_size << 2 AS e, p_size >> 1 AS f FROM part"),
    "case_searched": "SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 50000 THEN 'mid' ELSE 'low' END AS band FROM orders",
    "case_simple": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS code FROM orders",
    "cast_types": "SELECT o_orderkey::text AS k, CAST(o_orderdate AS date) AS d, o_totalprice::numeric(14,1)::double precision AS p, CAST('12' AS integer) AS i, CAST(o_orderkey AS bigint) AS b FROM orders",
    "try_cast": "SELECT p_partkey, TRY_CAST(replace(p_brand, 'Brand#', '') AS INTEGER) AS n, TRY_CAST(p_name AS INTEGER) AS none FROM part",
    "concat_op": "SELECT p_partkey, p_brand || '-' || p_type AS label FROM part",
    "str_funcs": ("SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, left(p_name, 3) AS le, right(p_name, 3) AS ri, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, reverse(p_brand) AS rev, repeat('ab', 2) AS rep, replace(p_brand, '#', '') AS r, md5(p_name) AS m, CAST(strpos(p_brand, '#') AS BIGINT) AS pos, concat(p_brand, NULL, 'x') AS c, CAST(octet_length(p_brand) AS BIGINT) AS o FROM part",
                  "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, CAST(length(p_name) AS BIGINT) AS n, left(p_name, 3) AS le, right(p_name, 3) AS ri, lpad(p_brand, 12, '*') AS lp, rpad(p_brand, 12, '*') AS rp, reverse(p_brand) AS rev, repeat('ab', 2) AS rep, replace(p_brand, '#', '') AS r, md5(p_name) AS m, CAST(strpos(p_brand, '#') AS BIGINT) AS pos, concat(p_brand, NULL, 'x') AS c, CAST(strlen(p_brand) AS BIGINT) AS o FROM part"),
    "str_initcap": ("SELECT p_partkey, initcap(lower(p_type)) AS t FROM part", "SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_type), ' '), lambda w: upper(w[1]) || substr(w, 2)), ' ') AS t FROM part"),
    "overlay_position_substring_trim": ("SELECT p_partkey, OVERLAY(p_brand PLACING 'XX' FROM 1 FOR 2) AS o, CAST(POSITION('#' IN p_brand) AS BIGINT) AS p, SUBSTRING(p_name FROM 2 FOR 3) AS s, TRIM(BOTH 'B' FROM p_brand) AS t, TRIM(LEADING 'B' FROM p_brand) AS tl, trim(p_name) AS tt FROM part",
                                        "SELECT p_partkey, 'XX' || substring(p_brand, 3) AS o, CAST(POSITION('#' IN p_brand) AS BIGINT) AS p, SUBSTRING(p_name, 2, 3) AS s, TRIM(p_brand, 'B') AS t, LTRIM(p_brand, 'B') AS tl, trim(p_name) AS tt FROM part"),
    "math_funcs": ("SELECT p_partkey, abs(-p_retailprice) AS a, round(sqrt(p_size), 6) AS s, round(power(p_size, 2), 3) AS p, round(ln(p_size), 6) AS l, round(log(p_size), 6) AS lg, round(exp(p_size / 50.0), 6) AS e, round(sin(p_size) + cos(p_size) + atan2(p_size, 2), 6) AS t, CAST(sign(p_size - 25) AS BIGINT) AS g, CAST(mod(p_size, 5) AS BIGINT) AS m, round(degrees(p_size), 4) AS d FROM part",
                   "SELECT p_partkey, abs(-p_retailprice) AS a, round(sqrt(p_size), 6) AS s, round(power(p_size, 2), 3) AS p, round(ln(p_size), 6) AS l, round(log10(p_size), 6) AS lg, round(exp(CAST(p_size AS DOUBLE) / 50.0), 6) AS e, round(sin(p_size) + cos(p_size) + atan2(p_size, 2), 6) AS t, CAST(sign(p_size - 25) AS BIGINT) AS g, CAST(mod(p_size, 5) AS BIGINT) AS m, round(degrees(p_size), 4) AS d FROM part"),
    "ceil_floor_round": ("SELECT p_partkey, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, CAST(trunc(CAST(p_retailprice AS DECIMAL(12,2)), 1) AS DOUBLE PRECISION) AS t FROM part",
                         "SELECT p_partkey, CAST(CEIL(p_retailprice) AS BIGINT) AS c, CAST(FLOOR(p_retailprice) AS BIGINT) AS f, round(p_retailprice, 1) AS r, CAST(floor(CAST(p_retailprice AS DECIMAL(12,2)) * 10) AS DOUBLE) / 10 AS t FROM part"),
    "cond_funcs": "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'O'), 'none') AS c, ifnull(nullif(o_orderpriority, '5-LOW'), 'low') AS i, greatest(o_totalprice, 50000.0) AS g, least(o_totalprice, 50000.0) AS l FROM orders",
    "date_extract": "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m, CAST(extract(DAY FROM o_orderdate) AS BIGINT) AS d, CAST(extract(DOW FROM o_orderdate) AS BIGINT) AS w, CAST(extract(QUARTER FROM o_orderdate) AS BIGINT) AS q, CAST(extract(DOY FROM o_orderdate) AS BIGINT) AS n FROM orders",
    "date_interval": "SELECT o_orderkey, o_orderdate + INTERVAL '30 days' AS later, CAST(o_orderdate - INTERVAL '2 months' AS date) AS earlier, date_trunc('month', o_orderdate) AS first_day FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01 00:00:00'",
    "epoch": ("SELECT event_id, CAST(floor(extract(EPOCH FROM ts)) AS BIGINT) AS s FROM events", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS s FROM events"),
    "tz_convert": ("SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local_ts FROM events", "SELECT event_id, (ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York' AS local_ts FROM events"),
    "json_extract": ("SELECT event_id, props ->> 'k' AS k, (props::jsonb ->> 'k')::integer AS n, props::jsonb ? 'k' AS has_k, props::jsonb ? 'zz' AS has_zz FROM events",
                     "SELECT event_id, props ->> 'k' AS k, CAST(props ->> 'k' AS INTEGER) AS n, json_exists(props, 'k') AS has_k, json_exists(props, 'zz') AS has_zz FROM events"),
    "json_path": ("SELECT event_id, props::jsonb #>> '{k}' AS k, (props::jsonb #> '{k}') IS NULL AS no_k FROM events", "SELECT event_id, props ->> 'k' AS k, (props -> 'k') IS NULL AS no_k FROM events"),
    "json_contains": ("SELECT event_id FROM events WHERE props::jsonb @> '{\"k\": 42}'", "SELECT event_id FROM events WHERE CAST(props ->> 'k' AS INTEGER) = 42"),
    "array_ops": ("SELECT event_id, ARRAY[user_id, event_id] AS a, (ARRAY[user_id, event_id])[2] AS second, (ARRAY['a', event_type, 'c'])[2:3] AS tail FROM events", "SELECT event_id, [user_id, event_id] AS a, event_id AS second, [event_type, 'c'] AS tail FROM events"),
    "array_text": ("SELECT n_nationkey, array_length(ARRAY[n_name, 'x'], 1) AS n, array_to_string(ARRAY[n_name, 'x', 'y'], '-') AS s, string_to_array(n_name, 'A') AS p FROM nation", "SELECT n_nationkey, CAST(2 AS INTEGER) AS n, n_name || '-x-y' AS s, string_split(n_name, 'A') AS p FROM nation"),
    "array_any": ("SELECT event_id FROM events WHERE event_type = ANY(ARRAY['click', 'view']) AND user_id > ALL(ARRAY[1, 2])", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND user_id > 2"),
    "array_overlap": ("SELECT event_id FROM events WHERE ARRAY[event_type, 'x'] && ARRAY['click', 'purchase'] AND ARRAY[event_type, 'y'] @> ARRAY['y']", "SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')"),
    "tuple_compare": "SELECT p_partkey FROM part WHERE (p_size, p_partkey) < (CAST(10 AS INTEGER), CAST(500 AS BIGINT))",
    "collate_c": ("SELECT p_partkey, (p_name COLLATE \"C\" < 'm') AS early FROM part", "SELECT p_partkey, (p_name < 'm') AS early FROM part"),
    # joins
    "join_inner": "SELECT c.c_name, o.o_orderkey FROM customer c INNER JOIN orders o ON c.c_custkey = o.o_custkey WHERE o.o_totalprice > 100000",
    "join_left": "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P' AND o.o_totalprice > 100000",
    "join_right": "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT OUTER JOIN customer c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'",
    "join_full": "SELECT a.n_name AS left_name, b.n_name AS right_name FROM (SELECT * FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT * FROM nation WHERE n_nationkey > 10) b ON a.n_nationkey = b.n_nationkey",
    "join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n",
    "join_comma": "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey",
    "join_natural": "SELECT * FROM (SELECT r_regionkey AS k, r_name FROM region) a NATURAL JOIN (SELECT n_regionkey AS k, n_name FROM nation) b",
    "join_using": "SELECT k, r_name, n_name FROM (SELECT r_regionkey AS k, r_name FROM region) a JOIN (SELECT n_regionkey AS k, n_name FROM nation) b USING (k)",
    "join_semi": ("SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')"),
    "join_anti": ("SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')"),
    "join_right_semi": ("SELECT c_custkey FROM orders RIGHT SEMI JOIN customer ON c_custkey = o_custkey AND o_totalprice > 150000", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_totalprice > 150000)"),
    "join_right_anti": ("SELECT c_custkey FROM orders RIGHT ANTI JOIN customer ON c_custkey = o_custkey AND o_orderstatus = 'P'", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey AND o_orderstatus = 'P')"),
    "join_self": "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey",
    "join_theta": "SELECT a.n_nationkey AS x, b.r_regionkey AS y FROM nation a JOIN region b ON a.n_nationkey > b.r_regionkey * 4",
    "join_compound": "SELECT l.l_orderkey, l.l_linenumber, s.s_name FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey AND s.s_acctbal > 0 AND l.l_quantity > 40",
    "join_lateral": "SELECT c.c_custkey, x.o_orderkey, x.o_totalprice FROM customer c CROSS JOIN LATERAL (SELECT o_orderkey, o_totalprice FROM orders o WHERE o.o_custkey = c.c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 1) x",
    "join_apply": ("SELECT c.c_custkey, x.best FROM customer c OUTER APPLY (SELECT max(o_totalprice) AS best FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') x", "SELECT c.c_custkey, x.best FROM customer c LEFT JOIN LATERAL (SELECT max(o_totalprice) AS best FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P') x ON true"),
    "join_cross_apply": ("SELECT n.n_name, x.n, x.best FROM nation n CROSS APPLY (SELECT count(*) AS n, max(s_acctbal) AS best FROM supplier s WHERE s.s_nationkey = n.n_nationkey HAVING count(*) > 0) x", "SELECT n.n_name, count(*) AS n, max(s_acctbal) AS best FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey GROUP BY n.n_nationkey, n.n_name"),
    "join_asof_keys": ("SELECT p.event_id, e.event_id AS later FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'click') e ON e.user_id = p.user_id AND p.ts <= e.ts", "SELECT p.event_id, (SELECT min_by(e.event_id, struct_pack(t := e.ts, i := e.event_id)) FROM events e WHERE e.event_type = 'click' AND e.user_id = p.user_id AND p.ts <= e.ts) AS later FROM events p WHERE p.event_type = 'purchase' AND EXISTS (SELECT 1 FROM events e WHERE e.event_type = 'click' AND e.user_id = p.user_id AND p.ts <= e.ts)"),
    "join_asof_left_tests": ("SELECT p.event_id, p.user_id AS u, e.event_id AS earlier FROM events p ASOF LEFT JOIN events e ON e.user_id = p.user_id AND p.ts > e.ts AND e.event_type = 'view' AND p.event_type = 'purchase'", "SELECT p.event_id, p.user_id AS u, (SELECT max_by(e.event_id, struct_pack(t := e.ts, i := -e.event_id)) FROM events e WHERE e.event_type = 'view' AND p.event_type = 'purchase' AND e.user_id = p.user_id AND p.ts > e.ts) AS earlier FROM events p"),
    "join_view": ("SELECT c.c_name, v.total FROM (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE PRECISION) AS total FROM orders GROUP BY o_custkey) AS v JOIN customer c ON c.c_custkey = v.k AND c.c_nationkey = 3", "WITH v AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE PRECISION) AS total FROM orders GROUP BY o_custkey) SELECT c.c_name, v.total FROM v JOIN customer c ON c.c_custkey = v.k WHERE c.c_nationkey = 3"),
    "join_asof_sql": ("SELECT n.n_nationkey, r.r_regionkey FROM nation n ASOF LEFT JOIN region r ON n.n_nationkey > r.r_regionkey * 3", "SELECT n.n_nationkey, (SELECT max(r.r_regionkey) FROM region r WHERE n.n_nationkey > r.r_regionkey * 3) AS r_regionkey FROM nation n"),
    "join_nway": f"SELECT r.r_name, n.n_name, {TOTAL} AS total FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey JOIN orders o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY r.r_name, n.n_name",
    "join_null_anti": "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P' WHERE o.o_orderkey IS NULL",
    "join_nested": "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN (nation n JOIN region r ON n.n_regionkey = r.r_regionkey) ON c.c_nationkey = n.n_nationkey",
    # subqueries
    "sub_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)",
    "sub_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 150000)",
    "sub_exists": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "sub_not_exists": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')",
    "sub_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT max(o_totalprice) * 0.8 FROM orders)",
    "sub_scalar_item": "SELECT n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS region_name FROM nation",
    "sub_corr_scalar": "SELECT o.o_orderkey FROM orders o WHERE o.o_totalprice >= (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sub_any": "SELECT c_custkey FROM customer WHERE c_custkey = ANY (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    "sub_all": "SELECT o_orderkey FROM orders WHERE o_totalprice >= ALL (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'P')",
    "sub_nested": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45 AND l.l_suppkey < 20))",
    "sub_grand_outer": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > c.c_nationkey + 20))",
    "sub_grand_outer_not": "SELECT c.c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > c.c_nationkey + 20))",
    "sub_grand_outer_scalar": "SELECT n.n_nationkey, (SELECT count(*) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > (SELECT min(s.s_acctbal) FROM supplier s WHERE s.s_nationkey = n.n_nationkey)) AS richer FROM nation n",
    "sub_all_null": "SELECT r_regionkey, (r_regionkey > ALL (SELECT nullif(n_regionkey, 1) FROM nation)) AS a, (r_regionkey >= ALL (SELECT n_regionkey FROM nation)) AS b, (r_regionkey < ALL (SELECT n_regionkey FROM nation WHERE n_nationkey > 900)) AS c, (r_regionkey <> ALL (SELECT nullif(n_regionkey, 1) FROM nation WHERE n_regionkey < 3)) AS d FROM region",
    "sub_any_null": "SELECT r_regionkey, (r_regionkey > ANY (SELECT nullif(n_regionkey, 0) FROM nation)) AS a, (r_regionkey < ANY (SELECT nullif(n_regionkey, 4) FROM nation)) AS b, (r_regionkey = ANY (SELECT nullif(n_regionkey, 1) FROM nation)) AS c, (r_regionkey > ANY (SELECT n_regionkey FROM nation WHERE n_nationkey > 900)) AS d FROM region",
    "sub_all_null_filter": "SELECT r_regionkey FROM region WHERE NOT (r_regionkey > ALL (SELECT nullif(n_regionkey, 2) FROM nation WHERE n_regionkey < 3))",
    "sub_in_tuple": "SELECT o_orderkey FROM orders WHERE (o_custkey, o_orderstatus) IN (SELECT o_custkey, o_orderstatus FROM orders WHERE o_totalprice > 150000)",
    # aggregation
    "agg_basic": f"SELECT o_orderstatus, count(*) AS n, {TOTAL} AS total, {TOTAL} / count(*) AS mean, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY o_orderstatus",
    "agg_pricing": f"SELECT l_returnflag, l_linestatus, {M.format('l_quantity')} AS sum_qty, {SPENT} AS sum_base, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus",
    "agg_avg": ("SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 6) AS urgent, avg(CAST(o_custkey AS DOUBLE PRECISION)) AS keys FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, round(avg(o_totalprice), 6) AS mean, round(avg(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 6) AS urgent, avg(CAST(o_custkey AS DOUBLE)) AS keys FROM orders GROUP BY o_orderstatus"),
    "agg_stddev": "SELECT p_brand, round(stddev(p_retailprice), 6) AS s, round(var_pop(p_size), 6) AS v FROM part GROUP BY p_brand HAVING count(*) > 2",
    "agg_having": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12",
    "agg_distinct": "SELECT DISTINCT p_brand, p_type FROM part",
    "agg_count_distinct": "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, count(o_orderpriority) AS n FROM orders GROUP BY o_orderstatus",
    "agg_filter": f"SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 100000) AS big, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(12,2))) FILTER (WHERE o_orderpriority = '1-URGENT'), 0) AS DOUBLE PRECISION) AS urgent FROM orders GROUP BY o_orderstatus",
    "agg_bool": "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every_one, bool_or(o_totalprice > 150000) AS some_one FROM orders GROUP BY o_custkey",
    "agg_case": "SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY o_custkey",
    "agg_grouping_sets": f"SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderstatus), ())",
    "agg_cube": "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "agg_rollup": f"SELECT o_orderpriority, o_orderstatus, {TOTAL} AS total, CAST(grouping(o_orderstatus) AS BIGINT) AS g FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)",
    "agg_group_all": "SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL",
    "agg_group_expr": "SELECT CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, count(*) AS n FROM orders GROUP BY extract(YEAR FROM o_orderdate)",
    "distinct_on": "SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey",
    "array_agg_ordered": "SELECT o_custkey, array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey) AS ks FROM orders GROUP BY o_custkey",
    "string_agg_ordered": "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY o_orderdate, o_orderkey) AS s FROM orders GROUP BY o_custkey",
    # windows
    "win_rank": "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS rk, CAST(dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS BIGINT) AS dr, CAST(ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS BIGINT) AS nt FROM orders",
    "win_lag_lead": "SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before_, lead(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS later, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS first_ FROM orders",
    "win_rows_frame": "SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE PRECISION) AS s FROM orders",
    "win_range_frame": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n FROM events",
    "win_groups_frame": "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders",
    "win_groups_join": "SELECT o.o_orderkey, c.c_name, count(*) OVER (PARTITION BY c.c_nationkey ORDER BY o.o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) AS n FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey WHERE o_totalprice > 50000",
    "win_groups_order": "SELECT o_orderkey FROM orders ORDER BY count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderstatus GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW) DESC, o_orderkey LIMIT 20",
    "win_percent": "SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 9) AS p, round(cume_dist() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus), 9) AS c, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_ FROM orders",
    "win_named": "SELECT o_orderkey, count(*) OVER w AS n, max(o_totalprice) OVER w AS hi FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)",
    "win_filter": "SELECT o_orderkey, count(*) FILTER (WHERE o_totalprice > 100000) OVER (PARTITION BY o_custkey) AS n FROM orders",
    "win_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2",
    # sorting and limits
    "topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "limit_offset": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 30",
    "order_alias": "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders ORDER BY twice DESC, o_orderkey LIMIT 15",
    "order_ordinal": "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY 2 DESC, 1 LIMIT 12",
    "order_nulls": "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s FROM orders ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey LIMIT 25",
    "fetch_first": "SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey FETCH FIRST 7 ROWS ONLY",
    "for_update": ("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' FOR UPDATE", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'"),
    "keyset_page": "SELECT o_orderkey, o_totalprice FROM orders WHERE (o_totalprice, o_orderkey) < (CAST(100000 AS DOUBLE PRECISION), CAST(500 AS BIGINT)) ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 10",
    # set operations
    "union_all": "SELECT c_name AS name FROM customer WHERE c_acctbal > 5000 UNION ALL SELECT s_name FROM supplier",
    "union_distinct": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "except_distinct": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "setop_chain": "(SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT (SELECT n_nationkey FROM nation WHERE n_regionkey = 1 INTERSECT SELECT c_nationkey FROM customer)",
    # CTEs
    "cte_multi": f"WITH big AS (SELECT o_custkey, {TOTAL} AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 500000) SELECT c.c_name, t.total FROM top t JOIN customer c ON c.c_custkey = t.o_custkey",
    "cte_column_list": "WITH x(region_key, n) AS (SELECT n_regionkey, count(*) FROM nation GROUP BY n_regionkey) SELECT r.r_name, x.n FROM x JOIN region r ON r.r_regionkey = x.region_key",
    "cte_recursive": "WITH RECURSIVE steps(n, total) AS (SELECT CAST(1 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT n + 1, total + n + 1 FROM steps WHERE n < 20) SELECT n, total FROM steps",
    # sources
    "schema_qualified": ("SELECT n.n_name, r.r_name FROM qw_shop.nation n JOIN qw_shop.region r ON r.r_regionkey = n.n_regionkey WHERE n.n_nationkey < 9", "SELECT n.n_name, r.r_name FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey WHERE n.n_nationkey < 9"),
    "values_table": "SELECT v.a, v.b, n.n_name FROM (VALUES (CAST(1 AS INTEGER), 'x'), (CAST(2 AS INTEGER), 'y')) AS v(a, b) JOIN nation n ON n.n_nationkey = v.a",
    "series_int": "SELECT CAST(g.i AS BIGINT) AS i FROM generate_series(1, 10) AS g(i)",
    "series_date": ("SELECT CAST(d AS date) AS d FROM generate_series(DATE '2024-01-01', DATE '2024-01-10', INTERVAL '1' DAY) AS g(d)", "SELECT CAST(d AS date) AS d FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-10', INTERVAL 1 DAY) AS g(d)"),
    "unnest_ordinality": ("SELECT n.n_nationkey, u.x, CAST(u.i AS BIGINT) AS i FROM nation n, unnest(ARRAY[n.n_name, 'end']) WITH ORDINALITY AS u(x, i)", "SELECT n_nationkey, n_name AS x, CAST(1 AS BIGINT) AS i FROM nation UNION ALL SELECT n_nationkey, 'end', 2 FROM nation"),
    "pivot": "SELECT * FROM (SELECT o_custkey, o_orderstatus, o_totalprice FROM orders) PIVOT (max(o_totalprice) FOR o_orderstatus IN ('F', 'O'))",
    "unpivot": "SELECT n_nationkey, field, v FROM (SELECT n_nationkey, n_name, CAST(n_regionkey AS VARCHAR(9)) AS region FROM nation) UNPIVOT (v FOR field IN (n_name, region))",
    "derived_table": f"SELECT d.o_custkey, d.total FROM (SELECT o_custkey, {TOTAL} AS total FROM orders GROUP BY o_custkey) AS d WHERE d.total > 300000",
}

#: Statements that change rows: the rows of the table after them.
CHANGES: dict[str, tuple[str, str]] = {
    "dml_insert_values": ("INSERT INTO region (r_regionkey, r_name) VALUES (100, 'NEW'), (101, 'NEWER')", "SELECT * FROM region UNION ALL VALUES (100, 'NEW'), (101, 'NEWER')"),
    "dml_insert_select": ("INSERT INTO region SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2", "SELECT * FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation WHERE n_regionkey = 2"),
    "dml_update": ("UPDATE customer SET c_acctbal = c_acctbal + 10, c_mktsegment = 'NONE' WHERE c_nationkey = 3", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal + 10 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'NONE' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_update_from": ("UPDATE customer c SET c_mktsegment = n.n_name FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1", "SELECT c.c_custkey, c.c_name, c.c_nationkey, c.c_acctbal, coalesce(n.n_name, c.c_mktsegment) AS c_mktsegment FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1"),
    "dml_delete": ("DELETE FROM orders WHERE o_orderstatus = 'F'", "SELECT * FROM orders WHERE o_orderstatus <> 'F'"),
    "dml_delete_using": ("DELETE FROM orders o USING customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0", "SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0)"),
    "dml_upsert": ("INSERT INTO region (r_regionkey, r_name) VALUES (0, 'CHANGED'), (50, 'ADDED') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = excluded.r_name", "SELECT r_regionkey, CASE WHEN r_regionkey = 0 THEN 'CHANGED' ELSE r_name END AS r_name FROM region UNION ALL VALUES (50, 'ADDED')"),
    "dml_upsert_null_key": ("INSERT INTO supplier SELECT CASE WHEN s_suppkey < 5 THEN NULL ELSE s_suppkey END, 'CHANGED', s_nationkey, NULL FROM supplier WHERE s_suppkey < 8 ON CONFLICT (s_suppkey) DO UPDATE SET s_name = excluded.s_name", "SELECT s_suppkey, CASE WHEN s_suppkey BETWEEN 5 AND 7 THEN 'CHANGED' ELSE s_name END AS s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT NULL, 'CHANGED', s_nationkey, NULL FROM supplier WHERE s_suppkey < 5"),
    "dml_upsert_repeated": ("INSERT INTO region SELECT n_regionkey + 3, n_name FROM nation ON CONFLICT (r_regionkey) DO NOTHING", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_regionkey + 3, min(n_name) FROM nation WHERE n_regionkey + 3 NOT IN (SELECT r_regionkey FROM region) GROUP BY n_regionkey"),
    "dml_upsert_where": ("INSERT INTO region (r_regionkey, r_name) VALUES (0, 'X'), (1, 'X'), (9, 'X') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = r_name || '-' || excluded.r_name WHERE r_regionkey > 0", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN r_name || '-X' ELSE r_name END AS r_name FROM region UNION ALL VALUES (9, 'X')"),
    "dml_update_from_many": ("UPDATE nation n SET n_name = c.c_name FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000", "SELECT n.n_nationkey, coalesce((SELECT min_by(c.c_name, c.c_custkey) FROM customer c WHERE c.c_nationkey = n.n_nationkey AND c.c_acctbal > 5000), n.n_name) AS n_name, n.n_regionkey FROM nation n"),
    "dml_update_from_two": ("UPDATE customer SET c_mktsegment = r_name FROM nation, region WHERE n_nationkey = c_nationkey AND r_regionkey = n_regionkey AND r_regionkey < 3 AND c_acctbal > 0", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, CASE WHEN c_acctbal > 0 AND r_regionkey < 3 THEN r_name ELSE c_mktsegment END AS c_mktsegment FROM customer LEFT JOIN (nation JOIN region ON r_regionkey = n_regionkey) ON n_nationkey = c_nationkey"),
    "dml_update_tuple": ("UPDATE customer SET (c_mktsegment, c_acctbal) = ('TUPLE', c_acctbal * 2) WHERE c_nationkey = 3", "SELECT c_custkey, c_name, c_nationkey, CASE WHEN c_nationkey = 3 THEN c_acctbal * 2 ELSE c_acctbal END AS c_acctbal, CASE WHEN c_nationkey = 3 THEN 'TUPLE' ELSE c_mktsegment END AS c_mktsegment FROM customer"),
    "dml_update_tuple_query": ("UPDATE nation SET (n_name, n_regionkey) = (SELECT max(s_name), CAST(count(*) AS INTEGER) FROM supplier WHERE s_nationkey = n_nationkey) WHERE n_regionkey = 1", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN (SELECT max(s_name) FROM supplier WHERE s_nationkey = n_nationkey) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN (SELECT CAST(count(*) AS INTEGER) FROM supplier WHERE s_nationkey = n_nationkey) ELSE n_regionkey END AS n_regionkey FROM nation"),
    "dml_insert_ignore": ("INSERT INTO region (r_regionkey, r_name) VALUES (0, 'CHANGED'), (50, 'ADDED') ON CONFLICT (r_regionkey) DO NOTHING", "SELECT * FROM region UNION ALL VALUES (50, 'ADDED')"),
}


#: Statements with RETURNING: the rows that they return.
RETURNED: dict[str, tuple[str, str]] = {
    "dml_returning": ("UPDATE customer SET c_acctbal = c_acctbal + 10 WHERE c_nationkey = 3 RETURNING c_custkey, c_acctbal AS now, c_acctbal > 5000 AS rich", "SELECT c_custkey, c_acctbal + 10 AS now, c_acctbal + 10 > 5000 AS rich FROM customer WHERE c_nationkey = 3"),
    "dml_returning_from": ("UPDATE customer c SET c_mktsegment = n.n_name FROM nation n WHERE n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1 RETURNING c.c_custkey, c.c_mktsegment, n.n_regionkey", "SELECT c.c_custkey, n.n_name AS c_mktsegment, n.n_regionkey FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_regionkey = 1"),
    "dml_returning_insert": ("INSERT INTO region (r_regionkey, r_name) VALUES (0, 'CHANGED'), (50, 'ADDED') ON CONFLICT (r_regionkey) DO UPDATE SET r_name = region.r_name || excluded.r_name RETURNING *", "SELECT r_regionkey, r_name || 'CHANGED' AS r_name FROM region WHERE r_regionkey = 0 UNION ALL VALUES (50, 'ADDED')"),
    "dml_returning_delete": ("DELETE FROM orders o USING customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal < 0 RETURNING o.o_orderkey, c.c_name", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_acctbal < 0"),
}

#: Queries with arguments.
ARGUMENTS: dict[str, tuple[str, list, str]] = {
    "params_numbered": ("SELECT o_orderkey FROM orders WHERE o_totalprice > $1 AND o_orderstatus = $2", [100000.0, "F"], "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F'"),
}


def _load(text: str, spark: SparkSession, sf_dir: str) -> None:
    """Registers the tables that a statement mentions; those of a schema as tables of it."""
    found = [m for s in parse(text) for m in mentions(s) if m[0] == "relation"]
    load_tables(spark, sf_dir, [t for t in TABLES if t in {m[2].lower() for m in found if not m[1]}])
    for _, schema, name, *_ in found:
        if schema:
            spark.sql(f"CREATE DATABASE IF NOT EXISTS {schema}")
            spark.sql(f"DROP TABLE IF EXISTS {schema}.{name}")  # of another folder
            spark.sql(f"CREATE TABLE {schema}.{name} USING parquet LOCATION '{sf_dir}/{name}.parquet'")


def _returned(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    _load(text, spark, sf_dir)
    return returning(spark, text)


def _with_arguments(text: str, args: list, spark: SparkSession, sf_dir: str) -> DataFrame:
    _load(text, spark, sf_dir)
    return run(spark, text, args=args)


def _query(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    _load(text, spark, sf_dir)
    return run(spark, text)


def _change(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    _load(text, spark, sf_dir)
    return after(spark, text)


def join_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each purchase the last earlier event of the same user."""
    from pyspark.sql import functions as F

    from querywright.operators.temporal import asof_join

    events = load_tables(spark, sf_dir, ["events"])["events"]
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.select("user_id", "ts", F.col("event_id").alias("earlier"))
    return asof_join(left, right, "ts", ["user_id"], ["earlier"], strict=True).select("event_id", "earlier")


ASOF_SQL = "SELECT p.event_id, max_by(e.event_id, struct_pack(t := e.ts, i := e.event_id)) AS earlier FROM events p LEFT JOIN events e ON e.user_id = p.user_id AND e.ts < p.ts WHERE p.event_type = 'purchase' GROUP BY p.event_id"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict = {n: partial(_query, q if isinstance(q, str) else q[0]) for n, q in QUERIES.items()}
    out |= {n: partial(_change, q) for n, (q, _) in CHANGES.items()}
    out |= {n: partial(_returned, q) for n, (q, _) in RETURNED.items()}
    out |= {n: partial(_with_arguments, q, args) for n, (q, args, _) in ARGUMENTS.items()}
    return out | {"join_asof": join_asof}


def oracle_sql() -> dict[str, str]:
    out = {n: q if isinstance(q, str) else q[1] for n, q in QUERIES.items()}
    out |= {n: q for n, (_, q) in (CHANGES | RETURNED).items()} | {n: q for n, (_, _, q) in ARGUMENTS.items()}
    return out | {"join_asof": ASOF_SQL}
