"""One registered query for each operator of the language, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .api import run
from .catalog import Catalog
from .plans.semantic import Graph
from .sources import tables_in

NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
RELATIONSHIPS = (
    "orders.o_custkey -> customer.c_custkey",
    "lineitem.l_orderkey -> orders.o_orderkey",
    "lineitem.l_partkey -> part.p_partkey",
    "lineitem.l_suppkey -> supplier.s_suppkey",
    "customer.c_nationkey -> nation.n_nationkey",
    "supplier.s_nationkey -> nation.n_nationkey",
    "nation.n_regionkey -> region.r_regionkey",
    "labels.doc_id -> documents.doc_id",
)
KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "documents": "doc_id"}
GRAPH = {
    "entities": {"customer": {"key": {"id": "INT"}}, "order": {"key": {"id": "INT"}}, "nation": {"key": {"id": "INT"}}},
    "models": {
        "customer": {
            "grains": ["customer"],
            "schema": {"c_custkey": "INT", "c_name": "TEXT", "c_mktsegment": "TEXT", "c_nationkey": "INT"},
            "relationships": {"customer": {"key": {"id": "c_custkey"}, "attributes": {"segment": "c_mktsegment", "segment_lower": {"expression": "lower(c_mktsegment)"}}}},
        },
        "orders": {
            "grains": ["order"],
            "schema": {"o_orderkey": "INT", "o_custkey": "INT", "o_totalprice": "DOUBLE", "o_orderstatus": "TEXT"},
            "relationships": {"order": {"key": {"id": "o_orderkey"}}, "buyer": {"entity": "customer", "key": {"id": "o_custkey"}}},
            "metrics": {
                "volume": "round(sum(o_totalprice), 2)",
                "order_count": "count(*)",
                "building_count": "count(*) filter (where buyer.segment = 'BUILDING')",
                "aov": "round(sum(o_totalprice) / order_count, 4)",
            },
        },
    },
}


def catalog(graph: bool = False) -> Catalog:
    out = Catalog.from_dict({"tables": {k: {"primary_key": v} for k, v in KEYS.items()}, "relationships": list(RELATIONSHIPS)})
    out.tables["labels"] = type(out.tables["documents"])("labels", unique={"doc_id"})
    if graph:
        out.graph = Graph.from_dict(GRAPH)
    return out


#: name -> (query, SQL or None where the rows are not determined)
PAIRS: dict[str, tuple[str, str | None]] = {
    # sources, projection, filters
    "src_table": ("from region", "SELECT * FROM region"),
    "src_subquery": ("from (from orders where o_totalprice > 200000) as big select o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000"),
    "src_with": ("with f as (from orders where o_orderstatus = 'F') from f group by o_orderpriority (# as n)", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "src_select_first": ("select o_orderpriority, count(*) as n from orders where o_totalprice > 1000 group by o_orderpriority having count(*) > 1 order by -n", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_totalprice > 1000 GROUP BY 1 HAVING count(*) > 1"),
    "src_pipe": ("from nation | where n_regionkey = 1 |> select n_name", "SELECT n_name FROM nation WHERE n_regionkey = 1"),
    "src_multi": ("set week_start = 'sunday'; from region; from nation select n_name", "SELECT n_name FROM nation"),
    "proj_select": ("from customer select c_custkey as id, c_acctbal * 2 as twice where twice > 8000 select id", "SELECT c_custkey AS id FROM customer WHERE c_acctbal * 2 > 8000"),
    "proj_star_override": ("from region select *, upper(r_name) as r_name", "SELECT r_regionkey, upper(r_name) AS r_name FROM region"),
    "proj_alias_reuse": ("from lineitem select l_extendedprice * (1 - l_discount) as net, net * (1 + l_tax) as gross select round(sum(net), 0) as net, round(sum(gross), 0) as gross", "SELECT round(sum(l_extendedprice * (1 - l_discount)), 0) AS net, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 0) AS gross FROM lineitem"),
    "proj_extend": ("from nation extend length(n_name) as len", "SELECT *, length(n_name) AS len FROM nation"),
    "proj_except": ("from customer except c_name, c_acctbal", "SELECT c_custkey, c_nationkey, c_mktsegment FROM customer"),
    "proj_rename": ("from nation rename n_name as name", "SELECT n_nationkey, n_regionkey, n_name AS name FROM nation"),
    "proj_replace": ("from nation replace n_name with lower(n_name)", "SELECT n_nationkey, n_regionkey, lower(n_name) AS n_name FROM nation"),
    "proj_join_star": ("from nation & region on nation.n_regionkey = region.r_regionkey except region.r_regionkey", "SELECT n.*, r.r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey"),
    "filter_where": ("from orders where o_totalprice > 100000 where o_orderstatus = 'O' select o_orderkey", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'O'"),
    "filter_having": ("from orders group by o_custkey select o_custkey, count(*) as n having count(*) > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12"),
    "filter_qualify": ("from customer select c_custkey, c_nationkey, rank() over (partition by c_nationkey order by c_acctbal desc) as r qualify r <= 2", "SELECT c_custkey, c_nationkey, rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC) AS r FROM customer QUALIFY r <= 2"),
    "filter_in": ("from nation where n_regionkey in (from region where r_name like 'A%' select r_regionkey) and n_nationkey not in (1, 2)", "SELECT * FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_name LIKE 'A%') AND n_nationkey NOT IN (1, 2)"),
    "filter_exists": ("from customer where exists (select 1 from orders where orders.o_custkey = customer.c_custkey and orders.o_totalprice > 300000) select c_custkey", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)"),
    "filter_between": ("from part where p_size between 5 and 8 select p_partkey, p_size", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 5 AND 8"),
    "filter_null_eq": ("from documents where text != null group by lang (# as n)", "SELECT lang, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1"),
    "dist_all": ("from customer select c_mktsegment distinct", "SELECT DISTINCT c_mktsegment FROM customer"),
    "dist_on": ("from orders order by o_custkey, -o_totalprice, o_orderkey distinct on (o_custkey) select o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1"),
    # joins
    "join_inner": ("from orders & customer on orders.o_custkey = customer.c_custkey group by customer.c_mktsegment (# as n)", "SELECT c_mktsegment, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "join_left": ("from customer &? orders on customer.c_custkey = orders.o_custkey and orders.o_totalprice > 400000 select c_custkey, o_orderkey", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 400000"),
    "join_right": ("from orders where o_totalprice > 350000 ?& customer on orders.o_custkey = customer.c_custkey select c_custkey, o_orderkey", "SELECT c_custkey, o_orderkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) o RIGHT JOIN customer ON o_custkey = c_custkey"),
    "join_full": ("from supplier where s_acctbal > 0 ?&? nation on supplier.s_nationkey = nation.n_nationkey select s_suppkey, n_nationkey", "SELECT s_suppkey, n_nationkey FROM (SELECT * FROM supplier WHERE s_acctbal > 0) s FULL JOIN nation ON s_nationkey = n_nationkey"),
    "join_cross": ("from region\n* nation\nselect r_name, n_name", "SELECT r_name, n_name FROM region, nation"),
    "join_theta": ("from nation as a & nation as b on a.n_nationkey < b.n_nationkey and a.n_regionkey = b.n_regionkey select a.n_name as x, b.n_name as y", "SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "join_fk_shorthand": ("from orders & customer on o_custkey select o_orderkey, c_name", "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey"),
    "join_infer": ("from orders & customer & nation & region group by region.r_name (# as n)", "SELECT r_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "join_self": ("from nation as a &? nation as b on a.n_regionkey = b.n_nationkey select a.n_name as child, b.n_name as parent", "SELECT a.n_name AS child, b.n_name AS parent FROM nation a LEFT JOIN nation b ON a.n_regionkey = b.n_nationkey"),
    "join_comma": ("from nation, region where nation.n_regionkey = region.r_regionkey and region.r_name != 'ASIA' select n_name, r_name", "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'"),
    "join_using": ("from documents join labels using (doc_id) group by lang (# as n, sum(toxic) as t)", "SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS t FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    "join_using_left": ("from documents left join labels using (doc_id) select doc_id, quality", "SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id)"),
    "join_sql": ("from orders join customer on orders.o_custkey = customer.c_custkey where customer.c_acctbal > 9000 select o_orderkey", "SELECT o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000"),
    # groups
    "agg_block": ("from orders where o_orderstatus = \"F\" group by o_orderpriority (# as n, round(sum(o_totalprice), 0) as rev) order by -rev limit 10", "SELECT o_orderpriority, count(*) AS n, round(sum(o_totalprice), 0) AS rev FROM orders WHERE o_orderstatus = 'F' GROUP BY 1 ORDER BY rev DESC LIMIT 10"),
    "agg_bare": ("from orders group by o_orderstatus select o_orderstatus, round(avg(o_totalprice), 2) as a", "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS a FROM orders GROUP BY 1"),
    "agg_key_alias": ("from orders group by month(o_orderdate) as m (# as n) where n > 150", "SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 150"),
    "agg_count_entity": ("from orders & customer on o_custkey group by c_mktsegment (# customer as who, # orders as what)", "SELECT c_mktsegment, count(DISTINCT c_custkey) AS who, count(DISTINCT o_orderkey) AS what FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "agg_count_distinct": ("from orders select ##o_custkey as a, #(distinct o_orderstatus) as b, uniq(o_orderpriority) as c, #(o_custkey) as d", "SELECT count(DISTINCT o_custkey) AS a, count(DISTINCT o_orderstatus) AS b, count(DISTINCT o_orderpriority) AS c, count(o_custkey) AS d FROM orders"),
    "agg_natural": ("from part group by p_brand (sum p_size, max of p_size, min_p_size as least)", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS sum_p_size, max(p_size) AS max_p_size, min(p_size) AS least FROM part GROUP BY 1"),
    "agg_first_last": ("from events group by user_id (first(event_type order by event_id) as a, last(event_type order by event_id) as b)", "SELECT user_id, arg_min(event_type, event_id) AS a, arg_max(event_type, event_id) AS b FROM events GROUP BY 1"),
    "agg_argmax": ("from orders group by o_custkey (arg_max(o_orderkey, o_orderkey) as last_key, arg_min(o_orderstatus, o_orderkey) as s)", "SELECT o_custkey, max(o_orderkey) AS last_key, arg_min(o_orderstatus, o_orderkey) AS s FROM orders GROUP BY 1"),
    "agg_other": ("from part group by p_brand (round(stddev(p_size), 6) as sd, median(p_size) as med, string_agg(distinct p_type, ',' order by p_type) as types)", "SELECT p_brand, round(stddev(p_size), 6) AS sd, median(p_size) AS med, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS types FROM part GROUP BY 1"),
    "agg_filter": ("from orders group by o_orderpriority (count(*) filter (where o_orderstatus = 'F') as f, sum(when o_orderstatus is 'O' then 1, otherwise 0) as o)", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS f, CAST(sum(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS o FROM orders GROUP BY 1"),
    "agg_rollup": ("from orders group by rollup(o_orderstatus, o_orderpriority) (# as n)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)"),
    "agg_cube": ("from orders group by cube(o_orderstatus, o_orderpriority) (# as n)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"),
    "agg_sets": ("from orders group by grouping sets ((o_orderstatus), (o_orderpriority), ()) (# as n)", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"),
    "agg_auto_alias": ("from part group by p_brand (#, sum(p_size), ##p_type)", "SELECT p_brand, count(*) AS num, CAST(sum(p_size) AS BIGINT) AS sum_p_size, count(DISTINCT p_type) AS uniq_p_type FROM part GROUP BY 1"),
    # windows
    "win_per_first": ("from orders per o_custkey first by -o_totalprice, o_orderkey select o_custkey, o_orderkey", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "win_per_last": ("from orders per o_custkey last by o_orderkey select o_custkey, o_orderkey", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1"),
    "win_per_number": ("from events per user_id number by event_id as k select event_id, k", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events"),
    "win_per_rank": ("from part per p_brand rank by -p_size select p_partkey, rank", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS rank FROM part"),
    "win_per_dense": ("from part per p_brand dense rank by p_size as d select p_partkey, d", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part"),
    "win_number": ("from nation number by -n_nationkey as k", "SELECT *, row_number() OVER (ORDER BY n_nationkey DESC) AS k FROM nation"),
    "win_dedup": ("from events deduplicate by user_id, event_type order by -event_id select event_id", "SELECT max(event_id) AS event_id FROM events GROUP BY user_id, event_type"),
    "win_prior_next": ("from nation select n_nationkey, prior(n_name) as p, next(n_name, 2) as q order by n_nationkey", "SELECT n_nationkey, lag(n_name) OVER (ORDER BY n_nationkey) AS p, lead(n_name, 2) OVER (ORDER BY n_nationkey) AS q FROM nation"),
    "win_running": ("from part select p_partkey, running_sum(p_size) over p_brand as s, running_count(p_size) over p_brand as n, running_max(p_size) over p_brand as m order by p_partkey", "SELECT p_partkey, CAST(coalesce(sum(p_size) OVER w, 0) AS BIGINT) AS s, count(p_size) OVER w AS n, max(p_size) OVER w AS m FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING)"),
    "win_rolling": ("from part select p_partkey, rolling_sum(p_size, 3) over p_brand as s, rolling_avg(p_size, 3) over p_brand as a order by p_partkey", "SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS s, avg(p_size) OVER w AS a FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS 2 PRECEDING)"),
    "win_fill": ("from part select p_partkey, fill_forward(when p_size > 25 then p_size end) over p_brand as f, fill_backward(when p_size > 25 then p_size end) over p_brand as b order by p_partkey", "SELECT p_partkey, last_value(CASE WHEN p_size > 25 THEN p_size END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS UNBOUNDED PRECEDING) AS f, first_value(CASE WHEN p_size > 25 THEN p_size END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM part"),
    "win_first_over": ("from part select p_partkey, first(p_name order by p_partkey) over p_brand as f", "SELECT p_partkey, first_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f FROM part"),
    "win_explicit": ("from orders select o_orderkey, row_number() over (partition by o_custkey order by o_orderkey desc) as r, count(*) over (partition by o_custkey order by o_orderkey rows between 2 preceding and current row) as n", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM orders"),
    "win_over_short": ("from nation select n_name, count(*) over n_regionkey as n", "SELECT n_name, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation"),
    "win_named": ("from part select p_partkey, sum(p_size) over w as s, row_number() over (w order by p_partkey desc) as r window w as (partition by p_brand order by p_partkey rows between unbounded preceding and current row)", "SELECT p_partkey, CAST(sum(p_size) OVER w AS BIGINT) AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS r FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"),
    "win_rank_global": ("from part rank by -p_size as r select p_partkey, r", "SELECT p_partkey, rank() OVER (ORDER BY p_size DESC) AS r FROM part"),
    "win_dense_global": ("from part dense rank by p_size as r select p_partkey, r", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_size) AS r FROM part"),
    "win_last_over": ("from part select p_partkey, last(p_name order by p_partkey) over p_brand as f", "SELECT p_partkey, last_value(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS f FROM part"),
    "win_argmax": ("from part select p_partkey, arg_max(p_name, p_partkey) over p_brand as a", "SELECT p_partkey, arg_max(p_name, p_partkey) OVER (PARTITION BY p_brand) AS a FROM part"),
    "win_rank_funcs": ("from part select p_partkey, ntile(4) over (partition by p_brand order by p_partkey) as q, round(percent_rank() over (partition by p_brand order by p_size), 6) as p, round(cume_dist() over (partition by p_brand order by p_size), 6) as c, nth_value(p_name, 2) over (partition by p_brand order by p_partkey) as n", "SELECT p_partkey, ntile(4) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS q, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c, nth_value(p_name, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_size)"),
    "win_distinct": ("from part select p_partkey, count(distinct p_size) over p_brand as d", "SELECT p_partkey, count(DISTINCT p_size) OVER (PARTITION BY p_brand) AS d FROM part"),
    # order, paging, samples
    "sort_order": ("from orders order by -o_totalprice, o_orderkey limit 20 select o_orderkey", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20"),
    "limit_offset": ("from nation order by n_nationkey offset 5 limit 7", "SELECT * FROM nation ORDER BY n_nationkey LIMIT 7 OFFSET 5"),
    "topk": ("from part group by p_brand (sum(p_size) as s) order by -s, p_brand take 5", "SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS s FROM part GROUP BY 1 ORDER BY s DESC, p_brand LIMIT 5"),
    "topk_group": ("from part qualify row_number() over (partition by p_brand order by p_partkey) <= 3 select p_partkey", "SELECT p_partkey FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3"),
    "sample_n": ("from events sample 100 select # as n", "SELECT least(100, count(*)) AS n FROM events"),
    "sample_pct": ("from events sample 10% select # > 0 as some", "SELECT true AS some"),
    "sample_strat": ("from events sample 3 per event_type group by event_type (# as n)", "SELECT event_type, least(3, count(*)) AS n FROM events GROUP BY 1"),
    # set operations
    "set_union_all": ("from nation select n_name as name union all from region select r_name as name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "set_union": ("from customer select c_nationkey as k union from supplier select s_nationkey as k", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier"),
    "set_intersect": ("from customer select c_custkey as k intersect from orders select o_custkey as k", "SELECT c_custkey AS k FROM customer INTERSECT SELECT o_custkey FROM orders"),
    "set_except": ("from part select p_size as k except from nation select n_nationkey as k", "SELECT p_size AS k FROM part EXCEPT SELECT n_nationkey FROM nation"),
    "set_by_name": ("from nation select n_name as a, n_nationkey as b union all by name from region select r_regionkey as b, r_name as a", "SELECT n_name AS a, n_nationkey AS b FROM nation UNION ALL SELECT r_name, r_regionkey FROM region"),
    "set_intersect_all": ("from customer select c_nationkey as k intersect all from supplier select s_nationkey as k", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier"),
    "set_except_all": ("from customer select c_nationkey as k except all from supplier select s_nationkey as k", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier"),
    "set_corresponding": ("from nation select n_name as a, n_regionkey as b union corresponding from region select r_regionkey as b, r_name as a", "SELECT n_name AS a, n_regionkey AS b FROM nation UNION SELECT r_name, r_regionkey FROM region"),
    # shapes
    "pivot_static": ("from orders select o_custkey, o_orderstatus, o_orderkey pivot count(o_orderkey) by o_orderstatus values ('F', 'O', 'P')", "SELECT o_custkey, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS F, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS O, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS P FROM orders GROUP BY 1"),
    "pivot_group": ("from orders pivot max(o_orderkey) by o_orderstatus values ('F' as f, 'O' as o) group by o_orderpriority", "SELECT o_orderpriority, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS f, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS o FROM orders GROUP BY 1"),
    "pivot_dynamic": ("from orders select o_custkey, o_orderstatus, o_orderkey pivot max(o_orderkey) by o_orderstatus", "SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O, max(o_orderkey) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1"),
    "unpivot": ("from part select p_partkey, p_brand, p_type unpivot p_brand, p_type into kind, value", "SELECT p_partkey, 'p_brand' AS kind, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part"),
    "col_explode": ("from embeddings explode embedding as x group by vec_id (# as n, round(sum(x), 3) + 0 as s)", "SELECT vec_id, count(*) AS n, round(sum(x), 3) + 0 AS s FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY 1"),
    "recurse": ("from nation select n_nationkey as id, n_regionkey, n_name stash as tree from tree where id = 0 recurse(n_regionkey, 3)", "WITH RECURSIVE r AS (SELECT n_nationkey AS id, n_regionkey, n_name, 1 AS _level FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n.n_nationkey, n.n_regionkey, n.n_name, r._level + 1 FROM nation n JOIN r ON n.n_regionkey = r.id WHERE r._level < 3) SELECT * FROM r"),
    "stash": ("from orders group by o_custkey (# as n) stash as per_customer from per_customer group by n (# as customers)", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1"),
    "list_comp": ("from embeddings select vec_id, array_length([v for v in embedding if v > 0]) as pos", "SELECT vec_id, len(list_filter(embedding, lambda v: v > 0)) AS pos FROM embeddings"),
    "pivot_sql": ("from orders select o_custkey, o_orderstatus, o_orderkey pivot (max(o_orderkey) for o_orderstatus in ('F', 'O'))", "SELECT o_custkey, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS F, max(o_orderkey) FILTER (WHERE o_orderstatus = 'O') AS O FROM orders GROUP BY 1"),
    "src_unnest": ("from embeddings select vec_id, embedding explode embedding as x where x > 0.2 select vec_id, round(x::double, 5) as x", "SELECT vec_id, round(x::DOUBLE, 5) AS x FROM (SELECT vec_id, unnest(embedding) AS x FROM embeddings) WHERE x > 0.2"),
    # expressions
    "op_null_safe": ("from documents & labels on documents.doc_id = labels.doc_id where documents.lang <=> 'en' select documents.doc_id as d", "SELECT documents.doc_id AS d FROM documents JOIN labels USING (doc_id) WHERE lang IS NOT DISTINCT FROM 'en'"),
    "fn_cond": ("from part select p_partkey, nullif(p_size, 10) as a, if(p_size > 25, 'x', 'y') as b, coalesce(nullif(p_size, 10), 0) as c", "SELECT p_partkey, nullif(p_size, 10) AS a, if(p_size > 25, 'x', 'y') AS b, coalesce(nullif(p_size, 10), 0) AS c FROM part"),
    "fn_array": ("from embeddings select vec_id, array_length(embedding) as n, embedding[1] > embedding[2] as g, array_max(embedding) as m", "SELECT vec_id, len(embedding) AS n, embedding[1] > embedding[2] AS g, list_max(embedding) AS m FROM embeddings"),
    "fn_type": ("from part select typeof(p_name) as a, typeof(p_size) as b distinct", "SELECT 'string' AS a, 'int' AS b FROM (SELECT 1) WHERE EXISTS (SELECT 1 FROM part)"),
    "fn_json": ("from events select event_id, get_json_object(props, '$.k')::int as k", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    "fn_safe_divide": ("from part select p_partkey, safe_divide(p_retailprice, p_size - 10) as d", "SELECT p_partkey, p_retailprice / nullif(p_size - 10, 0) AS d FROM part"),
    "agg_approx": ("from orders select abs(approx_count_distinct(o_custkey) - count(distinct o_custkey)) < 0.2 * count(distinct o_custkey) as close", "SELECT true AS close"),
    "filter_num_guard": ("from part where p_size >= 3 and p_size < 4.5 select p_partkey", "SELECT p_partkey FROM part WHERE p_size >= 3 AND p_size < 4.5"),
    "op_logic": ("from part where (p_size > 10 && p_size <= 12) or not p_size < 49 select p_partkey", "SELECT p_partkey FROM part WHERE (p_size > 10 AND p_size <= 12) OR NOT p_size < 49"),
    "op_arith": ("from part select p_partkey, p_size / 7 as q, p_size % 7 as r, -p_size as m", "SELECT p_partkey, p_size / 7 AS q, p_size % 7 AS r, -p_size AS m FROM part"),
    "op_coalesce": ("from documents select doc_id, lang ?? 'none' as l", "SELECT doc_id, coalesce(lang, 'none') AS l FROM documents"),
    "op_ternary": ("from part select p_partkey, p_size > 40 ? 'big' : p_size > 20 ? 'mid' : 'small' as s", "SELECT p_partkey, CASE WHEN p_size > 40 THEN 'big' WHEN p_size > 20 THEN 'mid' ELSE 'small' END AS s FROM part"),
    "op_when": ("from part select p_partkey, when p_size < 10 then 'a', p_size < 30 then 'b', otherwise 'c' as s, when p_brand is 'Brand#11' then 1, otherwise 0 as o", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'a' WHEN p_size < 30 THEN 'b' ELSE 'c' END AS s, CASE WHEN p_brand = 'Brand#11' THEN 1 ELSE 0 END AS o FROM part"),
    "op_case": ("from part select p_partkey, case when p_size > 25 then 'x' else 'y' end as s", "SELECT p_partkey, CASE WHEN p_size > 25 THEN 'x' ELSE 'y' END AS s FROM part"),
    "op_cast": ("from part select p_partkey, p_size::text as t, cast(p_size as double) as d, p_size::numeric / 3 > 5 as n", "SELECT p_partkey, CAST(p_size AS VARCHAR) AS t, CAST(p_size AS DOUBLE) AS d, p_size / 3 > 5 AS n FROM part"),
    "op_strings": ("from nation where n_name contains 'I' or n_name istarts with 'a' or n_name ends with 'Y' select n_name", "SELECT n_name FROM nation WHERE n_name LIKE '%I%' OR n_name ILIKE 'a%' OR n_name LIKE '%Y'"),
    "op_matches": ("from nation where n_name matches '[0-4]$' select n_name", "SELECT n_name FROM nation WHERE regexp_matches(n_name, '[0-4]$')"),
    "op_slice": ("from nation select n_name[1:3] as a, n_name[2:] as b, n_name[:4] as c, n_name[-2:] as d", "SELECT substring(n_name, 1, 3) AS a, substring(n_name, 2) AS b, left(n_name, 4) AS c, right(n_name, 2) AS d FROM nation"),
    "op_concat": ("from nation select n_name || '-' || n_regionkey as a, concat(n_name, null, '!') as b", "SELECT n_name || '-' || n_regionkey AS a, concat(n_name, NULL, '!') AS b FROM nation"),
    "op_tz": ("from events select event_id, ts::PST as p, ts::\"Europe/London\" as l", "SELECT event_id, timezone('America/Los_Angeles', timezone('UTC', ts)) AS p, timezone('Europe/London', timezone('UTC', ts)) AS l FROM events"),
    "fn_bucket": ("from part group by bucket(p_size, [0, 10, 25, 50]) as b (# as n)", "SELECT CASE WHEN p_size >= 0 AND p_size < 10 THEN '0-10' WHEN p_size >= 10 AND p_size < 25 THEN '10-25' WHEN p_size >= 25 AND p_size <= 50 THEN '25-50' END AS b, count(*) AS n FROM part GROUP BY 1"),
    "fn_key": ("from nation select key(n_nationkey, n_name) as k", "SELECT md5(n_nationkey || '||' || n_name) AS k FROM nation"),
    "fn_slugify": ("from part select p_partkey, slugify(p_name || ' & Co.') as s", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' & Co.'), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM part"),
    "fn_now": ("from region select r_name, now() > @2020-01-01 as later", "SELECT r_name, now() > DATE '2020-01-01' AS later FROM region"),
    "fn_string": ("from nation select upper(n_name) as a, reverse(n_name) as b, length(n_name) as c, replace(n_name, 'A', 'o') as d, position('N' in n_name) as e, substring(n_name from 2 for 3) as f", "SELECT upper(n_name) AS a, reverse(n_name) AS b, length(n_name) AS c, replace(n_name, 'A', 'o') AS d, position('N' IN n_name) AS e, substring(n_name, 2, 3) AS f FROM nation"),
    "fn_math": ("from part select p_partkey, abs(-p_size) as a, floor(p_size / 3) as f, greatest(p_size, 20) as g, power(p_size, 2) as p, mod(p_size, 5) as m", "SELECT p_partkey, abs(-p_size) AS a, CAST(floor(p_size / 3) AS BIGINT) AS f, greatest(p_size, 20) AS g, power(p_size, 2) AS p, p_size % 5 AS m FROM part"),
    # dates
    "dt_trunc": ("from orders select o_orderkey, year(o_orderdate) as y, quarter(o_orderdate) as q, month(o_orderdate) as m, week(o_orderdate) as w, day(o_orderdate) as d", "SELECT o_orderkey, date_trunc('year', o_orderdate) AS y, date_trunc('quarter', o_orderdate) AS q, date_trunc('month', o_orderdate) AS m, date_trunc('week', o_orderdate) AS w, date_trunc('day', o_orderdate) AS d FROM orders"),
    "dt_week_sunday": ("set week_start = 'sunday'; from orders group by week(o_orderdate) as w (# as n)", "SELECT date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY AS w, count(*) AS n FROM orders GROUP BY 1"),
    "dt_part": ("from orders select o_orderkey, day of week o_orderdate as a, day of year o_orderdate as b, week of year o_orderdate as c, extract(month from o_orderdate) as d", "SELECT o_orderkey, dayofweek(o_orderdate) AS a, dayofyear(o_orderdate) AS b, weekofyear(o_orderdate) AS c, month(o_orderdate) AS d FROM orders"),
    "dt_literal": ("from orders where o_orderdate >= @1997-03-01 and o_orderdate < @1997-03-05T12:00:00 select o_orderkey", "SELECT o_orderkey FROM orders WHERE o_orderdate >= DATE '1997-03-01' AND o_orderdate < TIMESTAMP '1997-03-05 12:00:00'"),
    "dt_arith": ("from orders select o_orderkey, o_orderdate + 7 days as a, o_orderdate - 1 month as b, o_orderdate + 2 years as c", "SELECT o_orderkey, o_orderdate + INTERVAL 7 DAY AS a, o_orderdate - INTERVAL 1 MONTH AS b, o_orderdate + INTERVAL 2 YEAR AS c FROM orders"),
    "dt_diff": ("from lineitem & orders select l_orderkey, date_diff('day', o_orderdate, l_shipdate) as d, date_diff('month', o_orderdate, l_shipdate) as m, date_diff('year', o_orderdate, l_shipdate) as y, date_diff('quarter', o_orderdate, l_shipdate) as q", "SELECT l_orderkey, date_diff('day', o_orderdate, l_shipdate) AS d, date_diff('month', o_orderdate, l_shipdate) AS m, date_diff('year', o_orderdate, l_shipdate) AS y, date_diff('quarter', o_orderdate, l_shipdate) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "dt_since": ("from orders select o_orderkey, days_since(o_orderdate) > 1000 as a, months since o_orderdate > 12 as b", "SELECT o_orderkey, date_diff('day', o_orderdate, CAST(now() AS TIMESTAMP)) > 1000 AS a, date_diff('month', o_orderdate, CAST(now() AS TIMESTAMP)) > 12 AS b FROM orders"),
    "dt_relative": ("from orders where o_orderdate < 7 days ago select # as n", "SELECT count(*) AS n FROM orders WHERE o_orderdate < CAST(now() AS TIMESTAMP) - INTERVAL 7 DAY"),
    # spines
    "spine_date": ("from orders where o_totalprice > 497000 spine by month(o_orderdate) as m (# as n, round(sum(o_totalprice), 2) as s)", "WITH o AS (SELECT * FROM orders WHERE o_totalprice > 497000), p AS (SELECT unnest(generate_series((SELECT date_trunc('month', min(o_orderdate)) FROM o), (SELECT date_trunc('month', max(o_orderdate)) FROM o), INTERVAL 1 MONTH)) AS m) SELECT p.m, count(o.o_orderkey) AS n, round(sum(o_totalprice), 2) AS s FROM p LEFT JOIN o ON date_trunc('month', o_orderdate) = p.m GROUP BY 1"),
    "spine_bounds": ("from orders where o_orderdate >= @1996-01-01 and o_orderdate < @1996-03-01 and o_totalprice > 400000 spine by day(o_orderdate) as d (# as n)", "WITH o AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1996-03-01' AND o_totalprice > 400000), p AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-02-29', INTERVAL 1 DAY)) AS d) SELECT p.d, count(o.o_orderkey) AS n FROM p LEFT JOIN o ON date_trunc('day', o_orderdate) = p.d GROUP BY 1"),
    "spine_cross": ("from orders where o_totalprice > 499000 spine by o_orderpriority, year(o_orderdate) as y (# as n)", "WITH o AS (SELECT *, date_trunc('year', o_orderdate) AS y FROM orders WHERE o_totalprice > 499000), p AS (SELECT unnest(generate_series((SELECT min(y) FROM o), (SELECT max(y) FROM o), INTERVAL 1 YEAR)) AS y), k AS (SELECT DISTINCT o_orderpriority FROM o) SELECT k.o_orderpriority, p.y, count(o.o_orderkey) AS n FROM k CROSS JOIN p LEFT JOIN o ON o.y = p.y AND o.o_orderpriority = k.o_orderpriority GROUP BY 1, 2"),
    "spine_nested_units": ("from orders where o_totalprice > 499000 spine by year(o_orderdate) as y, month(o_orderdate) as m (# as n)", "WITH o AS (SELECT *, date_trunc('month', o_orderdate) AS m FROM orders WHERE o_totalprice > 499000), p AS (SELECT unnest(generate_series((SELECT min(m) FROM o), (SELECT max(m) FROM o), INTERVAL 1 MONTH)) AS m) SELECT date_trunc('year', p.m) AS y, p.m, count(o.o_orderkey) AS n FROM p LEFT JOIN o ON o.m = p.m GROUP BY 1, 2"),
    "spine_partial": ("from orders where o_totalprice > 499000 group by spine(year(o_orderdate)) as y, o_orderstatus (# as n)", "WITH o AS (SELECT *, date_trunc('year', o_orderdate) AS y FROM orders WHERE o_totalprice > 499000), p AS (SELECT unnest(generate_series((SELECT min(y) FROM o), (SELECT max(y) FROM o), INTERVAL 1 YEAR)) AS y) SELECT p.y, o.o_orderstatus, count(o.o_orderkey) AS n FROM p LEFT JOIN o ON o.y = p.y GROUP BY 1, 2"),
    "spine_hour_date_bound": ("from events where ts >= @2024-01-01 where ts < @2024-01-04 spine by hour(ts) as h (# as n, round(sum(value), 4) as s)", "WITH o AS (SELECT *, date_trunc('hour', ts) AS h FROM events WHERE ts >= DATE '2024-01-01' AND ts < DATE '2024-01-04'), p AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-03 23:00:00', INTERVAL 1 HOUR)) AS h) SELECT p.h, count(o.event_id) AS n, round(sum(value), 4) AS s FROM p LEFT JOIN o ON o.h = p.h GROUP BY 1"),
    "spine_tightest": ("from orders where o_orderdate >= @1995-01-01 and o_orderdate >= @1996-01-01 and o_orderdate <= @1996-01-20 and o_orderdate < @1997-01-01 spine by day(o_orderdate) as d (# as n)", "WITH o AS (SELECT * FROM orders WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate <= DATE '1996-01-20'), p AS (SELECT unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1996-01-20', INTERVAL 1 DAY)) AS d) SELECT p.d, count(o.o_orderkey) AS n FROM p LEFT JOIN o ON date_trunc('day', o_orderdate) = p.d GROUP BY 1"),
    "spine_null_key": ("from documents &? labels on documents.doc_id = labels.doc_id spine by labels.quality as q (# as n)", "SELECT quality AS q, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1"),
    "spine_source": ("from (from orders where o_totalprice > 480000 select o_orderdate as at, o_totalprice as price) as big spine by quarter(at) as q (# as n, max(price) as m)", "WITH o AS (SELECT date_trunc('quarter', o_orderdate) AS q, o_totalprice FROM orders WHERE o_totalprice > 480000), p AS (SELECT unnest(generate_series((SELECT min(q) FROM o), (SELECT max(q) FROM o), INTERVAL 3 MONTH)) AS q) SELECT p.q, count(o_totalprice) AS n, max(o_totalprice) AS m FROM p LEFT JOIN o ON o.q = p.q GROUP BY 1"),
    "spine_sunday": ("set week_start = 'sunday'; from orders where o_totalprice > 490000 spine by week(o_orderdate) as w (# as n)", "WITH o AS (SELECT date_trunc('week', o_orderdate + INTERVAL 1 DAY) - INTERVAL 1 DAY AS w FROM orders WHERE o_totalprice > 490000), p AS (SELECT unnest(generate_series((SELECT min(w) FROM o), (SELECT max(w) FROM o), INTERVAL 7 DAY)) AS w) SELECT p.w, count(o.w) AS n FROM p LEFT JOIN o ON o.w = p.w GROUP BY 1"),
    "spine_having": ("from orders where o_totalprice > 490000 spine by year(o_orderdate) as y (# as n) having max(o_totalprice) > 495000 order by -sum(o_totalprice)", "SELECT date_trunc('year', o_orderdate) AS y, count(*) AS n FROM orders WHERE o_totalprice > 490000 GROUP BY 1 HAVING max(o_totalprice) > 495000"),
    # fanout
    "fan_two_joins": ("from orders & customer on orders.o_custkey = customer.c_custkey & lineitem on orders.o_orderkey = lineitem.l_orderkey group by customer.c_mktsegment (round(sum(orders.o_totalprice), 0) as t, round(sum(lineitem.l_quantity), 0) as q) having sum(lineitem.l_quantity) > 10 order by -sum(orders.o_totalprice)", "SELECT c_mktsegment, round(sum(o_totalprice), 0) AS t, round(sum(q), 0) AS q FROM orders JOIN customer ON o_custkey = c_custkey JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey GROUP BY 1 HAVING sum(q) > 10"),
    "fan_two_many": ("from part & lineitem as a on part.p_partkey = a.l_partkey &? lineitem as b on part.p_partkey = b.l_partkey group by part.p_brand (round(sum(part.p_retailprice), 2) as price, round(sum(a.l_quantity), 0) as qa, round(sum(b.l_tax), 2) as tb)", "SELECT p_brand, round(sum(p_retailprice), 2) AS price, round(sum(q), 0) AS qa, round(sum(t), 2) AS tb FROM part JOIN (SELECT l_partkey, sum(l_quantity) AS q, sum(l_tax) AS t FROM lineitem GROUP BY 1) l ON p_partkey = l_partkey GROUP BY 1"),
    "fan_where": ("from orders & lineitem on orders.o_orderkey = lineitem.l_orderkey where lineitem.l_returnflag = 'R' group by orders.o_orderpriority (round(sum(orders.o_totalprice), 0) as t, round(sum(lineitem.l_quantity), 0) as q)", "SELECT o_orderpriority, round(sum(o_totalprice), 0) AS t, round(sum(q), 0) AS q FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey GROUP BY 1"),
    "fan_select": ("from orders & lineitem on orders.o_orderkey = lineitem.l_orderkey select round(sum(orders.o_totalprice), 0) as t, round(sum(l_quantity), 0) as q", "SELECT round(sum(o_totalprice), 0) AS t, round(sum(q), 0) AS q FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey"),
    "fan_reverse_chain": ("from lineitem & orders on lineitem.l_orderkey = orders.o_orderkey & customer on orders.o_custkey = customer.c_custkey group by customer.c_mktsegment (round(sum(customer.c_acctbal), 0) as b, round(sum(lineitem.l_quantity), 0) as q)", "SELECT c_mktsegment, round(sum(b), 0) AS b, round(sum(q), 0) AS q FROM (SELECT c_mktsegment, c_custkey, max(c_acctbal) AS b, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) GROUP BY 1"),
    "fan_skip": ("from orders & lineitem on orders.o_orderkey = lineitem.l_orderkey group by lineitem.l_returnflag (round(sum(lineitem.l_quantity), 0) as q, max(orders.o_totalprice) as m)", "SELECT l_returnflag, round(sum(l_quantity), 0) AS q, max(o_totalprice) AS m FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1"),
    "fan_preagg": ("from orders & lineitem on orders.o_orderkey = lineitem.l_orderkey group by orders.o_orderpriority (round(sum(orders.o_totalprice), 0) as t, round(sum(lineitem.l_quantity), 0) as q, count(lineitem.l_partkey) as n, round(avg(lineitem.l_quantity), 6) as a)", "SELECT o_orderpriority, round(sum(o_totalprice), 0) AS t, round(sum(q), 0) AS q, CAST(sum(n) AS BIGINT) AS n, round(sum(q) / sum(n), 6) AS a FROM orders JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey GROUP BY 1"),
    "fan_distinct": ("from orders & lineitem on orders.o_orderkey = lineitem.l_orderkey group by orders.o_orderstatus (count(*) as n, round(sum(orders.o_totalprice), 0) as t)", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 0) AS t FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1"),
    "fan_reverse": ("from lineitem & orders on lineitem.l_orderkey = orders.o_orderkey group by orders.o_orderpriority (round(sum(orders.o_totalprice), 0) as t, round(sum(lineitem.l_quantity), 0) as q, max(orders.o_totalprice) as m)", "SELECT o_orderpriority, round(sum(t), 0) AS t, round(sum(q), 0) AS q, max(t) AS m FROM (SELECT o_orderpriority, l_orderkey, max(o_totalprice) AS t, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1"),
    "fan_reverse_count": ("from lineitem & orders on lineitem.l_orderkey = orders.o_orderkey group by orders.o_orderstatus (count(*) as n)", "SELECT o_orderstatus, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"),
    "fan_unique": ("from documents & labels on documents.doc_id = labels.doc_id group by documents.lang (count(*) as n, sum(labels.toxic) as t, sum(documents.n_chars) as c)", "SELECT lang, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS t, CAST(sum(n_chars) AS BIGINT) AS c FROM documents JOIN labels USING (doc_id) GROUP BY 1"),
    # several operators together
    "stage_close": ("from orders order by -o_totalprice, o_orderkey limit 100 where o_orderstatus = 'F' group by o_orderpriority (# as n)", "SELECT o_orderpriority, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100) WHERE o_orderstatus = 'F' GROUP BY 1"),
    "q_star_join": ("from lineitem & orders & customer & nation & region where orders.o_orderdate >= @1996-01-01 and orders.o_orderdate < @1998-01-01 group by nation.n_name (round(sum(lineitem.l_extendedprice * (1 - lineitem.l_discount)), 0) as revenue, # as lines) order by -revenue", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 0) AS revenue, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1"),
    "q_pricing": ("from lineitem where l_shipdate <= @1998-09-02 group by l_returnflag, l_linestatus (round(sum(l_quantity), 0) as qty, round(sum(l_extendedprice * (1 - l_discount)), 0) as disc, round(avg(l_discount), 6) as d, # as n)", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 0) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 0) AS disc, round(avg(l_discount), 6) AS d, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2"),
    "q_cohort": ("from events group by user_id (min(ts) as first_ts) stash as born from events & born on events.user_id = born.user_id group by day(born.first_ts) as cohort, date_diff('day', born.first_ts, events.ts) as age (count(distinct events.user_id) as users)", "WITH b AS (SELECT user_id, min(ts) AS f FROM events GROUP BY 1) SELECT date_trunc('day', f) AS cohort, date_diff('day', f, ts) AS age, count(DISTINCT e.user_id) AS users FROM events e JOIN b USING (user_id) GROUP BY 1, 2"),
}
#: Queries over the semantic graph.
SEMANTIC: dict[str, tuple[str, str | None]] = {
    "sem_metric": ("from orders select volume, order_count, aov", "SELECT round(sum(o_totalprice), 2) AS volume, count(*) AS order_count, round(sum(o_totalprice) / count(*), 4) AS aov FROM orders"),
    "sem_attr": ("from orders group by buyer.segment (order_count, building_count)", "SELECT c_mktsegment AS buyer_segment, count(*) AS order_count, count(*) FILTER (WHERE c_mktsegment = 'BUILDING') AS building_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "sem_where": ("from orders where buyer.segment_lower = 'machinery' group by o_orderstatus (order_count)", "SELECT o_orderstatus, count(*) AS order_count FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE lower(c_mktsegment) = 'machinery' GROUP BY 1"),
}


def _query(text: str, graph: bool) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run(spark, text, tables_in(spark, sf_dir, NAMES), catalog(graph))

    return call


QUERIES = {name: _query(text, False) for name, (text, _) in PAIRS.items()} | {name: _query(text, True) for name, (text, _) in SEMANTIC.items()}
#: Columns that Spark gives as 32-bit integers and DuckDB as 64-bit ones.
INTEGERS = {
    "proj_extend": "len", "filter_qualify": "r", "win_per_number": "k", "win_per_rank": "rank", "win_per_dense": "d", "win_number": "k", "win_explicit": "r",
    "list_comp": "pos", "fn_string": "c e", "dt_part": "a b c d", "dt_diff": "d m q y", "q_cohort": "age",
    "win_named": "r", "win_rank_global": "r", "win_dense_global": "r", "win_rank_funcs": "q", "fn_array": "n",
}


def _same_types(name: str, sql: str) -> str:
    casts = ", ".join(f"CAST({c} AS INTEGER) AS {c}" for c in INTEGERS.get(name, "").split())
    return f"SELECT * REPLACE ({casts}) FROM ({sql})" if casts else sql


ORACLE_SQL = {name: _same_types(name, sql) for name, (_, sql) in (PAIRS | SEMANTIC).items() if sql}
