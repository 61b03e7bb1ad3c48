"""Edges of the language on small literal tables."""

import datetime as dt
import warnings

import pytest

from brook import Catalog, as_json, run, run_all, run_json
from brook.errors import BrookError
from brook.lang.parser import parse
from brook.lang.visual import to_json, to_text
from brook.operators import Pipeline
from brook.queries import PAIRS

D = dt.date
T = dt.datetime


@pytest.fixture(scope="module")
def tables(spark):
    f = spark.createDataFrame
    return {
        "users": f([(1, "Alice", "active"), (2, "Bob", "inactive"), (3, "Charlie", "active")], "id int, name string, status string"),
        "sales": f([("North", 100), ("South", 75), ("North", 50)], "region string, amount int"),
        "orders": f([(1, 10, 5.0), (2, 10, 7.0), (3, 20, 1.0)], "order_id int, customer_id int, shipping_cost double"),
        "order_items": f([(1, 1, 2), (1, 2, 3), (2, 3, 1)], "order_id int, item_id int, quantity int"),
        "txns": f([(D(2024, 1, 3), 30), (D(2024, 1, 1), 10), (D(2024, 1, 2), 20)], "d date, amount int"),
        "tickets": f([("a",), (None,), (None,)], "status string"),
        "stamps": f([(T(2024, 1, 3, 1, 30), 10), (T(2024, 1, 3, 4, 10), 20), (T(2024, 3, 24), 5)], "ts timestamp_ntz, amount int"),
        "kinds": f([(D(2024, 1, 3), "a", 10), (D(2024, 3, 24), "b", 5)], "d date, k string, amount int"),
        "weeks": f([(D(2024, 1, 3), 10), (D(2024, 1, 10), 20), (D(2024, 1, 24), 5)], "d date, amount int"),
        "t": f([(1,), (2,), (3,)], "x int"),
        "employees": f([(1, None), (2, 1), (3, 1), (4, 2)], "id int, manager_id int"),
        "arrays": f([([1, 2, 3], "x"), ([], "y"), (None, "z")], "a array<int>, k string"),
        "wide": f([(1, 10, 20, None)], "id int, q1 int, q2 int, q3 int"),
        "scores": f([(0.0,), (10.0,), (59.9,), (100.0,), (101.0,), (None,)], "s double"),
    }


@pytest.fixture()
def schema():
    return Catalog.from_dict(
        {"tables": {"orders": {"columns": ["order_id", "customer_id", "shipping_cost"], "primary_key": "order_id"}, "order_items": {"columns": ["order_id", "item_id", "quantity"]}}, "relationships": ["order_items.order_id -> orders.order_id"]}
    )


@pytest.fixture()
def q(spark, tables, schema):
    def go(text, **options):
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return [tuple(r) for r in run(spark, text, tables, schema, **options).collect()]

    return go


JOIN = "from orders & order_items on orders.order_id = order_items.order_id "


def test_filter_and_group(q):
    assert sorted(r[1] for r in q("from users where status = 'active'")) == ["Alice", "Charlie"]
    assert sorted(q("from sales group by region (sum(amount) as s)")) == [("North", 150), ("South", 75)]
    assert q("from sales group by region (sum(amount) as s) where s > 80") == [("North", 150)]
    assert q("from sales group by region select region, sum(amount) as s having max(amount) > 80") == [("North", 150)]
    assert q("from sales group by region (sum amount) order by -sum(amount)")[0] == ("North", 150)


def test_filters_on_groups_outlast_later_aggregates(q):
    assert q("from sales group by region (# as n) having max(amount) > 80 order by -sum(amount)") == [("North", 2)]
    assert q("from sales group by region (# as n) where n > 1 having min(amount) > 10 order by -max(amount)") == [("North", 2)]
    assert q("from sales group by region (# as n) having max(amount) > 70 having min(amount) > 60 order by -sum(amount)") == [("South", 1)]
    assert q("from stamps spine by month(ts) as m (# as n) having max(amount) > 15 order by -sum(amount)")[0][1] == 2


def test_fanout_one_to_many(q):
    assert q(JOIN + "group by orders.customer_id (count(*) as n)") == [(10, 2)]
    assert q(JOIN + "group by orders.customer_id (sum(orders.shipping_cost) as s, sum(order_items.quantity) as q)") == [(10, 12.0, 6)]
    assert q(JOIN + "group by orders.customer_id (sum(orders.shipping_cost) as s)", fanout_protection=False) == [(10, 17.0)]
    assert sorted(q("from orders &? order_items on orders.order_id = order_items.order_id group by orders.customer_id (sum(orders.shipping_cost) as s, count(order_items.item_id) as n)")) == [(10, 12.0, 3), (20, 1.0, 0)]


def test_fanout_many_to_one(q):
    reverse = "from order_items & orders on order_items.order_id = orders.order_id group by orders.customer_id "
    assert q(reverse + "(sum(orders.shipping_cost) as s, avg(orders.shipping_cost) as a, sum(order_items.quantity) as q)") == [(10, 12.0, 6.0, 6)]
    assert q(reverse + "(count(*) as n)") == [(10, 3)]


def test_fanout_over_several_joins(q, spark, tables, schema, caplog):
    schema.tables["customers"] = type(schema.tables["orders"])("customers", primary_key="customer_id")
    schema.relationships.append(type(schema.relationships[0])("orders", "customer_id", "customers", "customer_id"))
    tables["customers"] = spark.createDataFrame([(10, "AL", 1.5), (20, "AK", 2.0)], "customer_id int, state string, credit double")
    two = "from orders & customers on orders.customer_id = customers.customer_id & order_items on orders.order_id = order_items.order_id "
    assert q(two + "group by customers.state (sum(orders.shipping_cost) as s)") == [("AL", 12.0)]
    assert q(two + "group by state (sum(shipping_cost) as s, sum(quantity) as n)") == [("AL", 12.0, 6)]  # tables found by column
    assert q(two + "select sum(orders.shipping_cost) as s") == [(12.0,)]
    assert q(two + "where order_items.quantity > 1 group by customers.state (sum(orders.shipping_cost) as s, sum(order_items.quantity) as n)") == [("AL", 5.0, 5)]
    assert q(two + "group by customers.state (sum(orders.shipping_cost) as s) having sum(order_items.quantity) > 5 order by -max(order_items.quantity)") == [("AL", 12.0)]
    many = "from orders & order_items as a on orders.order_id = a.order_id & order_items as b on orders.order_id = b.order_id "
    assert q(many + "group by orders.customer_id (sum(orders.shipping_cost) as s, sum(a.quantity) as x, count(b.item_id) as y)") == [(10, 12.0, 6, 3)]
    chain = "from order_items & orders on order_items.order_id = orders.order_id & customers on orders.customer_id = customers.customer_id "
    assert q(chain + "group by customers.state (sum(customers.credit) as c, sum(order_items.quantity) as n)") == [("AL", 1.5, 6)]

    def said(text):
        caplog.clear()
        with caplog.at_level("WARNING", "brook.fanout"):
            q(two + text)
        return caplog.text

    assert "multiplies rows" in said("group by customers.state (sum(orders.shipping_cost * order_items.quantity) as x, sum(orders.shipping_cost) as s)")
    assert "multiplies rows" in said("group by order_items.item_id (sum(orders.shipping_cost) as s)")
    assert "repeats rows of customers" in said("group by customers.state (sum(customers.credit) as c)")
    assert "COUNT(*)" in said("group by customers.state (count(*) as n)")
    assert "multiplies rows" not in said("group by customers.state (sum(orders.shipping_cost) as s)")


def test_windows_take_the_order_of_the_query(q):
    want = [(D(2024, 1, 1), 10.0, 10, 10.0), (D(2024, 1, 2), 15.0, 30, 15.0), (D(2024, 1, 3), 20.0, 60, 25.0)]
    items = "select d, running_avg(amount) as a, running_sum(amount) as s, rolling_avg(amount, 2) as r"
    assert q(f"from txns order by d {items}") == want
    assert q(f"from txns {items} order by d") == want
    with pytest.raises(BrookError):
        q("from txns select running_sum(amount) as s")


def test_spines(q):
    assert sorted(q("from tickets spine by status (# as n)"), key=str) == [("a", 1), (None, 2)]
    got = sorted(q("from stamps spine by year(ts) as y, month(ts) as m (# as n, sum(amount) as s)"))
    assert [(r[1].month, r[2], r[3]) for r in got] == [(1, 2, 30), (2, 0, None), (3, 1, 5)]
    assert len(q("from stamps where ts >= @2024-01-03 and ts < @2024-01-03T06:00:00 spine by hour(ts) (sum(amount) as s)")) == 6
    assert len(q("from stamps spine by hour(ts) (sum(amount) as s)")) == 1944
    assert len(q("from stamps where ts >= @2024-01-01 and ts < @2024-03-01T00:00:00 spine by month(ts) (# as n)")) == 2
    assert len(q("from kinds where d >= @2024-01-01 and d < @2024-04-01 spine by k, month(d) (sum(amount) as s)")) == 6
    assert q("from stamps where ts >= @2025-01-01 and ts <= @2024-01-01 spine by day(ts) (# as n)") == []
    with pytest.raises(BrookError):
        q("from stamps spine by month(ts), week(ts) (# as n)")
    # a day without its end still has its last hours, whatever kind of literal says so
    for bound in ("@2024-01-04", "@2024-01-04T00:00:00", "'2024-01-04'"):
        got = q(f"from stamps where ts >= @2024-01-03 where ts < {bound} spine by hour(ts) (sum(amount) as s)")
        assert len(got) == 24 and sum(r[1] or 0 for r in got) == 30
    assert len(q("from kinds where d > @2024-01-02 and d > @2023-01-01 and d < @2024-01-05 and d <= @2025-01-01 spine by day(d) (# as n)")) == 2
    assert q("from stamps spine by quarter(ts) (count(distinct amount) as n, collect_list(amount) as l)")[0][1:] == (3, [10, 20, 5])
    assert sorted(q("from stamps where ts >= @2024-01-01 and ts < @2024-04-01 group by spine(month(ts)) as m, amount (# as n)"), key=str)[-1][1:] == (5, 1)
    assert q("from stamps where ts > @2030-01-01 spine by month(ts) (# as n)") == []


def test_spine_reads_its_source_once(spark, tables):
    tables["stamps"].write.mode("overwrite").parquet("/tmp/brook-stamps")
    t = {"stamps": spark.read.parquet("/tmp/brook-stamps")}
    df = run(spark, "from stamps spine by month(ts) as m, amount (# as n, sum(amount) as s)", t)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    final = plan[: plan.index("Initial Plan")] if "Initial Plan" in plan else plan
    assert final.count("FileScan parquet") - 1 <= 1 or "ReusedExchange" in final


def test_sunday_weeks(q):
    got = sorted(q("set week_start = 'sunday'; from weeks spine by week(d) as w (sum(amount) as s)"))
    assert [(r[0].date(), r[1]) for r in got] == [(D(2023, 12, 31), 10), (D(2024, 1, 7), 20), (D(2024, 1, 14), None), (D(2024, 1, 21), 5)]


def test_projection(q, spark, tables):
    assert q("from t select x + 1 as b, b * 2 as c") == [(2, 4), (3, 6), (4, 8)]
    assert run(spark, "from users rename name as who", tables).columns == ["id", "status", "who"]
    assert run(spark, "from users select *, upper(name) as name", tables).columns == ["id", "status", "name"]
    assert run(spark, "from sales group by region (#, sum(amount))", tables).columns == ["region", "num", "sum_amount"]
    assert run(spark, "from sales group by region (sum(amount))", tables, alias_template="{{prefix}}__{{col}}").columns == ["region", "sum__amount"]


def test_expressions(q):
    assert q("from users where id = 1 select name[1:3] as a, name[-2:] as b, status == 'x' ? 1 : 0 as c, null ?? 4 as d, name contains 'lic' as e") == [("Ali", "ce", 0, 4, True)]
    assert q("from users where id = 1 select when status is 'active' then 'y', otherwise 'n' as w, concat('a', null) as c, 1 / 0 as z") == [("y", "a", None)]
    assert [r[0] for r in q("from scores select bucket(s, [0, 10, 100]) as b")] == ["0-10", "10-100", "10-100", "10-100", None, None]
    assert [r[0] for r in q("from scores select bucket(s, start=0, end=100, width=50) as b")] == ["0-50", "0-50", "50-100", "50-100", None, None]
    assert q("from users where id = 2 select slugify('Ab  c!') as s, key(id, name) as k") == [("ab-c", __import__("hashlib").md5(b"2||Bob").hexdigest())]


def test_shapes(q):
    assert sorted(q("from arrays explode a as v select k, v")) == [("x", 1), ("x", 2), ("x", 3)]
    assert q("from arrays where k = 'x' select [v * 2 for v in a if v > 1] as w") == [([4, 6],)]
    assert q("from wide unpivot q1, q2, q3 into name, value") == [(1, "q1", 10), (1, "q2", 20)]
    assert q("from sales pivot sum(amount) by region values ('North' as n, 'South' as s)") == [(150, 75)]
    assert sorted(q("from employees where manager_id = null recurse(manager_id) select id, _level")) == [(1, 1), (2, 2), (3, 2), (4, 3)]
    assert sorted(q("from employees where manager_id = null recurse(manager_id, 2) select id")) == [(1,), (2,), (3,)]


def test_sql_forms(q):
    assert q("from users, orders where users.id = orders.order_id and users.id > 1 select name, customer_id order by name") == [("Bob", 10), ("Charlie", 20)]
    assert sorted(q("from orders join order_items using (order_id) select order_id, item_id")) == [(1, 1), (1, 2), (2, 3)]
    assert sorted(q("from orders full join order_items using (order_id) select order_id, item_id"), key=str) == [(1, 1), (1, 2), (2, 3), (3, None)]
    assert q("select sum(amount) over w as s, row_number() over (w order by amount) as r from sales window w as (partition by region) where amount = 100") == [(100, 1)]
    assert sorted(q("from sales select region, max(amount) over w as m window w as (partition by region)")) == [("North", 100), ("North", 100), ("South", 75)]
    assert sorted(q("from sales select region, count(distinct amount) over region as n distinct")) == [("North", 2), ("South", 1)]
    assert q("from arrays select count(distinct a[1]) over () as n distinct") == [(1,)]


def test_nested_queries(q):
    assert q("from users where id in (from orders where order_id > 1 select order_id) select id order by id") == [(2,), (3,)]
    assert q("from orders select avg(shipping_cost) as m stash as mean from orders where shipping_cost > (select m from mean) select order_id order by order_id") == [(1,), (2,)]
    assert q("from users where not exists (select 1 from orders where orders.customer_id = users.id) select # as n") == [(3,)]


def test_several_statements(spark, tables):
    assert [d.count() for d in run_all(spark, "from users; from sales", tables)] == [3, 3]


def test_json_and_fluent(spark, tables):
    spec = [{"name": "a", "from": "sales", "transforms": [{"type": "where", "condition": "amount > 60"}, {"type": "group_by", "columns": ["region"], "aggregates": ["# as n"]}]}]
    assert sorted(map(tuple, run_json(spark, spec, tables).collect())) == [("North", 1), ("South", 1)]
    tree = [
        {"name": "big", "from": {"table": "sales", "alias": "s"}, "transforms": [{"type": "where", "condition": {"type": "binary_op", "operator": ">", "left": {"type": "column", "name": "amount"}, "right": {"type": "literal", "value": 60, "data_type": "number"}}}]},
        {"name": None, "from": {"table": "big"}, "transforms": [{"type": "select", "columns": [{"name": "region"}]}], "set_operation": {"type": "union", "all": True}},
        {"name": None, "from": {"table": "users"}, "transforms": [{"type": "select", "columns": [{"expression": "name", "name": "region"}]}, {"type": "limit", "count": 1}]},
    ]
    assert run_json(spark, tree[0] | {"name": None}, tables).count() == 2
    assert run_json(spark, tree[:2], tables).count() == 2
    assert "union all" in to_text(tree)
    text = "from sales where amount > 60 and region != null group by region (sum(amount) as s) order by s desc limit 3"
    made = as_json(text)
    assert made[0]["transforms"][0]["condition"]["operator"] == "and" and made[0]["transforms"][1]["aggregates"] == [{"expression": "sum(amount)", "alias": "s"}]
    assert [tuple(r) for r in run_json(spark, made, tables).collect()] == [tuple(r) for r in run(spark, text, tables).collect()]
    assert Pipeline(tables["sales"]).where("amount > 60").group("region", "sum(amount) as s").order("-s").limit(1).df().first()["s"] == 100


@pytest.mark.parametrize(
    "text",
    [
        "from users sort by id",
        "from users where",
        "from users select id)",
        "select from",
        "from nowhere",
        "from orders group by sum(shipping_cost) (# as n)",
        "from orders & users",
        "from txns where year(d) = 2024",
        "from users group by status where id = 1",
        "from users select now(1) as x",
        "from users select id ??",
        "from orders & order_items on orders.order_id = order_items.order_id except order_id",
        "set nothing = 1; from users",
    ],
)
def test_rejected(q, text):
    with pytest.raises(BrookError):
        q(text)


@pytest.mark.parametrize("name", list(PAIRS))
def test_json_both_ways(name):
    text = PAIRS[name][0]
    if text.startswith("set "):
        text = text.split(";", 1)[1]
    assert parse(to_text(to_json(text))) == parse(text)


def test_ambiguous_relationships():
    c = Catalog.from_dict({"tables": {"a": {"columns": ["x", "y"]}, "b": {"columns": ["id"]}}, "relationships": ["a.x -> b.id", "a.y -> b.id"]})
    with pytest.raises(BrookError):
        c.infer_join("a", "b")


def test_nothing_is_left_in_the_session(q, spark):
    limits = [spark.conf.get(f"spark.sql.cteRecursion{x}Limit") for x in ("Level", "Row")]
    before = {t.name for t in spark.catalog.listTables()}
    q("from users where id in (from orders select order_id)")
    q("from employees where manager_id = null recurse(manager_id, 300) select id")
    assert {t.name for t in spark.catalog.listTables()} == before
    assert limits == [spark.conf.get(f"spark.sql.cteRecursion{x}Limit") for x in ("Level", "Row")]


def test_ambiguous_outer_join(q):
    with pytest.raises(BrookError):
        q("from orders as a & order_items as b on a.order_id = b.order_id where a.order_id > 1 ?&? users as c on c.id = a.order_id")


def test_catalog_files(tmp_path):
    p = tmp_path / "models.yml"
    p.write_text(
        "models:\n- name: orders\n  columns:\n  - name: id\n    tests: [unique]\n  - name: user_id\n    tests:\n"
        "    - relationships: {to: \"ref('users')\", field: id}\n  - name: status\n    tests:\n    - accepted_values: {values: [a, b]}\n- name: users\n  columns: [{name: id}]\n"
    )
    c = Catalog.from_model_tests(p)
    assert c.infer_join("orders", "users").column == "user_id" and c.is_unique("orders", "id") and c.table("orders").distinct_values == {"status": ["a", "b"]}
    again = Catalog.from_dict(c.to_dict())
    assert again.infer_join("users", "orders").other == "users" and again.is_unique("orders", "id")


def test_inferred_relationships():
    c = Catalog.from_dict({"tables": {"users": {"columns": ["id"]}, "posts": {"columns": ["id", "owner_user_id"]}, "categories": {"columns": ["id"]}, "items": {"columns": ["id", "category_id"]}}})
    assert c.infer_join("posts", "users").column == "owner_user_id"
    assert c.infer_join("items", "categories").other_column == "id"
    with pytest.raises(BrookError):
        c.infer_join("users", "categories")
