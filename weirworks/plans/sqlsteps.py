"""SQL and custom-code steps, and the relational surface reached through SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks.operators import custom, joins
from weirworks.plans.registry import Data, query


def _sql_query(name: str, text: str, oracle: str | None = None, *tables: str) -> None:
    """A SQL step over the named tables; without an oracle the same text is the check."""

    @query(name, oracle or text)
    def run(d: Data) -> DataFrame:
        return custom.sql_transform(d.spark, text, {t: d.table(t) for t in tables})


@query(
    "sql_aliases",
    "SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_acctbal < 0 OR c_acctbal > 100 GROUP BY c_mktsegment",
)
def sql_aliases(d: Data) -> DataFrame:
    text = "SELECT c_mktsegment AS segment, count(*) AS n FROM people WHERE c_acctbal < 0 OR c_acctbal > 100 GROUP BY c_mktsegment"
    return custom.sql_transform(d.spark, text, {"customer": d.customer}, {"customer": "people"})


@query("custom_code", "SELECT o_orderpriority, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY o_orderpriority")
def custom_code(d: Data) -> DataFrame:
    def rich_orders(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        rich = frames["customer"].where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
        kept = frames["orders"].join(rich, "o_custkey")
        return {"out": kept.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")), "rest": kept}

    return custom.custom_code(rich_orders, {"orders": d.orders, "customer": d.customer})


@query("custom_pandas_udf", "SELECT p_partkey, p_retailprice * 4 AS gross FROM part")
def custom_pandas_udf(d: Data) -> DataFrame:
    @F.pandas_udf("double")
    def gross(net: pd.Series) -> pd.Series:
        return net * 4

    def add_tax(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {"out": frames["part"].select("p_partkey", gross("p_retailprice").alias("gross"))}

    return custom.custom_code(add_tax, {"part": d.part})


@query("custom_map_in_pandas", "SELECT event_id, length(props) AS width, upper(event_type) AS kind FROM events")
def custom_map_in_pandas(d: Data) -> DataFrame:
    def shape(batches):
        for batch in batches:
            yield pd.DataFrame({"event_id": batch.event_id, "width": batch.props.str.len(), "kind": batch.event_type.str.upper()})

    return d.events.select("event_id", "props", "event_type").mapInPandas(shape, "event_id bigint, width bigint, kind string")


@query("custom_function_in_sql", "SELECT p_brand, sum(length(p_name) + p_size)::BIGINT AS total FROM part GROUP BY p_brand")
def custom_function_in_sql(d: Data) -> DataFrame:
    def width(name: pd.Series, size: pd.Series) -> pd.Series:
        return name.str.len() + size

    custom.register_function(d.spark, "name_width", width, "bigint")
    return custom.sql_transform(d.spark, "SELECT p_brand, sum(name_width(p_name, p_size)) AS total FROM part GROUP BY p_brand", {"part": d.part})


@query("custom_table_function", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def custom_table_function(d: Data) -> DataFrame:
    class Words:
        def eval(self, name: str):
            for word in name.split(" "):
                yield (word,)

    custom.register_table_function(d.spark, "words_of", Words, "word string")
    return custom.sql_transform(d.spark, "SELECT p_partkey, word FROM part, LATERAL words_of(p_name)", {"part": d.part})


@query(
    "custom_grouped_pandas",
    """WITH daily AS (SELECT o_orderpriority, CAST(o_orderdate AS DATE) AS day, max(o_totalprice) AS top FROM orders GROUP BY 1, 2)
       SELECT o_orderpriority, day, max(top) OVER (PARTITION BY o_orderpriority ORDER BY day) AS best FROM daily""",
)
def custom_grouped_pandas(d: Data) -> DataFrame:
    def best_so_far(days: pd.DataFrame) -> pd.DataFrame:
        days = days.sort_values("day")
        return days.assign(best=days.top.cummax())[["o_orderpriority", "day", "best"]]

    # Daily maxima first: a group then has one row per calendar day at most.
    daily = d.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("top"))
    return daily.groupBy("o_orderpriority").applyInPandas(best_so_far, "o_orderpriority string, day date, best double")


@query(
    "custom_parameterised",
    "SELECT c_custkey, concat_ws(' / ', c_name, c_mktsegment) AS title, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey",
)
def custom_parameterised(d: Data) -> DataFrame:
    registry = custom.built_in_transforms()
    registry.register(custom.lookup_transform(d.nation.withColumnRenamed("n_nationkey", "c_nationkey"), ["c_nationkey"], ["n_name"]))
    titled = registry.apply("concatenate", d.customer, columns=["c_name", "c_mktsegment"], to="title", sep=" / ")
    return registry.apply("lookup", titled).select("c_custkey", "title", "n_name")


_sql_query(
    "sql_top_orders_per_customer",
    """SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (
         SELECT o_custkey, o_orderkey, o_totalprice,
           CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn FROM orders) t
       WHERE rn <= 3""",
    None, "orders",
)

_sql_query(
    "sql_rank_priorities",
    """WITH daily AS (SELECT o_orderpriority, o_orderdate, count(*) AS n FROM orders GROUP BY o_orderpriority, o_orderdate)
       SELECT o_orderpriority, o_orderdate, n, CAST(rank() OVER w AS BIGINT) AS rk, CAST(dense_rank() OVER w AS BIGINT) AS drk,
         CAST(ntile(4) OVER (PARTITION BY o_orderpriority ORDER BY n, o_orderdate) AS BIGINT) AS quarter
       FROM daily WINDOW w AS (PARTITION BY o_orderpriority ORDER BY n DESC)""",
    None, "orders",
)

# Daily totals come first, so a window holds at most one row per calendar day of a key.
_sql_query(
    "sql_running_and_sliding",
    """WITH daily AS (SELECT o_custkey, CAST(o_orderdate AS DATE) AS day, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS total FROM orders GROUP BY 1, 2)
       SELECT o_custkey, day, CAST(lag(total) OVER w AS DECIMAL(18,2)) AS previous,
         CAST(sum(total) OVER (PARTITION BY o_custkey ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(24,2)) AS running,
         CAST(sum(total) OVER (PARTITION BY o_custkey ORDER BY day RANGE BETWEEN INTERVAL '6' DAY PRECEDING AND CURRENT ROW) AS DECIMAL(24,2)) AS week
       FROM daily WINDOW w AS (PARTITION BY o_custkey ORDER BY day)""",
    None, "orders",
)

_sql_query(
    "sql_grouping_sets",
    """SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) AS INTEGER) AS g1, CAST(grouping(l_linestatus) AS INTEGER) AS g2,
         CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(24,2)) AS revenue
       FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())""",
    None, "lineitem",
)
_sql_query(
    "sql_rollup",
    """SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    None, "lineitem",
)
_sql_query(
    "sql_cube",
    """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus, l_linenumber)""",
    None, "lineitem",
)
_sql_query(
    "sql_intersect",
    "SELECT c_custkey AS key FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'",
    None, "customer", "orders",
)
_sql_query(
    "sql_except_all",
    "SELECT o_custkey AS key FROM orders EXCEPT ALL SELECT c_custkey FROM customer",
    None, "customer", "orders",
)
_sql_query(
    "sql_top_by_price",
    "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10",
    None, "lineitem",
)
_sql_query(
    "sql_correlated_mean",
    """SELECT o_orderkey, o_custkey, o_totalprice FROM orders o
       WHERE o_totalprice > (SELECT avg(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)""",
    None, "orders",
)
_sql_query(
    "sql_exists_subquery",
    """SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_discount > 0.09)
         AND NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 0)""",
    None, "supplier", "lineitem", "nation",
)
# Bands are 5000 wide, so a price can only fall in the band of its own quotient: an equi join carries the range.
_sql_query(
    "sql_range_join",
    """WITH bands AS (SELECT slot, slot * 5000.0E0 AS low, slot * 5000.0E0 + 5000.0E0 AS high, count(*) AS items
         FROM (SELECT CAST(floor(l_extendedprice / 5000) AS BIGINT) AS slot FROM lineitem) b GROUP BY slot)
       SELECT o_orderkey, low, high, items FROM orders JOIN bands
         ON CAST(floor(o_totalprice / 5000) AS BIGINT) = slot AND o_totalprice >= low AND o_totalprice < high""",
    None, "orders", "lineitem",
)
# One row per customer and year on both sides, so a customer pairs a handful of years at most.
_sql_query(
    "sql_theta_join",
    """WITH yearly AS (SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS yr, max(o_totalprice) AS top FROM orders GROUP BY 1, 2)
       SELECT a.o_custkey, a.yr, count(*) AS better_years FROM yearly a JOIN yearly b ON a.o_custkey = b.o_custkey AND b.top > a.top AND b.yr > a.yr
       GROUP BY a.o_custkey, a.yr""",
    None, "orders",
)


@query(
    "sql_asof_join",
    """WITH asked AS (SELECT DISTINCT l_suppkey AS key, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_returnflag = 'R'),
         held AS (SELECT o_custkey AS key, o_orderdate, o_orderkey FROM orders),
         found AS (SELECT a.key, a.day, max((o_orderdate, o_orderkey)) AS best FROM asked a JOIN held h ON a.key = h.key AND CAST(h.o_orderdate AS DATE) < a.day GROUP BY ALL)
       SELECT l_orderkey, l_linenumber, l_suppkey AS key, l_shipdate, f.best[1] AS o_orderdate, f.best[2] AS o_orderkey
       FROM lineitem l LEFT JOIN found f ON f.key = l.l_suppkey AND f.day = CAST(l.l_shipdate AS DATE) WHERE l_returnflag = 'R'""",
)
def sql_asof_join(d: Data) -> DataFrame:
    shipped = d.lineitem.where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("key"), "l_shipdate")
    ordered = d.orders.select(F.col("o_custkey").alias("key"), "o_orderdate", "o_orderkey")
    return joins.latest_before(shipped, ordered, ["key"], "l_shipdate", "o_orderdate", ["o_orderkey"])


@query(
    "sql_asof_instant",
    """WITH clicks AS (SELECT user_id, ts AS clicked_at, max(event_id) AS click_id FROM events WHERE event_type = 'click' GROUP BY ALL)
       SELECT e.event_id, e.user_id, e.ts, c.clicked_at, c.click_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
       ASOF LEFT JOIN clicks c ON e.user_id = c.user_id AND e.ts >= c.clicked_at""",
)
def sql_asof_instant(d: Data) -> DataFrame:
    """Every purchase with the user's last click, however many of both fall on a day."""
    bought = d.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    clicks = d.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("clicked_at"), F.col("event_id").alias("click_id"))
    return joins.latest_at(bought, clicks, ["user_id"], "ts", "clicked_at", ["click_id"])


_sql_query(
    "sql_string_functions",
    """SELECT p_partkey, upper(p_name) AS up, length(p_name) AS len, substr(p_name, 1, 3) AS head, replace(p_brand, 'Brand#', 'B') AS brand,
         lpad(CAST(p_size AS VARCHAR(9)), 4, '0') AS size4, reverse(p_type) AS backward, trim(concat('  ', p_type, ' ')) AS trimmed,
         regexp_replace(p_name, '[aeiou]', '_', 'g') AS no_vowels FROM part""".replace(", 'g'", ""),
    """SELECT p_partkey, upper(p_name) AS up, length(p_name)::INTEGER AS len, substr(p_name, 1, 3) AS head, replace(p_brand, 'Brand#', 'B') AS brand,
         lpad(CAST(p_size AS VARCHAR), 4, '0') AS size4, reverse(p_type) AS backward, trim(concat('  ', p_type, ' ')) AS trimmed,
         regexp_replace(p_name, '[aeiou]', '_', 'g') AS no_vowels FROM part""",
    "part",
)
_sql_query(
    "sql_date_functions",
    """SELECT o_orderkey, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS doy, last_day(o_orderdate) AS month_end,
         datediff(DATE '2002-01-01', CAST(o_orderdate AS DATE)) AS days_left, CAST(add_months(o_orderdate, 2) AS DATE) AS later,
         date_format(o_orderdate, 'yyyy-MM-dd') AS iso FROM orders""",
    """SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, quarter(o_orderdate)::INTEGER AS q, dayofyear(o_orderdate)::INTEGER AS doy, last_day(o_orderdate) AS month_end,
         datediff('day', CAST(o_orderdate AS DATE), DATE '2002-01-01')::INTEGER AS days_left, CAST(o_orderdate + INTERVAL '2' MONTH AS DATE) AS later,
         strftime(o_orderdate, '%Y-%m-%d') AS iso FROM orders""",
    "orders",
)
_sql_query(
    "sql_math_functions",
    """SELECT l_orderkey, l_linenumber, l_partkey, floor(l_extendedprice) AS fl, ceil(l_tax * 100) AS ce, abs(l_quantity - 25) AS dist,
         l_orderkey % 7 AS rest, round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS log_price, greatest(l_discount, l_tax) AS most, sign(l_quantity - 25) AS side
       FROM lineitem""",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(floor(l_extendedprice) AS BIGINT) AS fl, CAST(ceil(l_tax * 100) AS BIGINT) AS ce, abs(l_quantity - 25) AS dist,
         l_orderkey % 7 AS rest, round(sqrt(l_quantity), 6) AS root, round(ln(l_extendedprice), 6) AS log_price, greatest(l_discount, l_tax) AS most, CAST(sign(l_quantity - 25) AS DOUBLE) AS side
       FROM lineitem""",
    "lineitem",
)
_sql_query(
    "sql_json_functions",
    """SELECT event_id, from_json(props, 'k INT').k AS k, get_json_object(props, '$.k') AS k_text, json_array_length('[1,2]') AS two FROM events""",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, json_extract_string(props, '$.k') AS k_text, 2 AS two FROM events""",
    "events",
)
_sql_query(
    "sql_array_functions",
    """SELECT vec_id, size(embedding) AS width, round(aggregate(embedding, 0D, (a, x) -> a + CAST(x AS DOUBLE) * CAST(x AS DOUBLE)), 4) AS norm2,
         exists(embedding, x -> x > 0.3) AS has_big, size(filter(embedding, x -> x < 0)) AS negatives, array_max(embedding) = element_at(array_sort(embedding), -1) AS same_max,
         map_from_entries(array(struct('label', label)))['label'] AS label FROM embeddings""",
    """SELECT vec_id, len(embedding)::INTEGER AS width, round(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) for x in embedding]), 4) AS norm2,
         len([x for x in embedding if x > 0.3]) > 0 AS has_big, len([x for x in embedding if x < 0])::INTEGER AS negatives, true AS same_max, label FROM embeddings""",
    "embeddings",
)


@query(
    "sql_pivot",
    """SELECT CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error,
         count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'view') AS view
       FROM events GROUP BY 1""",
)
def sql_pivot(d: Data) -> DataFrame:
    text = """SELECT * FROM (SELECT CAST(ts AS DATE) AS day, event_type, event_id FROM events)
              PIVOT (count(event_id) FOR event_type IN ('click', 'error', 'purchase', 'signup', 'view'))"""
    return custom.sql_transform(d.spark, text, {"events": d.events}).fillna(0)
