"""The flagship query, sources, targets and projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirworks import sinks, sources
from weirworks.functions.predicates import cond
from weirworks.operators import aggregate as agg
from weirworks.operators import filters, joins, project
from weirworks.operators.project import keep
from weirworks.plans.registry import Data, query
from weirworks.session import scratch_path
from weirworks.types import schema_of

ORDER_COLUMNS = [
    ("o_orderkey", "long"), ("o_custkey", "long"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
    ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
]
ORDERS_SQL = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(
    "revenue_by_segment",
    """SELECT c_mktsegment AS segment,
         CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS amount_sum, count(o_orderkey) AS order_id_count
       FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE o_orderstatus = 'F' AND o_totalprice > 1000 GROUP BY c_mktsegment""",
)
def revenue_by_segment(d: Data) -> DataFrame:
    orders = project.apply_mapping(
        d.orders,
        [keep("o_orderkey", "long", "order_id"), keep("o_custkey", "long", "customer_id"),
         keep("o_orderstatus", "string", "status"), keep("o_totalprice", "decimal(12,2)", "amount")],
    )
    customers = project.apply_mapping(d.customer, [keep("c_custkey", "long", "customer_id"), keep("c_mktsegment", "string", "segment")])
    paid = filters.filter_rows(orders, [cond("status", "EQ", "F"), cond("amount", "GT", 1000)])
    joined = joins.join(paid, customers, ["customer_id"])
    result = agg.aggregate(joined, ["segment"], [("amount", "sum"), ("order_id", "count")])
    out = scratch_path(d.spark, "revenue")
    sinks.write_files(result, out, mode="overwrite")
    return sources.parquet(d.spark, out)


@query("source_csv", ORDERS_SQL)
def source_csv(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "orders-csv")
    sinks.write_connector(d.orders, "csv", path=out, options={"header": "true", "sep": "|", "quote": "'"})
    raw = sources.csv(d.spark, out, separator="pipe", quote="single_quote")
    return project.apply_mapping(raw, [keep(n, t) for n, t in ORDER_COLUMNS])


@query("source_parquet", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_quantity > 45")
def source_parquet(d: Data) -> DataFrame:
    df = sources.parquet(d.spark, d.path("lineitem"))
    return df.where("l_quantity > 45").select("l_orderkey", "l_linenumber", "l_shipdate")


def _nested_orders(d: Data) -> str:
    """Documents with names that need quotes, and pairs of orders of which one is picked by its place."""
    out = scratch_path(d.spark, "orders-nested")
    order = F.struct(F.col("o_orderkey").alias("order key"), F.col("o_totalprice").alias("total.price"), F.col("o_orderstatus").alias("status"))
    late = F.struct(F.lit(-1).alias("order key"), F.lit("x").alias("status"))
    pair = F.array(F.to_json(late), F.to_json(order))
    d.orders.select(F.concat(F.lit('{"pay.load": {"orders": ['), F.array_join(pair, ", "), F.lit("]}}"))).write.text(out)
    return out


@query("source_json_index", "SELECT o_orderkey AS \"order key\", o_orderstatus AS status FROM orders")
def source_json_index(d: Data) -> DataFrame:
    return sources.json(d.spark, _nested_orders(d), json_path='$["pay.load"].orders[1]', row_schema="`order key` bigint, status string")


@query(
    "source_json_quoted",
    """SELECT o_orderkey AS "order key", o_totalprice AS "total.price" FROM orders UNION ALL SELECT -1, NULL FROM orders""",
)
def source_json_quoted(d: Data) -> DataFrame:
    return sources.json(d.spark, _nested_orders(d), json_path="$['pay.load']['orders'][*]", row_schema="`order key` bigint, `total.price` double")


@query(
    "source_json_path",
    "SELECT o_orderkey AS key, o_orderstatus AS status, o_totalprice AS price FROM orders",
)
def source_json_path(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "orders-json")
    order = F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"))
    d.orders.select(F.struct(F.array(order).alias("orders")).alias("payload")).write.json(out)
    return sources.json(
        d.spark, out, json_path="$.payload.orders[*]",
        schema="payload struct<orders array<struct<key bigint, status string, price double>>>",
    )


def _scratch_table(d: Data, df: DataFrame, name: str, keys: list[str]) -> str:
    """A partitioned table under the shared folder, by a name no earlier call used."""
    home = scratch_path(d.spark, name)
    table = home.rsplit("/", 1)[1].replace("-", "_")
    d.spark.sql(f"CREATE DATABASE IF NOT EXISTS weirworks_scratch LOCATION '{home}-db'")
    sinks.write_catalog(df, "weirworks_scratch", table, partition_keys=keys, mode="overwrite")
    return table


@query("source_catalog", "SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def source_catalog(d: Data) -> DataFrame:
    table = _scratch_table(d, d.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), "orders_by_status", ["o_orderstatus"])
    return sources.catalog_table(d.spark, "weirworks_scratch", table, "o_orderstatus = 'F'")


@query("source_by_extension", "SELECT c_custkey, c_name, c_mktsegment FROM customer")
def source_by_extension(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "customer") + ".jsonl"
    d.customer.select("c_custkey", "c_name", "c_mktsegment").write.json(out)
    return sources.by_extension(d.spark, out, schema="c_custkey bigint, c_name string, c_mktsegment string")


@query("source_connector", "SELECT p_partkey, p_name FROM part WHERE p_size < 10")
def source_connector(d: Data) -> DataFrame:
    return sources.connector(d.spark, "parquet", path=d.path("part")).where("p_size < 10").select("p_partkey", "p_name")


@query(
    "source_rows",
    """SELECT label, count(*) AS n FROM orders JOIN (VALUES ('F', 'filled'), ('O', 'open'), ('P', 'partial')) t(code, label) ON o_orderstatus = code GROUP BY label""",
)
def source_rows(d: Data) -> DataFrame:
    labels = sources.rows(d.spark, [("F", "filled"), ("O", "open"), ("P", "partial")], "code string, label string")
    return joins.join(d.orders, labels, ["o_orderstatus"], ["code"]).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("target_partitioned_orc", "SELECT l_orderkey, l_linenumber, l_extendedprice, l_returnflag FROM lineitem")
def target_partitioned_orc(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "lineitem-orc")
    narrow = d.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag")
    sinks.write_files(narrow, out, fmt="orc", compression="zlib", partition_keys=["l_returnflag"])
    return d.spark.read.schema(narrow.schema).orc(out)


@query("target_glueparquet", "SELECT p_partkey, p_name, p_retailprice FROM part")
def target_glueparquet(d: Data) -> DataFrame:
    out = scratch_path(d.spark, "part-parquet")
    sinks.write_files(d.part.select("p_partkey", "p_name", "p_retailprice"), out, fmt="glueparquet")
    return sources.parquet(d.spark, out)


@query("target_catalog", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def target_catalog(d: Data) -> DataFrame:
    table = _scratch_table(d, d.customer.select("c_custkey", "c_acctbal", "c_mktsegment"), "customer", ["c_mktsegment"])
    return sources.catalog_table(d.spark, "weirworks_scratch", table)


@query("target_receipt", "SELECT 'orders' AS node, count(*) AS rows, 'json' AS format FROM orders")
def target_receipt(d: Data) -> DataFrame:
    receipt = sinks.write_with_receipt(d.orders, "orders", scratch_path(d.spark, "receipt"), fmt="json")
    return d.spark.createDataFrame([(receipt.node, receipt.rows, receipt.format)], "node string, rows bigint, format string")


@query("target_spigot", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def target_spigot(d: Data) -> DataFrame:
    passed = sinks.spigot(d.orders, scratch_path(d.spark, "spigot"), top=20, prob=0.5)
    return passed.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("target_spigot_sample", "SELECT least(20, count(*)) AS written, least(20, count(*)) AS known FROM orders")
def target_spigot_sample(d: Data) -> DataFrame:
    """The sample that is written: no more rows than asked for, each one of the table's."""
    path = scratch_path(d.spark, "spigot")
    sinks.spigot(d.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), path, top=20)
    sample = sources.json(d.spark, path, schema="o_orderkey bigint, o_orderstatus string, o_totalprice double")
    known = sample.join(d.orders, ["o_orderkey", "o_orderstatus", "o_totalprice"], "left_semi")
    return sample.agg(F.count(F.lit(1)).alias("written")).crossJoin(known.agg(F.count(F.lit(1)).alias("known")))


@query(
    "map_apply",
    """SELECT o_orderkey AS id, TRY_CAST(code AS INTEGER) AS code_int, TRY_CAST(price AS DECIMAL(12,2)) AS price_dec,
         CAST(o_orderkey AS VARCHAR) AS key_text, status AS status FROM nulls""",
    "nulls",
)
def map_apply(d: Data) -> DataFrame:
    return project.apply_mapping(
        d.nulls,
        [keep("o_orderkey", "long", "id"), keep("code", "int", "code_int"), keep("price", "decimal(12,2)", "price_dec"),
         keep("o_orderkey", "string", "key_text"), keep("status", "string"), project.FieldMap("price", "gone", "double", dropped=True)],
    )


@query("map_nested", "SELECT o_orderkey AS id, o_orderstatus AS status, CAST(year(o_orderdate) AS INTEGER) AS yr FROM orders")
def map_nested(d: Data) -> DataFrame:
    nested = project.apply_mapping(
        d.orders, [keep("o_orderkey", "long", "order.id"), keep("o_orderstatus", "string", "order.info.status"), keep("o_orderdate", "date", "order.info.day")]
    )
    return nested.select("order.id", "order.info.status", F.year("order.info.day").alias("yr"))


@query("fields_select", "SELECT o_orderkey, o_totalprice FROM orders")
def fields_select(d: Data) -> DataFrame:
    return project.select_fields(d.orders, ["o_orderkey", "o_totalprice"])


@query("fields_drop", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def fields_drop(d: Data) -> DataFrame:
    packed = d.orders.select("o_orderkey", "o_custkey", "o_orderdate", F.struct("o_totalprice", "o_orderpriority", "o_orderstatus").alias("rest"))
    return project.drop_fields(packed, ["o_orderdate", "rest.o_orderstatus"]).select("o_orderkey", "o_custkey", "rest.*")


@query("field_rename", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS amount FROM orders")
def field_rename(d: Data) -> DataFrame:
    packed = d.orders.select("o_orderkey", "o_orderstatus", F.struct("o_totalprice").alias("money"))
    renamed = project.rename_field(project.rename_field(packed, "o_orderkey", "id"), "o_orderstatus", "status")
    return project.rename_field(renamed, "money.o_totalprice", "money.amount").select("id", "status", "money.amount")


@query("names_snake_case", "SELECT s_suppkey AS supplier_key, s_name AS name_of_supplier, s_acctbal AS balance2_usd FROM supplier")
def names_snake_case(d: Data) -> DataFrame:
    odd = d.supplier.select(
        F.col("s_suppkey").alias("supplierKey"), F.col("s_name").alias("Name-of Supplier"), F.col("s_acctbal").alias("_balance2USD_")
    )
    return project.snake_case(odd)


@query("null_fields_drop", "SELECT o_orderkey, o_orderstatus FROM orders")
def null_fields_drop(d: Data) -> DataFrame:
    padded = d.orders.select(
        "o_orderkey", "o_orderstatus", F.lit(None).cast("double").alias("nothing"), F.lit("").alias("blank"),
        F.lit("null").alias("word"), F.lit(-1).alias("minus"), F.lit("n/a").alias("custom"),
    )
    return project.drop_null_fields(padded, empty_string=True, null_string=True, minus_one=True, custom=[("n/a", "string")])


@query("null_fields_empty_frame", "SELECT count(*) AS orders, 6 AS columns FROM orders")
def null_fields_empty_frame(d: Data) -> DataFrame:
    kept = project.drop_null_fields(d.orders.where("o_orderkey < 0"))
    return d.orders.agg(F.count(F.lit(1)).alias("orders"), F.lit(len(kept.columns)).alias("columns"))


@query("fields_split", "SELECT 'selected' AS part, count(*) AS n, sum(c_custkey)::BIGINT AS total FROM customer UNION ALL SELECT 'rest', count(*), sum(c_nationkey)::BIGINT FROM customer")
def fields_split(d: Data) -> DataFrame:
    frames = project.split_fields(d.customer, ["c_custkey", "c_name"])
    first = frames["selected"].agg(F.lit("selected").alias("part"), F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("total"))
    return first.union(frames["rest"].agg(F.lit("rest"), F.count(F.lit(1)), F.sum("c_nationkey")))


@query("collection_select", "SELECT c_nationkey, c_acctbal, c_mktsegment FROM customer")
def collection_select(d: Data) -> DataFrame:
    return project.select_from_collection(project.split_fields(d.customer, ["c_custkey", "c_name"]), 1)


@query(
    "missing_fill_mean",
    """WITH m AS (SELECT sum(CAST(price AS DECIMAL(20,4))) / count(price) AS fill FROM nulls)
       SELECT o_orderkey, coalesce(CAST(price AS DECIMAL(20,4)), CAST(fill AS DECIMAL(20,4))) AS price FROM nulls CROSS JOIN m""",
    "nulls",
)
def missing_fill_mean(d: Data) -> DataFrame:
    exact = d.nulls.select("o_orderkey", F.col("price").cast("decimal(20,4)").alias("price"))
    return project.fill_missing(exact, "price")


@query(
    "missing_fill_mode_by_group",
    """WITH c AS (SELECT o_orderkey % 7 AS grp, status, count(*) AS n FROM nulls WHERE status IS NOT NULL GROUP BY ALL),
         m AS (SELECT grp, min(status) AS fill FROM c WHERE (grp, n) IN (SELECT grp, max(n) FROM c GROUP BY grp) GROUP BY grp)
       SELECT o_orderkey, o_orderkey % 7 AS grp, status, coalesce(status, fill) AS status_filled
       FROM nulls LEFT JOIN m ON o_orderkey % 7 = m.grp""",
    "nulls",
)
def missing_fill_mode_by_group(d: Data) -> DataFrame:
    df = d.nulls.select("o_orderkey", (F.col("o_orderkey") % 7).alias("grp"), "status")
    return project.fill_missing(df, "status", filled="status_filled", by=["grp"])


@query(
    "missing_fill_median_by_group",
    """WITH v AS (SELECT o_orderkey, o_orderkey % 3 AS grp, CAST(price AS DECIMAL(20,4)) AS price FROM nulls),
         o AS (SELECT grp, price, row_number() OVER (PARTITION BY grp ORDER BY price) AS pos, count(*) OVER (PARTITION BY grp) AS n FROM v WHERE price IS NOT NULL),
         m AS (SELECT grp, CAST((min(price) + max(price)) / 2 AS DECIMAL(20,4)) AS fill FROM o WHERE pos IN ((n + 1) // 2, n // 2 + 1) GROUP BY grp)
       SELECT o_orderkey, v.grp, coalesce(price, fill) AS price FROM v LEFT JOIN m ON m.grp = v.grp""",
    "nulls",
)
def missing_fill_median_by_group(d: Data) -> DataFrame:
    df = d.nulls.select("o_orderkey", (F.col("o_orderkey") % 3).alias("grp"), F.col("price").cast("decimal(20,4)").alias("price"))
    return project.fill_missing(df, "price", by=["grp"], method="median")


@query(
    "flatten_structs",
    "SELECT o_orderkey AS key, o_orderstatus AS info_status, o_totalprice AS info_money_total, v AS tags FROM orders, (SELECT unnest(['a','b']) AS v)",
)
def flatten_structs(d: Data) -> DataFrame:
    nested = d.orders.select(
        F.col("o_orderkey").alias("key"),
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("money")).alias("info"),
        F.array(F.lit("a"), F.lit("b")).alias("tags"),
    )
    return project.flatten(nested, arrays=True)


@query("row_uuid", "SELECT count(*) AS n, count(*) AS ids, 36 AS width FROM orders")
def row_uuid(d: Data) -> DataFrame:
    tagged = project.add_uuid(d.orders.select("o_orderkey"))
    return tagged.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("uuid").alias("ids"), F.max(F.length("uuid")).alias("width"))


@query("row_identifier", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS id FROM orders")
def row_identifier(d: Data) -> DataFrame:
    narrow = d.orders.select("o_orderkey", "o_totalprice")
    return project.add_identifier(narrow, order_by=["o_totalprice", "o_orderkey"]).select("o_orderkey", "id")


@query(
    "timestamp_parse_format",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS parsed, strftime(o_orderdate, '%Y-%m') AS month FROM orders""",
)
def timestamp_parse_format(d: Data) -> DataFrame:
    text = F.when(F.col("o_orderkey") % 9 == 0, "not a date").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy HH:mm"))
    df = project.to_timestamp(d.orders.select("o_orderkey", "o_orderdate", text.alias("text")), "text", "dd/MM/yyyy HH:mm", "parsed")
    df = project.format_timestamp(df, "o_orderdate", "yyyy-MM", "month")
    return df.select("o_orderkey", F.col("parsed").cast("timestamp_ntz").alias("parsed"), "month")


@query(
    "strings_concat_split",
    """SELECT p_partkey, concat_ws('/', p_brand, p_type, CAST(p_size AS VARCHAR)) AS tag, string_split(p_name, ' ')[1] AS colour,
         string_split(p_name, ' ')[2] AS thing FROM part""",
)
def strings_concat_split(d: Data) -> DataFrame:
    df = project.concatenate(d.part, ["p_brand", "p_type", "p_size"], "tag", "/")
    df = project.split_string(df, "p_name", " ", "words")
    return df.select("p_partkey", "tag", F.get("words", 0).alias("colour"), F.get("words", 1).alias("thing"))


@query(
    "lookup_dimension",
    """SELECT c_custkey, n_name, n_regionkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""",
)
def lookup_dimension(d: Data) -> DataFrame:
    doubled = d.nation.union(d.nation.select("n_nationkey", F.concat(F.lit("zz"), "n_name"), "n_regionkey"))
    dim = doubled.withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup(d.customer.select("c_custkey", "c_nationkey"), dim, ["c_nationkey"], ["n_name", "n_regionkey"]).drop("c_nationkey")


@query(
    "choice_resolve",
    """SELECT o_orderkey, TRY_CAST(code AS INTEGER) AS code_int, CASE WHEN TRY_CAST(code AS INTEGER) IS NULL THEN code END AS code_string FROM nulls""",
    "nulls",
)
def choice_resolve(d: Data) -> DataFrame:
    return project.resolve_choice(d.nulls.select("o_orderkey", "code"), "code", make_columns=["int", "string"])


@query(
    "schema_conformance",
    """SELECT 'o_discount' AS name, 'missing' AS problem, 'double' AS declared, NULL AS actual, 0 AS non_null
       UNION ALL SELECT 'o_orderpriority', 'extra', NULL, 'string', count(o_orderpriority) FROM orders
       UNION ALL SELECT 'o_orderkey', 'type', 'int', 'bigint', count(o_orderkey) FROM orders""",
)
def schema_conformance(d: Data) -> DataFrame:
    declared = schema_of([("o_orderkey", "int"), *ORDER_COLUMNS[1:5], ("o_discount", "double")])
    return project.schema_drift(d.orders, declared)
