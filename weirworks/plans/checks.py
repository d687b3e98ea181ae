"""Data quality, sensitive data, audits, previews, samples and incremental reads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weirworks import sinks, sources
from weirworks.functions import entities as ent
from weirworks.functions import search
from weirworks.operators import audit, project, quality, sampling, sensitive
from weirworks.operators.name_index import NameIndex
from weirworks.plans.registry import Data, query
from weirworks.session import scratch_path
from weirworks.types import schema_of

RULES = [
    quality.row_count(">", 0), quality.is_complete("o_orderkey"), quality.is_complete("status"), quality.completeness("price", ">=", 0.75),
    quality.is_unique("o_orderkey"), quality.is_unique("status"), quality.uniqueness("code", "<", 0.9), quality.distinct_count("status", "=", 2),
    quality.values_in("status", "F", "O"), quality.values_between("price", 0, 400000), quality.values_match("code", "[0-9]+"),
    quality.statistic("Mean", "price", ">", 1000), quality.column_exists("colour"),
]


@query(
    "quality_rules",
    """WITH c AS (SELECT code, count(*) AS n FROM nulls GROUP BY code),
         m AS (SELECT count(*)::DOUBLE AS n, count(status) / n AS cs, count(price) / n AS cp, count(*) FILTER (status IN ('F', 'O')) / n AS vi,
           count(*) FILTER (price BETWEEN 0 AND 400000) / n AS vb, count(*) FILTER (regexp_full_match(code, '[0-9]+')) / n AS vm, round(avg(price), 3) AS mean,
           (SELECT count(*) FROM c WHERE n = 1 AND code IS NOT NULL) / n AS uc FROM nulls)
       SELECT unnest([{'rule': 'RowCount > 0', 'metric': n, 'expected': '> 0', 'passed': n > 0},
         {'rule': 'IsComplete "o_orderkey"', 'metric': 1.0::DOUBLE, 'expected': '= 1', 'passed': true}, {'rule': 'IsComplete "status"', 'metric': cs, 'expected': '= 1', 'passed': cs = 1},
         {'rule': 'Completeness "price" >= 0.75', 'metric': cp, 'expected': '>= 0.75', 'passed': cp >= 0.75},
         {'rule': 'IsUnique "o_orderkey"', 'metric': 1.0::DOUBLE, 'expected': '= 1', 'passed': true}, {'rule': 'IsUnique "status"', 'metric': 0.0::DOUBLE, 'expected': '= 1', 'passed': false},
         {'rule': 'Uniqueness "code" < 0.9', 'metric': uc, 'expected': '< 0.9', 'passed': uc < 0.9},
         {'rule': 'DistinctValuesCount "status" = 2', 'metric': 2.0::DOUBLE, 'expected': '= 2', 'passed': true},
         {'rule': 'ColumnValues "status" in ["F", "O"]', 'metric': vi, 'expected': '= 1', 'passed': vi = 1},
         {'rule': 'ColumnValues "price" between ["0", "400000"]', 'metric': vb, 'expected': '= 1', 'passed': vb = 1},
         {'rule': 'ColumnValues "code" matches "[0-9]+"', 'metric': vm, 'expected': '= 1', 'passed': vm = 1},
         {'rule': 'Mean "price" > 1000', 'metric': mean, 'expected': '> 1000', 'passed': mean > 1000},
         {'rule': 'ColumnExists "colour"', 'metric': 0.0::DOUBLE, 'expected': '= 1', 'passed': false}], recursive := true) FROM m""",
    "nulls",
)
def quality_rules(d: Data) -> DataFrame:
    out = quality.evaluate(d.nulls, RULES)
    return out.withColumn("metric", F.when(F.col("rule").startswith("Mean"), F.round("metric", 3)).otherwise(F.col("metric")))


@query(
    "quality_text_rules",
    """SELECT 'RowCount > 0' AS rule, count(*)::DOUBLE AS metric, '> 0' AS expected, true AS passed FROM orders
       UNION ALL SELECT 'IsComplete "o_custkey"', 1.0, '= 1', true
       UNION ALL SELECT 'IsUnique "o_custkey"', (SELECT count(*) FROM (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(*) = 1)) / count(*), '= 1', false FROM orders""",
)
def quality_text_rules(d: Data) -> DataFrame:
    return quality.evaluate(d.orders, quality.parse_rules('Rules = [\n RowCount > 0, IsComplete "o_custkey", IsUnique "o_custkey"\n]'))


@query(
    "quality_references",
    """SELECT count(*) AS rows, count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) AS matched,
         count(*) FILTER (user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) / count(*) AS ratio FROM events""",
)
def quality_references(d: Data) -> DataFrame:
    return quality.referential_integrity(d.events, ["user_id"], d.customer.where("c_acctbal > 0"), ["c_custkey"])


@query(
    "quality_row_count_match",
    """SELECT 'lines' AS alias, (SELECT count(*) FROM orders) AS rows, count(*) AS other_rows, (SELECT count(*) FROM orders) / count(*) AS ratio FROM lineitem
       UNION ALL SELECT 'customers', (SELECT count(*) FROM orders), count(*), (SELECT count(*) FROM orders) / count(*) FROM customer""",
)
def quality_row_count_match(d: Data) -> DataFrame:
    return quality.row_count_match(d.orders, {"lines": d.lineitem, "customers": d.customer})


@query(
    "quality_dataset_match",
    """SELECT count(*) AS rows, count(*) FILTER (o_orderkey % 5 > 0) AS common, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 3 > 0) AS equal,
         0 AS repeats, count(*) FILTER (o_orderkey % 5 > 0 AND o_orderkey % 3 > 0) / count(*) AS ratio FROM orders""",
)
def quality_dataset_match(d: Data) -> DataFrame:
    changed = d.orders.where("o_orderkey % 5 > 0").withColumn("o_totalprice", F.expr("CASE WHEN o_orderkey % 3 = 0 THEN -1D ELSE o_totalprice END"))
    return quality.dataset_match(d.orders, changed, ["o_orderkey"], ["o_totalprice", "o_orderstatus"])


@query(
    "quality_dataset_match_repeats",
    """SELECT count(*) AS rows, count(*) AS common, count(*) AS equal, CAST(count(*) FILTER (o_orderkey % 4 = 0) + 1 AS BIGINT) AS repeats, 1.0::DOUBLE AS ratio
       FROM (SELECT o_orderkey FROM orders UNION ALL SELECT NULL)""",
)
def quality_dataset_match_repeats(d: Data) -> DataFrame:
    narrow = d.orders.select("o_orderkey", "o_orderstatus")
    nothing = d.region.limit(2).select(F.lit(None).cast("bigint"), F.lit("x"))
    return quality.dataset_match(narrow.union(nothing), narrow.union(narrow.where("o_orderkey % 4 = 0")).union(nothing.limit(1)), ["o_orderkey"], ["o_orderstatus"])


@query(
    "quality_composite_key",
    """WITH c AS (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_partkey, l_linenumber),
         p AS (SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ALL)
       SELECT 'IsPrimaryKey "l_orderkey" "l_partkey" "l_linenumber"' AS rule, (SELECT count(*) FILTER (n = 1) / sum(n) FROM c)::DOUBLE AS metric
       UNION ALL SELECT 'IsPrimaryKey "l_returnflag" "l_linestatus"', (SELECT count(*) FILTER (n = 1) / sum(n) FROM p)::DOUBLE""",
)
def quality_composite_key(d: Data) -> DataFrame:
    rules = [quality.Rule("IsPrimaryKey", ("l_orderkey", "l_partkey", "l_linenumber")), quality.Rule("IsPrimaryKey", ("l_returnflag", "l_linestatus"))]
    return quality.evaluate(d.lineitem, rules).select("rule", "metric")


@query("quality_stop_on_failure", "SELECT 'failed: IsUnique \"o_custkey\"' AS said, count(*) AS read, 0 AS written FROM orders")
def quality_stop_on_failure(d: Data) -> DataFrame:
    written, said = [], ""
    try:
        quality.write_checked(d.orders, [quality.row_count(), quality.is_unique("o_custkey")], written.append, stop="Immediate")
    except quality.QualityError as e:
        said = str(e)
    return d.orders.agg(F.lit(said).alias("said"), F.count(F.lit(1)).alias("read"), F.lit(len(written)).alias("written"))


@query(
    "quality_row_outcomes",
    """SELECT o_orderkey, concat_ws('; ', CASE WHEN status IS NULL THEN 'IsComplete "status"' END,
         CASE WHEN NOT coalesce(price BETWEEN 0 AND 200000, false) THEN 'ColumnValues "price" between ["0", "200000"]' END) AS failed FROM nulls""",
    "nulls",
)
def quality_row_outcomes(d: Data) -> DataFrame:
    marked = quality.row_outcomes(d.nulls, [quality.is_complete("status"), quality.values_between("price", 0, 200000), quality.row_count()])
    return marked.select("o_orderkey", F.array_join("failed_rules", "; ").alias("failed"))


@query("quality_split_frames", "SELECT status IS NOT NULL AS ok, count(*) AS n FROM nulls GROUP BY 1", "nulls")
def quality_split_frames(d: Data) -> DataFrame:
    frames = quality.split_by_outcome(d.nulls, [quality.is_complete("status")])
    return frames["passed"].agg(F.lit(True).alias("ok"), F.count(F.lit(1)).alias("n")).union(
        frames["failed"].agg(F.lit(False), F.count(F.lit(1)))
    )


@query("quality_published", "SELECT 'nightly' AS context, 'RowCount > 0' AS rule, true AS passed, count(*) AS written FROM orders")
def quality_published(d: Data) -> DataFrame:
    data, results = scratch_path(d.spark, "checked"), scratch_path(d.spark, "outcomes")
    held = quality.write_checked(d.orders, [quality.row_count()], lambda df: sinks.write_files(df, data), stop="AfterDataLoad")
    quality.publish(held, results, "nightly")
    written = sources.parquet(d.spark, data).agg(F.count(F.lit(1)).alias("written"))
    return sources.parquet(d.spark, results).select("context", "rule", "passed").crossJoin(F.broadcast(written))


ENTITIES = [ent.managed(name) for name in ent.PATTERNS]
COMMON = [ent.managed(n) for n in ("EMAIL", "PHONE_NUMBER", "IP_ADDRESS", "CREDIT_CARD", "USA_SSN")]


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _table(entities) -> str:
    return ", ".join(f"('{e.name}', {_quoted(e.pattern)})" for e in entities)


def _weave(text: str, entity, change: str) -> str:
    """DuckDB text of a rewrite: the pieces between the matches, each followed by the changed match."""
    p = _quoted(entity.pattern)
    return f"""array_to_string(list_transform(list_zip(string_split_regex({text}, {p}), regexp_extract_all({text}, {p})),
      lambda z: concat(z[1], CASE WHEN z[2] IS NULL THEN '' ELSE {change} END)), '')"""


@query(
    "pii_row_audit",
    f"""SELECT doc_id, name AS entity, 'text' AS "column", unnest(regexp_extract_all(text, pattern)) AS match
        FROM documents, (VALUES {_table(ENTITIES)}) t(name, pattern)""",
)
def pii_row_audit(d: Data) -> DataFrame:
    return sensitive.matches(d.wide("documents", "doc_id"), ["doc_id"], ["text"], ENTITIES)


def _masked_sql(entities) -> str:
    out = "text"
    for e in entities:
        out = f"regexp_replace({out}, {_quoted(e.pattern)}, '*******', 'g')"
    return out


@query("pii_row_masking", f"SELECT doc_id, {_masked_sql(COMMON)} AS text FROM documents")
def pii_row_masking(d: Data) -> DataFrame:
    return sensitive.row_masking(d.wide("documents", "doc_id").select("doc_id", "text"), ["text"], COMMON)


@query(
    "pii_row_partial_masking",
    f"""WITH a AS (SELECT doc_id, {_weave('text', COMMON[0], "concat(repeat('*', greatest(length(z[2]) - 4, 0)), right(z[2], 4))")} AS text FROM documents)
        SELECT doc_id, {_weave('text', COMMON[3], "concat(repeat('*', greatest(length(z[2]) - 4, 0)), right(z[2], 4))")} AS text FROM a""",
)
def pii_row_partial_masking(d: Data) -> DataFrame:
    return sensitive.row_partial_masking(d.wide("documents", "doc_id").select("doc_id", "text"), ["text"], [COMMON[0], COMMON[3]])


@query("pii_row_hashing", f"SELECT doc_id, {_weave('text', COMMON[0], 'sha256(z[2])')} AS text FROM documents")
def pii_row_hashing(d: Data) -> DataFrame:
    return sensitive.row_hashing(d.wide("documents", "doc_id").select("doc_id", "text"), ["text"], [COMMON[0]])


@query(
    "pii_column_audit",
    f"""SELECT 'text' AS "column", name AS entity, count(text) AS rows, count(*) FILTER (regexp_matches(text, pattern)) AS hits,
          count(*) FILTER (regexp_matches(text, pattern)) / count(text) AS ratio, count(*) FILTER (regexp_matches(text, pattern)) / count(text) >= 0.02 AS sensitive
        FROM documents, (VALUES {_table(ENTITIES)}) t(name, pattern) GROUP BY name""",
)
def pii_column_audit(d: Data) -> DataFrame:
    return sensitive.column_audit(d.wide("documents", "doc_id"), ["text"], ENTITIES, threshold=0.02)


@query("pii_column_masking", "SELECT doc_id, '*******' AS text, source FROM documents")
def pii_column_masking(d: Data) -> DataFrame:
    return sensitive.column_masking(d.wide("documents", "doc_id").select("doc_id", "text", "source"), ["text", "source"], COMMON, threshold=0.0001)


@query("pii_column_hashing", "SELECT doc_id, sha256(text) AS text, source FROM documents")
def pii_column_hashing(d: Data) -> DataFrame:
    return sensitive.column_hashing(d.wide("documents", "doc_id").select("doc_id", "text", "source"), ["text", "source"], COMMON, threshold=0.0001)


TOKEN = ent.custom("ACCESS_TOKEN", r"\b[0-9a-f]{40}\b", ["token ="])


@query(
    "pii_custom_entity",
    r"""SELECT doc_id, list_slice(regexp_extract_all(text, '\b[0-9a-f]{40}\b'), 1, 20)[1] AS first_match,
          CAST(len(list_slice(regexp_extract_all(text, '\b[0-9a-f]{40}\b'), 1, 20)) AS INTEGER) AS n FROM documents WHERE contains(lower(text), 'token =') AND regexp_matches(text, '\b[0-9a-f]{40}\b')""",
)
def pii_custom_entity(d: Data) -> DataFrame:
    checked = ent.validate(d.wide("documents", "doc_id"), "text", TOKEN).where(F.size("matches") > 0)
    return checked.select("doc_id", F.get("matches", F.lit(0)).alias("first_match"), F.size("matches").alias("n"))


@query(
    "pii_low_sensitivity",
    f"""SELECT doc_id, CAST(len(regexp_extract_all(text, {_quoted(ent.PATTERNS['IP_ADDRESS'])})) AS INTEGER) AS high,
          CASE WHEN regexp_matches(text, '\\b(ip|host|server|address)\\b', 'i')
            THEN CAST(len(regexp_extract_all(text, {_quoted(ent.PATTERNS['IP_ADDRESS'])})) AS INTEGER) ELSE 0 END AS low FROM documents""",
)
def pii_low_sensitivity(d: Data) -> DataFrame:
    text = F.col("text")
    return d.wide("documents", "doc_id").select(
        "doc_id", ent.count(text, ent.managed("IP_ADDRESS")).alias("high"), ent.count(text, ent.managed("IP_ADDRESS", "LOW")).alias("low")
    )


@query("preview_ordered", "SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def preview_ordered(d: Data) -> DataFrame:
    return audit.preview(d.orders.withColumn("_neg", -F.col("o_totalprice")), 50, ["_neg", "o_orderkey"]).drop("_neg")


@query(
    "schema_record",
    """SELECT 'event_id' AS name, 'bigint' AS type, count(event_id) AS non_null FROM events UNION ALL SELECT 'ts', 'timestamp_ntz', count(ts) FROM events
       UNION ALL SELECT 'user_id', 'bigint', count(user_id) FROM events UNION ALL SELECT 'event_type', 'string', count(event_type) FROM events
       UNION ALL SELECT 'value', 'double', count(value) FROM events UNION ALL SELECT 'props', 'string', count(props) FROM events""",
)
def schema_record(d: Data) -> DataFrame:
    return project.schema_record(d.events)


@query("sample_capture", "SELECT 'orders' AS node, 'json' AS format, 25 AS rows, 'captured' AS kind, 'db.orders' AS source, sum(o_orderkey)::BIGINT AS keys FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 25)")
def sample_capture(d: Data) -> DataFrame:
    home = scratch_path(d.spark, "samples")
    entry = sampling.capture(d.orders, "orders", home, rows=25, order=["o_orderkey"], source="db.orders")
    kept = sampling.load(d.spark, home, "orders", "o_orderkey bigint").agg(F.sum("o_orderkey").alias("keys"))
    return entry.select("node", "format", F.col("rows").cast("int").alias("rows"), "kind", "source").crossJoin(F.broadcast(kept))


@query(
    "synthetic_rows",
    """SELECT CAST(o_orderkey + 1 AS VARCHAR) AS order_id, 'paid' AS status, CAST(o_orderkey + 1 AS VARCHAR) || '.5' AS amount, (o_orderkey + 1) % 2 = 0 AS flag,
         CAST('2024-01-' || lpad(CAST(1 + (o_orderkey + 1) % 28 AS VARCHAR), 2, '0') AS DATE) AS day, 'note-' || CAST(o_orderkey + 1 AS VARCHAR) AS note,
         CAST(o_orderkey + 1 AS DOUBLE) + 0.5 AS weight FROM orders""",
)
def synthetic_rows(d: Data) -> DataFrame:
    schema = schema_of([("order_id", "string"), ("status", "string"), ("amount", "string"), ("flag", "boolean"), ("day", "date"), ("note", "string"), ("weight", "double")])
    numbers = d.orders.select((F.col("o_orderkey") + 1).alias("i"))
    return audit.synthetic_rows(schema, 0, d.spark, hints={"status": "paid"}, casts={"order_id": "int", "amount": "double"}, numbers=numbers)


@query(
    "synthetic_nested_rows",
    """SELECT o_orderkey + 1 AS id, 'tags-' || CAST(o_orderkey + 1 AS VARCHAR) AS first_tag, CAST(2 AS INTEGER) AS tags, 'city-' || CAST(o_orderkey + 1 AS VARCHAR) AS city,
         CAST(o_orderkey + 1 AS DOUBLE) + 0.5 AS lat, CAST(o_orderkey + 1 AS INTEGER) AS visits, 'key-' || CAST(o_orderkey + 1 AS VARCHAR) AS prop, 'x' AS fixed FROM orders""",
)
def synthetic_nested_rows(d: Data) -> DataFrame:
    schema = StructType.fromDDL("id long, tags array<string>, place struct<city string, at struct<lat double>>, visits array<struct<n int>>, props map<string, boolean>, fixed string")
    made = audit.synthetic_rows(schema, 0, d.spark, hints={"fixed": "x"}, numbers=d.orders.select((F.col("o_orderkey") + 1).alias("i")))
    return made.select(
        "id", F.get("tags", F.lit(0)).alias("first_tag"), F.size("tags").alias("tags"), "place.city", "place.at.lat",
        F.get("visits", F.lit(1))["n"].alias("visits"), F.get(F.map_keys("props"), F.lit(0)).alias("prop"), "fixed",
    )


@query(
    "incremental_second_read",
    """SELECT 'first' AS step, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM orders WHERE o_orderstatus = 'F'
       UNION ALL SELECT 'second', count(*), sum(o_orderkey)::BIGINT FROM orders WHERE o_orderstatus <> 'F' UNION ALL SELECT 'third', 0, NULL""",
)
def incremental_second_read(d: Data) -> DataFrame:
    home = scratch_path(d.spark, "drops")
    mark = sources.Bookmark(d.spark, scratch_path(d.spark, "bookmark"))
    narrow = d.orders.select("o_orderkey", "o_orderstatus")
    out = scratch_path(d.spark, "loaded")
    for step, drop in (("first", "o_orderstatus = 'F'"), ("second", "o_orderstatus <> 'F'"), ("third", None)):
        if drop:
            narrow.where(drop).write.mode("append").parquet(home)
        increment = mark.read([home], narrow.schema, pattern="*.parquet")
        total = increment.frame.agg(F.lit(step).alias("step"), F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
        total.write.mode("append").parquet(out)
        increment.commit()
    return sources.parquet(d.spark, out)


@query(
    "observed_counts",
    "SELECT 'orders' AS node, count(*) AS rows, 6 AS columns FROM orders UNION ALL SELECT 'paid', count(*), 2 FROM orders WHERE o_orderstatus = 'F'",
)
def observed_counts(d: Data) -> DataFrame:
    watched, seen = audit.observed_counts({"orders": d.orders})
    more, seen_more = audit.observed_counts({"paid": watched["orders"].where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")})
    more["paid"].write.parquet(scratch_path(d.spark, "observed"))
    counts = [(n, o.get["rows"], o.get["columns"]) for n, o in {**seen, **seen_more}.items()]
    return d.spark.createDataFrame(counts, "node string, rows bigint, columns int")


@query(
    "column_loss",
    """SELECT DISTINCT l_orderkey AS node, concat('c', l_linenumber) AS "column", 'dropped' AS problem FROM lineitem a WHERE NOT EXISTS
         (SELECT 1 FROM lineitem b WHERE b.l_returnflag <> 'R' AND b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber)
       UNION ALL SELECT DISTINCT l_orderkey, concat('c', l_linenumber + 1), 'missing' FROM lineitem a WHERE l_linestatus = 'O' AND NOT EXISTS
         (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1)
       UNION ALL SELECT l_orderkey, concat('c', l_linenumber), 'duplicate' FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_suppkey FROM lineitem) GROUP BY ALL HAVING count(*) > 1""",
)
def column_loss(d: Data) -> DataFrame:
    lines = d.lineitem.select(F.col("l_orderkey").alias("node"), F.concat(F.lit("c"), "l_linenumber").alias("column"), "l_returnflag", "l_linestatus", "l_linenumber", F.col("l_suppkey").alias("input"))
    asked = lines.where("l_linestatus = 'O'").select("node", F.concat(F.lit("c"), F.col("l_linenumber") + 1).alias("column"))
    dropped = audit.column_loss(lines, lines.where("l_returnflag <> 'R'")).withColumn("problem", F.lit("dropped"))
    missing = audit.missing_references(lines, asked).withColumn("problem", F.lit("missing"))
    doubled = audit.colliding_columns(lines).select("node", "column", F.lit("duplicate").alias("problem"))
    return dropped.union(missing).union(doubled)


@query(
    "cast_loss",
    """SELECT 'code' AS "column", 'int' AS to_type, count(code) AS values, count(*) FILTER (code IS NOT NULL AND TRY_CAST(code AS INTEGER) IS NULL) AS lost FROM nulls
       UNION ALL SELECT 'status', 'boolean', count(status), count(*) FILTER (status IS NOT NULL AND lower(status) NOT IN ('t', 'f')) FROM nulls
       UNION ALL SELECT 'price', 'long', count(price), 0 FROM nulls""",
    "nulls",
)
def cast_loss(d: Data) -> DataFrame:
    return audit.cast_loss(d.nulls, [("code", "int"), ("status", "boolean"), ("price", "long")])


@query(
    "join_health",
    """WITH l AS (SELECT user_id AS k FROM events), r AS (SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'P'),
         lc AS (SELECT k, count(*) AS l FROM l GROUP BY k), rc AS (SELECT k, count(*) AS r FROM r GROUP BY k)
       SELECT (SELECT count(*) FROM l) AS left_rows, (SELECT count(*) FROM r) AS right_rows, 0::BIGINT AS left_null_keys,
         (SELECT count(*) FROM l WHERE k IN (SELECT k FROM r)) AS left_matched, (SELECT count(*) FROM l WHERE k NOT IN (SELECT k FROM r)) AS left_unmatched,
         (SELECT count(*) FROM rc WHERE r > 1) AS right_repeated_keys, (SELECT coalesce(sum(l * r), 0)::BIGINT FROM lc JOIN rc USING (k)) AS joined_rows""",
)
def join_health(d: Data) -> DataFrame:
    return audit.join_health(d.events, d.orders.where("o_orderstatus = 'P'"), ["user_id"], ["o_custkey"])


@query(
    "skew_report",
    """SELECT user_id, count(*) AS rows, count(*) / (SELECT count(*) FROM events) AS share FROM events GROUP BY user_id ORDER BY rows DESC, user_id LIMIT 10""",
)
def skew_report(d: Data) -> DataFrame:
    return audit.skew_report(d.events, ["user_id"])


N = "trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g'))"
T = "trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'))"
K = "trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g'))"


def _score_sql(q: str, letters: str, typos: int) -> str:
    return f"""SELECT p_partkey, score FROM (SELECT p_partkey, CAST(CASE WHEN starts_with({N}, '{q}') THEN 1000 WHEN contains({N}, '{q}') THEN 901 - instr({N}, '{q}')
      WHEN contains({T}, '{q}') THEN 800 WHEN {K} = '{q}' THEN 780 WHEN starts_with({K}, '{q}') THEN 760 WHEN contains({K}, '{q}') THEN 700
      WHEN regexp_matches({N}, '{letters}') THEN 600 WHEN regexp_matches({T}, '{letters}') THEN 550
      WHEN len(list_filter(list_concat(string_split({N}, ' '), [replace({T}, ' ', ''), {K}]), lambda w: damerau_levenshtein('{q}', w) <= {typos})) > 0 THEN 500 END AS INTEGER) AS score
      FROM part) WHERE score IS NOT NULL"""


def _search(d: Data, text: str) -> DataFrame:
    scored = d.part.select("p_partkey", search.score(text, F.col("p_name"), F.col("p_type"), F.array("p_brand")).alias("score"))
    return scored.where(F.col("score").isNotNull())


@query("search_ranked", _score_sql("r b", "r.* .*b", 1))
def search_ranked(d: Data) -> DataFrame:
    return _search(d, "R-b")


@query("search_keywords", _score_sql("brand 1", "b.*r.*a.*n.*d.* .*1", 2))
def search_keywords(d: Data) -> DataFrame:
    return _search(d, "Brand#1")


@query("search_typos", _score_sql("widegt", "w.*i.*d.*e.*g.*t", 2))
def search_typos(d: Data) -> DataFrame:
    """From the index, which is built here and would be kept for further searches."""
    part = d.part.select("p_partkey", "p_name", "p_type", F.array("p_brand").alias("brands"))
    found = NameIndex.build(part, "p_partkey", "p_name", "p_type", "brands").search("widegt")
    return found.withColumnRenamed("id", "p_partkey")
