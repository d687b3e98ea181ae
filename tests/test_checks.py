import os
import re

import pytest
from conftest import rows
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from weirworks.functions import entities as ent
from weirworks.operators import audit, custom, quality, sampling, sensitive
from weirworks.sinks import spigot, write_files, write_with_receipt
from weirworks.sources import Bookmark, by_extension, csv, jdbc
from weirworks.sources.files import path_steps, select_variant_path
from weirworks.sources import json as read_json
from weirworks.types import schema_of


@pytest.fixture(scope="module")
def people(spark):
    data = [(1, "ann", 5.0), (2, "bob", None), (2, None, 7.0), (None, "eve", 99.0)]
    return spark.createDataFrame(data, "id int, name string, v double").cache()


def outcome(df, *rules):
    return {r.rule: (r.metric, r.passed) for r in quality.evaluate(df, list(rules)).collect()}


def test_rules_over_rows_with_gaps(people):
    got = outcome(people, quality.row_count("=", 4), quality.is_complete("name"), quality.completeness("v", ">", 0.7), quality.is_unique("id"),
                  quality.uniqueness("id", ">=", 0.25), quality.distinct_count("id", "=", 2), quality.values_in("name", "ann", "bob", "eve"), quality.column_exists("zip"))
    assert got['IsUnique "id"'] == (0.25, False) and got['Uniqueness "id" >= 0.25'] == (0.25, True)
    assert got['DistinctValuesCount "id" = 2'] == (2.0, True)
    assert got['IsComplete "name"'] == (0.75, False) and got['Completeness "v" > 0.7'] == (0.75, True)
    assert got['ColumnValues "name" in ["ann", "bob", "eve"]'] == (0.75, False)
    assert got["RowCount = 4"] == (4.0, True) and got['ColumnExists "zip"'] == (0.0, False)


def test_rules_over_no_rows(people):
    got = outcome(people.limit(0), quality.row_count(), quality.is_complete("name"), quality.is_unique("id"), quality.statistic("Mean", "v", ">", 0))
    assert [p for _, p in (got["RowCount > 0"], got['IsComplete "name"'], got['IsUnique "id"'], got['Mean "v" > 0'])] == [False, True, True, False]


def test_rule_text_and_row_outcomes(people):
    assert quality.parse_rules('Rules = [\n  RowCount > 0, IsComplete "id"\n]') == [quality.row_count(), quality.is_complete("id")]
    with pytest.raises(ValueError):
        quality.parse_rules('Rules = [ Freshness "id" ]')
    frames = quality.split_by_outcome(people, [quality.is_complete("id"), quality.values_between("v", 0, 50)])
    assert (frames["passed"].count(), frames["failed"].count()) == (2, 2)


def test_stop_before_or_after_the_write(people):
    written = []
    bad = [quality.is_complete("id")]
    with pytest.raises(quality.QualityError):
        quality.write_checked(people, bad, lambda df: written.append("early"), stop="Immediate")
    assert written == []
    with pytest.raises(quality.QualityError):
        quality.write_checked(people, bad, lambda df: written.append("late"), stop="AfterDataLoad")
    quality.write_checked(people, bad, lambda df: written.append("never"), stop=None)
    assert written == ["late", "never"]


TEXTS = [(1, "write to ann.b@mail.example.com or +1 (499) 555-6503"), (2, "host 10.0.0.1 and 10.0.0.2"), (3, "nothing here"), (4, None),
         (5, "card 4111111111111111 ssn 123-45-6789 mac aa:bb:cc:dd:ee:ff")]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(TEXTS, "id int, t string").cache()


ALL = [ent.managed(n) for n in ent.PATTERNS]


def test_detection_against_python(texts):
    got = rows(sensitive.matches(texts, ["id"], ["t"], ALL))
    want = [(i, e.name, "t", m.group()) for i, t in TEXTS if t for e in ALL for m in re.finditer(e.pattern, t)]
    assert got == sorted(want, key=repr) and len(want) >= 7


def test_every_marker_is_part_of_every_match(spark):
    samples = {
        "EMAIL": "a@b.co", "CREDIT_CARD": "4111111111111111", "IP_ADDRESS": "1.2.3.4", "MAC_ADDRESS": "aa:bb:cc:dd:ee:ff", "PHONE_NUMBER": "(499) 555-6503",
        "USA_SSN": "123-45-6789", "USA_ITIN": "912-70-1234", "USA_DEA_NUMBER": "AB1234567", "USA_HCPCS_CODE": "A1234", "USA_NATIONAL_DRUG_CODE": "1234-567-8",
        "USA_MEDICARE_BENEFICIARY_IDENTIFIER": "1EG4-TE5-MK73", "UK_NATIONAL_INSURANCE_NUMBER": "AB123456C", "UK_BANK_SORT_CODE": "12-34-56",
        "UK_NATIONAL_HEALTH_SERVICE_NUMBER": "943 476 5919", "UK_VALUE_ADDED_TAX": "GBGD123", "UK_PHONE_NUMBER": "020 7946 0958", "CANADA_SIN": "046 454 286",
        "SPAIN_NIF_NIE": "X1234567L",
    }
    assert set(samples) == set(ent.PATTERNS)
    for e in ALL:
        assert re.search(e.pattern, samples[e.name]), e.name
        assert re.search(e.marker, samples[e.name]), e.name


def test_masks_and_hashes_keep_the_rest(spark, texts):
    mail, ip = ent.managed("EMAIL"), ent.managed("IP_ADDRESS")
    text = lambda df, i: df.where(f"id = {i}").first().t
    assert text(sensitive.row_masking(texts, ["t"], [mail, ip], "#"), 2) == "host # and #"
    assert text(sensitive.row_partial_masking(texts, ["t"], [mail, ip]), 2) == "host ****.0.1 and ****.0.2"
    import hashlib

    hashed = text(sensitive.row_hashing(texts, ["t"], [mail]), 1)
    assert hashlib.sha256(b"ann.b@mail.example.com").hexdigest() in hashed and hashed.startswith("write to ")
    assert text(sensitive.row_hashing(texts, ["t"], [mail]), 4) is None
    assert text(sensitive.row_hashing(texts, ["t"], [mail]), 3) == "nothing here"


def test_chained_rewrites_do_not_grow_the_plan(texts):
    plan = sensitive.row_hashing(texts, ["t"], [ent.managed(n) for n in ("EMAIL", "IP_ADDRESS", "CREDIT_CARD", "USA_SSN")])
    assert plan._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all") <= 4


def test_columns_count_as_sensitive_by_share(texts):
    audit_ = {(r.column, r.entity): (r.rows, r.hits, r.sensitive) for r in sensitive.column_audit(texts, ["t"], [ent.managed("EMAIL")], threshold=0.2).collect()}
    assert audit_ == {("t", "EMAIL"): (4, 1, True)}
    assert sensitive.column_masking(texts, ["t"], [ent.managed("EMAIL")], threshold=0.5).first().t == TEXTS[0][1]
    masked = sensitive.column_masking(texts, ["t"], [ent.managed("EMAIL")], threshold=0.2)
    assert [r.t for r in masked.orderBy("id").collect()] == ["*******"] * 3 + [None, "*******"]


def test_custom_entities(texts):
    with pytest.raises(ValueError):
        ent.custom("bad name!", "x")
    with pytest.raises(ValueError):
        ent.custom("empty", " ")
    with pytest.raises(ValueError):
        ent.managed("PERSON_NAME")
    with pytest.raises(ValueError):
        ent.validate(texts, "t", ent.custom("broken", "([a-z"))
    word = ent.custom("HOST_IP", r"[0-9.]{7,}", ["host"])
    assert [r.matches for r in ent.validate(texts, "t", word).orderBy("id").collect()] == [[], ["10.0.0.1", "10.0.0.2"], [], [], []]
    assert len(ent.MANAGED) == 38


def test_synthetic_rows_survive_the_steps_after(spark):
    schema = schema_of([("order_id", "string"), ("status", "string"), ("amount", "string"), ("big", "double"), ("flag", "boolean"), ("day", "date"), ("name", "string"), ("at", "timestamp_ntz")])
    made = audit.synthetic_rows(schema, 4, spark, hints={"status": "paid", "big": "9"}, casts={"order_id": "int", "amount": "double"}).orderBy("order_id").collect()
    first = made[0]
    assert len(made) == 4 and (first.order_id, first.status, first.amount, first.big, first.flag, first.name) == ("1", "paid", "1.5", 1.5, False, "name-1")
    assert str(first.day) == "2024-01-02" and str(first["at"]) == "2024-01-02 12:00:00"


def test_samples_keep_a_manifest(spark, tmp_path):
    home, df = str(tmp_path), spark.range(100).withColumn("k", F.col("id") % 2)
    assert sampling.capture(df, "a", home, rows=5, order=["id"], source="db.t").first().rows == 5
    sampling.capture(df, "a", home, rows=7)
    sampling.capture_by(df, "b", home, "k", {0: 1.0, 1: 0.0})
    assert rows(sampling.manifest(spark, home).select("node", "rows", "kind", "source")) == [("a", 7, "captured", None), ("b", 50, "stratified", None)]
    assert sampling.load(spark, home, "b", "id bigint").count() == 50


def test_bookmark_reads_each_file_once_and_rewritten_ones_again(spark, tmp_path):
    drop, mark = str(tmp_path / "drop"), Bookmark(spark, str(tmp_path / "mark"))
    spark.range(3).coalesce(1).write.parquet(drop)
    first = mark.read([drop], "id bigint", pattern="*.parquet")
    assert first.frame.count() == 3
    # Not committed: the same files come again.
    again = mark.read([drop], "id bigint", pattern="*.parquet")
    assert again.frame.count() == 3
    again.commit()
    spark.range(10, 12).coalesce(1).write.mode("append").parquet(drop)
    second = mark.read([drop], "id bigint", pattern="*.parquet")
    assert rows(second.frame) == [(10,), (11,)]
    second.commit()
    second.commit()
    empty = mark.read([drop], "id bigint", pattern="*.parquet")
    assert empty.frame.columns == ["id"] and empty.frame.count() == 0
    some = next(f for f in (tmp_path / "drop").iterdir() if f.name.endswith(".parquet"))
    os.utime(some, (1_900_000_000, 1_900_000_000))
    assert mark.read([drop], "id bigint", pattern="*.parquet").frame.count() in (2, 3)
    mark.reset()
    assert mark.read([drop], "id bigint", pattern="*.parquet").frame.count() == 5


def test_csv_dialects_and_extensions(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.csv").write_text("id\x01name\n1\x01«x\x01y«\n")
    assert rows(csv(spark, str(tmp_path), separator="ctrla", quote="quillemet")) == [("1", "x\x01y")]
    (tmp_path / "b.csv").write_text("id,v\n1,2.5\n")
    assert rows(by_extension(spark, str(tmp_path / "b.csv"))) == [(1, 2.5)]
    (tmp_path / "c.csv").write_text('a,"b"\n')
    assert rows(csv(spark, str(tmp_path / "c.csv"), header=False, quote="disabled")) == [("a", '"b"')]
    (tmp_path / "d.jsonl").write_text('{"x": {"y": [{"z": 1}, {"z": 2}]}}\n')
    assert rows(by_extension(spark, str(tmp_path / "d.jsonl")).select(F.size("x.y"))) == [(2,)]
    assert rows(read_json(spark, str(tmp_path / "d.jsonl"), json_path="$.x.y[*].z")) == [(1,), (2,)]


def test_writers(spark, tmp_path):
    df = spark.range(10).withColumn("p", F.col("id") % 2)
    receipt = write_with_receipt(df, "n", str(tmp_path / "r"), fmt="csv", partition_keys=["p"], compression="gzip")
    assert receipt.rows == 10 and (tmp_path / "r" / "p=0").exists()
    assert len(list((tmp_path / "r" / "p=0").glob("*.csv.gz"))) == 1
    with pytest.raises(ValueError):
        write_files(df, str(tmp_path / "x"), fmt="xlsx")
    with pytest.raises(AnalysisException, match="(?i)avro"):
        write_files(df, str(tmp_path / "x"), fmt="avro")
    assert spigot(df, str(tmp_path / "s"), top=3) is df and spark.read.json(str(tmp_path / "s")).count() == 3
    with pytest.raises(ValueError):
        spigot(df, str(tmp_path / "s"), top=101)
    with pytest.raises(ValueError):
        jdbc(spark, "jdbc:x", table="t", query="select 1")
    with pytest.raises(ValueError):
        jdbc(spark, "jdbc:x", table="t", partition_column="id")


def test_custom_steps(spark, people):
    with pytest.raises(ValueError):
        custom.sql_transform(spark, "SELECT 1", {"a": people}, {"b": "view"})
    first = custom.sql_transform(spark, "SELECT count(*) AS n FROM same", {"same": people})
    custom.sql_transform(spark, "SELECT 1", {"same": people.limit(0)})
    assert first.first().n == 4
    assert custom.custom_code(lambda f: {"x": f["in"].limit(1), "y": f["in"]}, {"in": people}).count() == 1
    registry = custom.built_in_transforms()
    registry.register(custom.Transform("keep", lambda df, n, mode="a": df.limit(n), (
        custom.Parameter("n", "int"), custom.Parameter("mode", "str", True, options=("a", "b")), )))
    assert registry.apply("keep", people, n=2).count() == 2
    for bad in ({}, {"n": "2"}, {"n": 1, "mode": "c"}, {"n": 1, "other": 2}, {"n": True}):
        with pytest.raises(ValueError):
            registry.apply("keep", people, **bad)
    rule = custom.Parameter("code", rule="[A-Z]{2}", message="two capitals")
    assert rule.check("AB") == "AB"
    with pytest.raises(ValueError, match="two capitals"):
        rule.check("abc")
    assert custom.Parameter("cols", "list", list_type="int").check([1, 2]) == [1, 2]


def test_preview_bounds(people):
    assert audit.preview(people, 2, ["v"]).count() == 2
    with pytest.raises(ValueError):
        audit.preview(people, 501)


def test_bookmark_over_many_files(spark, tmp_path):
    """5,000 files read before are left out by their time; of files as new as the new ones, those read before by name."""
    drop, mark = tmp_path / "many files", Bookmark(spark, str(tmp_path / "mark"))
    drop.mkdir()
    for n in range(5_000):
        (drop / f"{n}.json").write_text(f'{{"id": {n}}}\n')
        os.utime(drop / f"{n}.json", (1_600_000_000 + n, 1_600_000_000 + n))
    first = mark.read([str(drop)], "id bigint", fmt="json", pattern="*.json")
    assert first.frame.count() == 5_000
    first.commit()
    for n in (5_000, 5_001):
        (drop / f"{n}.json").write_text(f'{{"id": {n}}}\n')
        os.utime(drop / f"{n}.json", (1_600_004_999, 1_600_004_999))
    second = mark.read([str(drop)], "id bigint", fmt="json", pattern="*.json")
    assert rows(second.frame) == [(5_000,), (5_001,)]
    assert len(second.frame.inputFiles()) <= 10
    second.commit()
    assert mark.read([str(drop)], "id bigint", fmt="json", pattern="*.json").frame.count() == 0


def test_json_paths(spark):
    assert path_steps("""$.a['b.c']["d'e"][3][*].f""") == ["a", "b.c", "d'e", 3, None, "f"]
    assert path_steps("$") == [] and path_steps("a.b") == ["a", "b"]
    with pytest.raises(ValueError, match="cannot read"):
        path_steps("$.a[x]")
    texts = ['{"a": [{"n": 1, "s": "x", "l": [1, 2]}, {"n": "no"}, null, 7]}', '{"a": {"n": 2}}', '{"b": 1}', "not json", "", None]
    df = spark.createDataFrame([(t, 1) for t in texts], "value string, node int")
    kind = "n int, s string, l array<int>"
    assert rows(select_variant_path(df, "value", "$.a[*]", kind)) == sorted([(1, "x", [1, 2]), (None, None, None), (None, None, None)], key=repr)
    assert rows(select_variant_path(df, "value", "$.a[0]", kind)) == [(1, "x", [1, 2])]
    assert rows(select_variant_path(df, "value", "$.a[0].l[*]", "value int")) == [(1,), (2,)]
    assert select_variant_path(df.limit(0), "value", "$.a[*]", kind).count() == 0


def test_heavy_keys_by_sketch(spark):
    """Two heavy keys among 30,000: found by a sketch that tracks 1,000, counted exactly; an even table is counted in full."""
    data = spark.range(60_000).select(
        F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 30_000 + 2).cast("int").alias("k"), F.lit("x").alias("a.b")
    )
    found, lost = audit.heavy_keys(data, ["k", "a.b"], 100, 1_000)
    top = {r.k: r.rows for r in found.orderBy(F.desc("rows")).limit(2).collect()}
    assert top == {r.k: r["count"] for r in data.where("k = 1 OR k IS NULL").groupBy("k").count().collect()}
    assert 0 < lost < min(top.values())
    assert [(r.k, r.rows) for r in audit.skew_report(data, ["k"], 2).collect()] == sorted(top.items(), key=lambda kv: -kv[1])
    even = spark.range(20_000).select((F.col("id") % 10_000).alias("k"))
    assert [(r.k, r.rows) for r in audit.skew_report(even, ["k"], 3).collect()] == [(0, 2), (1, 2), (2, 2)]
    assert audit.skew_report(even.limit(0), ["k"]).count() == 0


def test_low_sensitivity_needs_a_whole_word(spark):
    texts = ["the ship at 10.0.0.1", "the IP 10.0.0.1", "ip:10.0.0.1", "hosts 10.0.0.1", "10.0.0.1 is a server"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    low = ent.managed("IP_ADDRESS", "LOW")
    assert [r.n for r in df.select(ent.count(F.col("t"), low).alias("n")).collect()] == [0, 1, 1, 0, 1]
    assert set(ent.PATTERNS) == set(ent.CONTEXT) and not any("@" in w for words in ent.CONTEXT.values() for w in words)


def test_low_sensitivity_without_words_is_an_error(monkeypatch):
    monkeypatch.delitem(ent.CONTEXT, "UK_VALUE_ADDED_TAX")
    with pytest.raises(ValueError, match="no context words"):
        ent.managed("UK_VALUE_ADDED_TAX", "LOW")
    assert ent.managed("UK_VALUE_ADDED_TAX").context == ()
