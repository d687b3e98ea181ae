"""File readers: CSV, Parquet, JSON, and a reader chosen by file extension."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weirworks.functions.names import quoted

# Separator and quote names a CSV source may use.
SEPARATORS = {"comma": ",", "tab": "\t", "pipe": "|", "semicolon": ";", "ctrla": "\x01"}
QUOTES = {"quote": '"', "single_quote": "'", "quillemet": "«", "disabled": ""}

# Reader per file extension; anything else is read as JSON lines.
EXTENSIONS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".parquet": "parquet"}

Schema = T.StructType | str | None


def _paths(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def csv(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    schema: Schema = None,
    header: bool = True,
    separator: str = "comma",
    quote: str = "quote",
    escaper: str | None = None,
    multiline: bool = False,
    recurse: bool = True,
    infer: bool = False,
    sampling: float | None = None,
) -> DataFrame:
    """Delimited text. Without ``schema`` or ``infer`` every column is a string, so no extra pass is made.

    ``sampling`` is the share of rows that types are inferred from; the whole text is then still read through.
    """
    reader = (
        spark.read.option("header", header)
        .option("sep", SEPARATORS.get(separator, separator))
        .option("quote", QUOTES.get(quote, quote))
        .option("multiLine", multiline)
        .option("recursiveFileLookup", recurse)
    )
    if escaper:
        reader = reader.option("escape", escaper)
    if schema is not None:
        reader = reader.schema(schema)
    elif infer:
        reader = reader.option("inferSchema", True).option("samplingRatio", 1.0 if sampling is None else sampling)
    return reader.csv(_paths(paths))


def parquet(
    spark: SparkSession, paths: str | Sequence[str], *, schema: Schema = None, recurse: bool = True
) -> DataFrame:
    """Parquet files. With ``recurse`` off, ``key=value`` folders become partition columns."""
    reader = spark.read.option("recursiveFileLookup", recurse)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.parquet(*_paths(paths))


def json(
    spark: SparkSession,
    paths: str | Sequence[str],
    *,
    schema: Schema = None,
    multiline: bool = False,
    json_path: str | None = None,
    row_schema: Schema = None,
    recurse: bool = True,
    sampling: float | None = None,
) -> DataFrame:
    """JSON documents; ``json_path`` such as ``$.orders[*]`` makes each selected element a row.

    ``row_schema`` declares the selected elements: they are then read as variants, so the documents need neither a
    schema nor a pass to infer one. ``schema`` declares the documents; without both, all are read once to infer it.
    """
    if row_schema is not None:
        texts = spark.read.option("wholetext", multiline).option("recursiveFileLookup", recurse).text(_paths(paths))
        return select_variant_path(texts, "value", json_path or "$", row_schema)
    reader = spark.read.option("multiLine", multiline).option("recursiveFileLookup", recurse)
    if schema is not None:
        reader = reader.schema(schema)
    elif sampling is not None:
        reader = reader.option("samplingRatio", sampling)
    df = reader.json(_paths(paths))
    return df if not json_path else select_json_path(df, json_path)


def select_json_path(df: DataFrame, json_path: str) -> DataFrame:
    """Step into ``$.a.b[*].c``: a name selects a field, ``[*]`` makes one row per array element."""
    steps = [s for s in json_path.replace("[*]", ".[*]").removeprefix("$").split(".") if s]
    current = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("node"))
    for step in steps:
        if step == "[*]":
            current = current.select(F.explode("node").alias("node"))
        else:
            current = current.select(F.col(f"node.{quoted(step)}").alias("node"))
    kind = current.schema["node"].dataType
    return current.select("node.*") if isinstance(kind, T.StructType) else current.select(F.col("node").alias("value"))


# One step of a path: .name, ['name'] or ["name"], [n] or [*].
STEP = re.compile(r"""\.(?P<name>[^.\[\]]+)|\[\s*(?:'(?P<single>[^']*)'|"(?P<double>[^"]*)"|(?P<index>\d+)|(?P<every>\*))\s*\]""")


def path_steps(json_path: str) -> list[str | int | None]:
    """The steps of a path: field names, array places, and None for every element."""
    text, at, out = json_path.strip().removeprefix("$"), 0, []
    if text and text[0] not in ".[":
        text = "." + text
    while at < len(text):
        m = STEP.match(text, at)
        if not m:
            raise ValueError(f"cannot read {json_path!r} from {text[at:]!r}")
        named = m["name"] or m["single"] if m["double"] is None else m["double"]
        out.append(None if m["every"] else int(m["index"]) if m["index"] else named)
        at = m.end()
    return out


def select_variant_path(df: DataFrame, column: str, json_path: str, row_schema: T.StructType | str) -> DataFrame:
    """Rows of ``row_schema`` from the JSON texts in ``column``: the elements that ``json_path`` selects.

    Texts that are no JSON, documents without the path, and elements of ``[*]`` that are null give no row. A field that an
    element lacks, or whose value is not of its type, is null; elements that are no objects are read as a field ``value``.
    """
    schema = row_schema if isinstance(row_schema, T.StructType) else T.StructType.fromDDL(row_schema)
    current = df.select(F.try_parse_json(F.col(f"`{column}`")).alias("node")).where("node IS NOT NULL")
    for step in path_steps(json_path):
        if step is None:
            current = current.select(F.explode(F.col("node").try_cast("array<variant>")).alias("node"))
        else:
            place = f"$[{step}]" if isinstance(step, int) else _variant_name(step)
            current = current.select(F.try_variant_get("node", place, "variant").alias("node"))
        current = current.where("node IS NOT NULL AND NOT is_variant_null(node)")
    plain = schema.names == ["value"]
    fields = []
    for f in schema.fields:
        kind = f.dataType.simpleString()
        field = F.try_variant_get("node", _variant_name(f.name), kind)
        fields.append((F.coalesce(field, F.col("node").try_cast(f.dataType)) if plain else field).alias(f.name))
    return current.select(*fields)


def _variant_name(name: str) -> str:
    return f'$["{name}"]' if '"' not in name else f"$['{name}']"


def by_extension(spark: SparkSession, path: str, *, schema: Schema = None, sampling: float | None = None) -> DataFrame:
    """Pick the reader from the extension. CSV has a header and inferred types unless a schema is given.

    Without a schema, CSV and JSON texts are read once more to infer it, from ``sampling`` (a share) of their rows.
    """
    kind = EXTENSIONS.get(posixpath.splitext(path.rstrip("/"))[1].lower(), "json")
    if kind == "csv":
        return csv(spark, path, schema=schema, infer=schema is None, sampling=sampling)
    return parquet(spark, path, schema=schema) if kind == "parquet" else json(spark, path, schema=schema, sampling=sampling)


def text_documents(spark: SparkSession, paths: str | Sequence[str], *, whole: bool = False) -> DataFrame:
    """Text files with the file each row came from; ``whole`` gives one row per file."""
    reader = spark.read.option("recursiveFileLookup", True).option("wholetext", whole)
    return reader.text(_paths(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
