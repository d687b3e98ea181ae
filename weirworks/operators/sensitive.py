"""Detection, masking and hashing of sensitive data in text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weirworks.functions import entities as ent
from weirworks.functions.entities import Entity

def _with_marks(df: DataFrame, columns: Sequence[str], found: Sequence[Entity]) -> tuple[DataFrame, dict[tuple[str, str], Column]]:
    """The frame with one flag per column and marker, so that a text is tried for each marker only once."""
    names = {(c, m): f"_mark_{i}" for i, (c, m) in enumerate((c, m) for c in columns for m in sorted({e.marker for e in found if e.marker}))}
    flagged = df.withColumns({name: F.col(c).rlike(m) for (c, m), name in names.items()})
    flags = {key: F.col(name) for key, name in names.items()}
    return flagged, flags | {(c, ""): F.lit(True) for c in columns}


def row_audit(df: DataFrame, columns: Sequence[str], found: Sequence[Entity], to: str = "detected") -> DataFrame:
    """Every match of every entity as an array column of ``(entity, column, match)``."""
    flagged, flags = _with_marks(df, columns, found)
    lists = [_tagged(ent.matches(F.col(c), e, flags[c, e.marker]), e.name, c) for c in columns for e in found]
    return flagged.select(*[F.col(f"`{c}`") for c in df.columns], F.flatten(F.filter(F.array(*lists), lambda x: x.isNotNull())).alias(to))


def matches(df: DataFrame, keys: Sequence[str], columns: Sequence[str], found: Sequence[Entity]) -> DataFrame:
    """One row ``(keys, entity, column, match)`` per match."""
    audited = row_audit(df.select(*dict.fromkeys([*keys, *columns])), columns, found).select(*keys, "detected")
    # An inner explode would make the optimizer search every text once more to filter out those without a match.
    return audited.select(*keys, F.inline_outer("detected")).where("entity IS NOT NULL")


def _tagged(found: Column, entity: str, column: str) -> Column:
    return F.transform(found, lambda m: F.struct(F.lit(entity).alias("entity"), F.lit(column).alias("column"), m.alias("match")))


def _rewritten(df: DataFrame, columns: Sequence[str], found: Sequence[Entity], change) -> DataFrame:
    """One projection per entity: folding them into one expression would repeat the inner ones many times over."""
    for e in found:
        df = df.withColumns({c: change(F.col(c), e) for c in columns})
    return df


def row_masking(df: DataFrame, columns: Sequence[str], found: Sequence[Entity], mask: str = "*******") -> DataFrame:
    return _rewritten(df, columns, found, lambda t, e: ent.masked(t, e, mask))


def row_partial_masking(df: DataFrame, columns: Sequence[str], found: Sequence[Entity], keep: int = 4) -> DataFrame:
    return _rewritten(df, columns, found, lambda t, e: ent.partly_masked(t, e, keep))


def row_hashing(df: DataFrame, columns: Sequence[str], found: Sequence[Entity]) -> DataFrame:
    return _rewritten(df, columns, found, ent.hashed)


def column_audit(
    df: DataFrame, columns: Sequence[str], found: Sequence[Entity], *, sample: float = 1.0, threshold: float = 0.1, seed: int = 17
) -> DataFrame:
    """``(column, entity, rows, hits, ratio, sensitive)``: the share of rows with a match, in one aggregation."""
    if not 0 < sample <= 1:
        raise ValueError("sample is a fraction above 0")
    looked = df if sample == 1.0 else df.sample(fraction=sample, seed=seed)
    looked, flags = _with_marks(looked.select(*columns), columns, found)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.lit(e.name).alias("entity"), F.count(F.col(c)).alias("rows"),
            F.count_if(ent.occurs(F.col(c), e, flags[c, e.marker])).alias("hits"),
        )
        for c in columns
        for e in found
    ]
    out = looked.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    ratio = F.when(F.col("rows") > 0, F.col("hits") / F.col("rows")).otherwise(F.lit(0.0))
    return out.withColumn("ratio", ratio).withColumn("sensitive", F.col("ratio") >= threshold)


def _sensitive(audit: DataFrame) -> list[str]:
    # One row per column and entity, whatever the size of the data.
    return sorted({r["column"] for r in audit.where("sensitive").select("column").collect()})


def column_masking(df: DataFrame, columns: Sequence[str], found: Sequence[Entity], *, mask: str = "*******", **how) -> DataFrame:
    """Replace every value of the columns that count as sensitive."""
    flagged = _sensitive(column_audit(df, columns, found, **how))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.lit(mask)) for c in flagged}) if flagged else df


def column_hashing(df: DataFrame, columns: Sequence[str], found: Sequence[Entity], **how) -> DataFrame:
    """Replace every value of the columns that count as sensitive by its SHA-256."""
    flagged = _sensitive(column_audit(df, columns, found, **how))
    return df.withColumns({c: F.sha2(c, 256) for c in flagged}) if flagged else df
