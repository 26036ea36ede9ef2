"""JSON-lines traces: typed views, projections and the lockstep comparison of two traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def of_type(rows: DataFrame, kind: str) -> DataFrame:
    return rows.where(F.variant_get("row", "$.type", "string") == kind)


def trace_float(row: str, key: str) -> Column:
    """A number, and 0 for anything else: booleans and numeric texts are not numbers."""
    value = F.try_variant_get(row, f"$.{key}", "variant")
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(row, f"$.{key}", "double")).otherwise(F.lit(0.0))


def field_or(row: str, key: str, kind: str, default) -> Column:
    return F.coalesce(F.try_variant_get(row, f"$.{key}", kind), F.lit(default))


def wildcard(column: Column, wanted: int) -> Column:
    """Equality where -1 asks for any value."""
    return F.lit(True) if wanted < 0 else column == wanted


def fields(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, field, value (canonical text): one row for each field that is there, explicit nulls included."""
    each = rows.sparkSession.tvf.variant_explode(F.col("t.row").outer()).alias("e")
    return rows.alias("t").lateralJoin(each).select(*[F.col(f"t.`{k}`") for k in keys], F.col("e.key").alias("field"), F.col("e.value").alias("value"))


def project(rows: DataFrame, allowed: dict[str, list[str]]) -> DataFrame:
    """Per type, only its allowed fields that are there; rows of other types go. line_no, type, fields (map of JSON texts)."""
    kept = fields(rows, ["line_no"]).select("line_no", "field", F.to_json("value").alias("text"))
    typed = rows.select("line_no", F.variant_get("row", "$.type", "string").alias("type"))
    pairs = [(t, f) for t, names in allowed.items() for f in names]
    allow = rows.sparkSession.createDataFrame(pairs, "type string, field string")
    hits = kept.join(typed, "line_no").join(F.broadcast(allow), ["type", "field"])
    return hits.groupBy("line_no", "type").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "text")))).alias("fields"))


def compare_traces(left: DataFrame, right: DataFrame, tolerance: dict[str, float] | None = None) -> DataFrame:
    """Row k of one trace against row k of the other: row_index, kind, field, left_value, right_value.

    Kinds: missing_left and missing_right (the other trace is longer), type_mismatch (then
    no fields are compared), field (absent differs from null). Numbers compare as doubles,
    within a field's inclusive tolerance if it has one. Order by (row_index, field) for listings.
    """
    a = left.select("line_no", F.col("row").alias("l"), F.variant_get("row", "$.type", "string").alias("lt"))
    b = right.select("line_no", F.col("row").alias("r"), F.variant_get("row", "$.type", "string").alias("rt"))
    both = a.join(b, "line_no", "full")
    none = F.lit(None).cast("string")
    missing = both.where(F.col("l").isNull() | F.col("r").isNull()).select(
        F.col("line_no").alias("row_index"), F.when(F.col("l").isNull(), "missing_left").otherwise("missing_right").alias("kind"), none.alias("field"), none.alias("left_value"), none.alias("right_value")
    )
    paired = both.where(F.col("l").isNotNull() & F.col("r").isNotNull())
    mismatch = paired.where(~F.col("lt").eqNullSafe(F.col("rt"))).select(F.col("line_no").alias("row_index"), F.lit("type_mismatch").alias("kind"), F.lit("type").alias("field"), F.col("lt").alias("left_value"), F.col("rt").alias("right_value"))
    same = paired.where(F.col("lt").eqNullSafe(F.col("rt"))).select("line_no")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return fields(rows.join(same, "line_no", "left_semi"), ["line_no"]).select(
            "line_no", "field", F.to_json("value").alias(f"{name}_value"), trace_number("value").alias(f"{name}_number")
        )

    joined = side(left, "left").join(side(right, "right"), ["line_no", "field"], "full")
    near = F.lit(0.0)
    for name, most in (tolerance or {}).items():
        near = F.when(F.col("field") == name, F.lit(float(most))).otherwise(near)
    numeric = F.col("left_number").isNotNull() & F.col("right_number").isNotNull()
    equal = F.when(numeric, (near >= 0) & (F.abs(F.col("left_number") - F.col("right_number")) <= near)).otherwise(F.col("left_value").eqNullSafe(F.col("right_value")))
    differing = joined.where(~equal | F.col("left_value").isNull() | F.col("right_value").isNull()).select(F.col("line_no").alias("row_index"), F.lit("field").alias("kind"), "field", "left_value", "right_value")
    return missing.unionByName(mismatch).unionByName(differing)


def trace_number(value: str) -> Column:
    kind = F.schema_of_variant(value)
    number = kind.isin("BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.when(number, F.try_variant_get(value, "$", "double"))


def last_states(events: DataFrame, name: str, action: str, order: str) -> DataFrame:
    """The last action of each test, and pass, fail and skip counts of all (a skipped test stays skipped)."""
    last = events.groupBy(name).agg(F.max(F.struct(order, action)).alias("m"), F.max((F.col(action) == "skip").cast("int")).alias("skipped"))
    state = F.when(F.col("skipped") == 1, "skip").otherwise(F.col(f"m.{action}"))
    return last.select(name, state.alias("state"))
