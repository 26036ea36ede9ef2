"""Figures, names and listings as text, as SQL expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with so many decimals; halves of its shortest decimal form are rounded up."""
    return F.format_string(f"%.{digits}f", value.cast("double"))


def trimmed(value: Column) -> Column:
    """A whole number without decimals, others with up to four and no zeros at the end."""
    whole = value == F.floor(value)
    return F.when(whole, value.cast("bigint").cast("string")).otherwise(F.regexp_replace(fixed(value, 4), r"\.?0+$", ""))


def yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").when(~flag, "no").otherwise("")


def gap_cell(kind: Column, value: Column) -> Column:
    """A match rate as its gap to 100 percentage points, other figures as they are."""
    return F.when(value.isNull(), "").when(kind == "gap_pp", F.concat(trimmed(100 - value), F.lit("pp"))).otherwise(trimmed(value))


def duration(ns: Column, largest: str = "s") -> Column:
    """A time in the unit that fits, up to the largest one."""
    scaled = lambda by, unit: F.concat(fixed(ns / by, 2), F.lit(f" {unit}"))
    units = [("µs", 1_000), ("ms", 1_000_000), ("s", 1_000_000_000)]
    return _in_units(F.when(ns <= 0, "-"), ns, "ns", units, largest, scaled)


def byte_size(n: Column, largest: str = "GiB") -> Column:
    """A size in the unit that fits, up to the largest one."""
    scaled = lambda by, unit: F.concat(fixed(n / by, 2), F.lit(f" {unit}"))
    return _in_units(F, n, "B", [("KiB", 1024), ("MiB", 1024**2), ("GiB", 1024**3)], largest, scaled)


def _in_units(out, value: Column, one: str, units: list[tuple[str, int]], largest: str, scaled: Callable[[int, str], Column]) -> Column:
    """Continues `out` (F or a case) by the value itself below the first unit, and from each unit on, up to the largest one, scaled."""
    names = [name for name, _ in units]
    units = units[: names.index(largest) + 1]
    out = out.when(value < units[0][1], F.concat(value.cast("string"), F.lit(f" {one}")))
    for (name, by), (_, end) in zip(units, units[1:], strict=False):
        out = out.when(value < end, scaled(by, name))
    return out.otherwise(scaled(units[-1][1], units[-1][0]))


def ratio_text(ratio: Column, suffix: str) -> Column:
    return F.when(ratio <= 0, "-").otherwise(F.concat(fixed(ratio, 2), F.lit(suffix)))


def divergence_line(row: Column, kind: Column, frame: Column, field: Column, left: Column, right: Column) -> Column:
    """One line of a listing of differences; left and right are JSON texts."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.coalesce(c, F.lit("null")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return F.concat(F.lit("row="), row.cast("string"), F.lit(" kind="), kind, F.lit(" frame="), frame.cast("string"), F.lit(" field="), F.coalesce(field, F.lit("")), F.lit(" left="), quoted(left), F.lit(" right="), quoted(right))


def csv_line(*columns: tuple[Column, int | None]) -> Column:
    """A CSV row: whole numbers (None) as they are, others with a fixed number of decimals."""
    return F.concat_ws(",", *[c.cast("string") if d is None else fixed(c, d) for c, d in columns])


def case_name(case: Column, digest: Column) -> Column:
    """regression_<case>_<first eight digits of the digest>; a name that is one already stays."""
    return F.when(case.rlike(r"^regression_.+_[0-9a-f]{8}$"), case).otherwise(F.concat(F.lit("regression_"), case, F.lit("_"), F.substring(digest, 1, 8)))


def clean_log(log: Column) -> Column:
    """A test's own lines: without the framework's, without the place of a log call (file.go:line:) and its indent, and without
    log calls of subtests (eight spaces) and the lines that continue them. Lines are read once in order; a line that is
    indented by eight continues the last call."""
    framework = r"^(=== (RUN|PAUSE|CONT|NAME|UPDATE)\b|--- (PASS|FAIL|SKIP):|(PASS|FAIL)$|(ok|FAIL|\?|---)[ \t]+\S)"
    own, sub = r"^    [^ \t]\S*\.go:[0-9]+:[ \t]?", r"^        [^ \t]\S*\.go:[0-9]+:"

    def step(acc: Column, line: Column) -> Column:
        state = lambda kept, drop: F.struct(kept.alias("kept"), F.lit(drop).alias("drop"))
        add = lambda text: F.concat(acc["kept"], F.array(text))
        deep = line.startswith("        ")
        return (
            F.when(line.rlike(framework), state(acc["kept"], False))
            .when(line.rlike(sub), state(acc["kept"], True))
            .when(line.rlike(own + "wrote baseline "), state(acc["kept"], False))
            .when(line.rlike(own), state(add(F.regexp_replace(line, own, "")), False))
            .when(deep & acc["drop"], acc)
            .otherwise(F.struct(add(F.regexp_replace(line, "^( {8}| {4})", "")).alias("kept"), acc["drop"].alias("drop")))
        )

    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("drop"))
    return F.array_join(F.aggregate(F.split(log, "\n"), start, step)["kept"], "\n")
