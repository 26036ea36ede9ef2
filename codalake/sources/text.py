"""Text sources: JSON-lines traces, checksum streams and figures scraped from logs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CHECKSUM = "idx int, width int, height int, key_frame boolean, show_frame boolean, y_md5 string, u_md5 string, v_md5 string, full_md5 string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (in file order, from 0), value; blank lines are left out.

    Lines are numbered within each block of a file that a task has read, and then get what earlier blocks hold.
    """
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__at"))
    kept = at.where(F.length(F.trim("value")) > 0)
    sizes = kept.groupBy("path", "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("path").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each block
    numbered = kept.withColumn("__k", F.row_number().over(Window.partitionBy("path", "__block").orderBy("__at")))
    return numbered.join(sizes.select("path", "__block", before.alias("__before")), ["path", "__block"]).select("path", (F.col("__k") - 1 + F.col("__before")).cast("int").alias("line_no"), "value")


def trace_rows(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path, line_no, row (a variant). A malformed line fails the scan if strict, and else is skipped."""
    parse = F.parse_json if strict else F.try_parse_json
    out = lines(spark, path).select("path", "line_no", parse("value").alias("row"))
    return out if strict else out.where("row IS NOT NULL")


def typed_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def frame_checksums(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a digest that is not 32 hex digits fail the read."""
    df = typed_rows(spark, path, CHECKSUM)
    good = lambda c: F.coalesce(F.col(c).rlike("^[0-9a-fA-F]{32}$"), F.lit(False))
    names = ["y_md5", "u_md5", "v_md5", "full_md5"]
    return df.withColumns({c: F.when(good(c), F.lower(c)).otherwise(F.raise_error(F.lit(f"{c} is no MD5"))) for c in names})


def metric_values(spark: SparkSession, path: str, key: str) -> DataFrame:
    """line_no, metric: the first key:value of each line that has one."""
    found = F.regexp_extract("value", rf"(?:^|\s){key}:([-+0-9.eE]+|inf|nan)", 1)
    return lines(spark, path).select("path", "line_no", found.alias("m")).where("m <> ''").select("path", "line_no", F.col("m").cast("double").alias("metric"))


def metric_of(value: Column, key: str) -> Column:
    """The first key:value of a line as a number; null without one."""
    found = F.regexp_extract(value, rf"(?:^|\s){key}:([-+0-9.eE]+|inf|nan)", 1)
    return F.when(found != "", found.try_cast("double"))


# The keys under which a frame's VMAF stands, in the order of preference.
VMAF_KEYS = ["vmaf", "integer_vmaf", "vmaf_score", "VMAF_score"]


def vmaf_frames(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, frame (from 0), vmaf of {"frames": [{"metrics": {name: value}}]} texts: the first of VMAF_KEYS that is there, or else the
    first other key that ends in 'vmaf' in any case; null for a frame without one (which makes the file unusable)."""
    frames = df.select(key, F.posexplode(F.from_json(F.col(text), "frames array<struct<metrics: map<string, double>>>")["frames"]).alias("frame", "f"))
    metrics = F.col("f.metrics")
    other = F.filter(F.array_sort(F.map_keys(metrics)), lambda k: F.lower(k).endswith("vmaf"))
    named = [F.try_element_at(metrics, F.lit(k)) for k in VMAF_KEYS]
    return frames.select(key, "frame", F.coalesce(*named, F.try_element_at(metrics, F.get(other, 0))).alias("vmaf"))


def elapsed_ms(value: Column) -> Column:
    """The time that an encoder has printed as '<n> us', '<n> ms' or '<n> s' in milliseconds; null without one."""
    number, unit = (F.regexp_extract(value, r"([0-9]+(?:\.[0-9]+)?)\s*(us|ms|s)\b", i) for i in (1, 2))
    scale = F.when(unit == "us", 0.001).when(unit == "ms", 1.0).otherwise(1000.0)
    return F.when(number != "", number.try_cast("double") * scale)


def key_values(value: Column, names: list[str], pair: str = r"\s+", equals: str = "=") -> Column:
    """A struct of whole numbers from key=value text; null if one is missing or there is another key."""
    found = F.str_to_map(F.trim(value), F.lit(pair), F.lit(equals))
    exact = F.size(F.array_except(F.map_keys(found), F.array(*map(F.lit, names)))) == 0
    every = F.size(F.array_intersect(F.map_keys(found), F.array(*map(F.lit, names)))) == len(names)
    return F.when(exact & every, F.struct(*[F.element_at(found, n).try_cast("bigint").alias(n) for n in names]))


def layer_sections(spark: SparkSession, path: str, header: str = r"For layer#:\s*([0-9]+)") -> DataFrame:
    """line_no, layer, value: each line with the layer of the last header above it."""
    at = lines(spark, path).withColumn("h", F.regexp_extract("value", header, 1))
    w = Window.partitionBy("path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    carried = at.withColumn("layer", F.last(F.when(F.col("h") != "", F.col("h").cast("int")), ignorenulls=True).over(w))
    return carried.where("h = '' AND layer IS NOT NULL").select("path", "line_no", "layer", "value")


def encode_summary(df: DataFrame, size: str, q: str, shown: Column) -> DataFrame:
    """Bytes of all rows; mean q and count of the shown ones (0 without any)."""
    return df.agg(F.coalesce(F.sum(size), F.lit(0)).alias("total_bytes"), F.coalesce(F.avg(F.when(shown, F.col(q))), F.lit(0.0)).alias("mean_q"), F.count_if(shown).alias("visible"))


def baselines(spark: SparkSession, path: str) -> DataFrame:
    """fixture, metric, value (a variant) of {"fixtures": {fixture: {metric: value}}} files."""
    df = spark.read.option("wholetext", "true").text(path).select(F.parse_json("value").alias("j"))
    return baseline_metrics(df, "j")


def baseline_metrics(df: DataFrame, column: str) -> DataFrame:
    """fixture, metric, value of a variant column of such objects."""
    tvf = df.sparkSession.tvf
    fixtures = df.select(F.variant_get(column, "$.fixtures", "variant").alias("j")).alias("b").lateralJoin(tvf.variant_explode(F.col("b.j").outer()).alias("f"))
    each = fixtures.select(F.col("f.key").alias("fixture"), F.col("f.value").alias("v")).alias("x").lateralJoin(tvf.variant_explode(F.col("x.v").outer()).alias("m"))
    return each.select("x.fixture", F.col("m.key").alias("metric"), F.col("m.value").alias("value"))


def write_events(df: DataFrame, path: str) -> None:
    """One JSON row per event, appended."""
    df.write.mode("append").json(path)


def first_pass_stats(spark: SparkSession, path: str, fields: list[str]) -> DataFrame:
    """path, idx and a double for each field, of files of fixed-width little-endian records."""
    width = 8 * len(fields)
    schema = ", ".join(["path string", "idx int", *(f"`{f}` double" for f in fields)])

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"], strict=True):
                if len(content) % width:
                    raise ValueError(f"{name} holds no whole records")
                rows = np.frombuffer(content, "<f8").reshape(-1, len(fields))
                out = pd.DataFrame(rows, columns=fields)
                out.insert(0, "idx", range(len(out)))
                out.insert(0, "path", name)
                yield out

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, schema)


# Seeds of a fuzzer: text files with one line []byte("...") whose literal is quoted as in the Go language.

# What a backslash and one letter stand for.
_ESCAPES = {"a": 7, "b": 8, "f": 12, "n": 10, "r": 13, "t": 9, "v": 11, "\\": 92, '"': 34}
_ESCAPE = re.compile(rb"""((?:\\x[0-9a-fA-F]{2})+)|\\(?:([abfnrtv\\"])|([0-3][0-7]{2})|u([0-9a-fA-F]{4})|U([0-9a-fA-F]{8})|(.?))""", re.S)


def unquoted(literal: bytes) -> bytes:
    """The bytes of a quoted literal, with escapes or between backquotes; anything else is an error."""
    if len(literal) > 1 and literal[:1] == literal[-1:] == b"`" and b"`" not in literal[1:-1]:
        return literal[1:-1].replace(b"\r", b"")
    body = literal[1:-1]
    if len(literal) < 2 or literal[:1] != b'"' or literal[-1:] != b'"' or b"\n" in body or re.search(rb'(?<!\\)(?:\\\\)*"', body):
        raise ValueError("no quoted literal")

    def one(m: re.Match) -> bytes:
        if m[1]:  # a whole run of bytes
            return bytes.fromhex(m[1].replace(b"\\x", b"").decode())
        if m[2]:
            return bytes([_ESCAPES[m[2].decode()]])
        if m[3]:
            return bytes([int(m[3], 8)])
        code = int(m[4] or m[5] or b"110000", 16)
        if code >= 0x110000 or 0xD800 <= code < 0xE000:
            raise ValueError("bad escape")
        return chr(code).encode()

    return _ESCAPE.sub(one, body)


def seed_bytes(content: Column | str) -> Column:
    """The bytes of the first []byte(...) line of a seed file; a file without one, or with a literal that is none, is an error."""

    @F.udf("binary", useArrow=True)
    def run(text: str | None) -> bytes | None:
        if text is None:
            return None
        for line in text.split("\n"):
            line = line.strip()
            if line.startswith("[]byte(") and line.endswith(")"):
                return unquoted(line[7:-1].encode("utf-8", "surrogateescape"))
        raise ValueError("no []byte(...) line found")

    return run(content)


def fuzz_seeds(spark: SparkSession, path: str) -> DataFrame:
    """path, seed: the bytes of all seed files below path."""
    files = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), seed_bytes("value").alias("seed"))


# Many seeds: archives of them, in which a line "-- name --" stands before each file (as in the Go language's txtar).

_NEXT = "\n-- "


def write_seed_archives(seeds: DataFrame, path: str) -> None:
    """Archives of seed files from name and literal (one line, quoted); as many as there are partitions, so that no file is made for each seed."""
    entry = F.concat(F.lit("-- "), F.col("name"), F.lit(' --\ngo test fuzz v1\n[]byte('), F.col("literal"), F.lit(")"))
    seeds.select(entry.alias("value")).write.text(path)


def archived_seeds(spark: SparkSession, path: str) -> DataFrame:
    """name, seed: the bytes of all seed files in the archives below path. Archives are cut between their files, at any size."""
    files = spark.read.option("lineSep", _NEXT).option("recursiveFileLookup", "true").text(path)
    # Only an archive's first file keeps its mark.
    name = F.regexp_extract("value", r"^(?:-- )?([^\n]*) --(?:\n|$)", 1)
    return files.select(name.alias("name"), seed_bytes("value").alias("seed"))
