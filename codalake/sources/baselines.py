"""Golden baselines: JSON files of fixtures and their metrics, written where they are missing and read otherwise."""

from __future__ import annotations

import json

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .containers import store

#: Most values of a baseline: it is a file for people to read and to keep under version control.
MOST = 100_000


def write_baseline(values: DataFrame, path: str) -> None:
    """Writes fixture, metric, value as indented JSON with sorted keys and a newline at the end; folders are made as needed."""
    rows = values.select("fixture", "metric", F.col("value").cast("double").alias("value")).limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"a baseline holds at most {MOST} values")
    fixtures: dict[str, dict] = {}
    for r in rows:
        if r["metric"] in fixtures.setdefault(r["fixture"], {}):
            raise ValueError(f"{r['fixture']} has {r['metric']} twice")
        fixtures[r["fixture"]][r["metric"]] = r["value"]
    where, local = store(path)
    where.create_dir(local.rpartition("/")[0], recursive=True)
    # Written aside and moved, so that a reader sees the old file or the new one.
    with where.open_output_stream(f"{local}.new") as f:
        f.write((json.dumps({"fixtures": fixtures}, indent=2, sort_keys=True) + "\n").encode())
    where.move(f"{local}.new", local)


def read_or_write_baseline(current: DataFrame, path: str, update: bool = False) -> tuple[DataFrame, bool]:
    """(fixture, metric, value of the baseline; whether it was written now): of the current values where the file is missing or an
    update is asked for, of the file otherwise. A file that is no such JSON is an error."""
    where, local = store(path)
    wrote = update or where.get_file_info(local).type == pafs.FileType.NotFound
    if wrote:
        write_baseline(current, path)
    text = current.sparkSession.read.text(path, wholetext=True)
    fixtures = F.from_json("value", "fixtures map<string, map<string, double>>", {"mode": "FAILFAST"})["fixtures"]
    rows = text.select(F.explode(fixtures).alias("fixture", "m")).select("fixture", F.explode("m").alias("metric", "value"))
    return rows, wrote
