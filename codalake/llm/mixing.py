"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Each source has a target of words: its weight's share of the whole, but `most` times its size at most; the excess
goes to the others by weight until none is above. A document's expected copies are r = target / size of its source: it is
taken floor(r) times, and once more with probability r - floor(r).

Which ones is decided by pivotal rounding of words: two documents with fractional masses (words times probability) meet, and
mass moves at random to the one or to the other, by probabilities that keep both means, until one of them is empty or
full. That one is decided; the other goes on. A source's mass never changes until a single document is left. That one is
rounded to the nearer end, so that the words taken differ from the target by half its size at most; long documents meet
first, which leaves a short one where that can be.

Pairs meet along a reduction tree. Rows that are equal (same source, id and size) form one class, of which a whole number
is taken and one row at most is fractional. The classes of each source are dealt by a hash to blocks of some BLOCK;
in each block an aggregate carries the residual document along and decides all others; a block's residual goes to the
parent of BLOCK neighbouring blocks, until one document of each source is left. So each level is one shuffle of what is
left, a source of any size is spread over as many groups as it needs, and no group holds more than a block. Random numbers are hashes of id, size, source and level: reruns agree, whatever the partitions.

Results for unusual input: a null text or one without words has size 0 and is taken 0 times; a null source is a source of its own,
the last; a null id is a value like any other; rows that are there twice are decided as one class and give two rows;
without words all targets are 0; a document's place in the input has no influence; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .groups import repeated, small

#: Documents of one group of the reduction tree, about.
BLOCK = 64
# What separates words.
_SPACES = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """The number of words, without gathering them: each word becomes one letter, then white space goes."""
    short = F.regexp_replace(text, r"[^\x20\x09-\x0D]++", "x")
    return F.coalesce(F.length(F.translate(short, _SPACES, "")).cast("bigint"), F.lit(0).cast("bigint"))


def numbered(rows: DataFrame, order: Column, name: str, scratch: Scratch) -> DataFrame:
    """rows (distinct in order) with their place from 0: ranges are sorted by themselves, and start where the ones before end."""
    parted = rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("part", F.spark_partition_id())
    parted = scratch.keep("parted", parted)
    counts = parted.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", start.alias("start"))  # a row for each partition
    place = F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return parted.join(F.broadcast(starts), "part").withColumn(name, place).drop("part", "start")


def targets(sizes: DataFrame, weights: list[int], share_percent: int, most: int, scratch: Scratch) -> DataFrame:
    """source, source_size, target. sizes: source, source_size (distinct sources).

    A target is least(most * source_size, level * weight) with the level that uses up the whole: found by fixing the
    sources that are above and sharing out the rest anew, one aggregate a round, until no further one is above.
    """
    order = F.asc_nulls_last("source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = scratch.keep("sources", numbered(sizes, order, "place", scratch).select("place", "source", "source_size", weight.cast("bigint").alias("weight")))
    whole = int(rows.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    top = most * F.col("source_size")
    share, full, known = top.cast("double"), F.lit(False), -1
    while True:
        got = rows.agg(
            F.coalesce(F.sum(F.when(full, F.col("source_size"))), F.lit(0)).alias("held"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("free"),
            F.count_if(full).alias("full"),
        ).first()
        if got["full"] == known or not got["free"]:
            break
        known = got["full"]
        rest = (share_percent * whole - 100 * most * int(got["held"])) / 100  # the sums are exact
        share = F.lit(rest) * F.col("weight") / F.lit(float(got["free"]))
        full = top <= share
    return rows.select("place", "source", "source_size", F.least(top.cast("double"), share).alias("target"))


def uniform(*parts: Column) -> Column:
    """A number above 0 and below 1 from a hash."""
    return (F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))


def fold(row: str, decided: str, level: int, seed: int) -> Column:
    """Of a block's rows (cap, h, c, mass), those of large cap first: the residual row `held`, and all others as `done` (c, up: 0 or 1)."""
    start = F.struct(F.lit(None).cast(row).alias("held"), F.array().cast(f"array<{decided}>").alias("done"))

    def step(acc: Column, new: Column) -> Column:
        old, done = acc["held"], acc["done"]
        a, b = old["mass"], new["mass"]
        room_old, room_new = old["cap"] - a, new["cap"] - b
        to_old, to_new = F.least(room_old, b), F.least(room_new, a)  # what can move to each
        # The chances are the other way round, so that each keeps its mean.
        towards_old = uniform(new["h"], old["h"], F.lit(level), F.lit(seed)) * (to_old + to_new) < to_new

        def left(keep: Column, mass: Column, out: Column, up: int) -> Column:
            held = F.struct(keep["cap"].alias("cap"), keep["h"].alias("h"), keep["c"].alias("c"), mass.alias("mass"))
            return F.struct(held.alias("held"), F.concat(done, F.array(F.struct(out["c"].alias("c"), F.lit(up).alias("up")))).alias("done"))

        moved = (
            F.when(towards_old & (b <= room_old), left(old, a + b, new, 0))
            .when(towards_old, left(new, b - room_old, old, 1))
            .when(a <= room_new, left(new, a + b, old, 0))
            .otherwise(left(old, a - room_new, new, 1))
        )
        return F.when(old.isNull(), F.struct(new.alias("held"), done.alias("done"))).otherwise(moved)

    return F.aggregate(F.sort_array("rows", asc=False), start, step)


def mix(
    docs: DataFrame,
    weights: list[int],
    share_percent: int = 150,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: int = 17,
    block: int = BLOCK,
) -> DataFrame:
    """One row per row of docs: doc_id, size, source_size, target, copies, taken (copies * size).

    weights: of the sources in the order of their names by code point, repeating; a copy number never exceeds `most`.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sized = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), word_count(F.col(f"`{text_col}`")).alias("size"))
    classes = scratch.keep("classes", sized.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("times")))
    found = scratch.keep("sizes", classes.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count(F.lit(1)).alias("classes")))
    goals = scratch.keep("goals", targets(found.select("source", "source_size"), weights, share_percent, most, scratch))
    goals = scratch.keep("targets", goals.join(found.select(F.col("source").alias("__source"), "classes"), F.col("source").eqNullSafe(F.col("__source"))).drop("__source"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    here = classes.withColumnRenamed("source", "__source").join(small(goals), F.col("source").eqNullSafe(F.col("__source")))
    here = here.withColumn("base", F.floor(ratio)).withColumn("extra", F.col("times") * (ratio - F.col("base")))
    here = here.withColumn("whole", F.floor("extra")).withColumn("mass", (F.col("extra") - F.col("whole")) * F.col("size"))
    payload = ["doc_id", "size", "times", "source_size", "target", "base", "whole"]
    here = here.select("place", F.ceil(F.col("classes") / block).alias("blocks"), F.struct(*payload).alias("c"), "mass", F.col("size").cast("double").alias("cap"))
    here = scratch.keep("units", here)
    kind = here.schema["c"].dataType.simpleString()
    row, decided = f"struct<cap:double,h:bigint,c:{kind},mass:double>", f"struct<c:{kind},up:int>"

    h = F.xxhash64("place", "c.doc_id", "c.size", F.lit(seed))
    left = here.where("mass > 0").withColumn("h", h).withColumn("block", F.pmod(F.shiftright("h", 7), F.col("blocks"))).select("place", "block", "h", "c", "mass", "cap")
    blocks = here.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    results, level = [here.where("mass <= 0").select("c", F.lit(0).alias("up"))], 0
    while True:
        rows = left.groupBy("place", "block").agg(F.collect_list(F.struct("cap", "h", "c", "mass")).alias("rows"))
        met = scratch.keep(f"level-{level}", rows.select("place", "block", fold(row, decided, level, seed).alias("f")).select("place", "block", "f.held", "f.done"))
        results.append(met.select(F.explode("done").alias("d")).select("d.c", "d.up"))
        left = met.select("place", F.expr(f"block div {block}").alias("block"), "held.*")
        if blocks <= 1:
            break
        blocks, level = math.ceil(blocks / block), level + 1
    results.append(left.select("c", (2 * F.col("mass") > F.col("cap")).cast("int").alias("up")))  # the last one of each source
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    out = repeated(out.select("c.*", "up"), "times", "copy")
    copies = F.col("base") + (F.col("copy") < F.col("whole") + F.col("up")).cast("bigint")
    out = out.withColumn("copies", copies).select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    out = scratch.keep("result", out)
    scratch.drop_all_but("result")
    return out
