"""Cutting payloads into packets and putting them together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def packet_count(size: Column, first_room: Column, rest_room: Column) -> Column:
    """Packets of a payload whose first one holds first_room and whose others hold rest_room units; an empty payload has none."""
    more = F.greatest(size - first_room, F.lit(0))
    return F.when(size <= 0, 0).otherwise(1 + F.ceil(more / rest_room)).cast("int")


def packetize(df: DataFrame, payload: str, room: int, first_room: int | None = None) -> DataFrame:
    """One row per fragment: seq (from 0), fragment, start_of_frame, marker (on the last). Works on text and binary."""
    first = room if first_room is None else first_room
    if min(room, first) <= 0:
        raise ValueError("the packet size must exceed the descriptor's")
    size = F.length(payload)
    count = packet_count(size, F.lit(first), F.lit(room))
    rows = df.withColumn("__n", count).where("__n > 0").withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    at = F.when(F.col("seq") == 0, 1).otherwise(1 + first + (F.col("seq") - 1) * room).cast("int")
    take = F.when(F.col("seq") == 0, first).otherwise(room).cast("int")
    out = rows.withColumns({"fragment": F.substring(F.col(payload), at, take), "start_of_frame": F.col("seq") == 0, "marker": F.col("seq") == F.col("__n") - 1})
    return out.drop(payload, "__n")


def assemble(fragments: DataFrame, keys: list[str], fragment: str = "fragment", name: str = "payload") -> DataFrame:
    """The payload of each key from its fragments in order of seq; null where a fragment or the marker is missing or one comes twice."""
    parts = fragments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("seq", "marker", fragment))).alias("p"))
    last = F.size("p") - 1
    whole = (
        (F.element_at("p", 1)["seq"] == 0)
        & (F.element_at("p", -1)["seq"] == last)
        & F.element_at("p", -1)["marker"]
        & (F.size(F.filter("p", lambda x: x["marker"])) == 1)
        & (F.size(F.array_distinct(F.transform("p", lambda x: x["seq"]))) == F.size("p"))
    )
    binary = dict(fragments.dtypes)[fragment] == "binary"
    empty = F.lit(b"" if binary else "")
    joined = F.aggregate("p", empty, lambda acc, x: F.concat(acc, x[fragment]))
    return parts.select(*keys, F.when(whole, joined).alias(name))


def limit_layers(layers: Column, count: int) -> Column:
    """The first `count` layers of an access unit; null if one of them is dropped, empty or out of order."""
    kept = F.slice(layers, 1, count)
    bad = F.exists(F.transform(kept, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda y: y["x"]["dropped"] | (F.coalesce(F.length(y["x"]["payload"]), F.lit(0)) == 0) | (y["x"]["layer"] != y["i"]))
    return F.when(~bad & (F.size(kept) == count), kept)


def access_units(frames: DataFrame, keys: list[str], layer: str) -> DataFrame:
    """keys, layers: the layers of each access unit in order, as structs of the other columns."""
    rest = [c for c in frames.columns if c not in (*keys, layer)]
    return frames.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(layer, *rest))).alias("layers"))


def fan_out(df: DataFrame, percents: list[int]) -> DataFrame:
    """Each row once for each rung of a ladder: adds rung (from 0) and percent."""
    rungs = F.array(*[F.struct(F.lit(i).alias("rung"), F.lit(p).alias("percent")) for i, p in enumerate(percents)])
    return df.withColumn("__r", F.explode(rungs)).select(*df.columns, "__r.rung", "__r.percent")


def layer_fragments(units: DataFrame, layers: str, room: int) -> DataFrame:
    """The fragments of access units in one sequence: seq (from 0, over all layers), layer, fragment, start_of_frame and end_of_frame (of the
    layer), marker (the last one of the last layer).

    layers: an array of structs (head, payload) in order; head is the size of the descriptor of a layer's first fragment and the other ones
    are 1 smaller, of `room` units in all. A unit without layers, with an empty layer or a descriptor that leaves no room gives no
    fragments (see layer_packets).
    """
    n = lambda x: packet_count(F.length(x["payload"]), F.lit(room) - x["head"], F.lit(room) - x["head"] + 1)
    place = lambda x, k: F.when(k == 0, F.lit(1)).otherwise(1 + room - x["head"] + (k - 1) * (room - x["head"] + 1))
    take = lambda x, k: F.when(k == 0, room - x["head"]).otherwise(room - x["head"] + 1)

    def of_layer(x: Column, i: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n(x) - 1), lambda k: F.struct(i.alias("layer"), k.alias("k"), (k == n(x) - 1).alias("end"), (i == F.size(layers) - 1).alias("top"), place(x, k).alias("place"), take(x, k).alias("take")))

    rows = units.where(layer_packets(layers, room).isNotNull()).select("*", F.posexplode(F.flatten(F.transform(layers, of_layer))).alias("seq", "__f"))
    cut = F.substring(F.get(F.col(layers), F.col("__f.layer"))["payload"], F.col("__f.place"), F.col("__f.take"))
    out = rows.withColumns({"layer": F.col("__f.layer"), "fragment": cut, "start_of_frame": F.col("__f.k") == 0, "end_of_frame": F.col("__f.end"), "marker": F.col("__f.end") & F.col("__f.top")})
    return out.drop(layers, "__f")


def layer_packets(layers: str, room: int) -> Column:
    """How many fragments an access unit has; null where it has no layers, an empty one, or one whose descriptor leaves no room."""
    bad = (F.size(layers) == 0) | F.exists(layers, lambda x: (F.coalesce(F.length(x["payload"]), F.lit(0)) == 0) | (x["head"] >= room))
    total = F.aggregate(layers, F.lit(0), lambda s, x: s + packet_count(F.length(x["payload"]), F.lit(room) - x["head"], F.lit(room) - x["head"] + 1))
    return F.when(~F.coalesce(bad, F.lit(True)), total)
