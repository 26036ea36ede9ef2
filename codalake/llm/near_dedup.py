"""MinHash near-duplicate detection with sequential Bayesian verification.

1. Each text becomes the set of its word shingles (64-bit hashes). Equal sets form a
   class, represented by its smallest id, so exact copies cost one representative.
2. Representatives get a signature of BANDS x ROWS minima; those that agree in all rows
   of a band share a bucket.
3. Candidates come in steps, each without the pairs that links already connect:
   a. the smallest member of each bucket with the others;
   b. in buckets that still hold several components, the member whose shingles are the
      most frequent ones (the middle of a group of near copies) with the others;
   c. while the members outside their bucket's largest component could make many pairs with the rest: rounds that pair
      each of them with a few leaders of the bucket, drawn anew by a hash. The fewer they get, the more leaders each
      meets, so that a round makes about as many pairs as there are members in buckets. This joins groups whose members are similar to
      some of each other only, as where each lacks other parts of a common text;
   d. all pairs of members of such buckets that share a shingle among the rarest of both
      (prefix filtering): two sets that are similar enough always do, so this finds every
      pair that is left, with no cap, while a passage that many documents share makes no
      pairs, as its shingles are not among their rarest.
   A group of near copies, or one that links hold together, so costs about its size in pairs. What has no such bound is a
   group of very many texts that are nearly similar enough, and stay unlinked: d compares those of them that share one of their
   rarest shingles, since nothing less shows that no link is lost.
4. A candidate pair's signatures are compared batch by batch. After n positions with m
   agreements, the posterior probability (uniform prior) that the similarity reaches the
   threshold is P(Binomial(n + 1, threshold) <= m); below MISS the pair is pruned.
5. Survivors are verified exactly on their full shingle sets.
6. Verified links are contracted to components between the steps.

A pair at the threshold shares no bucket with probability (1 - t^ROWS)^BANDS, 3e-6 at
0.8 and 2e-8 at 0.85; the bound MISS adds at most 1e-6 per pair. Ids, band keys and the
shingles of members of shared buckets are shuffled; texts stay where they are while those ids
are few enough for a broadcast, else they meet the ids in one shuffle. A set joins its pairs
where the pairs are, and AQE splits the pairs of a leader that has very many.

Results for unusual input: a text that is null or has no words has an empty set, links
with nothing and is its own component; rows that are there twice belong to one class;
an empty table gives an empty result; rows with a null id never represent a class; ties for
a leader go to the smaller id; other columns are ignored. One id is taken to have one text.

The result is a table in the folder of spark.checkpoint.dir; all others made on the way are deleted.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_texts, tune
from .groups import components, small
from .hashing import MinHasher, mixed, numbers, shingle_sets

BANDS, ROWS = 24, 4
BATCH = 16
MISS = 1e-6

#: Rounds of drawn leaders go on while the last step might make more than so many pairs for each member of a bucket, and while each
#: round leaves no more than this share of the members outside; the most leaders that each of these meets in a round.
FEW_PAIRS = 4
LEAST_FALL = 0.9
MOST_LEADERS = 256
MOST_TURNS = 24

_PAIR = ["a", "b", "comp_a", "comp_b"]


def least_matches(threshold: float, miss: float = MISS, length: int = BANDS * ROWS, batch: int = BATCH) -> list[int]:
    """After each batch, the fewest agreements with which a pair goes on."""
    out = []
    for n in range(batch, length + 1, batch):
        total, m = 0.0, 0
        while True:  # P(Binomial(n + 1, t) <= m) is the posterior of m agreements
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if total >= miss:
                break
            m += 1
        out.append(m)
    return out


def posterior_survivors(a: np.ndarray, b: np.ndarray, needed: list[int], batch: int = BATCH) -> np.ndarray:
    """Which rows of signatures a and b survive; later batches are compared for survivors only."""
    left = np.arange(len(a))
    same = np.zeros(len(a), np.int64)
    for k, least in enumerate(needed):
        cut = slice(k * batch, (k + 1) * batch)
        same[left] += (a[left, cut] == b[left, cut]).sum(axis=1)
        left = left[same[left] >= least]
    return left


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band of each signature."""
    words = np.ascontiguousarray(signatures, np.uint32).view(np.uint64).reshape(-1, BANDS, ROWS // 2)
    keys = np.broadcast_to(numbers(BANDS, 5), words.shape[:2])
    with np.errstate(over="ignore"):
        for i in range(ROWS // 2):
            keys = mixed(keys ^ words[:, :, i])
    return keys.view(np.int64)


def _sketches(docs: DataFrame, k: int) -> DataFrame:
    """id, n_shingles, set_key (equal for equal sets) and band keys of each row."""
    hasher = MinHasher(BANDS * ROWS)

    def rows(texts):
        sizes, keys, signatures = [], [], []
        for x in shingle_sets(texts, k):
            sizes.append(len(x))
            keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None)
            signatures.append(hasher(x))
        bands = band_keys(np.stack(signatures))
        for i, n in enumerate(sizes):
            yield i, n, keys[i], bands[i] if n else None

    return map_texts(docs, "id", "text", [("n_shingles", "bigint"), ("set_key", "binary"), ("bands", "array<bigint>")], rows)


def _sets(docs: DataFrame, k: int) -> DataFrame:
    """id, n, signature, shingles."""
    hasher = MinHasher(BANDS * ROWS)

    def rows(texts):
        for i, x in enumerate(shingle_sets(texts, k)):
            yield i, len(x), hasher(x).tobytes(), x.view(np.int64)

    return map_texts(docs, "id", "text", [("n", "bigint"), ("signature", "binary"), ("shingles", "array<bigint>")], rows)


def _with_both(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """The pairs with n and the column of both members (x of a, y of b). Members' sets go to the pairs one side at a
    time, so that the set of a leader is not sent once for each of its pairs."""
    of = lambda end, name: sets.select(F.col("id").alias(end), F.col("n").alias(f"n_{end}"), F.col(column).alias(name))
    return pairs.join(of("b", "y"), "b").join(of("a", "x"), "a")


def _pruned(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that may be similar by their sizes and survive the posterior bounds."""
    needed = least_matches(percent / 100)
    both = _with_both(pairs, sets, "signature").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(-1, BANDS * ROWS) for c in ("x", "y"))
            left = pa.array(posterior_survivors(x, y, needed))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(left) for c in _PAIR], names=_PAIR)

    kind = dict(pairs.dtypes)["a"]
    return both.select(*_PAIR, "x", "y").mapInArrow(run, ", ".join(f"{c} {kind}" for c in _PAIR))


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs that are similar on their full sets. Only sets of paired members move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, at_x), (y, at_y) = ((c.values.to_numpy(), c.offsets.to_numpy()) for c in (batch.column("x"), batch.column("y")))
            good = [i for i in range(batch.num_rows) if similar(x[at_x[i] : at_x[i + 1]], y[at_y[i] : at_y[i + 1]], percent)]
            at = pa.array(good, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(at) for c in _PAIR], names=_PAIR)

    kind = dict(pairs.dtypes)["a"]
    return _with_both(pairs, sets, "shingles").select(*_PAIR, "x", "y").mapInArrow(run, ", ".join(f"{c} {kind}" for c in _PAIR))


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept (doc_id = component_id).

    Documents link where 100 * |intersection| >= percent * |union| of their shingle sets.
    """
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark, "near-dedup")
    docs = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    sketches = scratch.keep("sketches", _sketches(docs, shingle))
    reps = (
        sketches.where("set_key IS NOT NULL AND id IS NOT NULL")
        .groupBy("set_key")
        .agg(F.min(F.struct("id", "bands")).alias("r"))
        .select("set_key", "r.id", "r.bands")
    )
    reps = scratch.keep("reps", reps)
    roots = _roots(docs, sketches, reps, percent, shingle, scratch)
    classes = reps.select("set_key", "id").join(roots, "id", "left").select("set_key", F.coalesce("comp", "id").alias("component_id"))
    rows = sketches.select("id", "n_shingles", "set_key").join(classes, "set_key", "left")
    out = rows.select(
        F.col("id").alias("doc_id"),
        "n_shingles",
        F.coalesce("component_id", "id").alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    out = scratch.keep("result", out)
    scratch.drop_all_but("result")
    return out


def _roots(docs: DataFrame, sketches: DataFrame, reps: DataFrame, percent: int, shingle: int, scratch: Scratch) -> DataFrame:
    """(id, comp) of all representatives that share a bucket: the smallest id that verified links reach."""
    bands = reps.select("id", F.explode("bands").alias("bucket"))
    shared = bands.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first != last").drop("last")
    # Written first, so that the join is a stage by itself in which AQE may split the rows of a very frequent bucket.
    members = scratch.keep("members", bands.join(scratch.keep("shared", shared), "bucket"))
    scratch.drop("shared")
    ids = scratch.keep("ids", members.select("id").distinct())
    hint = small(ids)
    sets = _sets(docs.join(hint, "id", "left_semi"), shingle)
    if not sketches.select("id").join(hint, "id", "left_semi").groupBy("id").count().where("count > 1").isEmpty():
        sets = sets.dropDuplicates(["id"])  # rows that are there twice
    sets = scratch.keep("sets", sets)
    labels = ids.select("id", F.col("id").alias("comp"))

    def linked(name: str, candidates: DataFrame, labels: DataFrame) -> DataFrame:
        """labels after the candidate pairs are pruned, verified and contracted."""
        pairs = scratch.keep("pairs", candidates.select(*_PAIR).distinct())
        found = scratch.keep("found", _verified(scratch.keep("survivors", _pruned(pairs, sets, percent)), sets, percent))
        if not found.isEmpty():
            merged = components(found, "comp_a", "comp_b", scratch)
            labels = labels.join(merged, labels["comp"] == merged["node"], "left").select("id", F.coalesce("root", "comp").alias("comp"))
        labels = scratch.keep(name, labels)
        scratch.drop("pairs", "survivors", "found", "edges", "postings", "largest")
        return labels

    firsts = members.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.col("first").alias("comp_a"), F.col("id").alias("comp_b"))
    labels = linked("labels-1", firsts, labels)

    now = members.select("bucket", "id").join(labels, "id")
    mixed_ = now.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("bucket")
    live = scratch.keep("live", now.join(scratch.keep("mixed", mixed_), "bucket"))
    if live.isEmpty():
        return labels
    rare = scratch.keep("rare", _rare_first(sets, live.select("id", "comp").distinct(), percent))
    labels = linked("labels-2", _middles(live, rare, scratch), labels)
    live = scratch.keep("mixed", live.select("bucket", "id"))
    scratch.drop("live", "central", "leads", "members", "ids")
    labels = _rounds(live, labels, linked, scratch)
    scratch.drop("mixed", "state", "outside", "leads")
    return linked("labels-3", _prefix_pairs(rare, labels, percent, scratch), labels)


def _rounds(live: DataFrame, labels: DataFrame, linked, scratch: Scratch) -> DataFrame:
    """labels after rounds of drawn leaders. live: bucket, id. A round pairs the members outside their bucket's largest component
    with LEADERS members or more of the bucket; rounds end where the pairs that are left to the last step are few, or linked too little."""
    before = None
    for turn in range(MOST_TURNS):
        now = live.join(labels, "id")
        counts = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("m"))
        state = counts.groupBy("bucket").agg(F.max(F.struct("m", "comp")).alias("most"), F.sum("m").alias("m"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        state = scratch.keep("state", state.select("bucket", "m", F.col("most.comp").alias("largest"), F.col("most.m").alias("inside")))
        m, outside, pairs = state.agg(F.sum("m"), F.sum(F.expr("m - inside")), F.sum(F.expr("cast(m - inside AS double) * m"))).first()
        if not m or pairs <= FEW_PAIRS * m or (before is not None and outside > LEAST_FALL * before):
            break
        before = outside
        leaders = max(1, min(MOST_LEADERS, m // outside))
        drawn = F.xxhash64("id", F.lit(turn))
        rows = now.join(state.select("bucket", "largest"), "bucket")
        leads = rows.groupBy("bucket", F.pmod(F.xxhash64("id", F.lit(turn), F.lit("slot")), F.lit(leaders)).alias("slot")).agg(F.min(F.struct(drawn.alias("h"), "id", "comp")).alias("lead"))
        # Written first, so that AQE may split the rows of a very frequent bucket.
        leads = scratch.keep("leads", leads.select("bucket", "lead.id", "lead.comp"))
        rest = scratch.keep("outside", rows.where("comp != largest").select("bucket", "id", "comp"))
        labels = linked(f"labels-{turn % 2}-drawn", rest.alias("l").join(leads.alias("r"), "bucket").where("l.comp != r.comp").select(*_pair_of("l", "r")), labels)
    return labels


def _rare_first(sets: DataFrame, live: DataFrame, percent: int) -> DataFrame:
    """id, n (set size), own (shingles that no other component has), common (mean log frequency), prefix.

    The shingles of a set are ordered by the number of live sets that have them, those that a single component has
    first; prefix holds the others among the first that any similar set must meet, least frequent first.
    """
    rows = sets.select("id", "n", "shingles").join(live, "id").select("id", "n", "comp", F.explode("shingles").alias("s"))
    often = rows.groupBy("s").agg(F.count(F.lit(1)).alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low != high").select("s", "df")
    found = (
        rows.select("id", "n", "s")
        .join(often, "s")
        .groupBy("id", "n")
        .agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("shared"), F.sum(F.log(F.col("df") + 1.0)).alias("total"))
        .withColumn("own", F.col("n") - F.size("shared"))
    )
    # Of two similar sets, the larger one meets the other within its first n - ceil(t n) + 1.
    length = F.greatest(F.lit(0), F.expr(f"int(n - ({percent} * n + 99) div 100 + 1 - own)"))
    return found.select("id", "n", "own", (F.col("total") / F.col("n")).alias("common"), F.slice("shared.s", F.lit(1), length).alias("prefix"))


def _pair_of(left: str, right: str) -> list:
    """The columns of _PAIR for two rows of id and comp; a is the one with the smaller id."""
    id_l, id_r, comp_l, comp_r = (F.col(f"{x}.{c}") for c in ("id", "comp") for x in (left, right))
    first = id_l < id_r
    return [
        F.least(id_l, id_r).alias("a"),
        F.greatest(id_l, id_r).alias("b"),
        F.when(first, comp_l).otherwise(comp_r).alias("comp_a"),
        F.when(first, comp_r).otherwise(comp_l).alias("comp_b"),
    ]


def _middles(live: DataFrame, rare: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of each bucket's member with the most frequent shingles with its members of other components."""
    rows = scratch.keep("central", live.join(rare.select("id", "common"), "id"))
    leads = rows.groupBy("bucket").agg(F.max(F.struct("common", "id", "comp")).alias("m")).select("bucket", "m.id", "m.comp")
    leads = scratch.keep("leads", leads)
    return rows.alias("l").join(leads.alias("r"), "bucket").where("l.comp != r.comp").select(*_pair_of("l", "r"))


def _prefix_pairs(rare: DataFrame, labels: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """All pairs of different components that may be similar: they share a shingle of their prefixes, at places that
    leave enough to share.

    Of two similar sets, the smaller one meets the other within its first n - ceil(2 t n / (1 + t)) + 1: only such early rows of a
    shingle look for others, and those of its largest component for other components' only.
    """
    short = F.expr(f"n - (2 * {percent} * n + {99 + percent}) div {100 + percent} + 1")
    rows = (
        rare.join(labels, "id")
        .select("id", "comp", "n", "own", short.alias("short"), F.posexplode("prefix").alias("k", "s"))
        .select("s", "id", "comp", "n", (F.col("own") + F.col("k")).alias("place"), (F.col("own") + F.col("k") < F.col("short")).alias("early"))
    )
    rows = scratch.keep("postings", rows)
    counts = rows.groupBy("s", "comp").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("s").agg(F.max(F.struct("m", "comp")).alias("most"), F.count(F.lit(1)).alias("comps")).where("comps > 1").select("s", F.col("most.comp").alias("largest"))
    # Each join by itself, so that AQE may split the rows of a very frequent shingle.
    rows = scratch.keep("postings", rows.join(scratch.keep("largest", largest), "s"))
    meets = """
        l.comp != r.comp
        AND (l.n < r.n OR (l.n = r.n AND l.id < r.id))
        AND 100 * l.n >= {0} * r.n
        AND {1} * least(l.n - l.place, r.n - r.place) >= {0} * (l.n + r.n)
    """.format(percent, 100 + percent)
    early, others = rows.where("early"), rows.where("comp != largest")
    pair = lambda l, r: l.alias("l").join(r.alias("r"), "s").where(meets).select(*_pair_of("l", "r"))
    # The smaller set of a pair is early. Rows of the largest component meet those of the others only.
    return pair(early.where("comp != largest"), rows).unionByName(pair(early.where("comp = largest"), others))
