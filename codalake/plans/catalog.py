"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

Each applies one operator shape to whole tables. Timestamps are read as they are stored
(without a zone). Floating results are rounded, so that the order of a sum does not show.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codalake.functions import headers, rtp, scalars
from codalake.operators import aggregates as agg
from codalake.operators import compare, folds, intervals, ordered, packets, sets, traces

def registry() -> tuple[dict[str, Callable[[SparkSession, str], DataFrame]], dict[str, str], Callable]:
    """Queries by name, their SQL by name, and the decorator that adds to both."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    oracle_sql: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                oracle_sql[f.__name__] = sql
            return f

        return add

    return queries, oracle_sql, query


QUERIES, ORACLE_SQL, query = registry()


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r(column: Column | str, digits: int = 4) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, digits)


def json_rows(events: DataFrame) -> DataFrame:
    return events.withColumn("row", F.parse_json("props"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'error'")
def scan_filter_project(spark, sf_dir):
    return read(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", "value")


@query("SELECT event_id, coalesce(CAST(json_extract(props, '$.k') AS DOUBLE), 0) AS k, coalesce(CAST(json_extract(props, '$.absent') AS DOUBLE), 0) AS absent FROM events")
def json_get_default0(spark, sf_dir):
    rows = json_rows(read(spark, sf_dir, "events"))
    return rows.select("event_id", traces.trace_float("row", "k").alias("k"), traces.trace_float("row", "absent").alias("absent"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_row_wins(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return compare.last_row_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


_PERTURBED = "o_orderkey % 7 <> 0"


def _two_sides(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    return o.where("o_orderkey % 5 <> 0"), o.where(_PERTURBED).withColumn("price", F.col("price") + F.col("o_orderkey") % 3)


@query(f"""
WITH a AS (SELECT o_orderkey AS k, o_totalprice AS p FROM orders WHERE o_orderkey % 5 <> 0),
     b AS (SELECT o_orderkey AS k, o_totalprice + o_orderkey % 3 AS p FROM orders WHERE {_PERTURBED}),
     j AS (SELECT a.k AS ak, b.k AS bk, abs(a.p - b.p) AS d FROM a FULL JOIN b ON a.k = b.k)
SELECT count(ak) AS n_left, count(bk) AS n_right, count(d) AS matched, count(*) FILTER (bk IS NULL) AS left_only,
       count(*) FILTER (ak IS NULL) AS right_only, round(avg(d), 4) AS mean_abs_delta, round(max(d), 4) AS max_abs_delta,
       round(count(d) * 100.0 / greatest(count(ak), count(bk)), 4) AS match_pct FROM j""")
def cmp_keyed(spark, sf_dir):
    a, b = _two_sides(spark, sf_dir)
    out = compare.keyed_compare(a, b, ["o_orderkey"], "price")
    return out.withColumns({c: r(c) for c in ("mean_abs_delta", "max_abs_delta", "match_pct")})


@query("""
SELECT count(*) AS n, round(avg(CASE WHEN d.doc_id % 2 = l.quality THEN 1.0 ELSE 0.0 END) * 100, 4) AS quality_match_pct
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def cmp_left_miss_is_fail(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = compare.match_rates(d, read(spark, sf_dir, "labels"), ["doc_id"], ["quality"], unmatched_fail=True)
    return out.withColumn("quality_match_pct", r("quality_match_pct"))


@query("""
SELECT count(*) AS n, round(avg(CASE WHEN d.doc_id % 2 = l.quality THEN 1.0 ELSE 0.0 END) * 100, 4) AS quality_match_pct
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""")
def cmp_inner_miss_is_dropped(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    out = compare.match_rates(d, read(spark, sf_dir, "labels"), ["doc_id"], ["quality"], unmatched_fail=False)
    return out.withColumn("quality_match_pct", r("quality_match_pct"))


@query("""
WITH c AS (SELECT CAST(ts AS DATE) AS day, user_id % 40 AS u, count(*) AS n FROM events WHERE event_type = 'click' GROUP BY ALL),
     v AS (SELECT CAST(ts AS DATE) AS day, user_id % 40 AS u, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT coalesce(c.day, v.day) AS day, coalesce(c.u, v.u) AS u, c.n AS left_value, v.n AS right_value, c.n IS DISTINCT FROM v.n AS differs
FROM c FULL JOIN v ON c.day = v.day AND c.u = v.u""")
def cmp_full_outer(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), (F.col("user_id") % 40).alias("u"), "event_type")
    count = lambda t: e.where(F.col("event_type") == t).groupBy("day", "u").agg(F.count(F.lit(1)).alias("n"))
    return compare.full_outer_divergences(count("click"), count("view"), ["day", "u"], "n")


def _clicks_and_purchases(spark, sf_dir, how):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value", "event_type")
    side = lambda t: e.where(F.col("event_type") == t).drop("event_type")
    return compare.zip_positional(side("click"), side("purchase"), ["user_id"], ["ts", "event_id"], how)


_ZIP = """
WITH n AS (SELECT user_id, event_id, value, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS position FROM events),
     l AS (SELECT * FROM n WHERE event_type = 'click'), r AS (SELECT * FROM n WHERE event_type = 'purchase'),
     z AS (SELECT coalesce(l.user_id, r.user_id) AS user_id, coalesce(l.position, r.position) AS position, l.event_id AS le, r.event_id AS re, l.value AS lv, r.value AS rv
           FROM l FULL JOIN r ON l.user_id = r.user_id AND l.position = r.position)
"""


@query(_ZIP + "SELECT user_id, position, le AS click_id, re AS purchase_id, round(lv - rv, 4) AS delta FROM z WHERE le IS NOT NULL AND re IS NOT NULL")
def zip_positional(spark, sf_dir):
    z = _clicks_and_purchases(spark, sf_dir, "inner")
    return z.select("user_id", F.col("position").cast("bigint").alias("position"), F.col("l.event_id").alias("click_id"), F.col("r.event_id").alias("purchase_id"), r(F.col("l.value") - F.col("r.value")).alias("delta"))


@query(_ZIP + "SELECT user_id, count(*) FILTER (coalesce(abs(lv - rv) <= 50, false)) AS matches, coalesce(min(position) FILTER (NOT coalesce(abs(lv - rv) <= 50, false)), -1) AS first_mismatch FROM z GROUP BY user_id")
def zip_first_mismatch(spark, sf_dir):
    z = _clicks_and_purchases(spark, sf_dir, "full")
    out = compare.first_mismatch(z, ["user_id"], compare.within(F.col("l.value"), F.col("r.value"), F.lit(50.0)))
    return out.withColumn("first_mismatch", F.col("first_mismatch").cast("bigint"))


@query(_ZIP + """, g AS (SELECT user_id, position, lv - rv AS gap FROM z WHERE le IS NOT NULL AND re IS NOT NULL),
     best AS (SELECT * FROM g WHERE gap > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY gap DESC, position) = 1)
SELECT u.user_id, coalesce(position, -1) AS position, round(coalesce(gap, 0), 4) AS gap FROM (SELECT DISTINCT user_id FROM g) u LEFT JOIN best b ON u.user_id = b.user_id""")
def gap_argmax(spark, sf_dir):
    z = _clicks_and_purchases(spark, sf_dir, "inner")
    out = compare.gap_argmax(z, ["user_id"], F.col("l.value") - F.col("r.value"))
    return out.select("user_id", F.col("position").cast("bigint").alias("position"), r("gap").alias("gap"))


@query("""
SELECT l_returnflag, round(avg(abs(l_extendedprice * (1 - l_discount) - l_extendedprice) / greatest(abs(l_extendedprice), 1000) * 100), 4) AS mean_pct
FROM lineitem GROUP BY l_returnflag""")
def relative_error(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    err = compare.relative_error_pct(F.col("l_extendedprice") * (1 - F.col("l_discount")), F.col("l_extendedprice"), 1000.0)
    return li.groupBy("l_returnflag").agg(r(F.avg(err)).alias("mean_pct"))


@query("""
SELECT user_id, value AS extreme FROM (SELECT user_id, event_id, round(value - 40, 4) AS value FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY abs(value) DESC, event_id) = 1""")
def signed_extreme(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "event_id", r(F.col("value") - 40).alias("value"))
    return e.groupBy("user_id").agg(compare.signed_extreme(F.col("value"), F.col("event_id")).alias("extreme"))


@query("SELECT least(greatest(p_size, 0), 40)::BIGINT AS bin, count(*) AS n FROM part GROUP BY 1")
def hist_clamped(spark, sf_dir):
    return agg.histogram(read(spark, sf_dir, "part"), F.col("p_size"), 0, 40)


_BINS = "SELECT least(greatest(floor(value / 10), 0), 15)::BIGINT AS bin, count(*) AS n FROM events WHERE event_type = '{}' GROUP BY 1"


@query(f"""
SELECT sum(abs(coalesce(a.n, 0) - coalesce(b.n, 0)))::BIGINT AS l1, count(*) FILTER (coalesce(a.n, 0) <> coalesce(b.n, 0)) AS bins_differ
FROM ({_BINS.format('click')}) a FULL JOIN ({_BINS.format('view')}) b ON a.bin = b.bin""")
def hist_l1(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    hist = lambda t: agg.histogram(e.where(F.col("event_type") == t), F.floor(F.col("value") / 10), 0, 15)
    return agg.histogram_l1(hist("click"), hist("view"))


@query("""
WITH g AS (SELECT user_id % 10 AS bucket, event_type, count(*) AS n FROM events GROUP BY ALL),
     a AS (SELECT event_type, count(*) * 100.0 / (SELECT count(*) FROM events) AS all_pp FROM events GROUP BY 1)
SELECT bucket, event_type, n, round(n * 100.0 / sum(n) OVER (PARTITION BY bucket) - all_pp, 4) AS diff_pp FROM g JOIN a USING (event_type)""")
def match_rates_pp(spark, sf_dir):
    e = read(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("bucket"), "event_type")
    return agg.shares_pp(e, ["bucket"], "event_type").select("bucket", "event_type", "n", r("diff_pp").alias("diff_pp"))


@query("SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95, quantile_disc(l_quantity, 0.99) AS p99 FROM lineitem GROUP BY 1")
def pctl_nearest_rank(spark, sf_dir):
    return agg.percentiles(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity", [50, 95, 99])


@query("""
SELECT o_orderstatus, o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) = count(*) OVER (PARTITION BY o_orderstatus) // 2 + 1""")
def upper_median_row(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", "o_totalprice")
    return agg.upper_median_row(o, ["o_orderstatus"], ["o_totalprice", "o_orderkey"])


@query("SELECT event_type, round(exp(avg(ln(value)) FILTER (value > 0)), 4) AS geomean FROM events GROUP BY 1")
def geomean_pos(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(r(agg.geomean_positive(F.col("value"))).alias("geomean"))


@query("""
SELECT n_name, total FROM (SELECT n_name, round(sum(c_acctbal), 2) AS total FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)
QUALIFY row_number() OVER (ORDER BY total DESC, n_name) = 1""")
def argmax_tiebreak(spark, sf_dir):
    n = F.broadcast(read(spark, sf_dir, "nation"))  # 25 rows by definition
    total = read(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(r(F.sum("c_acctbal"), 2).alias("total"))
    return total.orderBy(F.col("total").desc(), "n_name").limit(1)


@query("""
WITH m AS (SELECT DISTINCT CAST(ts AS DATE) AS day, user_id FROM events), p AS (SELECT DISTINCT day AS a, day + 1 AS b FROM m),
     s AS (SELECT day, count(*) AS n FROM m GROUP BY 1),
     i AS (SELECT a, b, count(*) AS n FROM p JOIN m x ON x.day = a JOIN m y ON y.day = CAST(b AS DATE) AND x.user_id = y.user_id GROUP BY 1, 2)
SELECT p.a, CAST(p.b AS DATE) AS b, round(coalesce(i.n, 0) / (sa.n + coalesce(sb.n, 0) - coalesce(i.n, 0)), 6) AS jaccard
FROM p LEFT JOIN i ON p.a = i.a AND p.b = i.b JOIN s sa ON sa.day = p.a LEFT JOIN s sb ON sb.day = CAST(p.b AS DATE)""")
def jaccard_sets(spark, sf_dir):
    e = read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id")
    pairs = e.select(F.col("day").alias("a"), F.date_add("day", 1).alias("b")).distinct()
    out = sets.jaccard_of_groups(e, "day", "user_id", pairs)
    return out.withColumn("jaccard", r("jaccard", 6))


@query("""
WITH w AS (SELECT *, first_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nv FROM events)
SELECT event_id, user_id, coalesce(nv, -1) AS next_purchase FROM w WHERE event_type = 'error'""")
def next_valid(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = ordered.next_valid(e, ["user_id"], ["ts", "event_id"], F.col("value"), F.col("event_type") == "purchase", "next_purchase", F.lit(-1.0))
    return out.where("event_type = 'error'").select("event_id", "user_id", "next_purchase")


@query("""
WITH n AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS g FROM events),
     s AS (SELECT user_id, event_type, count(*) AS length FROM n GROUP BY user_id, event_type, g)
SELECT user_id, max(length) AS longest, count(*) AS runs FROM s GROUP BY 1""")
def streaks(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type")
    return ordered.streaks(e, ["user_id"], ["ts", "event_id"], "event_type").groupBy("user_id").agg(F.max("length").alias("longest"), F.count(F.lit(1)).alias("runs"))


@query("""
SELECT event_id, count(value) OVER w AS n, round(sum(value) OVER w, 4) AS total
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)""")
def rolling_window(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = ordered.forward_sum(e, ["user_id"], ["ts", "event_id"], F.col("value"), 8)
    return out.select("event_id", "n", r("total").alias("total"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 4) AS remaining FROM events")
def remaining_total(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    return ordered.remaining_total(e, ["user_id"], ["ts", "event_id"], "value", "remaining").select("event_id", r("remaining").alias("remaining"))


@query("""
WITH k AS (SELECT p_size % 4 AS layer, p_retailprice AS v FROM part)
SELECT l.layer AS in_layer, count(*) AS n, round(sum(v), 2) AS total FROM (SELECT unnest(range(0, 4)) AS layer) l JOIN k ON k.layer <= l.layer GROUP BY 1""")
def cumulative_layers(spark, sf_dir):
    p = read(spark, sf_dir, "part").select((F.col("p_size") % 4).cast("bigint").alias("layer"), "p_retailprice")
    out = agg.cumulative_layers(p, "layer", "p_retailprice", 4)
    return out.select(F.col("in_layer").cast("bigint").alias("in_layer"), "n", r("total", 2).alias("total"))


@query("""
WITH n AS (SELECT user_id, event_id, ts, [0, 2, 1, 2][(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 + 1] AS layer FROM events)
SELECT event_id, layer, (sum(CASE WHEN layer = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) % 256)::BIGINT AS tl0 FROM n""")
def periodic_schedule(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return ordered.periodic_schedule(e, ["user_id"], ["ts", "event_id"], [0, 2, 1, 2]).select("event_id", "layer", "tl0")


@query("""
WITH l AS (SELECT user_id, list(struct_pack(e := event_id, b := value) ORDER BY ts, event_id) AS xs FROM events GROUP BY 1),
     f AS (SELECT user_id, unnest(range(1, len(xs) + 1)) AS i, xs FROM l)
SELECT xs[i].e AS event_id, round(list_reduce(list_transform(xs[:i], lambda x: x.b), lambda s, b: least(s + 60.0, 500.0) - b, 200.0), 4) + 0.0 AS level FROM f""")
def leaky_bucket(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = ordered.leaky_bucket(e, ["user_id"], ["ts", "event_id"], F.lit(60.0), F.col("value"), 200.0, 500.0)
    return out.select("event_id", (r("level") + 0.0).alias("level"))  # no negative zero


_N = "n AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


@query(f"""
WITH RECURSIVE {_N}, s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 200.0::DOUBLE AS level, 0 AS factor, 0 AS cnt, false AS dropped FROM n
  UNION ALL
  SELECT user_id, rn, event_id, l - CASE WHEN d THEN 0 ELSE value END, f, CASE WHEN l < 0 THEN c WHEN f = 0 THEN 0 WHEN d THEN c - 1 ELSE f END, d FROM (
    SELECT *, l < 0 OR (f > 0 AND c > 0) AS d FROM (
      SELECT *, CASE WHEN l < 0 THEN f0 WHEN l > 120 AND f0 > 0 THEN f0 - 1 WHEN l <= 120 AND f0 = 0 THEN 1 ELSE f0 END AS f FROM (
        SELECT n.user_id, n.rn, n.event_id, n.value, least(s.level + 60, 500) AS l, s.factor AS f0, s.cnt AS c FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1))))
SELECT event_id, user_id, round(level, 4) + 0.0 AS level, dropped FROM s WHERE rn > 0""")
def drop_automaton(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = folds.drop_automaton(e, "user_id", ["ts", "event_id"], "value", 60.0, 500.0, 200.0, 60)
    return out.select("event_id", "user_id", (r("level") + 0.0).alias("level"), "dropped")  # no negative zero


@query(f"""
WITH RECURSIVE {_N}, s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 3::BIGINT AS cap, 0 AS slow, 0 AS fast FROM n
  UNION ALL
  SELECT user_id, rn, event_id, cap - (sl >= 2)::INT + (fa >= 6)::INT, CASE WHEN sl >= 2 THEN 0 ELSE sl END, CASE WHEN fa >= 6 THEN 0 ELSE fa END FROM (
    SELECT n.user_id, n.rn, n.event_id, s.cap, CASE WHEN n.value > 80 AND s.cap > 1 THEN s.slow + 1 ELSE 0 END AS sl,
           CASE WHEN 4 * n.value < 120 AND s.cap < 3 THEN s.fast + 1 ELSE 0 END AS fa FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1))
SELECT event_id, user_id, cap FROM s WHERE rn > 0""")
def cap_backoff(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value", F.lit(40.0).alias("due"), F.lit(3).cast("bigint").alias("want"))
    return folds.cap_controller(e, "user_id", ["ts", "event_id"], "value", "due", "want", 2, 6).select("event_id", "user_id", "cap")


@query(f"""
WITH RECURSIVE {_N}, s AS (
  SELECT user_id, rn, event_id, trunc(value * 100)::BIGINT AS rolling FROM n WHERE rn = 1
  UNION ALL
  SELECT n.user_id, n.rn, n.event_id, ((3 * s.rolling + trunc(n.value * 100)::BIGINT + 2) // 4)::BIGINT FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1)
SELECT event_id, user_id, rolling FROM s""")
def rolling_average(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("value") * 100).cast("bigint").alias("bits"))
    return folds.rolling_average(e, "user_id", ["ts", "event_id"], "bits").select("event_id", "user_id", "rolling")


@query(f"""
WITH RECURSIVE {_N}, s AS (
  SELECT DISTINCT user_id, 0::BIGINT AS rn, NULL::BIGINT AS event_id, 0::BIGINT AS next_id, -1::BIGINT AS base, NULL::BIGINT AS sig, NULL::BIGINT AS picture_id FROM n
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN again THEN next_id ELSE (next_id + 1) % 32768 END, base + (NOT gone AND event_id % 3 = 0)::INT, CASE WHEN gone THEN event_id % 4 END, CASE WHEN NOT again THEN next_id END FROM (
    SELECT n.user_id, n.rn, n.event_id, s.next_id, s.base, n.event_type = 'error' AS gone, n.event_type = 'error' AND s.sig IS NOT DISTINCT FROM n.event_id % 4 AS again
    FROM s JOIN n ON n.user_id = s.user_id AND n.rn = s.rn + 1))
SELECT event_id, user_id, picture_id, greatest(base, 0) % 256 AS tl0 FROM s WHERE rn > 0""")
def picture_sequence(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", (F.col("event_id") % 3).alias("layer"), (F.col("event_type") == "error").alias("dropped"), (F.col("event_id") % 4).alias("signature"))
    return folds.picture_ids(e, "user_id", ["ts", "event_id"], "layer", "dropped", "signature").select("event_id", "user_id", "picture_id", "tl0")


@query("""
WITH n AS (SELECT doc_id, text, unnest(range(0, (length(text) + 199) // 200)) AS seq FROM documents WHERE length(text) > 0)
SELECT doc_id, seq, md5(substr(text, seq * 200 + 1, 200)) AS fragment_md5, seq = (length(text) + 199) // 200 - 1 AS marker FROM n""")
def packetize_explode(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packets.packetize(d, "text", 200).select("doc_id", F.col("seq").cast("bigint").alias("seq"), F.md5("fragment").alias("fragment_md5"), "marker")


@query("SELECT doc_id, md5(text) AS payload_md5 FROM documents WHERE length(text) > 0")
def assemble_ordered(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select("doc_id", "text")
    return packets.assemble(packets.packetize(d, "text", 1200, 1100), ["doc_id"]).select("doc_id", F.md5("payload").alias("payload_md5"))


def _kmeans_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round by itself: the nearest centre of every value, and the mean of every centre's values."""
    steps = [f"k0 AS (SELECT i AS idx, (SELECT list(value ORDER BY value) FROM e)[((2 * i + 1) * (SELECT count(*) FROM e)) // {2 * k} + 1] AS center FROM (SELECT unnest(range(0, {k})) AS i))"]
    for i in range(rounds):
        near = f"(SELECT event_id, any_value(value) AS value, min(struct_pack(d := abs(value - center), i := idx)).i AS idx FROM e, k{i} GROUP BY event_id)"
        steps.append(f"k{i + 1} AS (SELECT c.idx, coalesce(avg(a.value), any_value(c.center)) AS center FROM k{i} c LEFT JOIN {near} a ON a.idx = c.idx GROUP BY c.idx)")
    return f"WITH e AS (SELECT event_id, value FROM events WHERE value IS NOT NULL), {', '.join(steps)} SELECT idx::INT AS cluster, round(center, 4) AS center FROM k{rounds}"


@query(_kmeans_sql())
def kmeans1d_10(spark, sf_dir):
    return folds.kmeans_1d_distributed(read(spark, sf_dir, "events"), "value").select("cluster", r("center").alias("center"))


_INTERVALS = """
WITH c AS (SELECT user_id, ts, value, date_trunc('day', ts) AS start, lag(value) OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts) AS prev FROM events),
     s AS (SELECT user_id, start, count(*) AS n, min(value) AS low, max(value) AS high, arg_max(value, ts) - arg_min(value, ts) AS delta, count(*) FILTER (prev IS NOT NULL AND prev <> value) AS changes FROM c GROUP BY 1, 2)
"""


@query(_INTERVALS + "SELECT user_id, CAST(start AS DATE) AS day, n, low, high, round(delta, 4) AS delta, changes FROM s")
def tumbling_intervals(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = intervals.summarise_intervals(e, ["user_id"], "ts", "value", "1 day")
    return out.select("user_id", F.to_date("start").alias("day"), "n", "low", "high", r("delta").alias("delta"), "changes")


@query(_INTERVALS + "SELECT user_id, sum(n)::BIGINT AS n, min(low) AS low, max(high) AS high, round(sum(coalesce(delta, 0)), 4) AS delta, sum(changes)::BIGINT AS changes FROM s GROUP BY 1")
def tumbling_rollup(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    out = intervals.roll_up(intervals.summarise_intervals(e, ["user_id"], "ts", "value", "1 day"), ["user_id"])
    return out.withColumn("delta", r("delta"))


@query("""
WITH w AS (SELECT *, last_value(CASE WHEN event_type = 'purchase' THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS lp FROM events)
SELECT event_id, user_id, epoch_us(ts) - epoch_us(lp) AS idle_us FROM w WHERE event_type <> 'purchase' AND epoch_us(ts) - epoch_us(lp) > 259200000000""")
def stall_detector(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    out = intervals.stalls(e, ["user_id"], "ts", F.col("event_type") == "purchase", 3 * 86400)
    return out.select("event_id", "user_id", "idle_us")


@query("""
SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN length(text) END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS carried FROM conversations""")
def section_header_carry(spark, sf_dir):
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = ordered.carry_last(c, ["conv_id"], ["turn"], F.when(F.col("role") == "user", F.length("text").cast("bigint")), "carried")
    return out.select("conv_id", "turn", "carried")


@query("""
WITH a AS (SELECT l_orderkey % 50 AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'A'), b AS (SELECT l_orderkey % 50 AS k, l_linenumber AS v FROM lineitem WHERE l_returnflag = 'R')
SELECT side, k, v, count(*) AS n FROM (SELECT 'missing' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'unexpected' AS side, * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL""")
def union_except(spark, sf_dir):
    li = read(spark, sf_dir, "lineitem")
    side = lambda f: li.where(F.col("l_returnflag") == f).select((F.col("l_orderkey") % 50).alias("k"), F.col("l_linenumber").alias("v"))
    return sets.except_both_ways(side("A"), side("R")).groupBy("side", "k", "v").agg(F.count(F.lit(1)).alias("n"))


@query("""
WITH g AS (SELECT *, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gop FROM events)
SELECT user_id, gop::BIGINT AS gop, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY 1, 2""")
def group_sums(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type", "value")
    out = ordered.group_number(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", "gop")
    return out.groupBy("user_id", "gop").agg(F.count(F.lit(1)).alias("n"), r(F.sum("value")).alias("total"))


@query("""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)
SELECT event_id, (max(floor(value)::BIGINT - rn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) + rn)::BIGINT AS media FROM n""")
def monotone_counter(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = ordered.monotone_counter(e, ["user_id"], ["ts", "event_id"], F.floor("value"), "media")
    return out.select("event_id", F.col("media").cast("bigint").alias("media"))


@query("""
SELECT event_id, count(value) OVER w = 3 AND min(value) OVER w >= 5 AS still FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)""")
def transition_to_still(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = ordered.all_next_at_least(e, ["user_id"], ["ts", "event_id"], F.col("value"), 3, 5.0, "still")
    return out.select("event_id", F.coalesce("still", F.lit(False)).alias("still"))


@query("""
WITH b AS (SELECT event_type, least(floor(value / 100), 19)::BIGINT AS bin, count(*) AS n FROM events WHERE floor(value / 100) < 30 GROUP BY 1, 2),
     s AS (SELECT event_type, bin + d AS bin, sum(n)::BIGINT AS n FROM b, (SELECT unnest([-1, 0, 1]) AS d) WHERE bin + d BETWEEN 0 AND 19 GROUP BY 1, 2)
SELECT event_type, bin, n FROM s QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY n DESC, bin) = 1""")
def noise_level(spark, sf_dir):
    return agg.noise_level(read(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT l_linestatus, count(*) AS frames, sum(l_quantity)::BIGINT AS bytes, round(sum(l_quantity) * 8 * 30 / (count(*) * 1000.0), 4) AS kbps FROM lineitem GROUP BY 1")
def bitrate_fold(spark, sf_dir):
    out = read(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("frames"), F.sum("l_quantity").cast("bigint").alias("bytes"))
    return out.withColumn("kbps", r(agg.bitrate_kbps(F.col("bytes"), F.col("frames"), F.lit(30))))


@query("SELECT event_type, round(min(value) - (max(value) - min(value)) * 0.08, 4) AS low, round(max(value) + (max(value) - min(value)) * 0.08, 4) AS high FROM events GROUP BY 1")
def value_scale(spark, sf_dir):
    return read(spark, sf_dir, "events").groupBy("event_type").agg(*agg.padded_range(F.col("value"))).withColumns({"low": r("low"), "high": r("high")})


@query("SELECT " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS n_{t}" for t in ("click", "view", "purchase", "error", "signup")) + " FROM events")
def drop_reasons(spark, sf_dir):
    return agg.drop_reasons(read(spark, sf_dir, "events"), "event_type", ["click", "view", "purchase", "error", "signup"])


@query("""
WITH l AS (SELECT user_id, max(ts) AS t, max(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS skipped, arg_max(event_type, ts) AS a FROM events GROUP BY 1)
SELECT CASE WHEN skipped = 1 THEN 'skip' ELSE a END AS state, count(*) AS n FROM l GROUP BY 1""")
def last_states(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("user_id", "ts", F.when(F.col("event_type") == "error", "skip").otherwise(F.col("event_type")).alias("action"))
    return traces.last_states(e, "user_id", "action", "ts").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT vec_id, label, round(list_aggregate(embedding, 'sum'), 4) AS total, round(sqrt(list_aggregate(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x), 'sum')), 4) AS norm FROM embeddings""")
def plane_sums(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings")
    fold = lambda f: F.aggregate("embedding", F.lit(0.0), f)
    return e.select("vec_id", "label", r(fold(lambda s, x: s + x)).alias("total"), r(F.sqrt(fold(lambda s, x: s + x.cast("double") * x))).alias("norm"))


def pricing_summary(spark, sf_dir):
    """Headline scan-and-aggregate of the bench."""
    li = read(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    disc = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base"), r(F.sum(disc), 2).alias("sum_disc"), r(F.avg("l_discount"), 4).alias("avg_disc"), F.count(F.lit(1)).alias("n")
    )


query("""
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc,
       round(avg(l_discount), 4) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")(pricing_summary)


@query("SELECT doc_id, substr(sha256(text), 1, 16) || ':' || strlen(text) AS sha8 FROM documents")
def payload_sha8(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return d.select("doc_id", headers.payload_sha8(F.col("text").cast("binary")).alias("sha8"))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey + 15) // 16 AS mb_rows, least(greatest(l_partkey, 10), 500) AS clamped,
       (l_partkey * l_suppkey // 100)::BIGINT AS pct, (l_suppkey * 90000 // 30)::BIGINT AS ticks,
       CASE WHEN l_partkey <= 0 THEN 0 ELSE l_partkey * 8 END AS bits, round(abs(l_partkey - l_suppkey) * 100.0 / greatest(abs(l_suppkey), 1), 4) AS delta FROM lineitem""")
def scalar_math(spark, sf_dir):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        scalars.macroblock_rows(p).alias("mb_rows"),
        scalars.clamp(p, F.lit(10), F.lit(500)).alias("clamped"),
        scalars.percent_of(p, s).alias("pct"),
        scalars.clock_ticks(s, F.lit(30)).alias("ticks"),
        scalars.size_bits(p).alias("bits"),
        r(scalars.pct_delta(p, s)).alias("delta"),
    )


@query("""
SELECT c_custkey, (40 * c_custkey // 100)::BIGINT AS l0, (60 * c_custkey // 100)::BIGINT - (40 * c_custkey // 100)::BIGINT AS l1, c_custkey - (60 * c_custkey // 100)::BIGINT AS l2 FROM customer""")
def layer_bitrates(spark, sf_dir):
    rates = scalars.layer_differences(scalars.layer_bitrates(F.col("c_custkey"), 3))
    c = read(spark, sf_dir, "customer").select("c_custkey", rates.alias("d"))
    return c.select("c_custkey", *[F.get("d", F.lit(i)).alias(f"l{i}") for i in range(3)])


@query("""
WITH n AS (SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) % 4 AS idx FROM events),
     p AS (SELECT * FROM (VALUES (0, 0, 4), (1, 2, 1), (2, 1, 2), (3, 2, 1)) t(idx, layer, decimator))
SELECT event_id, layer, decimator FROM n JOIN p USING (idx)""")
def temporal_pattern_join(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    at = compare.numbered(e, ["user_id"], ["ts", "event_id"]).withColumn("idx", (F.col("position") - 1) % 4)
    pattern = scalars.temporal_patterns(spark).where("mode = 'three_layers'").drop("mode")
    return at.join(F.broadcast(pattern), "idx").select("event_id", "layer", "decimator")  # four rows


@query(_ZIP + "SELECT user_id, coalesce(min(position) FILTER (NOT coalesce(abs(lv - rv) <= 50, false)), max(position) + 1) - 1 AS prefix FROM z GROUP BY user_id")
def matched_prefix(spark, sf_dir):
    z = _clicks_and_purchases(spark, sf_dir, "full")
    out = compare.matched_prefix(z, ["user_id"], compare.within(F.col("l.value"), F.col("r.value"), F.lit(50.0)))
    return out.withColumn("prefix", F.col("prefix").cast("bigint"))


@query(_ZIP + "SELECT count(*) AS n, count(*) FILTER (abs(lv - rv) > greatest(20, abs(rv) * 0.5)) AS value_out FROM z WHERE le IS NOT NULL AND re IS NOT NULL")
def tolerance_violations(spark, sf_dir):
    return compare.tolerance_violations(_clicks_and_purchases(spark, sf_dir, "inner"), {"value": (20.0, 0.5)})


@query("""
SELECT event_id, (rn - coalesce(max(CASE WHEN NOT hit THEN rn END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0))::BIGINT AS streak
FROM (SELECT *, value < 40 AS hit, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)""")
def running_streak(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")
    out = ordered.running_streak(e, ["user_id"], ["ts", "event_id"], F.col("value") < 40, "streak")
    return out.select("event_id", F.col("streak").cast("bigint").alias("streak"))


@query("SELECT event_type, round(avg(value), 4) AS mean, round(median(value), 4) AS median, floor(sum(value::DECIMAL(18, 2)) / count(*))::BIGINT AS whole FROM events GROUP BY 1")
def means(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("event_type", "value")
    middle = agg.medians(e, ["event_type"], "value").select("event_type", r(F.coalesce("median", F.lit(float("nan")))).alias("median"))
    out = e.groupBy("event_type").agg(r(agg.mean_finite(F.col("value"))).alias("mean"), agg.integer_mean(F.sum(F.col("value").cast("decimal(18,2)")), F.count(F.lit(1))).cast("bigint").alias("whole"))
    return out.join(middle, "event_type").select("event_type", "mean", "median", "whole")


@query("""
WITH n AS (SELECT *, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // 8 AS packet_no FROM conversations WHERE strlen(text) > 0)
SELECT conv_id, packet_no, count(*) AS frames, sum(strlen(text))::BIGINT AS bytes FROM n GROUP BY 1, 2""")
def superframe_round_trip(spark, sf_dir):
    """Packs the turns of a conversation into superframes, eight at a time, and reads them again."""
    c = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    at = compare.numbered(c, ["conv_id"], ["turn"]).withColumn("packet_no", F.floor((F.col("position") - 1) / 8))
    packed = at.groupBy("conv_id", "packet_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("f")).select("conv_id", "packet_no", rtp.packed_superframe("f").alias("packet"))
    frames = packed.select("conv_id", "packet_no", rtp.superframe_frames("packet").alias("f"))
    total = F.aggregate("f", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x))
    return frames.select("conv_id", "packet_no", F.size("f").cast("bigint").alias("frames"), total.alias("bytes"))


@query("SELECT doc_id, md5(text) AS payload_md5 FROM documents WHERE strlen(text) > 0")
def rtp_round_trip(spark, sf_dir):
    """Cuts each document into RTP packets with descriptors, and assembles it from them."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("text")).where(F.length("text") > 0)
    cut = rtp.packet_rows(d, "doc_id", "text", lambda f: rtp.packetize_vp8({}, f, 1200))
    return rtp.frame_rows(cut, "doc_id", rtp.assemble_vp8).select("doc_id", F.md5("frame").alias("payload_md5"))
