"""The registered queries, each next to the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions.running import running
from ..operators import conformance, discovery, filters, objects, windows
from ..order import with_index
from ..sources import dict_ocel_log, string_log
from ..workspace import Passing
from .log import EventLog

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a log without numbers: what only needs the order within cases takes a struct as ``n``."""
    e = table(spark, sf_dir, "events")
    return e.select(F.struct("ts", "event_id").alias("n"), F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), "ts", "event_id", "value", "props")


def log(spark: SparkSession, sf_dir: str, *keep: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("ts", "event_id", F.col("user_id").alias("case_id"), F.col("event_type").alias("activity"), *keep)
    return with_index(e, "ts", "event_id")


LOG = (
    "WITH log AS (SELECT row_number() OVER (ORDER BY ts, event_id) AS n, event_id, user_id AS case_id, event_type AS activity, ts, "
    "value, CAST(props->>'$.k' AS BIGINT) AS k FROM events), "
    "rel AS (SELECT * FROM (SELECT n, case_id, lag(activity) OVER (PARTITION BY case_id ORDER BY n) AS src, activity AS dst FROM log) WHERE src IS NOT NULL), "
    "last AS (SELECT max(n) AS m FROM log)"
)


@query(f"{LOG} SELECT src, dst, count(*)::BIGINT AS freq FROM rel GROUP BY ALL")
def dfg_counts(spark, sf_dir):
    return discovery.dfg(raw_log(spark, sf_dir).select("n", "case_id", "activity"))


@query("SELECT event_id FROM events WHERE event_type IN ('click', 'purchase')")
def retain_activity(spark, sf_dir):
    return raw_log(spark, sf_dir).transform(filters.retains_activity_filter(["click", "purchase"])).select("event_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('error')")
def exclude_activity(spark, sf_dir):
    return raw_log(spark, sf_dir).transform(filters.excludes_activity_filter("error")).select("event_id")


def _with_k(spark, sf_dir):
    return raw_log(spark, sf_dir).withColumn("event_attrs", F.from_json("props", "map<string,string>"))


@query("SELECT event_id FROM events WHERE CAST(props->>'$.k' AS BIGINT) IN (1, 2, 3)")
def retain_event_attr(spark, sf_dir):
    return _with_k(spark, sf_dir).transform(filters.retains_on_event_attribute_equal_filter("k", ["1", "2", "3"])).select("event_id")


@query("SELECT event_id FROM events WHERE coalesce(CAST(props->>'$.k' AS BIGINT) NOT IN (1, 2, 3), true)")
def exclude_event_attr(spark, sf_dir):
    return _with_k(spark, sf_dir).transform(filters.excludes_on_event_attribute_equal_filter("k", ["1", "2", "3"])).select("event_id")


def _with_segment(spark, sf_dir):
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("case_id"), F.col("c_mktsegment").alias("segment"))
    return raw_log(spark, sf_dir).select("case_id", "event_id").join(own, "case_id", "left")


SEGMENT = "SELECT event_id FROM events LEFT JOIN customer ON user_id = c_custkey WHERE "


@query(SEGMENT + "c_mktsegment = 'BUILDING'")
def retain_trace_attr(spark, sf_dir):
    return _with_segment(spark, sf_dir).transform(filters.retains_on_trace_attribute_equal_filter("segment", "BUILDING")).select("event_id")


@query(SEGMENT + "coalesce(c_mktsegment <> 'BUILDING', true)")
def exclude_trace_attr(spark, sf_dir):
    return _with_segment(spark, sf_dir).transform(filters.excludes_on_trace_attribute_equal_filter("segment", "BUILDING")).select("event_id")


@query(f"{LOG} SELECT n, event_id FROM log WHERE n <= 100")
def take(spark, sf_dir):
    return windows.first_events(table(spark, sf_dir, "events").select("ts", "event_id"), 100, "ts", "event_id").select("n", "event_id")


@query(f"{LOG} SELECT n, event_id FROM log WHERE n % 7 = 0")
def skip_events(spark, sf_dir):
    return log(spark, sf_dir).transform(windows.skip_events(7)).select("n", "event_id")


def _window_sql(size: int, skip: int) -> str:
    return (
        f"{LOG} SELECT j AS window_id, n - j * {skip} AS pos, event_id FROM log, range(0, (SELECT (m - {size}) // {skip} + 1 FROM last)) r(j) "
        f"WHERE n BETWEEN j * {skip} + 1 AND j * {skip} + {size}"
    )


def _windows(spark, sf_dir, size, skip):
    return log(spark, sf_dir).transform(windows.sliding_window(size, skip)).select("window_id", "pos", "event_id")


@query(_window_sql(6, 4))
def sliding_window(spark, sf_dir):
    return _windows(spark, sf_dir, 6, 4)


@query(_window_sql(8, 8))
def tumbling_window(spark, sf_dir):
    return log(spark, sf_dir).transform(windows.tumbling_window(8)).select("window_id", "pos", "event_id")


@query(_window_sql(3, 5))
def hopping_gap_window(spark, sf_dir):
    return _windows(spark, sf_dir, 3, 5)


@query(
    f"{LOG}, w AS (SELECT n, (n - 1) // 500 AS window_id, case_id, activity FROM log WHERE (n - 1) // 500 < (SELECT m // 500 FROM last)), "
    "r AS (SELECT window_id, lag(activity) OVER (PARTITION BY window_id, case_id ORDER BY n) AS src, activity AS dst FROM w) "
    "SELECT window_id, src, dst, count(*)::BIGINT AS freq FROM r WHERE src IS NOT NULL GROUP BY ALL"
)
def window_dfg(spark, sf_dir):
    w = windows.sliding_window_to_log(log(spark, sf_dir).transform(windows.tumbling_window(500)))
    w = w.withColumn("case_id", F.struct("window_id", "case_id"))
    return discovery.directly_follows(w).groupBy(F.col("case_id.window_id").alias("window_id"), "src", "dst").agg(F.count("*").alias("freq"))


@query(
    "SELECT row_number() OVER (ORDER BY ts, s, event_id) AS n, event_id FROM (SELECT ts, event_id, 0 AS s FROM events WHERE event_type = 'click' "
    "UNION ALL SELECT ts, event_id, 1 FROM events WHERE event_type = 'view')"
)
def merge(spark, sf_dir):
    own = log(spark, sf_dir)
    part = lambda a: EventLog(own.transform(filters.retains_activity_filter(a)))
    return part("click").merge(part("view")).df.select("n", "event_id")


@query(
    "SELECT row_number() OVER (ORDER BY s, ts, event_id) AS n, event_id FROM (SELECT ts, event_id, 0 AS s FROM events WHERE event_type = 'click' "
    "UNION ALL SELECT ts, event_id, 1 FROM events WHERE event_type = 'view')"
)
def concat(spark, sf_dir):
    own = log(spark, sf_dir)
    part = lambda a: EventLog(own.transform(filters.retains_activity_filter(a)))
    return part("click").concat(part("view")).df.select("n", "event_id")


@query("SELECT coalesce(bool_and(value >= 0), true) AS all_positive FROM events")
def all_match(spark, sf_dir):
    found = EventLog(raw_log(spark, sf_dir)).all_match(F.col("value") >= 0)
    return spark.createDataFrame([(found,)], "all_positive boolean")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'purchase' ORDER BY ts, event_id LIMIT 1")
def find_first(spark, sf_dir):
    found = EventLog(raw_log(spark, sf_dir)).find_first(F.col("activity") == "purchase")
    return spark.createDataFrame([(found.event_id, found.case_id)] if found else [], "event_id long, user_id long")


@query("SELECT event_id, value * 2 AS twice FROM events")
def map_events(spark, sf_dir):
    return EventLog(raw_log(spark, sf_dir)).map(twice=F.col("value") * 2).df.select("event_id", "twice")


@query("SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events WHERE CAST(props->>'$.k' AS BIGINT) % 2 = 0")
def lambda_operator(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return EventLog(raw_log(spark, sf_dir)).map_not_null("k", F.when(k % 2 == 0, k)).df.select("event_id", "k")


@query("SELECT event_id, unnest(string_split(event_type, 'i')) AS part FROM events")
def flat_map_events(spark, sf_dir):
    return EventLog(raw_log(spark, sf_dir)).flat_map("part", F.split("activity", "i")).df.select("event_id", "part")


@query("SELECT case_id, count(*)::BIGINT AS n_events, sum(value > 50)::BIGINT AS n_high FROM (SELECT user_id AS case_id, value FROM events) GROUP BY case_id")
def map_with_state(spark, sf_dir):
    """A user-defined map with a state for each case; here it counts and puts out its last state."""

    def step(state, event):
        state = state or (0, 0)
        return (state[0] + 1, state[1] + (event.value > 50)), [(state[0] + 1, state[1] + int(event.value > 50))]

    rows = EventLog(raw_log(spark, sf_dir)).map_with_state(step, "n_events long, n_high long").df
    return rows.groupBy("case_id").agg(F.max("n_events").alias("n_events"), F.max("n_high").alias("n_high"))


@query(f"{LOG} SELECT n, event_id FROM log WHERE activity = 'view' AND n % 3 = 0")
def rx_pipe(spark, sf_dir):
    return EventLog(log(spark, sf_dir)).pipe(windows.skip_events(3), filters.retains_activity_filter(["view"])).df.select("n", "event_id")


@query(
    f"{LOG}, w AS (SELECT (n - 1) // 40 AS window_id, case_id, activity, lead(activity) OVER (PARTITION BY (n - 1) // 40 ORDER BY n) AS a, "
    "lead(case_id) OVER (PARTITION BY (n - 1) // 40 ORDER BY n) AS c FROM log) "
    "SELECT window_id, count(*) FILTER (activity = 'view' AND a = 'click' AND case_id = c)::BIGINT AS pairs FROM w GROUP BY window_id"
)
def buffer_pairwise_count(spark, sf_dir):
    return windows.pair_counts(log(spark, sf_dir), 40, "view", "click")


@query(
    f"{LOG}, t AS (SELECT unnest(range(10, (SELECT m + 1 FROM last), 10)) AS n), p AS (SELECT DISTINCT src, dst FROM rel), "
    "c AS (SELECT t.n, p.src, p.dst, (SELECT count(*) FROM rel r WHERE r.src = p.src AND r.dst = p.dst AND r.n <= t.n) AS freq FROM t, p) "
    "SELECT n, src, dst, freq::BIGINT AS freq, round(freq / m, 6) AS rel_freq FROM (SELECT *, max(freq) OVER (PARTITION BY n) AS m FROM c) WHERE m > 0 AND freq > 0 AND freq / m > 0.75"
)
def dfg_miner_ticks(spark, sf_dir):
    return discovery.simple_dfg_ticks(log(spark, sf_dir)).withColumn("rel_freq", F.round("rel_freq", 6))


ACTIVITIES = ["click", "error", "purchase", "signup", "view"]


@query(f"{LOG} SELECT src, " + ", ".join(f"count(*) FILTER (dst = '{a}')::BIGINT AS \"{a}\"" for a in ACTIVITIES) + " FROM rel GROUP BY src")
def dfg_matrix(spark, sf_dir):
    return discovery.dfg_matrix(dfg_counts(spark, sf_dir), ACTIVITIES)


@query(
    f"{LOG}, w AS (SELECT * FROM log WHERE n > (SELECT m - 2000 FROM last)), c AS (SELECT case_id, row_number() OVER (ORDER BY min(n)) - 1 AS y FROM w GROUP BY case_id) "
    "SELECT n, round((epoch_us(ts) - (SELECT min(epoch_us(ts)) FROM w)) / 1e6, 6) AS x, y::BIGINT AS y, activity FROM w JOIN c USING (case_id)"
)
def dotted_chart(spark, sf_dir):
    rows = render.dotted_chart(log(spark, sf_dir), max_events=2000)
    return rows.select("n", F.round("x", 6).alias("x"), F.col("y").cast("long").alias("y"), "activity")


#: The lossy tables event by event: a fold over the occurrences of every case, then of every relation.
LOSSY = (
    "{log}, cf AS (SELECT case_id, list(n ORDER BY n) AS ns FROM log GROUP BY case_id), "
    "cs AS (SELECT case_id, list_reduce(ns, lambda s, n: {{'f': CASE WHEN greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN 1 ELSE s.f + 1 END, "
    "'d': CASE WHEN greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN ceil(n / {w})::BIGINT - 1 ELSE s.d END, 'b': ceil(n / {w})::BIGINT, "
    "'dead': CASE WHEN s.f > 0 AND greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN list_append(s.dead, n) ELSE s.dead END}}, "
    "{{'f': 0::BIGINT, 'd': 0::BIGINT, 'b': 0::BIGINT, 'dead': []::BIGINT[]}}).dead AS dead FROM cf), "
    "live AS (SELECT r.* FROM rel r JOIN cs USING (case_id) WHERE NOT list_contains(dead, n)), "
    "rf AS (SELECT src, dst, list(n ORDER BY n) AS ns FROM live GROUP BY ALL), "
    "rs AS (SELECT src, dst, ns, list_reduce(ns, lambda s, n: {{'f': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN 1 ELSE s.f + 1 END, "
    "'d': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN ceil(n / {w})::BIGINT - 1 ELSE s.d END, 'b': ceil(n / {w})::BIGINT, "
    "'h': list_append(s.h, {{'f': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN 1 ELSE s.f + 1 END, "
    "'d': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / {w}) - 1 THEN ceil(n / {w})::BIGINT - 1 ELSE s.d END}})}}, "
    "{{'f': 0::BIGINT, 'd': 0::BIGINT, 'b': 0::BIGINT, 'h': []::STRUCT(f BIGINT, d BIGINT)[]}}).h AS h FROM rf), "
    "st AS (SELECT src, dst, unnest(ns) AS n, unnest(h) AS h FROM rs), "
    "sp AS (SELECT src, dst, n, h.f AS freq, {w} * greatest(ceil(n / {w})::BIGINT, h.f + h.d) AS gone, lead(n) OVER (PARTITION BY src, dst ORDER BY n) AS nxt FROM st), "
    "tk AS (SELECT unnest(range({f} - 1, (SELECT m + 1 FROM last), {f})) AS t), "
    "model AS (SELECT t AS n, src, dst, freq::BIGINT AS freq FROM tk JOIN sp ON sp.n <= t AND t < gone AND (nxt IS NULL OR t < nxt)) "
)
EPSILON, EVERY = 0.004, 100
LOSSY_SQL = LOSSY.format(log=LOG, w=250, f=EVERY)


def _lossy_model(spark, sf_dir):
    return discovery.heuristics_lossy_ticks(log(spark, sf_dir), EVERY, EPSILON)


@query(LOSSY_SQL + "SELECT n, src, dst, freq FROM model")
def hm_lossy_dfg_ticks(spark, sf_dir):
    return _lossy_model(spark, sf_dir)


DEPENDENCY = (
    ", dep AS (SELECT a.n, a.src, a.dst, a.freq, CASE WHEN a.src = a.dst THEN a.freq / (a.freq + 1) ELSE (a.freq - coalesce(b.freq, 0)) / (a.freq + coalesce(b.freq, 0) + 1) END AS d "
    "FROM model a LEFT JOIN model b ON a.n = b.n AND a.src = b.dst AND a.dst = b.src) "
)


@query(LOSSY_SQL + DEPENDENCY + "SELECT n, src, dst, freq, round(d, 6) AS dependency, d >= 0.05 AS kept FROM dep")
def hm_dependency(spark, sf_dir):
    return discovery.dependency_graph(_lossy_model(spark, sf_dir), 0.05).withColumn("dependency", F.round("dependency", 6))


@query(
    LOSSY_SQL + DEPENDENCY + ", k AS (SELECT * FROM dep WHERE d >= 0.05 AND src <> dst) "
    "SELECT a.n, a.src, a.dst AS first, b.dst AS second, round((coalesce(p.freq, 0) + coalesce(q.freq, 0)) / (a.freq + b.freq + 1), 6) AS measure, "
    "(coalesce(p.freq, 0) + coalesce(q.freq, 0)) / (a.freq + b.freq + 1) >= 0.8 AS is_and FROM k a JOIN k b ON a.n = b.n AND a.src = b.src AND a.dst < b.dst "
    "LEFT JOIN model p ON p.n = a.n AND p.src = a.dst AND p.dst = b.dst LEFT JOIN model q ON q.n = a.n AND q.src = b.dst AND q.dst = a.dst"
)
def hm_and_splits(spark, sf_dir):
    return discovery.and_splits(_lossy_model(spark, sf_dir), 0.05).withColumn("measure", F.round("measure", 6))


@query()
def hm_budget_ticks(spark, sf_dir):
    return discovery.heuristics_budget_ticks(log(spark, sf_dir), 100, 60)


#: Distances between activities, and all bounded paths: a relation is a bit of the two masks of a path.
BEHAVIOUR = (
    "WITH RECURSIVE " + LOG.removeprefix("WITH ") + ", re AS (SELECT src, dst, row_number() OVER (ORDER BY src, dst) - 1 AS r FROM (SELECT DISTINCT src, dst FROM rel)), "
    "st AS (SELECT DISTINCT arg_min(activity, n) AS a FROM log GROUP BY case_id), en AS (SELECT DISTINCT arg_max(activity, n) AS a FROM log GROUP BY case_id), "
    "fi AS (SELECT * FROM re WHERE src IN (SELECT a FROM st)), la AS (SELECT * FROM re WHERE dst IN (SELECT a FROM en)), "
    "fw AS (SELECT r AS s, r, 0 AS d FROM fi UNION SELECT s, x.r, d + 1 FROM fw JOIN re y ON y.r = fw.r JOIN re x ON x.src = y.dst WHERE d < 2 * (SELECT count(DISTINCT src) FROM re)), "
    "bw AS (SELECT r, 0 AS d FROM la UNION SELECT x.r, d + 1 FROM bw JOIN re y ON y.r = bw.r JOIN re x ON x.dst = y.src WHERE d < 2 * (SELECT count(DISTINCT src) FROM re)), "
    "pa AS (SELECT r, 0 AS d, 0::BIGINT AS seen, 0::BIGINT AS again FROM fi UNION "
    "SELECT r, d, CASE WHEN d = 6 THEN 0 ELSE seen END, CASE WHEN d = 6 THEN 0 ELSE again END FROM ("
    "SELECT x.r, CASE WHEN (seen >> pa.r) & 1 = 1 THEN d ELSE d + 1 END AS d, seen | (1::BIGINT << pa.r) AS seen, "
    "CASE WHEN (seen >> pa.r) & 1 = 1 THEN again | (1::BIGINT << pa.r) ELSE again END AS again "
    "FROM pa JOIN re y ON y.r = pa.r JOIN re x ON x.src = y.dst WHERE d < 6) WHERE (again >> r) & 1 = 0), "
    "mn AS (SELECT s, r, min(d) AS d FROM fw GROUP BY ALL), p AS (SELECT r, min(d) AS lo, max(d) AS hi FROM mn GROUP BY r), "
    "q AS (SELECT r, max(d) AS hi FROM pa GROUP BY r), e AS (SELECT r, min(d) AS d FROM bw GROUP BY r) "
)


@query(BEHAVIOUR + "SELECT src, dst, lo::INT AS p_min, greatest(p.hi, q.hi)::INT AS p_max, e.d::INT AS f FROM re LEFT JOIN p USING (r) LEFT JOIN q USING (r) LEFT JOIN e USING (r)")
def behavioral_model(spark, sf_dir):
    return discovery.behavioral_model(log(spark, sf_dir))


#: A fixed model: (src, dst, p_min, p_max, f).
MODEL = [("view", "click", 0, 2, 3), ("click", "view", 1, 3, 2), ("click", "purchase", 1, 6, 1), ("purchase", "view", 2, 6, 2), ("view", "view", 1, 4, 3), ("purchase", "signup", 2, 2, 0)]


@query(
    f"{LOG}, m AS (SELECT * FROM (VALUES " + ", ".join(map(str, MODEL)) + ") v(src, dst, p_min, p_max, f)), "
    "j AS (SELECT r.n, r.case_id, m.f, m.p_min, m.p_max, m.src IS NOT NULL AS known, row_number() OVER (PARTITION BY r.case_id, r.src, r.dst ORDER BY r.n) = 1 AS fresh FROM rel r LEFT JOIN m ON m.src = r.src AND m.dst = r.dst), "
    "c AS (SELECT *, count(*) FILTER (known AND fresh) OVER w AS obs, count(*) FILTER (NOT known) OVER w AS bad FROM j WINDOW w AS (PARTITION BY case_id ORDER BY n)) "
    "SELECT n, case_id, round(obs / (obs + bad), 6) AS conformance, CASE WHEN known THEN round(1 - f / 3, 6) ELSE -1.0 END::DOUBLE AS confidence, "
    "CASE WHEN NOT known THEN -1.0 WHEN obs BETWEEN p_min AND p_max THEN 1.0 ELSE round(least(1, obs / (p_min + 1)), 6) END::DOUBLE AS completeness FROM c"
)
def behavioral_conformance(spark, sf_dir):
    model = spark.createDataFrame(MODEL, "src string, dst string, p_min int, p_max int, f int")
    rows = conformance.behavioral_conformance(log(spark, sf_dir), model)
    return rows.select("n", "case_id", *(F.round(c, 6).alias(c) for c in ("conformance", "confidence", "completeness")))


def _pdfa(spark, sf_dir):
    edges = dfg_counts(spark, sf_dir)
    total = edges.groupBy("src").agg(F.sum("freq").alias("total"))
    return edges.join(total, "src").select("src", "dst", (F.col("freq") / F.col("total")).alias("prob"))


PDFA = (
    f"{LOG}, e AS (SELECT src, dst, count(*) AS c FROM rel GROUP BY ALL), "
    "pdfa AS (SELECT src, dst, c / sum(c) OVER (PARTITION BY src) AS prob FROM e), nodes AS (SELECT src AS a FROM e UNION SELECT dst FROM e), "
    "k AS (SELECT count(*) AS k FROM nodes), norm AS (SELECT x.a AS src, y.a AS dst, coalesce(prob, 0) * 0.7 + 0.3 / (SELECT k FROM k) AS prob FROM nodes x CROSS JOIN nodes y "
    "LEFT JOIN pdfa ON src = x.a AND dst = y.a) "
)


@query(PDFA + "SELECT src, dst, round(prob, 8) AS prob FROM norm")
def pdfa_normalize(spark, sf_dir):
    return conformance.normalize_weights(_pdfa(spark, sf_dir), 0.7).withColumn("prob", F.round("prob", 8))


def _soft_sql(cases: int) -> str:
    return PDFA + (
        ", p AS (SELECT n, case_id, activity, lag(n) OVER w AS prev, lead(n) OVER w AS nxt FROM log WINDOW w AS (PARTITION BY case_id ORDER BY n)), "
        f"lives AS (SELECT a.n, CASE WHEN a.prev IS NULL OR a.n - a.prev <= {cases} THEN 0 ELSE "
        f"((SELECT count(DISTINCT b.case_id) FROM log b WHERE b.n > a.prev AND b.n < a.n) >= {cases})::INT END AS gone FROM p a), "
        "s AS (SELECT p.n, case_id, activity, sum(gone) OVER (PARTITION BY case_id ORDER BY p.n) AS life FROM p JOIN lives USING (n)), "
        "l AS (SELECT n, case_id, life, lag(activity) OVER (PARTITION BY case_id, life ORDER BY n) AS src, activity FROM s), "
        "q AS (SELECT n, case_id, life, CASE WHEN l.src IS NOT NULL THEN coalesce(prob, 0) END AS pr FROM l LEFT JOIN norm ON norm.src = l.src AND norm.dst = l.activity) "
        "SELECT n, case_id, round(pr, 6) AS last_prob, round(1 + coalesce(sum(CASE WHEN pr > 0 THEN -ln(pr) WHEN pr = 0 THEN 'inf'::DOUBLE END) OVER w, 0), 6) AS log_prob, round(coalesce(avg(pr) OVER w, 0), 6) AS mean_prob, "
        "round(coalesce(avg(pr) OVER w, 0) / (0.7 + 0.3 / (SELECT k FROM k)), 6) AS soft_conformance FROM q WINDOW w AS (PARTITION BY case_id, life ORDER BY n)"
    )


def _soft(spark, sf_dir, cases):
    rows = conformance.soft_conformance(log(spark, sf_dir), _pdfa(spark, sf_dir), 0.7, cases)
    return rows.select("n", "case_id", *(F.round(c, 6).alias(c) for c in ("last_prob", "log_prob", "mean_prob", "soft_conformance")))


@query(_soft_sql(1000))
def soft_conformance(spark, sf_dir):
    return _soft(spark, sf_dir, 1000)


@query(_soft_sql(60))
def soft_conformance_few_cases(spark, sf_dir):
    return _soft(spark, sf_dir, 60)


PROFILE = (
    ", pr AS (SELECT x.n AS i, y.n AS n, x.case_id, x.activity AS a, y.activity AS b, (epoch_us(y.ts) - epoch_us(x.ts)) / 1e6 AS d FROM log x JOIN log y ON x.case_id = y.case_id AND x.n < y.n), "
    "prof AS (SELECT a, b, count(*) AS cnt, avg(d) AS mean_s, coalesce(stddev_samp(d), 0) AS std_s FROM pr GROUP BY ALL) "
)


@query(LOG + PROFILE + "SELECT a, b, cnt::BIGINT AS cnt, round(mean_s, 2) AS mean_s, round(std_s, 2) AS std_s FROM prof")
def temporal_profile(spark, sf_dir):
    rows = discovery.temporal_profile(log(spark, sf_dir))
    return rows.select("a", "b", F.col("cnt").cast("long").alias("cnt"), F.round("mean_s", 2).alias("mean_s"), F.round("std_s", 2).alias("std_s"))


@query(
    LOG + PROFILE + ", tk AS (SELECT unnest(range(1000, (SELECT m + 1 FROM last), 1000)) AS t) "
    "SELECT t AS n, a, b, count(*)::BIGINT AS cnt, round(avg(d), 2) AS mean_s, round(coalesce(stddev_samp(d), 0), 2) AS std_s FROM tk JOIN pr ON pr.n <= t GROUP BY ALL"
)
def temporal_profile_ticks(spark, sf_dir):
    rows = discovery.temporal_profile_ticks(log(spark, sf_dir), 1000)
    return rows.select("n", "a", "b", F.col("cnt").cast("long").alias("cnt"), F.round("mean_s", 2).alias("mean_s"), F.round("std_s", 2).alias("std_s"))


@query(
    "WITH g AS (SELECT *, (ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 12 HOUR)::INT AS gap FROM events), "
    "s AS (SELECT *, coalesce(sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS k FROM g) "
    "SELECT user_id AS case_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(max(ts) + INTERVAL 12 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS end, "
    "count(*)::BIGINT AS events, count(DISTINCT event_type)::BIGINT AS activities FROM s GROUP BY user_id, k"
)
def session_cases(spark, sf_dir):
    rows = windows.session_cases(raw_log(spark, sf_dir), "12 hours")
    return rows.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "end")})


@query(
    LOG + PROFILE + "SELECT n, case_id, pr.a, pr.b, round(d, 3) AS delta_s, round(abs(d - mean_s) / std_s, 3) AS z FROM pr JOIN prof ON pr.a = prof.a AND pr.b = prof.b WHERE abs(d - mean_s) > 2.5 * std_s"
)
def temporal_conformance(spark, sf_dir):
    own = log(spark, sf_dir)
    rows = conformance.temporal_conformance(own, discovery.temporal_profile(own), 2.5)
    return rows.select("n", "case_id", "a", "b", F.round("delta_s", 3).alias("delta_s"), F.round("z", 3).alias("z"))


def oc_log(spark, sf_dir):
    """``place_order`` for each order and ``ship`` for each order and shipping date."""
    line = lambda ts, kind, key, row, a, b: [F.col(ts).alias("ts"), F.lit(kind).alias("kind"), F.col(key).alias("key"), row.alias("row"), F.col(a).alias("a"), b.alias("b")]
    o = table(spark, sf_dir, "orders").select(*line("o_orderdate", 0, "o_orderkey", F.monotonically_increasing_id(), "o_custkey", F.lit(None).cast("long")))
    s = table(spark, sf_dir, "lineitem").select(*line("l_shipdate", 1, "l_orderkey", F.lit(-1).cast("long"), "l_partkey", F.col("l_suppkey")))
    # Lines go straight to the ranges of the log's order, where those of one event meet; objects are named after that.
    rows = o.unionByName(s).repartitionByRange("ts", "kind", "key").groupBy("ts", "kind", "key", "row")
    rows = rows.agg(F.min("a").alias("c"), F.collect_set("a").alias("a"), F.collect_set("b").alias("b")).drop("row")
    ids = lambda c: F.sort_array(F.col(c).cast("array<string>"))
    order = F.array(F.col("key").cast("string"))
    placed = F.create_map(F.lit("Customer"), F.array(F.col("c").cast("string")), F.lit("Order"), order)
    shipped = F.create_map(F.lit("Order"), order, F.lit("Part"), ids("a"), F.lit("Supplier"), ids("b"))
    activity = F.when(F.col("kind") == 0, "place_order").otherwise("ship")
    own = with_index(rows, "ts", "kind", "key", ranged=True, lean=True)
    return own.select("ts", "kind", "key", activity.alias("activity"), F.when(F.col("kind") == 0, placed).otherwise(shipped).alias("omap"), "n")


OC = (
    "WITH e AS (SELECT o_orderdate AS ts, 0 AS kind, o_orderkey AS key, 'place_order' AS activity FROM orders "
    "UNION ALL SELECT l_shipdate, 1, l_orderkey, 'ship' FROM lineitem GROUP BY l_orderkey, l_shipdate), "
    "ev AS (SELECT row_number() OVER (ORDER BY ts, kind, key) AS n, * FROM e), "
    "ob AS (SELECT o_orderdate AS ts, 0 AS kind, o_orderkey AS key, 'Customer' AS t, o_custkey::VARCHAR AS id FROM orders UNION ALL SELECT o_orderdate, 0, o_orderkey, 'Order', o_orderkey::VARCHAR FROM orders "
    "UNION SELECT l_shipdate, 1, l_orderkey, 'Order', l_orderkey::VARCHAR FROM lineitem UNION SELECT l_shipdate, 1, l_orderkey, 'Part', l_partkey::VARCHAR FROM lineitem "
    "UNION SELECT l_shipdate, 1, l_orderkey, 'Supplier', l_suppkey::VARCHAR FROM lineitem), "
    "fl AS (SELECT n, row_number() OVER (PARTITION BY n ORDER BY t, id) AS flat_pos, t AS object_type, id AS case_id, activity FROM ev JOIN ob USING (ts, kind, key)), "
    "ty AS (SELECT *, row_number() OVER (PARTITION BY object_type ORDER BY n, flat_pos) AS m FROM fl), "
    "msg AS (SELECT row_number() OVER (ORDER BY n, flat_pos) AS msg, n AS event_n, flat_pos, object_type, m AS type_n FROM ty WHERE (m + 1) % 20 = 0), "
    "sz AS (SELECT n, activity, t, count(*) AS c FROM ev JOIN ob USING (ts, kind, key) GROUP BY ALL), "
    "pr AS (SELECT a.n, a.activity, a.t AS type_a, b.t AS type_b, CASE WHEN a.c = 1 AND b.c = 1 THEN '1..1' WHEN a.c = 1 THEN '1..N' WHEN b.c = 1 THEN 'N..1' ELSE 'N..M' END AS cardinality FROM sz a JOIN sz b ON a.n = b.n AND a.t < b.t) "
)


@query(OC + "SELECT n, flat_pos::INT AS flat_pos, object_type, case_id, activity FROM fl")
def oc_flatten(spark, sf_dir):
    return objects.flatten(oc_log(spark, sf_dir)).select("n", "flat_pos", "object_type", "case_id", "activity")


@query(
    OC + ", r AS (SELECT object_type, lag(activity) OVER (PARTITION BY object_type, case_id ORDER BY n) AS src, activity AS dst FROM fl) "
    "SELECT object_type, src, dst, count(*)::BIGINT AS freq FROM r WHERE src IS NOT NULL GROUP BY ALL"
)
def oc_dfg(spark, sf_dir):
    return objects.oc_dfg(objects.flatten(oc_log(spark, sf_dir)))


@query(
    OC + ", c AS (SELECT activity, type_a, type_b, cardinality, count(*) AS freq, min(n) AS n FROM pr GROUP BY ALL) "
    "SELECT activity, type_a, type_b, cardinality, freq::BIGINT AS freq FROM (SELECT *, row_number() OVER (PARTITION BY activity, type_a, type_b ORDER BY freq DESC, n) AS r FROM c) WHERE r = 1"
)
def aer_cardinality(spark, sf_dir):
    return objects.cardinalities(objects.type_pairs(oc_log(spark, sf_dir)))


def _messages(spark, sf_dir):
    return objects.dfg_messages(objects.per_type_index(objects.flatten(oc_log(spark, sf_dir))), 20)


@query(OC + "SELECT msg, event_n, flat_pos::INT AS flat_pos, object_type, type_n FROM msg")
def oc_messages(spark, sf_dir):
    return _messages(spark, sf_dir).select("msg", "event_n", "flat_pos", "object_type", "type_n")


@query(
    OC + ", c AS (SELECT m.msg, t.object_type, sum((m.object_type = t.object_type)::INT) OVER (PARTITION BY t.object_type ORDER BY m.msg) / m.msg >= 0.15 AS on_, "
    "FROM msg m CROSS JOIN (SELECT DISTINCT object_type FROM msg) t), d AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY object_type ORDER BY msg), false) AS was FROM c) "
    "SELECT msg, object_type, CASE WHEN on_ THEN 'ACTIVE' ELSE 'INACTIVE' END AS command FROM d WHERE on_ <> was"
)
def strategy_relfreq(spark, sf_dir):
    return objects.relative_frequency(_messages(spark, sf_dir), 0.15)


@query(
    OC + ", s AS (SELECT m.msg, t.object_type, max(CASE WHEN m.object_type = t.object_type THEN m.msg END) OVER (PARTITION BY t.object_type ORDER BY m.msg) AS l "
    "FROM msg m CROSS JOIN (SELECT DISTINCT object_type FROM msg) t), c AS (SELECT msg, object_type, coalesce(msg - l < 8, false) AS on_ FROM s), "
    "d AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY object_type ORDER BY msg), false) AS was FROM c) "
    "SELECT msg, object_type, CASE WHEN on_ THEN 'ACTIVE' ELSE 'INACTIVE' END AS command FROM d WHERE on_ <> was"
)
def strategy_window(spark, sf_dir):
    return objects.sliding_window_inclusion(_messages(spark, sf_dir), 8)


@query(
    OC + ", mf AS (SELECT object_type, list(msg ORDER BY msg) AS ns FROM msg GROUP BY ALL), "
    "ms AS (SELECT object_type, ns, list_reduce(ns, lambda s, n: {'f': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / 10) - 1 THEN 1 ELSE s.f + 1 END, "
    "'d': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / 10) - 1 THEN ceil(n / 10)::BIGINT - 1 ELSE s.d END, 'b': ceil(n / 10)::BIGINT, "
    "'h': list_append(s.h, {'new': s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / 10) - 1, "
    "'r': CASE WHEN s.f = 0 OR greatest(s.b, s.f + s.d) <= ceil(n / 10) - 1 THEN ceil(n / 10)::BIGINT ELSE s.f + 1 + s.d END})}, "
    "{'f': 0::BIGINT, 'd': 0::BIGINT, 'b': 0::BIGINT, 'h': []::STRUCT(new BOOLEAN, r BIGINT)[]}).h AS h FROM mf), "
    "mu AS (SELECT object_type, unnest(ns) AS msg, unnest(h) AS h FROM ms), "
    "mg AS (SELECT *, 10 * greatest(ceil(msg / 10)::BIGINT, h.r) AS gone, lead(msg) OVER (PARTITION BY object_type ORDER BY msg) AS nxt FROM mu) "
    "SELECT msg, object_type, 'ACTIVE' AS command FROM mg WHERE h.new UNION ALL "
    "SELECT gone, object_type, 'INACTIVE' FROM mg WHERE gone < coalesce(nxt, (SELECT max(msg) + 1 FROM msg))"
)
def strategy_lossy(spark, sf_dir):
    return objects.lossy_inclusion(_messages(spark, sf_dir), 0.1)


def _active_sql(messages: str) -> str:
    """(msg, object_type, on_): the types that relative frequency holds active at every message."""
    return (
        f"(SELECT m.msg, t.object_type, sum((m.object_type = t.object_type)::INT) OVER (PARTITION BY t.object_type ORDER BY m.msg) / m.msg >= 0.15 AS on_ "
        f"FROM {messages} m CROSS JOIN (SELECT DISTINCT object_type FROM {messages}) t)"
    )


@query(
    OC + f", c AS {_active_sql('msg')}, d AS (SELECT *, coalesce(lag(on_) OVER (PARTITION BY object_type ORDER BY msg), false) AS was FROM c), "
    "u AS (SELECT event_n, flat_pos, 2 AS k, 'dfg' AS type, object_type, type_n, NULL AS command FROM msg "
    "UNION ALL SELECT event_n, flat_pos, 1, 'command', d.object_type, NULL, CASE WHEN on_ THEN 'ACTIVE' ELSE 'INACTIVE' END FROM d JOIN msg USING (msg) WHERE on_ <> was "
    "UNION ALL SELECT n, 0, 0, 'aer', NULL, NULL, NULL FROM ev WHERE (n + 1) % 300 = 0) "
    "SELECT row_number() OVER (ORDER BY event_n, flat_pos, k, object_type) AS pos, type, event_n, coalesce(object_type, '') AS object_type, coalesce(type_n, 0) AS type_n, coalesce(command, '') AS command FROM u"
)
def oc_stream(spark, sf_dir):
    own = oc_log(spark, sf_dir)
    messages = objects.dfg_messages(objects.per_type_index(objects.flatten(own)), 20)
    rows = objects.oc_stream(own, messages, lambda m: objects.relative_frequency(m, 0.15), 300)
    return rows.na.fill("", ["object_type", "command"]).na.fill(0, ["type_n"])


#: A miner of one's own for each type: plain counts after every 200 events of the type.
OC_MERGED = OC + (
    ", tr AS (SELECT * FROM (SELECT object_type, m, lag(activity) OVER (PARTITION BY object_type, case_id ORDER BY m) AS src, activity AS dst FROM ty) WHERE src IS NOT NULL), "
    "first AS (SELECT object_type, min(m) AS m FROM tr GROUP BY ALL), "
    "cm AS (SELECT row_number() OVER (ORDER BY n, flat_pos) AS msg, n AS event_n, t.object_type, t.m AS type_n FROM ty t JOIN first f ON f.object_type = t.object_type AND f.m <= t.m WHERE t.m % 200 = 0), "
    "mo AS (SELECT t.object_type, t.type_n, r.src, r.dst, count(*) AS freq FROM cm t JOIN tr r ON r.object_type = t.object_type AND r.m <= t.type_n GROUP BY ALL), "
    f"ac AS {_active_sql('cm')}, "
    "now AS (SELECT a.msg, a.object_type, max(c.type_n) AS type_n FROM ac a JOIN cm c ON c.object_type = a.object_type AND c.msg <= a.msg WHERE a.on_ GROUP BY ALL), "
    "edges AS (SELECT msg, object_type, src, dst, freq::BIGINT AS freq FROM now JOIN mo USING (object_type, type_n)) "
)


def _counting_miner(events: DataFrame) -> DataFrame:
    return discovery.simple_dfg_ticks(events, 200, 0.0)


#: The events after which the counting miner gives a model.
COUNTED_AT = "n % 200 = 0"


def _mined(own: DataFrame, **miners) -> tuple[DataFrame, DataFrame]:
    with Passing() as stage:
        messages, models = objects.mined_types(objects.flat_index(own), told_at=F.expr(COUNTED_AT), **miners)
        return stage.keep(messages, "messages"), stage.keep(models, "models")


def _merged(spark, sf_dir):
    own = oc_log(spark, sf_dir)
    types = ["Customer", "Order", "Part", "Supplier"]
    messages, models = _mined(own, control_flow=dict.fromkeys(types, _counting_miner))
    commands = objects.relative_frequency(messages, 0.15)
    return own, messages, commands, objects.merged_ocdfg(messages, models, commands)


@query(OC_MERGED + "SELECT * FROM edges")
def oc_merge(spark, sf_dir):
    return objects.spelled_out(_merged(spark, sf_dir)[3])


#: Lossy counts of cardinalities: a fold over the buckets of every activity, pair and cardinality.
AER = (
    ", ai AS (SELECT n, activity, row_number() OVER (PARTITION BY activity ORDER BY n) AS d FROM ev), "
    "ao AS (SELECT pr.*, d, ceil(d / 100)::BIGINT AS b, row_number() OVER (PARTITION BY activity, type_a, type_b, cardinality, ceil(d / 100) ORDER BY n) AS r, "
    "lead(n) OVER (PARTITION BY activity, type_a, type_b, cardinality ORDER BY n) AS nxt FROM pr JOIN ai USING (n, activity)), "
    "ab AS (SELECT activity, type_a, type_b, cardinality, b, count(*) AS c, min(n) AS first_n FROM ao GROUP BY ALL), "
    "al AS (SELECT activity, type_a, type_b, cardinality, list({'b': b, 'c': c, 'n': first_n} ORDER BY b) AS bs FROM ab GROUP BY ALL), "
    "af AS (SELECT activity, type_a, type_b, cardinality, list_reduce(bs, lambda s, x: {"
    "'f': CASE WHEN s.f = 0 OR greatest(s.l, s.f + s.d) <= x.b - 1 THEN x.c ELSE s.f + x.c END, "
    "'d': CASE WHEN s.f = 0 OR greatest(s.l, s.f + s.d) <= x.b - 1 THEN x.b ELSE s.d END, "
    "'born': CASE WHEN s.f = 0 OR greatest(s.l, s.f + s.d) <= x.b - 1 THEN x.n ELSE s.born END, 'l': x.b, "
    "'h': list_append(s.h, {'b': x.b, 'f': CASE WHEN s.f = 0 OR greatest(s.l, s.f + s.d) <= x.b - 1 THEN 0 ELSE s.f END, "
    "'d': CASE WHEN s.f = 0 OR greatest(s.l, s.f + s.d) <= x.b - 1 THEN x.b ELSE s.d END, "
    "'born': CASE WHEN s.f = 0 OR greatest(s.l, s.f + s.d) <= x.b - 1 THEN x.n ELSE s.born END})}, "
    "{'f': 0::BIGINT, 'd': 0::BIGINT, 'born': 0::BIGINT, 'l': 0::BIGINT, 'h': []::STRUCT(b BIGINT, f BIGINT, d BIGINT, born BIGINT)[]}).h AS h FROM al), "
    "ah AS (SELECT activity, type_a, type_b, cardinality, unnest(h) AS h FROM af), "
    "ast AS (SELECT o.*, h.f + r AS freq, h.born AS born, 100 * greatest(o.b, h.f + r + h.d) AS gone FROM ao o JOIN ah ON ah.activity = o.activity AND ah.type_a = o.type_a AND ah.type_b = o.type_b AND ah.cardinality = o.cardinality AND ah.h.b = o.b), "
    "tk AS (SELECT unnest(range(%d - 1, (SELECT max(n) + 1 FROM ev), %d)) AS t), "
    "ad AS (SELECT t, activity, max(d) AS d FROM tk JOIN ai ON ai.n <= t GROUP BY ALL), "
    "am AS (SELECT t AS n, s.activity, type_a, type_b, cardinality, row_number() OVER (PARTITION BY t, s.activity, type_a, type_b ORDER BY freq DESC, born) AS best "
    "FROM ast s JOIN ad ON ad.activity = s.activity AND s.n <= t AND (nxt IS NULL OR t < nxt) WHERE ad.d < gone), "
    "aer AS (SELECT n, activity, type_a, type_b, cardinality FROM am WHERE best = 1) "
)


@query(OC + AER % (1000, 1000) + "SELECT * FROM aer")
def aer_lossy_ticks(spark, sf_dir):
    return objects.aer_lossy_ticks(oc_log(spark, sf_dir), 1000, 0.01)


@query(
    OC_MERGED + AER % (300, 300) + ", an AS (SELECT msg, (event_n + 1) // 300 * 300 - 1 AS n FROM cm), "
    "nodes AS (SELECT msg, src AS activity FROM edges UNION SELECT msg, dst FROM edges) "
    "SELECT msg, activity, type_a, type_b, cardinality FROM an JOIN aer USING (n) JOIN nodes USING (msg, activity) "
    "WHERE (msg, type_a) IN (SELECT (msg, object_type) FROM ac WHERE on_) AND (msg, type_b) IN (SELECT (msg, object_type) FROM ac WHERE on_)"
)
def aer_pruned(spark, sf_dir):
    own, messages, commands, edges = _merged(spark, sf_dir)
    return objects.spelled_out(objects.merged_aer(messages, edges, objects.aer_lossy_ticks(own, 300, 0.01), commands))


@query(OC_MERGED + "SELECT msg, event_n, object_type, type_n FROM cm")
def oc_dynamic_miner(spark, sf_dir):
    messages, _ = _mined(oc_log(spark, sf_dir), default_miner=_counting_miner)
    return messages.select("msg", "event_n", "object_type", "type_n")


def _irregular_aer(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """AER models of the events since the last tick, told at irregular ticks: orders of some keys."""
    tick = (F.col("kind") == 0) & (F.col("key") % 97 == 0)
    events = running(objects.shapes(own.withColumn("tick", tick.cast("int")), "tick"), [], "n", slot=("before", "tick"))
    ticks = events.where("tick = 1").select("slot", F.col("n").alias("at"))
    met = events.groupBy("slot", "activity", "shape").agg(F.count("*").alias("cnt"), F.min("n").alias("n")).join(ticks, "slot")
    counts = objects.shape_pairs(met).groupBy("at", "activity", "type_a", "type_b", "cardinality").agg(F.sum("cnt").alias("freq"), F.min("n").alias("n"))
    best = F.max(F.struct("freq", (-F.col("n")).alias("n"), "cardinality")).alias("m")
    aer = counts.groupBy("at", "activity", "type_a", "type_b").agg(best)
    return aer.select(F.col("at").alias("n"), "activity", "type_a", "type_b", "m.cardinality"), ticks.select(F.col("at").alias("n"))


@query(
    OC_MERGED + ", tk AS (SELECT n FROM ev WHERE kind = 0 AND key % 97 = 0), "
    "ic AS (SELECT tk.n AS t, pr.activity, type_a, type_b, cardinality, count(*) AS c, min(pr.n) AS f FROM pr ASOF JOIN tk ON pr.n <= tk.n GROUP BY ALL), "
    "ia AS (SELECT t AS n, activity, type_a, type_b, cardinality FROM (SELECT *, row_number() OVER (PARTITION BY t, activity, type_a, type_b ORDER BY c DESC, f) AS r FROM ic) WHERE r = 1), "
    "an AS (SELECT msg, tk.n FROM cm ASOF JOIN tk ON cm.event_n >= tk.n), nodes AS (SELECT msg, src AS activity FROM edges UNION SELECT msg, dst FROM edges) "
    "SELECT msg, activity, type_a, type_b, cardinality FROM an JOIN ia USING (n) JOIN nodes USING (msg, activity) "
    "WHERE (msg, type_a) IN (SELECT (msg, object_type) FROM ac WHERE on_) AND (msg, type_b) IN (SELECT (msg, object_type) FROM ac WHERE on_)"
)
def aer_irregular(spark, sf_dir):
    own, messages, commands, edges = _merged(spark, sf_dir)
    aer, ticks = _irregular_aer(own)
    return objects.spelled_out(objects.merged_aer(messages, edges, aer, commands, ticks))


@query("SELECT role AS src, nxt AS dst, count(*)::BIGINT AS freq FROM (SELECT role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL GROUP BY ALL")
def conversation_dfg(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return discovery.dfg(c.select(F.col("turn").alias("n"), F.col("conv_id").alias("case_id"), F.col("role").alias("activity")))


@query(
    "SELECT src, dst, count(*)::BIGINT AS freq FROM (SELECT lag(c) OVER (PARTITION BY p_partkey ORDER BY i) AS src, c AS dst FROM "
    "(SELECT p_partkey, unnest(string_split(p_name, '')) AS c, unnest(range(len(p_name))) AS i FROM part)) WHERE src IS NOT NULL GROUP BY ALL"
)
def string_log_dfg(spark, sf_dir):
    return discovery.dfg(string_log(spark, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_name").alias("trace"))))


@query(
    "WITH r AS (SELECT 'conversations' AS log, role AS src, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM conversations UNION ALL "
    "SELECT 'types', c, lead(c) OVER (PARTITION BY p_partkey ORDER BY i) FROM (SELECT p_partkey, unnest(string_split(p_type, '')) AS c, unnest(range(len(p_type))) AS i FROM part)), "
    "o AS (SELECT DISTINCT log, src, dst FROM r WHERE src <> dst), a AS (SELECT log, src AS activity FROM o UNION SELECT log, dst FROM o) "
    "SELECT * FROM (SELECT log, activity, (log, activity) NOT IN (SELECT (log, dst) FROM o) AS is_start, (log, activity) NOT IN (SELECT (log, src) FROM o) AS is_end FROM a) WHERE is_start OR is_end"
)
def dfg_start_end(spark, sf_dir):
    types = string_log(spark, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), F.col("p_type").alias("trace")))
    edges = conversation_dfg(spark, sf_dir).withColumn("log", F.lit("conversations")).unionByName(discovery.dfg(types).withColumn("log", F.lit("types")))
    return discovery.start_end_activities(edges, by=("log",))


TEMPLATE = [
    {"activity": "register", "objects": {"Customer": ["c"]}}, {"activity": "order", "objects": {"Customer": ["c"], "Order": ["o"]}},
    {"activity": "add", "objects": {"Order": ["o"], "Item": ["i1", "i2"]}},
]


@query("SELECT 'Customer' AS object_type, 'register' AS src, 'order' AS dst, count(*)::BIGINT AS freq FROM customer UNION ALL SELECT 'Order', 'order', 'add', count(*) FROM customer")
def dict_ocel_dfg(spark, sf_dir):
    return objects.oc_dfg(objects.flatten(dict_ocel_log(spark, [(TEMPLATE, table(spark, sf_dir, "customer").count())])))


@query(
    OC_MERGED + ", o AS (SELECT DISTINCT msg, object_type, src, dst FROM edges WHERE src <> dst), a AS (SELECT msg, object_type, src AS activity FROM o UNION SELECT msg, object_type, dst FROM o), "
    "m AS (SELECT *, EXISTS (FROM o WHERE o.msg = a.msg AND o.object_type = a.object_type AND o.src = a.activity) AS s, EXISTS (FROM o WHERE o.msg = a.msg AND o.object_type = a.object_type AND o.dst = a.activity) AS t FROM a) "
    "SELECT msg, object_type, activity, s AND NOT t AS is_start, t AND NOT s AS is_end FROM m WHERE s <> t"
)
def oc_merge_ends(spark, sf_dir):
    return objects.spelled_out(objects.merged_ends(_merged(spark, sf_dir)[3]))


@query(
    f"{LOG}, e AS (SELECT src, dst, count(*) AS c FROM rel GROUP BY ALL), w AS (SELECT src, dst, c / max(c) OVER () AS x FROM e) "
    "SELECT src, dst, '\"' || src || '\" -> \"' || dst || '\" [penwidth=' || printf('%.2f', greatest(0.5, least(5, 5 * x))) || ', label=\"' || printf('%.2f', x) || '\"];' AS line FROM w"
)
def dot_text(spark, sf_dir):
    edges = dfg_counts(spark, sf_dir)
    top = edges.agg(F.max("freq")).first()[0]
    return render.dfg_lines(edges.withColumn("weight", F.col("freq") / F.lit(top)))
