"""Stream construction: order, change points, sampling, scenarios."""

from __future__ import annotations

from pyspark.sql import functions as F

from driftloom.catalog import sql
from driftloom.catalog.base import query
from driftloom.operators import sampling
from driftloom.operators.index import dense_index
from driftloom.operators.prefix import block_of, running
from driftloom.plans import report, scenarios, streams
from driftloom.session import cut

table = streams.table


@query("str_time_order", """
SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS idx, o_orderkey AS id FROM orders""")
def _(spark, d):
    return dense_index(table(spark, d, "orders").select("o_orderdate", F.col("o_orderkey").alias("id")),
                       ["o_orderdate", "id"]).select("idx", "id")


@query("eng_blocked_prefix", sql.with_(sql.EVENTS) + """
SELECT idx, CAST(coalesce(sum(user_id) OVER p, 0) AS BIGINT) AS total, max(value) OVER p AS highest FROM ev
WINDOW p AS (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(spark, d):
    rows = dense_index(table(spark, d, "events").select("ts", "event_id", "user_id", "value"), ["ts", "event_id"])
    rows = rows.withColumn("all", F.lit(0)).withColumn("blk", block_of(F.col("idx"), 512))
    return running(rows, ["all"], "idx", "blk", sums={"total": F.col("user_id")}, maxes={"highest": F.col("value")}).select(
        "idx", "total", "highest")


@query("str_change_point", sql.with_(sql.EVENTS) + """
SELECT p.change_idx, epoch_us(e.ts) AS change_us FROM (SELECT max(idx) + 1 AS change_idx FROM ev_tokens WHERE value > 100) p
LEFT JOIN ev e ON e.idx = p.change_idx""")
def _(spark, d):
    rows = dense_index(table(spark, d, "events").select("ts", "event_id", "value"), ["ts", "event_id"]).withColumn(
        "label", (F.col("value") > 100).cast("int"))
    return sampling.natural_change_point(rows).select(
        "change_idx", F.unix_micros(F.col("change_ts").cast("timestamp")).alias("change_us"))


@query("str_duplicate_ids", "SELECT CAST(sum(c - 1) AS BIGINT) AS duplicates, CAST(sum(c) AS BIGINT) AS n FROM (SELECT user_id, count(*) AS c FROM events GROUP BY 1)")
def _(spark, d):
    return sampling.duplicate_ids(table(spark, d, "events").select(F.col("user_id").alias("id")))


@query("str_usable_rows", sql.with_(sql.cleaned("(SELECT md5(text) AS id, doc_id, text FROM documents)", "doc_id", "text", "id")) + f"""
SELECT doc_id FROM cleaned WHERE len(regexp_extract_all(text, '{sql.TOKEN}')) > 0
  AND id NOT IN (SELECT md5(text) FROM documents GROUP BY 1 HAVING count(*) > 1)""")
def _(spark, d):
    from driftloom.functions import text
    docs = table(spark, d, "documents").select("doc_id", F.md5("text").alias("id"), text.tokens(F.col("text")).alias("tokens"))
    return sampling.usable_rows(docs).select("doc_id")


# Segments end at the last row whose value exceeds 200; class totals are shares of the stream.
SEGMENTED = sql.EVENTS + """,
change AS (SELECT max(idx) + 1 AS c FROM ev_tokens WHERE value > 200),
bounds AS (SELECT i, CAST(floor(c * i / 6) AS BIGINT) AS b FROM change, range(1, 7) AS r(i)),
segmented AS (SELECT e.*, (SELECT count(*) FROM bounds WHERE b <= e.idx) AS segment FROM ev_tokens e)"""
QUOTAS = """
pattern AS (SELECT * FROM (VALUES
  (0, 1, 1.0), (1, 1, 0.25), (2, 1, 0.8), (3, 1, 0.15), (4, 1, 0.6), (5, 1, 0.3),
  (0, 0, 0.6), (1, 0, 1.0), (2, 0, 0.5), (3, 0, 1.0), (4, 0, 0.7), (5, 0, 1.0)) AS v(segment, label, w)),
sizes AS (
  SELECT p.segment, p.label, CAST(p.w AS DOUBLE) AS w, count(s.idx) AS size FROM pattern p
  LEFT JOIN segmented s ON s.segment = p.segment AND s.label = p.label GROUP BY ALL),
target AS (SELECT 1 AS label, count(*) // 5 AS target FROM ev UNION ALL SELECT 0, count(*) // 4 FROM ev),
bisect AS (
  SELECT 0 AS i, label, CAST(0 AS DOUBLE) AS lo, 1 / min(w) AS hi, CAST(0 AS DOUBLE) AS mid FROM sizes GROUP BY label
  UNION ALL
  SELECT i + 1, label, CASE WHEN kept < target THEN m ELSE lo END, CASE WHEN kept < target THEN hi ELSE m END, m FROM (
    SELECT b.i, b.label, b.lo, b.hi, (b.lo + b.hi) / 2 AS m, t.target,
      (SELECT sum(least(CAST(1 AS DOUBLE), (b.lo + b.hi) / 2 * z.w) * z.size) FROM sizes z WHERE z.label = b.label) AS kept
    FROM bisect b JOIN target t ON t.label = b.label WHERE b.i < 100)),
floors AS (
  SELECT z.segment, z.label, z.size, t.target, CAST(floor(least(CAST(1 AS DOUBLE), b.mid * z.w) * z.size) AS BIGINT) AS base
  FROM sizes z JOIN bisect b ON b.label = z.label AND b.i = 100 JOIN target t ON t.label = z.label),
quota AS (
  SELECT segment, label, size, base + CASE WHEN row_number() OVER (PARTITION BY label ORDER BY base - size, segment)
    <= target - sum(base) OVER (PARTITION BY label) THEN 1 ELSE 0 END AS quota FROM floors)"""
SAMPLED = """
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.segment, s.label ORDER BY md5('42-' || s.id || '-' || s.idx)) AS r FROM segmented s),
kept AS (
  SELECT r.idx, r.id, r.label, r.segment FROM ranked r JOIN quota q ON q.segment = r.segment AND q.label = r.label WHERE r.r <= q.quota
  UNION ALL SELECT idx, id, label, segment FROM segmented WHERE segment = 6)"""


def _segmented(spark, d):
    e = dense_index(table(spark, d, "events").select("ts", F.col("event_id").alias("id"), "value"), ["ts", "id"])
    e = e.withColumn("label", (F.col("value") > 34.6).cast("int"))
    change = e.where("value > 200").agg((F.max("idx") + 1).alias("change_idx")).first()["change_idx"]
    return cut(sampling.with_segment(e, change), "segmented")


def _quotas(spark, d, rows):
    n = table(spark, d, "events").count()
    return sampling.quotas(rows, {1: n // 5, 0: n // 4})


def _kept(spark, d):
    rows = _segmented(spark, d)
    return sampling.stratified_sample(rows, _quotas(spark, d, rows), 42)


@query("str_segments", sql.with_(SEGMENTED) + "SELECT idx, CAST(segment AS INTEGER) AS segment FROM segmented")
def _(spark, d):
    return _segmented(spark, d).select("idx", "segment")


@query("str_quotas", sql.with_(SEGMENTED, QUOTAS, recursive=True) + "SELECT segment, label, size, CAST(quota AS BIGINT) AS quota FROM quota")
def _(spark, d):
    return _quotas(spark, d, _segmented(spark, d))


@query("str_stratified_sample", sql.with_(SEGMENTED, QUOTAS, SAMPLED, recursive=True) + "SELECT idx, id, label, CAST(segment AS INTEGER) AS segment FROM kept")
def _(spark, d):
    return _kept(spark, d).select("idx", "id", "label", "segment")


@query("str_new_positions", sql.with_(SEGMENTED, QUOTAS, SAMPLED, recursive=True) + """
SELECT CAST(b.i - 1 AS INTEGER) AS segment, (SELECT count(*) FROM kept k WHERE k.idx < b.b) AS drift_point FROM bounds b""")
def _(spark, d):
    return sampling.new_positions(_kept(spark, d))


@query("str_segment_shares", sql.with_(SEGMENTED, QUOTAS, SAMPLED, recursive=True) + """
SELECT CAST(segment AS INTEGER) AS segment, round(avg(label), 3) AS positive_share FROM kept GROUP BY 1""")
def _(spark, d):
    return sampling.segment_shares(_kept(spark, d))


# Scenarios from the events: topic A = clicks, B = views, the rest general; length n / 10.
TOPIC_A, TOPIC_B, SEEDS = ["click"], ["view"], (0, 1)
N = "(SELECT count(*) // 10 FROM events)"
POOLS = sql.EVENTS + """,
pools AS (
  SELECT id, ts, label, CASE event_type WHEN 'click' THEN 'A' WHEN 'view' THEN 'B' ELSE 'general' END AS pool FROM ev_tokens)"""
SLOTS = f"""
names AS (SELECT * FROM (VALUES ('s_sudden'), ('s_gradual'), ('s_recurring'), ('s_label_flip'), ('s_prior_shift'), ('s_label_flip_topic')) AS v(stream)),
cells AS (SELECT stream, seed, idx, {N} AS n FROM names, (VALUES (0), (1)) AS s(seed), range(0, {N}) AS r(idx)),
shaped AS (
  SELECT *, n // 2 - CAST(floor(n * 0.25) AS BIGINT) // 2 AS a, n // 2 + CAST(floor(n * 0.25) AS BIGINT) // 2 AS z,
    row_number() OVER (PARTITION BY stream, seed ORDER BY md5(stream || '-' || seed || '-mix-' || idx)) - 1 AS mix FROM cells),
topics AS (
  SELECT stream, seed, idx, n, CASE stream
    WHEN 's_sudden' THEN CASE WHEN idx < n // 2 THEN 'A' ELSE 'B' END
    WHEN 's_gradual' THEN CASE WHEN CAST('0x' || substr(md5(stream || '-' || seed || '-topic-' || idx), 1, 8) AS BIGINT) / CAST(4294967296 AS DOUBLE)
      < greatest(0, least(1, (idx - a) / CAST(z - a AS DOUBLE))) THEN 'B' ELSE 'A' END
    WHEN 's_recurring' THEN CASE WHEN least(idx // (n // 4), 3) % 2 = 0 THEN 'A' ELSE 'B' END
    WHEN 's_label_flip_topic' THEN CASE WHEN mix < round_even(n * 0.5, 0) THEN 'A' ELSE 'general' END
    ELSE 'general' END AS topic FROM shaped),
parts AS (SELECT *, CASE WHEN stream = 's_prior_shift' AND idx >= n // 2 THEN 'late' ELSE topic END AS part FROM topics),
slots AS (
  SELECT stream, seed, idx, n, topic, CAST(row_number() OVER (PARTITION BY stream, seed, part ORDER BY md5(stream || '-' || seed || '-class-' || idx)) - 1
    < round_even(count(*) OVER (PARTITION BY stream, seed, part) * CASE WHEN part = 'late' THEN 0.1 ELSE 0.5 END, 0) AS INTEGER) AS class FROM parts)"""
DRAWN = """
numbered AS (SELECT *, row_number() OVER (PARTITION BY stream, seed, topic, class ORDER BY idx) AS o FROM slots),
source AS (
  SELECT seed, pool, label, id, ts, row_number() OVER (PARTITION BY seed, pool, label ORDER BY md5(seed || '-' || id)) AS o
  FROM pools, (VALUES (0), (1)) AS s(seed)),
drawn AS (
  SELECT n.stream, n.seed, n.idx, n.n, n.topic, n.class, s.id, s.ts AS orig_ts, s.label AS orig_label FROM numbered n
  LEFT JOIN source s ON s.seed = n.seed AND s.pool = n.topic AND s.label = n.class AND s.o = n.o),
built AS (
  SELECT *, CASE WHEN idx >= n // 2 AND (stream = 's_label_flip' OR (stream = 's_label_flip_topic' AND topic = 'A'))
    THEN 1 - orig_label ELSE orig_label END AS label FROM drawn)"""


def _pools(spark, d):
    return scenarios.topic_pools(streams.events_stream(spark, d), TOPIC_A, TOPIC_B)


def _length(spark, d):
    return table(spark, d, "events").count() // 10


def _slots(spark, d):
    return scenarios.slots(spark, scenarios.SCENARIOS, _length(spark, d), SEEDS)


def _built(spark, d):
    n = _length(spark, d)
    return scenarios.assemble(scenarios.draw(cut(_pools(spark, d), "pools"), cut(_slots(spark, d), "slots"), SEEDS), n)


@query("str_topic_pools", sql.with_(POOLS) + "SELECT pool, label, count(*) AS n FROM pools GROUP BY ALL")
def _(spark, d):
    return _pools(spark, d).groupBy("pool", F.col("label").cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))


for _scenario in scenarios.SCENARIOS:
    query(f"str_{_scenario[2:]}_slots", sql.with_(POOLS, SLOTS) + f"SELECT seed, idx, topic, class FROM slots WHERE stream = '{_scenario}'")(
        lambda spark, d, s=_scenario: scenarios.slots(spark, [s], _length(spark, d), SEEDS).select("seed", "idx", "topic", "class"))


@query("str_pool_draw", sql.with_(POOLS, SLOTS, DRAWN) + "SELECT stream, seed, idx, topic, class, id FROM drawn")
def _(spark, d):
    return scenarios.draw(cut(_pools(spark, d), "pools"), cut(_slots(spark, d), "slots"), SEEDS).select("stream", "seed", "idx", "topic", "class", "id")


@query("str_pool_exhausted", sql.with_(POOLS, SLOTS, DRAWN.replace("FROM pools, (", "FROM (SELECT * FROM pools WHERE id % 10 < 1) AS pools, (")) + """
SELECT stream, seed, topic, class, count(*) AS missing FROM drawn WHERE id IS NULL GROUP BY ALL""")
def _(spark, d):
    thin = cut(_pools(spark, d).where("id % 10 < 1"), "pools")  # a pool made too small, to see it reported
    return scenarios.exhausted(scenarios.draw(thin, cut(_slots(spark, d), "slots"), SEEDS))


@query("str_scenarios", sql.with_(POOLS, SLOTS, DRAWN) + """
SELECT stream, seed, idx, id, epoch_us(TIMESTAMP '2009-06-01' + to_seconds(idx)) AS ts_us, label, topic, orig_label, epoch_us(orig_ts) AS orig_us FROM built""")
def _(spark, d):
    return _built(spark, d).select(
        "stream", "seed", "idx", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.col("label").cast("int").alias("label"), "topic", F.col("orig_label").cast("int").alias("orig_label"),
        F.unix_micros(F.col("orig_ts").cast("timestamp")).alias("orig_us"))


@query("rpt_topic_flip_shares", sql.with_(POOLS, SLOTS, DRAWN) + """
SELECT stream, seed, idx // 100 AS win, round(avg(label), 6) AS positive, round(avg(CAST(topic = 'B' AS INTEGER)), 6) AS topic_b,
  round(CASE WHEN max(max(CAST(topic = 'A' AS INTEGER))) OVER (PARTITION BY stream, seed) = 1
    THEN avg(CAST(label <> orig_label AS INTEGER)) / greatest(avg(CAST(topic = 'A' AS INTEGER)), 1e-9)
    ELSE avg(CAST(label <> orig_label AS INTEGER)) END, 6) AS flipped
FROM built GROUP BY stream, seed, idx // 100 HAVING count(*) = 100""")
def _(spark, d):
    out = report.topic_and_flip_shares(_built(spark, d), 100)
    return out.select("stream", "seed", "win", *[F.round(c, 6).alias(c) for c in ("positive", "topic_b", "flipped")])
