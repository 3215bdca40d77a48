"""Text, time and number queries, and the file and message sources."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import functions as F

from driftloom.catalog import sql
from driftloom.catalog.base import query
from driftloom.functions import clock, text
from driftloom.operators.ranks import quantiles
from driftloom.plans import streams
from driftloom.plans.streams import table
from driftloom.session import checkpoint_root
from driftloom.sources import files, messages, sinks


def scratch(spark, name: str) -> str:
    """A new folder for files a query writes and reads back, next to the checkpoints."""
    root = checkpoint_root(spark)
    if "://" in root or root.startswith("file:"):
        return f"{root}/driftloom/{name}-{os.urandom(8).hex()}"
    return tempfile.mkdtemp(prefix=f"{name}-", dir=root) if os.path.isdir(root) else f"{root}/{name}-{os.urandom(8).hex()}"


@query("txt_unescape", f"SELECT page_id, md5({sql.unescape('html')}) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.unescape_html(F.col("html"))).alias("digest"))


@query("txt_lower", "SELECT doc_id, md5(lower(text)) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.lower("text")).alias("digest"))


@query("txt_urls", r"SELECT page_id, md5(regexp_replace(html, '(?:https?://|www\.)[^\s\x{a0}]+', ' ', 'g')) AS digest FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.drop_urls(F.col("html"))).alias("digest"))


@query("txt_mentions", r"SELECT doc_id, md5(regexp_replace(text, '@[\p{L}\p{N}_]+', ' ', 'g')) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.drop_mentions(F.col("text"))).alias("digest"))


@query("txt_hashtags", "SELECT doc_id, md5(replace(text, '#', ' ')) AS digest FROM documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.open_hashtags(F.col("text"))).alias("digest"))


@query("txt_squeeze", sql.SQUEEZED_DOCUMENTS)
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.squeeze_repeats(F.col("text"))).alias("digest"))


@query("txt_tokens", sql.with_(sql.cleaned("documents", "doc_id", "text")) + f"""
SELECT doc_id, len(tokens) AS n, md5(array_to_string(tokens, ' ')) AS digest
FROM (SELECT doc_id, regexp_extract_all(text, '{sql.TOKEN}') AS tokens FROM cleaned)""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").cast("long").alias("n"),
                       F.md5(F.array_join("tokens", " ")).alias("digest"))


@query("txt_token_bag", sql.with_(sql.cleaned("documents", "doc_id", "text")) + f"""
SELECT doc_id, word, count(*) AS k
FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{sql.TOKEN}')) AS word FROM cleaned) GROUP BY ALL""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", F.inline(text.token_bag(F.col("tokens"))))


@query("txt_topic", sql.with_(sql.cleaned("documents", "doc_id", "text")) + f"""
SELECT doc_id, CAST(list_has_any(regexp_extract_all(text, '{sql.TOKEN}'), ['the', 'and', 'ing']) AS INTEGER) AS in_topic
FROM cleaned""")
def _(spark, d):
    rows = table(spark, d, "documents").select("doc_id", text.tokens(F.col("text")).alias("tokens"))
    return rows.select("doc_id", text.mentions_topic(F.col("tokens"), ["the", "and", "ing"]).cast("int").alias("in_topic"))


def _corpus_dates(spark, d):
    """Events as a raw corpus: dates as zone-stamped text, labels 0 and 4."""
    e = table(spark, d, "events")
    stamp = F.date_format("ts", "EEE MMM dd HH:mm:ss 'PDT' yyyy")
    return e.select(
        F.when(F.col("value") > 34.6, 4).otherwise(0).alias("label"), F.col("event_id").alias("id"),
        stamp.alias("date"), F.lit("NO_QUERY").alias("query"), F.concat(F.lit("é"), F.col("user_id")).alias("user"),
        F.concat_ws(" ", "event_type", "props").alias("text"))


@query("tim_corpus_date", "SELECT event_id AS id, epoch_us(date_trunc('second', ts)) AS ts_us, CAST(1 AS INTEGER) AS zoned FROM events")
def _(spark, d):
    rows = _corpus_dates(spark, d)
    ts = clock.corpus_timestamp(F.col("date"))
    return rows.select("id", F.unix_micros(ts.cast("timestamp")).alias("ts_us"),
                       clock.has_zone_token(F.col("date")).cast("int").alias("zoned"))


@query("tim_model_clock", "SELECT event_id AS id, round(epoch_us(ts) / CAST(3.6e9 AS DOUBLE), 9) AS hours, CAST(event_id AS DOUBLE) AS instance FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"),
                    F.round(clock.model_time(F.col("ts"), F.col("event_id")), 9).alias("hours"),
                    clock.model_time(F.col("ts"), F.col("event_id"), "instance").alias("instance"))


@query("tim_synthetic", "SELECT event_id AS id, epoch_us(TIMESTAMP '2009-06-01' + to_seconds(event_id)) AS ts_us FROM events")
def _(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.unix_micros(
        clock.synthetic_timestamp(F.col("event_id")).cast("timestamp")).alias("ts_us"))


@query("tim_iso", "SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, epoch_us(ts) AS ts_us FROM events")
def _(spark, d):
    e = table(spark, d, "events").withColumn("iso", clock.iso_text(F.col("ts")))
    return e.select(F.col("event_id").alias("id"), "iso",
                    F.unix_micros(clock.from_iso_text(F.col("iso")).cast("timestamp")).alias("ts_us"))


@query("num_label_map", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 5 = 4 THEN 1 ELSE 0 END AS INTEGER) AS label FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), clock.binary_label(F.col("o_orderkey") % 5).cast("int").alias("label"))


@query("num_label_flip", sql.with_(sql.EVENTS) + """
SELECT idx, label AS orig_label, CASE WHEN idx >= (SELECT count(*) // 2 FROM ev) AND event_type = 'click'
  THEN 1 - label ELSE label END AS label FROM ev_tokens""")
def _(spark, d):
    rows = streams.events_stream(spark, d)
    hit = (F.col("idx") >= rows.count() // 2) & (F.get("tokens", F.lit(0)) == "click")
    return rows.select(
        "idx", F.col("label").cast("int").alias("orig_label"), clock.flip_label(F.col("label"), hit).cast("int").alias("label"))


@query("num_round", "SELECT event_id AS id, round(value / 7, 3) AS r3, round(value / 7, 4) AS r4, round(value / 7, 5) AS r5 FROM events")
def _(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"), *[F.round(F.col("value") / 7, k).alias(f"r{k}") for k in (3, 4, 5)])


@query("num_percent", """
SELECT event_type, printf('%.1f', round(avg(CAST(value > 34.6 AS INTEGER)) * 100, 1)) AS share,
  printf('%.1f', round(avg(CAST(value > 34.6 AS INTEGER)) * 100, 1)) || ' ± ' ||
  printf('%.1f', round(stddev_pop(CAST(value > 34.6 AS INTEGER)) * 100, 1)) AS spread FROM events GROUP BY 1""")
def _(spark, d):
    high = (F.col("value") > 34.6).cast("int")
    agg = table(spark, d, "events").groupBy("event_type").agg(
        F.avg(high).alias("m"), F.stddev_pop(high).alias("s"), F.count(F.lit(1)).alias("n"))
    return agg.select("event_type", clock.percent(F.col("m")).alias("share"),
                      clock.mean_spread(F.col("m"), F.col("s"), F.col("n")).alias("spread"))


@query("num_percentile", """
SELECT event_type, round(quantile_cont(value, CAST(0.95 AS DOUBLE)), 6) AS p95, round(median(value), 6) AS p50 FROM events GROUP BY 1""")
def _(spark, d):
    found = quantiles(table(spark, d, "events"), ["event_type"], "value", {"p95": 0.95, "p50": 0.5})
    return found.select("event_type", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"))


@query("src_raw_corpus", """
SELECT row_number() OVER (ORDER BY date_trunc('second', ts), event_id) - 1 AS idx, event_id AS id,
  epoch_us(date_trunc('second', ts)) AS ts_us, CAST(value > 34.6 AS INTEGER) AS label,
  'é' || CAST(user_id AS VARCHAR) AS user_name, event_type || ' ' || props AS text FROM events""")
def _(spark, d):
    path = scratch(spark, "corpus")
    _corpus_dates(spark, d).write.mode("overwrite").option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    rows = files.time_ordered(files.raw_corpus(spark, path))
    return rows.select("idx", "id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
                       F.col("label").cast("int").alias("label"), F.col("user").alias("user_name"), "text")


@query("src_projection", "SELECT event_id, user_id, value FROM events WHERE value > 34.6")
def _(spark, d):
    return table(spark, d, "events").where("value > 34.6").select("event_id", "user_id", "value")


def _event_runs(spark, d):
    rows = streams.events_stream(spark, d)
    return rows.withColumn("stream", F.lit("s_events")).withColumn("seed", (F.col("id") % 2).cast("int"))


@query("src_stream_partitions", sql.with_(sql.EVENTS) + """
SELECT 's_events_seed1' AS name, idx // 2 AS idx, id, label FROM (
  SELECT (row_number() OVER (ORDER BY idx) - 1) * 2 AS idx, id, label FROM ev_tokens WHERE id % 2 = 1)""")
def _(spark, d):
    from driftloom.operators.sampling import ordinal_by_index
    rows = ordinal_by_index(_event_runs(spark, d), ["stream", "seed"]).drop("idx", "tokens").withColumnRenamed("ordinal", "idx")
    root = scratch(spark, "streams")
    meta = rows.select("stream", "seed").distinct().withColumn("drift_points", F.array(F.lit(5).cast("long")))
    sinks.save_streams(rows, meta, root)
    return files.read_stream(spark, root, "s_events", 1, ["idx", "id", F.col("label").cast("int").alias("label")]).withColumn(
        "name", F.lit(files.stream_name("s_events", 1)))


@query("src_replay_slice", sql.with_(sql.EVENTS) + """
SELECT 'run-a' AS run, idx, id FROM ev_tokens WHERE idx >= 100 AND idx < (SELECT count(*) // 2 FROM ev)""")
def _(spark, d):
    rows = streams.events_stream(spark, d)
    half = table(spark, d, "events").count() // 2
    return files.replay_slice(rows, "run-a", 100, half - 100).select("run", "idx", "id")


@query("src_drift_points", """
SELECT event_type AS stream, 0 AS seed, k, p, CASE WHEN k = 0 THEN p + 50 ELSE p END AS e FROM (
  SELECT event_type, unnest([n // 4, n // 2]) AS p, unnest([0, 1]) AS k FROM (
    SELECT event_type, count(*) AS n FROM events GROUP BY 1))""")
def _(spark, d):
    n = table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    quarter, half = F.floor(F.col("n") / 4), F.floor(F.col("n") / 2)
    meta = n.select(F.col("event_type").alias("stream"), "n", F.array(quarter, half).alias("drift_points"),
                    F.array(F.array(quarter, quarter + 50)).alias("drift_windows"))
    path = scratch(spark, "sidecars")
    meta.write.mode("overwrite").json(path)
    return files.explode_drifts(spark.read.schema(files.SIDECAR_SCHEMA).json(path)).drop("natural")


@query("snk_two_streams", sql.with_(sql.EVENTS) + """
, parts AS (SELECT id % 2 AS seed, row_number() OVER (PARTITION BY id % 2 ORDER BY idx) - 1 AS idx, id FROM ev_tokens),
sizes AS (SELECT seed, count(*) AS n FROM parts GROUP BY seed)
SELECT 's_events' AS stream, seed, count(*) AS n, count(*) FILTER (idx >= s.n // 2) AS after_drift, CAST(sum(id) AS BIGINT) AS ids
FROM parts JOIN sizes s USING (seed) GROUP BY seed""")
def _(spark, d):
    """Two streams saved one after the other, read back together and joined with their drifts."""
    from driftloom.operators.sampling import ordinal_by_index
    rows = ordinal_by_index(_event_runs(spark, d), ["stream", "seed"]).drop("idx", "tokens").withColumnRenamed("ordinal", "idx")
    root = scratch(spark, "streams")
    half = rows.groupBy("stream", "seed").agg(F.array(F.floor(F.count(F.lit(1)) / 2).cast("long")).alias("drift_points"))
    for seed in (0, 1):
        sinks.save_streams(rows.where(F.col("seed") == seed), half.where(F.col("seed") == seed), root)
    drifts = files.explode_drifts(files.read_sidecars(spark, f"{root}/drift_points"))
    both = spark.read.parquet(f"{root}/streams").join(drifts.select("stream", "seed", "p"), ["stream", "seed"])
    return both.groupBy("stream", "seed").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("idx") >= F.col("p")).alias("after_drift"), F.sum("id").alias("ids"))


def _messages(spark, d):
    rows = streams.events_stream(spark, d).withColumn("stream", F.lit("events")).withColumn(
        "run", F.concat(F.lit("run-"), (F.col("id") % 3).cast("string")))
    return messages.payload(rows, sent_ms=1_700_000_000_000)


PAYLOAD_SQL = sql.with_(sql.EVENTS) + """
SELECT 'run-' || CAST(id % 3 AS VARCHAR) AS run, idx,
  '{"stream":"events","run":"run-' || CAST(id % 3 AS VARCHAR) || '","idx":' || CAST(idx AS VARCHAR) || ',"id":' || CAST(id AS VARCHAR)
  || ',"ts":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '","text":"' || array_to_string(tokens, ' ')
  || '","label":' || CAST(label AS VARCHAR) || ',"sent_ms":1700000000000}' AS value FROM ev_tokens"""


@query("snk_payload", PAYLOAD_SQL)
def _(spark, d):
    return _messages(spark, d).select("run", "idx", "value")


@query("src_parse", sql.with_(sql.EVENTS) + """
SELECT 'run-' || CAST(id % 3 AS VARCHAR) AS run, idx, id, label, array_to_string(tokens, ' ') AS words,
  epoch_us(ts) AS ts_us FROM ev_tokens WHERE id % 7 <> 3""")
def _(spark, d):
    # Every seventh message is cut short: it must end up aside, not stop the query.
    broken = F.when(F.regexp_extract("value", r'"id":(\d+)', 1).cast("long") % 7 == 3,
                    F.expr("left(value, 20)")).otherwise(F.col("value"))
    parsed = messages.parse(_messages(spark, d).select(broken.alias("value")))
    return messages.accepted(parsed).select(
        "run", "idx", "id", "label", F.array_join("tokens", " ").alias("words"),
        F.unix_micros(clock.from_iso_text(F.col("ts")).cast("timestamp")).alias("ts_us"))


@query("src_dead_letters", PAYLOAD_SQL.replace("SELECT 'run-'", "SELECT idx, left(value, 20) AS raw FROM (SELECT id, 'run-'", 1) + ") WHERE id % 7 = 3")
def _(spark, d):
    with_id = _messages(spark, d).withColumn("_id", F.regexp_extract("value", r'"id":(\d+)', 1).cast("long"))
    cut_short = F.when(F.col("_id") % 7 == 3, F.expr("left(value, 20)")).otherwise(F.col("value"))
    tagged = with_id.select(F.col("idx").alias("at"), cut_short.alias("value"))
    return messages.parse(tagged).where("not ok").select(F.col("at").alias("idx"), "raw")


@query("src_props_json", """SELECT event_id, CAST(regexp_extract(props, '"k": (\\d+)', 1) AS INTEGER) AS k FROM events""")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("snk_stream_metadata", """
SELECT event_type AS stream, count(*) AS n, round(avg(CAST(value > 34.6 AS INTEGER)), 4) AS positive_share, 1 AS dense
FROM events GROUP BY 1""")
def _(spark, d):
    from driftloom.operators.sampling import ordinal_by_index
    rows = streams.events_stream(spark, d).withColumn("stream", F.get("tokens", F.lit(0)))
    dense = ordinal_by_index(rows, ["stream"]).drop("idx").withColumnRenamed("ordinal", "idx")
    return sinks.stream_metadata(dense, ["stream"]).withColumn("dense", F.col("dense").cast("int"))


@query("snk_append_runs", """
SELECT event_type AS run, CAST(count(*) AS DOUBLE) AS n, CAST(NULL AS DOUBLE) AS mean_value FROM events WHERE user_id % 2 = 0 GROUP BY 1
UNION ALL SELECT event_type, CAST(NULL AS DOUBLE), round(avg(value), 6) FROM events WHERE user_id % 2 = 1 GROUP BY 1""")
def _(spark, d):
    e = table(spark, d, "events")
    old = e.where("user_id % 2 = 0").groupBy(F.col("event_type").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    new = e.where("user_id % 2 = 1").groupBy(F.col("event_type").alias("run")).agg(F.round(F.avg("value"), 6).alias("mean_value"))
    return sinks.append_runs(old, new)


@query("snk_drift_event_text", sql.with_(sql.EVENTS) + """
SELECT idx, 'm' || CAST(user_id % 3 AS VARCHAR) || ': ' || event_type || ' change at ' || format('{:,}', idx * 1000) AS text
FROM ev_tokens WHERE label = 1""")
def _(spark, d):
    rows = streams.events_stream(spark, d).select(
        "idx", F.concat(F.lit("m"), (F.col("user").cast("long") % 3).cast("string")).alias("model"),
        F.get("tokens", F.lit(0)).alias("detector"),
        F.when(F.col("label") == 1, "change").otherwise("warning").alias("kind"))
    points = sinks.drift_event_points(rows.withColumn("small", F.col("idx")).withColumn("idx", F.col("idx") * 1000))
    return points.select(F.col("small").alias("idx"), "text")


@query("snk_long_form", """
SELECT event_id AS run, field, value FROM (
  SELECT event_id, 'value' AS field, value FROM events
  UNION ALL SELECT event_id, 'user_id', CAST(user_id AS DOUBLE) FROM events WHERE user_id % 2 = 0)""")
def _(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("run"), F.col("ts").alias("time"), "value",
                                         F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("user_id"))
    return sinks.long_form(e, ["run"], ["value", "user_id"]).select("run", "field", "value")
