"""Streams replayed over the driver tables: all that is there, then the result at rest."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalogspark.operators.screen import Policy, screen
from catalogspark.plans import bindings as b
from catalogspark.plans.registry import query, view
from catalogspark.session import ensure_checkpoint_dir
from catalogspark.sources import policy_store
from catalogspark.streaming import catalog as stream_catalog
from catalogspark.streaming import clients as stream_clients

ENDS_AFTER = 20 * b.DAY


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table as a stream of its files."""
    schema = b.table(spark, sf, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)


def replayed(spark: SparkSession, df: DataFrame, ts: str, *, parts: int = 3, after: tuple[int, ...] = (60, 120)) -> DataFrame:
    """A table as a stream in order of time: a file for each part, and last a row for each number of days ``after``.

    These let all others be finished; a join followed by an aggregate takes one for each.
    """
    folder = new_folder(spark, "replay")
    low, high = df.agg(F.min(ts), F.max(ts)).first()
    step = (high - low) / parts
    for k in range(parts):
        inside = (F.col(ts) >= low + k * step) & ((F.col(ts) < low + (k + 1) * step) if k + 1 < parts else F.lit(True))
        df.filter(inside).write.mode("append").parquet(folder)
    # Their user is named, though by nothing: a join drops rows without key before they move the watermark.
    rest = [F.lit("" if c == "user_hash" else None).cast(df.schema[c].dataType).alias(c) for c in df.columns if c != ts]
    for days in after:
        last = df.agg((F.max(ts) + F.expr(f"interval {days} days")).alias(ts)).select(ts, *rest)
        last.select(*df.columns).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def finished(spark: SparkSession, stream: DataFrame) -> DataFrame:
    """All rows of a stream that ends."""
    sink = new_folder(spark, "sink")
    writer = stream.writeStream.format("parquet").option("path", f"{sink}/rows").option("checkpointLocation", f"{sink}/checkpoint")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{sink}/rows")


@query("j6_streamed_sessions", """
SELECT user_hash, min(at_us) AS started_us, max(at_us) AS ended_us, count(*) AS events FROM (
  SELECT *, sum(opens) OVER (PARTITION BY user_hash ORDER BY at_us) AS session_no FROM (
    SELECT *, CASE WHEN at_us - lag(at_us) OVER (PARTITION BY user_hash ORDER BY at_us) <= 86400000000 THEN 0 ELSE 1 END AS opens
    FROM v_activity)) GROUP BY user_hash, session_no""")
def j6_streamed(spark, sf):
    """Two channels of activity as a stream; sessions as they close."""
    activity = b.events(spark, sf).filter(F.col("event_type").isin("view", "click")).select("user_hash", "ts")
    closed = stream_clients.stream_sessions(replayed(spark, activity, "ts"), idle_seconds=b.DAY)
    return finished(spark, closed).filter(F.col("user_hash") != "")


@query("j7_streamed_value", """
SELECT p.user_hash, p.event_id AS probe_id, p.at_us, p.event_id AS announced,
  CASE WHEN o.port <> 0 AND p.at_us - o.at_us < 43200000000 THEN o.port ELSE p.event_id END AS effective
FROM (SELECT * FROM v_events WHERE event_type = 'purchase') p
ASOF LEFT JOIN (SELECT user_hash, at_us, event_id % 5 AS port FROM v_events WHERE event_type = 'click') o
  ON p.user_hash = o.user_hash AND p.at_us >= o.at_us""")
def j7_streamed(spark, sf):
    """Requests and observations as two streams."""
    rows = b.events(spark, sf).filter(F.col("event_type").isin("purchase", "click")).select("user_hash", "ts", "event_id", "event_type")
    stream = replayed(spark, rows, "ts")
    probes = stream.filter("event_type = 'purchase' or event_type is null").select(
        "user_hash", "ts", F.col("event_id").alias("probe_id"), F.col("event_id").alias("announced"))
    seen = stream.filter("event_type = 'click' or event_type is null").select("user_hash", "ts", (F.col("event_id") % 5).alias("value"))
    answered = stream_clients.stream_fresh_value(probes, seen, tolerance_seconds=12 * 3600)
    return finished(spark, answered).filter(F.col("user_hash") != "")


view("v_session_starts", "SELECT user_hash, session_id, min(at_us) AS started FROM v_offers GROUP BY user_hash, session_id")
view("v_tombstones", f"""
SELECT DISTINCT user_hash, session_id, at_us + CAST({ENDS_AFTER} AS BIGINT) * 1000000 AS gone_us FROM v_offers WHERE seq % 8 >= 6""")
view("v_gone", """
SELECT t.user_hash, max(gone_us) AS gone_us FROM v_tombstones t JOIN v_session_starts s USING (user_hash, session_id)
WHERE NOT EXISTS (SELECT 1 FROM v_session_starts n WHERE n.user_hash = t.user_hash AND n.started <= t.gone_us
  AND (n.started, n.session_id) > (s.started, s.session_id)) GROUP BY t.user_hash""")
view("v_live_pieces", f"""
SELECT p.* FROM (SELECT file_hash, user_hash, session_id, min(at_us) AS first_us, max(at_us) AS last_us,
    arg_max(complete, (ts, seq, user_hash, file_hash, name, complete)) AS complete
  FROM v_screened_offers WHERE layer IS NULL GROUP BY file_hash, user_hash, session_id) p
LEFT JOIN v_gone g ON g.user_hash = p.user_hash WHERE g.gone_us IS NULL OR p.last_us > g.gone_us""")
view("v_first_allowed", f"""
SELECT file_hash, name FROM (SELECT file_hash, name, row_number() OVER (PARTITION BY file_hash ORDER BY {b._ORDER}) AS rn
  FROM v_screened_offers WHERE layer IS NULL) WHERE rn = 1""")


@query("k11_streaming_catalog", """
SELECT file_hash, user_hash, name, complete, first_us, last_us FROM (
  SELECT file_hash, user_hash, min(first_us) AS first_us, max(last_us) AS last_us, arg_max(complete, (last_us, complete)) AS complete
  FROM v_live_pieces GROUP BY file_hash, user_hash) JOIN v_first_allowed USING (file_hash)""")
def k11(spark, sf):
    """Offers and disconnects as two streams; then the catalog's sources with their file's name.

    Files go by their number and users by the bytes of their hash; hashes are made of the result.
    """
    root = new_folder(spark, "catalog")
    lines, policy = stream_of(spark, sf, "lineitem"), b.policy(spark, sf, True)
    ended = b.narrow_offers_of(lines, spark, sf).filter(F.col("seq") % 8 >= 6).select(
        "user_hash", "session_id", (F.col("ts") + F.expr(f"interval {ENDS_AFTER} seconds")).alias("ts"))
    running = [
        stream_catalog.run_departures(ended, root, f"{root}/checkpoint-departures", once=True),
        stream_catalog.run_catalog(
            lines, root, f"{root}/checkpoint-offers", lambda: policy, once=True,
            shape=lambda batch: b.narrow_offers_of(batch, spark, sf).drop("complete")),
    ]
    for stream in running:
        stream.awaitTermination()
    return stream_catalog.read_named_sources(spark, root).select(
        b.file_id("file_hash").alias("file_hash"), F.lower(F.hex("user_hash")).alias("user_hash"), "name", "complete",
        F.unix_micros("first_ts").alias("first_us"), F.unix_micros("last_ts").alias("last_us"))


@query("a10_policy_refresh", """
SELECT 1 AS version, file_hash, layer, reason FROM v_screened_files
UNION ALL SELECT v.version, f.file_hash,
  CASE WHEN listed = 0 THEN NULL WHEN listed = 1 THEN 'L3' WHEN listed = 2 THEN 'L5' WHEN l2 IS NOT NULL THEN 'L2' END,
  CASE WHEN listed = 0 THEN NULL WHEN listed = 1 THEN 'hash' WHEN listed = 2 THEN 'poison' ELSE l2 END
FROM v_files f JOIN v_name_rules r ON f.name = r.name LEFT JOIN v_listed l ON l.file_hash = f.file_hash
CROSS JOIN (SELECT unnest([2, 3]) AS version) v""")
def a10(spark, sf):
    """A published version, one with emptied term lists, and one that cannot be read: the lists then stay as they are."""
    root, lists, files = new_folder(spark, "policy"), b.policy(spark, sf), b.files(spark, sf)
    policy_store.publish(spark, root, 1, hashes=lists.hashes, terms=lists.terms, extra_terms=lists.extra_terms)
    first = policy_store.refresh(spark, root, Policy(rule=b.RULE, public=True))
    policy_store.publish(spark, root, 2, hashes=lists.hashes)
    second = policy_store.refresh(spark, root, first)
    # The log names a version of which nothing was written.
    spark.range(1).select(F.lit(3).alias("version")).write.mode("append").parquet(f"{root}/log")
    third = policy_store.refresh(spark, root, second)
    screened = [
        screen(files, policy).select(F.lit(k + 1).alias("version"), "file_hash", "layer", "reason") for k, policy in enumerate((first, second, third))]
    return screened[0].unionByName(screened[1]).unionByName(screened[2])
