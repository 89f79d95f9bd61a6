"""Streams replayed over files must equal the batch forms."""

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import catalog, traffic
from catalogspark.operators.traffic import FloodLimits
from catalogspark.plans import bindings as b
from catalogspark.operators.screen import Policy
from catalogspark.streaming import catalog as stream_catalog
from catalogspark.streaming import enforce as stream_enforce
from catalogspark.streaming import traffic as stream_traffic


def _files_in_order(df, path, column, parts):
    """Write rows as files in time order, so a replay reads them in that order."""
    bounds = df.approxQuantile(column, [i / parts for i in range(1, parts)], 0.0)
    bounds = [float("-inf"), *bounds, float("inf")]
    for i, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
        df.filter((F.col(column) > lo) & (F.col(column) <= hi)).coalesce(1).write.parquet(f"{path}/part{i:02d}")


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _replay(spark, tmp_path, df, column, transform, parts=2):
    """Run a stream over the written files, one file per micro-batch, and return its rows."""
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    _files_in_order(df, source, column, parts)
    events = (
        spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(source)
    )
    query = (
        transform(events).writeStream.format("parquet").option("path", sink)
        .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    )
    assert query.awaitTermination(300)
    return spark.read.parquet(sink)


def _rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_bans_equal_batch(spark, sf, tmp_path):
    events = b.queries(spark, sf).select("ip", "at_us")
    limits = FloodLimits(
        window_seconds=b.DAY * 3, min_samples=3, rate=2 / 1440, flood_rate=3 / 1440,
        stddev_ms=b.FLOOD.stddev_ms, ban_seconds=5 * b.DAY,
    )
    streamed = _replay(spark, tmp_path, events, "at_us", lambda e: stream_traffic.stream_bans(e, limits, expire=False))
    expected = _rows(traffic.timed_bans(events, limits), "ip", "at_us", "samples", "reason")
    assert expected and _rows(streamed, "ip", "at_us", "samples", "reason") == expected


def test_suppression_equals_batch(spark, sf, tmp_path):
    events = b.events(spark, sf).select("event_type", "at_us", "event_id")
    keys = ["event_type"]
    streamed = _replay(
        spark, tmp_path, events, "at_us",
        lambda e: stream_traffic.stream_suppressed(e, keys=keys, window_seconds=6 * 3600),
    )
    expected = traffic.suppress_repeats(events, keys=keys, seq="event_id", window_seconds=6 * 3600)
    assert _rows(streamed, *keys, "at_us", "suppressed") == _rows(expected, *keys, "at_us", "suppressed")


def test_ban_marks_equal_batch(spark, sf, tmp_path):
    caught = b.catches(spark, sf).select("user_hash", "file_hash", "caught_us")
    options = dict(window_seconds=b.COUNT_WINDOW, retention_seconds=b.RETENTION, threshold=b.THRESHOLD)
    streamed = _replay(
        spark, tmp_path, caught, "caught_us", lambda e: stream_enforce.stream_ban_marks(e, **options)
    )
    assert _rows(streamed, "user_hash", "caught_us") == _rows(b.ban_marks(spark, sf), "user_hash", "caught_us")


def test_catalog_equals_batch(spark, sf, tmp_path):
    offers = b.offers(spark, sf).drop("complete")
    source, root = str(tmp_path / "in"), str(tmp_path / "catalog")
    _files_in_order(offers.withColumn("us", F.unix_micros("ts")), source, "us", 2)
    stream = (
        spark.readStream.schema(offers.schema).option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(source)
    )
    policy = b.policy(spark, sf)
    stream_catalog.run_catalog(
        stream, root, str(tmp_path / "cp"), lambda: policy, once=True
    ).awaitTermination(300)

    screened = b.screened_offers(spark, sf)
    allowed = screened.filter(F.col("layer").isNull())
    columns = ("file_hash", "user_hash", "ip", "port", "complete", "first_ts", "last_ts")

    def check():
        assert _rows(stream_catalog.read_files(spark, root), "file_hash", "name", "size", "last_seen") == _rows(
            catalog.files(allowed), "file_hash", "name", "size", "last_seen"
        )
        assert _rows(stream_catalog.read_sources(spark, root), *columns) == _rows(catalog.sources(allowed), *columns)

    check()
    assert stream_catalog.read_blocks(spark, root).count() == screened.filter(F.col("layer").isNotNull()).count()
    stream_catalog.compact(spark, root, 0)
    check()


def test_disconnects_remove_sources(spark, tmp_path):
    """The end of a user's latest session removes their sources; that of an older one, or of another user, does not."""
    root = str(tmp_path / "catalog")
    offer = lambda t, user, session, file: (f"2024-01-{t:02d} 00:00:00", t, user, session, file)
    rows = [offer(1, "u1", "a", "f1"), offer(1, "u1", "a", "f2"), offer(3, "u1", "b", "f1"), offer(2, "u2", "c", "f2"), offer(2, "u3", "d", "f3"), offer(9, "u3", "e", "f4")]
    offers = spark.createDataFrame(rows, "ts string, seq bigint, user_hash string, session_id string, file_hash string").select(
        F.col("ts").cast("timestamp").alias("ts"), "seq", "session_id", "user_hash", "file_hash", F.lit(1).cast("bigint").alias("ip"), F.lit(2).alias("port"),
        F.concat("file_hash", F.lit(" red.mkv")).alias("name"), F.lit(5).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("client_id"), F.lit(0).alias("client_port"))
    gone = spark.createDataFrame([("u1", "a", "2024-01-04 00:00:00"), ("u2", "c", "2024-01-02 00:00:00"), ("u3", "d", "2024-01-05 00:00:00"), ("u9", "z", "2024-01-05 00:00:00")],
                                 "user_hash string, session_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    policy = lambda: stream_catalog.Policy()
    held = lambda: {(r.file_hash, r.user_hash) for r in stream_catalog.read_sources(spark, root).collect()}
    stream_catalog.write_batch(offers.filter("seq <= 2"), 0, root, policy())
    assert held() == {("f1", "u1"), ("f2", "u1"), ("f2", "u2"), ("f3", "u3")}
    gone.write.parquet(str(tmp_path / "gone"))
    stream = spark.readStream.schema(gone.schema).parquet(str(tmp_path / "gone"))
    stream_catalog.run_departures(stream, root, str(tmp_path / "cp"), once=True).awaitTermination(100)
    # Session b of u1 is not known yet: the end of a removes all of u1.
    assert held() == set()
    stream_catalog.write_batch(offers.filter("seq > 2"), 1, root, policy())
    # Now a is an older session, and its end changes nothing.
    want = {("f1", "u1"), ("f2", "u1"), ("f4", "u3")}
    for upto in (None, 0, 1):
        if upto is not None:
            stream_catalog.compact(spark, root, upto)
        assert held() == want
        assert {r.file_hash for r in stream_catalog.read_files(spark, root).collect()} == {"f1", "f2", "f4"}
        assert {r.token for r in stream_catalog.read_postings(spark, root).collect()} == {"f1", "f2", "f4", "red", "mkv"}


def test_snapshots_and_recent_keys(spark, sf, tmp_path):
    events = b.events(spark, sf).select("user_hash", "ts", "at_us", "ip")
    snaps = _replay(
        spark, tmp_path / "a", events, "at_us",
        lambda e: stream_traffic.stream_snapshots(e, ts="ts", period="1 day", lateness="1 hour"),
    )
    expected = {r["period_start"]: r["events"] for r in traffic.snapshots(events, period_seconds=b.DAY).collect()}
    got = {r["period_start"]: r["events"] for r in snaps.collect()}
    assert got and all(expected[k] == v for k, v in got.items())
    first = _replay(
        spark, tmp_path / "b", events, "at_us",
        lambda e: stream_traffic.stream_recent_keys(e, key="ip", ts="ts", ttl="60 days"),
    )
    assert _rows(first, "ip") == _rows(events.select("ip").distinct(), "ip")


def test_pieces_hold_no_key_twice_and_sources_are_read_once(spark, tmp_path):
    root = str(tmp_path / "catalog")
    rows = [(i, f"u{i % 2}", f"f{i % 3}", f"s{i % 2}") for i in range(12)]
    offers = spark.createDataFrame(rows, "seq bigint, user_hash string, file_hash string, session_id string").selectExpr(
        "*", "timestamp_seconds(seq) AS ts", "concat('name ', seq) AS name", "seq AS size", "1L AS ip", "1 AS port", "1L AS client_id", "1 AS client_port")
    stream_catalog.write_batch(offers, 0, root, Policy())
    pieces = spark.read.parquet(f"{root}/sources")
    held = set(pieces.select("first.key.*").columns) | set(pieces.select("latest.key.*").columns)
    assert held == {"ts", "seq", "name", "complete"} and pieces.select("latest.*").columns == ["key"]
    named = stream_catalog.read_named_sources(spark, root)
    apart = stream_catalog.read_sources(spark, root).join(stream_catalog.read_files(spark, root).select("file_hash", "name"), "file_hash")
    assert sorted(map(str, named.collect())) == sorted(map(str, apart.collect())) and named.count() == 6
    assert named._jdf.queryExecution().analyzed().toString().count("latest#") < apart._jdf.queryExecution().analyzed().toString().count("latest#")


def test_offers_of_a_batch_move_once(spark, tmp_path, monkeypatch):
    """They move to their file; names with a verdict come to them there, and files and sources are grouped there."""
    offers, root = spark.range(200).selectExpr(
        "timestamp '2001-01-01' as ts", "id as seq", "concat('f', id % 9) as file_hash", "concat('u', id % 4) as user_hash", "'s' as session_id",
        "1L as ip", "2 as port", "concat(if(id % 3 = 0, 'bad ', 'good '), id % 9) as name", "5L as size", "1L as client_id", "1 as client_port"
    ), str(tmp_path / "c")
    policy = Policy(hashes=spark.createDataFrame([("f1", "ban")], "file_hash string, list string"), terms=("bad",))
    made, real = [], stream_catalog.screen_repeated
    monkeypatch.setattr(stream_catalog, "screen_repeated", lambda *a, **k: made.append(real(*a, **k)) or made[-1])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stream_catalog.write_batch(offers, 0, root, policy)
        screened, allowed = made[0], made[0].filter("layer is null")
        plans = [df._jdf.queryExecution().executedPlan().toString() for df in (
            screened, stream_catalog._file_pieces(allowed), stream_catalog._source_pieces(allowed))]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # By name only the names themselves move, and pieces add no move to that of the offers and of the listed hashes.
    assert all(plan.count("Exchange hashpartitioning(name#") <= 1 for plan in plans)
    assert [plan.count("Exchange hashpartitioning(file_hash#") for plan in plans] == [2, 2, 2]
    blocked = {r.name for r in stream_catalog.read_blocks(spark, root).collect()}
    assert blocked == {"bad 0", "bad 3", "bad 6", "good 1"}


@pytest.mark.parametrize("few", [0, 400_000])
def test_narrow_rows_may_be_shaped_in_the_batch(spark, tmp_path, monkeypatch, few):
    """Numbers of files and bytes of users serve as well as hashes, whether names are few or many."""
    monkeypatch.setattr(stream_catalog, "FEW_NAMES", few)
    source, root = str(tmp_path / "in"), str(tmp_path / "c")
    rows = [(1, 7, 1, "old ring.mp3"), (2, 7, 2, "new name.mp3"), (3, 8, 1, "bad one"), (4, 9, 1, "gone.mkv")]
    spark.createDataFrame(rows, "seq bigint, file bigint, user bigint, name string").write.parquet(source)
    lines = spark.readStream.schema("seq bigint, file bigint, user bigint, name string").parquet(source)

    def shape(batch):
        return batch.selectExpr(
            "timestamp_seconds(seq) as ts", "seq", "file as file_hash", "unhex(md5(string(user))) as user_hash", "concat(user, '-s') as session_id",
            "user as ip", "1 as port", "name", "5L as size", "1L as client_id", "1 as client_port")

    policy = Policy(hashes=spark.createDataFrame([(9, "ban")], "file_hash bigint, list string"), terms=("bad",))
    stream_catalog.run_catalog(lines, root, str(tmp_path / "cp"), lambda: policy, once=True, shape=shape).awaitTermination(100)
    spark.createDataFrame([("2-s", 60), ("2-s", 60), (None, 70)], "session_id string, s bigint").selectExpr(
        "unhex(md5('2')) as user_hash", "session_id", "timestamp_seconds(s) as ts").write.parquet(f"{root}/departures/batch=0")
    got = stream_catalog.read_named_sources(spark, root).collect()
    assert [(r.file_hash, r.ip, r.name) for r in got] == [(7, 1, "old ring.mp3")]
    stream_catalog.compact(spark, root, 0)
    assert [(r.file_hash, r.ip, r.name) for r in stream_catalog.read_named_sources(spark, root).collect()] == [(7, 1, "old ring.mp3")]
