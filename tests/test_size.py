"""Rows move as often as a step needs, and ties are settled."""

import contextlib
import re

import __spark_entry__ as contract
from pyspark.sql import functions as F

from catalogspark.operators import catalog, enforce, reports
from catalogspark.plans import bindings as b
from catalogspark.plans.alias_queries import alias_records, blocks_by_file


@contextlib.contextmanager
def _shuffled_joins(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\), ENSURE_REQUIREMENTS", plan)


def test_offers_stay_with_their_file(spark, sf):
    with _shuffled_joins(spark):
        moved = _exchanges(catalog.sources(b.offers(spark, sf)))
    assert len(moved) == 2 and all("partkey" in m for m in moved)


def test_only_narrow_rows_meet_verdicts(spark, sf):
    with _shuffled_joins(spark):
        moved = _exchanges(b.screened_offers(spark, sf))
    assert sum("l_partkey" in m for m in moved) == 1
    assert not any("l_suppkey" in m or "session_id" in m for m in moved)


def test_catches_move_to_their_user_once(spark):
    schema = "user_hash string, file_hash string, ts timestamp, caught_us bigint, seq bigint, name string, complete boolean, layer string, reason string, size bigint, ip bigint"
    caught = spark.createDataFrame([], schema)
    with _shuffled_joins(spark):
        counted = enforce.window_counts(enforce.ledger(caught, retention_seconds=100), window_seconds=10)
        moved = _exchanges(counted)
    # Once for the slots of the runs, once the catches themselves.
    assert len(moved) <= 4 and not any("file_hash" in m or "chunk" in m for m in moved)


def test_batches_are_cut_by_banning_records_alone(spark):
    rows = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 1)], "batch_id bigint, seq bigint")
    banning = spark.createDataFrame([(1, 2), (1, 3)], "batch_id bigint, seq bigint")
    got = sorted(tuple(r) for r in enforce.truncate_batches(rows, banning).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]


def test_report_by_file_shuffles_catches_once(spark):
    schema = "user_hash string, file_hash string, name string, caught_us bigint, layer string, reason string, size bigint"
    caught = spark.createDataFrame([("u", "f", f"name {i}", i, "L1", "r", 1) for i in range(20)], schema)
    with _shuffled_joins(spark):
        report = reports.blocks_by_file(caught)
        report.collect()
        plan = report._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    made = [line for line in plan.splitlines() if re.search(r"\bExchange hashpartitioning\(file_hash#\d+, name#\d+", line)]
    assert len([line for line in made if "ReusedExchange" not in line]) == 1


def test_tables_by_file_are_not_sorted_before_they_move(spark, sf):
    """Small parts are not broadcast: offers, widened and sorted in whole input splits, may spill before their shuffle."""
    for kept in (b.files, b.sources, alias_records):
        moved = _exchanges(kept(spark, sf))
        assert any("l_partkey" in m for m in moved)
        assert not any("user_hash" in m or "name" in m for m in moved)


def test_report_by_file_reads_kept_names(spark, sf):
    """Exchanges over the kept ledger were seen not to be reused, so the names are kept, and the ledger is grouped once."""
    report = blocks_by_file(spark, sf)
    plan = report._jdf.queryExecution().executedPlan().toString()
    # The names' own plan is printed where they are read.
    reads = plan.count("InMemoryTableScan [file_hash")
    assert reads >= 3 and plan.count("InMemoryRelation [file_hash#") >= 3
    assert any(key[1:3] == (sf, "caught_names") for key in b._KNOWN)
    again = reports.blocks_by_file(b.ledger(spark, sf))
    assert sorted(map(str, report.collect())) == sorted(map(str, again.collect()))


def test_runs_of_catches_are_made_once(spark, sf):
    """Ledger and ban marks read the kept runs: catches move for themselves, not for the runs again."""
    for kept in (b.ledger, b.ban_marks):
        plan = kept(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "starts#" in plan
    assert any(key[1:3] == (sf, "catch_runs") for key in b._KNOWN)


def test_catches_are_not_sorted_to_meet_verdicts_or_users(spark, sf):
    """Joins of lineitems with verdicts, and of catches with their user, hash the smaller side: no sort that may spill."""
    with _shuffled_joins(spark):
        joined = b.screened_offers(spark, sf)._jdf.queryExecution().executedPlan().toString()
        schema = "user_hash string, caught_us bigint"
        caught, runs = spark.createDataFrame([], schema), spark.createDataFrame([], "user_hash string, starts array<bigint>")
        epochs = enforce._with_epochs(caught, 100, runs, "user_hash", "caught_us")._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_partkey" in joined and "Sort [l_partkey" not in joined
    assert "ShuffledHashJoin [user_hash" in epochs and "Sort [" not in epochs


def test_catalog_shuffles_start_with_enough_pieces(spark, sf):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.conf.unset(key)
    try:
        contract.queries()["h1_review_window"](spark, sf)
        assert int(spark.conf.get(key)) >= 200
        spark.conf.set(key, "5")
        contract.queries()["h1_review_window"](spark, sf)
        assert spark.conf.get(key) == "5"
    finally:
        spark.conf.unset(key)


def test_logins_of_users_without_marks_are_not_put_in_line(spark):
    logins = spark.createDataFrame([("a", 10, 1), ("a", 30, 2), ("b", 30, 3), (None, 30, 4)], "user_hash string, login_us bigint, event_id bigint")
    marks = spark.createDataFrame([("a", 20), (None, 20)], "user_hash string, caught_us bigint")
    got = enforce.refused_logins(logins, marks, ttl_seconds=1)
    assert sorted((r.event_id, r.since_us, r.refused) for r in got.collect()) == [(1, None, False), (2, 20, True), (3, None, False), (4, None, False)]
    assert "LeftAnti" in got._jdf.queryExecution().optimizedPlan().toString()


def test_publisher_reports_move_and_keep_numbers(spark, sf):
    """What only counts and matches users and files keeps neither hashes nor names of catches and sources."""
    for name in ("h4_publisher_graph", "h4_published_files"):
        plan = contract.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        kept = re.findall(r"InMemoryRelation \[(.*?)\]", plan)
        assert kept and not any("reason#" in k or "ip#" in k for k in kept)
        hashed = [line for line in plan.splitlines() if re.search(r"Exchange hashpartitioning\(user_hash", line)]
        assert hashed
    number = b.user_id("user_hash").alias("user_hash"), b.file_id("file_hash").alias("file_hash")
    narrow = b.numbered_ledger(spark, sf).select(number[0], "epoch", number[1], "caught_us")
    wide = b.ledger(spark, sf).select(*narrow.columns)
    assert narrow.count() == wide.count() and not narrow.exceptAll(wide).head(1)
    pairs = b.numbered_sources(spark, sf).select(*number)
    assert pairs.count() == b.sources(spark, sf).count() and not pairs.exceptAll(b.sources(spark, sf).select(*pairs.columns)).head(1)


def test_published_files_come_in_the_order_given(spark):
    graph = spark.createDataFrame([(1,)], "user_hash bigint")
    sources = spark.createDataFrame([(f, u) for f in (1, 2, 3) for u in (1, 2)], "file_hash bigint, user_hash bigint")
    files = spark.createDataFrame([(f, f"n{f}", f) for f in (1, 2, 3)], "file_hash bigint, name string, size bigint")
    caught = spark.createDataFrame([(1, 3), (2, 2)], "user_hash bigint, file_hash bigint")
    got = reports.published_detail(graph, caught, files, sources, max_files=2, file_order=-F.col("file_hash")).collect()
    assert sorted((r["rank"], r["name"], r["sources"], r["flagged"]) for r in got) == [(1, "n3", 2, True), (2, "n2", 2, False)]
