"""Readers with good and bad lines, sinks, the policy store, the generator."""

import pytest
from pyspark.sql import functions as F

from catalogspark.operators import catalog, index
from catalogspark.operators.screen import Policy
from catalogspark.plans import bindings as b
from catalogspark.plans.alias_queries import blocks_by_file
from catalogspark.sources import lists, offers, policy_store, sinks


def _file(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_ip_ranges(spark, tmp_path):
    path = _file(tmp_path, "r.txt", "# note\n001.000.000.000 - 001.000.000.255 , 000 , a , b\n\nbroken\n2.0.0.0 - 2.0.0.1\n")
    rows = {r["range_start"]: r for r in lists.parse_ip_ranges(lists.read_lines(spark, path)).collect()}
    assert rows[1 << 24]["range_end"] == (1 << 24) + 255 and rows[1 << 24]["description"] == "a , b"
    assert rows[2 << 24]["ok"] and rows[2 << 24]["level"] is None
    assert rows[None]["value"] == "broken" and not rows[None]["ok"]


def test_countries(spark, tmp_path):
    path = _file(tmp_path, "c.csv", "16777216,16777471,au,Australia\n1,2,AUS,Other, name\nx,2,DE,G\n5,6,D,short\n7,8,DE,Germany, East\n")
    ranges, names = lists.parse_country_ranges(lists.read_lines(spark, path))
    assert sorted(r["code"] for r in ranges.collect()) == ["AU", "AU", "DE"]
    assert {r["code"]: r["name"] for r in names.collect()} == {"AU": "Australia", "DE": "Germany, East"}


def test_hashes_and_terms(spark, tmp_path):
    good = "AB" * 16
    path = _file(tmp_path, "h.txt", f"# c\n{good} ; name; more\nabcd\n  \nzz{good[2:]}\n")
    rows = lists.parse_hash_list(lists.read_lines(spark, path)).collect()
    assert [r["file_hash"] for r in rows if r["ok"]] == [good.lower()] and sum(not r["ok"] for r in rows) == 2
    path = _file(tmp_path, "t.txt", "  Beta \n#x\n\nalpha\n")
    terms = lists.parse_terms(lists.read_lines(spark, path)).orderBy("line_no").collect()
    assert [r["term"] for r in terms] == ["beta", "alpha"]


def test_rules(spark, tmp_path):
    known = dict(known_sections={"one", "two", "three"}, known_limits={"window"})
    read = lambda text: lists.parse_rules(lists.read_lines(spark, _file(tmp_path, "x.txt", text)), **known)
    entries, errors = read("; c\n[One]\nWord ; note\n# c\n[two]\n[limits]\nwindow = 9\n")
    lists.require_valid(entries, errors)
    defaults = spark.createDataFrame([("one", "old"), ("two", "gone"), ("three", "kept")], "section string, entry string")
    got = sorted(tuple(r) for r in lists.with_defaults(entries, defaults).collect())
    assert got == [("limits", "window=9"), ("one", "word"), ("three", "kept")]
    for bad in ("[four]\nx\n", "x\n[one]\n", "[limits]\nwindow\n", "[limits]\nother = 1\n", "[limits]\nwindow = x\n", "# only\n"):
        with pytest.raises(ValueError):
            lists.require_valid(*read(bad))


def test_review_csv_round_trip(spark, sf, tmp_path):
    by_file = blocks_by_file(spark, sf)
    sinks.write_review_csv(by_file, str(tmp_path / "csv"))
    back = sinks.read_review_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, sinks.review_csv_rows(by_file).collect()))
    sinks.write_report(by_file.select("file_hash", "name"), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == by_file.count()


def test_review_window_moves_only_after_export(spark, sf, tmp_path):
    ledger = b.ledger(spark, sf)
    now = ledger.agg(F.max("caught_us")).head()[0]
    mark = str(tmp_path / "mark")
    run = lambda n, **o: sinks.export_review(ledger, out=str(tmp_path / f"o{n}"), watermark=mark, now_us=now + 1, **o).count()
    everything = run(0, everything=True, peek=True)
    assert sinks.last_watermark(spark, mark) is None
    first = run(1)
    assert 0 < first < everything and sinks.last_watermark(spark, mark) == now + 1
    assert run(2) == 0 and run(3, hours=24) == first


def test_policy_store(spark, tmp_path):
    root = str(tmp_path / "policy")
    hashes = spark.createDataFrame([("h", "ban")], "file_hash string, list string")
    in_use = Policy(terms=("kept",))
    assert policy_store.refresh(spark, root, in_use) is in_use
    policy_store.publish(spark, root, 1, hashes=hashes, terms=("b", "a"), extra_terms=("x",))
    first = policy_store.refresh(spark, root, in_use)
    assert first.terms == ("b", "a") and first.extra_terms == ("x",) and first.hashes.count() == 1
    policy_store.publish(spark, root, 2, hashes=hashes.limit(0))
    second = policy_store.refresh(spark, root, first)
    assert second.terms == () and second.hashes.count() == 0


def test_generator_shape(spark):
    rows = catalog.with_complete(offers.generate_offers(spark, 2000, users=10))
    files = catalog.files(rows)
    assert files.count() == 2000 and files.select("name").distinct().count() <= 1400
    assert catalog.sources(rows).select("user_hash").distinct().count() == 10
    per_file = index.postings(files).count() / 2000
    assert 7 < per_file <= 8
    assert offers.accept_offers(rows).count() == 2000
    assert offers.accept_offers(rows, max_batch_records=100).count() == 0


def test_bucketed_tables_join_without_shuffle(spark, sf):
    catalog.write_bucketed(b.files(spark, sf), "kept_files", key="file_hash", buckets=4)
    catalog.write_bucketed(b.sources(spark, sf), "kept_sources", key="file_hash", buckets=4)
    index.write_postings(b.postings(spark, sf), "kept_postings", buckets=4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counted = catalog.source_counts(spark.table("kept_sources")).join(spark.table("kept_files"), "file_hash")
        lengths = index.token_counts(spark.table("kept_postings"))
        for df in (counted, lengths):
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert counted.count() == b.files(spark, sf).count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for table in ("kept_files", "kept_sources", "kept_postings"):
            spark.sql(f"DROP TABLE {table}")
