"""Small tables that pin the behaviour of single operators."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from catalogspark.functions import filetype, net, text
from catalogspark.functions.ordered import MICROS
from catalogspark.operators import aliases, catalog, clients, enforce, index, lookup, screen, search
from catalogspark.operators.screen import Policy, Quantity, Rule, Words

T0 = datetime(2024, 1, 1)
OFFER = "ts timestamp, seq bigint, user_hash string, file_hash string, name string, size bigint, complete boolean, ip bigint, port int"


def _offers(spark, rows):
    """(minute, user, file, name, size) -> offers."""
    data = [(T0 + timedelta(minutes=m), i, u, f, n, s, True, i, 4662) for i, (m, u, f, n, s) in enumerate(rows)]
    return spark.createDataFrame(data, OFFER)


def _one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column.alias("x")).head()["x"]


@pytest.mark.parametrize("name,expected", [
    ("Linux_Mint-22.iso", ["linux", "mint", "22", "iso"]),
    ("The web & a HD film", ["hd", "film"]),
    ("12:30 x", ["12:30"]),
    ("漢 é b", ["漢", "é"]),
    ("red red　rod", ["red", "rod"]),
])
def test_tokens(spark, name, expected):
    assert _one(spark, name, text.tokens(F.col("v"))) == expected


@pytest.mark.parametrize("term,expected", [
    ("linux ubuntu", ["linux", "ubuntu"]), ("*", ["*"]), (" ** ", ["**"]), ("the", ["the"]), ("X", ["x"]), ("  ", []),
])
def test_term_tokens(spark, term, expected):
    assert search.term_tokens(term) == expected
    assert _one(spark, term, text.search_term_tokens(F.col("v"))) == expected


def test_token_hash(spark):
    assert _one(spark, "", text.fnv1a32(F.col("v"))) == 0x811C9DC5
    assert _one(spark, "a", text.fnv1a32(F.col("v"))) == 0xE40C292C


def test_positive_terms():
    tree = {"not": [{"and": [{"term": "a"}, {"type": "video"}]}, {"not": [{"term": "b"}, {"term": "c"}]}]}
    assert search.positive_terms(tree) == ["a", "c"]


def test_search(spark):
    offers = _offers(spark, [
        (0, "u1", "f1", "Linux Mint Cinnamon.iso", 2000), (1, "u1", "f2", "Linux Debian Server.iso", 3000),
        (2, "u2", "f3", "Windows 11 Pro.iso", 4000), (3, "u2", "f4", "linuxmint notes.pdf", 10),
    ])
    files, sources = catalog.files(offers), catalog.sources(offers)
    posts = index.postings(files)

    def run(tree, **options):
        return [r["file_hash"] for r in search.search(files, posts, sources, tree, **options).collect()]

    assert run({"and": [{"term": "linux"}, {"term": "mint"}]}) == ["f1"]
    assert run({"term": "mint linux"}) == ["f1"]
    assert run({"term": "linux"}, match="substring") == ["f1", "f2", "f4"]
    assert run({"or": [{"term": "mint"}, {"term": "windows"}]}) == ["f1", "f3"]
    assert run({"or": [{"term": "mint"}, {"term": "windows"}]}, compat=True) == []
    assert run({"not": [{"type": "iso"}, {"num": "size", "op": ">", "value": 2500}]}) == ["f1"]
    assert run({"not": [{"term": "linux"}, {"num": "unknown", "op": ">", "value": 5}]}) == []
    assert run({"term": "*"}, short=True) == []
    assert run({"term": "*"}, cap=2) == ["f1", "f2"]
    hidden = spark.createDataFrame([("f1",)], "file_hash string")
    assert run({"term": "linux"}, withheld=hidden) == ["f2"]
    queries = spark.createDataFrame([(1, ["iso", "linux"]), (2, ["windows"]), (3, ["linux", "iso"]), (4, ["none"])],
                                    "query_id int, tokens array<string>")
    got = search.batch_search(files, posts, queries).collect()
    assert sorted((r["query_id"], r["rank"], r["file_hash"]) for r in got) == [
        (1, 1, "f1"), (1, 2, "f2"), (2, 1, "f3"), (3, 1, "f1"), (3, 2, "f2")]


def test_type_classes(spark):
    for name, expected in [("a.MP3", 1), ("noext", 0), ("x.bin", 4), ("x.iso", 7), ("p.emulecollection", 8), ("t.tar.gz", 6)]:
        assert _one(spark, name, filetype.type_id(F.lower("v"))) == expected
    assert _one(spark, "x.bin", filetype.has_type(F.lower("v"), "Iso"))
    assert _one(spark, "plain", filetype.has_type(F.lower("v"), "unheard")) is False


def test_first_name_wins_and_cascade(spark):
    offers = _offers(spark, [
        (0, "u1", "f1", "first", 5), (9, "u2", "f1", "second", 6), (3, "u1", "f2", "alone", 7), (4, "u1", "f1", "third", 5),
    ])
    files, sources = catalog.files(offers), catalog.sources(offers)
    row = files.filter("file_hash = 'f1'").head()
    assert (row["name"], row["size"], row["last_seen"]) == ("first", 5, T0 + timedelta(minutes=9))
    left, kept = catalog.remove_users(files, sources, spark.createDataFrame([("u1",)], "user_hash string"))
    assert [r["file_hash"] for r in left.collect()] == ["f1"] and kept.count() == 1


def test_old_session_end_keeps_user(spark):
    sessions = spark.createDataFrame([("u", "s1", 1), ("u", "s2", 2)], "user_hash string, session_id string, login_ts int")
    end = lambda s: spark.createDataFrame([("u", s)], "user_hash string, session_id string")
    assert catalog.effective_departures(sessions, end("s1")).count() == 0
    assert catalog.effective_departures(sessions, end("s2")).count() == 1


def test_low_id_source(spark):
    sources = catalog.sources(_offers(spark, [(0, "low", "f", "n", 1), (1, "high", "f", "n", 1), (2, "gone", "f", "n", 1)]))
    people = spark.createDataFrame([("low", 77, False), ("high", 5, True)], "user_hash string, assigned_id bigint, is_high_id boolean")
    got = {r["user_hash"]: r["endpoint_id"] for r in lookup.endpoints(sources, people).collect()}
    assert got == {"low": 77, "high": 1 << 24, "gone": 2 << 24}
    asks = spark.createDataFrame([(1, "low", "f"), (2, "x", "f"), (3, "x", "none")], "request_id int, requester string, file_hash string")
    replies = {r["request_id"]: [s["user_hash"] for s in r["sources"]] for r in lookup.sources_for(asks, sources, people, cap=2).collect()}
    assert replies == {1: ["high", "gone"], 2: ["low", "high"], 3: []}


@pytest.mark.parametrize("name,terms,expected", [
    ("a longmarkers b", ["longmarker"], "longmarker"), ("xlongmarker", ["longmarker"], None),
    ("1longmarker", ["longmarker"], "longmarker"), ("shrt_1", ["shrt"], "shrt"), ("shrtx", ["shrt"], None),
    ("longmarkers", ["longmarker$"], None), ("longmarker-2", ["longmarker$"], "longmarker$"),
    ("a shrt longmarker", ["longmarker", "shrt"], "longmarker"), ("9漢字x", ["漢字"], "漢字"),
    ("c++ notes", ["c++"], "c++"), ("plain", [], None),
])
def test_terms(spark, name, terms, expected):
    assert _one(spark, name, text.first_matching_term(F.lower("v"), terms)) == expected


def test_double_encoding(spark):
    broken = "café 漢".encode().decode("latin-1")
    twice = broken.encode().decode("latin-1")
    for value, expected in [(broken, "café 漢"), (twice, "café 漢"), ("plain", None), ("café", None), ("漢", None)]:
        assert _one(spark, value, text.repair_double_encoding(F.col("v"))) == expected


RULE = Rule(
    evidence=Words(prefix=("new",)), context=Words(bounded=("cold",)), exceptions=("cold anvil",),
    quantity=Quantity(1, 20, compact=("kg",), spelled=("kilos",), attached="k", veto_after=("cup",), veto_before=("after",), veto_near=("jubilee",)),
    standalone_max=10, guards=("box",), guard_window=12, pair_letters="bg", level_caps=(("grade", 6),),
)


@pytest.mark.parametrize("name,expected", [
    ("cold newest", "word"), ("newest", None), ("cold anvil new", None), ("cold 12 kg", "quantity 12 kg"),
    ("cold 123kg 7kg", "quantity 7kg"), ("cold 25kg", None), ("12 kg", None), ("9kg x", "quantity 9kg alone"),
    ("box 9kg", None), ("box 9kg and far away there is 8kg", "quantity 8kg alone"), ("cold 15k", "quantity 15k"),
    ("cold 15 k x", None), ("cold 12 kilos cup", None), ("cold after 12 kilos", None), ("cold jubilee 12 kilos", None),
    ("cold 12 kilos", "quantity 12 kilos"), ("cold b12 g13", "pair"), ("cold b12", None), ("cold grade 7", None), ("cold grade 6", "level"),
])
def test_rule(spark, name, expected):
    assert _one(spark, name, screen.rule_reason(F.lower("v"), RULE)) == expected


def test_screen_order(spark):
    hashes = spark.createDataFrame(
        [("h1", "allow"), ("h1", "ban"), ("h2", "ban"), ("h2", "poison"), ("h3", "poison")], "file_hash string, list string")
    policy = Policy(hashes=hashes, terms=("marker",), extra_terms=("extra",), rule=RULE)
    mangled = "漢 marker".encode().decode("latin-1")
    rows = spark.createDataFrame(
        [("h1", "marker"), ("h2", "x"), ("h3", "marker"), ("h4", "extra marker"), ("h5", "cold new extra"), ("h6", "extra"),
         ("h7", mangled), ("h8", "fine")], "file_hash string, name string")
    expected = {"h1": (None, None), "h2": ("L3", "hash"), "h3": ("L5", "poison"), "h4": ("L1", "marker"), "h5": ("L2", "word"),
                "h6": ("L4", "extra"), "h7": ("L1", "marker (mojibake)"), "h8": (None, None)}
    for form in (screen.screen, screen.screen_repeated):
        assert {r["file_hash"]: (r["layer"], r["reason"]) for r in form(rows, policy).collect()} == expected
    with pytest.raises(ValueError):
        screen.require_ready(Policy(public=True))
    screen.require_ready(Policy(public=True, hashes=hashes))


def _caught(spark, rows):
    """(hours, file) of one user -> catches."""
    data = [(T0 + timedelta(hours=h), i, "u", f, f"n{f}", True, "L1", "r", 1, 9, int(h * 3600 * MICROS)) for i, (h, f) in enumerate(rows)]
    return spark.createDataFrame(
        data, "ts timestamp, seq bigint, user_hash string, file_hash string, name string, complete boolean, "
              "layer string, reason string, size bigint, ip bigint, caught_us bigint")


def _bans(spark, rows, window_h=24, retention_h=100):
    ledger = enforce.ledger(_caught(spark, rows), retention_seconds=retention_h * 3600)
    return enforce.publisher_bans(ledger, window_seconds=window_h * 3600, threshold=3).collect()


def test_ban_threshold(spark):
    assert _bans(spark, [(0, "a"), (1, "b"), (2, "c")]) == []
    assert _bans(spark, [(i, "a") for i in range(9)]) == []
    (ban,) = _bans(spark, [(0, "a"), (1, "b"), (2, "c"), (3, "d")])
    assert ban["banned_us"] == 3 * 3600 * MICROS
    assert _bans(spark, [(0, "a"), (30, "b"), (60, "c"), (90, "d")]) == []
    assert len(_bans(spark, [(0, "a"), (30, "b"), (60, "c"), (90, "d")], window_h=100)) == 1
    assert _bans(spark, [(0, "a"), (1, "b"), (2, "c"), (200, "d")], window_h=300) == []


def test_ban_renewal_and_expiry(spark):
    rows = [(0, "a"), (1, "b"), (2, "c"), (3, "d"), (10, "a")]
    caught = _caught(spark, rows)
    ledger = enforce.ledger(caught, retention_seconds=360_000)
    marks = enforce.repeat_catch_bans(caught, ledger, window_seconds=86_400, threshold=3, retention_seconds=360_000)
    assert sorted(r["caught_us"] // (3600 * MICROS) for r in marks.collect()) == [3, 10]
    logins = spark.createDataFrame(
        [("u", int(h * 3600 * MICROS), i) for i, h in enumerate([2, 3, 7.9, 12, 14])], "user_hash string, login_us bigint, event_id bigint")
    got = {r["event_id"]: r["refused"] for r in enforce.refused_logins(logins, marks, ttl_seconds=4 * 3600).collect()}
    assert got == {0: False, 1: True, 2: False, 3: True, 4: False}


def test_aliases(spark):
    big = 50 * 1024 * 1024
    offers = _offers(spark, [
        (0, "u1", "f", "American Beauty.mkv", big), (1, "u2", "f", "Beauty renamed", big), (2, "u3", "f", "Photo manual", big),
        (3, "u4", "f", "Beauty again", big), (4, "u5", "f", "American Beauty.mkv", big), (5, "u6", "f", "Photo manual", big),
        (0, "u1", "g", "small one", 10), (1, "u2", "g", "other thing", 10),
    ])
    (row,) = aliases.alias_records(offers).collect()
    assert row["names"] == ["American Beauty.mkv", "Photo manual", "Beauty again"] and row["seen"] == 3
    frame = spark.createDataFrame([(row["names"],)], "names array<string>")
    assert frame.select(aliases.unrelated_names(F.col("names")).alias("n")).head()["n"] == 1


def test_id_index(spark):
    schema = "assigned_id bigint, user_hash string, at_us bigint"
    assigned = spark.createDataFrame([(7, "a", 1), (7, "b", 2), (0, "z", 3), (8, "a", 5)], schema)
    removed = spark.createDataFrame([(7, "a", 9), (8, "a", 6)], schema)
    got = [(r["assigned_id"], r["user_hash"]) for r in clients.id_index(assigned, removed).collect()]
    assert got == [(7, "b")]


def test_fresh_value(spark):
    probes = spark.createDataFrame([("u", h * 3600 * MICROS, h, 1) for h in (1, 2, 5, 50)],
                                   "user_hash string, at_us bigint, probe_id bigint, announced bigint")
    seen = spark.createDataFrame([("u", 2 * 3600 * MICROS, 9), ("u", 4 * 3600 * MICROS, 0)], "user_hash string, at_us bigint, value bigint")
    got = {r["probe_id"]: r["effective"] for r in clients.fresh_value(probes, seen, tolerance_seconds=3 * 3600).collect()}
    assert got == {1: 1, 2: 9, 5: 1, 50: 1}


def test_addresses(spark):
    for value, expected in [("001.002.003.004", 0x01020304), ("1.2.3", None), ("1.2.3.256", None), ("a.b.c.d", None), ("1.2.3.99999999999", None)]:
        assert _one(spark, value, net.ip_from_text(F.col("v"))) == expected
    for value, ok in [("10.1.1.1", False), ("172.31.0.1", False), ("172.32.0.1", True), ("192.168.1.1", False),
                      ("127.0.0.1", False), ("169.254.1.1", False), ("8.8.8.8", True), ("255.255.255.255", False), ("0.0.0.0", False)]:
        assert _one(spark, value, net.is_routable(net.ip_from_text(F.col("v")))) == ok
    assert _one(spark, "1.2.3.4", net.endpoint_id(net.ip_from_text(F.col("v")))) == 0x04030201


def test_truncated_batch(spark):
    rows = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "batch_id int, seq int, bans boolean")
    got = sorted((r["batch_id"], r["seq"]) for r in enforce.truncate_batches(rows).collect())
    assert got == [(1, 1), (1, 2), (2, 1)]
