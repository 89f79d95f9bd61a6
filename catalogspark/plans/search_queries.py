"""Tokens, index, search and source lookup."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogspark.functions import filetype, text
from catalogspark.functions.ordered import first_per_key
from catalogspark.operators import index, lookup, search, trees
from catalogspark.operators.screen import hash_only_verdict
from catalogspark.plans import bindings as b
from catalogspark.plans.registry import query, view


@query("c1_name_tokens", f"""
SELECT DISTINCT name, array_to_string(list_sort({b.sql_tokens('name')}), '|') AS tokens FROM v_offers""")
def c1(spark, sf):
    return b.offers(spark, sf).select("name").distinct().select(
        "name", F.array_join(F.array_sort(text.tokens(F.col("name"))), "|").alias("tokens")
    )


@query("c1_document_tokens", f"""
SELECT doc_id, len(t) AS tokens, md5(array_to_string(t, '|')) AS digest
FROM (SELECT doc_id, list_sort({b.sql_tokens('text')}) AS t FROM documents)""")
def c1_documents(spark, sf):
    words = F.array_sort(text.tokens(F.col("text")))
    return b.table(spark, sf, "documents").select("doc_id", words.alias("t")).select(
        "doc_id", F.size("t").cast("bigint").alias("tokens"), F.md5(F.array_join("t", "|")).alias("digest")
    )


view("v_terms", """
SELECT DISTINCT term FROM (SELECT p_name AS term FROM part UNION ALL SELECT p_brand FROM part
  UNION ALL SELECT concat(' ', o_orderpriority) FROM orders UNION ALL SELECT l_returnflag FROM lineitem
  UNION ALL SELECT '*' FROM region UNION ALL SELECT ' The ' FROM region UNION ALL SELECT '  ' FROM region
  UNION ALL SELECT replace(n_name, 'NATION', '-') FROM nation)""")


@query("c2_term_tokens", f"""
SELECT term, array_to_string(CASE WHEN trim(term) IN ('*', '**') THEN [trim(term)]
  WHEN len({b.sql_tokens('term')}) > 0 THEN list_sort({b.sql_tokens('term')})
  WHEN trim(term) = '' THEN [] ELSE [lower(trim(term))] END, '|') AS keys FROM v_terms""")
def c2(spark, sf):
    part, region = b.table(spark, sf, "part"), b.table(spark, sf, "region")
    terms = part.select(F.col("p_name").alias("term"))
    for more in (
        part.select("p_brand"),
        b.table(spark, sf, "orders").select(F.concat(F.lit(" "), "o_orderpriority")),
        b.table(spark, sf, "lineitem").select("l_returnflag"),
        region.select(F.lit("*")), region.select(F.lit(" The ")), region.select(F.lit("  ")),
        b.table(spark, sf, "nation").select(F.replace(F.col("n_name"), F.lit("NATION"), F.lit("-"))),
    ):
        terms = terms.union(more)
    return terms.distinct().select(
        "term", F.array_join(F.array_sort(text.search_term_tokens(F.col("term"))), "|").alias("keys")
    )


@query("c3_postings", "SELECT token, file_hash FROM v_postings")
def c3(spark, sf):
    return b.postings(spark, sf)


view("v_doc_postings", f"SELECT unnest({b.sql_tokens('text')}) AS token, doc_id FROM documents")


@query("c3_document_postings", """
SELECT token, count(*) AS documents, min(doc_id) AS first_doc, max(doc_id) AS last_doc
FROM v_doc_postings GROUP BY token""")
def c3_documents(spark, sf):
    rows = index.postings(b.table(spark, sf, "documents"), id_col="doc_id", text_col="text")
    return rows.groupBy("token").agg(
        F.count("*").alias("documents"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")
    )


view("v_changes", f"""
SELECT unnest({b.sql_tokens('name')}) AS token, file_hash, CASE WHEN complete THEN 'add' ELSE 'remove' END AS op,
  at_us, seq FROM v_offers""")
view("v_last_changes", """
SELECT token, file_hash, arg_max(op, (at_us, seq, op)) AS op FROM v_changes GROUP BY token, file_hash""")


@query("c4_index_delta", """
SELECT token, file_hash FROM (SELECT token, file_hash, max(op) AS op FROM (
  SELECT token, file_hash, op FROM v_last_changes UNION ALL SELECT token, file_hash, '' FROM v_postings) GROUP BY token, file_hash)
WHERE op <> 'remove'""")
def c4(spark, sf):
    offers = b.offers(spark, sf)
    changes = offers.select(
        F.explode(text.tokens(F.col("name"))).alias("token"), "file_hash",
        F.when(F.col("complete"), "add").otherwise("remove").alias("op"), "ts", "seq",
    )
    return index.apply_delta(b.postings(spark, sf), changes)


@query("c5_index_stats", """
SELECT count(*) AS keywords, CAST(sum(n) AS BIGINT) AS postings, max(n) AS longest, min(n) AS shortest
FROM (SELECT count(*) AS n FROM v_postings GROUP BY token)""")
def c5(spark, sf):
    return index.index_stats(b.postings(spark, sf))


@query("c5_token_counts", "SELECT token, count(*) AS postings FROM v_postings GROUP BY token")
def c5_counts(spark, sf):
    return index.token_counts(b.postings(spark, sf))


view("v_offer_tokens", f"SELECT DISTINCT year(ts) AS batch, unnest({b.sql_tokens('name')}) AS token FROM v_offers")


@query("c5_sketched_keywords", """
SELECT batch, count(DISTINCT token) AS keywords, true AS within FROM v_offer_tokens GROUP BY batch
UNION ALL SELECT NULL, count(DISTINCT token), true FROM v_offer_tokens""")
def c5_sketches(spark, sf):
    """Tokens of a year's offers as one sketch; exact counts, and whether estimates lie within three deviations."""
    tokens = b.offers(spark, sf).select(F.year("ts").cast("bigint").alias("batch"), F.explode(text.tokens(F.col("name"))).alias("token"))
    sketches = index.keyword_sketches(tokens, "batch")
    none = F.lit(None).cast("bigint")
    guessed = index.united_keywords(sketches, "batch").unionByName(index.united_keywords(sketches).withColumn("batch", none))
    exact = tokens.groupBy("batch").agg(F.count_distinct("token").alias("exact"))
    exact = exact.unionByName(tokens.agg(F.count_distinct("token").alias("exact")).withColumn("batch", none))
    both = guessed.join(exact, guessed["batch"].eqNullSafe(exact["batch"])).drop(guessed["batch"])
    deviation = F.col("exact") / 2 ** (index.LOG_REGISTERS / 2)
    return both.select("batch", F.col("exact").alias("keywords"), (F.abs(F.col("keywords") - F.col("exact")) <= 3 * deviation).alias("within"))


@query("c6_token_hash", """
SELECT token, list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(0, strlen(token)),
    lambda i: CAST(concat('0x', substr(hex(encode(token)), CAST(2 * i + 1 AS INTEGER), 2)) AS BIGINT))),
  lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS token_hash
FROM (SELECT DISTINCT token FROM v_doc_postings)""")
def c6(spark, sf):
    rows = index.postings(b.table(spark, sf, "documents"), id_col="doc_id", text_col="text")
    return rows.select("token").distinct().select("token", text.fnv1a32(F.col("token")).alias("token_hash"))


@query("c7_all_tokens", """
SELECT file_hash FROM v_postings WHERE token IN ('new', 'bolt') GROUP BY file_hash HAVING count(*) = 2""")
def c7(spark, sf):
    return index.having_all(b.postings(spark, sf), ["new", "bolt"])


def _tree_query(name, tree, condition):
    """The predicate alone over every file."""

    @query(name, f"SELECT file_hash, name, size FROM (SELECT *, lower(name) AS n FROM v_files) WHERE {condition}")
    def run(spark, sf):
        rows = b.files(spark, sf).select("file_hash", "name", "size")
        return rows.filter(search.predicate(tree, F.lower("name"), F.col("size")))


_tree_query(
    "c8_boolean_tree",
    {"not": [{"or": [{"and": [{"term": "new"}, {"term": "gear"}]}, {"term": "small ring"}]},
             {"num": "size", "op": "<", "value": 5_000_000}]},
    "((contains(n, 'new') AND contains(n, 'gear')) OR (contains(n, 'small') AND contains(n, 'ring'))) "
    "AND NOT size < 5000000",
)
_tree_query("c9_term_words", {"term": "ROD red"}, "contains(n, 'rod') AND contains(n, 'red')")
_tree_query(
    "c10_numeric",
    {"and": [{"and": [{"num": "FileSize", "op": ">=", "value": 10_000_000}, {"num": "size", "op": "!=", "value": 65536}]},
             {"num": "bitrate", "op": ">", "value": 320}]},
    "size >= 10000000 AND size <> 65536",
)
_tree_query(
    "c11_type",
    {"or": [{"type": "Image"}, {"and": [{"type": "iso"}, {"type": "unheard"}]}]},
    "regexp_matches(n, '[.]jpg$') OR regexp_matches(n, '[.]bin$')",
)
_tree_query("c12_format", {"format": "MKV"}, "regexp_extract(n, '[^.]*$') = 'mkv'")
_tree_query("c13_other_meta", {"meta": "Anvil"}, "contains(n, 'anvil')")


@query("c14_type_id", """
SELECT name, CASE regexp_extract(n, '[.]([^.]*)$', 1) WHEN 'mp3' THEN 1 WHEN 'mkv' THEN 2 WHEN 'jpg' THEN 3
  WHEN 'exe' THEN 4 WHEN 'bin' THEN 4 WHEN 'pdf' THEN 5 WHEN 'zip' THEN 6 ELSE 0 END AS type_id
FROM (SELECT DISTINCT name, lower(name) AS n FROM v_offers)""")
def c14(spark, sf):
    return b.offers(spark, sf).select("name").distinct().withColumn("type_id", filetype.type_id(F.lower("name")))


view("v_served", """
SELECT f.*, lower(name) AS n FROM v_files f WHERE file_hash NOT IN (SELECT file_hash FROM v_withheld)
  AND file_hash IN (SELECT file_hash FROM v_kept_sources)""")


def _has(token: str) -> str:
    return f"file_hash IN (SELECT file_hash FROM v_postings WHERE token = '{token}')"


def _run_search(spark, sf, tree, **options):
    offers = b.files(spark, sf)
    sources = b.sources(spark, sf).join(b.departed(spark, sf), "user_hash", "left_anti")
    return search.search(
        offers, b.postings(spark, sf), sources, tree, withheld=b.withheld(spark, sf), **options
    ).select("file_hash", "name", "size")


TREE = {"and": [{"or": [{"term": "red"}, {"term": "blue"}]},
                {"not": [{"term": "gear"}, {"num": "size", "op": "<", "value": 1_000_000}]}]}


@query("c16_search", f"""
SELECT file_hash, name, size FROM v_served WHERE {_has('gear')} AND ({_has('red')} OR {_has('blue')})
  AND contains(n, 'gear') AND NOT size < 1000000 ORDER BY file_hash LIMIT 200""")
def c16(spark, sf):
    return _run_search(spark, sf, TREE)


@query("c16_search_compat", f"""
SELECT file_hash, name, size FROM v_served WHERE {_has('red')} AND {_has('plate')}
ORDER BY file_hash LIMIT 200""")
def c16_compat(spark, sf):
    """OR narrowed to files with the words of both sides."""
    return _run_search(spark, sf, {"or": [{"term": "red"}, {"term": "plate"}]}, compat=True)


@query("c16_search_substring", """
SELECT file_hash, name, size FROM v_served WHERE contains(n, 'ge') AND contains(n, 'old')
ORDER BY file_hash LIMIT 200""")
def c16_substring(spark, sf):
    return _run_search(spark, sf, {"term": "ge old"}, match="substring")


@query("c17_scan_search", """
SELECT file_hash, name, size FROM v_served WHERE regexp_matches(n, '[.](jpg|mp3)$') AND size > 50000000
ORDER BY file_hash LIMIT 200""")
def c17(spark, sf):
    tree = {"and": [{"or": [{"type": "image"}, {"type": "audio"}]}, {"num": "size", "op": ">", "value": 50_000_000}]}
    return _run_search(spark, sf, tree)


@query("c3_gram_postings", """
SELECT unnest(list_distinct(list_concat([substr(n, i, 2) FOR i IN range(1, length(n))],
  [substr(n, i, 3) FOR i IN range(1, length(n) - 1)]))) AS gram, file_hash FROM (SELECT file_hash, lower(name) AS n FROM v_files)""")
def c3_grams(spark, sf):
    return b.gram_postings(spark, sf)


def _run_gram_search(spark, sf, tree):
    return _run_search(spark, sf, tree, match="substring", gram_rows=b.gram_postings(spark, sf))


@query("c9_gram_search", """
SELECT file_hash, name, size FROM v_served WHERE contains(n, 'ea') AND contains(n, 'r')
  AND ((contains(n, 'ing') AND size > 1000000) OR (contains(n, 'mp') AND NOT contains(n, 'kg')))
ORDER BY file_hash LIMIT 200""")
def c9_grams(spark, sf):
    """Parts of words, one of two characters, found by their grams."""
    parts = {"or": [{"and": [{"meta": "ing"}, {"num": "size", "op": ">", "value": 1_000_000}]},
                    {"not": [{"term": "MP"}, {"term": "kg"}]}]}
    return _run_gram_search(spark, sf, {"and": [{"term": "ea R"}, parts]})


@query("c16_gram_search", """
SELECT file_hash, name, size FROM v_served WHERE contains(n, 'ge') AND contains(n, 'old')
ORDER BY file_hash LIMIT 200""")
def c16_grams(spark, sf):
    return _run_gram_search(spark, sf, {"term": "ge old"})


@query("c17_gram_search", """
SELECT file_hash, name, size FROM v_served WHERE regexp_matches(n, '[.](jpg|mp3)$') AND size > 50000000
ORDER BY file_hash LIMIT 200""")
def c17_grams(spark, sf):
    """No word at all: the extensions of a type have grams too."""
    tree = {"and": [{"or": [{"type": "image"}, {"type": "audio"}]}, {"num": "size", "op": ">", "value": 50_000_000}]}
    return _run_gram_search(spark, sf, tree)


@query("c18_short_search", f"""
SELECT file_hash, name, size FROM v_served WHERE {_has('red')} ORDER BY file_hash LIMIT 10""")
def c18(spark, sf):
    return _run_search(spark, sf, {"term": "red"}, short=True)


view("v_batch_queries", """
SELECT DISTINCT concat(p_name, ' ', CASE p_partkey % 8 WHEN 0 THEN 'mp3' WHEN 1 THEN 'mkv' WHEN 2 THEN 'jpg'
  WHEN 3 THEN 'exe' WHEN 4 THEN 'pdf' WHEN 5 THEN 'zip' WHEN 6 THEN 'bin' ELSE 'none' END) AS query_id FROM part""")
view("v_batch_results", """
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY file_hash) AS INTEGER) AS rank,
  file_hash, name, size
FROM (SELECT q.query_id, v.file_hash, v.name, v.size FROM v_batch_queries q
  JOIN (SELECT query_id, unnest(string_split(query_id, ' ')) AS token FROM v_batch_queries) t ON q.query_id = t.query_id
  JOIN v_postings p ON p.token = t.token JOIN v_served v ON v.file_hash = p.file_hash
  GROUP BY ALL HAVING count(*) = 3)""")


def batch_results(spark, sf, cap):
    kinds = ["mp3", "mkv", "jpg", "exe", "pdf", "zip", "bin", "none"]
    kind = F.get(F.array(*map(F.lit, kinds)), (F.col("p_partkey") % 8).cast("int"))
    asked = b.table(spark, sf, "part").select(F.concat("p_name", F.lit(" "), kind).alias("query_id")).distinct()
    sources = b.sources(spark, sf).join(b.departed(spark, sf), "user_hash", "left_anti")
    return search.batch_search(
        b.files(spark, sf), b.postings(spark, sf), asked.withColumn("tokens", text.tokens(F.col("query_id"))),
        withheld=b.withheld(spark, sf), source_rows=sources, cap=cap,
    )


@query("c19_batch_search", "SELECT * FROM v_batch_results WHERE rank <= 20")
def c19(spark, sf):
    return batch_results(spark, sf, 20)


view("v_tree_queries", """
SELECT DISTINCT p_partkey % 6 AS kind, split_part(p_name, ' ', 1) AS w1, split_part(p_name, ' ', 2) AS w2,
  CASE WHEN p_partkey % 6 IN (2, 4) THEN CAST(p_size AS BIGINT) * p_size * 65536 ELSE 0 END AS v FROM part""")
view("v_file_words", "SELECT file_hash, list(token) AS words FROM v_postings GROUP BY file_hash")
view("v_tree_hits", """
SELECT q.kind, q.w1, q.w2, q.v, s.file_hash, s.name, s.size FROM v_tree_queries q
JOIN (SELECT v_served.*, regexp_extract(n, '[^.]*$') AS ext, words FROM v_served LEFT JOIN v_file_words USING (file_hash)) s ON CASE q.kind
  WHEN 0 THEN contains(n, w1) AND contains(n, w2) AND list_has_all(words, [w1, w2])
  WHEN 1 THEN (contains(n, w1) OR (contains(n, w2) AND ext = 'mp3')) AND list_has_any(words, [w1, w2])
  WHEN 2 THEN contains(n, w1) AND contains(n, w2) AND list_has_all(words, [w1, w2]) AND NOT size < v
  WHEN 3 THEN (contains(n, w1) OR contains(n, w2)) AND ext = 'mkv'
  WHEN 4 THEN ext = 'jpg' AND size >= v
  ELSE NOT contains(n, w1) END""")


@query("c19_batch_trees", """
SELECT concat_ws(' ', kind, w1, w2, v) AS query_id, CAST(rank AS INTEGER) AS rank, file_hash, name, size FROM (
  SELECT *, row_number() OVER (PARTITION BY kind, w1, w2, v ORDER BY file_hash) AS rank FROM v_tree_hits) WHERE rank <= 20""")
def c19_trees(spark, sf):
    """Six kinds of boolean trees over the words and sizes of parts: with and without indexable words."""
    part = b.table(spark, sf, "part")
    kind, word = F.col("p_partkey") % 6, lambda i: F.split_part("p_name", F.lit(" "), F.lit(i))
    size = F.when(kind.isin(2, 4), F.col("p_size").cast("bigint") * F.col("p_size") * 65536).otherwise(F.lit(0).cast("bigint"))
    asked = part.select(kind.alias("kind"), word(1).alias("w1"), word(2).alias("w2"), size.alias("v")).distinct()
    one, two, v = {"term": F.col("w1")}, {"term": F.col("w2")}, F.col("v")
    by_kind = [
        {"and": [one, two]},
        {"or": [one, {"and": [two, {"type": "Audio"}]}]},
        {"not": [{"term": F.concat_ws(" ", F.upper("w1"), "w2")}, {"num": "size", "op": "<", "value": v}]},
        {"and": [{"or": [one, {"meta": F.col("w2")}]}, {"format": "MKV"}]},
        {"and": [{"type": "image"}, {"num": "FileSize", "op": ">=", "value": v}]},
        {"not": [{"num": "bitrate", "op": ">", "value": 320}, one]},
    ]
    nodes = F.get(F.array(*map(trees.postfix, by_kind)), F.col("kind").cast("int"))
    asked = asked.select(F.concat_ws(" ", *[F.col(c).cast("string") for c in ("kind", "w1", "w2", "v")]).alias("query_id"), nodes.alias("nodes"))
    sources = b.sources(spark, sf).join(b.departed(spark, sf), "user_hash", "left_anti")
    return trees.batch_trees(
        b.files(spark, sf), b.search_keys(spark, sf), asked, withheld=b.withheld(spark, sf), source_rows=sources, cap=20)


@query("c20_result_projection", f"""
SELECT h.file_hash, coalesce(ip, 0) AS source_ip, coalesce(port, 0) AS source_port, name,
  size % 4294967296 AS size_low, size // 4294967296 AS size_high, c.sources, c.sources AS complete_sources,
  nullif(CASE regexp_extract(n, '[.]([^.]*)$', 1) WHEN 'mp3' THEN 1 WHEN 'mkv' THEN 2 WHEN 'jpg' THEN 3
    WHEN 'exe' THEN 4 WHEN 'bin' THEN 4 WHEN 'pdf' THEN 5 WHEN 'zip' THEN 6 ELSE 0 END, 0) AS type_id
FROM (SELECT * FROM v_served WHERE {_has('small')} AND {_has('bolt')} ORDER BY file_hash LIMIT 200) h
LEFT JOIN (SELECT file_hash, ip, port, row_number() OVER (PARTITION BY file_hash ORDER BY first_us, user_hash) AS rn
  FROM v_kept_sources) s ON s.file_hash = h.file_hash AND rn = 1
LEFT JOIN (SELECT file_hash, count(*) AS sources FROM v_kept_sources GROUP BY file_hash) c ON c.file_hash = h.file_hash""")
def c20(spark, sf):
    sources = b.sources(spark, sf).join(b.departed(spark, sf), "user_hash", "left_anti")
    tree = {"and": [{"term": "small"}, {"term": "bolt"}]}
    hits = search.search(
        b.files(spark, sf), b.postings(spark, sf), sources, tree, withheld=b.withheld(spark, sf)
    )
    return search.project_results(hits, sources)


@query("c21_pages", """
SELECT query_id, rank, file_hash, CAST((rank - 1) // 3 + 1 AS INTEGER) AS page,
  max(rank) OVER (PARTITION BY query_id) > ((rank - 1) // 3 + 1) * 3 AS has_more
FROM v_batch_results WHERE rank <= 10""")
def c21(spark, sf):
    paged = search.paginate(batch_results(spark, sf, 10), page_size=3, keys=["query_id"])
    return paged.select("query_id", "rank", "file_hash", "page", "has_more")


# -- source lookup ----------------------------------------------------------

view("v_requests", """
SELECT o_orderkey AS request_id, md5(concat('u', u)) AS requester, md5(concat('f', f)) AS file_hash
FROM (SELECT o_orderkey, coalesce(min(l_suppkey), -1) AS u, coalesce(min(l_partkey), -1) AS f
  FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)""")
view("v_endpoints", """
SELECT s.*, coalesce(c.assigned_id, (s.ip >> 24 & 255) + (s.ip >> 16 & 255) * 256 + (s.ip >> 8 & 255) * 65536
    + (s.ip & 255) * 16777216) AS endpoint_id
FROM v_sources s LEFT JOIN (SELECT user_hash, assigned_id FROM v_clients WHERE NOT is_high_id) c
  ON s.user_hash = c.user_hash""")


def _requests(spark, sf):
    lines = b.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_suppkey").alias("u"), F.min("l_partkey").alias("f")
    )
    rows = b.table(spark, sf, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = lambda prefix, c: F.md5(F.concat(F.lit(prefix), F.coalesce(c, F.lit(-1)).cast("string")))
    return rows.select(
        F.col("o_orderkey").alias("request_id"), key("u", F.col("u")).alias("requester"),
        key("f", F.col("f")).alias("file_hash"),
    )


def _listed(sources):
    return F.array_join(
        F.transform(
            sources,
            lambda s: F.concat_ws(":", s["user_hash"], s["endpoint_id"].cast("string"), s["port"].cast("string")),
        ),
        "|",
    )


@query("d1_sources", """
SELECT r.request_id, r.file_hash, coalesce(listed, '') AS listed FROM v_requests r LEFT JOIN (
  SELECT request_id, string_agg(entry, '|' ORDER BY rn) AS listed FROM (
    SELECT r.request_id, concat(s.user_hash, ':', s.endpoint_id, ':', s.port) AS entry,
      row_number() OVER (PARTITION BY r.request_id ORDER BY s.first_us, s.user_hash) AS rn
    FROM v_requests r JOIN v_endpoints s ON r.file_hash = s.file_hash AND s.user_hash <> r.requester
    WHERE r.file_hash NOT IN (SELECT file_hash FROM v_withheld)) WHERE rn <= 5 GROUP BY request_id) a
  ON a.request_id = r.request_id""")
def d1(spark, sf):
    replies = lookup.sources_for(
        _requests(spark, sf), b.sources(spark, sf), b.clients(spark, sf),
        withheld=b.withheld(spark, sf), cap=5,
    )
    return replies.select("request_id", "file_hash", _listed(F.col("sources")).alias("listed"))


view("v_batch_requests", """
SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY file_hash) - 1 AS INTEGER) AS pos, file_hash
FROM (SELECT DISTINCT l_orderkey AS request_id, md5(concat('f', l_partkey)) AS file_hash FROM lineitem)""")


@query("d2_batch_sources", """
SELECT r.request_id, r.pos, r.file_hash, string_agg(entry, '|' ORDER BY rn) AS listed FROM v_batch_requests r
JOIN (SELECT file_hash, concat(user_hash, ':', endpoint_id, ':', port) AS entry,
    row_number() OVER (PARTITION BY file_hash ORDER BY first_us, user_hash) AS rn FROM v_endpoints) s
  ON s.file_hash = r.file_hash AND rn <= 5
WHERE pos < 3 AND r.file_hash NOT IN (SELECT file_hash FROM v_withheld) GROUP BY ALL""")
def d2(spark, sf):
    lines = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request_id"), b.file_id("l_partkey").alias("file_hash")
    ).distinct()
    asked = first_per_key(lines, ["request_id"], ["file_hash"], lookup.BATCH_HASHES).groupBy("request_id").agg(
        F.array_sort(F.collect_list("file_hash")).alias("file_hashes")
    )
    replies = lookup.sources_for_batch(
        asked, b.sources(spark, sf), b.clients(spark, sf), withheld=b.withheld(spark, sf), max_hashes=3, cap=5
    )
    return replies.select("request_id", "pos", "file_hash", _listed(F.col("sources")).alias("listed"))


@query("d3_endpoint_ids", "SELECT file_hash, user_hash, endpoint_id FROM v_endpoints")
def d3(spark, sf):
    return lookup.endpoints(b.sources(spark, sf), b.clients(spark, sf)).select(
        "file_hash", "user_hash", "endpoint_id"
    )


@query("d4_withheld", "SELECT file_hash FROM v_withheld")
def d4(spark, sf):
    return lookup.withheld_files(b.screened_files(spark, sf))


@query("d4_hash_only", """
SELECT md5(concat('f', p_partkey)) AS file_hash, coalesce(listed IN (1, 2), false) AS withheld
FROM part LEFT JOIN v_listed l ON l.file_hash = md5(concat('f', p_partkey))""")
def d4_hash_only(spark, sf):
    asked = b.table(spark, sf, "part").select(b.file_id("p_partkey").alias("file_hash"))
    return hash_only_verdict(asked, b.policy_hashes(spark, sf))
