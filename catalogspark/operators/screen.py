"""Layered content-policy screening. All vocabulary is operator data."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions import text
from catalogspark.functions.ordered import running
from catalogspark.operators import terms as term_lists

# Layer -> (counts against the publisher, counter key, total key).
LAYERS = {
    "L1": (True, "policy_L1_terms", "policy"),
    "L2": (True, "policy_L2_rule", "policy"),
    "L3": (True, "policy_L3_hash", "policy"),
    "L4": (True, "policy_L4_extra", "policy"),
    "L5": (False, "poison_L5_hash", "poison"),
}


MOJIBAKE = " (mojibake)"


@dataclass(frozen=True)
class Words:
    """A word list split by how its entries are bounded."""

    substring: tuple[str, ...] = ()
    prefix: tuple[str, ...] = ()
    bounded: tuple[str, ...] = ()
    script: tuple[str, ...] = ()

    def pattern(self) -> str | None:
        return text.any_of(
            [text.plain_pattern(w) for w in (*self.substring, *self.script)]
            + [text.prefix_pattern(w) for w in self.prefix]
            + [text.bounded_pattern(w) for w in self.bounded]
        )


@dataclass(frozen=True)
class Quantity:
    """A one- or two-digit number with a unit.

    ``compact`` units may also stand alone as evidence below the rule's limit;
    ``spelled`` units are cancelled by the veto words around them. ``attached``
    is a unit that must follow the digits without a space.
    """

    low: int
    high: int
    compact: tuple[str, ...] = ()
    spelled: tuple[str, ...] = ()
    attached: str | None = None
    veto_after: tuple[str, ...] = ()
    veto_before: tuple[str, ...] = ()
    veto_near: tuple[str, ...] = ()
    near_chars: int = 32


@dataclass(frozen=True)
class Rule:
    """Evidence and context together, unless an exception phrase is present."""

    evidence: Words = field(default_factory=Words)
    context: Words = field(default_factory=Words)
    exceptions: tuple[str, ...] = ()
    quantity: Quantity | None = None
    standalone_max: int | None = None
    guards: tuple[str, ...] = ()
    guard_window: int = 24
    pair_letters: str = ""
    level_caps: tuple[tuple[str, int], ...] = ()


@dataclass(frozen=True)
class Policy:
    """Operator lists of one policy version. Hash lists are tables, since they may be large.

    A term list is given in Python while it is short, else as a table (ord, term).
    """

    hashes: DataFrame | None = None  # file_hash, list ('allow' | 'ban' | 'poison')
    terms: tuple[str, ...] | DataFrame = ()
    extra_terms: tuple[str, ...] | DataFrame = ()
    rule: Rule | None = None
    public: bool = False


def _number(low: int, high: int) -> str:
    """A number in the range, one or two digits, leading zero allowed."""
    return "(?:" + "|".join(f"0?{n}" if n < 10 else str(n) for n in range(high, low - 1, -1)) + ")"


def _guarded(guards: tuple[str, ...], window: int) -> tuple[str, str]:
    """Look-arounds that fail when a guard word lies wholly within the window around the number."""
    fits = [g for g in guards if len(g) <= window]
    before = "".join(rf"(?<!{text.quote(g)}[\s\S]{{0,{window - len(g)}}})" for g in fits)
    after = "".join(rf"(?![\s\S]{{0,{window - len(g)}}}{text.quote(g)})" for g in fits)
    return before, after


def quantity_patterns(
    q: Quantity, *, max_value: int | None = None, compact_only: bool = False,
    guards: tuple[str, ...] = (), window: int = 0,
) -> list[str]:
    """One pattern per notation. The engine goes on to later numbers by itself when one fails."""
    before_guard, after_guard = _guarded(guards, window)
    number = _number(q.low, q.high if max_value is None else min(q.high, max_value))
    head = rf"(?<![A-Za-z0-9_]){before_guard}{after_guard}{number}(?![0-9])"
    end = r"(?![A-Za-z0-9_])"
    out = []
    if q.attached:
        out.append(rf"{head}{text.quote(q.attached)}{end}")
    if q.compact:
        out.append(rf"{head} *{text.any_of([text.quote(u) for u in q.compact])}{end}")
    if q.spelled and not compact_only:
        tail = [text.quote(w) for w in q.veto_after] + ["[0-9]"]
        veto = rf"(?! *{text.any_of(tail)})"
        lead = "".join(rf"(?<!(?<![A-Za-z]){text.quote(w)}[^A-Za-z]{{1,8}})" for w in q.veto_before)
        lead += "".join(
            rf"(?<!{text.quote(w)}[\s\S]{{0,{max(q.near_chars - len(w), 0)}}})" for w in q.veto_near
        )
        out.append(rf"{lead}{head} *{text.any_of([text.quote(u) for u in q.spelled])}{end}{veto}")
    return out


def paired_marker(lowered: Column, letters: str) -> Column:
    """At least two letter+number marks such as ``a12``."""
    mark = rf"(?<![A-Za-z0-9_])[{letters}][0-9]{{1,2}}(?![A-Za-z0-9_])"
    return F.regexp_count(lowered, F.lit(mark)) >= 2


def level_pattern(caps: tuple[tuple[str, int], ...]) -> str:
    """A word followed by a digit that its level scale really has."""
    return text.any_of([rf"{text.quote(word)} *[1-{cap}]" for word, cap in caps])


def rule_reason(lowered: Column, rule: Rule | None) -> Column:
    """Why the rule fires on a lowered name, or null."""
    none = F.lit(None).cast("string")
    if rule is None:
        return none
    claims: list[tuple[Column, Column]] = []
    if rule.quantity is not None:
        pattern = text.any_of(quantity_patterns(rule.quantity))
        found = F.concat(F.lit("quantity "), F.regexp_extract(lowered, pattern, 0))
        claims.append((lowered.rlike(pattern), found))
    if rule.level_caps:
        claims.append((lowered.rlike(level_pattern(rule.level_caps)), F.lit("level")))
    if rule.evidence.pattern():
        claims.append((lowered.rlike(rule.evidence.pattern()), F.lit("word")))
    if rule.pair_letters:
        claims.append((paired_marker(lowered, rule.pair_letters), F.lit("pair")))
    if not claims:
        return none
    claim = F.coalesce(*[F.when(test, label) for test, label in claims])
    context = rule.context.pattern()
    with_context = F.when(lowered.rlike(context), claim) if context else none
    out = with_context
    if rule.quantity is not None and rule.standalone_max is not None:
        alone = text.any_of(
            quantity_patterns(
                rule.quantity, max_value=rule.standalone_max, compact_only=True,
                guards=rule.guards, window=rule.guard_window,
            )
        )
        if alone:
            found = F.concat(F.lit("quantity "), F.regexp_extract(lowered, alone, 0), F.lit(" alone"))
            out = F.coalesce(out, F.when(lowered.rlike(alone), found))
    if rule.exceptions:
        phrase = text.any_of([text.plain_pattern(p) for p in rule.exceptions])
        out = F.when(~lowered.rlike(phrase), out)
    return out


def name_forms(rows: DataFrame, name: Column) -> DataFrame:
    """Add ``__lower`` and ``__fixed``: the lowered name, and the lowered repaired one where it was doubly encoded."""
    once = F.col("__once")
    return rows.withColumns({"__lower": F.lower(name), "__once": text.repair_round(name)}).withColumns(
        {"__fixed": F.lower(F.coalesce(text.repair_round(once), once))}
    ).drop("__once")


def _with_list_matches(steps: DataFrame, lists: dict[str, DataFrame]) -> DataFrame:
    """Add ``__lower_L1`` and the like: first entries of lists that are tables, by joins on the distinct texts."""
    texts = steps.select(F.explode(F.array("__lower", "__fixed")).alias("text")).filter("text is not null").distinct()
    found = None
    for layer, entries in lists.items():
        hits = term_lists.first_terms(texts, entries).select("text", F.col("term").alias(layer))
        found = hits if found is None else found.join(hits, "text", "full")
    for source in ("__lower", "__fixed"):
        named = found.select(F.col("text").alias(source), *[F.col(layer).alias(f"{source}_{layer}") for layer in lists])
        steps = steps.join(named, source, "left")
    return steps


def with_name_verdict(rows: DataFrame, policy: Policy, *, when: Column | None = None) -> DataFrame:
    """Add ``verdict``, struct(layer, reason) of the text layers or null, to rows with a name.

    A name that turns out to be doubly encoded is tested in its repaired form first.
    Every step is a column of its own, so no pattern is evaluated twice; rows
    outside ``when`` carry nulls through all of them.
    """
    lists = {"L1": policy.terms, "L4": policy.extra_terms}
    tables = {layer: entries for layer, entries in lists.items() if isinstance(entries, DataFrame)}
    steps = name_forms(rows, F.col("name") if when is None else F.when(when, F.col("name")))
    if tables:
        steps = _with_list_matches(steps, tables)

    def reason(layer: str, source: str) -> Column:
        if layer == "L2":
            return rule_reason(F.col(source), policy.rule)
        if layer in tables:
            return F.col(f"{source}_{layer}")
        return text.first_matching_term(F.col(source), list(lists[layer]))

    columns, reasons = {}, []
    for source, suffix, layers in (("__fixed", MOJIBAKE, "L1 L4 L2"), ("__lower", "", "L1 L2 L4")):
        for layer in layers.split():
            found = reason(layer, source)
            columns[f"{source}_{layer}"] = F.concat(found, F.lit(suffix)) if suffix else found
            reasons.append((layer, F.col(f"{source}_{layer}")))
    steps = steps.withColumns(columns)
    verdict = F.coalesce(
        *[F.when(r.isNotNull(), F.struct(F.lit(layer).alias("layer"), r.alias("reason"))) for layer, r in reasons]
    )
    return steps.select(*rows.columns, verdict.alias("verdict"))


def hash_verdicts(hashes: DataFrame) -> DataFrame:
    """One row per listed hash: allow beats ban, ban beats poison."""
    rank = F.when(F.col("list") == "allow", 0).when(F.col("list") == "ban", 1).otherwise(2)
    return hashes.groupBy("file_hash").agg(F.min(rank).alias("__listed"))


def _listed(rows: DataFrame, policy: Policy, by_file: bool = False) -> DataFrame:
    if policy.hashes is None:
        return rows.withColumn("__listed", F.lit(None).cast("int"))
    verdicts = hash_verdicts(policy.hashes)
    return rows.join(verdicts.hint("shuffle_hash") if by_file else verdicts, "file_hash", "left")


def _decide(listed: DataFrame, columns: list[str], by_name: Column) -> DataFrame:
    at = F.col("__listed")
    verdict = (
        F.when(at == 1, F.struct(F.lit("L3").alias("layer"), F.lit("hash").alias("reason")))
        .when(at == 2, F.struct(F.lit("L5").alias("layer"), F.lit("poison").alias("reason")))
        .when(at.isNull(), by_name)
    )
    return listed.withColumn("__verdict", verdict).select(
        *columns, F.col("__verdict.layer").alias("layer"), F.col("__verdict.reason").alias("reason")
    )


def screen(rows: DataFrame, policy: Policy) -> DataFrame:
    """Add ``layer`` and ``reason`` (null when allowed) to rows with file_hash and name.

    The hash lists decide first, by one join; the text layers sit behind them in
    a condition, so they are evaluated only for rows still open.
    """
    judged = with_name_verdict(_listed(rows, policy), policy, when=F.col("__listed").isNull())
    return _decide(judged, rows.columns, F.col("verdict"))


def blocked_names(rows: DataFrame, policy: Policy) -> DataFrame:
    """Distinct names the text layers object to: (name, verdict). Usually a small part of all names."""
    return (
        with_name_verdict(rows.select("name").distinct(), policy)
        .filter(F.col("verdict").isNotNull())
    )


def screen_repeated(rows: DataFrame, policy: Policy, names: DataFrame | None = None, *, by_file: bool = False) -> DataFrame:
    """As ``screen``, for rows whose names repeat, such as offers.

    Each distinct name is tested once, and only the names with a verdict are joined
    back. ``names`` may hold the result of ``blocked_names``. With ``by_file`` the rows are
    laid out by file to meet the hash lists, at any size of these: for what then groups by file.
    """
    names = blocked_names(rows, policy) if names is None else names
    judged = _listed(rows, policy, by_file).join(names.withColumnRenamed("verdict", "__by_name"), "name", "left")
    return _decide(judged, rows.columns, F.col("__by_name"))


def hash_only_verdict(hashes: DataFrame, policy_hashes: DataFrame) -> DataFrame:
    """Verdict for hashes without a known name: only the lists apply."""
    joined = hashes.join(hash_verdicts(policy_hashes), "file_hash", "left")
    at = F.col("__listed")
    return joined.withColumn("withheld", F.coalesce(at.isin(1, 2), F.lit(False))).drop("__listed")


def layer_attributes(spark) -> DataFrame:
    """Five-row dimension: does the layer count against its publisher, and under which keys."""
    rows = [(layer, *values) for layer, values in LAYERS.items()]
    return spark.createDataFrame(
        rows, "layer string, counts_against_publisher boolean, stat_key string, total_key string"
    )


def counts_against_publisher(layer: Column) -> Column:
    return layer.isin(*[name for name, values in LAYERS.items() if values[0]])


def rescreen(screened: DataFrame, after: Policy) -> DataFrame:
    """Verdicts that change with a new policy version, old and new side by side.

    ``screened`` carries the verdict of the version before.
    """
    old = screened.withColumnRenamed("layer", "old_layer").withColumnRenamed("reason", "old_reason")
    new = screen(old, after)
    changed = ~(F.col("old_layer").eqNullSafe(F.col("layer")) & F.col("old_reason").eqNullSafe(F.col("reason")))
    return new.filter(changed)


def list_changes(spark, before: tuple[str, ...] | DataFrame, after: tuple[str, ...] | DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ord, term) of the entries to test anew, and the terms that are gone.

    An entry that moved ahead of one it used to follow may now come first, so it is tested anew.
    """
    old, new = [e if isinstance(e, DataFrame) else term_lists.term_table(spark, e) for e in (before, after)]
    old, new = [e.filter("term <> ''").groupBy("term").agg(F.min("ord").alias("ord")) for e in (old, new)]
    gone = old.join(new, "term", "left_anti").select("term")
    both = new.join(old.withColumnRenamed("ord", "old_ord"), "term").withColumns({"one": F.lit(1), "chunk": F.floor(F.col("old_ord") / 4096)})
    passed = running(both, keys=["one"], chunk="chunk", order=["old_ord"], aggs={"furthest": ("max", F.col("ord"))})
    moved = passed.filter(F.col("furthest") > F.col("ord")).select("ord", "term")
    return new.join(old, "term", "left_anti").select("ord", "term").unionByName(moved), gone


def name_runs(file_rows: DataFrame) -> DataFrame:
    """(run, file_hash): runs of one to three characters of each name, lowered and as repaired. Kept, it serves every list change."""
    each = [F.transform(term_lists.runs(F.col(form), n), lambda r: r["run"]) for form in ("__lower", "__fixed") for n in range(1, term_lists.ANCHOR + 1)]
    cut = F.array_distinct(F.concat(*[F.coalesce(e, F.array().cast("array<string>")) for e in each]))
    return name_forms(file_rows, F.col("name")).select(F.explode(cut).alias("run"), "file_hash")


def rescreen_changes(screened: DataFrame, before: Policy, after: Policy, runs: DataFrame | None = None) -> DataFrame:
    """As ``rescreen``, reading only what the change of lists can concern.

    These are files whose hash was listed or unlisted, files whose verdict names an entry that
    is gone, and files whose name may hold an entry that is new. The latter are found by
    the entries' rarest runs in ``runs`` (``name_runs``, else made on the way). Every other
    verdict stands: what decided it is still listed, and nothing new speaks before it. Only a
    changed rule concerns all names.
    """
    if before.rule != after.rule:
        return rescreen(screened, after)
    spark = screened.sparkSession
    runs = name_runs(screened) if runs is None else runs
    concerned = []
    if before.hashes is not after.hashes:
        none = spark.createDataFrame([], "file_hash string, list string")
        old, new = [none if p.hashes is None else p.hashes.select("file_hash", "list") for p in (before, after)]
        concerned += [old.join(new, ["file_hash", "list"], "left_anti").select("file_hash"), new.join(old, ["file_hash", "list"], "left_anti").select("file_hash")]
    for layer, was, now in (("L1", before.terms, after.terms), ("L4", before.extra_terms, after.extra_terms)):
        if was is now or (isinstance(was, tuple) and was == now):
            continue
        fresh, gone = list_changes(spark, was, now)
        anchors = term_lists.anchors(term_lists.entries(fresh), runs)
        concerned.append(runs.join(anchors.select("run").distinct(), "run", "left_semi").select("file_hash"))
        named = screened.filter(F.col("layer") == layer).select("file_hash", F.regexp_replace("reason", r" \(mojibake\)\z", "").alias("term"))
        concerned.append(named.join(gone, "term", "left_semi").select("file_hash"))
    if not concerned:
        return rescreen(screened.limit(0), after)
    hashes = concerned[0]
    for more in concerned[1:]:
        hashes = hashes.unionByName(more)
    return rescreen(screened.join(hashes.distinct(), "file_hash", "left_semi"), after)


def audit_name(name: Column) -> Column:
    """Fingerprint that stands in for a name in audit output."""
    return F.sha2(name, 256)


def require_ready(policy: Policy) -> None:
    """A public deployment must not start without a ban list."""
    if not policy.public:
        return
    if policy.hashes is None or policy.hashes.filter(F.col("list") == "ban").isEmpty():
        raise ValueError("a public deployment needs a ban list")
