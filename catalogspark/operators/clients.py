"""Clients and sessions: latest state, classification, liveness, time-aware lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from catalogspark.functions import net
from catalogspark.functions.ordered import MICROS, islands, running, slot

LOW_ID_MODULUS = 16_777_214  # fixed value: ids wrap below 0xFFFFFF
DAY = 86_400

# Compatibility id -> client name, and the labels of the ladder.
COMPAT_NAMES = {
    1: "cDonkey", 2: "xMule", 3: "aMule", 4: "Shareaza", 10: "mldonkey", 20: "lphant",
}


def latest_sessions(logins: DataFrame, *, ts: str = "login_ts") -> DataFrame:
    """The newest login of every user, all its columns."""
    rest = [c for c in logins.columns if c != "user_hash"]
    return (
        logins.groupBy("user_hash")
        .agg(F.max_by(F.struct(*rest), F.struct(ts, "session_id")).alias("s"))
        .select("user_hash", *[F.col(f"s.{c}").alias(c) for c in rest])
    )


def classify_software(clients: DataFrame) -> DataFrame:
    """Add ``software`` from: compat_id (nullable), mod (nullable), has_ext, nick."""
    mod, lower = F.col("mod"), F.lower("mod")
    first_word = F.coalesce(F.nullif(F.regexp_extract(mod, r"\S+", 0), F.lit("")), mod)
    named = F.concat(F.lit("eMule-"), first_word)
    compat = F.lit(None).cast("string")
    for number, name in COMPAT_NAMES.items():
        compat = F.when(F.col("compat_id") == number, F.lit(name)).otherwise(compat)
    base_family = (
        F.when(mod.isNull(), F.lit("eMule"))
        .when(lower.contains("emule+") | lower.contains("emuleplus"), F.lit("eMulePlus"))
        .when(lower.contains("xtreme"), F.lit("eMule-Xtreme"))
        .when(lower.contains("mephisto"), F.lit("eMule-Mephisto"))
        .otherwise(named)
    )
    software = (
        F.when(lower.startswith("mldonkey"), F.lit("mldonkey"))
        .when(F.col("compat_id") == 0, base_family)
        .when(
            F.col("compat_id").isNotNull(),
            F.coalesce(compat, F.concat(F.lit("compat("), F.col("compat_id").cast("string"), F.lit(")"))),
        )
        .when(mod.isNotNull(), F.when(lower.contains("emule+"), F.lit("eMulePlus")).otherwise(named))
        .when(F.col("has_ext"), F.lit("eMule-old"))
        .otherwise(F.lit("eD2k-basic"))
    )
    nick = F.lower("nick")
    unknown = F.col("software").startswith("compat(") | (F.col("software") == "eD2k-basic")
    by_nick = (
        F.when(nick.contains("nolistsrvs") | nick.contains("mldonkey"), F.lit("mldonkey"))
        .when(nick.contains("jed2k"), F.lit("jed2k"))
        .otherwise(F.col("software"))
    )
    return clients.withColumn("software", software).withColumn(
        "software", F.when(unknown, by_nick).otherwise(F.col("software"))
    )


def assign_ids(logins: DataFrame, *, modulus: int = LOW_ID_MODULUS) -> DataFrame:
    """Reachable logins get the id of their address, the others the next low id, which wraps.

    ``logins``: login_us, event_id, ip, reachable. Low ids are numbered over all
    logins in time order; the numbering is chunked by day.
    """
    line = logins.withColumn("__low", (~F.col("reachable")).cast("bigint")).withColumn(
        "__day", slot(F.col("login_us"), DAY)
    )
    numbered = running(
        line, keys=[], chunk="__day", order=["login_us", "event_id"], aggs={"__n": ("sum", F.col("__low"))}
    )
    low = F.pmod(F.col("__n") - 1, F.lit(modulus)) + 1
    return numbered.withColumn(
        "assigned_id", F.when(F.col("reachable"), net.endpoint_id(F.col("ip"))).otherwise(low)
    ).drop("__n", "__low", "__day")


def client_counts(clients: DataFrame) -> DataFrame:
    return clients.agg(
        F.count("*").alias("clients"),
        F.count_if(~F.col("is_high_id")).alias("low_id"),
        F.count_if("natt_capable").alias("capable"),
    )


def id_index(assigned: DataFrame, removals: DataFrame) -> DataFrame:
    """assigned_id -> user: the last writer wins, id 0 is never indexed.

    A removal takes an entry away only when it still belongs to the removing user.
    ``assigned``: assigned_id, user_hash, at_us. ``removals``: the same.
    """
    last = assigned.filter(F.col("assigned_id") != 0).groupBy("assigned_id").agg(
        F.max_by(F.struct("user_hash", "at_us"), F.struct("at_us", "user_hash")).alias("o")
    ).select("assigned_id", "o.user_hash", "o.at_us")
    gone = removals.groupBy("assigned_id", "user_hash").agg(F.max("at_us").alias("__gone"))
    return (
        last.join(gone, ["assigned_id", "user_hash"], "left")
        .filter(F.col("__gone").isNull() | (F.col("__gone") < F.col("at_us")))
        .drop("__gone")
    )


def sessions(activity: DataFrame, *, idle_seconds: int) -> DataFrame:
    """Sessions of each user from any activity channel; a longer pause than the limit ends one."""
    runs = islands(activity, keys=["user_hash"], ts_us="at_us", gap_seconds=idle_seconds)
    return (
        activity.withColumn("slot", slot(F.col("at_us"), idle_seconds))
        .groupBy("user_hash", "slot")
        .agg(F.min("at_us").alias("lo"), F.max("at_us").alias("hi"), F.count("*").alias("n"))
        .join(runs, ["user_hash", "slot"])
        .groupBy("user_hash", "run")
        .agg(F.min("lo").alias("started_us"), F.max("hi").alias("ended_us"), F.sum("n").alias("events"))
        .withColumnRenamed("run", "session_no")
    )


def last_activity(*channels: DataFrame) -> DataFrame:
    """Latest activity per user over all channels: any of them keeps a session alive."""
    merged = channels[0]
    for other in channels[1:]:
        merged = merged.unionByName(other)
    return merged.groupBy("user_hash").agg(F.max("at_us").alias("last_activity_us"))


def alive(activity: DataFrame, *, as_of_us: Column, idle_seconds: int) -> DataFrame:
    """Users with ``alive``: idle no longer than the limit."""
    return activity.withColumn(
        "alive", as_of_us - F.col("last_activity_us") <= idle_seconds * MICROS
    )


def fresh_value(
    probes: DataFrame, observations: DataFrame, *, tolerance_seconds: int, chunk_seconds: int = DAY
) -> DataFrame:
    """Newest observed value per probe if young enough and not zero, else the announced one.

    ``probes``: user_hash, at_us, probe_id, announced. ``observations``: user_hash,
    at_us, value. An as-of join as a running "last observation", chunked by time.
    """
    seen = observations.select(
        "user_hash", "at_us", F.lit(0).alias("is_probe"),
        F.struct("at_us", "value").alias("observed"),
    )
    asks = probes.select(
        "user_hash", "at_us", F.lit(1).alias("is_probe"), "probe_id", "announced",
    )
    line = asks.unionByName(seen, allowMissingColumns=True).withColumn(
        "chunk", slot(F.col("at_us"), chunk_seconds)
    )
    latest = running(
        line, keys=["user_hash"], chunk="chunk", order=["at_us", "is_probe", "observed", "probe_id"],
        aggs={"last": ("max", F.col("observed"))},
    )
    usable = (F.col("last.value") != 0) & (
        F.col("at_us") - F.col("last.at_us") < tolerance_seconds * MICROS
    )
    return latest.filter(F.col("is_probe") == 1).select(
        "user_hash", "probe_id", "at_us", "announced",
        F.when(usable, F.col("last.value")).otherwise(F.col("announced")).alias("effective"),
    )


def rendezvous(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Outcome of each rendezvous request, and which side starts.

    ``requests``: request_id, requester_id, target_id. ``clients``: assigned_id,
    alive, is_high_id, udp_port (one row per id).
    """
    target = clients.select(
        F.col("assigned_id").alias("target_id"), "alive", "is_high_id", "udp_port",
        F.lit(True).alias("__known"),
    )
    outcome = (
        F.when(F.col("requester_id") == F.col("target_id"), "bad_request")
        .when(F.col("__known").isNull(), "not_connected")
        .when(~F.col("alive"), "target_dead")
        .when(F.col("is_high_id"), "target_high_id")
        .when(F.col("udp_port") == 0, "no_udp_port")
        .otherwise("coordinated")
    )
    return (
        requests.join(target, "target_id", "left")
        .withColumn("outcome", outcome)
        .withColumn(
            "initiator_id",
            F.when(F.col("outcome") == "coordinated", F.least("requester_id", "target_id")),
        )
        .select("request_id", "requester_id", "target_id", "outcome", "initiator_id")
    )


def callbacks(requests: DataFrame, clients: DataFrame) -> DataFrame:
    """Outcome of each callback request: only a reachable requester may ask for a connected target.

    ``requests``: request_id, requester_high, target_id. ``clients``: assigned_id.
    """
    target = clients.select(F.col("assigned_id").alias("target_id"), F.lit(True).alias("__known"))
    outcome = (
        F.when(~F.col("requester_high"), "ignored")
        .when(F.col("__known").isNull(), "failed")
        .otherwise("forwarded")
    )
    return requests.join(target, "target_id", "left").select(
        "request_id", "target_id", outcome.alias("outcome")
    )
