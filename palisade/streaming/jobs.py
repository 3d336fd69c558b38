"""Detection on streams of events.

All parsers are stateless and run on a stream of lines as they are.  The
functions here are the stateful parts.  They need event times: rows without
one are set aside by `split_timed`, because a watermark cannot hold them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import contains_any, is_filled
from palisade.operators.accounts import auth_success, privilege_pattern
from palisade.operators.allow import drop_listed
from palisade.operators.windows import peak_window
from palisade.params import Params
from palisade.schema import micros

SECOND = 1_000_000


def read_line_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """A folder of text files as a stream of lines."""
    return spark.readStream.options(**options).text(path).select(
        "value", F.col("_metadata.file_path").alias("source")
    )


def split_timed(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events with a time, events without one)."""
    return events.filter(F.col("ts").isNotNull()), events.filter(F.col("ts").isNull())


def _grid(events: DataFrame, key: str, window_sec: int, step_sec: int, delay: str, least: int):
    """Keys with at least `least` events in a window of a regular grid.  The
    windows are one step longer than asked, so any closed window of the asked
    length lies inside one of them: nothing is missed."""
    return (
        events.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{window_sec + step_sec} seconds", f"{step_sec} seconds"), key)
        .agg(F.count(F.lit(1)).alias("events"), F.max("ts").alias("last_seen"))
        .filter(F.col("events") >= least)
        .select(key, F.col("window.start").alias("window_start"),
                F.col("window.end").alias("window_end"), "events", "last_seen")
    )


def _failures(events: DataFrame, params: Params) -> DataFrame:
    return drop_listed(
        events.filter((F.col("event_type") == "auth_failure") & is_filled(F.col("ip"))),
        "ip", params.allowed_ips,
    )


def _rows_of(detector: str, events: DataFrame, params: Params) -> DataFrame:
    """The failures that a detector looks at."""
    rows = _failures(events, params)
    if detector == "brute_force":
        return rows
    if detector == "password_spray":
        return rows.filter(is_filled(F.col("user")))
    if detector == "enumeration":
        return rows.filter(contains_any(F.lower("message"), fixed.INVALID_USER_MARKERS))
    raise ValueError(f"no such detector: {detector}")


def brute_force_candidates(
    events: DataFrame, params: Params = Params(), delay: str = "10 minutes",
    step_sec: int | None = None,
) -> DataFrame:
    """Addresses that may have a burst, with the stretch of time to look at."""
    window = params.brute_force_window_sec
    return _grid(_failures(events, params), "ip", window, step_sec or max(1, window // 4),
                 delay, params.brute_force_threshold)


def password_spray_candidates(
    events: DataFrame, params: Params = Params(), delay: str = "10 minutes",
    step_sec: int | None = None,
) -> DataFrame:
    """Addresses that may spray: as many events as accounts are asked for."""
    window = params.spray_window_sec
    rows = _rows_of("password_spray", events, params)
    return _grid(rows, "ip", window, step_sec or max(1, window // 4), delay,
                 max(2, params.spray_threshold // 2))


def enumeration_candidates(
    events: DataFrame, params: Params = Params(), delay: str = "10 minutes",
    step_sec: int | None = None,
) -> DataFrame:
    """Addresses that may probe for account names."""
    window = params.brute_force_window_sec
    rows = _rows_of("enumeration", events, params)
    return _grid(rows, "ip", window, step_sec or max(1, window // 4), delay,
                 params.enumeration_threshold)


def confirm(
    candidates: DataFrame, events: DataFrame, params: Params = Params(),
    distinct: bool | None = None, window_sec: int | None = None, least: int | None = None,
    detector: str = "brute_force",
) -> DataFrame:
    """Exact peaks of candidate stretches: a batch of candidates of a detector
    against the stored events it looks at, for use in foreachBatch.  Gives `ip,
    window_start, peak, peak_start` where the peak reaches `least`."""
    spray = detector == "password_spray"
    distinct = spray if distinct is None else distinct
    window = window_sec or (params.spray_window_sec if spray else params.brute_force_window_sec)
    least = least or {
        "brute_force": params.brute_force_threshold, "password_spray": max(2, params.spray_threshold // 2),
        "enumeration": params.enumeration_threshold,
    }[detector]
    rows = _rows_of(detector, events, params).select("ip", "user", "ts")
    # the window is part of the join key, so an address meets the events of its own
    # stretches only; times that overlapping stretches share are kept for each of them
    cell = window * SECOND
    start, end = micros(F.col("window_start")), micros(F.col("window_end"))
    stretches = candidates.select("ip", "window_start", "window_end").distinct().select(
        "ip", "window_start", "window_end", F.explode(F.sequence(
            F.floor(start / cell), F.floor((end - 1) / cell))).alias("cell"))
    inside = rows.withColumn("cell", F.floor(micros(F.col("ts")) / cell)).join(
        stretches, ["ip", "cell"]
    ).filter(
        (F.col("ts") >= F.col("window_start")) & (F.col("ts") < F.col("window_end"))
    ).select(
        F.struct("ip", "window_start").alias("stretch"), "user", micros(F.col("ts")).alias("t")
    )
    peaks = peak_window(
        inside, "stretch", "t", window * SECOND, params.slice_sec * SECOND,
        distinct="user" if distinct else None,
    )
    return peaks.filter(F.col("peak") >= least).select(
        "stretch.ip", "stretch.window_start", "peak",
        F.timestamp_micros("peak_start").alias("peak_start"),
    )


def failed_sudo_counts(
    events: DataFrame, params: Params = Params(), window_sec: int = 3600,
    delay: str = "10 minutes",
) -> DataFrame:
    """Users with repeated failed sudo in a tumbling window."""
    rows = privilege_pattern(drop_listed(events, "user", params.allowed_users)).filter(
        F.col("pattern") == "failed_sudo"
    )
    return (
        rows.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{window_sec} seconds"), "user")
        .agg(F.count(F.lit(1)).alias("failed_count"))
        .filter(F.col("failed_count") >= params.failed_sudo_threshold)
        .select("user", F.col("window.start").alias("window_start"), "failed_count")
    )


def login_findings(events: DataFrame, params: Params = Params()) -> DataFrame:
    """Findings of successful logins; stateless."""
    return auth_success(events, params).findings


def followed_by_login(
    attacks: DataFrame, logins: DataFrame, window_sec: int, delay: str = "10 minutes",
) -> DataFrame:
    """Attacks (`ip, first_seen`) followed by a login (`ip, ts, user`) from the
    same address within the window; each address is reported once while the
    watermark holds it.  Equal attack rows count once, so give findings or
    coarse times, not single failures."""
    a = attacks.select(F.col("ip").alias("attack_ip"), F.col("first_seen").alias("attack_time"))
    b = logins.select("ip", F.col("ts").alias("login_time"))
    a = a.withWatermark("attack_time", delay).dropDuplicates(["attack_ip", "attack_time"])
    b = b.withWatermark("login_time", delay)
    within = F.expr(
        "attack_ip = ip AND login_time >= attack_time "
        f"AND login_time <= attack_time + INTERVAL {int(window_sec)} SECONDS"
    )
    # a stream may carry one event time only: the attack time becomes a value
    return (
        a.join(b, within).select(
            F.lit("brute_then_success").alias("rule_id"), "ip", "login_time",
            F.timestamp_micros(F.unix_micros("attack_time")).alias("attack_time"),
        )
        .dropDuplicatesWithinWatermark(["rule_id", "ip"])
        .select("rule_id", "ip", "attack_time", "login_time")
    )


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Run a stream over all input there is and give what it wrote, as a table.
    `folder` keeps the output and the state, so a later call goes on from
    there."""
    query = (
        stream.writeStream.format("parquet").outputMode(mode)
        .option("checkpointLocation", f"{folder}/state")
        .option("path", f"{folder}/rows")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/rows")
