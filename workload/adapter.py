"""Log text made from the driver's `events` table.

The table has no log lines, so each of its rows is rendered as one line of a
format; the same rendering is written in SQL in `oracles.py`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.storage import stored
from palisade.sources.lines import spread
from palisade.sources.syslog import parse_syslog

YEAR = 2024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def base(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    return with_actors(spread(table(spark, sf_dir, "events")), daily)


def with_actors(events: DataFrame, daily: bool = False) -> DataFrame:
    """Events with an address, a user and a host.  `daily` gives every day its
    own addresses, so that findings are spread over the whole month."""
    second = F.dayofmonth("ts") if daily else F.lit(0)
    return events.select(
        "event_id", "event_type", "props",
        F.col("ts").cast("timestamp").alias("ts"),
        F.concat_ws(
            ".", F.lit("10"), second, F.col("user_id") % 4, F.col("user_id") % 20
        ).alias("ip"),
        F.concat(F.lit("u"), F.col("event_id") % 23).alias("user"),
        F.concat(F.lit("h"), F.col("user_id") % 5).alias("host"),
    )


def _by_number(*choices: tuple[int, Column]) -> Column:
    nr = F.col("event_id") % 8
    chain = F
    for n, value in choices[:-1]:
        chain = chain.when(nr == n, value)
    return chain.otherwise(choices[-1][1])


def _text(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def syslog_lines(df: DataFrame) -> DataFrame:
    """One auth.log line per event; some have blanks around them, some no
    header, some are blank."""
    u, ip, kind = F.col("user"), F.col("ip"), F.col("event_type")
    command = _text(u, " : TTY=pts/0 ; PWD=/home/", u, " ; USER=root ; COMMAND=")
    failed = _text(u, " : authentication failure ; rhost= user=", u)
    purchase = _by_number(
        (0, _text(command, "/bin/bash")), (1, _text(command, "/usr/bin/systemctl")),
        (2, _text(command, "/usr/bin/cat /etc/shadow")), (3, _text(command, "/usr/bin/ls")),
        (4, failed), (5, failed),
        (6, _text("Successful su for root by ", u)), (7, _text("usermod: add to group ", u)),
    )
    program = _by_number(
        (0, F.lit("sudo")), (1, F.lit("sudo")), (2, F.lit("sudo")), (3, F.lit("sudo")),
        (4, F.lit("sudo")), (5, F.lit("sudo")), (6, F.lit("su")), (7, F.lit("usermod")),
    )
    message = (
        F.when(kind == "error", _text("Failed password for ", u, " from ", ip, " port 22 ssh2"))
        .when(kind == "view", _text("Invalid user ", u, " from ", ip, " port 22"))
        .when(kind == "click", _text("Accepted password for ", u, " from ", ip, " port 22 ssh2"))
        .when(kind == "signup", _text("new user: name=", u, ", UID=1"))
        .otherwise(purchase)
    )
    process = (
        F.when(kind.isin("error", "view", "click"), F.lit("sshd"))
        .when(kind == "signup", F.lit("useradd")).otherwise(program)
    )
    stamp = F.concat(
        F.date_format("ts", "MMM"), F.lit(" "), F.lpad(F.dayofmonth("ts").cast("string"), 2, " "),
        F.lit(" "), F.date_format("ts", "HH:mm:ss"),
    )
    line = _text(
        stamp, " ", F.col("host"), " ", process, "[", F.col("event_id").cast("string"), "]: ",
        message,
    )
    nr = F.col("event_id")
    return df.select(
        "event_id", F.lit("events").alias("source"),
        F.when(nr % 40 == 7, _text("  ", line, "\t "))
        .when(nr % 60 == 11, message)
        .when(nr % 90 == 13, F.lit("   "))
        .otherwise(line).alias("value"),
    )


def log_events(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """The table as log lines, parsed."""
    return parse_syslog(syslog_lines(base(spark, sf_dir, daily)), YEAR)


def stored_events(spark: SparkSession, sf_dir: str, daily: bool = False) -> DataFrame:
    """The same, written once, as several detectors read it."""
    return stored(log_events(spark, sf_dir, daily))


def cef_lines(df: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    name = (
        F.when(kind == "error", "Console logon failure").when(kind == "view", "Portal request denied")
        .when(kind == "click", "Console logon success").when(kind == "signup", "Helpdesk user created")
        .otherwise("Privilege grant")
    )
    nr = F.col("event_id")
    millis = F.unix_millis("ts").cast("string")
    level = F.when(nr % 12 == 11, F.lit("High")).otherwise((nr % 12).cast("string"))
    ext = _text(
        F.when(nr % 3 == 0, F.lit("shost=gw1 src=")).otherwise(F.lit("src=")), F.col("ip"),
        " suser=", F.col("user"), " dst=192.168.0.1 msg=code\\=",
        (nr % 7).cast("string"), " of ", kind, "  rt=", millis, " act=", kind,
    )
    leef = _text(
        "LEEF:1.0|Halden|Lookout|4.0|", kind, "|sev=", (nr % 11).cast("string"), "\tsrc=",
        F.col("ip"), "\tusrName=", F.col("user"), "\tdst=", F.col("host"), "\tnote=a=b",
    )
    cef = _text("CEF:0|Northgate|Porter|2.11|", (nr % 100).cast("string"), "|", name, "|", level, "|", ext)
    return df.select(
        "event_id", F.lit("events").alias("source"),
        F.when(nr % 5 == 4, leef).when(nr % 50 == 3, _text("Jan  1 00:00:00 gw ", cef))
        .when(nr % 70 == 5, F.lit("CEF:0|too|short")).otherwise(cef).alias("value"),
    )


def json_lines(df: DataFrame) -> DataFrame:
    nr = F.col("event_id")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    level = F.element_at(
        F.array(*[F.lit(x) for x in ("error", "WARN", "info", "fatal", "odd", "debug", "notice")]),
        (nr % 7 + 1).cast("int"),
    )
    full = _text(
        '{"timestamp":"', stamp, 'Z","host":"', F.col("host"), '","service":"', F.col("event_type"),
        '","level":"', level, '","message":"m ', nr.cast("string"), '","user":"', F.col("user"),
        '","ip":"', F.col("ip"), '","pid":', (nr % 9).cast("string"), ',"props":',
        F.col("props"), "}",
    )
    other = _text(
        '{"time":"', stamp, ".", F.date_format("ts", "SSS"), '","hostname":"', F.col("host"),
        '","app":"x","loglevel":"', level, '","event":"e ', nr.cast("string"),
        '","username":"","src_ip":"', F.col("ip"), '"}',
    )
    return df.select(
        "event_id", F.lit("events").alias("source"),
        F.when(nr % 30 == 17, F.lit("not json")).when(nr % 2 == 0, full).otherwise(other)
        .alias("value"),
    )


def windows_documents(df: DataFrame) -> DataFrame:
    nr, kind, u, ip = F.col("event_id"), F.col("event_type"), F.col("user"), F.col("ip")
    code = (
        F.when(kind == "error", "4625").when(kind == "view", "4776").when(kind == "click", "4624")
        .when(kind == "signup", "4720")
        .otherwise(F.when(nr % 2 == 0, "4688").otherwise("4732"))
    )

    def item(name, value):
        return _text(f'<Data Name="{name}">', value, "</Data>")

    account = F.when(nr % 13 == 5, F.concat(u, F.lit("$"))).otherwise(u)
    address = F.when(nr % 11 == 3, F.lit("-")).otherwise(ip)
    return df.select(
        "event_id", F.lit("events").alias("source"),
        _text(
            '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>',
            code, '</EventID><TimeCreated SystemTime="',
            F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), '.000000000Z"/><Computer>', F.col("host"),
            "</Computer></System><EventData>",
            item("TargetUserName", account), item("IpAddress", address),
            item("LogonType", (nr % 12).cast("string")), item("SubjectUserName", u),
            item("NewProcessName", F.lit("C:\\x.exe")), item("MemberName", u),
            "</EventData></Event>",
        ).alias("value"),
    )


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Address ranges with gaps, one per nation."""
    n = F.col("n_nationkey").cast("bigint")
    start = F.lit(10 * 256 ** 3) + (n % 4) * 256 + F.floor(n / 4) * 4
    return table(spark, sf_dir, "nation").select(
        start.alias("start_ip"), (start + 2).alias("end_ip"),
        F.substring("n_name", 1, 2).alias("country"), F.col("n_name").alias("country_name"),
        F.lower("n_name").alias("city"), n.cast("double").alias("latitude"),
        (-n).cast("double").alias("longitude"),
        (n + 64512).cast("int").alias("asn"), F.concat(F.lit("net "), F.col("n_name")).alias("asn_org"),
    )
