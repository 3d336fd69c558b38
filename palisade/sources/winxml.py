"""Windows Security event XML -> events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade import fixed_values as fixed
from palisade.functions.text import blank_to_null, computed, strip
from palisade.sources.lines import events_of, stripped

# reading text with this separator gives one event per row
RECORD_END = "</Event>"

_LAYOUT = (
    "struct<System: struct<EventID: string, TimeCreated: struct<_SystemTime: string>, "
    "Computer: string>, EventData: struct<Data: array<struct<_Name: string, _VALUE: string>>>>"
)


def records(chunks: DataFrame) -> DataFrame:
    """Chunks of a file cut at the end of each event -> one whole `<Event>`
    element per row.  What stands before the element is dropped."""
    return chunks.withColumn(
        "value", F.regexp_extract("value", r"(?s)<Event(?=[\s>]).*", 0)
    ).filter(F.col("value") != "").withColumn(
        "value", F.concat("value", F.lit(RECORD_END))
    )


def _data(name: str) -> Column:
    """Text of the first Data element with a name, null when empty."""
    found = F.filter("data", lambda d: d["_Name"] == name)
    return blank_to_null(strip(F.get(found, 0)["_VALUE"]))


def _or_unknown(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def _without_placeholder(c: Column) -> Column:
    return F.when(~c.isin(*fixed.WINDOWS_PLACEHOLDERS), c)


def record_time(text: Column) -> Column:
    """ISO time; a fraction and its Z are cut off first."""
    plain = F.replace(F.regexp_replace(text, r"\.\d+Z?$", ""), F.lit("T"), F.lit(" "))
    return F.when(
        plain.rlike(r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$"),
        F.try_to_timestamp(F.regexp_replace(plain, r"\s+", " "), F.lit("yyyy-M-d H:m:s")),
    )


def parse_windows_xml(documents: DataFrame) -> DataFrame:
    """Rows with one `<Event>` element each in `value`.  A record that is not
    well-formed or has no event id is dropped; machine accounts are dropped
    from the logon events."""
    df = computed(
        stripped(documents), "x",
        F.from_xml("line", _LAYOUT, {"ignoreNamespace": "true", "mode": "PERMISSIVE"}),
    )
    df = df.select(
        "event_id", "source", F.col("line").alias("raw"),
        strip(F.col("x.System.EventID")).try_cast("int").alias("code"),
        F.col("x.System.TimeCreated._SystemTime").alias("time"),
        F.coalesce(strip(F.col("x.System.Computer")), F.lit("")).alias("host"),
        F.coalesce("x.EventData.Data", F.array().cast("array<struct<_Name:string,_VALUE:string>>"))
        .alias("data"),
    ).filter(F.col("code").isNotNull())

    code = F.col("code")
    logon = code.isin(4624, 4625, 4776)
    target, subject = _data("TargetUserName"), _data("SubjectUserName")
    df = df.select(
        "event_id", "source", "raw", "code", "time", "host",
        target.alias("target"), subject.alias("subject"),
        F.when(logon, F.coalesce(target, subject)).when(code == 4688, subject)
        .when(code == 4720, target).when(code == 4732, _data("MemberName")).alias("who"),
        F.when(logon, F.coalesce(_data("IpAddress"), _data("WorkstationName"))).alias("where"),
        _data("LogonType").alias("logon_type"), _data("Status").alias("status"),
        _data("NewProcessName").alias("program"), _data("CommandLine").alias("command"),
    )
    who, where = _or_unknown(F.col("who")), _or_unknown(F.col("where"))
    type_names = F.create_map(*[
        F.lit(x) for pair in fixed.WINDOWS_LOGON_TYPES.items() for x in pair
    ])
    type_name = F.try_element_at(type_names, F.col("logon_type"))

    def when_filled(before: str, c: Column, after: str = "") -> Column:
        return F.coalesce(F.concat(F.lit(before), c, F.lit(after)), F.lit(""))

    head = F.concat(F.lit("EventID "), code.cast("string"))
    message = (
        F.when(logon, F.concat(
            head, F.lit(": "), F.when(code == 4625, "Failed").otherwise("Successful"),
            F.lit(" logon for "), who, F.lit(" from "), where,
            when_filled(" [", type_name, "]"), when_filled(" Status=", F.col("status")),
        ))
        .when(code == 4688, F.concat(
            head, F.lit(": Process created by "), who, F.lit(": "),
            F.coalesce("program", F.lit("")), when_filled(" | CMD: ", F.col("command")),
        ))
        .when(code == 4720, F.concat(
            head, F.lit(": User account created: "), who, F.lit(" by "),
            _or_unknown(F.col("subject")),
        ))
        .when(code == 4732, F.concat(
            head, F.lit(": "), who, F.lit(" added to group "), _or_unknown(F.col("target")),
        ))
        .otherwise(head)
    )

    def mapped(n: int, default: str) -> Column:
        chain = None
        for k, v in fixed.WINDOWS_EVENTS.items():
            chain = F.when(code == k, v[n]) if chain is None else chain.when(code == k, v[n])
        return chain.otherwise(default)

    user = _without_placeholder(F.col("who"))
    machine = F.endswith(user, F.lit("$")) & code.isin(4624, 4625)
    return events_of(
        df.filter(~F.coalesce(machine, F.lit(False))),
        event_type=mapped(0, "generic"),
        severity=mapped(1, "UNKNOWN"),
        ts=record_time(F.col("time")),
        host=F.col("host"),
        process=F.concat(F.lit("EventID-"), code.cast("string")),
        user=user,
        ip=_without_placeholder(F.col("where")),
        message=message,
        raw=F.col("raw"),
        metadata=F.create_map(F.lit("event_id"), code.cast("string")),
    )
