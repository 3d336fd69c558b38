"""Choose the parser of a path and load events from files."""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.plans.storage import stored
from palisade.sources import csvlog, jsonlog, winxml
from palisade.sources.cef import parse_cef_leef
from palisade.sources.lines import lines_with_ids, read_documents, read_lines
from palisade.sources.places import placed_lines
from palisade.sources.syslog import classified, parse_syslog
from palisade.schema import EVENTS, conform

FORMATS = ("json", "jsonl", "json_document", "csv", "tsv", "windows_xml", "cef", "syslog")


def format_of(path: str) -> str:
    """Format by file name.  Endings that say nothing about the format
    (compression, `.sample`) are ignored; the default is syslog."""
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    name = re.sub(r"(\.(gz|bz2|sample))+$", "", name)
    suffix = name.rsplit(".", 1)[-1] if "." in name else ""
    if suffix in ("jsonl", "ndjson"):
        return "jsonl"
    if suffix in ("json", "csv", "tsv"):
        return suffix
    if suffix in ("xml", "evtx_xml"):
        return "windows_xml"
    if "cef" in name or "leef" in name:
        return "cef"
    return "syslog"


FEW_FILES = 100_000


def _load_json(spark: SparkSession, path) -> DataFrame:
    """Each `.json` file is read by lines unless its own first line is not a whole
    object by itself, so a folder may hold files of both kinds."""
    placed = placed_lines(spark, path)
    whole = F.from_json("first", "map<string,string>").isNotNull() & F.startswith(
        F.btrim("first"), F.lit("{"))
    layout = (
        placed.filter(F.btrim("value") != "").groupBy("source")
        .agg(F.min_by("value", "offset").alias("first"))
        .select("source", F.coalesce(whole, F.lit(False)).alias("by_line"))
    )
    layout = stored(layout)
    few = layout.limit(FEW_FILES + 1).count() <= FEW_FILES
    if few:
        layout = F.broadcast(layout)  # a row per file, counted
    events = jsonlog.parse_json_lines(
        lines_with_ids(placed.join(layout.filter("by_line"), "source", "left_semi")))
    whole_files = layout.filter("not by_line").select("source")
    if few:  # only documents are read as a whole: a file of lines may be far too large for a row
        paths = [unquote(r["source"]) for r in whole_files.collect()]
        documents = read_documents(spark, paths) if paths else None
    else:
        documents = read_documents(spark, path).join(whole_files, "source", "left_semi")
    return events if documents is None else events.unionByName(jsonlog.parse_json_documents(documents))


def load_events(
    spark: SparkSession, path: str, fmt: str | None = None,
    year: int | None = None, classify: bool = False,
) -> DataFrame:
    """Events of one file, folder or glob.  `classify` also applies the syslog
    message rules to formats whose events are otherwise always generic."""
    fmt = fmt or format_of(path)
    if fmt not in FORMATS:
        raise ValueError(f"unknown format: {fmt}")
    if fmt == "json":
        events = _load_json(spark, path)
    elif fmt == "jsonl":
        events = jsonlog.parse_json_lines(read_lines(spark, path))
    elif fmt == "json_document":
        events = jsonlog.parse_json_documents(read_documents(spark, path))
    elif fmt in ("csv", "tsv"):
        events = csvlog.parse_csv(csvlog.read_csv(spark, path, "\t" if fmt == "tsv" else ","))
    elif fmt == "windows_xml":
        events = winxml.parse_windows_xml(
            winxml.records(read_lines(spark, path, line_sep=winxml.RECORD_END))
        )
    elif fmt == "cef":
        events = parse_cef_leef(read_lines(spark, path))
    else:
        events = parse_syslog(read_lines(spark, path), year)
    return reclassify(events) if classify else events


def load_many(spark: SparkSession, paths: list[str], **options) -> DataFrame:
    """Events of any number of paths of any formats.  The ids of different paths are
    kept apart by a hash of the path and the id."""
    frames = [
        load_events(spark, p, **options).withColumn(
            "event_id", F.xxhash64(F.lit(p), F.col("event_id"))
        )
        for p in paths
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def reclassify(events: DataFrame) -> DataFrame:
    """Apply the syslog message rules to generic events; values that the
    format gave are kept where a rule gives none."""
    own = events.select(
        *[c for c in events.columns if c not in ("event_type", "severity", "user", "ip")],
        F.struct("event_type", "severity", "user", "ip").alias("own"),
    )
    found = classified(own)
    hit = (F.col("own.event_type") == "generic") & (F.col("event_type") != "generic")
    pick = {
        c: F.when(hit, F.coalesce(F.col(c), F.col(f"own.{c}"))).otherwise(F.col(f"own.{c}"))
        for c in ("event_type", "severity", "user", "ip")
    }
    return conform(found.select(
        *[c for c in found.columns if c not in (*pick, "own")],
        *[v.alias(k) for k, v in pick.items()],
    ), EVENTS)
