"""Findings and chains of a stream against those of the whole input at once."""

import random
from collections import Counter

from pyspark.sql import functions as F

from fixtures import event, events_frame
from palisade import Params, detect
from palisade.operators.correlate import BUILT_IN_RULES, SequenceRule, correlate
from palisade.schema import EVENTS
from palisade.streaming import jobs
from palisade.streaming.findings import StreamDetection
from palisade.streaming.late import Arrivals

PARAMS = Params(brute_force_threshold=4, brute_force_window_sec=900, spray_threshold=6, spray_window_sec=900,
                enumeration_threshold=3, failed_sudo_threshold=2, allowed_users=("nagios",), allowed_ips=("9.9.9.9",),
                priv_esc_per=("user",), slice_sec=60)
RULES = tuple(SequenceRule(**{**r.__dict__, "window_sec": 1800}) for r in BUILT_IN_RULES)


def random_events(seed, count=260):
    rnd = random.Random(seed)
    rows = []
    for i in range(count):
        sec = None if rnd.random() < 0.06 else rnd.randint(0, 9_000)
        ip, user = rnd.choice(["1.1.1.1", "2.2.2.2", "3.3.3.3", "9.9.9.9", "4.4.4.4", None]), f"u{rnd.randint(0, 8)}"
        kind = rnd.choice(["auth_failure"] * 5 + ["auth_success", "sudo", "su", "user_created", "group_change", "other"])
        message = {"auth_failure": rnd.choice(["Failed password", "Invalid user x"]),
                   "sudo": rnd.choice([f"{user} : COMMAND=/bin/bash", f"{user} : COMMAND=/bin/ls", f"{user} : incorrect password"]),
                   }.get(kind, "text")
        if kind == "other":
            kind = "unknown"
        rows.append(event(i, kind, sec=sec, ip=ip, user=rnd.choice([user, user, user, None, "nagios"]), message=message))
    return rows


def pick(df, columns):
    return Counter(tuple(str(r[c]) for c in columns) for r in df.collect())


FINDING = ["finding_id", "rule_id", "severity", "confidence", "title", "description", "first_seen", "last_seen",
           "event_count", "n_source_ips", "n_users", "source_ips", "users", "metadata"]


def same(stream, whole):
    got, want = stream.detections(), detect(whole, PARAMS)
    assert pick(got.findings, FINDING) == pick(want.findings, FINDING)
    columns = ["finding_id", "event_id", "ts", "ip", "user"]
    assert pick(got.evidence, columns) == pick(want.evidence, columns)
    return want


def test_stream_equals_batch(spark, tmp_path):
    rows = random_events(1)
    rows = sorted(rows[:170], key=lambda r: str(r["ts"])) + rows[170:]  # the last ones come late
    cuts = [0, 170, 260]
    for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
        events_frame(spark, rows[a:b]).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    stream = StreamDetection(spark, str(tmp_path / "out"), PARAMS, RULES)
    stream.run(events)
    whole = events_frame(spark, rows)
    want = same(stream, whole)
    assert {r["rule_id"] for r in want.findings.collect()} >= {"brute_force", "password_spray", "enumeration", "priv_esc"}
    chains = correlate(want, PARAMS, RULES, mode="keyed")
    got = stream.correlation()
    assert pick(got.links, ["finding_id", "rule_id", "position", "member_id"]) == pick(
        chains.links, ["finding_id", "rule_id", "position", "member_id"])
    assert pick(got.findings, FINDING) == pick(chains.findings, FINDING)
    assert len({r["rule_id"] for r in got.links.collect()}) >= 3
    # more input, and a second try of the last batch, as after a crash
    more = [event(1000 + i, sec=9_000 + i, ip="5.5.5.5", user=f"x{i}") for i in range(8)]
    events_frame(spark, more).coalesce(1).write.parquet(f"{tmp_path}/in/later")
    StreamDetection(spark, str(tmp_path / "out"), PARAMS, RULES).run(events)
    stream.advance(events_frame(spark, more), 2)
    same(stream, events_frame(spark, rows + more))


def test_no_events(spark, tmp_path):
    stream = StreamDetection(spark, str(tmp_path), PARAMS)
    stream.advance(events_frame(spark, []), 0)
    assert stream.detections().findings.count() == 0 and stream.correlation().links.count() == 0


def test_late_rows_are_kept(spark, tmp_path):
    """What the watermark of tumbling windows drops is what is put aside."""
    rnd = random.Random(4)
    batches = [[event(100 * b + i, sec=None if i % 9 == 0 else b * 2_000 + rnd.randint(-3_000, 2_000)) for i in range(60)]
               for b in range(4)] + [[event(999, sec=10**6)]]
    for i, rows in enumerate(batches):
        events_frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/b{i}")
    events = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    kept = Arrivals(spark, str(tmp_path / "out"), EVENTS, 600, 300)
    kept.run(events)
    parts = {a: [r["event_id"] for r in kept.part(a).collect()] for a in ("in_time", "late", "untimed")}
    assert sorted(x for p in parts.values() for x in p) == sorted(r["event_id"] for b in batches for r in b)
    assert len(parts["late"]) > 5 and len(parts["untimed"]) == 28
    counted = jobs.drain(
        events.filter("ts is not null").withWatermark("ts", "600 seconds").groupBy(F.window("ts", "300 seconds")).count(),
        str(tmp_path / "counted"))
    assert sum(r["count"] for r in counted.collect()) == len(parts["in_time"]) - 1  # the last window is open
    before = kept.rows().count()
    kept.advance(events_frame(spark, batches[4]), 4)
    assert kept.rows().count() == before


def test_parts_of_a_stream_are_not_single_files(spark, tmp_path):
    """Each part is one batch, and is written by as many tasks as it has partitions."""
    from workload.queries import _run_parts
    seen = {}

    class Kept:
        def run(self, events):
            def keep(batch, number):
                rows = batch.select("event_id", F.input_file_name().alias("file")).collect()
                seen[number] = (sorted(r["event_id"] for r in rows), len({r["file"] for r in rows}))
            events.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "state")).trigger(
                availableNow=True).start().awaitTermination()

    rows = events_frame(spark, [event(i, sec=i) for i in range(40)]).repartition(4)
    _run_parts(spark, Kept(), rows, F.col("event_id") % 2, 2)
    assert {n: ids for n, (ids, _) in seen.items()} == {0: list(range(0, 40, 2)), 1: list(range(1, 40, 2))}
    assert min(files for _, files in seen.values()) > 1
