import random
from datetime import timedelta

from pyspark.sql import functions as F

from fixtures import AUTH_LOG, T0, event, events_frame, lines_frame
from palisade import Params
from palisade.operators.sources_of_attack import brute_force
from palisade.schema import EVENTS
from palisade.sources.syslog import parse_syslog
from palisade.streaming import jobs


def stream_of(spark, folder, batches):
    """Batches of events as files that a stream reads one after another."""
    for i, rows in enumerate(batches):
        events_frame(spark, rows).coalesce(1).write.parquet(f"{folder}/in/b{i}")
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")


def close(rows, hours=100):
    """A late event that moves the watermark past everything before it."""
    return [rows, [event(99_999, sec=hours * 3600, ip="end", user="end")]]


def test_parse_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(4):
        (tmp_path / "in" / f"{i}.log").write_text("\n".join(AUTH_LOG[i * 10:(i + 1) * 10]))
    lines = jobs.read_line_stream(spark, str(tmp_path / "in"), maxFilesPerTrigger=1)
    got = jobs.drain(parse_syslog(lines, 2024), str(tmp_path / "out"))
    want = parse_syslog(lines_frame(spark, AUTH_LOG), 2024)
    pick = lambda df: sorted(df.select("event_type", "ts", "user", "ip", "raw").collect(), key=str)
    assert pick(got) == pick(want) and len(pick(got)) == 32


def test_candidates_miss_nothing(spark, tmp_path):
    rnd = random.Random(5)
    rows = [event(i, sec=rnd.randint(0, 20_000), ip=rnd.choice("abcdef"), user=f"u{i % 7}",
                  message="Invalid user x") for i in range(90)]
    rows += [event(200 + i, sec=None, ip="a") for i in range(9)]
    rows.sort(key=lambda r: (r["ts"] is None, r["ts"] or T0))
    stream = stream_of(spark, tmp_path, [rows[:40], rows[40:70], rows[70:], close([])[1]])
    timed, untimed = jobs.split_timed(stream)
    params = Params(brute_force_window_sec=1200, spray_window_sec=1200, spray_threshold=6)
    found = jobs.drain(jobs.brute_force_candidates(timed, params, "1 hour", 300), str(tmp_path / "a"))
    stored = events_frame(spark, rows)
    exact = {
        (r.source_ips[0], r.metadata["burst_start"]): int(r.metadata["burst_count"])
        for r in brute_force(stored, params).findings.collect()
        if int(r.metadata["burst_count"]) >= 5
    }
    confirmed = jobs.confirm(found, stored, params).collect()
    best = {}
    for r in confirmed:
        best[r.ip] = max(best.get(r.ip, 0), r.peak)
    assert exact and best == {ip: n for (ip, _), n in exact.items()}
    assert all(r.peak_start >= r.window_start for r in confirmed)
    users = jobs.drain(jobs.enumeration_candidates(timed, params, "1 hour", 300), str(tmp_path / "b"))
    assert {r.ip for r in users.collect()} >= {ip for ip, _ in exact}
    sprays = jobs.drain(jobs.password_spray_candidates(timed, params, "1 hour", 300), str(tmp_path / "c"))
    assert sprays.filter("events < 3").count() == 0
    assert jobs.confirm(sprays, stored, params, window_sec=1200, least=4, detector="password_spray").count() > 0
    assert jobs.drain(untimed, str(tmp_path / "d")).count() == 9


def test_failed_sudo_and_logins(spark, tmp_path):
    def failed(i, sec, user):
        return event(i, "sudo", sec=sec, ip=None, user=user, message=f"{user} : incorrect password")
    rows = [failed(i, i, "bob") for i in range(3)] + [failed(10 + i, i, "nagios") for i in range(4)]
    rows += [failed(20, 0, "eve"), failed(21, 7200, "eve"), failed(22, 7201, "eve")]
    rows += [event(30, "auth_success", user="bob"), event(31, "auth_success", ip="9.9.9.9")]
    late = [failed(40, 360_000, "end")]
    allowed = spark.createDataFrame([("nagios",)], "user string")
    stream = stream_of(spark, tmp_path, [rows, late])
    params = Params(allowed_users=allowed, allowed_ips=("9.9.9.9",))
    got = jobs.drain(jobs.failed_sudo_counts(stream, params), str(tmp_path / "a")).collect()
    assert [(r.user, r.failed_count, r.window_start) for r in got] == [("bob", 3, T0)]
    logins = jobs.drain(jobs.login_findings(stream, params), str(tmp_path / "b")).collect()
    assert [r.finding_id for r in logins] == ["auth_success|30"]


def test_followed_by_login(spark, tmp_path):
    rows = [event(1, sec=0, ip="a"), event(2, sec=5, ip="a"), event(3, sec=0, ip="b"),
            event(4, sec=900, ip="c")]
    later = [event(10, "auth_success", sec=300, ip="a"), event(11, "auth_success", sec=301, ip="a"),
             event(12, "auth_success", sec=601, ip="b"), event(13, "auth_success", sec=800, ip="c")]
    stream = stream_of(spark, tmp_path, [rows, later])
    attacks = stream.filter("event_type = 'auth_failure'").select("ip", F.col("ts").alias("first_seen"))
    logins = stream.filter("event_type = 'auth_success'")
    got = jobs.drain(jobs.followed_by_login(attacks, logins, 600, "1 hour"), str(tmp_path / "a")).collect()
    assert [(r.rule_id, r.ip) for r in got] == [("brute_then_success", "a")]


def test_drain_goes_on(spark, tmp_path):
    stream = stream_of(spark, tmp_path, [[event(1, "auth_success")]])
    out = str(tmp_path / "out")
    assert jobs.drain(jobs.login_findings(stream), out).count() == 1
    events_frame(spark, [event(2, "auth_success", sec=9)]).write.parquet(f"{tmp_path}/in/later")
    assert jobs.drain(jobs.login_findings(stream), out).count() == 2


def test_confirm_looks_at_the_rows_of_its_detector(spark):
    rows = [event(i, sec=10 * i, ip="a", message="Invalid user x") for i in range(6)]
    rows += [event(50 + i, sec=5 * i, ip="a", user=None, message="Failed password") for i in range(14)]
    stored = events_frame(spark, rows)
    stretch = spark.createDataFrame(
        [("a", T0 - timedelta(seconds=60), T0 + timedelta(seconds=1800))], "ip string, window_start timestamp, window_end timestamp")
    peak = lambda **k: [r.peak for r in jobs.confirm(stretch, stored, **k).collect()]
    assert peak() == [20] and peak(detector="enumeration") == [6]
    assert peak(detector="password_spray", least=1) == [1]
