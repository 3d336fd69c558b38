"""Places of lines and records in files, under any split."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from palisade.sources import lines, load
from palisade.sources.csvlog import parse_csv, read_csv
from palisade.sources.lines import read_documents, read_lines
from palisade.sources.load import load_events
from palisade.sources.places import placed_lines
from workload import queries


@pytest.fixture(params=["256", "128m"])
def split(spark, request):
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "0" if request.param == "256" else "4m")
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_offsets(spark, tmp_path, split):
    rnd = random.Random(3)
    texts = {}
    for name in ("a.log", "b c.log", "e.log"):
        lines = ["é" * rnd.randint(0, 40) + "x" * rnd.randint(0, 30) + rnd.choice(["", "\r"]) for _ in range(120)]
        texts[name] = "\n".join(lines) + rnd.choice(["", "\n"])
        (tmp_path / name).write_bytes(texts[name].encode())
    got = placed_lines(spark, str(tmp_path / "*.log"))
    assert split != "256" or got.select("block").distinct().count() > 20
    for name, text in texts.items():
        data = text.encode()
        own = sorted((r["offset"], r["value"]) for r in got.filter(got["source"].endswith(name.replace(" ", "%20"))).collect())
        assert [v for _, v in own] == (text[:-1] if text.endswith("\n") else text).split("\n")
        assert all(data[o:o + len(v.encode())] == v.encode() for o, v in own)


def test_totals_are_taken_once(spark, tmp_path):
    """The sums of the splits are stored, so reading the lines goes over the text once more, not twice."""
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(50)))
    got = placed_lines(spark, str(tmp_path / "a.log"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("] text") == 1
    assert [r["offset"] for r in got.filter("value in ('line 0', 'line 1', 'line 10')").orderBy("offset").collect()] == [0, 7, 70]


def test_ids_do_not_depend_on_splits_or_other_files(spark, tmp_path):
    (tmp_path / "a.log").write_text("".join(f"line {i}\n" for i in range(200)) + "one\rtwo\r\n\nlast")
    read = lambda: sorted((r["event_id"], r["value"]) for r in read_lines(spark, str(tmp_path / "*.log")).collect())
    once = read()
    assert [v for _, v in once][:201] == [*[f"line {i}" for i in range(200)], "one"] and len({i for i, _ in once}) == len(once)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    assert read() == once
    (tmp_path / "0.log").write_text("first by name\n" * 30)
    assert set(once) < set(read())
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_records(spark, tmp_path, split):
    rnd = random.Random(8)
    rows = [["host", "message", "user", "note"]]
    for i in range(150):
        text = rnd.choice(["plain", "with, comma", 'a "quoted" word', "two\nlines", "three\n\nlines, \"all\"", ""])
        rows.append([f"h{i}", text, f"u{i % 7}", rnd.choice(["x", "y\nz"])])
    with open(tmp_path / "log.csv", "w", newline="") as f:
        csv.writer(f, lineterminator=rnd.choice(["\n", "\r\n"])).writerows(rows)
    with open(tmp_path / "log.csv", "a") as f:
        f.write("\n\nh150,end,u,v")
    read = read_csv(spark, str(tmp_path / "log.csv"))
    got = sorted(read.collect(), key=lambda r: r["line_number"])
    with open(tmp_path / "log.csv") as f:  # universal line ends
        want = list(csv.DictReader(f))
    assert len(got) == len(want) == 151
    for number, (r, w) in enumerate(zip(got, want), 1):
        assert r["line_number"] == number and {k: r[k] or "" for k in w} == w
    assert len({r["event_id"] for r in got}) == 151
    events = parse_csv(read)
    assert {e["metadata"]["line_number"] for e in events.collect()} == {str(i) for i in range(1, 152)}


def test_json_folder_reads_only_documents_whole(spark, tmp_path, monkeypatch):
    asked = []
    monkeypatch.setattr(load, "read_documents", lambda spark, paths: asked.extend(paths) or read_documents(spark, paths))
    (tmp_path / "lines.json").write_text("".join('{"msg":"m%d"}\n' % i for i in range(50)))
    (tmp_path / "one doc.json").write_text('[{"msg":"a"},\n {"msg":"b"}]')
    events = load_events(spark, str(tmp_path / "*.json"))
    assert events.count() == 52
    assert [p.rsplit("/", 1)[-1] for p in asked] == ["one doc.json"]


def test_gz(spark, tmp_path):
    import gzip

    with gzip.open(tmp_path / "a.log.gz", "wt") as f:
        f.write("".join(f"Apr  9 08:00:{i:02d} h sshd[1]: Failed password for u{i} from 1.2.3.4 port 1 ssh2\n" for i in range(40)))
    events = load_events(spark, str(tmp_path / "a.log.gz"), year=2024)
    assert events.count() == 40 and events.select("event_id").distinct().count() == 40


@pytest.mark.parametrize("broken", [None, "other ids", "more lines", "equal ids", "ids by partition"])
def test_both_reads_count_in_files_ids(spark, tmp_path, monkeypatch, broken):
    """The query that reads log lines under two split sizes shows where the ids of the second read differ."""
    spark.range(12_000).selectExpr(
        "id AS event_id", "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS ts", "id % 70 AS user_id",
        "element_at(array('error', 'view', 'click', 'signup'), cast(id % 4 + 1 AS int)) AS event_type",
        "1.0D AS value", "'{}' AS props").write.parquet(f"{tmp_path}/events.parquet")
    reads = []

    def read(*args, **options):
        reads.append(load_events(*args, **options))
        if len(reads) < 2 or broken in (None, "ids by partition"):
            return reads[-1]
        if broken == "more lines":
            return reads[-1].unionByName(reads[-1].withColumn("event_id", F.col("event_id") * 2))
        return reads[-1].withColumn("event_id", F.col("event_id") + 1 if broken == "other ids" else F.lit(7).cast("bigint"))

    monkeypatch.setattr(queries, "load_events", read)
    if broken == "ids by partition":
        monkeypatch.setattr(lines, "event_id", lambda df, source, text: F.monotonically_increasing_id())
    got = {r["message"]: r["lines"] for r in queries.files_ids(spark, str(tmp_path)).collect()}
    want = {r["message"]: r["count"] for r in reads[0].groupBy("message").count().collect()}
    assert len(reads) == 2 and max(want.values()) > 1 and got.keys() == want.keys()
    if broken is None:
        assert got == want
    else:
        assert sum(got[m] == n for m, n in want.items()) < len(want) / 2
