import gzip
from datetime import datetime

from fixtures import AUTH_LOG, lines_frame
from palisade.sources.cef import parse_cef, parse_cef_leef, parse_leef
from palisade.sources.csvlog import parse_csv, read_csv
from palisade.sources.jsonlog import parse_json_documents, parse_json_lines
from palisade.sources.load import format_of, load_events, load_many, reclassify
from palisade.sources.syslog import parse_syslog
from palisade.sources.winxml import parse_windows_xml


def rows(df):
    return df.orderBy("event_id").collect()


def syslog(spark, *lines, year=2024):
    return rows(parse_syslog(lines_frame(spark, lines), year))


def one(spark, line, year=2024):
    return syslog(spark, line, year=year)[0]


def test_scenario_types(spark):
    counts = dict(
        parse_syslog(lines_frame(spark, AUTH_LOG), 2024)
        .groupBy("event_type").count().collect()
    )
    assert counts == {
        "auth_failure": 24, "auth_success": 2, "session_open": 1, "sudo": 3,
        "user_created": 1, "session_close": 1,
    }


def test_syslog_fields(spark):
    r = one(spark, "  Jun  3 17:20:09 mx2 sshd[88]: Failed password for kim from 198.18.0.4 port 9 ssh2 ")
    assert (r.host, r.process, r.pid, r.user, r.ip) == ("mx2", "sshd", "88", "kim", "198.18.0.4")
    assert r.ts == datetime(2024, 6, 3, 17, 20, 9)
    assert r.severity == "ERROR" and r.event_type == "auth_failure"
    assert r.message == "Failed password for kim from 198.18.0.4 port 9 ssh2"
    assert r.raw.startswith("Jun  3") and r.raw.endswith("ssh2")


def test_syslog_without_header(spark):
    r = one(spark, "accepted PASSWORD for bob from 9.9.9.9")
    assert (r.host, r.process, r.pid, r.ts) == ("", "", None, None)
    assert (r.event_type, r.user, r.ip) == ("auth_success", "bob", "9.9.9.9")
    r = one(spark, "nothing to see")
    assert (r.event_type, r.severity, r.user, r.ip) == ("generic", "UNKNOWN", None, None)


def test_syslog_without_pid(spark):
    r = one(spark, "Feb 30 17:26:11 h su: Successful su for root by bob")
    assert (r.event_type, r.severity, r.user, r.pid, r.ts) == ("su", "WARNING", "root", None, None)


def test_syslog_bad_address_is_null(spark):
    r = one(spark, "Apr 10 1:2:3 h sshd[1]: Failed password for bob from 1.2.3.4.5 port 1")
    assert r.user == "bob" and r.ip is None and r.ts == datetime(2024, 4, 10, 1, 2, 3)


def test_syslog_rules_in_order(spark):
    got = [
        (r.event_type, r.severity, r.user, r.ip) for r in syslog(
            spark,
            "h sshd: authentication failure; user=joe rhost=7.7.7.7",
            "Apr 9 08:00:00 h sshd[1]: Invalid user joe from 7.7.7.7",
            "Apr 9 08:00:00 h sudo: pam_unix(sudo:auth): authentication failure; rhost= user=joe",
            "Apr 9 08:00:00 h sudo: joe : authentication failure ; rhost= user=joe",
            "Apr 9 08:00:00 h cron: joe : authentication failure ; rhost= user=joe",
            "Apr 9 08:00:00 h SUDO[9]: joe : TTY=x ; COMMAND=/bin/ls -l",
            "Apr 9 08:00:00 h sudo: pam_unix(sudo:session): session opened for user root by joe",
            "Apr 9 08:00:00 h sshd: session opened for user joe",
            "Apr 9 08:00:00 h sshd: Session Closed for user joe",
            "Apr 9 08:00:00 h userdel: delete user joe",
            "Apr 9 08:00:00 h usermod: usermod: add to group wheel, by root",
            "Apr 9 08:00:00 h usermod: add joe to group wheel",
        )
    ]
    assert got == [
        ("auth_failure", "ERROR", "joe", "7.7.7.7"),
        ("auth_failure", "WARNING", "joe", "7.7.7.7"),
        ("auth_failure", "ERROR", "joe", None),
        ("sudo", "WARNING", "joe", None),
        ("generic", "UNKNOWN", None, None),
        ("sudo", "INFO", "joe", None),
        ("su", "INFO", "root", None),
        ("session_open", "INFO", "joe", None),
        ("session_close", "INFO", "joe", None),
        ("user_deleted", "WARNING", "joe", None),
        ("group_change", "WARNING", "wheel", None),
        ("generic", "UNKNOWN", None, None),
    ]


CEF = [
    "CEF:0|Acme|Wall|2.0|L-17|Console login failed|8|app=vpn suser=kim cn1=3 src=198.18.7.7 msg=third wrong password in a row",
    "Apr 09 08:00:00 gw CEF:0|Acme|Wall|2.0|L-18|Console login success|3|src=host1 dst=192.168.1.10 duser=lena rt=1712649600123 dhost=srv9",
    "CEF:0|Acme|Wall|2.0|1|Deny tcp|10|act=denied msg=a\\=b\\nc  key=v k=1 k=2 bad=x=y end=oops start=1712649600000",
    "CEF:0|too|few|bars",
    "CEF:0|Acme|Wall|1|2|Privilege use|Emergency|shost=fw1",
    "LEEF:1.0|Beta|Probe|1.9|AuthFail|note=a=b\tusrName=kim\tsrc=198.18.3.3\tsev=8",
    "LEEF:1.0|Beta|Probe|1.9|X|severity=medium\tsrcIP=\tsuser=joe",
    "LEEF:1.0|Beta|Probe|1.9|Y|",
    "plain line",
]


def test_cef(spark):
    got = rows(parse_cef(lines_frame(spark, CEF)))
    assert [r.event_id for r in got] == [1, 2, 3, 5]
    a, b, c, d = got
    assert (a.event_type, a.severity, a.ip, a.user, a.ts) == ("auth_failure", "ERROR", "198.18.7.7", "kim", None)
    assert a.message == "[CEF] Acme/Wall | Console login failed | SigID=L-17 | src=198.18.7.7 | user=kim"
    assert a.process == "Acme/Wall" and a.metadata["ext.msg"] == "third wrong password in a row"
    assert (b.event_type, b.severity, b.ip, b.user, b.host) == ("auth_success", "INFO", "192.168.1.10", "lena", "srv9")
    assert b.ts == datetime(2024, 4, 9, 8, 0, 0, 123000)
    assert b.raw.startswith("Apr 09")
    assert (c.event_type, c.severity, c.user, c.ip) == ("generic", "CRITICAL", "denied", None)
    assert c.ts == datetime(2024, 4, 9, 8, 0, 0)
    assert c.metadata["ext.msg"] == "a=b\nc" and c.metadata["ext.k"] == "2"
    assert c.metadata["ext.x"] == "y" and "ext.bad" not in c.metadata
    assert (d.event_type, d.severity, d.host, d.message) == (
        "sudo", "ERROR", "fw1", "[CEF] Acme/Wall | Privilege use | SigID=2")


def test_cef_severity_steps(spark):
    lines = [f"CEF:0|a|b|c|d|e|{s}|k=v" for s in ("0", "1", "3", "4", "6", "7", "8", "9", " 9 ", "+7", "-2", "7.5", "Warning", "")]
    got = [r.severity for r in rows(parse_cef(lines_frame(spark, lines)))]
    assert got == ["DEBUG", "INFO", "INFO", "WARNING", "WARNING", "ERROR", "ERROR", "CRITICAL", "CRITICAL", "ERROR", "DEBUG", "UNKNOWN", "WARNING", "UNKNOWN"]


def test_cef_long_value(spark):
    text = "word " * 200_000
    r = rows(parse_cef(lines_frame(spark, [f"CEF:0|a|b|c|d|e|5|msg={text}src=1.1.1.1"])))[0]
    assert r.ip == "1.1.1.1" and r.metadata["ext.msg"] == text.strip()


def test_leef(spark):
    a, b, c = rows(parse_leef(lines_frame(spark, CEF)))
    assert (a.event_type, a.severity, a.ip, a.user, a.host, a.ts) == ("generic", "ERROR", "198.18.3.3", "kim", "", None)
    assert a.message == "[LEEF] Beta/Probe | EventID=AuthFail | src=198.18.3.3 | user=kim"
    assert a.metadata["attrs.note"] == "a=b" and a.metadata["event_id"] == "AuthFail"
    assert (b.severity, b.ip, b.user) == ("WARNING", "", "joe")
    assert b.message == "[LEEF] Beta/Probe | EventID=X | user=joe"
    assert (c.severity, c.ip, c.user, c.host) == ("WARNING", None, None, "")
    assert parse_cef_leef(lines_frame(spark, CEF)).count() == 7


JSON = [
    '{"timestamp":"2024-05-21T17:26:11Z","host":"kiosk","service":"sshd","level":"error","message":"Failed password for root from 4.3.2.1","user":"root","ip":"4.3.2.1"}',
    '{"time":"2024-05-21 17:31:00","hostname":"web2","app":"x","loglevel":"FATAL","msg":"m","pid":17,"username":"","src_ip":"1.1.1.1"}',
    '[1, 2]',
    'not json',
    '{"date":"2024-05-21T17:31:00.25","severity":"odd","k":{"a":1}}',
    '{"@timestamp":"2024-05-21T17:31","level":"notice","event":"e","user":"a","user":"b"}',
    '{"timestamp":"2024-05-21 17:31:00Z","level":"warn","message":"z"}',
]


def test_json_lines(spark):
    got = rows(parse_json_lines(lines_frame(spark, JSON)))
    assert [r.event_id for r in got] == [1, 2, 5, 6, 7]
    a, b, c, d, e = got
    assert (a.event_type, a.severity, a.host, a.process, a.user, a.ip) == ("generic", "ERROR", "kiosk", "sshd", "root", "4.3.2.1")
    assert a.ts == datetime(2024, 5, 21, 17, 26, 11)
    assert (b.severity, b.host, b.process, b.pid, b.user, b.ip, b.message) == ("CRITICAL", "web2", "x", "17", None, "1.1.1.1", "m")
    assert b.ts == datetime(2024, 5, 21, 17, 31)
    assert c.ts == datetime(2024, 5, 21, 17, 31, 0, 250000) and c.severity == "UNKNOWN"
    assert c.message == c.raw == JSON[4]
    assert (d.ts, d.severity, d.message, d.user) == (None, "INFO", "e", "b")
    assert (e.ts, e.severity) == (None, "WARNING")


def test_json_documents(spark):
    text = '[{"msg":"a","level":"info"}, 5, {"msg":"b","time":"2024-01-02T03:04:05"}]'
    got = parse_json_documents(lines_frame(spark, [text, '{"msg":\n"c"}', '{broken'])).collect()
    assert sorted((r.message, r.metadata["line_number"]) for r in got) == [("a", "1"), ("b", "3"), ("c", "1")]


def test_csv(spark, tmp_path):
    p = tmp_path / "log.csv"
    p.write_text('host,msg,user,ip,extra\nh1,"hello, world",bob,1.1.1.1,x\nh2,,,,"y ""q"""\n')
    a, b = rows(load_events(spark, str(p)))
    assert (a.host, a.message, a.user, a.ip, a.raw) == ("h1", "hello, world", "bob", "1.1.1.1", "h1,hello, world,bob,1.1.1.1,x")
    assert (a.event_type, a.severity, a.ts) == ("generic", "UNKNOWN", None)
    assert (b.message, b.user, b.ip, b.raw) == ('h2    y "q"', None, None, 'h2,,,,y "q"')
    t = tmp_path / "log.tsv"
    t.write_text("description\tsrc\tpid\na\tb\t7\n")
    r = rows(parse_csv(read_csv(spark, str(t), "\t")))[0]
    assert (r.message, r.host, r.pid, r.process) == ("a", "b", "7", "")
    assert r.metadata["columns"] == "description,src,pid"


def windows(code, time="2024-05-21T17:26:11.000000000Z", **data):
    items = "".join(f'<Data Name="{k}">{v}</Data>' for k, v in data.items())
    return (
        '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event">\n<System>'
        f'<EventID>{code}</EventID><TimeCreated SystemTime="{time}"/><Computer> WIN1 </Computer></System>'
        f"<EventData>{items}</EventData></Event>"
    )


WINDOWS = [
    windows(4625, TargetUserName="kim", IpAddress="4.3.2.1", LogonType="3", Status="0xC0000064"),
    windows(4624, TargetUserName="WIN1$", IpAddress="4.3.2.1"),
    windows(4624, SubjectUserName="joe", WorkstationName="-", LogonType="10", time="2024-05-21T17:31:00Z"),
    windows(4688, SubjectUserName="joe", NewProcessName="C:\\cmd.exe", CommandLine="cmd /c whoami"),
    windows(4720, TargetUserName="ghost"),
    windows(4732, MemberName="eve", TargetUserName="Administrators"),
    windows(4776, TargetUserName="N/A", time="2024-05-21 17:31:00"),
    windows(1102),
    "<Event><System><Computer>x</Computer></System></Event>",
    "<Event><System><EventID>4624</EventID>",
]


def check_windows(got):
    assert len(got) == 7
    a, c, d, e, f, g, h = got
    assert (a.event_type, a.severity, a.user, a.ip, a.host) == ("auth_failure", "ERROR", "kim", "4.3.2.1", "WIN1")
    assert a.message == "EventID 4625: Failed logon for kim from 4.3.2.1 [Network] Status=0xC0000064"
    assert a.ts == datetime(2024, 5, 21, 17, 26, 11) and a.process == "EventID-4625"
    assert (c.event_type, c.user, c.ip, c.ts) == ("auth_success", "joe", None, None)
    assert c.message == "EventID 4624: Successful logon for joe from - [RemoteInteractive]"
    assert d.message == "EventID 4688: Process created by joe: C:\\cmd.exe | CMD: cmd /c whoami"
    assert (d.event_type, d.severity) == ("generic", "INFO")
    assert e.message == "EventID 4720: User account created: ghost by unknown" and e.user == "ghost"
    assert f.message == "EventID 4732: eve added to group Administrators" and f.event_type == "group_change"
    assert g.message == "EventID 4776: Successful logon for N/A from unknown" and g.user is None
    assert g.ts == datetime(2024, 5, 21, 17, 31)
    assert (h.event_type, h.severity, h.message, h.user) == ("generic", "UNKNOWN", "EventID 1102", None)


def test_windows_records(spark):
    check_windows(rows(parse_windows_xml(lines_frame(spark, WINDOWS))))


def test_windows_file(spark, tmp_path):
    p = tmp_path / "security.xml.sample"
    p.write_text("<?xml version='1.0'?>\n<Events>\n" + "\n".join(WINDOWS[:-1]) + "\n</Events>\n")
    got = rows(load_events(spark, str(p)))
    check_windows(got)
    assert got[0].raw == WINDOWS[0]


def test_routing(spark, tmp_path):
    assert [format_of(n) for n in (
        "a/x.json", "x.jsonl.gz", "x.ndjson", "x.CSV", "x.tsv.bz2", "x.xml", "s.xml.sample",
        "fw.cef", "my_leef_dump.txt", "auth.log", "auth.log.sample", "whatever.bin", "x.json.gz",
    )] == ["json", "jsonl", "jsonl", "csv", "tsv", "windows_xml", "windows_xml",
           "cef", "cef", "syslog", "syslog", "syslog", "json"]
    p = tmp_path / "auth.log.gz"
    with gzip.open(p, "wt") as f:
        f.write("\n".join(AUTH_LOG))
    j = tmp_path / "e.json"
    j.write_text("\n".join(JSON))
    d = tmp_path / "d.json"
    d.write_text('[\n{"msg":"a"},\n{"msg":"b"}\n]')
    assert load_events(spark, str(p), year=2024).count() == 32
    assert load_events(spark, str(j)).count() == 5
    assert load_events(spark, str(d)).count() == 2
    both = load_many(spark, [str(p), str(j)])
    assert both.count() == 37 and both.select("event_id").distinct().count() == 37


def test_json_folder_of_both_layouts(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join('{"msg":"Failed password for kim from 198.18.0.%d"}' % i for i in range(3)))
    (tmp_path / "b.json").write_text("[" + ",\n".join('{"msg":"Failed password for kim from 198.18.1.%d"}' % i for i in range(4)) + "]")
    got = load_events(spark, str(tmp_path / "*.json"), classify=True)
    assert got.count() == 7 and got.filter("event_type = 'auth_failure'").count() == 7
    assert got.select("event_id").distinct().count() == 7
    many = load_many(spark, [str(tmp_path / "a.json")] * 3 + [str(tmp_path / "b.json")], fmt="json")
    assert many.count() == 13


def test_classify_option(spark):
    got = rows(reclassify(parse_json_lines(lines_frame(spark, JSON))))
    assert (got[0].event_type, got[0].user, got[0].ip, got[0].severity) == ("auth_failure", "root", "4.3.2.1", "ERROR")
    assert (got[1].event_type, got[1].severity) == ("generic", "CRITICAL")


def test_parsers_stay_in_the_jvm(spark):
    for df in (
        parse_syslog(lines_frame(spark, AUTH_LOG)), parse_cef_leef(lines_frame(spark, CEF)),
        parse_json_lines(lines_frame(spark, JSON)), parse_windows_xml(lines_frame(spark, WINDOWS)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Exchange" not in plan
