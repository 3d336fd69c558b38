"""Hand-made log lines and row builders."""

from datetime import datetime, timedelta

from palisade.schema import EVENTS

# one night on one machine: an administrator at work, a few stray attempts, a
# burst over many accounts that ends in a login, what is done with it, and a
# second burst on one account after midnight
BURST, LATE_BURST, STRAY, DESK = "203.0.113.77", "198.51.100.200", "198.51.100.9", "192.0.2.40"
_ACCOUNTS = ["nora", "svc", "git", "www", "root", "mail"]


def _line(clock, process, text):
    return f"Nov {clock} vault {process}: {text}"


AUTH_LOG = [
    "",
    _line("17 21:10:02", "sshd[311]", f"Accepted publickey for nora from {DESK} port 50022 ssh2"),
    _line("17 21:10:03", "sshd[311]", "pam_unix(sshd:session): session opened for user nora by (uid=0)"),
    _line("17 21:14:40", "sudo[320]", "nora : authentication failure ; logname=nora uid=1007 rhost= user=nora"),
    _line("17 21:15:02", "sudo[321]", "nora : TTY=pts/3 ; PWD=/srv ; USER=root ; COMMAND=/usr/bin/systemctl reload nginx"),
    *[_line(f"17 21:{20 + 6 * i}:30", f"sshd[{330 + i}]", f"Failed password for git from {STRAY} port {6100 + i} ssh2")
      for i in range(3)],
    _line("17 21:48:09", "sshd[311]", "pam_unix(sshd:session): session closed for user nora"),
    *[_line(f"17 22:40:{3 * i:02d}", f"sshd[{400 + i}]",
            f"Failed password for {_ACCOUNTS[i % 6]} from {BURST} port {30100 + 7 * i} ssh2") for i in range(12)],
    _line("17 22:40:50", "sshd[420]", f"Invalid user pilot from {BURST} port 30900"),
    _line("17 22:40:51", "sshd[420]", f"Failed password for invalid user pilot from {BURST} port 30900 ssh2"),
    _line("17 22:41:55", "sshd[431]", f"Accepted password for svc from {BURST} port 31007 ssh2"),
    _line("17 22:43:11", "sudo[440]", "svc : TTY=pts/4 ; PWD=/tmp ; USER=root ; COMMAND=/bin/sh"),
    _line("17 22:47:29", "useradd[447]", "new user: name=ghost, UID=2020, GID=2020, home=/home/ghost"),
    *[_line(f"18 01:02:{9 * i:02d}", f"sshd[{500 + i}]", f"Failed password for root from {LATE_BURST} port {7000 + i} ssh2")
      for i in range(7)],
]

T0 = datetime(2024, 4, 9, 8, 0, 0)


def lines_frame(spark, lines, source="log"):
    return spark.createDataFrame(
        [(i, source, text) for i, text in enumerate(lines, 1)],
        "event_id bigint, source string, value string",
    )


def event(i, kind="auth_failure", sec=0, ip="1.2.3.4", user="root", message="x", **other):
    """One event row; `sec` is an offset from T0, None for no time."""
    row = dict(
        event_id=i, event_type=kind, severity="ERROR",
        ts=None if sec is None else T0 + timedelta(seconds=sec),
        source="log", host="srv", process="sshd", pid=None, user=user, ip=ip,
        message=message, raw=f"raw {i}", metadata={},
    )
    row.update(other)
    return row


def events_frame(spark, rows):
    return spark.createDataFrame(
        [tuple(r[f.name] for f in EVENTS.fields) for r in rows], EVENTS
    )
