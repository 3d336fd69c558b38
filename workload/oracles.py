"""The same queries in SQL, for DuckDB."""

from __future__ import annotations

import string

from palisade import fixed_values as fixed
from palisade.functions.text import WHITESPACE
from workload import queries as q

HOUR = 3_600_000_000
DAY = 24 * HOUR


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def words(column: str, items) -> str:
    return "(" + " OR ".join(f"contains({column}, {lit(w)})" for w in items) + ")"


def fill(template: str, **values: str) -> str:
    parts = []
    for text, name, _, _ in string.Formatter().parse(template):
        if text:
            parts.append(lit(text))
        if name:
            parts.append(f"({values[name]})::VARCHAR")
    return " || ".join(parts)


def listing(names: str, total: str, shown: int, sep: str = ", ") -> str:
    head = f"array_to_string(({names})[1:{shown}], {lit(sep)})"
    return f"{head} || CASE WHEN {total} > {shown} THEN ' (+' || ({total} - {shown}) || ' more)' ELSE '' END"


def rank(column: str, table: dict) -> str:
    return "CASE " + column + " " + " ".join(
        f"WHEN {lit(k)} THEN {v}" for k, v in table.items()) + " ELSE 9 END"


# -------------------------------------------------------------------- lines
def base(daily: bool = False) -> str:
    second = "day(ts)" if daily else "0"
    return f"""base AS (SELECT event_id, event_type, props, ts,
  '10.' || {second} || '.' || (user_id % 4) || '.' || (user_id % 20) AS ip,
  'u' || (event_id % 23) AS "user", 'h' || (user_id % 5) AS host FROM events)"""


LINES = """texts AS (SELECT *, CASE event_type
    WHEN 'error' THEN 'Failed password for ' || "user" || ' from ' || ip || ' port 22 ssh2'
    WHEN 'view' THEN 'Invalid user ' || "user" || ' from ' || ip || ' port 22'
    WHEN 'click' THEN 'Accepted password for ' || "user" || ' from ' || ip || ' port 22 ssh2'
    WHEN 'signup' THEN 'new user: name=' || "user" || ', UID=1'
    ELSE CASE event_id % 8
      WHEN 4 THEN "user" || ' : authentication failure ; rhost= user=' || "user"
      WHEN 5 THEN "user" || ' : authentication failure ; rhost= user=' || "user"
      WHEN 6 THEN 'Successful su for root by ' || "user"
      WHEN 7 THEN 'usermod: add to group ' || "user"
      ELSE "user" || ' : TTY=pts/0 ; PWD=/home/' || "user" || ' ; USER=root ; COMMAND=' ||
        CASE event_id % 8 WHEN 0 THEN '/bin/bash' WHEN 1 THEN '/usr/bin/systemctl'
          WHEN 2 THEN '/usr/bin/cat /etc/shadow' ELSE '/usr/bin/ls' END END END AS text,
  CASE event_type WHEN 'error' THEN 'sshd' WHEN 'view' THEN 'sshd' WHEN 'click' THEN 'sshd'
    WHEN 'signup' THEN 'useradd'
    ELSE CASE event_id % 8 WHEN 6 THEN 'su' WHEN 7 THEN 'usermod' ELSE 'sudo' END END AS program
  FROM base),
full_lines AS (SELECT *, strftime(ts, '%b') || ' ' || lpad(day(ts)::VARCHAR, 2, ' ') || ' '
  || strftime(ts, '%H:%M:%S') || ' ' || host || ' ' || program || '[' || event_id || ']: ' || text AS whole
  FROM texts),
lines AS (SELECT event_id, CASE WHEN event_id % 40 = 7 THEN '  ' || whole || chr(9) || ' '
  WHEN event_id % 60 = 11 THEN text WHEN event_id % 90 = 13 THEN '   ' ELSE whole END AS value
  FROM full_lines)"""

_BLANKS = " || ".join(f"chr({ord(c)})" for c in WHITESPACE)


def parsed(lines: str = "lines") -> str:
    """CTEs from `lines` to `ev`, the parsed events (ts in microseconds)."""
    header = lit(fixed.SYSLOG_HEADER)
    number = " ".join(
        f"WHEN {'lower(process) = ' + lit(p) + ' AND ' if p else ''}"
        f"regexp_matches(message, {lit('(?i)' + x)}) THEN {i}"
        for i, (p, x, _, _) in enumerate(fixed.SYSLOG_RULES, 1))

    def group(n):
        import re
        return "CASE rule " + " ".join(
            f"WHEN {i} THEN regexp_extract(message, {lit('(?i)' + x)}, {n})"
            for i, (_, x, _, _) in enumerate(fixed.SYSLOG_RULES, 1) if re.compile(x).groups >= n
        ) + " END"

    def pick(n, other):
        return "CASE rule " + " ".join(
            f"WHEN {i} THEN {lit(r[n])}" for i, r in enumerate(fixed.SYSLOG_RULES, 1)
        ) + f" ELSE {lit(other)} END"

    return f"""blanks AS (SELECT {_BLANKS} AS b),
clean AS (SELECT event_id, trim(value, b) AS raw FROM {lines}, blanks),
headed AS (SELECT *, regexp_matches(raw, {header}) AS has_head,
  try_strptime('2024 ' || regexp_replace(regexp_extract(raw, {lit(fixed.SYSLOG_TIME)}, 1), '\\s+', ' ', 'g'),
    '%Y %b %d %H:%M:%S') AS stamp FROM clean WHERE raw <> ''),
fields AS (SELECT event_id, raw, epoch_us(stamp) AS ts,
  CASE WHEN has_head THEN regexp_extract(raw, {header}, 1) ELSE '' END AS host,
  CASE WHEN has_head THEN regexp_extract(raw, {header}, 2) ELSE '' END AS process,
  nullif(regexp_extract(raw, {header}, 3), '') AS pid,
  CASE WHEN has_head THEN regexp_extract(raw, {header}, 4) ELSE raw END AS message FROM headed),
ruled AS (SELECT *, CASE {number} ELSE 0 END AS rule FROM fields),
grouped AS (SELECT *, {group(1)} AS "user", {group(2)} AS second FROM ruled),
ev AS (SELECT event_id, {pick(2, 'generic')} AS event_type, {pick(3, 'UNKNOWN')} AS severity, ts,
  'events' AS source, host, process, pid, "user",
  CASE WHEN regexp_matches(second, {lit(fixed.DOTTED_QUAD)}) THEN second END AS ip, message, raw
  FROM grouped)"""


def events_ctes(daily: bool = False) -> str:
    return f"WITH {base(daily)}, {LINES}, {parsed()}"


EVENT_VIEW = ('event_id, event_type, severity, ts, host, process, pid, "user", ip, message, raw')


# ---------------------------------------------------------------- detectors
def peaks(name: str, source: str, window: int, distinct: bool) -> str:
    """CTE: best window per ip of rows (ip, user, ts)."""
    value = "count(DISTINCT b.\"user\")" if distinct else "count(*)"
    return f"""{name}_all AS (SELECT a.ip, a.ts AS t0, {value} AS peak, count(*) AS peak_rows
  FROM (SELECT DISTINCT ip, ts FROM {source} WHERE ts IS NOT NULL) a
  JOIN {source} b ON a.ip = b.ip AND b.ts BETWEEN a.ts AND a.ts + {window} GROUP BY ALL),
{name} AS (SELECT * FROM {name}_all QUALIFY row_number() OVER (PARTITION BY ip ORDER BY peak DESC, t0) = 1)"""


FACTS = """count(*) AS event_count, min(ts) AS first_seen, max(ts) AS last_seen,
  count(DISTINCT ip) AS n_source_ips, count(DISTINCT "user") AS n_users,
  list_sort(list_distinct(list(ip) FILTER (ip IS NOT NULL))) AS ips,
  list_sort(list_distinct(list("user") FILTER ("user" IS NOT NULL))) AS users"""

LAYOUT = ("finding_id, finding_rank, rule_id, title, severity, confidence, description, "
          "recommendation, first_seen, last_seen, event_count, n_source_ips, n_users, ips, users, "
          "m1, m2, m3")


def _texts(texts: dict, **values: str) -> str:
    return ", ".join(f"{fill(texts[k], **values)} AS {k}"
                     for k in ("title", "description", "recommendation"))


def _not_in(column: str, values) -> str:
    if not values:
        return "true"
    return f"({column} IS NULL OR {column} NOT IN ({', '.join(map(lit, values))}))"


def detectors(p, per: str = "''") -> str:
    """CTEs `findings` and `evidence` of all detectors over `ev`."""
    ok_ip, ok_user = _not_in("ip", p.allowed_ips), _not_in('"user"', p.allowed_users)
    bw, sw = p.brute_force_window_sec * 10**6, p.spray_window_sec * 10**6
    thr, spray = p.brute_force_threshold, p.spray_threshold
    enum = p.enumeration_threshold
    brute = f"""fails AS (SELECT * FROM ev WHERE event_type = 'auth_failure' AND ip <> '' AND {ok_ip}),
{peaks('bp', 'fails', bw, False)},
b0 AS (SELECT 'brute_force|' || ip AS finding_id, ip, {FACTS} FROM fails GROUP BY ip HAVING count(*) >= {thr}),
b1 AS (SELECT b0.*, coalesce(bp.peak, b0.event_count) AS burst, bp.t0 FROM b0 LEFT JOIN bp USING (ip)),
f_brute AS (SELECT *, 10 AS finding_rank, 'brute_force' AS rule_id,
  CASE WHEN burst >= {3 * thr} THEN 'CRITICAL' WHEN burst >= {thr} THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
  CASE WHEN burst >= {thr} THEN 'HIGH' ELSE 'MEDIUM' END AS confidence,
  {_texts(fixed.BRUTE_FORCE_TEXT, ip='ip', total='event_count', burst='burst',
          minutes=str(p.brute_force_window_sec // 60), users=listing('users', 'n_users', 5))},
  event_count AS m1, burst AS m2, t0 AS m3 FROM b1),
e_brute AS (SELECT b1.finding_id, fails.* FROM fails JOIN b1 USING (ip))"""

    def widest(tag, source, window, least, rule, frank, texts, level, shown, attempts):
        return f"""{peaks(tag + 'p', source, window, True)},
{tag}u AS (SELECT ip, NULL::BIGINT AS t0, count(DISTINCT "user") AS peak FROM {source} GROUP BY ip HAVING max(ts) IS NULL),
{tag}b AS (SELECT ip, t0, peak FROM {tag}p UNION ALL SELECT ip, t0, peak FROM {tag}u),
e_{tag} AS (SELECT '{rule}|' || f.ip AS finding_id, f.* FROM {source} f JOIN {tag}b w ON f.ip = w.ip
  AND (w.t0 IS NULL OR f.ts BETWEEN w.t0 AND w.t0 + {window}) WHERE w.peak >= {least}),
{tag}0 AS (SELECT finding_id, ip, {FACTS} FROM e_{tag} GROUP BY finding_id, ip),
f_{tag} AS (SELECT *, {frank} AS finding_rank, '{rule}' AS rule_id,
  CASE WHEN n_users >= {level} THEN 'HIGH' ELSE 'MEDIUM' END AS severity, severity AS confidence,
  {_texts(texts, ip='ip', distinct='n_users', attempts='event_count', minutes=str(window // 60_000_000),
          users=listing('users', 'n_users', shown))},
  n_users AS m1, event_count AS m2, NULL::BIGINT AS m3 FROM {tag}0)"""

    sprays = 'named AS (SELECT * FROM fails WHERE "user" <> \'\'),\n' + widest(
        "spray", "named", sw, max(2, spray // 2), "password_spray", 20,
        fixed.PASSWORD_SPRAY_TEXT, spray, 8, True)
    probes = f"probing AS (SELECT * FROM fails WHERE {words('lower(message)', fixed.INVALID_USER_MARKERS)}),\n" + widest(
        "enum", "probing", bw, enum, "enumeration", 30, fixed.ENUMERATION_TEXT, 2 * enum, 10, False)
    command = "CASE WHEN contains(message, 'COMMAND=') THEN trim(substr(message, strpos(message, 'COMMAND=') + 8)) ELSE '' END"
    names = "n_users"
    all_users = listing("users", names, 2_147_483_647)
    items = "coalesce(items, [])"
    by = {
        "high_risk_sudo": (40, fixed.HIGH_RISK_SUDO_TEXT, "'CRITICAL'", "HIGH"),
        "normal_sudo": (41, fixed.NORMAL_SUDO_TEXT, "'MEDIUM'", "MEDIUM"),
        "failed_sudo": (42, fixed.FAILED_SUDO_TEXT, "'HIGH'", "HIGH"),
        "su": (43, fixed.SU_TEXT, "CASE WHEN list_contains(users, 'root') THEN 'HIGH' ELSE 'MEDIUM' END", "MEDIUM"),
        "user_created": (44, fixed.USER_CREATED_TEXT, "'HIGH'", "HIGH"),
        "group_change": (45, fixed.GROUP_CHANGE_TEXT, "'HIGH'", "MEDIUM"),
    }
    values = dict(
        users=all_users, count="event_count", user="users[1]",
        commands=listing(items, "event_count", 5, "; "), names=listing(items, "n_named", 2_147_483_647),
        target=f"CASE WHEN list_contains(users, 'root') THEN 'root' ELSE {all_users} END",
        root_note=f"CASE WHEN list_contains(users, 'root') THEN {lit(fixed.SU_TEXT['root_note'])} ELSE '' END",
    )

    def pick(f):
        return "CASE pattern " + " ".join(f"WHEN {lit(k)} THEN {f(v)}" for k, v in by.items()) + " END"

    priv = f"""pv AS (SELECT *, {command} AS command, CASE
    WHEN event_type = 'sudo' AND {words('lower(message)', fixed.SUDO_FAILURE_MARKERS)}
      THEN CASE WHEN "user" <> '' THEN 'failed_sudo' END
    WHEN event_type = 'sudo' AND {words('lower(' + command + ')', fixed.HIGH_RISK_COMMANDS)} THEN 'high_risk_sudo'
    WHEN event_type = 'sudo' THEN 'normal_sudo'
    WHEN event_type IN ('su', 'user_created', 'group_change') THEN event_type END AS pattern
  FROM ev WHERE {ok_user}),
pe AS (SELECT 'priv_esc|' || pattern || CASE WHEN pattern = 'failed_sudo' THEN '|' || "user" ELSE '' END || {per} AS finding_id, *
  FROM pv WHERE pattern IS NOT NULL),
p0 AS (SELECT finding_id, pattern, {FACTS}, count("user") AS n_named,
  list(CASE WHEN pattern = 'user_created' THEN "user" ELSE command END ORDER BY ts NULLS LAST, event_id)
    FILTER (pattern = 'high_risk_sudo' OR (pattern = 'user_created' AND "user" IS NOT NULL)) AS items
  FROM pe GROUP BY finding_id, pattern HAVING pattern <> 'failed_sudo' OR count(*) >= {p.failed_sudo_threshold}),
f_priv AS (SELECT *, {pick(lambda v: str(v[0]))} AS finding_rank, 'priv_esc' AS rule_id,
  {pick(lambda v: v[2])} AS severity, {pick(lambda v: lit(v[3]))} AS confidence,
  {', '.join(pick(lambda v, k=k: fill(v[1][k], **values)) + ' AS ' + k for k in ('title', 'description', 'recommendation'))},
  NULL::BIGINT AS m1, NULL::BIGINT AS m2, NULL::BIGINT AS m3 FROM p0),
e_priv AS (SELECT pe.* EXCLUDE (command, pattern) FROM pe SEMI JOIN p0 USING (finding_id))"""
    login = f"""e_login AS (SELECT 'auth_success|' || event_id AS finding_id, * FROM ev
  WHERE event_type = 'auth_success' AND {ok_ip} AND {ok_user}),
l0 AS (SELECT finding_id, any_value(ip) AS one_ip, any_value("user") AS one_user, {FACTS} FROM e_login GROUP BY finding_id),
f_login AS (SELECT *, 50 AS finding_rank, 'auth_success' AS rule_id, 'INFO' AS severity, 'HIGH' AS confidence,
  {_texts(fixed.AUTH_SUCCESS_TEXT, ip="coalesce(one_ip, 'unknown')", user="coalesce(one_user, 'unknown')")},
  NULL::BIGINT AS m1, NULL::BIGINT AS m2, NULL::BIGINT AS m3 FROM l0)"""
    tags = ("brute", "spray", "enum", "priv", "login")
    findings = " UNION ALL ".join(f"SELECT {LAYOUT} FROM f_{t}" for t in tags)
    columns = 'finding_id, event_id, event_type, severity, ts, source, host, process, pid, "user", ip, message, raw'
    evidence = " UNION ALL ".join(f"SELECT {columns} FROM e_{t}" for t in tags)
    return f"""{brute}, {sprays}, {probes}, {priv}, {login},
found AS MATERIALIZED ({findings}), found_evidence AS MATERIALIZED ({evidence})"""


def _all_in(lists: str, values) -> str:
    if not values:
        return "false"
    return f"(coalesce(len({lists}), 0) > 0 AND len(list_filter({lists}, lambda x: x NOT IN ({', '.join(map(lit, values))}))) = 0)"


def case(p=None, daily: bool = False, per: str = "''") -> str:
    """All CTEs up to `findings` and `evidence` (the allowlist applied)."""
    p = p or q.WIDE
    listed = f"({_all_in('ips', p.allowed_ips)} OR {_all_in('users', p.allowed_users)})"
    return f"""{events_ctes(daily)}, {detectors(p, per)},
findings AS MATERIALIZED (SELECT * FROM found WHERE NOT {listed}),
evidence AS MATERIALIZED (SELECT * FROM found_evidence SEMI JOIN findings USING (finding_id))"""


def finding_view(where: str, more: str = "") -> str:
    return f"""SELECT finding_id, rule_id, title, severity, confidence, description, first_seen,
  last_seen, event_count, n_source_ips, n_users, array_to_string(coalesce(ips, []), ',') AS source_ips,
  array_to_string(coalesce(users, []), ',') AS users{more} FROM findings WHERE {where}"""


# -------------------------------------------------------------- correlation
PLACED = """placed AS (SELECT *, coalesce(first_seen, (SELECT max(first_seen) FROM findings)) AS t,
  row_number() OVER (ORDER BY first_seen NULLS LAST, finding_rank, finding_id) AS ord FROM findings),
times AS (SELECT t, min(ord) AS arrival FROM placed GROUP BY t)"""


def chain_rows(rules: list[tuple[str, list[str]]], seen: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{rid}' AS rule_id, t, arrival, [{', '.join(h)}] AS hits FROM {seen} WHERE "
        + " AND ".join(f"{x} IS NOT NULL" for x in h)
        for rid, h in rules
    )


def fired(name: str, chains: str, pool: str) -> str:
    """CTE of fired chains.  `pool`: ord, t, base (list of finding ids)."""
    return f"""{name}_c AS ({chains}),
{name}_d AS (SELECT rule_id, hits, min(greatest(list_max(hits), arrival)) AS trig,
  arg_min(t, t) AS t FROM {name}_c GROUP BY rule_id, hits),
{name}_h AS (SELECT rule_id, hits, trig, t, unnest(hits) AS ord, generate_subscripts(hits, 1) AS pos FROM {name}_d),
{name}_b AS (SELECT h.rule_id, h.hits, h.trig, h.t, string_agg(p.id, '|' ORDER BY pos) AS ids,
  string_agg(p.rule_id, ',' ORDER BY pos) AS hit_rules, flatten(list(p.base ORDER BY pos)) AS base
  FROM {name}_h h JOIN {pool} p ON p.ord = h.ord GROUP BY h.rule_id, h.hits, h.trig, h.t),
{name}_m AS (SELECT b.rule_id, b.hits, list_sort(list_concat(
    coalesce(list_distinct(flatten(list(f.ips))), []), coalesce(list_distinct(flatten(list(f.users))), []))) AS names,
  coalesce(len(list_distinct(flatten(list(f.ips)))), 0) AS n_ips, coalesce(len(list_distinct(flatten(list(f.users)))), 0) AS n_names,
  array_to_string(list_sort(list_distinct(flatten(list(f.ips)))), ',') AS ips,
  array_to_string(list_sort(list_distinct(flatten(list(f.users)))), ',') AS users,
  min(f.first_seen) AS first_seen, max(f.last_seen) AS last_seen, sum(f.event_count)::BIGINT AS event_count
  FROM (SELECT rule_id, hits, unnest(base) AS id FROM {name}_b) b
  JOIN placed f ON f.finding_id = b.id GROUP BY b.rule_id, b.hits),
{name} AS (SELECT b.*, m.* EXCLUDE (rule_id, hits) FROM {name}_b b JOIN {name}_m m USING (rule_id, hits)
  QUALIFY row_number() OVER (PARTITION BY b.rule_id, names ORDER BY trig) = 1)"""


def seen(name: str, window: int, columns: dict[str, str], pool: str) -> str:
    picks = ", ".join(f"{v} AS {k}" for k, v in columns.items())
    return f"""{name} AS (SELECT x.t, x.arrival, {picks} FROM times x
  JOIN {pool} p ON p.t BETWEEN x.t - {window} AND x.t GROUP BY x.t, x.arrival)"""


def earliest(where: str, nth: int = 1) -> str:
    if nth == 1:
        return f"min(p.ord) FILTER ({where})"
    return f"list_sort(list(p.ord) FILTER ({where}))[{nth}]"


POOL = "pool0 AS (SELECT ord, t, finding_id AS id, rule_id, severity, [finding_id] AS base FROM placed)"
ATTACK = "p.rule_id IN ('brute_force', 'password_spray')"
SEVERITY = "CASE rule_id " + " ".join(
    f"WHEN {lit(r['rule_id'])} THEN {lit(r['severity'])}" for r in fixed.CORRELATION_RULES) + " END"


def _window_of(rule_id: str) -> int:
    return next(r["window_sec"] for r in fixed.CORRELATION_RULES if r["rule_id"] == rule_id)


def reference_chains(p) -> str:
    w = p.correlation_window_sec * 10**6
    one = seen("seen1", w, {
        "a": earliest(ATTACK), "s": earliest("p.rule_id = 'auth_success'"),
        "v": earliest("p.rule_id = 'priv_esc'"), "n": earliest("p.rule_id = 'enumeration'"),
        "n2": earliest("p.rule_id = 'enumeration'", 2),
    }, "pool0")
    first = fired("r1", chain_rows([
        ("brute_then_success", ["a", "s"]), ("success_then_priv_esc", ["s", "v"]),
        ("enum_then_brute", ["n", "a"]), ("persistent_recon", ["n", "n2"]),
    ], "seen1"), "pool0")
    pool = """pool1 AS (SELECT ord::DOUBLE AS ord, t, id, rule_id, base FROM pool0 UNION ALL
  SELECT trig + CASE rule_id WHEN 'brute_then_success' THEN 0.2 WHEN 'success_then_priv_esc' THEN 0.3
    WHEN 'enum_then_brute' THEN 0.4 ELSE 0.5 END, r1.t, rule_id || '|' || ids, rule_id, base FROM r1)"""
    two = seen("seen2", w, {
        "a": earliest(ATTACK), "s": earliest("p.rule_id IN ('auth_success', 'brute_then_success')"),
        "v": earliest("p.rule_id = 'priv_esc'"),
    }, "pool1")
    second = fired("r2", chain_rows([("full_attack_chain", ["a", "s", "v"])], "seen2"), "pool1")
    return f"""{PLACED}, {POOL}, {one}, {first}, {pool}, {two}, {second},
chains AS (SELECT rule_id, ids, trig, hit_rules, base, n_ips, n_names, ips, users, first_seen, last_seen, event_count FROM r1
  UNION ALL SELECT rule_id, ids, trig, hit_rules, base, n_ips, n_names, ips, users, first_seen, last_seen, event_count FROM r2)"""


CHAIN_VIEW = """SELECT c.rule_id || '|' || ids AS finding_id, c.rule_id, {severity} AS severity,
  p.finding_id AS triggered_by, hit_rules AS correlated_rules, c.first_seen, c.last_seen, c.event_count,
  n_ips AS n_source_ips, n_names AS n_users{names} FROM chains c JOIN placed p ON p.ord = floor(trig)"""
NAMES = ", c.ips AS source_ips, c.users AS users"


def chain_view(severity: str = SEVERITY.replace("rule_id", "c.rule_id"), names: str = NAMES) -> str:
    return CHAIN_VIEW.format(severity=severity, names=names)


def own_rules() -> str:
    w = 1800 * 10**6
    one = seen("seen1", w, {
        "g": earliest("p.severity IN ('CRITICAL', 'HIGH') AND p.rule_id <> 'priv_esc'"),
        "s": earliest("p.rule_id = 'auth_success'"), "s2": earliest("p.rule_id = 'auth_success'", 2),
        "s3": earliest("p.rule_id = 'auth_success'", 3),
    }, "pool0")
    rows = fired("r1", chain_rows([
        ("grave_then_login", ["g", "s"]), ("three_logins", ["s", "s2", "s3"])], "seen1"), "pool0")
    return f"""{case(q.DAILY, True)}, {PLACED}, {POOL}, {one}, {rows}, chains AS (SELECT * FROM r1)
{chain_view("CASE c.rule_id WHEN 'three_logins' THEN 'LOW' ELSE 'HIGH' END", "")}"""


def keyed() -> str:
    def step(name, rows, where, kind, window, first):
        """Rows (hits, t, ord) followed by findings that share a value."""
        return f"""{name}_p AS (SELECT b.ord, b.t, v.value, min(a.ord) AS before
  FROM timed b JOIN vals v ON v.id = b.finding_id AND v.kind = '{kind}'
  JOIN vals av ON av.value = v.value AND av.kind = '{kind}'
  JOIN {rows} a ON a.last_id = av.id AND a.ord <> b.ord AND a.t BETWEEN b.t - {window} AND b.t
  WHERE {where} GROUP BY b.ord, b.t, v.value),
{name} AS (SELECT p.ord, p.t, p.value, list_append(a.hits, p.ord) AS hits, b.finding_id AS last_id
  FROM {name}_p p JOIN {rows} a ON a.ord = p.before JOIN timed b ON b.ord = p.ord)"""

    def start(name, where):
        return f"{name} AS (SELECT ord, t, [ord] AS hits, finding_id AS last_id FROM timed b WHERE {where})"

    attack = "b.rule_id IN ('brute_force', 'password_spray')"
    w = {r["rule_id"]: 4 * r["window_sec"] * 10**6 for r in fixed.CORRELATION_RULES}
    parts = [
        start("k_attack", attack), start("k_login", "b.rule_id = 'auth_success'"),
        start("k_enum", "b.rule_id = 'enumeration'"),
        step("k1", "k_attack", "b.rule_id = 'auth_success'", "ip", w["brute_then_success"], True),
        step("k2", "k_login", "b.rule_id = 'priv_esc'", "user", w["success_then_priv_esc"], True),
        step("k3a", "k_attack", "b.rule_id IN ('brute_then_success', 'auth_success')", "ip", w["full_attack_chain"], True),
        step("k3", "k3a", "b.rule_id = 'priv_esc'", "user", w["full_attack_chain"], False),
        step("k4", "k_enum", attack, "ip", w["enum_then_brute"], True),
        step("k5", "k_enum", "b.rule_id = 'enumeration'", "ip", w["persistent_recon"], True),
    ]
    rules = {"brute_then_success": "k1", "success_then_priv_esc": "k2", "full_attack_chain": "k3",
             "enum_then_brute": "k4", "persistent_recon": "k5"}
    once = " UNION ALL ".join(
        f"SELECT DISTINCT '{r}' AS rule_id, hits, ord AS trig, t FROM (SELECT * FROM {k} QUALIFY "
        f"row_number() OVER (PARTITION BY value ORDER BY ord) = 1)" for r, k in rules.items())
    body = fired("r1", "SELECT NULL::VARCHAR AS rule_id, NULL::BIGINT AS t, NULL::BIGINT AS arrival, NULL::BIGINT[] AS hits WHERE false", "pool0")
    body = body.replace(body[:body.index("r1_h AS")], f"r1_d AS ({once}),\n", 1)
    body = body.replace("QUALIFY row_number() OVER (PARTITION BY b.rule_id, names ORDER BY trig) = 1", "")
    params = q.Params(brute_force_window_sec=q.DAY, spray_window_sec=q.DAY, spray_threshold=12)
    return f"""{case(params, True, "'|' || coalesce(" + '"user"' + ", '')")}, {PLACED}, {POOL},
timed AS (SELECT * FROM placed WHERE first_seen IS NOT NULL),
vals AS (SELECT finding_id AS id, 'ip' AS kind, unnest(ips) AS value FROM timed
  UNION ALL SELECT finding_id, 'user', unnest(users) FROM timed),
{', '.join(parts)}, {body}, chains AS (SELECT * FROM r1)
{chain_view()}"""


# ------------------------------------------------------------------ reports
ORDER = f"{rank('severity', fixed.REPORT_RANK)}, first_seen NULLS LAST, finding_rank, finding_id"
F_ORDER = f"{rank('f.severity', fixed.REPORT_RANK)}, f.first_seen NULLS LAST, f.finding_rank, f.finding_id"


def level(column: str) -> str:
    number = f"TRY_CAST(trim({column}) AS BIGINT)"
    return f"""CASE WHEN {number} >= 9 THEN 'CRITICAL' WHEN {number} >= 7 THEN 'ERROR'
  WHEN {number} >= 4 THEN 'WARNING' WHEN {number} >= 1 THEN 'INFO' WHEN {number} IS NOT NULL THEN 'DEBUG'
  WHEN lower({column}) IN ('high', 'critical', 'emergency') THEN 'ERROR'
  WHEN lower({column}) IN ('medium', 'warning') THEN 'WARNING' ELSE 'UNKNOWN' END"""


CEF_LINES = """cef_lines AS (SELECT *, 'CEF:0|Northgate|Porter|2.11|' || (event_id % 100) || '|' ||
  CASE event_type WHEN 'error' THEN 'Console logon failure' WHEN 'view' THEN 'Portal request denied'
    WHEN 'click' THEN 'Console logon success' WHEN 'signup' THEN 'Helpdesk user created' ELSE 'Privilege grant' END
  || '|' || CASE WHEN event_id % 12 = 11 THEN 'High' ELSE (event_id % 12)::VARCHAR END || '|' ||
  CASE WHEN event_id % 3 = 0 THEN 'shost=gw1 src=' ELSE 'src=' END || ip || ' suser=' || "user" ||
  ' dst=192.168.0.1 msg=code\\=' || (event_id % 7) || ' of ' || event_type || '  rt=' || (epoch_us(ts) // 1000) ||
  ' act=' || event_type AS cef,
  'LEEF:1.0|Halden|Lookout|4.0|' || event_type || '|sev=' || (event_id % 11) || chr(9) || 'src=' || ip
  || chr(9) || 'usrName=' || "user" || chr(9) || 'dst=' || host || chr(9) || 'note=a=b' AS leef FROM base)"""

CEF = f"""WITH {base()}, {CEF_LINES},
lines AS (SELECT event_id, CASE WHEN event_id % 50 = 3 THEN 'Jan  1 00:00:00 gw ' || cef
  WHEN event_id % 70 = 5 THEN 'CEF:0|too|short' ELSE cef END AS value FROM cef_lines WHERE event_id % 5 <> 4),
f AS (SELECT event_id, string_split(substr(value, strpos(value, 'CEF:')), '|') AS f FROM lines),
x AS (SELECT event_id, f[2] || '/' || f[3] AS maker, f[5] AS sig_id, f[6] AS name, f[7] AS sev, f[8] AS ext FROM f WHERE len(f) = 8),
y AS (SELECT *, regexp_extract(ext, '(?:^| )src=(\\S+)', 1) AS ip, regexp_extract(ext, 'suser=(\\S+)', 1) AS "user",
  lower(name || ' ' || sig_id) AS w FROM x)
SELECT event_id, CASE WHEN {words('w', fixed.CEF_FAILURE_WORDS)} THEN 'auth_failure'
  WHEN {words('w', fixed.CEF_SUCCESS_WORDS)} THEN 'auth_success' WHEN {words('w', fixed.CEF_SUDO_WORDS)} THEN 'sudo'
  WHEN {words('w', fixed.CEF_CREATED_WORDS)} THEN 'user_created' ELSE 'generic' END AS event_type,
  {level('sev')} AS severity, regexp_extract(ext, ' rt=(\\d+)', 1)::BIGINT * 1000 AS ts,
  regexp_extract(ext, 'shost=(\\S+)', 1) AS host, maker AS process, "user", ip,
  '[CEF] ' || maker || ' | ' || name || ' | SigID=' || sig_id || ' | src=' || ip || ' | user=' || "user" AS message,
  replace(regexp_extract(ext, 'msg=(.*?)\\s+rt=', 1), '\\=', '=') AS msg, sig_id FROM y"""

LEEF = f"""WITH {base()}, {CEF_LINES},
f AS (SELECT event_id, string_split(leef, '|') AS f FROM cef_lines WHERE event_id % 5 = 4),
x AS (SELECT event_id, f[2] || '/' || f[3] AS maker, f[5] AS code, string_split(f[6], chr(9)) AS a FROM f),
y AS (SELECT event_id, maker, code, map_from_entries(list_transform(a, lambda p:
  {{'k': split_part(p, '=', 1), 'v': substr(p, strpos(p, '=') + 1)}})) AS m FROM x)
SELECT event_id, 'generic' AS event_type, {level("m['sev']")} AS severity, m['dst'] AS host, maker AS process,
  m['usrName'] AS "user", m['src'] AS ip,
  '[LEEF] ' || maker || ' | EventID=' || code || ' | src=' || m['src'] || ' | user=' || m['usrName'] AS message,
  m['note'] AS note FROM y"""

JSON = f"""WITH {base()}, lv AS (SELECT *,
  ['error', 'WARN', 'info', 'fatal', 'odd', 'debug', 'notice'][event_id % 7 + 1] AS lvl FROM base),
lines AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN
  '{{"timestamp":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z","host":"' || host || '","service":"' || event_type ||
  '","level":"' || lvl || '","message":"m ' || event_id || '","user":"' || "user" || '","ip":"' || ip ||
  '","pid":' || (event_id % 9) || ',"props":' || props || '}}'
  ELSE '{{"time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.' || strftime(ts, '%g') || '","hostname":"' || host ||
  '","app":"x","loglevel":"' || lvl || '","event":"e ' || event_id || '","username":"","src_ip":"' || ip || '"}}' END AS raw
  FROM lv WHERE event_id % 30 <> 17),
j AS (SELECT event_id, raw, raw::JSON AS j FROM lines),
k AS (SELECT *, lower(coalesce(j->>'level', j->>'loglevel')) AS lvl, coalesce(j->>'timestamp', j->>'time') AS tm FROM j)
SELECT event_id, 'generic' AS event_type, CASE WHEN lvl IN ('critical', 'fatal') THEN 'CRITICAL'
  WHEN lvl IN ('error', 'err') THEN 'ERROR' WHEN lvl IN ('warning', 'warn') THEN 'WARNING'
  WHEN lvl IN ('info', 'notice') THEN 'INFO' WHEN lvl = 'debug' THEN 'DEBUG' ELSE 'UNKNOWN' END AS severity,
  epoch_us(replace(replace(tm, 'Z', ''), 'T', ' ')::TIMESTAMP) AS ts, coalesce(j->>'host', j->>'hostname') AS host,
  coalesce(j->>'service', j->>'app') AS process, j->>'pid' AS pid,
  nullif(coalesce(j->>'user', j->>'username'), '') AS "user", coalesce(j->>'ip', j->>'src_ip') AS ip,
  coalesce(j->>'message', j->>'event') AS message, raw FROM k"""

WINDOWS = f"""WITH {base()}, c AS (SELECT *, CASE event_type WHEN 'error' THEN '4625' WHEN 'view' THEN '4776'
  WHEN 'click' THEN '4624' WHEN 'signup' THEN '4720' ELSE CASE WHEN event_id % 2 = 0 THEN '4688' ELSE '4732' END END AS code,
  "user" || CASE WHEN event_id % 13 = 5 THEN '$' ELSE '' END AS account,
  CASE WHEN event_id % 11 = 3 THEN '-' ELSE ip END AS address FROM base),
d AS (SELECT *, '<Event xmlns="http://schemas.microsoft.com/win/2004/08/events/event"><System><EventID>' || code ||
  '</EventID><TimeCreated SystemTime="' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000000000Z"/><Computer>' || host ||
  '</Computer></System><EventData><Data Name="TargetUserName">' || account || '</Data><Data Name="IpAddress">' || address ||
  '</Data><Data Name="LogonType">' || (event_id % 12) || '</Data><Data Name="SubjectUserName">' || "user" ||
  '</Data><Data Name="NewProcessName">C:\\x.exe</Data><Data Name="MemberName">' || "user" || '</Data></EventData></Event>' AS raw,
  code IN ('4624', '4625', '4776') AS logon,
  CASE (event_id % 12)::VARCHAR {' '.join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in fixed.WINDOWS_LOGON_TYPES.items())} END AS lt FROM c)
SELECT event_id, CASE code {' '.join(f"WHEN '{k}' THEN {lit(v[0])}" for k, v in fixed.WINDOWS_EVENTS.items())} END AS event_type,
  CASE code {' '.join(f"WHEN '{k}' THEN {lit(v[1])}" for k, v in fixed.WINDOWS_EVENTS.items())} END AS severity,
  epoch_us(date_trunc('second', ts)) AS ts, host, 'EventID-' || code AS process,
  CASE WHEN logon OR code = '4720' THEN account ELSE "user" END AS "user",
  CASE WHEN logon AND address <> '-' THEN address END AS ip,
  'EventID ' || code || ': ' || CASE WHEN logon THEN CASE code WHEN '4625' THEN 'Failed' ELSE 'Successful' END ||
    ' logon for ' || account || ' from ' || address || coalesce(' [' || lt || ']', '')
    WHEN code = '4688' THEN 'Process created by ' || "user" || ': C:\\x.exe'
    WHEN code = '4720' THEN 'User account created: ' || account || ' by ' || "user"
    ELSE "user" || ' added to group ' || account END AS message, raw
FROM d WHERE NOT (code IN ('4624', '4625') AND ends_with(account, '$'))"""

GRID = """grid AS (SELECT ip, w AS window_start, w + {length} AS window_end, count(*) AS events, max(ts) AS last_seen
  FROM (SELECT ip, ts, unnest(generate_series(ts - ts % {step} - {length} + {step}, ts - ts % {step}, {step})) AS w FROM src)
  GROUP BY ip, w HAVING count(*) >= {least} AND w + {length} <= (SELECT max(ts) FROM src) - 3600000000)"""


def grid(where: str, window: int, step: int, least: int) -> str:
    return (f"{events_ctes()}, src AS (SELECT * FROM ev WHERE event_type = 'auth_failure' AND ip <> '' "
            f"AND ts IS NOT NULL AND {where}), "
            + GRID.format(length=window + step, step=step, least=least))


_CUSTOMER = """SELECT c_custkey AS event_id, 'generic' AS event_type, 'UNKNOWN' AS severity, NULL::BIGINT AS ts, '' AS host,
  c_mktsegment AS process, NULL::VARCHAR AS pid, c_name AS "user", '10.0.0.' || (c_custkey % 256) AS ip,
  CASE WHEN c_custkey % 4 = 0 THEN ' ' || c_mktsegment || ' ' || c_name || ' 10.0.0.' || (c_custkey % 256) || ' ' || c_nationkey
    ELSE c_name END AS message,
  CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END || ',' || c_mktsegment || ',' || c_name || ',10.0.0.' ||
  (c_custkey % 256) || ',' || c_nationkey AS raw FROM customer"""

_RANGE = """r AS (SELECT 167772160 + (n_nationkey % 4) * 256 + (n_nationkey // 4) * 4 AS s, n_nationkey AS n, n_name FROM nation),
addr AS (SELECT *, CASE WHEN ip IS NOT NULL THEN list_reduce(list_transform(string_split(ip, '.'), lambda x: x::BIGINT),
  lambda a, b: a * 256 + b) END AS num FROM ev)"""

_SPLIT_IPS = "(SELECT DISTINCT '10.0.' || (n_nationkey % 4) || '.' || n_nationkey AS v FROM nation)"
_SPLIT_USERS = "(SELECT DISTINCT 'u' || (s_suppkey % 11) AS v FROM supplier)"


def _split_reason(ips: str, users: str, reason_ips: str, reason_users: str, rows: str = "findings") -> str:
    return f"""SELECT finding_id, CASE WHEN {ips} THEN {reason_ips} WHEN {users} THEN {reason_users} ELSE 'kept' END AS reason FROM {rows}"""


def _listed(values: str, kind: str) -> str:
    return f"""{kind}_out AS MATERIALIZED (SELECT DISTINCT finding_id, true AS {kind}_outside
  FROM (SELECT DISTINCT finding_id, "{kind}" AS v FROM evidence WHERE "{kind}" <> '') ANTI JOIN {values} USING (v))"""


_failed = "SELECT ts, \"user\" FROM ev WHERE event_type = 'sudo' AND ts IS NOT NULL AND contains(lower(message), 'authentication failure') AND \"user\" <> 'u2'"

ORACLES: dict[str, str] = {
    "syslog_parse": f"{events_ctes()} SELECT {EVENT_VIEW} FROM ev",
    "syslog_parse_text": f"""WITH lines AS (SELECT doc_id AS event_id,
  unnest(string_split_regex(text, '\\r\\n|\\r|\\n')) AS value FROM documents), {parsed()}
SELECT event_id, event_type, severity, count(*) AS lines, sum(length(message))::BIGINT AS chars FROM ev GROUP BY ALL""",
    "cef_parse": CEF, "leef_parse": LEEF, "json_parse": JSON,
    "json_document_parse": f"""WITH {base()} SELECT 1::BIGINT AS rows_of_id, event_type AS message, "user", ip,
  event_id::VARCHAR AS pid, row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id) AS line_number FROM base""",
    "files_load": f"""SELECT 'auth' AS file, event_type, severity, ts, host, "user", ip, message
FROM ({events_ctes()} SELECT {EVENT_VIEW} FROM ev)
UNION ALL SELECT 'gateway', event_type, severity, ts, host, "user", ip, message FROM ({CEF})
UNION ALL SELECT 'gateway', event_type, severity, NULL, host, "user", ip, message FROM ({LEEF})
UNION ALL SELECT 'app', event_type, severity, ts, host, "user", ip, message FROM ({JSON})""",
    "files_ids": f"{events_ctes()} SELECT message, count(*) AS lines FROM ev GROUP BY message",
    "files_csv": """SELECT CASE WHEN c_custkey % 3 = 0 THEN c_name || chr(10) || '"' || c_mktsegment || '"' || chr(10) || 'end'
  ELSE c_name END AS message, c_name AS "user", '10.0.0.' || (c_custkey % 256) AS ip,
  concat_ws(',', message, c_name, ip, c_custkey) AS raw FROM customer""",
    "csv_parse": _CUSTOMER, "windows_parse": WINDOWS,
    "reclassified": """SELECT 'auth_success' AS event_type, 'INFO' AS severity, role AS "user", '10.1.1.1' AS ip,
  count(*) AS n, sum(length('Accepted password for ' || role || ' from 10.1.1.1: ' || text))::BIGINT AS chars
  FROM conversations GROUP BY role""",
    "filter_severity": f"{events_ctes()} SELECT {EVENT_VIEW} FROM ev WHERE severity = 'WARNING'",
    "filter_keyword": f"{events_ctes()} SELECT {EVENT_VIEW} FROM ev WHERE contains(lower(message), 'invalid user')",
    "filter_type": f"{events_ctes()} SELECT {EVENT_VIEW} FROM ev WHERE event_type = 'auth_success'",
    "filter_limit": f"""{events_ctes()} SELECT {EVENT_VIEW} FROM ev WHERE severity = 'ERROR'
  AND contains(lower(message), 'u7 ') AND event_type = 'auth_failure' ORDER BY event_id LIMIT 25""",
    "event_export": f"""{events_ctes()} SELECT event_type, severity, ts, host, process, "user", ip, message, source FROM ev""",
    "peak_count": f"""{events_ctes()}, f AS (SELECT * FROM ev WHERE event_type = 'auth_failure' AND ip IS NOT NULL),
{peaks('p', 'f', 6 * HOUR, False)} SELECT ip, peak, t0 AS peak_start, peak_rows FROM p""",
    "peak_distinct": f"""{events_ctes()}, f AS (SELECT * FROM ev WHERE event_type = 'auth_failure' AND ip IS NOT NULL),
{peaks('p', 'f', 6 * HOUR, True)} SELECT ip, peak, t0 AS peak_start, peak_rows FROM p""",
    "brute_force": case() + finding_view(
        "rule_id = 'brute_force'", ", m1 AS total, m2 AS burst_count, m3 AS burst_start"),
    "brute_force_evidence": case() + """SELECT finding_id, event_id, ts, "user" FROM evidence
  WHERE starts_with(finding_id, 'brute_force|')""",
    "password_spray": case() + finding_view(
        "rule_id = 'password_spray'", ", m1 AS distinct_users, m2 AS total_attempts"),
    "password_spray_partial": case(q.Params(spray_window_sec=6 * 3600)) + finding_view(
        "rule_id = 'password_spray'", ", m1 AS distinct_users, m2 AS total_attempts"),
    "password_spray_evidence": case() + """SELECT finding_id, event_id, ts, "user" FROM evidence
  WHERE starts_with(finding_id, 'password_spray|')""",
    "enumeration": case() + finding_view("rule_id = 'enumeration'", ", m1 AS distinct_invalid"),
    "priv_esc": case() + finding_view("rule_id = 'priv_esc'"),
    "priv_esc_per_host": case(None, False, "'|' || host") + finding_view("rule_id = 'priv_esc'"),
    "priv_esc_evidence": case() + """SELECT finding_id, count(*) AS events, sum(event_id)::BIGINT AS id_sum,
  count(DISTINCT "user") AS users FROM evidence WHERE starts_with(finding_id, 'priv_esc|') GROUP BY finding_id""",
    "auth_success": case() + finding_view("rule_id = 'auth_success'"),
    "detect_all": case() + """SELECT rule_id, severity, confidence, count(*) AS findings,
  sum(event_count)::BIGINT AS events FROM findings GROUP BY ALL""",
    "detect_one_rule": case() + finding_view("rule_id = 'enumeration'"),
    "allowlist_events": case(q.ALLOWED) + "SELECT finding_id, rule_id, severity, event_count, n_users FROM findings",
    "allowlist_findings": case() + _split_reason(
        _all_in("ips", q.ALLOWED.allowed_ips), _all_in("users", q.ALLOWED.allowed_users),
        "'all source IPs allowlisted: ' || array_to_string(ips, ', ')",
        "'all targeted users allowlisted: ' || array_to_string(users, ', ')"),
    "allowlist_table": case() + f", {_listed(_SPLIT_IPS, 'ip')}, {_listed(_SPLIT_USERS, 'user')} " + _split_reason(
        "n_source_ips > 0 AND ip_outside IS NULL", "n_users > 0 AND user_outside IS NULL",
        "'all source IPs allowlisted'", "'all targeted users allowlisted'",
        "findings LEFT JOIN ip_out USING (finding_id) LEFT JOIN user_out USING (finding_id)"),
    "geo_enrich": f"""{events_ctes()}, {_RANGE} SELECT event_id, ip, substr(n_name, 1, 2) AS country, n_name AS country_name,
  lower(n_name) AS city, n::DOUBLE AS latitude, (-n)::DOUBLE AS longitude, (n + 64512)::INTEGER AS asn,
  'net ' || n_name AS asn_org FROM addr LEFT JOIN r ON num BETWEEN s AND s + 2""",
    "geo_prefixes": """WITH a AS (SELECT event_id, user_id % 4 AS net, user_id % 20 AS host FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN '2001:db8:' || net || ':' || lower(to_hex(host)) || '::7'
  ELSE '10.0.' || net || '.' || host END AS ip, coalesce(narrow.n_name, wide.n_name) AS name
FROM a LEFT JOIN nation wide ON wide.n_nationkey = net
LEFT JOIN nation narrow ON narrow.n_nationkey = host AND narrow.n_nationkey BETWEEN 4 AND 19 AND host % 4 = net""",
    "own_detector": case() + finding_view(
        "rule_id = 'enumeration' OR (rule_id = 'auth_success' AND users[1] = 'u1')"),
    "own_enricher": f"""{events_ctes()}, {_RANGE}, x AS (SELECT ip, n_name, host
  FROM addr LEFT JOIN r ON num BETWEEN s AND s + 2)
SELECT concat_ws('/', substr(n_name, 1, 2), host) AS place, count(*) AS events, count(ip) AS with_address FROM x GROUP BY place""",
    "correlation_off": case() + "SELECT rule_id, false AS is_correlated, count(*) AS findings FROM findings GROUP BY rule_id",
    "report_written": case() + """, m AS (
  SELECT DISTINCT finding_id, 'ip' AS kind, ip AS value FROM evidence WHERE ip <> ''
  UNION ALL SELECT DISTINCT finding_id, 'user', "user" FROM evidence WHERE "user" <> '')
SELECT 'findings' AS name, count(*) AS row_count FROM findings UNION ALL SELECT 'export', count(*) FROM findings
UNION ALL SELECT 'evidence', count(*) FROM evidence
UNION ALL SELECT 'actions', count(DISTINCT recommendation) FROM findings
UNION ALL SELECT 'timeline', (SELECT count(*) FROM (SELECT DISTINCT first_seen, rule_id, description FROM findings))
  + (SELECT count(*) FROM (SELECT DISTINCT ts, source, raw FROM evidence))
UNION ALL SELECT 'members ' || kind, count(*) FROM m GROUP BY kind""",
    "correlate_reference": f"{case(q.DAILY, True)}, {reference_chains(q.DAILY)} {chain_view()}",
    "correlate_evidence": f"""{case(q.DAILY, True)}, {reference_chains(q.DAILY)},
u AS (SELECT rule_id || '|' || ids AS finding_id, unnest(base) AS member, generate_subscripts(base, 1) AS pos FROM chains),
v AS (SELECT u.finding_id, e.event_id, row_number() OVER (PARTITION BY u.finding_id ORDER BY pos, ts NULLS LAST, event_id) AS nr
  FROM u JOIN evidence e ON e.finding_id = u.member)
SELECT finding_id, count(*) AS events, sum(event_id)::BIGINT AS id_sum FROM v GROUP BY finding_id""",
    "correlate_own_rules": own_rules(),
    "correlate_keyed": keyed(),
    "severity_filter": case() + f"SELECT finding_id, severity FROM findings WHERE {rank('severity', fixed.FILTER_RANK)} <= 2",
    "info_hidden": case() + "SELECT finding_id, severity FROM findings WHERE severity <> 'INFO'",
    "findings_flat": case() + """SELECT rule_id, title, severity, confidence, first_seen, last_seen, event_count,
  array_to_string(coalesce(ips, []), ';') AS source_ips, array_to_string(coalesce(users, []), ';') AS users,
  false AS is_correlated FROM findings""",
    "findings_listing": case() + f"""SELECT row_number() OVER (ORDER BY {ORDER}) AS nr, severity, rule_id, title, event_count FROM findings""",
    "report_summary": case() + f"""SELECT count(*) AS total_findings, count(*) FILTER (severity = 'CRITICAL') AS critical,
  count(*) FILTER (severity = 'HIGH') AS high, count(*) FILTER (severity = 'MEDIUM') AS medium,
  count(*) FILTER (severity = 'LOW') AS low, 0::BIGINT AS correlated, sum(event_count)::BIGINT AS evidence_events,
  (SELECT count(DISTINCT ip) FROM evidence) AS n_source_ips, (SELECT count(DISTINCT "user") FROM evidence) AS n_users,
  CASE WHEN critical > 0 THEN {lit(fixed.STATUS_TEXT['critical'])} WHEN high > 0 THEN {lit(fixed.STATUS_TEXT['high'])}
    ELSE {lit(fixed.STATUS_TEXT['review'])} END AS status FROM findings""",
    "report_names": case() + """SELECT DISTINCT 'ip' AS kind, ip AS value FROM evidence WHERE ip IS NOT NULL
  UNION ALL SELECT DISTINCT 'user', "user" FROM evidence WHERE "user" IS NOT NULL""",
    "report_timeline": case() + f""", tl AS (SELECT first_seen AS ts, 'finding' AS kind, severity,
    coalesce(ips[1], users[1], 'unknown') AS actor, title AS action, description AS detail, rule_id AS source,
    description AS key, {rank('severity', fixed.REPORT_RANK)} AS place, finding_rank AS event_id, finding_id FROM findings
  UNION ALL SELECT ts, 'event', severity, coalesce(ip, "user", nullif(host, ''), 'unknown'), event_type, message, source,
    raw, 10, event_id, finding_id FROM evidence)
SELECT ts, kind, severity, actor, action, detail, source FROM tl
QUALIFY row_number() OVER (PARTITION BY ts, kind, source, key ORDER BY place, event_id, finding_id) = 1""",
    "report_actions": case() + f""", a AS (SELECT * FROM findings
  QUALIFY row_number() OVER (PARTITION BY recommendation ORDER BY {ORDER}) = 1)
SELECT row_number() OVER (ORDER BY {ORDER}) AS nr, severity, recommendation, finding_id FROM a""",
    "report_evidence_summary": case() + "SELECT source, count(*) AS evidence_events FROM evidence GROUP BY source",
    "report_evidence_lines": case() + f"""SELECT f.finding_id, f.title, f.severity, e.raw FROM evidence e JOIN findings f USING (finding_id)
  QUALIFY row_number() OVER (PARTITION BY e.raw ORDER BY {F_ORDER}) = 1""",
    "report_capped_evidence": case() + """SELECT finding_id, row_number() OVER w AS ord, event_id FROM evidence
  WINDOW w AS (PARTITION BY finding_id ORDER BY ts NULLS LAST, event_id) QUALIFY ord <= 10""",
    "report_export": case() + """, o AS (SELECT finding_id, message, row_number() OVER (PARTITION BY finding_id
  ORDER BY ts NULLS LAST, event_id) AS ord FROM evidence),
n AS (SELECT finding_id, count(*) AS evidence_rows, max(message) FILTER (ord = 1) AS first_message FROM o GROUP BY finding_id)
SELECT finding_id, strftime(make_timestamp(first_seen), '%Y-%m-%d %H:%M:%S') AS first_seen, event_count,
  false AS is_correlated, evidence_rows, first_message FROM findings JOIN n USING (finding_id)""",
    "stream_parse": f"{events_ctes()} SELECT {EVENT_VIEW} FROM ev",
    "stream_logins": case(q.ALLOWED) + "SELECT finding_id, title, severity FROM found WHERE rule_id = 'auth_success'",
    "stream_untimed": f"{events_ctes()} SELECT {EVENT_VIEW} FROM ev WHERE ts IS NULL",
    "stream_brute_force": grid("true", 6 * HOUR, 2 * HOUR, 5) + """,
inside AS (SELECT g.ip, g.window_start, s.ts FROM grid g JOIN src s ON s.ip = g.ip AND s.ts >= g.window_start AND s.ts < g.window_end),
pk AS (SELECT a.ip, a.window_start, a.ts AS t0, count(*) AS peak FROM (SELECT DISTINCT * FROM inside) a
  JOIN inside b ON a.ip = b.ip AND a.window_start = b.window_start AND b.ts BETWEEN a.ts AND a.ts + 21600000000 GROUP BY ALL)
SELECT ip, window_start, peak, t0 AS peak_start FROM pk
QUALIFY peak >= 5 AND row_number() OVER (PARTITION BY ip, window_start ORDER BY peak DESC, t0) = 1""",
    "stream_candidates": grid("\"user\" <> ''", 6 * HOUR, 2 * HOUR, 5) + "SELECT * FROM grid",
    "stream_enumeration": grid(words("lower(message)", fixed.INVALID_USER_MARKERS), DAY, 6 * HOUR, 5) + "SELECT * FROM grid",
    "stream_findings": case(q.ALLOWED) + finding_view("true"),
    "stream_evidence": case(q.ALLOWED) + """SELECT finding_id, count(*) AS events, sum(event_id)::BIGINT AS id_sum
  FROM evidence GROUP BY finding_id""",
    "stream_chains": keyed(),
    "stream_late": events_ctes() + """, p AS (SELECT event_id, ts, CASE WHEN event_id % 5 = 0 THEN 3
  ELSE coalesce(day(make_timestamp(ts)) // 11, 1) END AS batch FROM ev),
m AS (SELECT batch, max(ts) AS latest FROM p GROUP BY batch),
w AS (SELECT b.batch, (SELECT max(latest) FROM m WHERE m.batch < b.batch - 1) - 5 * 86400000000 AS mark
  FROM (SELECT DISTINCT batch FROM p) b)
SELECT event_id, batch::BIGINT AS batch, CASE WHEN ts IS NULL THEN 'untimed'
  WHEN ts // 3600000000 * 3600000000 + 3600000000 <= mark THEN 'late' ELSE 'in_time' END AS arrival
FROM p JOIN w USING (batch)""",
    "stream_failed_sudo": f"""{events_ctes()}, src AS ({_failed}),
  days AS (SELECT "user", ts - ts % {DAY} AS window_start, count(*) AS failed_count FROM src GROUP BY ALL)
SELECT * FROM days WHERE failed_count >= 2 AND window_start + {DAY} <= (SELECT max(ts) FROM src) - {HOUR}""",
    "stream_followed_by_login": f"""{events_ctes()} SELECT DISTINCT 'brute_then_success' AS rule_id, a.ip FROM ev a
  JOIN ev b ON a.ip = b.ip AND a.event_type = 'auth_failure' AND b.event_type = 'auth_success'
  AND b.ts BETWEEN a.ts - a.ts % {HOUR} AND a.ts - a.ts % {HOUR} + {HOUR}""",
}
