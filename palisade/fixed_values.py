"""Patterns, word lists, code tables, defaults and report texts.

Everything in this module is a value that results depend on.  It is stated
here once, as plain text, and the rest of the package refers to it.
"""

# ---------------------------------------------------------------- events
EVENT_TYPES = (
    "auth_failure", "auth_success", "sudo", "su", "user_created",
    "user_deleted", "group_change", "session_open", "session_close", "generic",
)
SEVERITIES = (
    "CRITICAL", "ERROR", "WARNING", "INFO", "DEBUG", "UNKNOWN",
    "HIGH", "MEDIUM", "LOW",
)
CONFIDENCES = ("HIGH", "MEDIUM", "LOW")

# ------------------------------------------------------------- rank tables
# ranks of the minimum-severity filter; anything else is 9
FILTER_RANK = {
    "CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4,
    "ERROR": 1, "WARNING": 2, "UNKNOWN": 5,
}
# rank used for an unknown argument of that filter
UNKNOWN_ARGUMENT_RANK = 5
# ranks of report order; anything else is 9
REPORT_RANK = {"CRITICAL": 0, "HIGH": 1, "MEDIUM": 2, "LOW": 3, "INFO": 4}
OTHER_RANK = 9

# ------------------------------------------------------------------ syslog
SYSLOG_TIME_FORMAT = "yyyy MMM d H:m:s"
SYSLOG_TIME = r"^(\w{3}\s+\d+\s+[\d:]+)"
SYSLOG_HEADER = r"^\w{3}\s+\d+\s+[\d:]+\s+(\S+)\s+(\S+?)(?:\[(\d+)\])?:\s+(.+)$"
DOTTED_QUAD = r"^\d{1,3}(?:\.\d{1,3}){3}$"

# first match wins; (process or None, pattern, event type, severity)
# group 1 is the user, group 2 the address when it is a dotted quad
SYSLOG_RULES = (
    (None, r"Failed password for (?:invalid user )?(\S+) from ([\d.]+)", "auth_failure", "ERROR"),
    (None, r"authentication failure.*user=(\S+).*rhost=([\d.]+)", "auth_failure", "ERROR"),
    (None, r"Invalid user (\S+) from ([\d.]+)", "auth_failure", "WARNING"),
    (None, r"pam_unix.*authentication failure.*user=(\S+)", "auth_failure", "ERROR"),
    (None, r"Accepted (?:password|publickey) for (\S+) from ([\d.]+)", "auth_success", "INFO"),
    ("sudo", r"^(\S+)\s+:.*COMMAND=(.+)", "sudo", "INFO"),
    ("sudo", r"authentication failure.*user=(\S+)", "sudo", "WARNING"),
    (None, r"pam_unix.*su.*session opened for user (\S+)", "su", "INFO"),
    (None, r"Successful su for (\S+)", "su", "WARNING"),
    (None, r"session opened for user (\S+)", "session_open", "INFO"),
    (None, r"session closed for user (\S+)", "session_close", "INFO"),
    (None, r"new user: name=([^,\s]+)", "user_created", "WARNING"),
    (None, r"delete user (\S+)", "user_deleted", "WARNING"),
    (None, r"(?:groupadd|usermod).*(?:group|user) ([^,\s]+)", "group_change", "WARNING"),
)

# -------------------------------------------------------------- CEF / LEEF
CEF_FAILURE_WORDS = ("login fail", "logon fail", "auth fail", "invalid", "denied")
CEF_SUCCESS_WORDS = ("login success", "logon success", "auth success", "accepted")
CEF_SUDO_WORDS = ("sudo", "privilege", "escalat")
CEF_CREATED_WORDS = ("user creat", "useradd", "account creat")
CEF_IP_KEYS = ("src", "sourceAddress", "dst", "destinationAddress", "shost", "dhost")
CEF_USER_KEYS = ("suser", "duser", "sourceUserName", "destinationUserName", "act", "spriv")
CEF_TIME_KEYS = ("rt", "end", "start", "deviceReceiptTime")
CEF_HOST_KEYS = ("dhost", "shost")
CEF_ERROR_WORDS = ("high", "critical", "emergency")
CEF_WARNING_WORDS = ("medium", "warning")
# lowest number of each severity step; below the last one is DEBUG
CEF_SEVERITY_STEPS = ((9, "CRITICAL"), (7, "ERROR"), (4, "WARNING"), (1, "INFO"))
LEEF_SEVERITY_KEYS = ("sev", "severity")
LEEF_DEFAULT_SEVERITY = "5"
LEEF_IP_KEYS = ("src", "srcIP")
LEEF_USER_KEYS = ("usrName", "suser")

# -------------------------------------------------------------- JSON / CSV
JSON_MESSAGE_KEYS = ("message", "msg", "event")
JSON_HOST_KEYS = ("host", "hostname")
JSON_PROCESS_KEYS = ("process", "service", "app")
JSON_PID_KEYS = ("pid",)
JSON_USER_KEYS = ("user", "username")
JSON_IP_KEYS = ("ip", "src_ip", "remote_ip")
JSON_SEVERITY_KEYS = ("level", "severity", "loglevel", "log_level")
JSON_TIME_KEYS = ("timestamp", "time", "@timestamp", "date")
JSON_SEVERITY_MAP = {
    "critical": "CRITICAL", "fatal": "CRITICAL", "error": "ERROR", "err": "ERROR",
    "warning": "WARNING", "warn": "WARNING", "info": "INFO", "notice": "INFO",
    "debug": "DEBUG",
}
# a date, 'T' or blank, a time, an optional fraction of 1-6 digits, an
# optional Z; the blank form has neither fraction nor Z
JSON_TIME_SHAPES = (
    r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(?:\.\d{1,6})?Z?$",
    r"^\d{4}-\d{1,2}-\d{1,2}\s+\d{1,2}:\d{1,2}:\d{1,2}$",
)
CSV_MESSAGE_COLUMNS = ("message", "msg", "event", "description")
CSV_HOST_COLUMNS = ("host", "hostname", "src")
CSV_PROCESS_COLUMNS = ("process", "service")
CSV_PID_COLUMNS = ("pid",)
CSV_USER_COLUMNS = ("user", "username")
CSV_IP_COLUMNS = ("ip", "src_ip", "remote_ip")

# ----------------------------------------------------- Windows Security XML
WINDOWS_EVENTS = {
    4624: ("auth_success", "INFO"),
    4625: ("auth_failure", "ERROR"),
    4688: ("generic", "INFO"),
    4720: ("user_created", "WARNING"),
    4732: ("group_change", "WARNING"),
    4776: ("auth_failure", "ERROR"),
}
WINDOWS_LOGON_TYPES = {
    "2": "Interactive", "3": "Network", "4": "Batch", "5": "Service",
    "7": "Unlock", "8": "NetworkCleartext", "9": "NewCredentials",
    "10": "RemoteInteractive", "11": "CachedInteractive",
}
WINDOWS_PLACEHOLDERS = ("-", "-\\-", "N/A", "NULL SID")

# --------------------------------------------------------------- detectors
INVALID_USER_MARKERS = ("invalid user", "no such user", "unknown user", "user unknown")
SUDO_FAILURE_MARKERS = ("authentication failure", "incorrect password")
HIGH_RISK_COMMANDS = (
    "/bin/bash", "/bin/sh", "/bin/zsh",
    "/usr/bin/passwd", "/usr/bin/chsh",
    "/usr/sbin/useradd", "/usr/sbin/usermod", "/usr/sbin/userdel",
    "/usr/sbin/visudo", "/etc/sudoers",
    "chmod", "chown", "/etc/shadow", "/etc/passwd",
    "nc ", "netcat", "ncat", "curl", "wget",
    "python", "perl", "ruby", "php",
)
BRUTE_FORCE_THRESHOLD = 5
BRUTE_FORCE_WINDOW_SEC = 1800
SPRAY_THRESHOLD = 10
SPRAY_WINDOW_SEC = 300
ENUMERATION_THRESHOLD = 5
FAILED_SUDO_THRESHOLD = 3
CORRELATION_WINDOW_SEC = 3600
CORRELATED_EVIDENCE_CAP = 500
EXPORTED_EVIDENCE_CAP = 100
TIMELINE_KEY_CHARS = 120
TIMELINE_DETAIL_CHARS = 200
ACTION_KEY_CHARS = 60
# how many names a text lists before "(+n more)"
BRUTE_USERS_SHOWN = 5
SPRAY_USERS_SHOWN = 8
ENUMERATION_USERS_SHOWN = 10
COMMANDS_SHOWN = 5

# ------------------------------------------------------------ report texts
BRUTE_FORCE_TEXT = {
    "title": "Brute force attack from {ip}",
    "description": (
        "{ip} made {total} failed login attempt(s), with a peak burst of {burst} "
        "within {minutes} minutes. Targeted account(s): {users}."
    ),
    "recommendation": (
        "Block {ip} at the firewall. Review whether any targeted accounts were later "
        "successfully authenticated. Consider enabling fail2ban or equivalent."
    ),
}
PASSWORD_SPRAY_TEXT = {
    "title": "Password spray from {ip}",
    "description": (
        "{ip} targeted {distinct} distinct account(s) with {attempts} attempt(s) within "
        "{minutes} minutes — consistent with a password spray attack. "
        "Accounts targeted: {users}."
    ),
    "recommendation": (
        "Block {ip} at the firewall or rate-limit at the authentication layer. Audit all "
        "targeted accounts for subsequent successful logins. Consider alerting account owners."
    ),
}
ENUMERATION_TEXT = {
    "title": "Account enumeration from {ip}",
    "description": (
        "{ip} probed {distinct} non-existent username(s), suggesting automated account "
        "enumeration. Invalid accounts probed: {users}."
    ),
    "recommendation": (
        "Block {ip} at the firewall. Enumeration is typically a reconnaissance step before "
        "a targeted brute force or spray attack — correlate with subsequent auth failure "
        "findings from the same IP."
    ),
}
AUTH_SUCCESS_TEXT = {
    "title": "Successful login: {user} from {ip}",
    "description": (
        "{user} authenticated successfully from {ip}. This finding exists to enable "
        "correlation rules - on its own it is informational."
    ),
    "recommendation": (
        "Review if this login follows suspicious activity from the same source IP. Check "
        "for brute_then_success or full_attack_chain correlated findings."
    ),
}
HIGH_RISK_SUDO_TEXT = {
    "title": "High-risk sudo command executed",
    "description": (
        "User(s) {users} executed high-risk sudo command(s) that indicate privilege abuse "
        "or potential post-compromise activity: {commands}."
    ),
    "recommendation": (
        "Review these commands immediately. Shell spawns (bash/sh) via sudo are a strong "
        "indicator of privilege escalation. Correlate with preceding authentication events "
        "from the same user."
    ),
}
NORMAL_SUDO_TEXT = {
    "title": "Sudo activity — {count} command(s)",
    "description": (
        "User(s) {users} ran {count} sudo command(s). Review if this is expected for these "
        "accounts."
    ),
    "recommendation": (
        "Verify sudo usage is authorized. If preceded by a brute force or spray finding, "
        "treat as HIGH."
    ),
}
FAILED_SUDO_TEXT = {
    "title": "Repeated failed sudo attempts by {user}",
    "description": (
        "{user} failed sudo authentication {count} time(s). This may indicate password "
        "guessing on a compromised low-privilege account attempting to escalate."
    ),
    "recommendation": (
        "Investigate {user}'s recent login history. If the account was recently "
        "authenticated from an unusual IP, treat as active compromise."
    ),
}
SU_TEXT = {
    "title": "User switching via su to {target}",
    "description": "su was used to switch to account(s): {users}. {root_note}",
    "root_note": "Switching to root is high-risk and warrants immediate review.",
    "recommendation": (
        "Verify su usage is authorized. If the originating session followed unusual "
        "authentication, treat as lateral movement or privilege escalation."
    ),
}
USER_CREATED_TEXT = {
    "title": "New user account created: {names}",
    "description": (
        "{count} new user account(s) created: {names}. Attacker-created accounts are a "
        "common persistence mechanism."
    ),
    "recommendation": (
        "Verify each new account is authorized. If unexpected, disable immediately, audit "
        "sudo/group membership, and check for SSH authorized_keys changes."
    ),
}
GROUP_CHANGE_TEXT = {
    "title": "Group membership changed ({count} event(s))",
    "description": (
        "{count} group membership change(s) detected. Adding users to wheel, sudo, or admin "
        "groups grants elevated privileges."
    ),
    "recommendation": (
        "Verify all group changes are authorized. Pay particular attention to wheel, sudo, "
        "and admin group modifications."
    ),
}
STATUS_TEXT = {
    "critical": "CRITICAL — immediate action required",
    "high": "HIGH — action required",
    "review": "Review recommended",
}
SUPPRESSION_TEXT = {
    "ips": "all source IPs allowlisted",
    "users": "all targeted users allowlisted",
}

# ----------------------------------------------------- correlation rules
# in evaluation order; each step is the set of rule ids that satisfies it
CORRELATION_RULES = (
    {
        "rule_id": "full_attack_chain",
        "title": "Full attack chain detected",
        "steps": (
            ("brute_force", "password_spray"),
            ("brute_then_success", "auth_success"),
            ("priv_esc",),
        ),
        "window_sec": 3600,
        "severity": "CRITICAL",
        "confidence": "HIGH",
        "description": (
            "A complete attack sequence was detected: brute force or spray attack, followed "
            "by successful authentication, followed by privilege escalation. This is the "
            "highest-confidence indicator of a successful intrusion."
        ),
        "recommendation": (
            "CRITICAL — treat as confirmed intrusion. Immediately isolate the affected host. "
            "Preserve forensic evidence (memory dump, disk image) before any remediation. "
            "Escalate to incident response. Notify relevant stakeholders per your IR plan."
        ),
    },
    {
        "rule_id": "brute_then_success",
        "title": "Brute force succeeded",
        "steps": (("brute_force", "password_spray"), ("auth_success",)),
        "window_sec": 600,
        "severity": "CRITICAL",
        "confidence": "HIGH",
        "description": (
            "A brute force or password spray attack from the same source was followed by a "
            "successful authentication. This is a high-confidence indicator of account "
            "compromise."
        ),
        "recommendation": (
            "Treat as active compromise. Immediately: (1) disable the affected account, (2) "
            "block the source IP at the firewall, (3) review all actions taken in the "
            "authenticated session, (4) rotate credentials for the affected account and any "
            "shared passwords."
        ),
    },
    {
        "rule_id": "success_then_priv_esc",
        "title": "Login followed by privilege escalation",
        "steps": (("auth_success",), ("priv_esc",)),
        "window_sec": 1800,
        "severity": "CRITICAL",
        "confidence": "HIGH",
        "description": (
            "A successful authentication was followed by privilege escalation activity "
            "(sudo, su, or user creation). This chain indicates an attacker has gained a "
            "foothold and is attempting to elevate access."
        ),
        "recommendation": (
            "Investigate the authenticated session immediately. Review all commands "
            "executed, files accessed, and network connections made after the login. If "
            "sudo or user creation is confirmed, assume full system compromise and begin "
            "incident response."
        ),
    },
    {
        "rule_id": "enum_then_brute",
        "title": "Enumeration followed by targeted brute force",
        "steps": (("enumeration",), ("brute_force", "password_spray")),
        "window_sec": 1800,
        "severity": "HIGH",
        "confidence": "HIGH",
        "description": (
            "Account enumeration (probing for valid usernames) was followed by a brute force "
            "attack. This two-stage pattern indicates a targeted, methodical attacker rather "
            "than opportunistic scanning."
        ),
        "recommendation": (
            "Block the source IP immediately. The enumeration phase indicates the attacker "
            "now has a list of valid usernames — the subsequent brute force or spray attempt "
            "is targeted. Review all accounts identified during enumeration for unauthorized "
            "access."
        ),
    },
    {
        "rule_id": "persistent_recon",
        "title": "Persistent reconnaissance detected",
        "steps": (("enumeration",), ("enumeration",)),
        "window_sec": 3600,
        "severity": "HIGH",
        "confidence": "MEDIUM",
        "description": (
            "Multiple enumeration findings from the same source suggest persistent, ongoing "
            "reconnaissance rather than a one-off scan. The attacker is systematically "
            "mapping the attack surface."
        ),
        "recommendation": (
            "Block the source IP and investigate whether any of the probed usernames "
            "correspond to real accounts. Consider honeypot accounts to detect future "
            "enumeration attempts early."
        ),
    },
)
