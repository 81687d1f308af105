"""Fixed values of the detection domain, and the thresholds a caller may change."""

from __future__ import annotations

from dataclasses import dataclass

# Patterns, word lists, lookup tables and formats of the log formats and rules.
SOURCES = ("linux_auth", "nginx_access", "windows_security", "cloud_audit")
ID_PREFIX = {"linux_auth": "lx", "nginx_access": "ng", "windows_security": "win", "cloud_audit": "cld"}
STEMS = {
    "linux_auth": "linux_auth",
    "nginx_access": "nginx_access",
    "nginx_auth_bruteforce": "nginx_access",
    "windows_security": "windows_security",
    "cloud_audit": "cloud_audit",
}
SYSLOG_LINE = (
    r"^(\w+\s+\d+\s+[\d:]+)\s+(\S+)\s+(?:sshd\[\d+\]:\s+(?:Failed password for(?: invalid user)?\s+(\S+)\s+from\s+(\S+)|Invalid user\s+(\S+)\s+from\s+(\S+)"
    r"|Accepted password for\s+(\S+)\s+from\s+(\S+))|sudo\s*:\s+(\S+)\s+:(?:(?=.*(NOT in sudoers))|.*(COMMAND=)(.*))).*$"
)
ACCESS_LINE = r'^(\S+)\s+-\s+(\S+)\s+\[([^\]]+)\]\s+"(\S+)\s+(\S+)\s+\S+"\s+(\d+)\s+\d+\s+"[^"]*"\s+"([^"]*)".*$'
JNDI = "${jndi:"
SHAPING_PAYLOADS = ("union select", "or '1'='1", "../", "/etc/passwd", ";whoami", "${jndi:")
EXPLOIT_PAYLOADS = (
    "union select", "or 1=1", "' or '1'='1", "information_schema", "sleep(",
    "../", "/etc/passwd", "/etc/shadow",
    "<script", "onerror=", "javascript:",
)
COMMAND_INJECTION = r"(?i)[;|]\s*(cat|ls|id|whoami|uname|curl|wget|nc|bash|sh)\b"
SCANNERS = ("sqlmap", "nikto", "nmap", "masscan", "gobuster", "dirbuster")
LABEL_SCANNERS = ("sqlmap", "nikto", "nmap", "masscan", "dirbuster")
LOGIN_WORDS = ("login", "signin", "auth", "session")
LOGIN_PATHS = ("/login", "/api/login", "/admin/login", "/signin", "/auth")
SENSITIVE_PATHS = ("/.env", "/.git", "/admin", "/phpmyadmin", "/backup", "/wp-admin", "/config")
HEURISTIC_PATHS = ("/.env", "/.git", "/phpmyadmin", "/admin", "/wp-admin", "/config")
AUTH_FAIL_STATUSES = ("401", "403")
FOUND_STATUSES = ("200", "302")
SENSITIVE_PORTS = (22, 3389, 3306, 5432, 27017)
DATABASE_PORTS = (3306, 5432, 27017)
OPEN_CIDR = "0.0.0.0/0"
NO_TECHNIQUE = ("", "none", "null", "n/a", "na", "-")
TRUE_WORDS = ("true", "yes", "y", "1", "incident", "malicious", "attack", "suspicious")
FALSE_WORDS = ("false", "no", "n", "0", "benign", "normal", "clean", "none")
CONFIDENCE_WORDS = {"high": 0.9, "medium": 0.6, "med": 0.6, "moderate": 0.6, "low": 0.3, "none": 0.0}
CLEARING_PHRASES = ("not an incident", "benign", "no incident", "false")
ALARM_WORDS = ("incident", "malicious", "attack", "brute", "exploit")
# The scenario behind the sample logs: entity, technique, rationale.
SSH_ATTACKERS = (
    ("192.0.2.100", "T1110.001", "Sustained SSH password guessing against root, admin and oracle from one address."),
    ("198.51.100.50", "T1110.001", "Sustained SSH password guessing across many account names from one address."),
    ("203.0.113.99", "T1110.001", "High-volume SSH password guessing that ends in a successful login."),
)
COMPROMISED = (("203.0.113.99", "T1078", "Successful SSH login from an address that had just guessed passwords."),)
WEB_SCANNERS = (
    ("198.51.100.77", "T1595.002", "Automated directory scan with a known scanner user-agent."),
    ("203.0.113.50", "T1083", "Probing of sensitive paths by an automation user-agent."),
)
LOGIN_GUESSERS = (("203.0.113.77", "T1110", "Many failed web logins from one address, then a success."),)
LOGON_GUESSERS = (("WIN-SERVER01", "192.0.2.150", "T1110.001", "Burst of failed Windows logons before a new account appears."),)


@dataclass(frozen=True)
class Scenario:
    """Who is known to have attacked: rows of entity (or host and address), technique, rationale."""

    ssh: tuple = SSH_ATTACKERS
    compromised: tuple = COMPROMISED
    scanners: tuple = WEB_SCANNERS
    web_logins: tuple = LOGIN_GUESSERS
    logons: tuple = LOGON_GUESSERS


@dataclass(frozen=True)
class RuleConfig:
    """Thresholds; counts must exceed them."""

    ssh: int = 10
    web_login: int = 20
    not_found: int = 30
    windows: int = 3
    account_minutes: int = 60


@dataclass(frozen=True)
class ShapeConfig:
    """Least sizes of bursts, and how many sample lines a unit keeps."""

    windows: int = 5
    login_posts: int = 5
    scan: int = 10
    samples: int = 4
    sample_paths: int = 6
    #: whether a login burst's unit also holds all its statuses one by one, beside their runs
    full_sequences: bool = False
    #: stretch of time whose statuses are put into runs together, before runs of one address meet
    run_minutes: int = 10
