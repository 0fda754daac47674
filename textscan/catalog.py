"""The pattern catalog: labelled regular expressions in a fixed order.

The order matters: when two matches of one label start at the same offset, the
one whose pattern comes first in the catalog is stitched first.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.errors import IllegalArgumentException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values: (group, label, regular expression), in catalog order.
# ---------------------------------------------------------------------------
_FIXED_PATTERNS = [
    ("document", "interrogative_context", r"(?:\b\w+\b\s+){2,5}\b(how|why|what|when|where|who)\b(?:\s+\b\w+\b){2,5}"),
    ("document", "reporting_statement", r"(?:\b\w+\b\s+){2,5}\b\w+(?:\s\w+)*\s+(said|stated|reported|mentioned|claimed|explained|noted|suggested)\b(?:\s+\".*?\"|\s+\b.*?\b[.!?])"),
    ("document", "entity_name", r"(?:\b\w+\b\s+){2,5}\b(by|from|to|with|about|for)\s+([A-Z][a-z]+(?:\s[A-Z][a-z]+)*)(?:\s+\b\w+\b){2,5}"),
    ("document", "all_caps_phrase", r"(?:\b\w+\b\s+){2,5}\b[A-Z]{2,}(?:\s+[A-Z]{2,})*\b(?:\s+\b\w+\b){2,5}"),
    ("document", "quoted_text", r"(?:\b\w+\b\s+){2,5}\".*?\"(?:\s+\b\w+\b){2,5}"),
    ("document", "action_context", r"(?:\b\w+\b\s+){2,5}\b\w+(?:\s+\w+)*\s+(completed|developed|initiated|threatened|investigated)\s+\b.*?[.!?](?:\s+\b\w+\b){2,5}"),
    ("document", "possessive_context", r"(?:\b\w+\b\s+){2,5}(\b[A-Z][a-z]+(?:'s|’s)\s+\w+)|\b(owned by|reported by|handled by)\s+([A-Z][a-z]+)(?:\s+\b\w+\b){2,5}"),
    ("document", "proper_noun", r"(?:\b\w+\b\s+){2,5}\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b(?:\s+\b\w+\b){2,5}"),
    ("document", "adjective_context", r"(?:\b\w+\b\s+){2,5}\b(critical|urgent|significant|dangerous|illegal|fraudulent)\b\s+\w+(?:\s+\b\w+\b){2,5}"),
    ("document", "question_context", r"(?:\b\w+\b\s+){2,5}\b(who|what|why|how|where|when)\b(?:\s+\b\w+\b){2,5}[?]"),
    ("document", "number_context", r"(?:\b\w+\b\s+){2,5}\b\d{1,3}(?:,\d{3})*(?:\.\d+)?(?:\s+(units|percent|completion|days|weeks))?\b(?:\s+\b\w+\b){2,5}"),
    ("document", "threat_context", r"(?:\b\w+\b\s+){2,5}(threat|risk|danger|exploit)(?:\s+\b\w+\b){2,5}[.!?]"),
    ("term", "protocol", r"\b(?i:dns|http|https|ftp|ssh|tcp|ip|udp|ssl|smtp|telnet|ipv4|ipv6|icmp|arp|pop3|imap|smb|nfs|dhcp|tftp|ldap|snmp|sctp|bgp|ospf|rsvp|rtp|rdp|lldp|sip|pim|mpls|gre|ppp|pptp|l2tp|ipsec|nat|stp|rip|eigrp|http2|spdy|quic|sctp|ntp|kerberos|radius|gopher|mqtt|coap|amqp)\b"),
    ("term", "language", r"\b(?i:python|javascript|java|c\+\+|c#|ruby|perl|php|swift|kotlin|go|rust|typescript|scala|r|matlab|bash|shell|powershell|html|css|sql|dart|elixir|erlang|haskell|clojure|f#|visual\s*basic|fortran|cobol|assembly|lisp|prolog|vhdl|verilog|sas|groovy|smalltalk|tcl|awk|ada|pascal|delphi|nim|julia|crystal|objective-c|postscript|apl|scratch|logo|abap|pl/sql)\b"),
    ("term", "file_format", r"\b(?i:txt|pdf|doc|docx|xls|xlsx|csv|json|xml|yaml|html|md|ppt|pptx|png|jpg|jpeg|gif|bmp|tiff|svg|mp3|wav|flac|aac|ogg|mp4|mkv|avi|mov|wmv)\b"),
    ("term", "os", r"\b(?i:windows|linux|macos|ios|android|ubuntu|debian|redhat|centos|fedora|arch|kali|alpine|unix|solaris|bsd|freebsd)\b"),
    ("term", "web_tech", r"\b(?i:react|angular|vue|svelte|next\.js|nuxt\.js|node\.js|django|flask|express|spring|rails|laravel|webpack|gulp|grunt|babel|eslint|graphql|rest|soap|ajax)\b"),
    ("term", "cloud_devops", r"\b(?i:aws|azure|gcp|digitalocean|heroku|jenkins|travis|circleci|gitlab-ci|github-actions|docker|kubernetes|helm|podman|rancher|prometheus|grafana|nagios|zabbix|ansible|terraform|puppet|chef)\b"),
    ("term", "database", r"\b(?i:mysql|postgresql|sqlite|oracle|mssql|mongodb|cassandra|couchdb|redis|dynamodb|influxdb|timescale|opentsdb|neo4j|janusgraph|dgraph)\b"),
    ("term", "cybersecurity", r"\b(?i:firewall|vpn|antivirus|malware|ransomware|phishing|zero-day|nmap|metasploit|wireshark|kali|burp|nessus|ossec|tls|ssl|ipsec|oauth|saml|fido2|nist|iso27001|cobit)\b"),
    ("term", "hardware", r"\b(?i:cpu|gpu|ram|ssd|hdd|motherboard|psu|intel|amd|nvidia|asus|dell|lenovo|hp|keyboard|mouse|monitor|printer|router)\b"),
    ("term", "networking", r"\b(?i:router|switch|modem|firewall|access point|lan|wan|vpn|dns|dhcp|nat|subnet)\b"),
    ("term", "ml_ai", r"\b(?i:tensorflow|keras|pytorch|sklearn|xgboost|lightgbm|cnn|rnn|gan|transformer|bert|gpt|svm|mlflow|kubeflow|airflow)\b"),
    ("term", "version_control", r"\b(?i:git|svn|mercurial|cvs|bitbucket|github|gitlab)\b"),
    ("term", "mobile_dev", r"\b(?i:swift|kotlin|objective-c|flutter|react-native|xamarin|cordova|ionic)\b"),
    ("term", "blockchain", r"\b(?i:bitcoin|ethereum|dogecoin|litecoin|solana|polkadot|hyperledger|cosmos|nft|smart-contract|dapp|defi)\b"),
    ("term", "game_dev", r"\b(?i:unity|unreal|godot|cryengine|c#|c\+\+|lua|python|panda3d|monogame)\b"),
    ("analyze", "analyze", r"\b[A-Za-z0-9]{20,100}\b"),
    ("analyze", "analyze", r"\b(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]{6,20}\b"),
    ("analyze", "analyze", r"\b\d{8,20}\b"),
    ("analyze", "analyze", r"\b[A-Z]{8,20}\b"),
    ("analyze", "analyze", r"\b(?:[A-Za-z0-9]{2}[,:|.-]([A-Za-z0-9]{2}|)){4,20}\b"),
    ("month", "month", r"\b(?i:January|February|March|April|May|June|July|August|September|October|November|December)\b"),
    ("month", "month", r"\b(?i:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\b"),
    ("time", "time", r"\b\d{2}(:|\.)\d{2}((:|\.)\d{2,4}|)\b"),
    ("time", "time", r"\b(\d{2}(\.|:)|)\d{1,2}(?i:am|pm)\b"),
    ("mac", "mac", r"\b([0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}\b"),
    ("mac", "mac", r"\b[0-9a-fA-F]{12}\b"),
    ("mac", "mac", r"\b([0-9a-fA-F]{4}\.){2}[0-9a-fA-F]{4}"),
    ("date", "date", r"\b\d{4}[-/]\d{1,2}[-/]\d{1,2}\b"),
    ("date", "date", r"\b\d{1,2}[-/]\d{1,2}[-/]\d{4}\b"),
    ("date", "date", r"\b(?i:January|February|March|April|May|June|July|August|September|October|November|December)\s\d{1,2}(st|nd|rd|th)\s\d{4}\b"),
    ("date", "date", r"\b(?i:Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s\d{1,2}(st|nd|rd|th)\s\d{4}\b"),
    ("week", "week", r"(?i:Monday|Tuesday|Wednesday|Thursday|Friday|Saturday|Sunday)"),
    ("week", "week", r"\b(?i:Mon|Tue(s)|Wed|Thu(rs)|Fri|Sat|Sun)\b"),
    ("ipv6", "ipv6", r"\b(?:[0-9a-fA-F]{1,4}|)(:)([0-9a-fA-F]{1,4})\b"),
    ("ipv6", "ipv6", r"\b(?:[0-9a-fA-F]{1,4})?!\.(\d{1,3}\.){3}"),
    ("ipv6", "ipv6", r"\b(?:[0-9a-fA-F]{1,4})?!.*::.*::"),
    ("ipv6", "ipv6", r"[0-9a-fA-F]{4}(:)[0-9a-fA-F]{3}(::)"),
    ("ipv6", "ipv6", r"\b[0-9a-fA-F]{4}(::)"),
    ("ipv6", "ipv6", r"(::|:)(([0-9a-fA-F]{4}+)|\d\b|([0-9a-fA-F]{3})(:)[0-9a-fA-F](::))"),
    ("ipv4", "ipv4", r"\b(\d{1,3}\.){3}\d{1,3}(\/\d{1,2}\b|\/|)"),
    ("phone", "phone_number", r"\b\+?\d{1,3}[-.\s]?\(?\d{1,3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("datetime", "datetime", r"\b\d{4}-\d{2}-\d{2}[T\s]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})?\b"),
    ("datetime", "datetime", r"\d{4}(/|-)(?:0[1-9]|1[0-2])(/|-)(?:0[1-9]|[12][0-9]|3[01])\b"),
    ("datetime", "datetime", r"(?:[01][0-9]|2[0-3])(:)[0-5][0-9](:)(?:[0-5][0-9]|60)\b"),
    ("datetime", "datetime", r"(?:[01][0-9]|2[0-3])(:)[0-5][0-9]\b"),
    ("datetime", "datetime", r"\b(\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}\b)"),
    ("datetime", "datetime", r"\b\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}\b"),
    ("datetime", "datetime", r"(?:[01][0-9]|2[0-3])(:)[0-5][0-9]\b"),
    ("datetime", "datetime", r"(\d{2}){2}\d{4} (\d{2}:){3}"),
    ("misc", "unix_path", r"(?:[ \t\n]|^)/(?:[a-zA-Z0-9_.-]+/)*[a-zA-Z0-9_.-]+"),
    ("misc", "windows_path", r"([a-zA-Z]:\\|\\\\)[\w\\.-]+"),
    ("misc", "email", r"[\w.-]+@([\w-]+\.)+[\w-]+"),
    ("misc", "url", r"([a-zA-Z]+):\/\/[a-zA-Z0-9\-._~:/?#[\]@!$&'()*+,;=%]+"),
    ("misc", "ini", r"\[\w+\]"),
    ("misc", "hex_number", r"\b0x[0-9a-fA-F]+\b"),
    ("misc", "env_var", r"\$[\w]+|%[\w]+%"),
    ("misc", "uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b"),
]

# ---------------------------------------------------------------------------
# Own design: equal rewrites for the JVM.  Java's matcher recurses once per turn
# of an unbounded *group* loop, so a 20,000-word run would overflow the stack of
# an executor thread.  The rewrites match the same text with possessive loops
# (iterative in Java) and a look-ahead that stops each loop where the greedy one
# would have backed off to; \G stands for "where the last match ended".
# ---------------------------------------------------------------------------
_TWO_MORE_WORDS = r"(?=\s+\w+\s+\w)"
_STACK_SAFE = {
    "unix_path": r"(?:[ \t\n]|^)/(?:[a-zA-Z0-9_.-]+/(?=[a-zA-Z0-9_.-]))*+[a-zA-Z0-9_.-]+",
    "email": r"(?:\G|(?<![\w.-]))[\w.-]++@(?:[\w-]+\.(?=[\w-]))++[\w-]+",
    "url": r"(?<![a-zA-Z])[a-zA-Z]++:\/\/[a-zA-Z0-9\-._~:/?#[\]@!$&'()*+,;=%]+",
    "entity_name": r"(?:\b\w+\b\s+){2,5}\b(?:by|from|to|with|about|for)\s+[A-Z][a-z]+(?:\s[A-Z][a-z]+" + _TWO_MORE_WORDS + r")*+(?:\s+\b\w+\b){2,5}",
    "all_caps_phrase": r"(?:\b\w+\b\s+){2,5}\b[A-Z]{2,}(?:\s+[A-Z]{2,}" + _TWO_MORE_WORDS + r")*+\b(?:\s+\b\w+\b){2,5}",
    "proper_noun": r"(?:\b\w+\b\s+){2,5}\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+" + _TWO_MORE_WORDS + r")*+\b(?:\s+\b\w+\b){2,5}",
    "action_context": r"\b(?=\w[\w\s]*\s(?:completed|developed|initiated|threatened|investigated)\s)(?:\b\w+\b\s+){2,5}\b\w[\w\s]*\s(?:completed|developed|initiated|threatened|investigated)\s+\b.*?[.!?](?:\s+\b\w+\b){2,5}",
    "reporting_statement": r"\b(?=\w[\w\s]*\s(?:said|stated|reported|mentioned|claimed|explained|noted|suggested)\b)(?:\b\w+\b\s+){2,5}\b\w(?:(?!\s\s)[\w\s])*\s+(?:said|stated|reported|mentioned|claimed|explained|noted|suggested)\b(?:\s+\".*?\"|\s+\b.*?\b[.!?])",
}

# Own design: the two patterns that look for the last verb of a run of words with an end of a sentence somewhere
# behind it.  Plain matching tries every word as a start, every verb behind it and every end behind that.  In steps, each
# pass is linear: (1) a mark goes before the word that follows a verb, (2) another behind the last end of a sentence of
# each line, (3) marks of verbs behind that are taken out again, so a mark says that an end follows.  A match then begins
# with the first word of a run, where the last match ended, or, as single blanks are asked for behind five words, five words
# before a wider gap.  The last step has the match in its second group.
_SAID = "(?:said|stated|reported|mentioned|claimed|explained|noted|suggested)"
_DONE = "(?:completed|developed|initiated|threatened|investigated)"


def _last_verbs(verbs: str, end: str, start: str, body: str) -> tuple[tuple[str, str], ...]:
    return (
        (rf"(?<=\s){verbs}\s++(?=\w)", "$0\x04"),
        (rf"(?m)^(?:[^\n]*{end}|)", "$0\x05"),
        ("(?:\x05|\\G(?!\\A))([^\n\x04\x05]*+)\x04", "$1"),
        ("\x05", ""),
        (rf"({start})({body})", "$1\x01$2\x02"),
        ("\x04", ""),
    )


_RUN_START = "(?:\\A|(?<=[^\\w\\s\x04]))\\s*+"
_STEPS = {
    "reporting_statement": _last_verbs(
        _SAID,
        r"\w[.!?]",
        f"{_RUN_START}|(?<!\\w)(?=(?:\\w+\\s+\x04?){{4}}\\w+\\s\\s)",
        f"(?:\\w+\\s+\x04?){{2,5}}\\w(?:(?!\\s\\s)[\\w\\s\x04])*\\s+\x04?{_SAID}(?:\\s+\".*?\"|\\s+\x04.*?(?<=\\w)[.!?])",
    ),
    "action_context": _last_verbs(
        _DONE,
        "[.!?](?=\\s++\x04?\\w++\\s++\x04?\\w)",
        f"(?:{_RUN_START}|\\G(?!\\A)\\s*+\x04?)",
        f"(?:\\w+\\s+\x04?){{2}}\\w[\\w\\s\x04]*\\s\x04?{_DONE}\\s+\x04.*?[.!?](?:\\s++\x04?\\w++){{2,5}}",
    ),
}

# A cheap test that every match of the label (or of each of its patterns, in order) must pass; the full pattern only
# runs on rows that pass it.
_GATES = {
    "interrogative_context": r"\s(?:how|why|what|when|where|who)\s",
    "reporting_statement": rf"\s{_SAID}\s",
    "entity_name": r"\s(?:by|from|to|with|about|for)\s+[A-Z][a-z]",
    "all_caps_phrase": r"\s[A-Z]{2}",
    "quoted_text": r"\"",
    "action_context": rf"\s{_DONE}\s",
    "possessive_context": r"['’]s\s|(?:owned|reported|handled) by\s",
    "adjective_context": r"critical|urgent|significant|dangerous|illegal|fraudulent",
    "question_context": r"\?",
    "number_context": r"\d",
    "threat_context": r"threat|risk|danger|exploit",
    "windows_path": r"\\",
    "unix_path": r"/",
    "email": r"@",
    "url": r"://",
    "ini": r"\]",
    "hex_number": r"0x",
    "env_var": r"[$%]",
    "ipv6": (r":[0-9a-fA-F]", r"!\.\d", "::", "::", "::", r":[0-9a-fA-F]"),
    "ipv4": r"\d\.\d",
    "datetime": r"\d[-/:]\d",
    "phone_number": r"\d{4}",
    "uuid": r"[0-9a-fA-F]{8}-",
    "analyze": (r"(?<!\w)[A-Za-z0-9]{20}", r"[A-Za-z]\d|\d[A-Za-z]", r"\d{8}", r"[A-Z]{8}", r"[A-Za-z0-9]{2}[,:|.-][A-Za-z0-9]{2}"),
    "time": (r"\d[:.]\d", r"\d(?i:[ap]m)"),
    "mac": (r"[0-9a-fA-F]{2}[:-][0-9a-fA-F]{2}[:-]", r"(?<!\w)[0-9a-fA-F]{12}", r"[0-9a-fA-F]{4}\.[0-9a-fA-F]{4}\."),
    "date": (r"\d[-/]\d", r"\d[-/]\d", r"\d(?:st|nd|rd|th)\s", r"\d(?:st|nd|rd|th)\s"),
    "week": (r"(?i:day)", None),
}


@dataclass(frozen=True)
class Pattern:
    """One catalog entry.  ``regex`` is in Python syntax, ``jvm`` (if given) is
    an equal rewrite that is safe on the JVM, ``gate`` a necessary condition,
    ``steps`` (if given) replacements that mark the matches in linear time, ``words``
    (if given) the lower-case words of which one must begin a match."""

    ordinal: int
    group: str
    label: str
    regex: str
    jvm: str | None = None
    gate: str | None = None
    steps: tuple[tuple[str, str], ...] = ()
    words: tuple[str, ...] = ()


def first_words(regex: str) -> tuple[str, ...]:
    """The words with which the phrases of a pattern that begins with a case-insensitive word list begin; empty for others."""
    listed = re.match(r"\\b\(\?i:([^()]*(?:\([a-z]+\)[^()]*)*)\)\\[bs]", regex)
    if listed is None:
        return ()
    plain = [re.sub(r"[()]", "", p).lower() for p in listed.group(1).split("|")]
    spelled = [p.replace(r"\s*", gap) for p in plain for gap in ("", " ")]
    return tuple(sorted({re.match(r"\w+", p).group() for p in spelled}))


def _catalog() -> Iterable[Pattern]:
    numbers: dict[str, int] = {}
    for i, (group, label, regex) in enumerate(_FIXED_PATTERNS):
        nth = numbers[label] = numbers.get(label, -1) + 1
        gate = _GATES.get(label)
        if isinstance(gate, tuple):
            gate = gate[nth]
        yield Pattern(i, group, label, regex, _STACK_SAFE.get(label), gate, _STEPS.get(label, ()), first_words(regex))


PATTERNS: tuple[Pattern, ...] = tuple(_catalog())


def from_regexes(regexes: Iterable[str], group: str = "custom") -> tuple[Pattern, ...]:
    """A catalog from plain regular expressions; the first named group is the
    label, and expressions without one are left out."""
    named = [(m.group(1), r) for r in regexes if (m := re.search(r"\(\?P<(\w+)>", r))]
    return tuple(Pattern(i, group, label, regex) for i, (label, regex) in enumerate(named))


def label_names(patterns: Iterable[Pattern] = PATTERNS) -> list[str]:
    """Sorted distinct labels of a catalog."""
    return sorted({p.label for p in patterns})


def select_patterns(
    labels: str | Sequence[str] | None = None,
    patterns: Iterable[Pattern] = PATTERNS,
) -> tuple[Pattern, ...]:
    """Keep the patterns of the given labels (exact names); ``None`` keeps all."""
    if isinstance(labels, str):
        labels = [labels]
    if not labels:
        return tuple(patterns)
    wanted = set(labels)
    return tuple(p for p in patterns if p.label in wanted)


def compile_error(regex: str) -> str | None:
    """Why ``regex`` is not a valid regular expression, or None if it is."""
    try:
        re.compile(regex)
    except re.error as error:
        return str(error)
    return None


def jvm_compile_error(regex: str) -> str | None:
    """Why the JVM refuses the translated ``regex``, or None; also None without a session to ask."""
    from textscan.functions.regexes import to_jvm

    session = SparkSession.getActiveSession()
    if session is None:
        return None
    try:
        session.sparkContext._jvm.java.util.regex.Pattern.compile(to_jvm(regex, known=False))
    except IllegalArgumentException as error:  # the JVM's syntax error, as PySpark gives it
        return str(error)
    return None


def is_regex(pattern: str) -> bool:
    return compile_error(pattern) is None


def checked_regex(pattern: str) -> str:
    """The pattern itself; a ValueError says why it is none."""
    if (reason := compile_error(pattern)) is not None:
        raise ValueError(f"not a regular expression: {pattern!r} ({reason})")
    return pattern


def split_valid(patterns: Iterable[Pattern]) -> tuple[tuple[Pattern, ...], tuple[tuple[Pattern, str], ...]]:
    """Split patterns into those that compile, in Python and on the JVM, and (pattern, reason) for the rest."""
    valid, rejected = [], []
    for p in patterns:
        error = compile_error(p.regex)
        if error is None and p.group == "custom":
            error = jvm_compile_error(p.regex)
        if error is None:
            valid.append(p)
        else:
            rejected.append((p, error))
    return tuple(valid), tuple(rejected)


def pattern_table(spark: SparkSession, patterns: Iterable[Pattern] = PATTERNS) -> DataFrame:
    """The catalog as a DataFrame, with the compile error of each entry."""
    rows = [(p.ordinal, p.group, p.label, p.regex, compile_error(p.regex)) for p in patterns]
    return spark.createDataFrame(rows, "ordinal int, group string, label string, regex string, error string")


def label_table(spark: SparkSession, patterns: Iterable[Pattern] = PATTERNS) -> DataFrame:
    """Sorted distinct labels as a DataFrame."""
    return pattern_table(spark, patterns).select("label").distinct().orderBy(F.col("label"))
