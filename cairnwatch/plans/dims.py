"""Small dimension tables: the taxonomy, its keywords, vulnerability maps and the knowledge graph's edges.

Each is a fixed list of rows, given to Spark as a local relation and to SQL as VALUES, so
that both sides see the same rows. Real deployments read these from sources (see
cairnwatch.sources) and pass them to the operators instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: technique_id, name, description, platforms
TECHNIQUE = [
    ("T1059", "Command and Scripting Interpreter", "Abuse of command injection and interpreters. Adversaries run commands. A third sentence.", "Windows,Linux"),
    ("T1059.001", "PowerShell", "PowerShell commands and scripts with the token of a user. Used for execution.", "Windows"),
    ("T1059.003", "Windows Command Shell", "The command shell was used for execution. Batch files.", "Windows"),
    ("T1566", "Phishing", "Malicious email sent to victims. The license lure is common.", "Windows,Linux,macOS"),
    ("T1566.001", "Spearphishing Attachment", "An attachment with this email. Opened by the user.", "Windows"),
    ("T1190", "Exploit Public-Facing Application", "Weakness in an internet host such as sql injection or path traversal. Web servers.", "Linux,Network"),
    ("T1133", "External Remote Services", "Remote services that accept a secret from outside. VPN use.", "Windows,Linux"),
    ("T1027", "Obfuscated Files or Information", "Encoded or encrypted payload that hides. Harder to detect.", "Windows"),
    ("T1078", "Valid Accounts", "Credentials of existing accounts with the password and token. Persistence.", "Windows,SaaS"),
    ("T1110", "Brute Force", "Guessing of password hashes. Tried from many hosts.", "Windows,Linux"),
    ("T1003", "OS Credential Dumping", "Dump the secret store. Memory was read.", "Windows,Linux"),
    ("T1021", "Remote Services", "Lateral movement with valid accounts. Sessions.", "Windows,Linux"),
    ("T1053", "Scheduled Task/Job", "Tasks were scheduled from the host. Persistence (cron).", "Windows,Linux"),
    ("T1055", "Process Injection", "Code in the memory of another process through a buffer overflow. Evasion.", "Windows"),
    ("T1068", "Exploitation for Privilege Escalation", "Privilege escalation by an exploit. That kernel.", "Linux"),
    ("T1071", "Application Layer Protocol", "Command and control traffic with web protocols. Beacon.", "Windows,Network"),
    ("T1082", "System Information Discovery", "Query of the system. List of hosts.", "Windows,Linux"),
    ("T1083", "File and Directory Discovery", "Files were listed from shares. Search.", "Windows,Linux"),
    ("T1203", "Exploitation for Client Execution", "Cross-site scripting or deserialization in clients. Office.", "Windows"),
    ("T1486", "Data Encrypted for Impact", "Ransom notes with encrypted data. That was costly.", "Windows,Linux"),
    ("T1548.002", "Bypass User Account Control", "Elevation without consent. Privilege elevation.", "Windows"),
    ("T1562", "Impair Defenses", "Disable or bypass defences. Logs.", "Windows,Linux"),
    ("T1552", "Unsecured Credentials", "Secrets in files. Token and secret search.", "Windows,Cloud"),
    ("T1005", "Data from Local System", "Data collected from this host. Files.", "Windows,Linux"),
]
#: technique_id, keyword
KEYWORD = [
    ("T1059", "script"), ("T1059", "command"), ("T1059", "was"), ("T1059", "with"), ("T1059.001", "powershell"), ("T1059.001", "token"), ("T1059.001", "with that"),
    ("T1059.003", "cmd"), ("T1059.003", "was the"), ("T1566", "phishing"), ("T1566", "email"), ("T1566", "license"), ("T1566.001", "attachment"), ("T1566.001", "this"),
    ("T1190", "exploit"), ("T1190", "than"), ("T1190", "to the"), ("T1133", "vpn"), ("T1133", "secret"), ("T1027", "encoded"), ("T1027", "from the"),
    ("T1078", "password"), ("T1078", "token"), ("T1078", "was"), ("T1110", "hash"), ("T1110", "from"), ("T1003", "secret"), ("T1003", "dump"), ("T1021", "with"), ("T1021", "remote"),
    ("T1053", "cron"), ("T1053", "from"), ("T1055", "inject"), ("T1055", "that the"), ("T1068", "kernel"), ("T1068", "than"), ("T1071", "beacon"), ("T1071", "http"),
    ("T1082", "query"), ("T1082", "this"), ("T1083", "from"), ("T1083", "list"), ("T1203", "client"), ("T1203", "with the"), ("T1486", "ransom"), ("T1486", "was"),
    ("T1548.002", "uac"), ("T1562", "bypass"), ("T1562", "than"), ("T1552", "token"), ("T1552", "secret"), ("T1005", "from this"), ("T1005", "data"),
]
#: technique_id, tactic, shortname
TACTIC = [
    ("T1059", "Execution", "execution"), ("T1059.001", "Execution", "execution"), ("T1059.003", "Execution", "execution"), ("T1566", "Initial Access", "initial-access"),
    ("T1566.001", "Initial Access", "initial-access"), ("T1190", "Initial Access", "initial-access"), ("T1133", "Initial Access", "initial-access"), ("T1133", "Persistence", "persistence"),
    ("T1027", "Defense Evasion", "defense-evasion"), ("T1078", "Initial Access", "initial-access"), ("T1078", "Persistence", "persistence"), ("T1078", "Privilege Escalation", "privilege-escalation"),
    ("T1110", "Credential Access", "credential-access"), ("T1003", "Credential Access", "credential-access"), ("T1021", "Lateral Movement", "lateral-movement"), ("T1053", "Execution", "execution"),
    ("T1053", "Persistence", "persistence"), ("T1055", "Defense Evasion", "defense-evasion"), ("T1055", "Privilege Escalation", "privilege-escalation"), ("T1068", "Privilege Escalation", "privilege-escalation"),
    ("T1071", "Command and Control", "command-and-control"), ("T1082", "Discovery", "discovery"), ("T1083", "Discovery", "discovery"), ("T1203", "Execution", "execution"),
    ("T1486", "Impact", "impact"), ("T1548.002", "Privilege Escalation", "privilege-escalation"), ("T1562", "Defense Evasion", "defense-evasion"), ("T1552", "Credential Access", "credential-access"), ("T1005", "Collection", "collection"),
]
#: Mentions in the test documents are CVE-202y-nnnn with y of 0..4 and nnnn of 1000..1039 (see queries).
CVE_TECHNIQUE = [(f"CVE-202{i % 5}-{1000 + i}", TECHNIQUE[(i * 7) % 24][0], 0.9) for i in range(0, 40, 2)] + [(f"CVE-202{i % 5}-{1000 + i}", TECHNIQUE[(i * 5 + 3) % 24][0], 0.9) for i in range(0, 40, 5)]
CVE_CWE = [(f"CVE-202{i % 5}-{1000 + i}", cwe) for i in range(40) for cwe in {("CWE-119", "CWE-78", "CWE-22", "CWE-89", "CWE-79", "CWE-200", "CWE-269", "CWE-502")[i % 8], ("CWE-78", "CWE-22", "CWE-798")[i % 3]}]
#: Which techniques a weakness suggests.
CWE_TECHNIQUE = [
    ("CWE-119", "T1055"), ("CWE-119", "T1185"), ("CWE-120", "T1055"), ("CWE-120", "T1185"), ("CWE-122", "T1055"), ("CWE-122", "T1185"), ("CWE-125", "T1055"), ("CWE-125", "T1186"), ("CWE-787", "T1055"), ("CWE-787", "T1565"),
    ("CWE-78", "T1059"), ("CWE-94", "T1059"), ("CWE-22", "T1083"), ("CWE-22", "T1082"), ("CWE-23", "T1083"), ("CWE-23", "T1082"), ("CWE-36", "T1083"), ("CWE-36", "T1082"), ("CWE-73", "T1083"), ("CWE-73", "T1082"),
    ("CWE-287", "T1110"), ("CWE-287", "T1212"), ("CWE-294", "T1110"), ("CWE-294", "T1212"), ("CWE-295", "T1553"), ("CWE-295", "T1555"), ("CWE-306", "T1212"), ("CWE-306", "T1550"),
    ("CWE-269", "T1068"), ("CWE-269", "T1548"), ("CWE-274", "T1068"), ("CWE-274", "T1548"), ("CWE-264", "T1068"), ("CWE-264", "T1548"), ("CWE-79", "T1189"), ("CWE-79", "T1203"), ("CWE-89", "T1190"), ("CWE-89", "T1203"),
    ("CWE-200", "T1552"), ("CWE-200", "T1005"), ("CWE-203", "T1552"), ("CWE-203", "T1005"), ("CWE-209", "T1552"), ("CWE-209", "T1005"), ("CWE-502", "T1059"), ("CWE-502", "T1203"), ("CWE-16", "T1552"), ("CWE-16", "T1555"),
    ("CWE-276", "T1222"), ("CWE-284", "T1222"), ("CWE-798", "T1552"), ("CWE-798", "T1555"), ("CWE-259", "T1552"), ("CWE-259", "T1555"), ("CWE-918", "T1190"),
]
#: Words of a technique's description (all of them) that suggest weaknesses.
CWE_RULE = [
    ("buffer", "overflow", "CWE-119"), ("buffer", "overflow", "CWE-120"), ("buffer", "overflow", "CWE-122"), ("command injection", "", "CWE-78"), ("command injection", "", "CWE-77"), ("command execution", "", "CWE-78"), ("command execution", "", "CWE-77"),
    ("sql injection", "", "CWE-89"), ("cross-site", "", "CWE-79"), ("xss", "", "CWE-79"), ("path traversal", "", "CWE-22"), ("path traversal", "", "CWE-23"), ("path traversal", "", "CWE-36"), ("path traversal", "", "CWE-73"),
    ("privilege escalation", "", "CWE-269"), ("privilege escalation", "", "CWE-274"), ("privilege escalation", "", "CWE-264"), ("privilege elevation", "", "CWE-269"), ("privilege elevation", "", "CWE-274"), ("privilege elevation", "", "CWE-264"), ("deserialization", "", "CWE-502"),
]
#: Phrases that count for a technique besides its keywords.
SIGNAL = [
    ("T1190", "web exploit"), ("T1190", "web application vulnerability"), ("T1190", "public-facing"), ("T1133", "vpn"), ("T1133", "rdp exploit"), ("T1133", "external service"),
    ("T1566", "phishing"), ("T1566", "spear phishing"), ("T1566", "malicious email"), ("T1059", "powershell"), ("T1059", "cmd.exe"), ("T1059", "bash"), ("T1059", "python script"),
    ("T1027", "obfuscated"), ("T1027", "encoded"), ("T1027", "encrypted payload"),
]
#: Tactic, pattern (case ignored, from a word's start), its techniques.
CONTEXT = [
    ("initial_access", r"phish|spearphish|malicious\s+(?:email|attachment)|exploit\s+(?:web|application|public)", ["T1566", "T1566.001", "T1566.002", "T1190"]),
    ("execution", r"execut(?:e|ion|ed)|script|command|run\s+(?:code|process)", ["T1059", "T1059.001", "T1059.003", "T1106"]),
    ("persistence", r"persist(?:ence|ent)|startup|boot|registry|schedule|cron|autorun", ["T1053", "T1053.005", "T1547", "T1547.001"]),
    ("privilege_escalation", r"privile(?:ge|ged)|escalat(?:e|ion)|admin|root|sudo|uac", ["T1068", "T1548", "T1548.002"]),
    ("defense_evasion", r"evade|evasion|bypass|disable|tamper|anti[\s-]?virus|detection", ["T1562", "T1562.001", "T1070"]),
    ("credential_access", r"credential|password|hash|kerberos|ticket|token|dump", ["T1003", "T1003.001", "T1110", "T1110.002"]),
    ("discovery", r"discover|enumerat(?:e|ion)|scan|query|list|network", ["T1046", "T1082", "T1018"]),
    ("lateral_movement", r"lateral|move(?:ment)?|pivot|remote|psexec|wmi|smb", ["T1021", "T1021.002", "T1021.006", "T1091"]),
    ("collection", r"collect|gather|harvest|screenshot|keylog|clipboard", ["T1056", "T1056.001", "T1113", "T1115"]),
    ("exfiltration", r"exfiltrat(?:e|ion)|transfer|upload|steal|extract", ["T1048", "T1048.003", "T1041"]),
    ("command_and_control", r"command\s*(?:and|&)\s*control|c2|c&c|beacon|callback", ["T1071", "T1071.001", "T1071.004", "T1095"]),
    ("impact", r"ransom|encrypt|wipe|corrupt|deny|dos|ddos|destruct", ["T1486", "T1489", "T1490"]),
]
#: Entity types and the techniques they favour.
FAVOURED = {
    "ATTACK-PATTERN": ["T1190", "T1133", "T1566", "T1566.001", "T1078"],
    "MALWARE": ["T1059", "T1204", "T1027", "T1027.002", "T1055"],
    "TOOL": ["T1059.001", "T1059.003", "T1059.005", "T1059.006", "T1021.006"],
    "VULNERABILITY": ["T1190", "T1068", "T1211", "T1212", "T1203"],
    "FILE": ["T1005", "T1074", "T1083", "T1564", "T1560"],
    "SYSTEM": ["T1082", "T1018", "T1016", "T1049", "T1033"],
    "NETWORK": ["T1046", "T1049", "T1071", "T1095", "T1571"],
    "USER-ACCOUNT": ["T1078", "T1136", "T1087", "T1098", "T1003.001"],
    "PROTOCOL": ["T1071.001", "T1071.002", "T1071.003", "T1071.004", "T1095"],
    "CREDENTIAL": ["T1003", "T1110", "T1555", "T1552", "T1556"],
}
AFFINITY = [(kind, technique) for kind, techniques in FAVOURED.items() for technique in techniques]
#: Weight of each extractor in the weighted combination; any other weighs 0.6.
COMBINE_WEIGHT = [("rule_based", 0.7), ("bm25", 0.8), ("ner", 0.9), ("semantic", 0.85), ("classifier", 0.8), ("kev", 0.95)]
#: Extractor, weight, scale, shift of the advanced ensemble.
ENSEMBLE = [
    ("enhanced_rule_based", 0.25, 0.9, 0.0), ("enhanced_bm25", 0.20, 0.8, 0.05), ("optimized_ner", 0.20, 0.7, 0.1), ("optimized_semantic", 0.15, 0.8, 0.05), ("kev", 0.30, 1.0, 0.0),
    ("rule_based", 0.20, 0.8, 0.0), ("bm25", 0.15, 0.7, 0.05), ("ner", 0.15, 0.6, 0.1), ("semantic", 0.10, 0.7, 0.05), ("classifier", 0.10, 0.8, 0.0),
]
#: src, type, dst of the graph between techniques, attack patterns and others.
EDGE = [(TECHNIQUE[i][0], ("RELATED_TO", "SIMILAR_TO", "MAPPED_TO", "USES")[i % 4], TECHNIQUE[(i * 5 + 2) % 24][0]) for i in range(24) if i != (i * 5 + 2) % 24] + [
    (f"CAPEC-{100 + i}", ("MAPPED_TO", "SIMILAR_TO", "CHILD_OF")[i % 3], TECHNIQUE[(i * 3) % 24][0]) for i in range(15)
] + [(f"S{1000 + i}", "USES", TECHNIQUE[i][0]) for i in range(6)] + [(TECHNIQUE[i][0], "MITIGATED_BY", f"M{1030 + i % 5}") for i in range(12)]
#: capec_id, name
CAPEC = [(f"CAPEC-{100 + i}", n) for i, n in enumerate(("Command Injection through Script", "Phishing Email Attachment", "Brute Force of Valid Accounts", "Process Injection Code", "Remote Services Abuse", "File and Directory Probing", "Data Encrypted by Ransom", "System Information Query", "Scheduled Task Abuse", "Application Layer Protocol Abuse", "Public-Facing Application Flaw", "Credential Dumping", "Token Theft", "User Account Control Bypass", "Client Execution Flaw"))]
#: Entities a tagger would report, by type (text, entity_type).
ENTITY_TERM = [("token", "CREDENTIAL"), ("secret", "CREDENTIAL"), ("license", "FILE"), ("email", "USER-ACCOUNT"), ("with that", "TOOL"), ("from this", "SYSTEM"), ("version", "FILE"), ("apache", "NETWORK"), ("password", "CREDENTIAL")]
#: abbreviation, expansion in the order of application; deployments pass their own longer list.
ABBREVIATION = [
    ("cve", "common vulnerabilities and exposures"), ("dos", "denial of service"), ("ddos", "distributed denial of service"), ("malware", "malicious software"), ("rce", "remote code execution"), ("xss", "cross site scripting"),
    ("of", "out of"), ("the", "this"), ("this", "that one"), ("av", "anti-virus"), ("des", "data encryption standard"), ("set", "social engineering toolkit"),
]

TABLES = {
    "technique": ("technique_id, name, description, platforms", TECHNIQUE, "technique_id string, name string, description string, platforms string"),
    "technique_keyword": ("technique_id, keyword", KEYWORD, "technique_id string, keyword string"),
    "technique_tactic": ("technique_id, tactic, shortname", TACTIC, "technique_id string, tactic string, shortname string"),
    "cve_technique": ("cve_id, technique_id, confidence", CVE_TECHNIQUE, "cve_id string, technique_id string, confidence double"),
    "cve_cwe": ("cve_id, cwe_id", sorted(CVE_CWE), "cve_id string, cwe_id string"),
    "cwe_technique": ("cwe_id, technique_id", CWE_TECHNIQUE, "cwe_id string, technique_id string"),
    "cwe_rule": ("word_a, word_b, cwe_id", CWE_RULE, "word_a string, word_b string, cwe_id string"),
    "signal": ("technique_id, phrase", SIGNAL, "technique_id string, phrase string"),
    "context": ("tactic, pattern, techniques", CONTEXT, "tactic string, pattern string, techniques array<string>"),
    "affinity": ("entity_type, technique_id", AFFINITY, "entity_type string, technique_id string"),
    "combine_weight": ("extractor, weight", COMBINE_WEIGHT, "extractor string, weight double"),
    "ensemble": ("extractor, weight, scale, shift", ENSEMBLE, "extractor string, weight double, scale double, shift double"),
    "edge": ("src, type, dst", EDGE, "src string, type string, dst string"),
    "capec": ("capec_id, name", CAPEC, "capec_id string, name string"),
    "entity_term": ("entity, entity_type", ENTITY_TERM, "entity string, entity_type string"),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    _, rows, schema = TABLES[name]
    return spark.createDataFrame(rows, schema)


def _literal(v: object) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(_literal, v)) + "]"
    return "CAST(" + repr(v) + " AS DOUBLE)" if isinstance(v, float) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"


def values(*names: str) -> str:
    """Common table expressions of dimension tables, for SQL."""
    return ",\n".join(f"{n}({TABLES[n][0]}) AS (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in TABLES[n][1]) + ")" for n in names)
