"""Fixed lookup values: languages, severities, categories, dictionaries."""

# fixed values: extension -> language
LANGUAGES = {
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".c": "c",
}

# fixed values: folders a corpus scan never enters (besides dot-folders)
SKIPPED_FOLDERS = (
    "node_modules", "__pycache__", ".git", ".vite", "dist", "build", ".cache", ".next",
    "venv", ".venv", "env", ".tox", "target", "out", ".idea", ".vscode",
)

# fixed values: severity as written by rules -> severity as displayed
SEVERITY_DISPLAY = {
    "ERROR": "HIGH",
    "WARNING": "MEDIUM",
    "INFO": "LOW",
    "HIGH": "HIGH",
    "MEDIUM": "MEDIUM",
    "LOW": "LOW",
}

# fixed values: weakness id -> category
WEAKNESS_CATEGORY = {
    "CWE-89": "SQL Injection",
    "CWE-78": "Command Injection",
    "CWE-94": "Code Injection",
    "CWE-502": "Deserialization",
    "CWE-79": "XSS",
    "CWE-327": "Weak Cryptography",
    "CWE-338": "Weak PRNG",
    "CWE-336": "Predictable Seed",
    "CWE-337": "Predictable Seed",
    "CWE-798": "Hardcoded Secrets",
    "CWE-259": "Hardcoded Secrets",
    "CWE-321": "Hardcoded Secrets",
    "CWE-22": "Path Traversal",
    "CWE-918": "SSRF",
    "CWE-611": "XXE",
    "CWE-120": "Buffer Overflow",
    "CWE-134": "Format String",
    "CWE-190": "Integer Overflow",
    "CWE-770": "Resource Exhaustion",
    "CWE-295": "TLS/SSL Bypass",
    "CWE-347": "JWT Weakness",
    "CWE-352": "CSRF",
    "CWE-601": "Open Redirect",
    "CWE-377": "Race Condition",
    "CWE-330": "Thread Safety",
    "CWE-532": "Info Exposure (Logs)",
    "CWE-209": "Info Exposure (Logs)",
    "CWE-90": "LDAP Injection",
    "CWE-643": "XPath Injection",
    "CWE-943": "NoSQL Injection",
    "CWE-942": "CORS Misconfiguration",
    "CWE-1321": "Prototype Pollution",
    "CWE-1333": "ReDoS",
}

# fixed values: keyword -> category, the first one contained in a message wins
KEYWORD_CATEGORY = [
    ("sql", "SQL Injection"),
    ("command", "Command Injection"),
    ("exec", "Command Injection"),
    ("os.system", "Command Injection"),
    ("popen", "Command Injection"),
    ("eval", "Code Injection"),
    ("pickle", "Deserialization"),
    ("yaml.load", "Deserialization"),
    ("deserializ", "Deserialization"),
    ("xss", "XSS"),
    ("innerhtml", "XSS"),
    ("document.write", "XSS"),
    ("md5", "Weak Cryptography"),
    ("sha-1", "Weak Cryptography"),
    ("sha1", "Weak Cryptography"),
    ("des ", "Weak Cryptography"),
    ("password", "Hardcoded Secrets"),
    ("secret", "Hardcoded Secrets"),
    ("api_key", "Hardcoded Secrets"),
    ("hardcoded", "Hardcoded Secrets"),
    ("path traversal", "Path Traversal"),
    ("ssrf", "SSRF"),
    ("xxe", "XXE"),
    ("buffer", "Buffer Overflow"),
    ("strcpy", "Buffer Overflow"),
    ("strcat", "Buffer Overflow"),
    ("sprintf", "Buffer Overflow"),
    ("gets(", "Buffer Overflow"),
    ("format string", "Format String"),
    ("csrf", "CSRF"),
    ("cors", "CORS Misconfiguration"),
    ("prototype", "Prototype Pollution"),
    ("jwt", "JWT Weakness"),
    ("tls", "TLS/SSL Bypass"),
    ("ssl", "TLS/SSL Bypass"),
    ("redirect", "Open Redirect"),
    ("random", "Weak PRNG"),
    ("prng", "Weak PRNG"),
    ("log4shell", "Known CVE"),
]

# fixed values: call names that bring data in, by language
SOURCES = {
    "python": ["input", "sys.argv", "request.args", "request.form", "open"],
    "javascript": ["prompt", "process.argv", "req.body", "req.query"],
    "java": ["Scanner", "System.in", "getParameter"],
    "c": ["scanf", "gets", "read"],
}

# fixed values: call names that use data dangerously, by language
SINKS = {
    "python": ["eval", "exec", "os.system", "subprocess.call", "pickle.loads", "subprocess.Popen",
               "cursor.execute", "execute", "subprocess.run", "os.popen", "yaml.load", "tarfile.open"],
    "javascript": ["eval", "setTimeout", "child_process.exec", "document.write", "child_process.spawn",
                   "element.innerHTML"],
    "java": ["Runtime.exec", "ProcessBuilder", "Statement.execute", "Runtime.loadLibrary"],
    "c": ["system", "execl", "popen", "strcpy", "strcat", "sprintf", "memcpy", "gets"],
}

# fixed values: thresholds and limits
BIG_FILE_LINES = 200
CHUNK_LINES = 60
SCAN_SNIPPET_CHARS = 120
LOOKUP_SNIPPET_CHARS = 100
PROMPT_CODE_CHARS = 450
UNREADABLE_LINE_COUNT = 100
RISKY_CHUNK_SCORE = 4.0
TDP_WATTS = 28.0
GRAMS_CO2_PER_KWH = 475.0
JOULES_PER_KWH = 3_600_000.0

# fixed values: texts
NO_SUMMARY = "Summary unavailable."
NO_FINDINGS = "No vulnerabilities detected."
