"""Word lists, path patterns and constants that results depend on."""

from __future__ import annotations

# file suffix -> language
LANGUAGES = {
    ".py": "python", ".pyi": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript",
    ".go": "go", ".java": "java", ".rb": "ruby", ".rs": "rust", ".sql": "sql", ".yml": "yaml", ".yaml": "yaml", ".toml": "toml",
    ".json": "json", ".md": "markdown", ".sh": "shell", ".ini": "ini", ".cfg": "ini",
}
LANGUAGE_NAMES = {"Dockerfile": "dockerfile", "Makefile": "make"}

LOCKFILES = ["poetry.lock", "uv.lock", "Pipfile.lock", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Cargo.lock", "go.sum", "Gemfile.lock", "composer.lock"]
BINARY_SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".ico", ".pdf", ".zip", ".gz", ".tar", ".woff", ".woff2", ".ttf", ".eot", ".so", ".dll", ".exe", ".pyc", ".jar", ".whl", ".bin"]

GENERATED_PATH = (r"(^|/)(dist|build|node_modules|vendor|third_party|__pycache__|\.venv|venv|coverage)/"
                  r"|\.min\.(js|css)$|_pb2(_grpc)?\.pyi?$|\.generated\.|(^|/)generated/|\.snap$")
TEST_PATH = r"(^|/)(tests?|__tests__|spec)/|(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]sx?$|(^|/)conftest\.py$"
GENERATED_MARKERS = ["# Code generated", "// Code generated", "DO NOT EDIT", "@generated", "Generated by the protocol buffer compiler"]
SENSITIVE_PATH = r"(?i)auth|login|session|token|password|secret|crypt|permission|acl|payment|migrat|security|sql|db|database"

IGNORE_PATTERNS = [
    ".git/", "node_modules/", "venv/", ".venv/", "env/", "dist/", "build/", "coverage/", "htmlcov/", "__pycache__/", ".tox/", ".mypy_cache/", ".pytest_cache/", ".ruff_cache/",
    "vendor/", "third_party/", "site-packages/", "*.egg-info/", ".idea/", ".vscode/", "*.min.js", "*.min.css", "*.map", "*.lock", "*.snap", "*.pyc", ".env", ".env.*", "!.env.example",
]

STOP_WORDS = [
    "self", "cls", "none", "true", "false", "return", "import", "from", "class", "def", "async", "await", "and", "not", "for", "the", "with", "else", "elif", "pass", "raise", "try",
    "except", "finally", "lambda", "yield", "while", "break", "continue", "global", "str", "int", "dict", "list", "bool", "float", "set", "tuple", "any", "type", "isinstance", "len",
    "range", "print",
]
QUERY_TERMS = 24

INJECTION_PATTERNS = [
    r"ignore\s+(?:all\s+|any\s+|the\s+)*(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|messages?)",
    r"disregard\s+(?:all\s+|any\s+|the\s+)*(?:previous|prior|above|earlier)",
    r"\b(?:note|message|instructions?|attention|hey)\s+(?:to|for)\s+(?:the\s+)?(?:automated|ai|llm|bot|review\w*)",
    r"\b(?:ai|llm|automated|bot)\s+(?:code\s+)?(?:review(?:er)?s?|tools?|assistants?|agents?)\s*[:,\-]",
    r"\b(?:report|return|output|give|find)\s+(?:no|zero|0)\s+(?:issues|findings|problems|bugs)",
    r"""\b(?:reply|respond|answer|say|write)\s+(?:only\s+)?(?:with\s+)?["'`]?(?:lgtm|looks good|approved?)\b""",
    r"\bapprove\s+this\s+(?:pr|pull\s+request|change|commit)\b",
    r"\bpre-?approved\b",
    r"\bnew\s+instructions?\s*:",
    r"\byou\s+are\s+now\s+(?:a|an|in)\b",
    r"\bdo\s+not\s+(?:report|flag|mention|comment)\b.{0,40}\b(?:issues?|bugs?|vulnerabilit\w+|findings?)",
]
PLACEHOLDER = "[removed: instruction-like text addressed to an automated reviewer]"
DELIMITERS = r"(?i)<(/?)(untrusted_[a-z_]*|context_item|task)\b"
HTML_TAGS = (r"(?i)</?(script|img|iframe|a|style|details|summary|svg|object|embed|form|input|link|meta|div|span|table|tr|td|th|br|p|h[1-6]|button|video|audio|source)\b[^>]*>")

# rank fusion and boosts
RRF_K, RRF_SCALE = 60, 60.0
BOOSTS = {"exact_name": 1.00, "import_edge": 0.30, "called_edge": 0.30, "same_dir": 0.15, "test_relation": 0.25, "generic_penalty": -0.20, "module_penalty": -0.15}
GENERIC_SYMBOLS = ["__init__", "__repr__", "__str__", "__eq__", "__hash__", "__enter__", "__exit__"]
GENERIC_TOKENS = 15

# tiers 1 to 6: share of the token budget
TIER_SHARES = {1: 0.25, 2: 0.20, 3: 0.10, 4: 0.15, 5: 0.20, 6: 0.05}

SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
ADJACENT_LINES, SIMILARITY, LINE_TOLERANCE = 3, 0.6, 3
MAX_CHUNK_TOKENS, MODULE_HEADER_LINES, PYTHON_WINDOW, SECTION_WINDOW = 800, 120, 60, 80
GUIDE_PATHS = ["readme%", "contributing%", "docs/%", "%architecture%", "%style%", "%conventions%"]
SOURCE_ROOTS = ["", "src/", "lib/"]
EMBEDDING_DIM = 1024
# signatures: longest of a definition, longest of a class, and how a class lists its methods
SIGNATURE_CHARS, CLASS_SIGNATURE_CHARS, METHOD_INDEX = 400, 1200, "{}  [methods: {}]"
