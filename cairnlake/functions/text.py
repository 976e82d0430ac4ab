"""Text functions as column expressions; all run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cairnlake.functions import fixed_values as V

INJECTION = "(?i)" + "|".join(f"(?:{p})" for p in V.INJECTION_PATTERNS)
#: kind -> pattern of the credentials that redact() names
SECRETS = {
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:[^-]|-[^-])*-----END [A-Z ]*PRIVATE KEY-----",
    "aws_access_key": r"\b(?:AKIA|ASIA)[A-Z0-9]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{20,}\b",
}
#: name, quote and value of a secret-looking assignment; values under 16 characters are placeholders
NAMED_SECRET = r"""(?i)\b([A-Za-z0-9_]*(?:passw(?:or)?d|secret|token|api_?key)[A-Za-z0-9_]*["']?\s*[:=]\s*)(["'])([^"'\s\[]{16,})(["'])"""


def estimate_tokens(s: Column) -> Column:
    """0 for a null or empty text, else a quarter of its characters, at least 1."""
    n = F.length(s)
    return F.when(s.isNull() | (n == 0), 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def git_blob_sha(s: Column) -> Column:
    raw = F.encode(s, "UTF-8")
    return F.sha1(F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(s).cast("string")), "UTF-8"), F.unhex(F.lit("00")), raw))


def split_lines(s: Column) -> Column:
    """Lines at every line boundary of Unicode; a final boundary opens no line."""
    parts = F.split(s, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def collapse(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "[ \t\n\r\f\u000b]+", " "))


def words(s: Column, pattern: str = "[a-z0-9_]{3,}") -> Column:
    """Distinct lower-case words in order of occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit(f"({pattern})"), 1))


def jaccard(a: Column, b: Column) -> Column:
    """0 if either set is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def fingerprint(path: Column, category: Column, line: Column, title: Column) -> Column:
    """First 16 hex digits of the hash of path, category, line in steps of four and the first six sorted title words."""
    toks = F.slice(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(title), F.lit("([a-z0-9]+)"), 1))), 1, 6)
    return F.substring(F.sha2(F.concat_ws("|", path, category, F.floor(line / 4).cast("string"), F.array_join(toks, " ")), 256), 1, 16)


def query_terms(s: Column, most: int = V.QUERY_TERMS) -> Column:
    """Distinct identifier pieces of a text: split at underscores, lower case, over two characters, no stop words."""
    pieces = F.flatten(F.transform(F.regexp_extract_all(s, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), lambda x: F.split(F.lower(x), "_")))
    stop = F.array(*[F.lit(w) for w in V.STOP_WORDS])
    return F.slice(F.array_distinct(F.filter(pieces, lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))), 1, most)


def identifier_tokens(s: Column) -> Column:
    """Lower-case identifiers, each followed by its camel-case and underscore parts if there are several."""
    def parts(ident: Column) -> Column:
        low = F.lower(ident)
        sub = F.transform(F.regexp_extract_all(F.replace(ident, F.lit("_"), F.lit(" ")), F.lit("([A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+)"), 1), F.lower)
        return F.when(F.size(sub) > 1, F.concat(F.array(low), sub)).otherwise(F.array(low))
    return F.flatten(F.transform(F.regexp_extract_all(s, F.lit("([A-Za-z_][A-Za-z0-9_]*)"), 1), parts))


def index_terms(*parts: Column) -> Column:
    """All terms of a full-text document, with repetition: lower case, split at everything but letters and digits."""
    return F.filter(F.split(F.lower(F.concat_ws(" ", *parts)), "[^a-z0-9]+"), lambda x: x != "")


def trigrams(s: Column) -> Column:
    """Distinct 3-grams of the lower-case words, each with two blanks before and one after."""
    def grams(w: Column) -> Column:
        padded = F.concat(F.lit("  "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return F.array_distinct(F.flatten(F.transform(F.filter(F.split(F.lower(s), "[^a-z0-9]+"), lambda x: x != ""), grams)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is all zero."""
    n = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(n > 0, dot(a, b) / n)


def injection_lines(s: Column) -> Column:
    return F.size(F.filter(F.split(s, "\n"), lambda x: x.rlike(INJECTION)))


def strip_injections(s: Column) -> Column:
    """Lines that speak to an automated reviewer replaced by a placeholder."""
    return F.array_join(F.transform(F.split(s, "\n"), lambda x: F.when(x.rlike(INJECTION), V.PLACEHOLDER).otherwise(x)), "\n")


def redact(s: Column) -> Column:
    for kind, p in SECRETS.items():
        s = F.regexp_replace(s, p, f"[REDACTED:{kind}]")
    return F.regexp_replace(s, NAMED_SECRET, "$1$2[REDACTED:named_secret]$4")


def neutralize(s: Column) -> Column:
    """Redacted, without lines to the reviewer, prompt delimiters defanged."""
    return F.regexp_replace(strip_injections(redact(s)), V.DELIMITERS, "‹$1$2")


def sanitize_markdown(s: Column) -> Column:
    """Without images, HTML tags and foreign links; mentions and issue numbers broken by a zero-width space."""
    s = F.regexp_replace(s, r"!\[[^\]]*\]\([^)]*\)", "")
    s = F.regexp_replace(s, V.HTML_TAGS, "")
    s = _links(s)
    s = F.regexp_replace(s, r"(^|[^\w`])@([A-Za-z0-9_-])", "$1@​$2")
    return F.trim(F.regexp_replace(s, r"(^|[^\w&])#(\d+)", "$1#​$2"))


def _links(s: Column) -> Column:
    # the wanted host is marked first, so that one pattern without lookaround can drop the rest
    kept = F.regexp_replace(s, r"(?i)http(s?)://((?:[^\s/)>\]]*)github\.com(?:/[^\s)>\]]*)?(?:[\s)>\]]|$))", "\u0001$1\u0002$2")
    gone = F.regexp_replace(kept, r"(?i)https?://[^\s)>\]]+", "[link removed]")
    return F.regexp_replace(gone, "\u0001(s?)\u0002", "http$1://")


def parent_dir(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(".")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Lower-case suffix with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]+)$", 1))


def module_name(path: Column) -> Column:
    """Dotted module of a Python path."""
    return F.replace(F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "(^|/)__init__$", ""), F.lit("/"), F.lit("."))
