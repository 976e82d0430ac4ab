"""Credentials written out as literals in source code, configuration and patches, and their redaction.

Literals and bare tokens are proposed broadly: whatever is given to a name that speaks of a secret, stands in a
login, a header or a query string, or has the form of a known issuer. What is a credential is decided by how
unnatural the value is: characters per subword under the vocabulary of a public tokenizer. Words and
identifiers take three or more characters per subword, random strings under two, passwords that people
make up of words, digits and signs are between. Context only moves the limit that a value has to stay under:
up for names that say password and for logins, down to zero for references, placeholders, checksums and ids.
Private-key blocks, whose body is not one literal, are found by their frame.

Redaction overwrites each value with asterisks of the same length, line breaks kept, so every offset, line
number, quote and delimiter around it stays as it was.

Defined results
- null or empty text: no finding; the redacted text is the text.
- a value over several lines is one finding, on the line on which it begins; two values on a line are one row.
- repeated rows of an id give their findings once. Extra columns are ignored.
- texts are read whole, whatever their length, in time linear in it.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Characters per subword below which a literal of letters alone, of letters and digits, and a password that people made up is unnatural.
UNNATURAL, MIXED, MADE_UP = 2.3, 2.75, 4.0

_encoders: dict[str, object] = {}


def share(spark: SparkSession, vocabulary: str) -> str:
    """Send a vocabulary file to the executors, where encoder() looks for it by its name."""
    if "://" in vocabulary or os.path.exists(vocabulary):
        spark.sparkContext.addFile(vocabulary)
    return vocabulary


def _local(vocabulary: str) -> str:
    from pyspark import SparkFiles

    if SparkFiles._is_running_on_worker:
        sent = SparkFiles.get(os.path.basename(vocabulary))
        if os.path.exists(sent):
            return sent
    return vocabulary


def encoder(vocabulary: str):
    """The tokenizer of a rank file, built once per worker."""
    if vocabulary not in _encoders:
        import tiktoken

        with open(_local(vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
        _encoders[vocabulary] = tiktoken.Encoding("credentials", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[vocabulary]


def _ratio(value: str, vocabulary: str) -> float:
    return len(value) / max(1, len(encoder(vocabulary).encode_ordinary(value)))


_known_ratio = lru_cache(maxsize=100_000)(_ratio)


def chars_per_subword(value: str, vocabulary: str) -> float:
    """Repeated short values are looked up."""
    return _known_ratio(value, vocabulary) if len(value) <= 300 else _ratio(value, vocabulary)


#: Formats of known issuers. Group 1 is the value.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_])((?:AKIA|ASIA|AROA)[A-Z0-9]{16}(?![A-Za-z0-9])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|glpat-[\w-]{16,}"
    r"|xox[abeoprs]-[A-Za-z0-9-]{16,}|xapp-[A-Za-z0-9-]{20,}|[srp]k_(?:live|test|prod)_[A-Za-z0-9]{12,}|whsec_[A-Za-z0-9+/=]{16,}|AIza[A-Za-z0-9_-]{20,}"
    r"|ya29\.[\w-]{20,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|npm_[A-Za-z0-9]{30,}|pypi-[\w-]{40,}|SG\.[\w-]{16,}\.[\w-]{16,}"
    r"|dop_v1_[0-9a-f]{40,}|hf_[A-Za-z0-9]{30,}|sk-(?:proj-|ant-)?[A-Za-z0-9_-]{24,}|AGE-SECRET-KEY-1[A-Z0-9]{50,}|shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}"
    r"|key-[0-9a-f]{32}|SK[0-9a-f]{32}(?![0-9a-f])|EAA[A-Za-z0-9]{40,}|dckr_pat_[\w-]{20,})")
PEM = re.compile(r"-----BEGIN (?!ENCRYPTED |PUBLIC |CERTIFICATE)((?:[A-Z0-9]+ )*)PRIVATE KEY(?: BLOCK)?-----")
PEM_END = re.compile(r"-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----")
PEM_TAIL = re.compile(r"(?:\r?\n[ +-]?[ \t]*+[A-Za-z0-9+/=]{8,}+[ \t]*+(?=\r?\n|$)|(?:\\r)?\\n[A-Za-z0-9+/=]{8,}+)++")
URL_LOGIN = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@\"'`<>]*):([^\s/@\"'`<>]+)@([^\s/:\"'`<>]+)")
URL_QUERY = re.compile(r"[?&;](?:sig|signature|token|auth_?token|access_?token|refresh_?token|id_?token|key|api_?key|apikey|auth|secret|client_secret|passwd|password|pwd|"
                       r"x-amz-signature|x-goog-signature|code|sv_sig)=([^\s&\"'`#<>\\)]{8,})", re.I)
HEADER = re.compile(r"\b(Basic|Bearer|Token|ApiKey|Digest)[ \t]+([A-Za-z0-9+/=._~-]{8,})")

#: What stands between a name and its literal, and the literal's quote.
BETWEEN = re.compile(r"(?:[\"'`]?\]?[ \t]*+(?::[ \t]*+[A-Za-z_][\w\[\], \t|]*+)?(?::=|=>|(?<![=!<>])=(?!=)|:)|(?<=[\w$.-])[\"'`][ \t]*+,)\s*+"
                     r"(?:(?:\[\]byte|str|bytes|bytearray|String|Secret\w*+|[\w.]*b64decode|Buffer\.from|Some)?\(\s*+)?[rbufRBUF]{0,2}(\"\"\"|\'\'\'|[\"'`])")
#: Part of a name that may speak of a secret; the whole name is judged by SECRET_NAME.
HINT = re.compile(r"kennwort|passwort|losung|contrase|clave|senha|mot_?de_?passe|wachtwoord|haslo|geheim|pass|pw|secret|token|key|cred|bearer|auth|jwt|session|cookie", re.I)
NAME_END = re.compile(r"[\w$.-]*+")
#: Any name, used only on lines whose literal goes on over the next line.
NAMED = re.compile(r"(?<![\w$.-])([A-Za-z_$][\w$.-]*+)")
GOES_ON = re.compile(r"[\"'`][ \t]*+(?:(?:\\|\+|\.\.)[ \t]*+)?\r?\n[ +-]?[ \t]*+(?:(?:\+|\.\.)[ \t]*+)?[rbufRBUF]{0,2}[\"'`]")
#: The same without quotes, as in YAML, shell, ini and prose.
BARE = re.compile(r"(?<![\w$.-])[.-]*+([A-Za-z_][\w.-]*+)(?:=|:[ \t]++)([^\s\"'`,;(){}\[\]<>$]{6,})(?=[\s,;\"'`]|$)", re.M)
BLOCK = re.compile(r"^([ +-]?[ \t]*)[\"']?([A-Za-z_][\w.-]*)[\"']?:[ \t]*[>|][+-]?\d?[ \t]*\r?$", re.M)
#: Words for a password in other languages are names too. Prose and comments: "`name` to `value`", "| name | `value` |", "name value", "log in as `user` with `value`".
PROSE = re.compile(r"[`|][ \t]*([A-Za-z_][\w.-]*)[ \t]*(?:`[^`|\n]{1,30}`|`?[ \t]*\|[ \t]*`?)([^`|\s]{6,})[ \t]*[`|]")
SPACED = re.compile(r"(?<![\w$.-])([A-Za-z_][\w-]*+)[ \t]++(?=[^\s]*\d)([^\s\"'`,;(){}\[\]<>$|]{8,})(?=[\"'`,;)]?\s|[\"'`,;)]?$)", re.M)
LAST_WORDS = re.compile(r"(?<![\w$.-])([A-Za-z_][\w-]*+)[ \t]++(\S{8,}?)[ \t]*+(?:-->)?\r?$", re.M)
COMMENT_SIGN = re.compile(r"#|//|--|;|<!--")
LOGIN = re.compile(r"\b(?:log(?:ged)?[ -]?(?:in|on)|sign(?:ed)?[ -]?in|connect|authenticate)\b[^`\"'\n(=]{0,30}[`\"'][^`\"'\n]{1,60}[`\"'][^`\"'\n=(]{1,20}[`\"']([^`\"'\s]{6,})[`\"']", re.I)
SECRET_NAME = re.compile(r"kennwort|passwort|losung|contrase|clave|senha|mot_?de_?passe|wachtwoord|haslo|geheim|(?:^|[_a-z])(?:pass|pw)(?:[0-9a-f]{3})?$|passw|passphrase|passcode|pwd|secret|token|(?:api|access|private|signing|sign|service|account|encryption|hmac|master|auth|client|deploy|license|"
                         r"storage|shared|maps|stripe|aws|s3|g|ssh|db|app|web|hook|jwt|crypt|bot|admin|user)[_-]?key|_key|key$|credential|creds|bearer|auth|jwt|session|cookie", re.I)
PASSWORD_NAME = re.compile(r"kennwort|passwort|losung|contrase|clave|senha|mot_?de_?passe|wachtwoord|haslo|passw|passphrase|passcode|pwd|userpass|dbpass|(?:^|_)(?:pass|pw)(?:[0-9a-f]{3})?$|[a-z](?:Pass|Pw)(?:[0-9a-f]{3})?$", re.I)
STRONG_NAME = re.compile(r"passw|passphrase|pwd|secret|token|api[_-]?key|apikey|bearer|auth|credential|private[_-]?key|hmac|encrypt|signing|service[_-]?key", re.I)
#: Parts of a name that tell of something about a secret, or of an id or checksum.
OTHER_NAME = re.compile(r"(?:^|[_.-])(?:hash|sha\d*|md5|digest|checksum|sum|etag|integrity|fingerprint|thumbprint|id|ids|uuid|guid|request|trace|span|public|pub|verify|cert|"
                        r"label|help|hint|column|name|names|re|regex|pattern|format|type|kind|length|len|policy|url|uri|path|file|filename|dir|ttl|expiry|expires|count|"
                        r"limit|size|field|param|prefix|suffix|title|text|message|placeholder|example|sample|description|doc|endpoint|issuer|audience|scope|version|revision|commit|"
                        r"nonce|etag|resolved)(?:$|[_.-]|[0-9a-f]{3}$)|(?:Hash|Id|Name|Label|Help|Hint|Column|Path|File|Url|Type|Digest|Checksum)(?:$|[0-9a-f]{3}$)")
OTHER_NAME_I = re.compile(OTHER_NAME.pattern.split("|(?:Hash")[0], re.I)

REFERENCE = re.compile(
    r"\{[A-Za-z_][\w.()\[\]]*\}|\$\{|\$\(|\{\{|\}\}|%\(|<%|^\$[A-Za-z_]|^%[A-Za-z_]+%$|^<[^>]*>$|^\{[^}]*\}$|^@[\w.]|^#\{"
    r"|^(?:env|vault|ssm|secretref|secret|secrets|arn|op|kms|gcp|sm|awssm|keyvault|keychain|file|ref|projects|doppler|sops|credstash|parameter|aws-sm|gsm|azurekv|config|param|lookup|k8s)[:/]"
    r"|^(?:ENC|enc|AES|CRYPT|vault)[\[(]|^\$ANSIBLE_VAULT|^\{(?:cipher|SSHA|SHA|bcrypt|noop)[^}]*\}|^\$(?:2[aby]|5|6|argon2)|^sha(?:1|256|384|512)[-:]|^md5[-:]|^h1:|^ssh-(?:rsa|ed25519|dss)"
    r"|^age1|^(?:https?|file|git|s3|gs)://[^?@]*$|process\.env|os\.environ|getenv|^/(?:run|etc|var|usr|home|opt|tmp)/|^\.{0,2}/[\w./-]+$")
PLACEHOLDER = re.compile(
    r"change[_ .-]?(?:me|it|this)|replace[_ .-]?(?:me|this|with)|your[_ .-]|^your|example|placeholder|dummy|sample|fake|fixme|todo|redacted|masked|insert[_ -]|put[_ -]|enter[_ -]|goes[_ -]?here|"
    r"real[_ -]?value|not[_ -]?a[_ -]?real|^test|_here$|-here$|^x{4,}$|^(.)\1{5,}$|^[*.x•-]+$|^none$|^null$|^undefined$|^(?:pass(?:word)?|passwd|secret|token|key|user|admin|root|guest|default)\d{0,4}$"
    r"|(.)\2{7,}|^0+$|0{8,}|12345|abcdef|deadbeef|^<|^\.\.\.|^na$|^n/a$|xxxx|\*{4,}|\.{4,}", re.I)
UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
HEX = re.compile(r"[0-9a-f]{16,}", re.I)
LOCAL = re.compile(r"localhost|127\.0\.0\.1|\[?::1\]?|0\.0\.0\.0", re.I)


#: Numbers, dates and patterns, whose subwords are short for other reasons, and names of files and hosts.
NO_VALUE = re.compile(r"[\d.:/T-]+|.*(?:\(\?|\[\^|\\[bdsw]).*|[\w.-]+\.(?:py|js|ts|go|json|ya?ml|toml|pem|crt|txt|md|com|org|net|io|invalid|example|test)", re.S)


def literal(value: str) -> bool:
    """Neither a reference nor a placeholder."""
    return not REFERENCE.search(value) and not PLACEHOLDER.search(value)


def unnatural(value: str, limit: float, vocabulary: str) -> bool:
    """The one test that makes a value a credential."""
    return limit > 0 and bool(value) and chars_per_subword(value, vocabulary) < limit


def usual(value: str, most: float) -> float:
    """The limit by what the value is made of: words and names hold few digits."""
    return most if re.search("[0-9]", value) else min(most, UNNATURAL)


def limit(name: str, value: str) -> float:
    """The characters per subword under which a value given to a name is a credential; 0: it never is."""
    if re.search(r"\s", value) or OTHER_NAME.search(name) or OTHER_NAME_I.search(name) or not literal(value) or NO_VALUE.fullmatch(value):
        return 0.0
    if UUID.fullmatch(value) or HEX.fullmatch(value):  # ids and checksums look the same
        return MIXED if STRONG_NAME.search(name) else 0.0
    if PASSWORD_NAME.search(name):
        return usual(value, MADE_UP) if len(value) >= 6 else 0.0
    return usual(value, MIXED) if len(value) >= 10 else 0.0


def looks_issued(value: str, vocabulary: str) -> bool:
    """A random body behind the issuer's prefix."""
    return unnatural(value, MIXED if literal(value) and len(set(value)) >= 9 else 0.0, vocabulary)


def looks_token(value: str, vocabulary: str) -> bool:
    """Where a token is expected."""
    return unnatural(value, usual(value, MIXED) if literal(value) else 0.0, vocabulary)


def looks_password(value: str, vocabulary: str) -> bool:
    """Where a password is expected."""
    return unnatural(value, usual(value, MADE_UP) if literal(value) and not re.search(r"\s", value) else 0.0, vocabulary)


def looks_secret(name: str, value: str, vocabulary: str) -> bool:
    return unnatural(value, limit(name, value), vocabulary)


def looks_basic(value: str, vocabulary: str) -> bool:
    try:
        user, sep, password = base64.b64decode(value + "=" * (-len(value) % 4), validate=True).decode().partition(":")
    except (ValueError, binascii.Error):
        return False
    return bool(sep) and len(password) >= 3 and looks_password(password, vocabulary)


CONTINUED = re.compile(r"[ \t]*+(?:(?:\\|\+|\.\.)[ \t]*+)?\r?\n[ +-]?[ \t]*+(?:(?:\+|\.\.)[ \t]*+)?[rbufRBUF]{0,2}([\"'`])")


def _literal_at(text: str, at: int, quote: str) -> list[tuple[int, int]] | None:
    """Spans of the literal whose opening quote ends at `at`, with the parts that adjoin it on the next lines."""
    if len(quote) == 3:
        end = text.find(quote, at)
        return [(at, end)] if at <= end else None
    spans = []
    while True:
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        stop = len(text) if quote == "`" else stop
        end = text.find(quote, at, stop)
        while end > at and text[end - 1] == "\\":
            first = end - 1
            while first > at and text[first - 1] == "\\":
                first -= 1
            if (end - first) % 2 == 0:
                break
            end = text.find(quote, end + 1, stop)
        if end < 0:
            return spans or None
        spans.append((at, end))
        m = CONTINUED.match(text, end + 1)
        if not m:
            return spans
        quote, at = m[1], m.end()


def _comma(m: re.Match) -> bool:
    return m[0][:m.start(1) - m.start()].rstrip(" \t\r\nrbufRBUF").endswith(",")


def _secret_names(text: str) -> Iterator[tuple[int, int]]:
    """Spans of the names with a hint in them; each name is gone through once."""
    at = 0
    while m := HINT.search(text, at):
        begin = m.start()
        while begin > at and (text[begin - 1].isalnum() or text[begin - 1] in "_$.-"):
            begin -= 1
        at = NAME_END.match(text, m.end()).end()
        yield begin, at


def _private_keys(text: str) -> Iterator[tuple[int, int]]:
    ends, begins = list(PEM_END.finditer(text)), list(PEM.finditer(text))
    stops = [e.start() for e in ends]
    for k, m in enumerate(begins):
        e = bisect.bisect_left(stops, m.end())
        if e < len(ends) and not (k + 1 < len(begins) and begins[k + 1].start() < stops[e]):
            end, stop = ends[e].end(), stops[e]
        else:  # cut off: the lines of base64 that follow
            tail = PEM_TAIL.match(text, m.end())
            end = stop = tail.end() if tail else m.end()
        body = re.sub(r"\\[nr]|[^A-Za-z0-9+/=]", "", text[m.end():stop])
        if len(body) >= 16 and len(set(body)) >= 10:
            yield m.start(), end


def _judge(text: str, name: str, secret: bool, got: list[tuple[int, int]] | None, vocabulary: str) -> list[tuple[int, int, str]]:
    """The spans of the literal given to a name, if it is a credential."""
    if not got or not secret and len(got) == 1:
        return []
    whole = "".join(text[a:b] for a, b in got).strip()
    kind = known_format(whole, vocabulary) if len(got) > 1 else None
    if kind is None and secret and "\n" not in whole and looks_secret(name, whole, vocabulary):
        kind = "password" if PASSWORD_NAME.search(name) else "key"
    return [(a, b, kind if n == 0 else "part") for n, (a, b) in enumerate(got)] if kind else []


def known_format(value: str, vocabulary: str) -> str | None:
    """Kind of a whole literal that has a format of its own."""
    if ISSUED.fullmatch(value):
        return "key" if looks_issued(value, vocabulary) else None
    if h := HEADER.fullmatch(value):
        return "header" if (looks_basic(h[2], vocabulary) if h[1] == "Basic" else looks_token(h[2], vocabulary)) else None
    if u := URL_LOGIN.match(value):
        return "password in url" if not LOCAL.fullmatch(u[3]) and looks_password(u[2], vocabulary) else None
    if k := URL_QUERY.search(value):
        return "token in url" if looks_token(k[1], vocabulary) else None
    return "private key" if PEM.search(value) else None


#: One of these is in every text that has more than a fixed format; most texts hold none.
HINTS = ("kennwort", "passwort", "losung", "contrase", "clave", "senha", "passe", "wachtwoord", "haslo", "geheim", "passw", "passphrase", "passcode", "pwd", "secret", "token", "key", "cred", "bearer", "auth", "jwt", "session", "cookie", "pass", "pw", "basic", "login", "log in", "sign in")


def find(text: str, is_patch: bool, vocabulary: str = VOCABULARY, code: bool = True) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the values, in order and without overlap; a value of several parts gives one span per part,
    of which only the first has a kind other than 'part'."""
    out: list[tuple[int, int, str]] = []
    if "PRIVATE KEY" in text:
        out.extend((a, b, "private key") for a, b in _private_keys(text))
    for m in ISSUED.finditer(text):
        if looks_issued(m[1], vocabulary):
            out.append((m.start(1), m.end(1), "key"))
    if "://" in text:
        for m in URL_LOGIN.finditer(text):
            if not (LOCAL.fullmatch(m[3]) and re.fullmatch(r"pass(?:word)?|passwd|pwd|secret", m[2], re.I)) and looks_password(m[2], vocabulary):
                out.append((m.start(2), m.end(2), "password in url"))
    if "=" in text:
        for m in URL_QUERY.finditer(text):
            if looks_token(m[1], vocabulary):
                out.append((m.start(1), m.end(1), "token in url"))
    low = text.lower()
    hinted = any(h in low for h in HINTS)
    for m in HEADER.finditer(text) if "Basic" in text or "Bearer" in text or "Token" in text or "ApiKey" in text else ():
        if looks_basic(m[2], vocabulary) if m[1] == "Basic" else len(m[2]) >= 16 and looks_token(m[2], vocabulary):
            out.append((m.start(2), m.end(2), "header"))
    for begin, end in _secret_names(text) if hinted else ():
        m = BETWEEN.match(text, end)
        if not m:
            continue
        name = text[begin:end].lstrip("-.$0123456789")
        if not name or _comma(m) and (begin == 0 or text[begin - 1] not in "\"'`" or "\n" in m[0]) or not SECRET_NAME.search(name):
            continue
        out.extend(_judge(text, name, True, _literal_at(text, m.end(), m[1]), vocabulary))
    line = -1
    for g in GOES_ON.finditer(text):
        at = text.rfind("\n", 0, g.start()) + 1
        if at == line:
            continue
        line = at
        for n in NAMED.finditer(text, at, g.start() + 1):
            m = BETWEEN.match(text, n.end(), g.start() + 1)
            if m:
                if not SECRET_NAME.search(n[1]) and not _comma(m):
                    out.extend(_judge(text, n[1], False, _literal_at(text, m.end(), m[1]), vocabulary))
                break
    for m in BARE.finditer(text) if hinted else ():
        if not SECRET_NAME.search(m[1]):
            continue
        value = m[2].rstrip("\\.")
        # a keyword argument is given a name, not a literal
        if code and m[0].lstrip(".-")[len(m[1])] == "=" and re.fullmatch(r"[A-Za-z_][\w.]*", m[2]) and not (len(m[2]) >= 16 and unnatural(m[2], MIXED, vocabulary) and len(re.findall("[0-9]", m[2])) >= 2):
            continue
        if looks_secret(m[1], value, vocabulary):
            out.append((m.start(2), m.start(2) + len(value), "password" if PASSWORD_NAME.search(m[1]) else "key"))
    for m in PROSE.finditer(text) if hinted and ("`" in text or "|" in text) else ():
        # beside each other stand also names of the code
        if SECRET_NAME.search(m[1]) and re.search("[0-9]", m[2]) and looks_secret(m[1], m[2], vocabulary):
            out.append((m.start(2), m.end(2), "password" if PASSWORD_NAME.search(m[1]) else "key"))
    for m in LOGIN.finditer(text) if "log" in low or "sign" in low or "connect" in low or "authenticate" in low else ():
        if looks_password(m[1], vocabulary):
            out.append((m.start(1), m.end(1), "password"))
    for m in [*SPACED.finditer(text), *(m for m in LAST_WORDS.finditer(text) if SECRET_NAME.search(m[1]) and COMMENT_SIGN.search(text, text.rfind("\n", 0, m.start()) + 1, m.start()))] if hinted else ():
        # words that merely follow a name: the limit is lower, but for values with signs that no identifier has
        if SECRET_NAME.search(m[1]) and re.search("[0-9]", m[2]):
            most = limit(m[1], m[2])
            if unnatural(m[2], most if re.search(r"[^\w.]", m[2]) else min(most, MIXED), vocabulary):
                out.append((m.start(2), m.end(2), "password" if PASSWORD_NAME.search(m[1]) else "key"))
    for m in BLOCK.finditer(text) if ">" in text or "|" in text else ():
        indent = len(m[1])
        spans, at = [], m.end() + 1
        while at < len(text):
            nl = text.find("\n", at)
            nl = len(text) if nl < 0 else nl
            line = text[at:nl].rstrip("\r")
            body = line[1:] if is_patch else line
            lead = len(body) - len(body.lstrip(" \t")) + is_patch
            if not body.strip() or lead <= indent:
                break
            spans.append((at + lead, at + len(line.rstrip())))
            at = nl + 1
        value = "".join(text[a:b] for a, b in spans)
        if spans and "PRIVATE KEY" not in value:
            if known_format(value, vocabulary) or SECRET_NAME.search(m[2]) and looks_secret(m[2], value, vocabulary):
                out.extend((a, b, "block" if n == 0 else "part") for n, (a, b) in enumerate(spans))
    if len(out) < 2:
        return out
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, last = [], -1
    for s, e, k in out:
        if s >= last:
            kept.append((s, e, k))
            last = e
        elif e > last:  # overlapping finds: keep what the first did not cover
            kept.append((last, e, "part"))
            last = e
    return kept


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, _ in spans:
        out.append(text[at:s])
        out.append(re.sub(r"[^\r\n]", "*", text[s:e]) if "\n" in text[s:e] else "*" * (e - s))
        at = e
    return "".join(out) + text[at:]


def _scan(is_patch: bool, vocabulary: str, redacted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, lines, kinds, starts, ends, texts = [], [], [], [], [], []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                spans = find(text, is_patch, vocabulary) if text else []
                if redacted:
                    ids.append(key)
                    texts.append(redact(text, spans) if spans else text)
                    lines.append(sum(k != "part" for _, _, k in spans))
                    continue
                n, at = 1, 0
                for s, e, k in spans:
                    n += text.count("\n", at, s)
                    at = s
                    if k != "part":
                        ids.append(key)
                        lines.append(n)
                        kinds.append(k)
                        starts.append(s)
                        ends.append(e)
            if redacted:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(lines, pa.int32()), pa.array(texts, pa.string())], names=["row_id", "n_found", "redacted"])
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.string()), pa.array(lines, pa.int32()), pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                    names=["row_id", "line_no", "kind", "start_char", "end_char"])
    return run


def scan(rows: DataFrame, *, row_id: str = "id", text: str = "content", is_patch: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, line_no, kind, start_char, end_char): the values found, no shuffle but for the few findings."""
    share(rows.sparkSession, vocabulary)
    slim = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_scan(is_patch, vocabulary, False), "row_id string, line_no int, kind string, start_char int, end_char int").distinct()


def redact_rows(rows: DataFrame, *, row_id: str = "id", text: str = "content", is_patch: bool = False, vocabulary: str = VOCABULARY) -> DataFrame:
    """(row_id, n_found, redacted) of every row, repeated rows included."""
    share(rows.sparkSession, vocabulary)
    slim = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(text).alias("text"))
    return slim.mapInArrow(_scan(is_patch, vocabulary, True), "row_id string, n_found int, redacted string")
