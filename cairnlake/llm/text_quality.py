"""Per-document text statistics and how far each document is from natural prose of its language.

Statistics describe words, symbols and lines: counts, lengths, shares of common words, digits, symbols and
separators, distinct words, lines that end in punctuation, and the share of characters on lines that belong to
lists, tables, logs, key-value dumps, code, navigation, repetition and random matter. Per language a prose mean
and covariance are fitted robustly: from the documents without structure, then re-fitted on those within the
chi-square bound of the fit before (concentration steps). The squared Mahalanobis distance of a document is
split into one contribution per statistic, which sum to it; beyond the bound a document is no prose.

Two things make distances of unequal documents comparable. Means over few words scatter more, so deviations are
scaled by sqrt(n / (n + SHORT)) for n words, in the fit as in the distance. And every statistic has a least
deviation, its FLOOR; the one of other_share is such that a document like the prose of its language in all else, of
which just half is something else, lies on the bound. The number of words itself is reported, but size is no sign
of kind: it takes no part in the distance.

Plan. The statistics take one pass over the texts in Arrow batches; from then on only numbers move. Means
and covariances are sums per language within each partition, then over partitions; one row per language
reaches the driver. Distances come with the statistics they were computed from, nothing is joined.

Defined results
- null or blank text: zero words, every share zero, distance null, not prose.
- a null or wrong language label does not matter: the language is the one whose common words the text has most of, else
  the script most letters are of, 'und' where neither is found. Languages with fewer than FEWEST prose documents use the
  fit over all.
- repeated rows of an id count once; of different texts under one id the greatest holds. Extra columns are ignored.
- texts are read whole, in time linear in their length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Frequent words of a few languages.
COMMON = {
    "en": "the a an and of to in is it that for on with as was were by this be are or not but if we you he she they has have from at which each no can its will so after before when while because".split(),
    "de": "der die das und ist nicht ein eine den dem des zu im in von mit auf für sich wird sind aber auch als an bei nach noch es wenn dass oder hat ohne seit obwohl weil vor zum zur".split(),
    "es": "el la los las de en y que no un una se por con para es del al lo como más pero sus su ya cuando este esta sin sobre desde hasta aunque porque cada antes".split(),
    "fr": "le la les de des et un une est en que qui dans pour pas ne sur avec ce cette au aux par plus il elle nous vous sont mais ou où du se sans".split(),
    "it": "il lo la gli le di e che un una è non per con del della in si da sono come ma più nel alla anche questo questa".split(),
    "pt": "o a os as de e que um uma não em para com do da no na por se mais como mas foi ao são sem este esta".split(),
    "nl": "de het een en van ik te dat die in is niet op met voor zijn er aan om ook als maar bij nog wordt naar".split(),
    "pl": "i w na z się nie że do to jest o jak ale po co tak za od przez dla są oraz".split(),
    "sv": "och i att det som en på är av för med den till inte om ett har de var från men".split(),
}
_WORD_LANGS: dict[str, list[str]] = {}
for _lang, _words in COMMON.items():
    for _w in _words:
        _WORD_LANGS.setdefault(_w, []).append(_lang)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
QUOTE = re.compile(r"(?:>\s?)+")
LIST = re.compile(r"(?:[-*+•‣–·]|\(?\d{1,4}[.)]|\(?[a-zA-Z][.)]|\[[ xX]\])\s+\S")
RULE = re.compile(r"[\W_]+")
LOG = re.compile(r"\[?(?:\d{4}[-/]\d\d[-/]\d\d[T ,]+)?\d\d:\d\d(?::\d\d)?|\[?(?:TRACE|DEBUG|INFO|WARN(?:ING)?|ERROR|FATAL|CRITICAL)\b|\d{4}[-/]\d\d[-/]\d\d\b")
PAIR = re.compile(r"[\"']?[\w$-]++(?:\.[\w$-]++)*+[\"']?\s*+=(?!=)\s*\S|[\"'][^\"'\n]++[\"']\s*+:\s*\S|(?=[\w-]*[_.\d])[\w.-]++\s*+:(?:\s|$)|[\w-]++:$|[A-Z][\w-]*+:\s++\S++$|[a-z][\w-]*+:\s++\S++(?:\s\S++)?$")
CSV = re.compile(r"[^\s,;\t]*(?:[,;\t][^\s,;\t]*){2,}")
CODE = re.compile(
    r"(?:def|class|async def|func|fn|package|import|from \S+ import|return|const|let|var|export|(?:public|private|protected|static)\s+(?:[\w<>\[\]]+\s+)*\w+\s*[({=;]|function|if \(|for \(|while \(|switch|case .*:$|else\b|try\b|except\b|"
    r"catch|finally|raise|throw|with .*:$|if .*:$|for (?=.*:$).* in |while .*:$|elif|@\w+|#!|//|/\*|\*/|#include|#define|using |namespace|struct |enum |interface |type \w+ =|select .* from|insert into|update \w+ set|"
    r"create table|delete from|fi$|done$|esac$|echo |set -|rm -|mkdir |cd |exit \d|local \w+=|done|assert |lambda|pass$|break$|continue$|self\.|\$ |>>> |yield |await |del |print\(|log\.)|Traceback \(most recent|File \"[^\"]*\", line \d+|\w+(?:Error|Exception)\b|at [\w.$<>]+\(",
    re.I)
CODE_END = re.compile(r"\b(?:then|do)$|;;$|\$[\w({]|^\*\) |[{};\\]$|\)\s*:$|[({\[]$|^[)\]}]|=>|\w\(\)|\w\([^()]*\)\s*$|->|::|:=|==|!=|\+=|&&|\|\|")
SIGN, DIGIT = re.compile(r"[^\w\s]|_"), re.compile(r"\d")
#: Signs that prose has few of.
ODD_SIGN = re.compile(r"[^\w\s.,!?'\"’“”«»:;()…–—¿¡%-]|_")
SENTENCE_END = re.compile(r"[.!?…。:;][\"'”’»)\]*_]*$")
SENTENCES = re.compile(r"(?<=[.!?…])\s+|\n+")
SPAN = re.compile(r"`[^`\n]*`")
#: Signs of text decoded with the wrong character set, and runs no language has.
ODD = re.compile(r"[¢¤§¬Ãâ™‚ƒ\ufffdÂ€œž]{2}|[a-z][ÃÂ¬¢¤§ƒ‚™\ufffd]|[ÃÂ¬¢¤§ƒ‚™\ufffd][a-z]")
#: Letters and digits run together, as in encoded data.
DENSE = (re.compile(r"[A-Za-z]\d+[A-Za-z]"), re.compile(r"[a-z][A-Z]"), re.compile(r"\d"))
#: Signs that set off the entries of a list on one line: between spaces, or a semicolon.
SEPARATOR = re.compile(r" (?:[/|»›·•→]|->|=>|::) |; ")
#: A line of words and the signs of sentences only.
PLAIN = re.compile(r"[^\W\d_][^\W_]*+(?:[ ,'’.!?\"“”-]++[^\W_]++)*+[ .,!?\"”’]*+")
#: First letters of scripts that no list of common words covers.
SCRIPTS = ((0x370, 0x3FF, "grek"), (0x400, 0x52F, "cyrl"), (0x530, 0x58F, "armn"), (0x590, 0x5FF, "hebr"), (0x600, 0x6FF, "arab"), (0x900, 0x97F, "deva"),
           (0x980, 0x9FF, "beng"), (0xB80, 0xBFF, "taml"), (0xE00, 0xE7F, "thai"), (0x10A0, 0x10FF, "geor"), (0x3040, 0x30FF, "jpan"), (0x4E00, 0x9FFF, "hani"),
           (0xAC00, 0xD7AF, "hang"))
#: What entries of a change log have and sentences do not.
ENTRY = re.compile(r"\(#?\d+\)|^[*+-]\s*\w+(?:\([\w-]+\))?!?:|\b[0-9a-f]{7,}\b|[#/_=]")
CONSONANTS = re.compile(r"[bcdfghjklmnpqrstvwxz]{5,}")
KINDS = ("list", "table", "log", "pair", "code", "nav", "random", "repeat")
#: Statistics of the distance, with the least standard deviation of each (0: see half_floor) and whether it scatters with few words.
FITTED = {"word_length": (0.3, True), "words_per_line": (0.3, True), "symbol_ratio": (0.02, True), "digit_ratio": (0.02, True), "upper_ratio": (0.25, True), "common_share": (0.05, True),
          "end_share": (0.15, True), "separator_share": (0.02, True), "distinct_share": (0.1, True), "other_share": (0.0, False)}
STATS = ("log_words", *FITTED, *(f"{k}_share" for k in KINDS))
#: Distinct words are counted in stretches of so many words.
STRETCH = 50


def ends(s: str) -> bool:
    """Whether a line ends as a sentence does."""
    last = s[-1:]
    return last in ".!?…。:;" and last != "" or last in "\"'”’»)]*_" and SENTENCE_END.search(s[-12:]) is not None


def natural(words: list[str]) -> bool:
    """Letters as languages use them: vowels in most words, no long runs of consonants, no capitals within."""
    good = 0
    for w in words:
        low = w.lower()
        if sum("a" <= c <= "z" for c in low) < len(low) * 0.6:
            good += len(low) > 1 and not ODD.search(w)
            continue
        vowels = sum(c in "aeiouyäöüáéíóúàèìòùâêîôûåæøœãõ" for c in low)
        inner = w[1:] != low[1:] and w != w.upper()
        good += (0.13 <= vowels / len(low) <= 0.8 or len(low) <= 3 and vowels > 0) and not inner and not ODD.search(w) and not CONSONANTS.search(low)
    return good >= 0.65 * len(words)


def dense(s: str) -> bool:
    at = 0
    for p in DENSE:
        m = p.search(s, at)
        if not m:
            return False
        at = m.end()
    return True


def script(words: list[str]) -> str:
    """Script of most letters, 'und' for Latin and unknown ones."""
    votes: Counter = Counter()
    for w in words:
        c = ord(w[0])
        if c >= 0x370:
            name = next((n for a, b, n in SCRIPTS if a <= c <= b), "")
            votes[name] += len(w)
    if not votes:
        return "und"
    if "jpan" in votes and "hani" in votes:  # Japanese uses both
        votes["jpan"] += votes.pop("hani")
    name, most = max(votes.items(), key=lambda x: (x[1], x[0]))
    return name if name and 2 * most > sum(map(len, words)) else "und"


def count_signs(text: str) -> tuple[int, int, int]:
    """Signs, digits and capitals."""
    if text.isascii():
        n = len(text)
        return n - len(text.translate(_SIGNS)), n - len(text.translate(_DIGITS)), n - len(text.translate(_CAPITALS))
    return len(SIGN.findall(text)), len(DIGIT.findall(text)), sum(map(str.isupper, text))


_SIGNS = dict.fromkeys(i for i in range(33, 127) if not chr(i).isalnum())
_DIGITS, _CAPITALS = dict.fromkeys(range(48, 58)), dict.fromkeys(range(65, 91))


def wrapped(body: list[str], known: set[str]) -> bool:
    """Whether lines are those of a wrapped text: the first word of the next one did not fit on them, and some break is
    beside a word that neither begins nor ends an entry of a list, or a line ends a sentence."""
    width = max(map(len, body))
    full = sum(len(a) + 1 + len(b.split(None, 1)[0]) > width for a, b in zip(body, body[1:]) if b)
    return full >= 0.8 * (len(body) - 1) and any(ends(a) or a.endswith(",") or a.rsplit(None, 1)[-1:][0].lower() in known or b.split(None, 1)[:1][0].lower() in known
                                                 for a, b in zip(body, [*body[1:], "."]) if a and b)


def line_kind(s: str, common: int, words: list[str], doc_share: float) -> str:
    """Kind of one stripped line."""
    n = len(words)
    if LIST.match(s):
        return "list"
    if s.startswith("|") or s.count("|") >= 2 or s.count("\t") >= 2:
        return "table"
    if LOG.match(s):
        return "log"
    bare = SPAN.sub("x", s) if "`" in s else s
    if n >= 8 and common >= 0.2 * n and PLAIN.fullmatch(bare) and not bare.endswith(("then", "do")):  # most lines of prose need no more tests
        return "prose"
    if not words:
        return "repeat" if RULE.fullmatch(s) and len(set(s)) <= 3 else "pair"
    if s.startswith("#") and len(words) <= 12:
        return "heading"
    if len(s) >= 30 and " " not in s and dense(s):
        return "random"
    share = common / n
    if CSV.fullmatch(bare) and n <= 2 * (1 + bare.count(",") + bare.count(";")) and " " not in bare:
        return "table"
    if PAIR.match(bare):
        return "pair"
    odd = len(ODD_SIGN.findall(bare)) / max(1, len(bare))
    if CODE.match(bare) and (CODE_END.search(bare) or share < 0.25 and (odd >= 0.03 or n <= 5)) and not (ends(bare) and n >= 4 and odd < 0.03):
        return "code"
    if CODE_END.search(bare) and (share < 0.2 or odd > 0.08) and bare[-1:] not in ".!?":
        return "code"
    if bare.count(",") >= 5 and n < 2.6 * bare.count(",") and share < 0.2:
        return "list"
    if n >= 2 and share < 0.15 and (not natural(WORD.findall(s)) or len(ODD.findall(s)) > 0.03 * len(s)):
        return "random"
    if odd > 0.15:
        return "code"
    if n <= 4 and not ends(s):
        return "short"
    if n >= 8 and share < 0.06 and doc_share < 0.1 and not ends(s):
        return "list"
    return "prose"


def statistics(text: str) -> tuple[str, int, list[float]]:
    """(language, words, values of STATS)."""
    lines = [QUOTE.sub("", x.strip(), count=1).strip() if x.lstrip().startswith(">") else x.strip() for x in text.replace("\r\n", "\n").split("\n")]
    joined = "\n".join(lines)
    low_joined = joined.lower()
    low_line = list(map(WORD.findall, low_joined.split("\n")))
    lows = [w for ws in low_line for w in ws]
    n_words = len(lows)
    votes: Counter = Counter()
    counted = Counter(lows)
    for w in counted.keys() & _WORD_LANGS.keys():
        for lang in _WORD_LANGS[w]:
            votes[lang] += counted[w]
    lang, hits = max(votes.items(), key=lambda x: (x[1], x[0])) if votes else ("und", 0)
    if hits < max(1, 0.03 * n_words):
        lang = "und"
    if lang == "und" and not text.isascii():
        lang = script(lows)
    known = set(COMMON.get(lang, ()))
    total = sum(map(len, lines))
    chars = dict.fromkeys((*KINDS, "heading", "short", "prose"), 0)
    ended = filled = 0
    kinds: list[str] = []
    for s, w in zip(lines, low_line):
        if not s:
            kinds.append("")
            continue
        filled += 1
        kinds.append(line_kind(s, sum(map(known.__contains__, w)), w, hits / max(1, n_words)))
        ended += ends(s)
    # prose behind the marker of a comment block: sentences run on from line to line
    i = 0
    while i < len(kinds):
        j = i
        while j < len(kinds) and kinds[j] == "list" and lines[j][0] == lines[i][0] and lines[i][0] in "*-+":
            j += 1
        if j - i >= 2:
            body = [x[1:].strip() for x in lines[i:j]]
            runs_on = sum(not ends(a) and b[:1].islower() for a, b in zip(body, body[1:]))
            w = WORD.findall(" ".join(body))
            if runs_on >= 0.4 * (j - i - 1) and wrapped(body, known) and not any(ENTRY.search(x) for x in lines[i:j]) and sum(x.lower() in known for x in w) >= 0.2 * len(w) and len(w) >= 4 * (j - i):
                kinds[i:j] = ["prose"] * (j - i)
        i = max(j, i + 1)
    # a short line after a line of prose ends it, one before prose opens it; alone it is navigation
    for i, k in enumerate(kinds):
        if k == "short":
            before = kinds[i - 1] if i else ""
            after = next((x for x in kinds[i + 1:i + 3] if x), "")
            kinds[i] = "prose" if before == "prose" or before == "heading" or after == "prose" else "nav"
    structure = sum(k in ("code", "pair", "log") for k in kinds)
    if structure >= 0.5 * filled:  # comments and words alone on a line within code
        kinds = ["code" if k in ("heading", "nav") or k == "prose" and len(x.split()) <= 6 and not ends(x) else k for k, x in zip(kinds, lines)]
    for i, k in enumerate(kinds):
        if k in ("heading", "nav") and 0 < i < len(kinds) - 1:
            around = [x for x in (kinds[i - 1], kinds[i + 1]) if x]
            if around and all(x in ("code", "pair", "log") for x in around):
                kinds[i] = around[0]
    for s, k in zip(lines, kinds):
        if k:
            chars[k] += len(s)
    # repetition: sentences or lines that occur three times or more; only what is not structure already
    # a rough split at first: few texts repeat anything
    rough = low_joined.replace("\n", ". ").replace("\t", " ").replace("? ", ". ").replace("! ", ". ").replace("… ", ". ").split(". ")
    if len(rough) > 2 and max(Counter([p.strip(" .!?…\r") for p in rough]).values()) >= 3:
        parts = [(p.strip().lower(), k) for s, k in zip(lines, kinds) if k in ("prose", "nav", "heading") for p in SENTENCES.split(s) if p.strip()]
        seen = Counter(p for p, _ in parts)
        for p, k in parts:
            if seen[p] >= 3:
                chars["repeat"] += len(p)
                chars[k] -= len(p)
    d = max(1, total)
    letters = max(1, sum(map(len, lows)))
    other = min(1.0, sum(chars[k] for k in KINDS) / d)
    signs, digits, capitals = count_signs(text)
    size = max(1, len(text))
    stretches = [lows[i:i + STRETCH] for i in range(0, max(1, n_words - STRETCH // 2), STRETCH)]
    distinct = sum(len(set(x)) / max(1.0, STRETCH * (len(x) / STRETCH) ** 0.85) for x in stretches) / len(stretches)
    values = [
        math.log1p(n_words), letters / max(1, n_words) if n_words else 0.0, math.log1p(n_words / max(1, filled)), signs / size, digits / size, capitals / letters,
        hits / max(1, n_words), ended / max(1, filled), len(SEPARATOR.findall(joined)) / max(1, n_words), distinct, other, *(max(0, chars[k]) / d for k in KINDS)]
    return lang, n_words, [float(v) for v in values]


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, langs, counts, vals = b.column(0), [], [], []
        for t in b.column(1).to_pylist():
            lang, n, v = statistics(t or "")
            langs.append(lang)
            counts.append(n)
            vals.append(v)
        m = np.array(vals, np.float64).reshape(-1, len(STATS))
        yield pa.RecordBatch.from_arrays([ids, pa.array(langs, pa.string()), pa.array(counts, pa.int64()), *(pa.array(m[:, i]) for i in range(len(STATS)))],
                                         names=["doc_id", "language", "words", *STATS])


def measure(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, language, words, STATS...), one row per document."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    stats = slim.mapInArrow(_measure, "doc_id bigint, language string, words bigint, " + ", ".join(f"{s} double" for s in STATS))
    return stats.groupBy("doc_id").agg(F.max(F.struct("words", "language", *STATS)).alias("s")).select("doc_id", "s.language", "s.words", *[F.col(f"s.{x}").alias(x) for x in STATS])


#: The fewest prose documents for a fit of its own, concentration steps, the bound's quantile, words at which a mean's variance is twice that of a long text's.
FEWEST, STEPS, QUANTILE, SHORT = 60, 2, 0.99, 20
NAMES = tuple(FITTED)


def chi_square(p: float, k: int) -> float:
    """Quantile by Wilson and Hilferty."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return k * (1 - 2 / (9 * k) + z * math.sqrt(2 / (9 * k))) ** 3


BOUND = chi_square(QUANTILE, len(NAMES))
#: Least deviations; half a document of something else is just on the bound.
FLOORS = np.array([f or 0.5 / math.sqrt(BOUND) for f, _ in FITTED.values()])
SCATTERS = np.array([x for _, x in FITTED.values()])


def _matrix(b: pa.RecordBatch) -> np.ndarray:
    return np.column_stack([b.column(s).to_numpy(zero_copy_only=False) for s in NAMES]) if b.num_rows else np.zeros((0, len(NAMES)))


def _deviations(x: np.ndarray, words: np.ndarray, mean: np.ndarray) -> np.ndarray:
    y = x - mean
    y[:, SCATTERS] *= np.sqrt(words / (words + SHORT))[:, None]
    return y


def _of(fits: dict, lang):
    return fits.get(lang) or fits.get("*") or (np.zeros(len(NAMES)), np.eye(len(NAMES)))


def _parts(b: pa.RecordBatch, fits: dict) -> np.ndarray:
    """Contribution of each statistic to the squared distance of each row."""
    x, words, langs = _matrix(b), b.column("words").to_numpy(zero_copy_only=False), np.array(b.column("language").to_pylist(), object)
    out = np.zeros_like(x)
    for lang in set(langs):
        rows = np.flatnonzero(langs == lang)
        mean, inverse = _of(fits, lang)
        y = _deviations(x[rows], words[rows], mean)
        out[rows] = y * (y @ inverse)
    return out


D = len(NAMES)
SUMS = [f"s{i}" for i in range(D)] + [f"y{i}" for i in range(D)] + [f"p{i}_{j}" for i in range(D) for j in range(D)]


def _sums(fits: dict | None):
    """Per language of a partition, over its prose: number, sums, sums and products of deviations from the mean of the fit before.
    Prose is what is within the bound of `fits`, at first what has hardly any structure."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            words, langs, x = b.column("words").to_numpy(zero_copy_only=False), np.array(b.column("language").to_pylist(), object), _matrix(b)
            near = (_parts(b, fits).sum(axis=1) <= BOUND) if fits else x[:, NAMES.index("other_share")] < 0.1
            near &= words >= 5
            for lang in set(langs[near]):
                rows = np.flatnonzero(near & (langs == lang))
                y = _deviations(x[rows], words[rows], _of(fits, lang)[0] if fits else np.zeros(D))
                got = np.concatenate([[len(rows)], x[rows].sum(axis=0), y.sum(axis=0), (y.T @ y).ravel()])
                total[lang] = total[lang] + got if lang in total else got
        if total:
            m = np.array(list(total.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *(pa.array(m[:, i]) for i in range(m.shape[1]))], names=["language", "n", *SUMS])
    return run


def _fit(stats: DataFrame, fits: dict | None) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Mean and inverse covariance per language, and over all as '*'; languages with few documents have the fit over all."""
    sums = stats.mapInArrow(_sums(fits), "language string, n double, " + ", ".join(f"{c} double" for c in SUMS))
    total: dict[str, np.ndarray] = {}
    for r in sums.groupBy("language").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS)]).collect():  # one row per language of COMMON or SCRIPTS
        got = np.array(r[1:], float)
        total[r["language"]] = got
        total["*"] = total["*"] + got if "*" in total else got
    out = {}
    for lang, t in total.items():
        n, mean, shift, products = t[0], t[1:D + 1] / t[0], t[D + 1:2 * D + 1] / t[0], t[2 * D + 1:].reshape(D, D) / t[0]
        if lang == "*" or n >= FEWEST:
            out[lang] = (mean, np.linalg.inv(products - np.outer(shift, shift) + np.diag(FLOORS ** 2)))
    return out


def _distances(fits: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = _parts(b, fits)
            empty = b.column("words").to_numpy(zero_copy_only=False) == 0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "language", "words", *STATS)), pa.array(parts.sum(axis=1), mask=empty), *(pa.array(parts[:, i]) for i in range(D))],
                                             names=["doc_id", "language", "words", *STATS, "distance", *(f"c_{s}" for s in NAMES)])
    return run


DISTANCE_SCHEMA = "doc_id bigint, language string, words bigint, " + ", ".join(f"{s} double" for s in STATS) + ", distance double, " + ", ".join(f"c_{s} double" for s in NAMES)


def outlierness(stats: DataFrame) -> DataFrame:
    """measure()'s rows with distance, c_<statistic>... and is_outlier; `stats` is read several times, so make it durable."""
    fits = None
    for _ in range(STEPS + 1):
        fits = _fit(stats, fits)
    return stats.mapInArrow(_distances(fits), DISTANCE_SCHEMA).withColumn("is_outlier", F.coalesce(F.col("distance") > BOUND, F.lit(True)))
