"""Generated, minified or vendored source files, lockfiles and data blobs saved as code.

A multi-pattern automaton (Aho-Corasick) finds notices in the header comments that open a file or hunk, in
one pass over all patterns; path rules add lockfiles, vendored package folders and the suffixes of
generators and minifiers; line statistics add minified text and pure data. Each row of a file is turned
into a few numbers, and a file is judged by the sums over all its rows.

A notice counts only where it stands in a comment before any code, at the start of the comment or after a
few connecting words: code that holds a notice in a string, or a comment saying that something writes or
tests one, does not count. Terms of a licence alone do not make a file vendored, for a project's own files have
them too; a foreign holder or origin does. A folder name alone (vendor/, dist/, generated/) never counts.

Defined results
- null path: no file, left out. null repository: the files of repository null.
- null or empty text: judged by path alone. Repeated rows (same id) count once.
- extra columns are ignored; the stored flags are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Notice -> kind. Texts that tools write into the files they make, in lower case.
NOTICES = {
    "@generated": "generated",
    "<auto-generated": "generated",
    "auto-generated": "generated",
    "auto generated": "generated",
    "autogenerated": "generated",
    "automatically generated": "generated",
    "generated automatically": "generated",
    "created automatically": "generated",
    "code generated by": "generated",
    "generated by": "generated",
    "generated from": "generated",
    "generated with": "generated",
    "generated file": "generated",
    "generated code": "generated",
    "machine generated": "generated",
    "machine-generated": "generated",
    "this file is generated": "generated",
    "this file was generated": "generated",
    "automatisch erzeugt": "generated",
    "automatisch generiert": "generated",
    "generado automáticamente": "generated",
    "généré automatiquement": "generated",
    "do not edit": "generated",
    "do not hand-edit": "generated",
    "do not hand edit": "generated",
    "do not alter": "generated",
    "do not touch": "generated",
    "don't edit": "generated",
    "nicht von hand": "generated",
    "nicht bearbeiten": "generated",
    "no editar": "generated",
    "no modificar": "generated",
    "ne pas modifier": "generated",
    "do not modify": "generated",
    "do not change this file": "generated",
    "changes will be lost": "generated",
    "changes will be overwritten": "generated",
    "vendored copy of": "vendored",
    "vendored from": "vendored",
    "copied from upstream": "vendored",
    "imported from upstream": "vendored",
    "taken from upstream": "vendored",
    "upstream: http": "vendored",
    "bundled copy of": "vendored",
    "third-party code": "vendored",
    "third party code": "vendored",
    "do not patch": "vendored",
    "project contributors": "vendored",
    "authors | mit": "vendored",
    "authors | bsd": "vendored",
    "authors | apache": "vendored",
}
#: Words that may stand before a notice within its comment.
LEAD = re.compile(r"(?:[\W_]*+(?:this|the|file|code|source|module|is|was|has|been|are|warning|note|notice|caution|important|please|"
                  r"copyright|c|v?\d++|by|all|content|contents|manual|any|your|in|here|and|will|be)\b)*+[\W_]*+")
#: Orders, which may also follow a clause, and names of holders, which may follow anything.
ORDERS, HOLDERS = ("do not", "don't", "nicht", "no ", "ne pas"), ("authors |", "project contributors")
COMMENT = re.compile(r"\s*(?://+!?|#+!?|/\*+!?|\*+/?|--+|;+|<!--|%+|\"\"\"|'''|rem\b)\s*(.*)", re.I | re.S)

#: File names of lockfiles.
LOCKFILES = ("package-lock.json", "npm-shrinkwrap.json", "yarn.lock", "pnpm-lock.yaml", "bun.lock", "bun.lockb", "cargo.lock",
             "poetry.lock", "uv.lock", "pdm.lock", "pipfile.lock", "gemfile.lock", "composer.lock", "go.sum", "go.work.sum",
             "gradle.lockfile", "buildscript-gradle.lockfile", "packages.lock.json", "requirements.locked.txt", "requirements.lock",
             "mix.lock", "flake.lock", "podfile.lock", "pubspec.lock", "package.resolved", "deno.lock", "conan.lock", "cartfile.resolved",
             "paket.lock", "shard.lock", "conda-lock.yml", ".terraform.lock.hcl")
#: Path patterns, applied to the lower-case path.
PATHS = {
    "lockfile": r"(^|/)(" + "|".join(re.escape(x) for x in LOCKFILES) + r")$",
    "vendored": r"(^|/)(node_modules|bower_components|jspm_packages|site-packages|godeps|pods|carthage)/"
                r"|(^|/)(vendor|vendors|third_party|third-party|thirdparty|external|externals|deps)/[^/]+/(.*/)?[^/]+$",
    "minified": r"[.-]min\.(js|mjs|cjs|css|html|svg|json)$|\.bundle\.(js|mjs|css)$|(^|/)(chunk|main|vendor|app|runtime|polyfills)[.-][0-9a-f]{8,20}\.(js|css)$"
                r"|\.(js|css)\.map$",
    "generated": r"_pb2(_grpc)?\.pyi?$|\.pb(\.gw)?\.(go|cc|h|swift)$|_grpc\.pb\.go$|\.pb\.(validate|gw)\.go$|(^|/)zz_generated[^/]*\.go$"
                 r"|\.(generated|gen|designer|g|g\.i|freezed)\.[a-z]+$|(_gen|_generated|\.generated)\.(go|py|ts|js|rs|java|cs|dart)$|(^|/)__snapshots__/[^/]*\.snap$|\.snap$",
}

#: Numbers and strings of data; every part takes what it can and gives nothing back, so a line is gone through once.
DATA_LINE = re.compile(
    r"""\s*+(?:[\[({]*+(?:[-+]?(?:0[xX][0-9a-fA-F]++|\d++(?:\.\d*+)?+(?:[eE][-+]?\d++)?+|\.\d++)[fFuUlL]*+(?![\w.])[,;\s\[\](){}]*+)++"""
    r"""|["'][A-Za-z0-9+/=_-]{40,}+["']\s*+[,;+\\]?|(?:\\x[0-9a-fA-F]{2}){4,}+.*|["'](?:\\x[0-9a-fA-F]{2}){4,}+.*|[A-Za-z0-9+/=]{60,}+)\s*+""")
BRACKETS = re.compile(r"[\s\[\](){},;]*")
LONG_LINE = 300
CODE_EXT = ("py", "js", "mjs", "cjs", "ts", "tsx", "jsx", "go", "rs", "c", "cc", "cpp", "h", "hpp", "java", "kt", "cs", "rb", "php", "swift", "sh", "pl",
            "lua", "r", "scala", "dart", "css", "scss", "html", "svg", "sql")

_auto = None


def automaton():
    """Built once per worker."""
    global _auto
    if _auto is None:
        import ahocorasick

        _auto = ahocorasick.Automaton()
        for text, kind in NOTICES.items():
            _auto.add_word(text, (text, kind))
        _auto.make_automaton()
    return _auto


def notice(comment: str) -> str | None:
    """Kind of the notice that a comment line is, None for a mere mention."""
    low = comment.lower()
    lead = -1
    for end, (text, kind) in automaton().iter(low):
        at = end + 1 - len(text)
        if lead < 0:
            lead = LEAD.match(low).end()
        if at <= lead and not (at and low[at - 1].isalnum() and low[at].isalnum()) or text.startswith(HOLDERS) or text.startswith(ORDERS) and _after_clause(low, at):
            return kind
    return None


def _after_clause(low: str, at: int) -> bool:
    k = at
    while k and low[k - 1].isspace():
        k -= 1
    return 0 < k < at and low[k - 1] in ".,;:!-"


#: Per row: notices of each kind, characters and lines by class.
FEATURES = ("n_generated", "n_vendored", "chars", "dense_chars", "lines", "data_lines", "dense_lines")


def features(text: str, is_patch: bool) -> tuple[int, ...]:
    gen = ven = chars = dense = lines = data = long = 0
    head = not is_patch  # whether no code was seen yet
    for line in text.split("\n"):
        if is_patch:
            if line.startswith("@@"):
                head = True
                continue
            if line.startswith("\\"):
                continue
            line = line[1:]
        body = line.strip()
        if not body:
            continue
        n = len(body)
        chars += n
        lines += 1
        if n > LONG_LINE and body.count(" ") * 12 < n:
            dense += n
            long += 1
        elif (body[0] in "0123456789[({\"'-+.\\" or n >= 60) and DATA_LINE.fullmatch(body):
            data += 1
        elif BRACKETS.fullmatch(body):
            lines -= 1
        if head:
            m = COMMENT.match(line)
            if m:
                kind = notice(m[1])
                if kind == "generated":
                    gen += 1
                elif kind == "vendored":
                    ven += 1
            else:
                head = False
    return gen, ven, chars, dense, lines, data, long


def _rows(is_patch: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [features(t, is_patch) if t else (0,) * len(FEATURES) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("row_id", "repo", "path")] + [pa.array([g[i] for g in got], pa.int64()) for i in range(len(FEATURES))],
                names=["row_id", "repo", "path", *FEATURES])
    return run


def classify(rows: DataFrame, *, row_id: str = "id", repo: str = "repository_id", path: str = "path", text: str = "patch",
             is_patch: bool = True) -> DataFrame:
    """(repo, path, kind, by): one row per file; kind is 'lockfile', 'vendored', 'generated', 'minified', 'data' or 'source'."""
    slim = rows.select(F.col(row_id).cast("string").alias("row_id"), F.col(repo).alias("repo"), F.col(path).alias("path"), F.col(text).alias("text"))
    feats = slim.filter("path is not null").mapInArrow(
        _rows(is_patch), "row_id string, repo string, path string, " + ", ".join(f"{f} bigint" for f in FEATURES))
    # repeated rows become one before anything is summed; only numbers are shuffled
    files = feats.distinct().groupBy("repo", "path").agg(*[F.sum(f).alias(f) for f in FEATURES])
    low = F.lower("path")
    by_path = [(k, low.rlike(p)) for k, p in PATHS.items()]
    # a few words about the folder in front of a single code line are no evidence; a hunk of tables is
    data = (F.col("data_lines") >= 3) & (F.col("data_lines") >= 0.7 * F.col("lines"))
    # one long string among ordinary lines is none either; minified text has few other lines, such as a licence in front
    dense = (F.col("dense_chars") >= 0.8 * F.col("chars")) & (F.col("chars") > 0) & (F.col("lines") - F.col("dense_lines") <= F.col("dense_lines") + 3)
    kind = F.lit(None).cast("string")
    by = F.lit(None).cast("string")
    rules = [*[(k, c, "path") for k, c in by_path], ("vendored", F.col("n_vendored") > 0, "notice"), ("generated", F.col("n_generated") > 0, "notice"),
             ("minified", dense & low.rlike(r"\.(" + "|".join(CODE_EXT) + r")$"), "lines"), ("data", data & low.rlike(r"\.(" + "|".join(CODE_EXT) + r")$"), "lines")]
    for k, c, b in reversed(rules):
        kind, by = F.when(c, k).otherwise(kind), F.when(c, b).otherwise(by)
    return files.select("repo", "path", F.coalesce(kind, F.lit("source")).alias("kind"), by.alias("by"))
