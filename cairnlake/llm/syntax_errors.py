"""Source files that are not valid in their stated language.

Files are put together from their chunks and parsed with packrat parsing-expression grammars, one per
language, that must consume the whole input. A file that is not consumed is reported with the line of the
furthest failure and a cause: merge conflict, truncated, not text, other language, or plain syntax. For
Python, JSON and TOML the parser of the standard library has the last word on files the grammar rejects.

Plan. Chunks are grouped by (repository, blob, chunker version), equal copies merged before the shuffle; each
file is parsed where it lands. Statement shapes seen before are not parsed again.

Defined results
- languages without a grammar are no files here. Null language: left out.
- null content is empty; null start_line is 1. Lines in no chunk are blank; CRLF counts as LF. Of many blank lines between chunks
  only a few are parsed, so a start_line of any size costs nothing.
- repeated rows count once. Chunks that overlap: the later start wins where it is not blank, of equal starts the longer.
- an empty file is valid but in JSON. Extra columns are ignored. Nesting: JSON is checked at any depth; in the other languages a file
  nested beyond FRAMES calls (some 40,000 brackets) is neither valid nor invalid: valid is null, cause 'too deep', and rates() counts it apart.
"""

from __future__ import annotations

import bisect
import math
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

LANGUAGES = ("python", "javascript", "go", "shell", "json", "yaml", "toml")
MARKER = re.compile(r"^(?:<{7}(?: |$)|>{7}(?: |$)|={7}$|\|{7}(?: |$))", re.M)
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f�]")


#: So many blank lines between chunks stand for any number of them.
BLANKS = 3


def assemble(chunks: list[tuple[int, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a file from (start_line, content), in order of start_line, and (line of the text, line of the file) where the count jumps."""
    out: list[str] = []
    jumps = [(1, 1)]
    at = line = 1  # number of the line that is being written: in the file, in the text
    ended = True
    for start, content in chunks:
        content = content.replace("\r\n", "\n")
        if start < at or start == at and not ended:
            return _overlay(chunks)
        # after a chunk without a last newline the first of the blanks ends its line
        gap = min(start - at, BLANKS + (not ended))
        line += gap
        if gap < start - at:
            jumps.append((line, start))
        out.append("\n" * gap + content)
        n = content.count("\n")
        at, line = start + n, line + n
        ended = not content or content.endswith("\n")
    return "".join(out), jumps


def _overlay(chunks: list[tuple[int, str]]) -> tuple[str, list[tuple[int, int]]]:
    lines: dict[int, str] = {}
    for start, content in chunks:
        for k, x in enumerate(content.replace("\r\n", "\n").split("\n"), start):
            if x or k not in lines:
                lines[k] = x
    out: list[str] = []
    jumps, at = [(1, 1)], 1
    for k in sorted(lines):
        gap = min(k - at, BLANKS)
        out.extend([""] * gap)
        if gap < k - at:
            jumps.append((len(out) + 1, k))
        out.append(lines[k])
        at = k + 1
    return "\n".join(out), jumps


def line_of(line: int | None, jumps: list[tuple[int, int]]) -> int | None:
    """Line of the file of a line of its text."""
    if line is None:
        return None
    a, b = jumps[bisect.bisect_right(jumps, (line, math.inf)) - 1]
    return line - a + b


def _accepted(language: str, text: str) -> bool:
    """Whether the standard library parses it; False where it has no parser."""
    try:
        if language == "python":
            import ast
            import warnings

            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif language == "json":
            import json

            def no(word: str) -> None:
                raise ValueError(word)

            json.loads(text, parse_constant=no)
        elif language == "toml":
            import tomllib

            tomllib.loads(text)
        else:
            return False
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


_JSON = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*+(")|(?:-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null)(?![\w.+-]))')


def deep_json(text: str) -> int | None:
    """Offset at which JSON of any depth fails, None if it is valid."""
    stack: list[str] = []
    want, at = "value", 0  # value, first (value or end), key, first key (key or end), colon, next (comma or end)
    while want != "next" or stack:
        m = _JSON.match(text, at)
        if not m:
            return at
        sign = m[1]
        if want in ("value", "first") and sign in (None, "{", "["):
            if sign:
                stack.append(sign)
            want = {None: "next", "{": "first key", "[": "first"}[sign]
        elif want in ("key", "first key") and m[2]:
            want = "colon"
        elif want == "colon" and sign == ":":
            want = "value"
        elif want == "next" and sign == ",":
            want = "key" if stack[-1] == "{" else "value"
        elif sign and stack and (sign == "]" and stack[-1] == "[" and want in ("first", "next") or sign == "}" and stack[-1] == "{" and want in ("first key", "next")):
            stack.pop()
            want = "next"
        else:
            return at
        at = m.end()
    return None if not text[at:].strip(" \t\r\n") else at


#: Depth of calls up to which files are parsed; calls between Python functions take memory, about 450 bytes each, but no stack.
FRAMES = 400_000
_checks: dict = {}


def checker(language: str):
    if not _checks:
        from cairnlake.llm.grammar_code import check_go, check_javascript, check_shell
        from cairnlake.llm.grammar_data import check_json, check_toml, check_yaml
        from cairnlake.llm.grammar_python import check as check_python

        sys.setrecursionlimit(max(sys.getrecursionlimit(), FRAMES))
        _checks.update(python=check_python, javascript=check_javascript, go=check_go, shell=check_shell, json=check_json, yaml=check_yaml, toml=check_toml)
    return _checks[language]


def cause(text: str, at: int) -> str:
    marks = MARKER.findall(text)
    if any(m.startswith("<") for m in marks) and any(m.startswith(">") for m in marks):
        return "merge conflict"
    if len(CONTROL.findall(text)) > 0.01 * len(text):
        return "not text"
    if not text[at:].strip():
        return "truncated"
    if not text[:at].strip() or text.count("\n", 0, at) < 2 and len(text[:at].split()) <= 3:
        return "other language"
    return "syntax"


def diagnose(language: str, text: str) -> tuple[bool | None, int | None, str | None]:
    """(valid, line of the furthest failure, cause); valid is None where that could not be found out."""
    try:
        at = checker(language)(text)
    except (RecursionError, MemoryError):
        if language != "json":
            return None, None, "too deep"
        at = deep_json(text)
    if at is None or _accepted(language, text):
        return True, None, None
    at = min(at, len(text))
    return False, text.count("\n", 0, at) + 1, cause(text, at)


SCHEMA = "repository_id string, blob_sha string, chunker_version string, language string, path string, valid boolean, error_line int, cause string"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        valid, lines, causes = [], [], []
        for language, chunks in zip(b.column("language").to_pylist(), b.column("chunks").to_pylist()):
            parts = sorted(((c["start"], c["content"]) for c in chunks), key=lambda c: (c[0], len(c[1]), c[1]))
            text, jumps = assemble(parts)
            ok, line, why = diagnose(language, text)
            valid.append(ok)
            lines.append(line_of(line, jumps))
            causes.append(why)
        yield pa.RecordBatch.from_arrays([*(b.column(n) for n in _NAMES[:5]), pa.array(valid, pa.bool_()), pa.array(lines, pa.int32()), pa.array(causes, pa.string())], names=_NAMES)


def parse_files(chunks: DataFrame) -> DataFrame:
    """One row per file (SCHEMA) of chunk rows with repository_id, blob_sha, chunker_version, language, path, start_line, content."""
    rows = chunks.filter(F.col("language").isin(*LANGUAGES)).select(
        "repository_id", "blob_sha", "chunker_version", "language", "path",
        F.struct(F.coalesce(F.greatest("start_line", F.lit(1)), F.lit(1)).alias("start"), F.coalesce("content", F.lit("")).alias("content")).alias("chunk"))
    files = rows.groupBy("repository_id", "blob_sha", "chunker_version", "language").agg(F.min("path").alias("path"), F.collect_set("chunk").alias("chunks"))
    return files.mapInArrow(_parse, SCHEMA)


def rates(files: DataFrame) -> DataFrame:
    """Files and failures per repository and language, by cause; the rate is that of the files whose validity is known."""
    causes = ("merge conflict", "truncated", "not text", "other language", "syntax")
    return files.groupBy("repository_id", "language").agg(
        F.count("*").alias("files"), F.count_if(~F.col("valid")).alias("invalid"), F.round(F.avg(F.when(F.col("valid"), 0.0).when(~F.col("valid"), 1.0)), 6).alias("rate"),
        *[F.count_if(~F.col("valid") & (F.col("cause") == c)).alias(c.replace(" ", "_")) for c in causes], F.count_if(F.col("cause") == "too deep").alias("too_deep"))
