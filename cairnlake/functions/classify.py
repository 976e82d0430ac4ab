"""Classification of paths and files as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from cairnlake.functions import fixed_values as V
from cairnlake.functions.text import base_name, suffix


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def language(path: Column) -> Column:
    """By file name, else by suffix, else null."""
    return F.coalesce(_lookup(base_name(path), V.LANGUAGE_NAMES), _lookup(suffix(path), V.LANGUAGES))


def is_test(path: Column) -> Column:
    return path.rlike(V.TEST_PATH)


def is_generated(path: Column) -> Column:
    return path.rlike(V.GENERATED_PATH)


def is_lockfile(path: Column) -> Column:
    return base_name(path).isin(V.LOCKFILES)


def is_binary(path: Column) -> Column:
    return suffix(path).isin(V.BINARY_SUFFIXES)


def has_marker(text: Column) -> Column:
    head = F.substring(text, 1, 600)
    out = F.lit(False)
    for m in V.GENERATED_MARKERS:
        out = out | head.contains(m)
    return out


def ignore_regex(pattern: str) -> str | None:
    """Regular expression of one ignore pattern over a whole path, without its leading !; None for comments and blanks."""
    p = pattern.rstrip()
    if not p or p.startswith("#"):
        return None
    p = p.removeprefix("!").removeprefix("\\")
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.lstrip("/")
    out, i = "", 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and "]" in p[i + 2:]:
            j = p.index("]", i + 2)
            out, i = out + "[" + p[i + 1:j].replace("!", "^", 1) + "]", j + 1
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$")


def is_ignored(path: Column, patterns: list[str] | None = None) -> Column:
    """The last of the ignore patterns that matches decides; one that begins with ! takes a path back in."""
    verdict = F.lit(False)
    for p in V.IGNORE_PATTERNS if patterns is None else patterns:
        rx = ignore_regex(p)
        if rx:
            verdict = F.when(path.rlike(rx), F.lit(not p.startswith("!"))).otherwise(verdict)
    return verdict | is_generated(path)


def admission(path: Column, size: Column, text: Column, patterns: list[str] | None = None, most: int = 512 * 1024) -> Column:
    """Why a file is not indexed; null if it is."""
    return (F.when(is_ignored(path, patterns), "ignored").when(is_binary(path) | is_lockfile(path) | language(path).isNull(), "unsupported_type")
            .when(size > most, "too_large").when(F.substring(text, 1, 8192).contains("\u0000"), "binary").when(has_marker(text), "generated"))


def skip_reason(path: Column, status: Column, patch: Column, changed: Column, most_changed: int = 400) -> Column:
    """Why a changed file is not looked at; null if it is."""
    return (F.when(is_binary(path), "binary").when(is_lockfile(path), "lockfile").when(is_generated(path), "generated")
            .when(patch.isNull() & (status == "renamed"), "rename_only").when(patch.isNull() | (patch == ""), "no_patch")
            .when(changed > most_changed, "patch_too_large"))


def priority(lang: Column, test: Column, path: Column, status: Column, changed: Column) -> Column:
    """Order in which changed files are looked at."""
    kind = (F.when((lang == "python") & ~test, 100.0).when(lang.isin("javascript", "typescript", "go", "java", "ruby", "rust", "sql") & ~test, 80.0)
            .when(test, 40.0).when(lang.isin("yaml", "toml", "json", "ini", "shell"), 30.0).otherwise(10.0))
    return (kind + F.when(path.rlike(V.SENSITIVE_PATH), 25.0).otherwise(0.0) + F.when(status == "added", 5.0).otherwise(0.0) + F.least(changed, F.lit(200)) / 20)
