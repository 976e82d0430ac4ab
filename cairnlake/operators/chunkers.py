"""Table functions from file texts to semantic chunks.

python_chunks() follows the syntax tree: module sections, class headers with an index of their methods, functions and
methods, long ones cut at statements. Files that do not parse are scanned for top-level definitions by indentation, and
cut into windows if there are none. sections() is set-based: headings of Markdown, top-level keys of YAML, tables of TOML and INI,
and windows of lines for all else.
Null or blank sources give no chunks.
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby, zip_longest
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from cairnlake.functions import fixed_values as V, text as T

CHUNK = ("path string, symbol_type string, symbol string, qualified_name string, parent_symbol string, start_line int, end_line int, signature string, imports array<string>, called_names array<string>, "
         "bases array<string>, is_test boolean, docstring string, content string")
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)
_TEST = re.compile(V.TEST_PATH)
_SCAN = re.compile(r"(?:async\s+def|def|class)\s+([A-Za-z_]\w*)")


@dataclass
class Chunk:
    symbol_type: str
    start_line: int
    end_line: int
    content: str
    symbol: str | None = None
    qualified_name: str | None = None
    parent_symbol: str | None = None
    signature: str | None = None
    imports: list[str] = field(default_factory=list)
    called_names: list[str] = field(default_factory=list)
    bases: list[str] = field(default_factory=list)
    is_test: bool = False
    docstring: str | None = None


def tokens(s: str) -> int:
    return max(1, len(s) // 4) if s else 0


def dotted(node: ast.expr) -> str | None:
    """a.b.c of a chain of attributes on a name."""
    names: list[str] = []
    while isinstance(node, ast.Attribute):
        names.insert(0, node.attr)
        node = node.value
    return ".".join([node.id, *names]) if isinstance(node, ast.Name) else None


def calls(node: ast.AST) -> list[str]:
    """Names that are called, in full and by their last part."""
    full = {d for n in ast.walk(node) if isinstance(n, ast.Call) and (d := dotted(n.func))}
    return sorted(full | {d.rpartition(".")[2] for d in full})


def module_of(path: str) -> tuple[str, bool]:
    """Dotted module of a path, and whether it is a package."""
    stem = path.rsplit(".", 1)[0] if "." in path.rsplit("/", 1)[-1] else path
    parts = stem.split("/")
    package = parts[-1] == "__init__"
    return ".".join(parts[:-1] if package else parts), package


def imported(tree: ast.Module, module: str, package: bool) -> list[str]:
    """Dotted names that a module's top level imports, relative ones resolved."""
    out: list[str] = []
    for n in tree.body:
        if isinstance(n, ast.Import):
            out.extend(a.name for a in n.names)
        elif isinstance(n, ast.ImportFrom):
            home = module.split(".") if n.level else []
            up = n.level - (1 if package else 0)
            home = home[:max(0, len(home) - up)] if up > 0 else home
            base = ".".join([*home, *([n.module] if n.module else [])])
            out.extend(f"{base}.{a.name}" if base else a.name for a in n.names)
    return out


def first_line(node: ast.stmt) -> int:
    return min([node.lineno, *(d.lineno for d in getattr(node, "decorator_list", ()))])


class Span(NamedTuple):
    """Lines start..end of a file that become one chunk: of statements between definitions (node None), of a class's head, or of a function."""

    kind: str
    start: int
    end: int
    node: ast.AST | None = None
    owner: str | None = None


def spans(tree: ast.Module) -> Iterator[Span]:
    """Where the chunks of a module lie, in order, whatever their size."""
    for named, run in groupby(tree.body, lambda n: isinstance(n, (*_DEF, ast.ClassDef))):
        nodes = list(run)
        if not named:
            yield Span("module", nodes[0].lineno, nodes[-1].end_lineno)
            continue
        for node in nodes:
            inner = [m for m in node.body if isinstance(m, _DEF)] if isinstance(node, ast.ClassDef) else []
            if isinstance(node, ast.ClassDef):
                yield Span("class", first_line(node), max(node.lineno, first_line(inner[0]) - 1) if inner else node.end_lineno, node)
                yield from (Span("method", first_line(m), m.end_lineno, m, node.name) for m in inner)
            else:
                yield Span("function", first_line(node), node.end_lineno, node)


def fitted(every: Iterable[Span], lines: list[str]) -> Iterator[Span]:
    """Spans of a size to be searched: the first section is cut to a header, empty ones go, and long functions are cut before the
    statement that would make a piece too long."""
    size = lambda a, b: tokens("\n".join(lines[a - 1:b]))
    header = True
    for s in every:
        if s.kind == "module":
            end = min(s.end, s.start + V.MODULE_HEADER_LINES - 1) if header else s.end
            if any(x.strip() for x in lines[s.start - 1:end]):
                yield s._replace(end=end)
                header = False
        elif s.kind == "class" or size(s.start, s.end) <= V.MAX_CHUNK_TOKENS:
            yield s
        else:
            stops = [x.end_lineno for x in s.node.body]
            start = s.start
            for here, after in zip_longest(stops, stops[1:]):
                if after is None or size(start, after) > V.MAX_CHUNK_TOKENS:
                    yield s._replace(start=start, end=here)
                    start = here + 1


def heading(node: ast.AST, lines: list[str]) -> str:
    """The lines up to a definition's body on one line, with decorators."""
    return " ".join(x.strip() for x in lines[first_line(node) - 1:max(node.lineno, node.body[0].lineno - 1)])[:V.SIGNATURE_CHARS]


def described(s: Span, lines: list[str], tree: ast.Module, module: str, imports: list[str], in_tests: bool, first: bool) -> Chunk:
    """The chunk of a span; `first` says whether it is the module's header."""
    made = Chunk(s.kind, s.start, s.end, "\n".join(lines[s.start - 1:s.end]), imports=imports if s.node is not None or first else [], is_test=in_tests)
    if s.node is None:
        made.symbol, made.qualified_name = "<module>", f"<module:{module}>"
        made.docstring = ast.get_docstring(tree) if first else None
        return made
    made.symbol, made.parent_symbol = s.node.name, s.owner
    made.qualified_name = ".".join(filter(None, (s.owner, s.node.name)))
    made.docstring, made.signature = ast.get_docstring(s.node), heading(s.node, lines)
    methods = [m for m in s.node.body if isinstance(m, _DEF)] if s.kind == "class" else []
    made.called_names = [] if methods else calls(s.node)
    made.is_test = in_tests or s.node.name.startswith("Test" if s.kind == "class" else "test_")
    if s.kind == "class":
        made.bases = [ast.unparse(b) for b in s.node.bases]
    if methods:
        made.signature = V.METHOD_INDEX.format(made.signature, "; ".join(heading(m, lines) for m in methods))[:V.CLASS_SIGNATURE_CHARS]
    return made


def python_file(path: str, source: str) -> list[Chunk]:
    lines, in_tests = source.splitlines(), bool(_TEST.search(path))
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return scanned(lines, in_tests) or windows(lines, in_tests)
    module, package = module_of(path)
    imports = imported(tree, module, package)
    kept = list(fitted(spans(tree), lines))
    head = next((k for k, s in enumerate(kept) if s.kind == "module"), None)
    return [described(s, lines, tree, module, imports, in_tests, k == head) for k, s in enumerate(kept)]


def scanned(lines: list[str], in_tests: bool) -> list[Chunk]:
    """Top-level definitions found by indentation, for files that do not parse."""
    out, i = [], 0
    while i < len(lines):
        m = _SCAN.match(lines[i])
        if not m:
            i += 1
            continue
        a = i
        while a and lines[a - 1].startswith("@"):
            a -= 1
        j = i + 1
        while j < len(lines) and (not lines[j].strip() or lines[j][0] in " \t)"):
            j += 1
        while not lines[j - 1].strip():
            j -= 1
        out.append(Chunk("class" if lines[i].startswith("class") else "function", a + 1, j, "\n".join(lines[a:j]), m[1], m[1], is_test=in_tests or m[1].startswith("test_")))
        i = j
    return out


def windows(lines: list[str], in_tests: bool) -> list[Chunk]:
    step = V.PYTHON_WINDOW
    return [Chunk("fallback", i + 1, min(i + step, len(lines)), "\n".join(lines[i:i + step]), is_test=in_tests) for i in range(0, len(lines), step) if "".join(lines[i:i + step]).strip()]


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in CHUNK.split(", "))])
    for b in batches:
        rows = []
        for path, source in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if path is not None and source:
                rows += [{"path": path, **vars(c)} for c in python_file(path, source)]
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def python_chunks(files: DataFrame, *, path: str = "path", source: str = "source") -> DataFrame:
    """Chunks (CHUNK) of Python files."""
    return files.select(F.col(path).alias("path"), F.col(source).alias("source")).mapInArrow(_run, CHUNK)


def boundaries(language: Column, line: Column) -> Column:
    """Title of the section that a line begins, null if it begins none."""
    heading = F.regexp_extract(line, r"^#{1,4}\s+(.*\S)\s*$", 1)
    table = F.trim(F.regexp_extract(line, r"^\[\[?([^\]]+)\]\]?", 1))
    key = F.regexp_extract(line, r"^([A-Za-z_][\w.-]*)\s*[:=]", 1)
    found = (F.when(language == "markdown", heading).when(language.isin("toml", "ini"), table).when(language == "yaml", F.when(table != "", table).otherwise(key)))
    return F.when(found != "", found)


def sections(files: DataFrame, *, key: str = "path", language: str = "language", source: str = "source") -> DataFrame:
    """(key, start_line, end_line, symbol, symbol_type, content): sections by heading or key, long ones in windows of lines.

    The lines of a file are turned around within its own row by array functions, so no file's lines are shuffled.
    """
    f = files.select(F.col(key).alias("key"), F.col(language).alias("language"), T.split_lines(F.col(source)).alias("lines")).filter(F.col("lines").isNotNull() & (F.size("lines") > 0))
    titles = F.transform("lines", lambda x, i: F.struct((i + 1).alias("at"), boundaries(F.col("language"), x).alias("title")))
    starts = F.filter(titles, lambda s: s["title"].isNotNull())
    f = f.withColumn("starts", starts)
    preamble = F.array(F.struct(F.lit(1).alias("at"), F.lit("<preamble>").alias("title")))
    f = f.withColumn("starts", F.when((F.size("starts") == 0) | (F.element_at("starts", 1)["at"] > 1), F.concat(preamble, F.col("starts"))).otherwise(F.col("starts")))
    # each section takes its own lines along before they are exploded
    ends = F.transform("starts", lambda s, i: F.struct(s["at"].alias("at"), s["title"].alias("title"),
                                                       F.slice("lines", s["at"], F.coalesce(F.get("starts", i + 1)["at"] - 1, F.size("lines")) - s["at"] + 1).alias("block")))
    s = f.select("key", "language", F.explode(ends).alias("s")).select("key", "language", "s.at", "s.title", "s.block")
    # blank lines at the end belong to no section
    used = F.aggregate(F.transform("block", lambda x, i: F.when(F.trim(F.regexp_replace(x, r"\s+", " ")) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    s = s.withColumn("n", used).filter("n > 0")
    step = V.SECTION_WINDOW
    w = s.select("key", "language", "at", "title", "block", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step).cast("int"))).alias("k"))
    kind = (F.when(F.col("language") == "markdown", "doc").when(F.col("language").isin("yaml", "toml", "ini", "json", "dockerfile", "make", "sql"), "config").otherwise("fallback"))
    length = F.least(F.lit(step), F.col("n") - F.col("k") * step)
    return w.select("key", (F.col("at") + F.col("k") * step).alias("start_line"), (F.col("at") + F.col("k") * step + length - 1).alias("end_line"), F.col("title").alias("symbol"), kind.alias("symbol_type"),
                    F.array_join(F.slice("block", F.col("k") * step + 1, length), "\n").alias("content"))
