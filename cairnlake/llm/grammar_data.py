"""Lexers and grammars for JSON, TOML and YAML."""

from __future__ import annotations

import re

from cairnlake.llm.peg import LONG_TOKEN, Lexicon, Parser

# JSON, strict ----------------------------------------------------------------------------------------

JSON_LEX = Lexicon()
JSON_TOKEN = re.compile(r"[ \t\r\n]+|\"(?:[^\"\\\x00-\x1f]|\\(?:[\"\\/bfnrt]|u[0-9a-fA-F]{4}))*\"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|true|false|null|[{}\[\],:]|[\s\S]")
JSON = Parser("""
file <- value EOF
value <~ STR / NUM / WORD / object / array
object <- '{' (pair (',' pair)*)? '}'
pair <~ STR ':' value
array <- '[' (value (',' value)*)? ']'
""", JSON_LEX)


class _JsonKinds(dict):
    def __missing__(self, tok: str) -> str:
        if len(self) > 500_000:
            self.clear()
        c = tok[0]
        k = ("" if c in " \t\r\n" else JSON_LEX["STR"] if c == '"' and len(tok) > 1 else JSON_LEX["WORD"] if tok in ("true", "false", "null")
             else JSON_LEX["NUM"] if c in "-0123456789" and tok != "-" else JSON_LEX[c] if c in "{}[],:" else JSON_LEX["BAD"])
        if len(tok) <= LONG_TOKEN:
            self[tok] = k
        return k


JSON_KINDS = _JsonKinds()


def offset(tokens: list[str], kinds: list[str], far: int) -> int:
    """Offset of the far-th visible token; the end of the text if there are fewer."""
    at = 0
    for t, k in zip(tokens, kinds):
        far -= len(k)
        if far < 0:
            return at
        at += len(t)
    return at


def check_json(text: str) -> int | None:
    tokens = JSON_TOKEN.findall(text)
    kinds = list(map(JSON_KINDS.__getitem__, tokens))
    end, far = JSON.parse("".join(kinds), "file")
    return None if end >= 0 else offset(tokens, kinds, far)


# TOML ------------------------------------------------------------------------------------------------

TOML_LEX = Lexicon()
_ESC = r"\\(?:[btnfr\"\\]|u(?![dD][89a-fA-F])[0-9a-fA-F]{4}|U00(?:10|0(?!0[dD][89a-fA-F])[0-9a-fA-F])[0-9a-fA-F]{4})"
_INTS = r"0x[0-9a-fA-F](?:_?[0-9a-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*"
_CTRL = r"\x00-\x08\x0b\x0c\x0e-\x1f\x7f"
_DATE, _TIME = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])", r"(?:[01]\d|2[0-3]):[0-5]\d:(?:[0-5]\d|60)(?:\.\d+)?"
TOML_TOKEN = re.compile(
    r"(?:[ \t]*(?:#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*)?\r?\n)+[ \t]*|[ \t]+|#[^\n\x00-\x08\x0b\x0c\x0e-\x1f\x7f]*"
    r"|\"\"\"(?:[^\"\\" + _CTRL + "]|" + _ESC + r"|\\[ \t]*\r?\n|\"(?!\"\")|\"\"(?!\"))*\"{3,5}|'''(?:[^'" + _CTRL + r"]|'(?!'')|''(?!'))*'{3,5}"
    r"|\"(?:[^\"\\\n\x00-\x08\x0b-\x1f\x7f]|" + _ESC + r")*\"|'[^'\n" + _CTRL + "]*'"
    r"|" + _DATE + r"(?:[Tt ]" + _TIME + r"(?:[Zz]|[+-](?:[01]\d|2[0-3]):[0-5]\d)?)?(?![\w:.-])|" + _TIME + r"(?![\w:.-])"
    r"|(?:" + _INTS + r")(?![\w.+-])|[+-]?(?:(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|inf|nan)(?![\w.+-])"
    r"|[A-Za-z0-9_-]+|[\[\]{},.=]|[\s\S]")
TOML = Parser("""
file <- NL? (item NL)* item? EOF
item << pair / '[' '[' key ']' ']' / '[' key ']'
key <~ name ('.' name)*
name <~ BARE / INT / STR / WORD / DATE / FLOAT
pair <- key '=' value
value <- STR / MSTR / INT / FLOAT / WORD / DATE / SIGNED / array / table
array <- '[' NL? (value NL? (',' NL? value NL?)* (',' NL?)?)? ']'
table <- '{' (pair (',' pair)*)? '}'
""", TOML_LEX)


class _TomlKinds(dict):
    def __missing__(self, tok: str) -> str:
        if len(self) > 500_000:
            self.clear()
        c, L = tok[0], TOML_LEX
        if tok[:3] in ('"""', "'''") and len(tok) > 5:
            k = L["MSTR"]
        elif c in "\"'":
            k = L["STR"] if len(tok) > 1 else L["BAD"]
        elif "\n" in tok:
            k = "\n"
        elif c in " \t#":
            k = ""
        elif c in "[]{},.=":
            k = L[c]
        elif tok in ("true", "false", "inf", "nan"):
            k = L["WORD"]
        elif re.fullmatch(_DATE, tok):
            k = L["DATE"]
        elif re.fullmatch(_DATE + r"[Tt ].+|" + _TIME, tok):
            k = L["SIGNED"]  # values that are no keys
        elif re.fullmatch(r"(?:0|[1-9](?:_?\d)*)|-(?:0|[1-9]\d*)|" + _INTS + r"|\d+[eE]\d+|-\d+[eE]\d+|-inf|-nan", tok):
            k = L["INT"]
        elif re.fullmatch(r"(?:0|[1-9]\d*)\.\d+", tok):
            k = L["FLOAT"]  # as a key two names and a dot
        elif c in "+-0123456789" and re.fullmatch(r"[+-]?(?:(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|inf|nan)", tok):
            k = L["SIGNED"]
        elif re.fullmatch(r"[A-Za-z0-9_-]+", tok):
            k = L["BARE"]
        else:
            k = L["BAD"]
        if len(tok) <= LONG_TOKEN:
            self[tok] = k
        return k


TOML_KINDS = _TomlKinds()


def check_toml(text: str) -> int | None:
    tokens = TOML_TOKEN.findall(text)
    kinds = list(map(TOML_KINDS.__getitem__, tokens))
    end, far = TOML.parse("".join(kinds), "file")
    return offset(tokens, kinds, far) if end < 0 else repeated_key(tokens, kinds)


class _Twice(Exception):
    """A key or table is defined a second time; its argument is the offset."""


class _Table:
    """What a name stands for: 'open' (only named as a parent), 'table' (has its header), 'dotted', 'list' of tables, 'closed' (a value)."""

    def __init__(self, kind: str):
        self.kind, self.names, self.last = kind, {}, None


def _names(tok: str) -> list[str]:
    if tok[0] == '"':
        return [re.sub(r"\\u([0-9a-fA-F]{4})|\\U([0-9a-fA-F]{8})", lambda m: chr(int(m[1] or m[2], 16)), tok[1:-1])]
    return [tok[1:-1]] if tok[0] == "'" else tok.split(".")


class _Definitions:
    """The format forbids to define a key or table twice. Walks the tokens of a file that parsed."""

    def __init__(self, tokens: list[str], kinds: list[str]):
        self.toks, at = [], 0
        for t, k in zip(tokens, kinds):
            if k:
                self.toks.append(("\n" if k == "\n" else t, at))
            at += len(t)
        self.i = 0

    def skip(self) -> None:
        while self.i < len(self.toks) and self.toks[self.i][0] == "\n":
            self.i += 1

    def key(self) -> list[str]:
        out = _names(self.toks[self.i][0])
        self.i += 1
        while self.toks[self.i][0] == ".":
            out += _names(self.toks[self.i + 1][0])
            self.i += 2
        return out

    def value(self) -> None:
        t = self.toks[self.i][0]
        self.i += 1
        if t == "[":
            self.skip()
            while self.toks[self.i][0] != "]":
                if self.toks[self.i][0] == ",":
                    self.i += 1
                else:
                    self.value()
                self.skip()
            self.i += 1
        elif t == "{":
            inner = _Table("table")
            while self.toks[self.i][0] != "}":
                if self.toks[self.i][0] == ",":
                    self.i += 1
                else:
                    self.pair(inner)
            self.i += 1

    def pair(self, table: _Table) -> None:
        at = self.toks[self.i][1]
        *path, name = self.key()
        for p in path:
            nxt = table.names.setdefault(p, _Table("dotted"))
            if nxt.kind not in ("dotted", "open"):
                raise _Twice(at)
            nxt.kind = "dotted"
            table = nxt
        if name in table.names:
            raise _Twice(at)
        table.names[name] = _Table("closed")
        self.i += 1  # the equals sign
        self.value()

    def header(self, root: _Table) -> _Table:
        at = self.toks[self.i][1]
        many = self.toks[self.i + 1][0] == "["
        self.i += 1 + many
        *path, name = self.key()
        self.i += 1 + many
        table = root
        for p in path:
            table = table.names.setdefault(p, _Table("open"))
            if table.kind == "closed":
                raise _Twice(at)
            table = table.last if table.kind == "list" else table
        had = table.names.get(name)
        if many:
            if had is None:
                had = table.names[name] = _Table("list")
            elif had.kind != "list":
                raise _Twice(at)
            had.last = _Table("table")
            return had.last
        if had is None:
            had = table.names[name] = _Table("table")
        elif had.kind != "open":
            raise _Twice(at)
        had.kind = "table"
        return had

    def run(self) -> int | None:
        root = table = _Table("table")
        try:
            self.skip()
            while self.i < len(self.toks):
                if self.toks[self.i][0] == "[":
                    table = self.header(root)
                else:
                    self.pair(table)
                self.skip()
        except _Twice as e:
            return e.args[0]
        return None


def repeated_key(tokens: list[str], kinds: list[str]) -> int | None:
    """Offset of the first second definition."""
    return _Definitions(tokens, kinds).run()


# YAML ------------------------------------------------------------------------------------------------

YAML_LEX = Lexicon()
YAML = Parser("""
file <- (mark / doc)* EOF
mark <~ DOC NL?
doc <- block &(DOC / EOF)
block <- (props NL)? (map / seq / plain)
plain <~ props? (scalar NL / BLOCKSCALAR NL)
map <- entry+
entry <- key val / flow FKEY val / QKEY item (QVAL item)?
key <~ props? KEY
val <- props? (scalar NL / BLOCKSCALAR NL / NL (INDENT block DEDENT / &DASH seq)?)
seq <- (DASH item)+
item <- props? (scalar NL / BLOCKSCALAR NL / INDENT (map / seq) DEDENT / NL (INDENT block DEDENT)?)
scalar <~ SCALAR / QUOTED / ALIAS / flow
props <- PROP+
flow <- '{' fnl (fpair fnl (',' fnl fpair fnl)* (',' fnl)?)? '}' / '[' fnl (fitem fnl (',' fnl fitem fnl)* (',' fnl)?)? ']'
fnl <~ FNL*
fpair <- fkey fnl (':' fnl fitem?)?
fkey <~ props? (SCALAR / QUOTED / ALIAS / flow)
fitem <- fkey fnl (':' fnl fitem?)? / PROP
""", YAML_LEX)

_Y_DQ = re.compile(r'"(?:[^"\\]|\\(?:[0abtnvfre "/\\N_LP\t\n]|\r\n|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*"')
_Y_SQ = re.compile(r"'(?:[^']|'')*'")
_Y_PROP = re.compile(r"[&!][^\s,\[\]{}]*")
_Y_ALIAS = re.compile(r"\*[^\s,\[\]{}:]+")
_Y_HEAD = re.compile(r"[|>](?:[+-]?[1-9]?|[1-9][+-])[ \t]*(?:#.*)?$")
_Y_FLOW_PLAIN = re.compile(r"[^\s,\[\]{}#\"'&*!|>%@`:?-](?:[^,\[\]{}\n:#]|:(?![\s,\[\]{}])|(?<!\s)#)*|[-?:](?=[^\s,\[\]{}])(?:[^,\[\]{}\n:#]|:(?![\s,\[\]{}])|(?<!\s)#)*")
_Y_PLAIN_KEY = re.compile(r"(?:[^\s\-?:,\[\]{}#&*!|>'\"%@`]|[-?:](?=\S))(?:[^\s:#]|:(?=\S)|(?<=\S)#|[^\S\n]++(?!:(?:[ \t\n]|$)))*?(?=[ \t]*:(?:[ \t\n]|$))")


class _YamlLexer:
    """Lines -> kinds; INDENT and DEDENT from columns, continuation lines of scalars taken in."""

    def __init__(self, text: str):
        self.text = text
        self.lines = text.split("\n")
        self.starts = [0]
        for x in self.lines:
            self.starts.append(self.starts[-1] + len(x) + 1)
        self.out: list[str] = []
        self.at: list[int] = []
        self.stack = [0]

    def put(self, kind: str, at: int) -> None:
        self.out.append("\n" if kind == "NL" else YAML_LEX[kind])
        self.at.append(at)

    def run(self) -> tuple[str, list[int]]:
        i, n, open_doc = 0, len(self.lines), False
        while i < n:
            line = self.lines[i].rstrip("\r")
            body = line.lstrip(" ")
            col = len(line) - len(body)
            if not body.strip() or body[0] == "#" or body[0] == "\t" and (not body.strip() or body.strip()[0] == "#"):
                i += 1
                continue
            if re.match(r"(?:---|\.\.\.)(?:\s|$)", line):
                self.close(0, self.starts[i])
                self.put("DOC", self.starts[i])
                rest = line[3:].strip()
                open_doc = True
                if rest and rest[0] != "#":
                    i = self.content(i, len(line) - len(line[3:].lstrip()), -1, False)
                else:
                    i += 1
                continue
            if line[0] == "%" and not self.out:
                i += 1
                continue
            if body[0] == "\t":
                self.put("BAD", self.starts[i] + col)
                i += 1
                continue
            self.level(col, self.starts[i])
            i = self.content(i, col, col, True)
        self.close(0, self.starts[-1])
        return "".join(self.out), self.at

    def level(self, col: int, at: int) -> None:
        if col > self.stack[-1]:
            self.stack.append(col)
            self.put("INDENT", at)
            return
        self.close(col, at)
        if col != self.stack[-1]:
            self.put("BAD", at)

    def close(self, col: int, at: int) -> None:
        while self.stack[-1] > col:
            self.stack.pop()
            self.put("DEDENT", at)

    def content(self, i: int, col: int, indent: int, keys: bool) -> int:
        """Tokens from column col of line i on; the number of the next line."""
        line = self.lines[i].rstrip("\r")
        base = self.starts[i]
        while True:
            rest = line[col:]
            if not rest.strip() or rest.lstrip()[0] == "#" and (col == 0 or line[col - 1] in " \t" or rest[0] in " \t"):
                self.put("NL", base + col)
                return i + 1
            skip = len(rest) - len(rest.lstrip(" \t"))
            col += skip
            rest = line[col:]
            c = rest[0]
            if keys and c in "-?:" and rest[1:2] in ("", " ", "\t"):
                self.put({"-": "DASH", "?": "QKEY", ":": "QVAL"}[c], base + col)
                after = rest[1:]
                inner = col + 1 + len(after) - len(after.lstrip(" "))
                nxt = line[inner:]
                if nxt.strip() and nxt[0] != "#" and (nxt == "-" or nxt[:2] == "- " or self.is_key(nxt)):
                    self.stack.append(inner)
                    self.put("INDENT", base + inner)
                    indent = inner
                col = inner
                continue
            m = _Y_PROP.match(rest)
            if m:
                self.put("PROP", base + col)
                col += len(m[0])
                continue
            key = self.key_at(rest)
            if key is not None:
                if not keys:
                    self.put("BAD", base + col)
                self.put("KEY", base + col)
                col += key
                keys = False
                continue
            m = _Y_ALIAS.match(rest)
            if m:
                self.put("ALIAS", base + col)
                col += len(m[0])
                continue
            if c in "|>" and _Y_HEAD.match(rest):
                self.put("BLOCKSCALAR", base + col)
                i += 1
                own = self.own(indent)
                while i < len(self.lines):
                    x = self.lines[i]
                    if x.strip() and len(x) - len(x.lstrip(" ")) <= own:
                        break
                    i += 1
                self.put("NL", self.starts[min(i, len(self.lines))])
                return i
            if c in "\"'":
                m = (_Y_DQ if c == '"' else _Y_SQ).match(self.text, self.starts[i] + col)
                if not m:
                    self.put("BAD", base + col)
                    return i + 1
                used = m[0].count("\n")
                if used:
                    own = self.own(indent)
                    for k in range(1, used + 1):
                        x = self.lines[i + k]
                        if x.strip() and len(x) - len(x.lstrip(" ")) <= own and own >= 0:
                            self.put("BAD", self.starts[i + k])
                            return i + k
                    i += used
                    line, base = self.lines[i].rstrip("\r"), self.starts[i]
                    col = len(m[0]) - m[0].rfind("\n") - 1
                else:
                    col += len(m[0])
                self.put("QUOTED", base + col)
                continue
            if c in "[{":
                got = self.flow(i, col, self.own(indent))
                if got is None:
                    return len(self.lines)
                i, col = got
                line, base = self.lines[i].rstrip("\r"), self.starts[i]
                after = line[col:].lstrip()
                if after[:1] == ":" and after[1:2] in ("", " "):  # a collection as a key
                    self.put("FKEY" if keys else "BAD", base + col)
                    col += len(line[col:]) - len(after) + 1
                keys = False
                continue
            if c in "@`%" or c in "-?:" and rest[1:2] in ("", " ", "\t") or c in ",]}":
                self.put("BAD", base + col)
                return i + 1
            # a plain scalar: to a comment or the end of the line, and over more indented lines
            self.put("SCALAR", base + col)
            plain = re.split(r"[ \t]#", rest, maxsplit=1)[0]
            if re.search(r":(?:[ \t]|$)", plain):
                self.put("BAD", base + col)
                return i + 1
            commented = plain is not rest and len(plain) < len(rest)
            own = self.own(indent)
            i += 1
            while i < len(self.lines) and not commented:
                x = self.lines[i].rstrip("\r")
                y = x.lstrip(" \t")
                if not y:
                    i += 1
                    continue
                if len(x) - len(x.lstrip(" ")) <= own or y[0] == "#" or re.match(r"(?:---|\.\.\.)(?:\s|$)", x):
                    break
                more = re.split(r"[ \t]#", x, maxsplit=1)[0]
                if re.search(r":(?:[ \t]|$)", more):
                    self.put("BAD", self.starts[i])
                    return i + 1
                i += 1
            self.put("NL", self.starts[min(i, len(self.lines))])
            return i

    def own(self, indent: int) -> int:
        """Continuation lines must be indented more than this."""
        return indent

    def key_at(self, rest: str) -> int | None:
        """Length of the key and its colon at the start of rest."""
        c = rest[0]
        if c in "\"'":
            m = (_Y_DQ if c == '"' else _Y_SQ).match(rest)
            if not m or "\n" in m[0]:
                return None
            tail = rest[m.end():]
            k = re.match(r"[ \t]*:(?=[ \t]|$)", tail)
            return m.end() + k.end() if k else None
        if c == "*":
            m = re.match(r"\*[^\s,\[\]{}]+[ \t]+:(?=[ \t]|$)", rest)
            return m.end() if m else None
        m = _Y_PLAIN_KEY.match(rest)
        if not m:
            return None
        k = re.match(r"[ \t]*:", rest[m.end():])
        return m.end() + k.end()

    def is_key(self, rest: str) -> bool:
        m = _Y_PROP.match(rest)
        while m:
            rest = rest[m.end():].lstrip(" ")
            m = _Y_PROP.match(rest)
        return bool(rest) and self.key_at(rest) is not None

    def flow(self, i: int, col: int, own: int) -> tuple[int, int] | None:
        """Tokens of a flow collection; where it ends, None if it does not."""
        depth = 0
        line, base = self.lines[i].rstrip("\r"), self.starts[i]
        while True:
            while col < len(line) and line[col] in " \t":
                col += 1
            if col >= len(line) or line[col] == "#" and line[col - 1] in " \t":
                i += 1
                if i >= len(self.lines):
                    return None
                line, base, col = self.lines[i].rstrip("\r"), self.starts[i], 0
                if line.strip() and len(line) - len(line.lstrip(" ")) <= own and own >= 0 and line.lstrip()[0] not in "]}":
                    self.put("BAD", base)
                    return None
                self.put("FNL", base)
                continue
            c = line[col]
            if c in "[{":
                depth += 1
                self.put(c, base + col)
                col += 1
            elif c in "]}":
                depth -= 1
                self.put(c, base + col)
                col += 1
                if not depth:
                    return i, col
            elif c == ",":
                self.put(",", base + col)
                col += 1
            elif c == ":" and (line[col + 1:col + 2] in ("", " ", "\t", ",", "]", "}") or self.out[-1] == YAML_LEX["QUOTED"]):
                self.put(":", base + col)
                col += 1
            elif c in "\"'":
                m = (_Y_DQ if c == '"' else _Y_SQ).match(self.text, self.starts[i] + col)
                if not m:
                    self.put("BAD", base + col)
                    return None
                self.put("QUOTED", base + col)
                used = m[0].count("\n")
                col = len(m[0]) - m[0].rfind("\n") - 1 if used else col + len(m[0])
                i += used
                line, base = self.lines[i].rstrip("\r"), self.starts[i]
            else:
                for rx, kind in ((_Y_PROP, "PROP"), (_Y_ALIAS, "ALIAS"), (_Y_FLOW_PLAIN, "SCALAR")):
                    m = rx.match(line, col)
                    if m and m[0]:
                        self.put(kind, base + col)
                        col = m.end()
                        break
                else:
                    self.put("BAD", base + col)
                    return None


_Y_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\ufffe\uffff\ud800-\udfff]")


def check_yaml(text: str) -> int | None:
    bad = _Y_CONTROL.search(text)
    if bad:
        return bad.start()
    kinds, at = _YamlLexer(text.lstrip("\ufeff")).run()
    end, far = YAML.parse(kinds, "file")
    return None if end >= 0 else at[far] if far < len(at) else len(text)
