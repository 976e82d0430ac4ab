"""Packrat parsers from parsing-expression grammars over token strings.

A text is lexed into kinds, one character per token, so a grammar's terminals are single characters and a
parser is plain comparisons on a string. Grammar text, one rule a line (indented lines go on):

    rule <- expression        memoised at each position: the packrat table
    rule <~ expression        inlined where it is used
    rule << expression        memoised across texts too, keyed by the tokens up to the end of the line

'x' is a token, NAME a kind, [a b c] one of several, / ordered choice, * + ? repetition, & ! lookahead,
( ) grouping. A rule << is only kept across texts when nothing beyond the end of its line was looked at, so
it gives what parsing again would give. Parsers report the end reached and the furthest failure.
"""

from __future__ import annotations

import re

EOF = "\x00"
#: Longer stretches of tokens are not kept across texts, nor are longer tokens.
LONGEST, LONG_TOKEN = 2000, 200
_TOKEN = re.compile(r"'((?:[^'\\]|\\.)+)'|\[([^\]]*)\]|([A-Za-z_]\w*)|([/*+?&!()])")


class Lexicon:
    """Token spelling or kind name -> one character."""

    def __init__(self) -> None:
        self.codes: dict[str, str] = {"NL": "\n", "EOF": EOF}

    def __getitem__(self, name: str) -> str:
        c = self.codes.get(name)
        if c is None:
            c = self.codes[name] = chr(0xE000 + len(self.codes))
        return c


def _parse_rules(text: str) -> dict[str, tuple[str, list]]:
    rules: dict[str, tuple[str, list]] = {}
    lines: list[str] = []
    for line in text.strip("\n").split("\n"):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        if line[0] in " \t" and lines:
            lines[-1] += " " + line.strip()
        else:
            lines.append(line)
    for line in lines:
        name, how, body = re.fullmatch(r"(\w+)\s*(<-|<~|<<)\s*(.*)", line).groups()
        rules[name] = (how, [m for m in _TOKEN.finditer(body)])
    return rules


class _Compiler:
    def __init__(self, rules, lexicon: Lexicon):
        self.rules, self.lex, self.trees, self.n = rules, lexicon, {}, 0
        for name, (_, toks) in rules.items():
            self.toks, self.at = toks, 0
            self.trees[name] = self.choice()
            if self.at != len(toks):
                raise ValueError(f"rule {name}")

    def peek(self) -> str:
        return self.toks[self.at][4] if self.at < len(self.toks) else None

    def choice(self):
        alts = [self.sequence()]
        while self.at < len(self.toks) and self.peek() == "/":
            self.at += 1
            alts.append(self.sequence())
        return alts[0] if len(alts) == 1 else ("alt", alts)

    def sequence(self):
        parts = []
        while self.at < len(self.toks) and self.peek() not in ("/", ")"):
            parts.append(self.prefix())
        return parts[0] if len(parts) == 1 else ("seq", parts)

    def prefix(self):
        if self.peek() in ("&", "!"):
            op = self.peek()
            self.at += 1
            return (op, self.suffix())
        return self.suffix()

    def suffix(self):
        node = self.primary()
        while self.at < len(self.toks) and self.peek() in ("*", "+", "?"):
            node = (self.peek(), node)
            self.at += 1
        return node

    def primary(self):
        m = self.toks[self.at]
        self.at += 1
        if m[1]:
            return ("chr", self.lex[m[1].replace("\\'", "'")])
        if m[2] is not None:
            return ("set", "".join(self.lex[x] for x in m[2].split()))
        if m[3]:
            return ("ref", m[3]) if m[3] in self.rules else ("chr", self.lex[m[3]])
        if m[4] == "(":
            node = self.choice()
            self.at += 1
            return node
        raise ValueError(m[0])

    def var(self) -> str:
        self.n += 1
        return f"v{self.n}"

    def emit(self, node, p: str, o: str, ind: int, out: list[str]) -> None:
        """Code that sets o to the end of node's match from p, or to -1."""
        pad = "    " * ind
        kind = node[0]
        if kind in ("chr", "set"):
            test = f"s[{p}] == {node[1]!r}" if kind == "chr" else f"s[{p}] in {node[1]!r}"
            out += [f"{pad}if {test}:", f"{pad}    {o} = {p} + 1", f"{pad}else:", f"{pad}    if {p} > far: far = {p}", f"{pad}    {o} = -1"]
        elif kind == "ref":
            how, _ = self.rules[node[1]]
            if how == "<~":
                self.emit(self.trees[node[1]], p, o, ind, out)
            else:
                out.append(f"{pad}{o} = r_{node[1]}({p})")
        elif kind == "seq":
            q = self.var()
            if not node[1]:
                out.append(f"{pad}{o} = {p}")
                return
            self.emit(node[1][0], p, q, ind, out)
            for i, x in enumerate(node[1][1:], 1):
                pad2 = "    " * (ind + i - 1)
                out.append(f"{pad2}if {q} >= 0:")
                r = self.var()
                self.emit(x, q, r, ind + i, out)
                out.append(f"{pad2}    {q} = {r}")
                # the next part goes on within this branch
            out.append(f"{pad}{o} = {q}")
        elif kind == "alt":
            self.emit(node[1][0], p, o, ind, out)
            for i, x in enumerate(node[1][1:]):
                out.append("    " * (ind + i) + f"if {o} < 0:")
                self.emit(x, p, o, ind + i + 1, out)
        elif kind in ("*", "+"):
            q, r = self.var(), self.var()
            if kind == "+":
                self.emit(node[1], p, o, ind, out)
                out.append(f"{pad}if {o} >= 0:")
                pad, ind = pad + "    ", ind + 1
                out.append(f"{pad}{q} = {o}")
            else:
                out.append(f"{pad}{q} = {p}")
            out.append(f"{pad}while True:")
            self.emit(node[1], q, r, ind + 1, out)
            out += [f"{pad}    if {r} <= {q}: break", f"{pad}    {q} = {r}", f"{pad}{o} = {q}"]
        elif kind == "?":
            self.emit(node[1], p, o, ind, out)
            out.append(f"{pad}if {o} < 0: {o} = {p}")
        elif kind in ("&", "!"):
            q = self.var()
            self.emit(node[1], p, q, ind, out)
            # a lookahead that succeeds has looked at least at its end
            out.append(f"{pad}if {q} - 1 > far: far = {q} - 1")
            out.append(f"{pad}{o} = {p} if {q} {'>=' if kind == '&' else '<'} 0 else -1")

    def source(self) -> str:
        out = ["def parse(s, start, top, shared):", "    far = -1"]
        names = [n for n, (how, _) in self.rules.items() if how != "<~"]
        out += [f"    m_{n} = {{}}" for n in names]
        for n in names:
            how = self.rules[n][0]
            out += [f"    def r_{n}(p):", "        nonlocal far", f"        v0 = m_{n}.get(p)", "        if v0 is not None: return v0"]
            if how == "<<":
                out += ["        e = s.find('\\n', p) + 2", "        if e < 2: e = len(s)", f"        key = ({n!r}, s[p:e]) if e - p < {LONGEST} else None", "        got = shared.get(key) if key else None", "        if got is not None:",
                        "            if got[1] + p > far: far = got[1] + p", f"            v0 = m_{n}[p] = got[0] + p if got[0] >= 0 else -1", "            return v0",
                        "        before = far", "        far = -1"]
            self.n = 0
            self.emit(self.trees[n], "p", "v0", 2, out)
            if how == "<<":
                out += ["        if key and far < e and v0 <= e: shared[key] = (v0 - p if v0 >= 0 else -1, far - p)", "        if before > far: far = before"]
            out += [f"        m_{n}[p] = v0", "        return v0"]
        out.append("    rules = {" + ", ".join(f"{n!r}: r_{n}" for n in names) + "}")
        out += ["    end = rules[top](start)", "    return end, far"]
        return "\n".join(out)


class Parser:
    """Compiled grammar. parse(kinds, top) -> (end or -1, furthest position at which a token was not as expected)."""

    MOST_SHARED = 200_000

    def __init__(self, grammar: str, lexicon: Lexicon):
        self.lexicon = lexicon
        self.code = _Compiler(_parse_rules(grammar), lexicon).source()
        space: dict = {}
        exec(compile(self.code, "<grammar>", "exec"), space)
        self._parse = space["parse"]
        self.shared: dict = {}

    def parse(self, kinds: str, top: str, start: int = 0) -> tuple[int, int]:
        if len(self.shared) > self.MOST_SHARED:
            self.shared.clear()
        return self._parse(kinds + EOF + EOF, start, top, self.shared)
