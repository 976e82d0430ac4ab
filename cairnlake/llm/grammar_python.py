"""Lexer and grammars for Python 3.13: one grammar for a logical line, one for the blocks that lines make."""

from __future__ import annotations

import re

from cairnlake.llm.peg import LONG_TOKEN, LONGEST, Lexicon, Parser

LEX = Lexicon()
KEYWORDS = ("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
            "nonlocal not or pass raise return try while with yield match case type").split()
OPERATORS = "** // >> << <= >= == != -> := += -= *= /= %= &= |= ^= @= **= //= >>= <<= ... + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()
_OPS = "|".join(re.escape(x) for x in sorted(OPERATORS, key=len, reverse=True))
_QUOTED = (r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''" r'|"""(?:[^"\\]|\\[\s\S]|"(?!""))*"""' r"|'(?:[^'\\\n]|\\[\s\S])*'" r'|"(?:[^"\\\n]|\\[\s\S])*"')
TOKEN = re.compile(
    r"(?:[ \t\f]*(?:#[^\n]*)?\n)+[ \t\f]*|[ \t\f]+|#[^\n]*|\\\n|(?:[rRbBuUfF]|[bBfF][rR]|[rR][bBfF])?(?:" + _QUOTED + r")|[^\W\d]\w*"
    r"|(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)|" + _OPS + r"|[\s\S]")
_NUMBER = re.compile(r"[\d.]\S*")
_ZEROS = re.compile(r"0[\d_]*[1-9][\d_]*")
_FSTRING = re.compile(r"[rR]?[fF][rR]?['\"]")
_SIMPLE_F = re.compile(r"(?:[^{}]|\{\{|\}\}|\{[A-Za-z_][\w.]*(?:\([\w., ]*\)|\[\w+\])?(?:![rsa])?(?::[^{}'\"]*)?\})*")

LINE = Parser(r"""
line <- header ':' body / decorator EOF / simple ';'? EOF
body <- EOF / simple ';'? EOF
inline <- header ':' simple ';'? EOF
header <~ 'if' named / 'elif' named / 'else' / 'for' targets 'in' stars / 'while' named / 'try' / 'except' '*' expr as_name? / 'except' (expr as_name?)? / 'finally'
    / 'with' with_items / 'def' def_rest / 'class' name tparams? ('(' args? ')')? / 'async' ('for' targets 'in' stars / 'with' with_items / 'def' def_rest) / match_head / case_head
def_rest <- name tparams? '(' params? ')' ('->' expr)?
tparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- ('*' / '**')? name (':' expr)? ('=' expr)?
as_name <- 'as' name
with_items <- '(' with_item (',' with_item)* ','? ')' &':' / with_item (',' with_item)*
with_item <- expr ('as' target)?
match_head <- 'match' subject &(':' EOF)
subject <- stars
case_head <- 'case' patterns ('if' named)?
patterns <- pattern (',' pattern)* ','?
pattern <- '*' name / orpat ('as' name)?
orpat <- closed ('|' closed)*
closed <- '-'? NUM ([+ -] NUM)? / STR+ / ['None' None 'True' True 'False' False] / name ('.' name)* ('(' (patarg (',' patarg)* ','?)? ')')? / '(' patterns? ')' / '[' patterns? ']'
    / '{' (mappat (',' mappat)* ','?)? '}'
patarg <- name '=' pattern / pattern
mappat <- '**' name / closed ':' pattern
decorator <- '@' named
simple <- small (';' small)*
small <- ['pass' pass 'break' break 'continue' continue] / 'return' stars? / 'raise' (expr ('from' expr)?)? / 'global' name (',' name)* / 'nonlocal' name (',' name)* / 'del' targets
    / 'assert' expr (',' expr)? / import / type_alias / assignment / yield / stars
type_alias <- 'type' name tparams? '=' expr
import <- 'import' dotted ('as' name)? (',' dotted ('as' name)?)* / 'from' (['.' . '...' ...]* dotted / ['.' . '...' ...]+) 'import' ('*' / '(' froms ','? ')' / froms)
froms <- name ('as' name)? (',' name ('as' name)?)*
dotted <- name ('.' name)*
assignment <- single ':' expr ('=' rhs)? / (targets '=')+ rhs !'=' / single AUG rhs
rhs <~ yield / stars
single <- atarget / name !trailer / '(' single ')' !trailer
targets <- startarget (',' startarget)* ','?
startarget <- '*'? target
target <- atarget / name !trailer / '(' targets? ')' !trailer / '[' targets? ']' !trailer
atarget <- atom (trailer &trailer)* ('.' name / '[' slices ']') !trailer
yield <- 'yield' ('from' expr / stars?)
stars <- star (',' star)* ','?
star <- '*' bitor / named
named <- name ':=' expr / expr !':='
expr <- disj ('if' disj 'else' expr)? / 'lambda' lparams? ':' expr
disj <- conj ('or' conj)*
conj <- inv ('and' inv)*
inv <- 'not' inv / comparison
comparison <- bitor ((COMPARE / 'in' / 'not' 'in' / 'is' 'not'?) bitor)*
bitor <- unary (BINARY unary)*
unary <- SIGN* power
power <- 'await'? atom trailer* ('**' unary)?
trailer <- '.' name / '(' args? ')' / '[' slices ']'
args <- pos (',' pos)* (',' kw (',' (kw / '*' expr))*)? ','? / kw (',' (kw / '*' expr))* ','?
pos <- '*' expr / !(name '=' !'=') named gen?
kw <- name '=' !'=' expr / '**' expr
gen <- ('async'? 'for' targets 'in' disj ('if' (disj / named))*)+
slices <- slice (',' slice)* ','?
slice <- expr? ':' expr? (':' expr?)? / '*' bitor / named
atom <- name / STR+ / NUM / ['None' None 'True' True 'False' False '...' ...] / '(' (yield / named gen / stars)? ')' / '[' (named gen / stars)? ']' / '{' (dict / set)? '}'
dict <- (pair gen / (pair / '**' bitor) (',' (pair / '**' bitor))* ','?) &'}'
pair <- expr ':' expr
set <- named gen / star (',' star)* ','?
params <- param (',' param)* ','?
param <- '**' name annotation? / '*' name (':' '*'? expr)? / '*' / '/' / name annotation? ('=' expr)?
annotation <- ':' expr
lparams <- lparam (',' lparam)* ','?
lparam <- '**' name / '*' name / '*' / '/' / name ('=' expr)?
name <~ [NAME match case type]
fexpr <- (yield / stars) '='? EOF
""".replace("['None' None 'True' True 'False' False '...' ...]", "[None True False ...]").replace("['None' None 'True' True 'False' False]", "[None True False]")
    .replace("['pass' pass 'break' break 'continue' continue]", "[pass break continue]").replace("['.' . '...' ...]", "[. ...]")
    .replace("AUG", "[+= -= *= /= %= &= |= ^= @= **= //= >>= <<=]").replace("COMPARE", "[== != < > <= >=]").replace("BINARY", "[+ - * / // % @ & | ^ << >>]").replace("SIGN", "[+ - ~]"), LEX)

#: What a line is to the block grammar.
BLOCKS = Lexicon()
BLOCK = Parser(r"""
file <- stmt* EOF
suite <- INDENT stmt+ DEDENT
stmt << SIMPLE / if / for / while / try / with / def / class / decorated / match
if <- if_part elif_part* else_part?
if_part <~ IF suite / IF1
elif_part <~ ELIF suite / ELIF1
else_part <~ ELSE suite / ELSE1
for <- (FOR suite / FOR1) else_part?
while <- (WHILE suite / WHILE1) else_part?
try <- (TRY suite / TRY1) (except+ else_part? finally? / finally)
except <~ EXCEPT suite / EXCEPT1
finally <~ FINALLY suite / FINALLY1
with <- WITH suite / WITH1
def <- DEF suite / DEF1
class <- CLASS suite / CLASS1
decorated <- AT+ (def / class)
match <- MATCH INDENT case+ DEDENT
case <~ CASE suite / CASE1
""", BLOCKS)

_HEADS = {"if": "IF", "elif": "ELIF", "else": "ELSE", "for": "FOR", "while": "WHILE", "try": "TRY", "except": "EXCEPT", "finally": "FINALLY", "with": "WITH",
          "def": "DEF", "class": "CLASS", "match": "MATCH", "case": "CASE"}
_BY_CODE = {LEX[k]: v for k, v in _HEADS.items()}
_OPEN, _CLOSE = "".join(LEX[x] for x in "([{"), "".join(LEX[x] for x in ")]}")
BAD = LEX["BAD"]
_INDENT, _DEDENT = BLOCKS["INDENT"], BLOCKS["DEDENT"]


def _good_fstring(tok: str) -> bool:
    body = tok.lstrip("rRfF")
    body = body[3:-3] if body[:3] in ("'''", '"""') else body[1:-1]
    if _SIMPLE_F.fullmatch(body):
        return True
    i, n = 0, len(body)
    while i < n:
        c = body[i]
        if c in "{}" and body[i:i + 2] == c * 2:
            i += 2
        elif c == "}":
            return False
        elif c == "{":
            depth, j = 1, i + 1
            while j < n and depth:
                depth += (body[j] in "{[(") - (body[j] in "}])")
                j += 1
            if depth:
                return False
            inner = body[i + 1:j - 1]
            cut = _spec(inner)
            expr = re.sub(r"![rsa]$", "", inner[:cut].rstrip())
            kinds = "".join(map(KINDS.__getitem__, TOKEN.findall(expr.strip().replace("\n", " "))))
            if LINE.parse(kinds, "fexpr")[0] < 0:
                return False
            i = j
        else:
            i += 1
    return True


def _spec(inner: str) -> int:
    """Where the format specification of a replacement field begins."""
    depth = 0
    for k, c in enumerate(inner):
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and not depth and inner[k + 1:k + 2] != "=" and "lambda" not in inner[:k]:
            return k
        elif c == "!" and not depth and inner[k + 1:k + 2] in ("r", "s", "a") and inner[k + 2:k + 3] in ("", ":"):
            return k
    return len(inner)


class _Kinds(dict):
    """Token text -> kind, '' for what the grammar does not see."""

    def __missing__(self, tok: str) -> str:
        if len(self) > 500_000:
            self.clear()
        c = tok[0]
        if tok in _RESERVED:
            k = LEX[tok]
        elif c.isalpha() or c == "_":
            if tok[-1] in "'\"":
                k = LEX["STR"] if not _FSTRING.match(tok) or _good_fstring(tok) else BAD
            else:
                k = LEX["NAME"] if tok.isidentifier() else BAD
        elif c in "'\"":
            k = LEX["STR"] if len(tok) > 1 else BAD
        elif "\n" in tok and tok != "\\\n":
            k = "\n"
        elif tok.isspace() or c == "#" or tok == "\\\n":
            k = ""
        elif _NUMBER.fullmatch(tok) and tok != ".":
            k = BAD if _ZEROS.fullmatch(tok) else LEX["NUM"]
        else:
            k = BAD
        if len(tok) <= LONG_TOKEN:
            self[tok] = k
        return k


_RESERVED = frozenset(KEYWORDS) | frozenset(OPERATORS)
KINDS = _Kinds()


class _Lines(dict):
    """Tokens of a logical line -> (symbol or '', furthest token)."""

    def __missing__(self, kinds: str):
        if len(self) > 200_000:
            self.clear()
        end, far = LINE.parse(kinds, "line")
        if end < 0:
            out = ("", far)
        elif kinds[0] == LEX["@"]:
            out = (BLOCKS["AT"], far)
        else:
            first = _BY_CODE.get(kinds[1] if kinds[0] == LEX["async"] and len(kinds) > 1 else kinds[0])
            if first in ("MATCH", "CASE") and not (kinds[-1] == LEX[":"] or LINE.parse(kinds, "inline")[0] > 0):
                first = None
            if first is None:
                out = (BLOCKS["SIMPLE"], far)
            else:
                out = (BLOCKS[first if kinds[-1] == LEX[":"] and LINE.parse(kinds, "inline")[0] < 0 else first + "1"], far)
        if len(kinds) <= LONGEST:
            self[kinds] = out
        return out


class _Depth(dict):
    def __missing__(self, kinds: str):
        if len(self) > 200_000:
            self.clear()
        d = sum(kinds.count(x) for x in _OPEN) - sum(kinds.count(x) for x in _CLOSE)
        if len(kinds) <= LONGEST:
            self[kinds] = d
        return d


LINES, DEPTH = _Lines(), _Depth()


def check(text: str) -> int | None:
    """None if the text parses, else the offset of the furthest failure."""
    text = text.lstrip("﻿") if text[:1] == "﻿" else text
    tokens = TOKEN.findall("\n" + text)
    kinds = list(map(KINDS.__getitem__, tokens))
    physical = "".join(kinds).split("\n")[1:]
    breaks = [t for t, k in zip(tokens, kinds) if k == "\n"]
    symbols: list[str] = []
    places: list[tuple[int, int]] = []  # line of each symbol
    stack = [(0, 0)]
    i, n = 0, len(physical)
    while i < n:
        kind = physical[i]
        start = i
        depth = DEPTH[kind]
        while depth > 0 and i + 1 < n:
            i += 1
            kind += physical[i]
            depth += DEPTH[physical[i]]
        i += 1
        if not kind:
            continue
        space = breaks[start].rsplit("\n", 1)[1]
        # tabs count to the next multiple of 8, and must mean the same when they count 1
        space = space.rsplit("\f", 1)[-1]
        width, alt = (len(space.expandtabs(8)), len(space)) if "\t" in space else (len(space),) * 2
        if width > stack[-1][0]:
            if alt <= stack[-1][1]:
                return _offset(tokens, kinds, start, 0)
            stack.append((width, alt))
            symbols.append(_INDENT)
            places.append((start, 0))
        else:
            while width < stack[-1][0]:
                stack.pop()
                symbols.append(_DEDENT)
                places.append((start, 0))
            if (width, alt) != stack[-1]:
                return _offset(tokens, kinds, start, 0)
        symbol, far = LINES[kind]
        if not symbol:
            return _offset(tokens, kinds, start, far)
        symbols.append(symbol)
        places.append((start, 0))
    symbols += [_DEDENT] * (len(stack) - 1)
    end, far = BLOCK.parse("".join(symbols), "file")
    if end >= 0:
        return None
    return _offset(tokens, kinds, places[far][0], 0) if far < len(places) else len(text)


def _offset(tokens: list[str], kinds: list[str], line: int, far: int) -> int:
    """Offset of the far-th token of the logical line that begins with physical line `line`."""
    at, seen, left, begun = -1, -1, far, False  # a line break was put in front
    for t, k in zip(tokens, kinds):
        if k == "\n" and not begun:
            seen += 1
            begun = seen == line
        elif begun and k and k != "\n":
            if left == 0:
                return max(0, at)
            left -= 1
        at += len(t)
    return max(0, at)
