"""Lexers and grammars for JavaScript modules, Go and bash."""

from __future__ import annotations

import re

from cairnlake.llm.grammar_data import offset
from cairnlake.llm.peg import LONG_TOKEN, Lexicon, Parser


def _ops(spellings: str) -> str:
    return "|".join(re.escape(x) for x in sorted(spellings.split(), key=len, reverse=True))


# JavaScript, as a module -----------------------------------------------------------------------------

JS_LEX = Lexicon()
JS_WORDS = frozenset(("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch "
                      "this throw true try typeof var void while with yield let static await async of get set from as enum").split())
JS_OPERATORS = ("{ } ( ) [ ] ... . ?. ; , < > <= >= == != === !== + - * / % ** ++ -- << >> >>> & | ^ ! ~ && || ?? ? : = += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= => #")
_TEMPLATE = r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{(?:[^{}`'\"]|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|\{(?:[^{}]|\{[^{}]*\})*\}|`(?:[^`\\$]|\\[\s\S]|\$(?!\{)|\$\{[^{}]*\})*`)*\})*`"
_REGEX = r"/(?![*/])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[a-z]*"
# what may stand before a regular expression is lexed together with it
JS_TOKEN = re.compile(
    r"(?:[ \t\r\f\v\ufeff\xa0]*+(?:(?://[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)[ \t\r]*+)?\n)+|[ \t\r\f\v\ufeff\xa0]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|/\*[\s\S]*|^#![^\n]*"
    r"|(?:(?:=>|&&|\|\||\?\?|[!=]==?|[-+*%&|^=<>!~?:(,\[{};])\s*|\b(?:return|typeof|case|in|of|delete|void|throw|new|await|yield|else|do)\b[ \t]*)" + _REGEX
    + r"|" + _TEMPLATE + r"|'(?:[^'\\\n]|\\(?:\r\n|[\s\S]))*'|\"(?:[^\"\\\n]|\\(?:\r\n|[\s\S]))*\""
    r"|#?[^\W\d][\w$]*|#?\$[\w$]*|(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*n?|0[oO][0-7](?:_?[0-7])*n?|0[bB][01](?:_?[01])*n?|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?n?)(?![\w$])|"
    + _ops(JS_OPERATORS) + r"|[\s\S]")
_JS_HEAD = re.compile(r"([^\w\s/]+|\w+)\s*(/[\s\S]*)")

JS = Parser("""
file <- _ (item _)* EOF
_ <~ NL*
item <~ import / export / stmt
import <- 'import' _ !'(' !'.' (STR / (name (_ ',' _ (ns / named))? / ns / named) _ 'from' _ STR) (_ 'with' _ object)? end
ns <- '*' _ 'as' _ name
named <- '{' _ (spec (_ ',' _ spec)* (_ ',')?)? _ '}'
spec <- (anyname / STR) (_ 'as' _ (anyname / STR))?
export <- 'export' _ ('default' _ (func / class / assign end) / '*' (_ 'as' _ (anyname / STR))? _ 'from' _ STR end / named (_ 'from' _ STR)? end / func / class / var end)
stmt << block / var end / func / class / if / for / while / do / try / switch / 'return' (expr)? end / 'throw' expr end / ['break' break] name? end / ';' / 'debugger' end / label / expr end
end <- ';' / &'}' / &NL / &EOF
block <- '{' _ (stmt _)* '}'
var <- ('const' / 'var' / 'let') _ binding (_ ',' _ binding)*
binding <- pattern (_ '=' _ assign)?
if <- 'if' _ '(' _ expr _ ')' _ stmt (_ 'else' _ stmt)?
for <- 'for' _ 'await'? _ '(' _ (forhead _ ('of' _ assign / 'in' _ expr) / (var / expr)? _ ';' _ expr? _ ';' _ expr?) _ ')' _ stmt
forhead <- ('const' / 'var' / 'let') _ pattern / lhs
while <- 'while' _ '(' _ expr _ ')' _ stmt
do <- 'do' _ stmt _ 'while' _ '(' _ expr _ ')' ';'?
try <- 'try' _ block (_ 'catch' _ ('(' _ pattern _ ')' _)? block (_ 'finally' _ block)? / _ 'finally' _ block)
switch <- 'switch' _ '(' _ expr _ ')' _ '{' _ (('case' _ expr / 'default') _ ':' _ (stmt _)*)* '}'
label <- name _ ':' _ stmt
func <- ('async' )? 'function' _ '*'? _ name? _ '(' params ')' _ block
params <- _ (param (_ ',' _ param)* (_ ',')?)? _
param <- '...'? _ pattern (_ '=' _ assign)?
pattern <- name / '[' _ (element? _ ',' _)* (element _)? ']' / '{' _ (field (_ ',' _ field)* (_ ',')?)? _ '}'
element <- '...'? _ pattern (_ '=' _ assign)?
field <- '...' _ pattern / propname _ ':' _ pattern (_ '=' _ assign)? / name (_ '=' _ assign)?
class <- 'class' _ name? (_ 'extends' _ lhs)? _ '{' _ (member _)* '}'
member <- ';' / 'static' _ block / ('static' _ &member_start)? (method / propname (_ '=' _ assign)? end)
member_start <- propname / '*' / PRIVATE
method <- (('get' / 'set') _ &member_start / 'async' &member_start)? '*'? _ propname _ '(' params ')' _ block
expr <- assign (_ ',' _ assign)*
assign <- arrow / 'yield' ('*'? _ assign)? / cond (_ ASSIGN _ assign)?
arrow <- 'async'? (name / '(' params ')') '=>' _ (block / assign)
cond <- binary (_ '?' _ assign _ ':' _ assign)?
binary <- unary (_ BINOP _ unary)*
unary <- (UNOP _)* postfix
postfix <- lhs [++ --]?
lhs <- ('new' _ !'.')* primary (_ trailer)*
trailer <~ '.' _ (anyname / PRIVATE) / '?.' _ (anyname / PRIVATE / '[' _ expr _ ']' / '(' args ')') / '[' _ expr _ ']' / '(' args ')' / TEMPLATE
args <- _ (arg (_ ',' _ arg)* (_ ',')?)? _
arg <~ '...'? _ assign
primary <- 'async'? 'function' _ '*'? _ name? _ '(' params ')' _ block / name / NUM / STR / TEMPLATE / REGEX / [this super null true false] / array / object / class / '(' _ expr _ ')'
    / 'import' _ ('(' args ')' / '.' _ anyname) / 'new' _ '.' _ anyname / PRIVATE _ &'in'
array <- '[' _ (arg? _ ',' _)* (arg _)? ']'
object <- '{' _ (prop (_ ',' _ prop)* (_ ',')?)? _ '}'
prop <- '...' _ assign / method / propname _ ':' _ assign / name (_ '=' _ assign)?
propname <- anyname / STR / NUM / PRIVATE / '[' _ assign _ ']'
anyname <~ [NAME ANY]
name <~ [NAME async of get set from as]
""".replace("['break' break]", "[break continue]").replace("ASSIGN", "[= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=]")
    .replace("BINOP", "[+ - * / % ** == != === !== < > <= >= && || ?? & | ^ << >> >>> in instanceof]").replace("UNOP", "[! ~ + - ++ -- typeof void delete await]")
    .replace("ANY", " ".join(sorted(JS_WORDS))), JS_LEX)
_JS_OPS = frozenset(JS_OPERATORS.split())


class _JsKinds(dict):
    def __missing__(self, tok: str) -> str:
        if len(self) > 500_000:
            self.clear()
        c, L = tok[0], JS_LEX
        if tok in JS_WORDS or tok in _JS_OPS:
            k = L[tok] if tok != "#" else L["BAD"]
        elif c not in "/`'\"" and (m := _JS_HEAD.fullmatch(tok)) and (m[1] in JS_WORDS or m[1] in _JS_OPS):
            k = L[m[1]] + L["REGEX"]
        elif tok[:2] == "/*" and "*/" not in tok[2:]:
            k = L["BAD"]
        elif "\n" in tok and c not in "`'\"/" or c == "/" and "\n" in tok:
            k = "\n"
        elif tok.isspace() or tok[:2] in ("//", "/*", "#!") or c == "\ufeff":
            k = ""
        elif c == "`":
            k = L["TEMPLATE"] if len(tok) > 1 else L["BAD"]
        elif c in "'\"":
            k = L["STR"] if len(tok) > 1 else L["BAD"]
        elif c == "#" and len(tok) > 1:
            k = L["PRIVATE"]
        elif c.isdigit() or c == "." and len(tok) > 1:
            k = L["NUM"]
        elif (c.isalpha() or c in "_$") and tok.replace("$", "a").isidentifier():
            k = L["NAME"]
        else:
            k = L["BAD"]
        if len(tok) <= LONG_TOKEN:
            self[tok] = k
        return k


JS_KINDS = _JsKinds()


def _check(tokens: list[str], kinds: list[str], drop: re.Pattern, parser: Parser) -> int | None:
    """Parse after leaving out the line breaks that drop finds; offset of the furthest failure, else None."""
    raw = "".join(kinds)
    seen = drop.sub("", raw)
    end, far = parser.parse(seen, "file")
    if end >= 0:
        return None
    # position in the raw kinds of the far-th that was kept
    for m in drop.finditer(raw):
        if m.start() > far:
            break
        far += m.end() - m.start()
    return offset(tokens, kinds, far)


_JS_DROP = re.compile(r"(?<=\n)\n+")


def check_javascript(text: str) -> int | None:
    tokens = JS_TOKEN.findall(text)
    return _check(tokens, list(map(JS_KINDS.__getitem__, tokens)), _JS_DROP, JS)


# Go --------------------------------------------------------------------------------------------------

GO_LEX = Lexicon()
GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
GO_OPERATORS = "+ - * / % & | ^ << >> &^ += -= *= /= %= &= |= ^= <<= >>= &^= && || <- ++ -- == < > = ! ~ != <= >= := ... ( ) [ ] { } , ; . :"
GO_TOKEN = re.compile(
    r"(?:[ \t\r]*+(?:(?://[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/)[ \t\r]*+)?\n)+|[ \t\r\ufeff]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|/\*[\s\S]*|`[^`]*`"
    r"|\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"
    r"|[^\W\d]\w*|(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?(?!\w)|"
    + _ops(GO_OPERATORS) + r"|[\s\S]")

_GO = """
file <- NL? 'package' NAME semi+ (import semi+)* (top semi+)* top? EOF
semi <~ ';' / NL
import <- 'import' (spec / '(' (semi* spec)* semi* ')')
spec <~ (NAME / '.')? STR
top << func / decl
func <- 'func' params? NAME tparams? sig block?
decl <- 'var' (vspec / '(' semi* (vspec semi+)* vspec? ')') / 'const' (cspec / '(' semi* (cspec semi+)* cspec? ')') / 'type' (tspec / '(' semi* (tspec semi+)* tspec? ')')
vspec <- names (type ('=' exprs)? / '=' exprs)
cspec <- names (type? '=' exprs)?
tspec <- NAME tparams? '='? type
tparams <- '[' tparam (',' tparam)* ','? ']'
tparam <- names constraint
constraint <- '~'? type ('|' '~'? type)*
names <~ NAME (',' NAME)*
sig <- params (params / type)?
params <- '(' (param (',' param)* ','?)? ')'
param <- NAME '...'? type / '...'? type
type <- NAME ('.' NAME)? targs? / '*' type / '[' ']' type / '[' ('...' / expr) ']' type / 'map' '[' type ']' type / '<-'? 'chan' '<-'? type / 'func' sig / struct / interface / '(' type ')'
targs <- '[' type (',' type)* ','? ']'
struct <- 'struct' '{' semi* (sfield semi+)* sfield? '}'
sfield <- (names type / '*'? NAME ('.' NAME)? targs?) STR?
interface <- 'interface' '{' semi* (ielem semi+)* ielem? '}'
ielem <- NAME sig / constraint
block <- '{' stmts '}'
stmts <- semi* (stmt semi+)* stmt?
stmt << decl / if / for / switch / select / block / 'return' exprs? / ('go' / 'defer') expr / [break continue goto] NAME? / 'fallthrough' / NAME ':' !'=' (semi* stmt)? / simple
simple <- exprs ([++ --] / '<-' expr / ASSIGN exprs)?
xsimple <- xexprs ([++ --] / '<-' xexpr / ASSIGN xexprs)?
if <- 'if' (xsimple? semi)? xexpr block ('else' (if / block))?
for <- 'for' ((xexprs (':=' / '='))? 'range' xexpr / xsimple? ';' xexpr? ';' xsimple? / xexpr)? block
switch <- 'switch' (xsimple? semi)? ((NAME ':=')? xprimary '.' '(' 'type' ')' / xsimple)? '{' semi* (('case' exprs &':' / 'case' (type / expr) (',' (type / expr))* / 'default') ':' stmts)* '}'
select <- 'select' '{' semi* (('case' simple / 'default') ':' stmts)* '}'
exprs <- expr (',' expr)*
xexprs <- xexpr (',' xexpr)*
expr <- unary (BINOP unary)*
xexpr <- xunary (BINOP xunary)*
unary <- UNOP* primary
xunary <- UNOP* xprimary
primary <- operand (trailer / litbody)*
xprimary <- xoperand trailer*
operand <- NUM / STR / CHR / 'func' sig block / littype litbody / ctype '(' expr ','? ')' / NAME / '(' (expr / type) ')'
xoperand <- NUM / STR / CHR / 'func' sig block / littype litbody / ctype '(' expr ','? ')' / NAME / '(' (expr / type) ')'
littype <- '[' (('...' / expr)?) ']' type / 'map' '[' type ']' type / struct
ctype <- '[' expr? ']' type / 'map' '[' type ']' type / 'chan' type / 'func' sig / interface / struct
litbody <- '{' semi* (elem (',' semi* elem)* ','? semi*)? '}'
elem <- (litbody / expr) (':' (litbody / expr))?
trailer <- '.' NAME / '.' '(' (type / 'type') ')' / '[' (expr? ':' expr? (':' expr?)? / type (',' type)* ','? / expr) ']' / '(' args? ')'
args <- arg (',' arg)* '...'? ','?
arg <~ expr &[, ... )] / type
"""
GO = Parser(_GO.replace("ASSIGN", "[= := += -= *= /= %= &= |= ^= <<= >>= &^=]").replace("BINOP", "[+ - * / % & | ^ << >> &^ && || == < > != <= >=]")
            .replace("UNOP", "[+ - ! ^ * & <-]").replace("[break continue goto]", "[break continue goto]"), GO_LEX)
_GO_OPS = frozenset(GO_OPERATORS.split())


class _GoKinds(dict):
    def __missing__(self, tok: str) -> str:
        if len(self) > 500_000:
            self.clear()
        c, L = tok[0], GO_LEX
        if tok in GO_WORDS or tok in _GO_OPS:
            k = L[tok]
        elif c == "`":
            k = L["STR"] if len(tok) > 1 else L["BAD"]
        elif c == '"':
            k = L["STR"] if len(tok) > 1 else L["BAD"]
        elif c == "'":
            k = L["CHR"] if len(tok) > 1 else L["BAD"]
        elif tok[:2] == "/*" and "*/" not in tok[2:]:
            k = L["BAD"]
        elif "\n" in tok:
            k = "\n"
        elif tok.isspace() or tok[:2] in ("//", "/*") or c == "\ufeff":
            k = ""
        elif c.isdigit() or c == "." and len(tok) > 1:
            k = L["NUM"] if not re.fullmatch(r"0[\d_]*[89][\d_]*", tok) else L["BAD"]
        elif c.isalpha() or c == "_":
            k = L["NAME"]
        else:
            k = L["BAD"]
        if len(tok) <= LONG_TOKEN:
            self[tok] = k
        return k


GO_KINDS = _GoKinds()
# a line break ends a statement only after these
_GO_DROP = re.compile("(?<![" + "".join(re.escape(GO_LEX[x]) for x in "NAME NUM STR CHR break continue fallthrough return ++ -- ) ] }".split()) + "])\n+")


def check_go(text: str) -> int | None:
    tokens = GO_TOKEN.findall(text)
    return _check(tokens, list(map(GO_KINDS.__getitem__, tokens)), _GO_DROP, GO)


# bash ------------------------------------------------------------------------------------------------

SH_LEX = Lexicon()
SH_WORDS = frozenset("if then elif else fi for in do done while until case esac function select time ! { } [[ ]]".split())
SH_OPERATORS = "&& || ;;& ;; ;& & | |& ; ( ) << <<- <<< < > >> >| <& >& &> &>> <>"
_SUB = r"\$\((?:[^()\"'\\#]|#|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\((?:[^()\"']|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\((?:[^()]|\([^()]*\))*\))*\))*\)"
_BRACE = r"\$\{(?:[^{}\"'\\]|\\[\s\S]|\"(?:[^\"\\]|\\[\s\S])*\"|'[^']*'|\$?\{(?:[^{}]|\{[^{}]*\})*\})*\}"
_DOUBLE = r"\"(?:[^\"\\$`]|\\[\s\S]|" + _SUB + "|" + _BRACE + r"|`(?:[^`\\]|\\[\s\S])*`|\$(?![({])|)*\""
SH_TOKEN = re.compile(
    r"(?:[ \t\r]*\n)+|[ \t\r]+|\\\r?\n|(?<![^\s;&|()])#[^\n]*|(?:\d+|\{\w+\})(?:<<<|<<-|<<|>>|>\||<&|>&|<>|>|<)|\(\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)\)|[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=\("
    r"|(?:\$'(?:[^'\\]|\\[\s\S])*'|'[^']*'|\$?" + _DOUBLE.replace("|)*", ")*") + "|" + _SUB + "|" + _BRACE + r"|`(?:[^`\\]|\\[\s\S])*`|\\[^\n]|\$(?![({])|[^\s'\"`$\;&|()<>])+|"
    + _ops(SH_OPERATORS) + r"|[\s\S]")
SH = Parser("""
file <- _ list? EOF
_ <~ NL*
sep <~ (';' / '&') _ / NL+
list <- andor (sep andor)* sep?
andor <- pipeline (['&&' &&] _ pipeline)*
pipeline <- ('time' / '!')* command (['|' |] _ command)*
command << compound redir* / funcdef / simple
compound <~ if / for / while / case / group / sub / arith / test / select
group <- '{' _ list '}'
sub <- '(' _ list ')'
arith <~ ARITH
test <- '[[' _ (tword / TESTOPS / NL)+ ']]'
tword <~ [WORD ! { } if then elif else fi for in do done while until case esac function select time]
if <- 'if' _ list 'then' _ list ('elif' _ list 'then' _ list)* ('else' _ list)? 'fi'
for <- 'for' (ARITH / word (_ 'in' word*)?) (sep / _) ('do' _ list 'done' / group)
select <- 'select' word (_ 'in' word*)? (sep / _) 'do' _ list 'done'
while <- ('while' / 'until') _ list 'do' _ list 'done'
case <- 'case' word _ 'in' _ (item _)* last? 'esac'
item <- '('? !'esac' word ('|' word)* ')' _ list? [;; ;& ;;&]
last <- '('? !'esac' word ('|' word)* ')' _ list?
funcdef <- ('function' word ('(' ')')? / plain '(' ')') _ compound redir*
plain <~ WORD
simple <- (assign / redir)* plain (word / redir / assign)* / (assign / redir)+
assign <- AOPEN _ (word _)* ')'
word <~ [WORD if then elif else fi for in do done while until case esac function select time ! { } [[ ]]] / ARITH
redir <- REDIR (word / ['<' <] '(' _ list ')' / '(' _ list ')') / ['<' <] '(' _ list ')'
""".replace("['&&' &&]", "[&& ||]").replace("['|' |]", "[| |&]").replace("['<' <]", "[< >]").replace("REDIR", "[<< <<- <<< < > >> >| <& >& &> &>> <>]")
    .replace("time ! { } [[ ]]] / ARITH", "time ! { } DOPEN DCLOSE] / ARITH").replace("TESTOPS", "[( ) < > && || | & ; <& >& >> <<]").replace("'[['", "DOPEN").replace("']]'", "DCLOSE"), SH_LEX)
_SH_OPS = frozenset(SH_OPERATORS.split())


_FD = re.compile(r"(?:\d+|\{\w+\})([<>][<>&|-]*)")


class _ShKinds(dict):
    def __missing__(self, tok: str) -> str:
        if len(self) > 500_000:
            self.clear()
        c, L = tok[0], SH_LEX
        if tok in SH_WORDS:
            k = L[{"[[": "DOPEN", "]]": "DCLOSE"}.get(tok, tok)]
        elif tok in _SH_OPS:
            k = L[tok]
        elif "\n" in tok and (tok.isspace()):
            k = "\n"
        elif tok.isspace() or c == "#" or tok in ("\\\n", "\\\r\n"):
            k = ""
        elif (m := _FD.fullmatch(tok)):
            k = L[m[1]]  # the number of the file does not matter
        elif tok.startswith("((") and tok.endswith("))"):
            k = L["ARITH"]
        elif tok.endswith("=(") and len(tok) > 2 and (c.isalpha() or c == "_"):
            k = L["AOPEN"]
        elif len(tok) == 1 and c in "'\"`":
            k = L["BAD"]
        elif len(tok) == 1 and ord(c) < 32:
            k = L["BAD"]
        elif tok == "$" or len(tok) > 0:
            k = L["WORD"]
        if len(tok) <= LONG_TOKEN:
            self[tok] = k
        return k


SH_KINDS = _ShKinds()
_SH_DROP = re.compile(r"(?<=\n)\n+")
_HEREDOC = re.compile(r"(?<!<)<<(-?)(?!<)[ \t]*(?:'([^'\n]+)'|\"([^\"\n]+)\"|\\?([\w.-]+))")


def without_heredocs(text: str) -> str:
    """The text with the bodies of here-documents overwritten by spaces, so that offsets stay."""
    if "<<" not in text:
        return text
    lines = text.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        i += 1
        if "<<" not in line or line.lstrip().startswith("#"):
            continue
        for m in _HEREDOC.finditer(line):
            before = line[:m.start()]
            if before.count("'") % 2 or before.count('"') % 2 and "$(" not in before or "((" in before:
                continue
            end = m[2] or m[3] or m[4]
            while i < len(lines):
                body = lines[i].rstrip("\r")
                lines[i] = " " * len(lines[i])
                i += 1
                if (body.lstrip("\t") if m[1] else body) == end:
                    break
    return "\n".join(lines)


def check_shell(text: str) -> int | None:
    if "\x00" in text:
        return text.index("\x00")
    tokens = SH_TOKEN.findall(without_heredocs(text))
    return _check(tokens, list(map(SH_KINDS.__getitem__, tokens)), _SH_DROP, SH)
