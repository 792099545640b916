"""Python 3."""

from __future__ import annotations

import re

from loomdex.llm.syntax.gll import BAD, Grammar, Kinds

GRAMMAR = Grammar(
    """
block = stmt
stmt = line | compound
line = small ( ';' small )* ';'? NL
small = exprs | targets annotation | assign | tprim AUG ( exprs | yield ) | yield | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' ( e ( 'from' e )? )? | 'del' dels | 'assert' e ( ',' e )? | 'global' ids | 'nonlocal' ids | 'import' mods | from | 'type' ID K:tparams? '=' e
annotation = ':' e ( '=' ( exprs | yield ) )?
assign = ( targets '=' )+ ( exprs | yield )
yield = 'yield' exprs? | 'yield' 'from' e
ids = ID ( ',' ID )*
mods = dotted ( 'as' ID )? ( ',' dotted ( 'as' ID )? )*
dotted = ID ( '.' ID )*
from = 'from' ( '.' | '...' )* dotted? 'import' ( '*' | names | P:pnames )
names = ID ( 'as' ID )? ( ',' ID ( 'as' ID )? )*
pnames = names ','?
dels = del ( ',' del )* ','?
del = tprim | P:dlist | K:dlist
dlist = del
compound = deco* ( func | class ) | if | while | for | with | try | match | 'async' ( for | with )
deco = '@' ne NL
func = 'async'? 'def' ID K:tparams? P:params ( '->' e )? ':' suite
class = 'class' ID K:tparams? P:args? ':' suite
suite = D:block | line
if = 'if' ne ':' suite ( 'elif' ne ':' suite )* else?
else = 'else' ':' suite
while = 'while' ne ':' suite else?
for = 'for' targets 'in' exprs ':' suite else?
with = 'with' ( item ( ',' item )* | P:items ) ':' suite
items = item ( ',' item )* ','?
item = e ( 'as' target )?
try = 'try' ':' suite ( ( 'except' '*'? ( exprs ( 'as' ID )? )? ':' suite )+ else? ( 'finally' ':' suite )? | 'finally' ':' suite )
match = 'match' exprs ':' D:cases
cases = case
case = 'case' pats ( 'if' ne )? ':' suite
pats = pat ( ',' pat )* ','?
pat = '*' ID | orpat ( 'as' ID )?
orpat = closed ( '|' closed )*
closed = '-'? NUM ( ( '+' | '-' ) NUM )? | STR+ | BYTES+ | 'None' | 'True' | 'False' | dotted P:patargs? | P:patseq | K:patseq | B:patmap
patargs = ( parg ( ',' parg )* ','? )?
parg = ID '=' pat | pat
patseq = pat
patmap = mapitem
mapitem = '**' ID | closed ':' pat
params = ( plist ','? )?
plist = ppos ( ',' pstar )? | pstar
ppos = p ( ',' p )* ( ',' '/' ( ',' p )* )? ( ',' d )* | p ( ',' p )* ( ',' d )+ ',' '/' ( ',' d )* | d ( ',' d )* ( ',' '/' ( ',' d )* )?
pstar = '*' ID ( ':' '*'? e )? ( ',' p | ',' d )* ( ',' pmap )? | '*' ( ',' p | ',' d )+ ( ',' pmap )? | pmap
pmap = '**' ID ( ':' e )?
p = ID ( ':' e )?
d = ID ( ':' e )? '=' e
lparams = llist ','?
llist = lpos ( ',' lstar )? | lstar
lpos = ID ( ',' ID )* ( ',' '/' ( ',' ID )* )? ( ',' l )* | ID ( ',' ID )* ( ',' l )+ ',' '/' ( ',' l )* | l ( ',' l )* ( ',' '/' ( ',' l )* )?
lstar = '*' ID ( ',' ID | ',' l )* ( ',' '**' ID )? | '*' ( ',' ID | ',' l )+ ( ',' '**' ID )? | '**' ID
l = ID '=' e
tparams = tparam ( ',' tparam )* ','?
tparam = ( '*' | '**' )? ID ( ':' e )? ( '=' e )?
exprs = sexpr ( ',' sexpr )* ','?
sexpr = '*' e | ne
ne = ID ':=' e | e
e = or ( 'if' or 'else' e )? | 'lambda' lparams? ':' e
or = un ( BOP un )*
un = UOP* prim
prim = atom suffix*
suffix = '.' ID | P:args | K:subscript
atom = ID | NUM | STR+ | BYTES+ | '...' | 'None' | 'True' | 'False' | P:tuple | P:row | K:tuple | K:row | B:dict | B:row | B:pairs
tuple = sexpr comp | yield
row = sexpr
subscript = sub
sub = sexpr | e? ':' e? ( ':' e? )?
dict = sexpr comp | e ':' e comp
pairs = pair
pair = '**' or | e ':' e
args = ( arglist ','? | ne comp )?
arglist = pos ( ',' pos )* ( ',' kwargs )? | kwargs
pos = ne | '*' e
kwargs = kw ( ',' kw )* ( ',' kwmap )* | kwmap ( ',' kwmap )*
kw = ID '=' e | '*' e
kwmap = ID '=' e | '**' e
comp = ( 'async'? 'for' targets 'in' or ( 'if' cond )* )+
cond = or | ID ':=' or
targets = target ( ',' target )* ','?
tlist = target
target = '*'? tprim | '*'? P:tlist | '*'? K:tlist | P:none | K:none
none = ''?
tprim = ID | atom suffix* ( '.' ID | K:subscript )
BOP = 'and' | 'or' | 'in' | 'not' 'in' | 'is' | 'is' 'not' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**'
UOP = 'not' | '-' | '+' | '~' | 'await'
AUG = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '**='
file = stmt
hole = exprs | yield
""".replace("none = ''?", "none = NEVER?"),
    {"ID": "i", "NUM": "n", "STR": "s", "BYTES": "y", "NL": "\n", "NEVER": "\x01"},
    also={t: ("ID",) for t in ("match", "case", "type")},
    lists={"block": ("stmt", ("NL", "D")), "cases": ("case", ("NL", "D")), "file": ("stmt", ("NL", "D"))},
    commas={"row": ("sexpr", True, True), "pairs": ("pair", True, False), "subscript": ("sub", True, False), "dlist": ("del", True, True), "patseq": ("pat", True, True), "patmap": ("mapitem", True, True), "tlist": ("target", True, False)},
)
STRING = r"(?:[rR][bBfF]?|[bBfF][rR]?|[uU])?(?:\"\"\"(?:[^\\\"]|\\.|\"(?!\"\"))*\"\"\"|'''(?:[^\\']|\\.|'(?!''))*'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')"
TOKEN = re.compile(
    STRING + r"|[ \t\f]+|#[^\n]*|\\\n|(?:\n[ \t\f]*(?:#[^\n]*)?)+|[^\W\d]\w*|0[xX](?:_?[0-9a-fA-F])+(?!\w)|0[oO](?:_?[0-7])+(?!\w)|0[bB](?:_?[01])+(?!\w)"
    r"|(?:(?:[1-9](?:_?\d)*|0(?:_?0)*)(?![\w.])|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*[jJ]?|[jJ]))(?!\w)"
    r"|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\*\*|//|<<|>>|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|.",
    re.S,
)
INDENT = 0xF0000  # plus the width: a line's start


def _classify(t: str) -> str:
    if t[0] == "\n":
        last = t[t.rindex("\n") + 1 :]
        if "#" in last:
            return chr(INDENT + 9999)
        width = 0
        for c in last:
            width = 0 if c == "\f" else width // 8 * 8 + 8 if c == "\t" else width + 1
        return chr(INDENT + min(width, 9998))
    if t[-1] in "\"'":
        return _string(t) if len(t) > 1 else BAD
    if t[0] == "#" or t.isspace() or t == "\\\n":
        return ""
    if t[0].isdigit() or t[0] == "." and len(t) > 1:
        return "n"
    return "i" if t.isidentifier() else BAD


def _string(t: str) -> str:
    """The class of a string; of bytes all letters are ASCII, and the holes of a formatted one are expressions."""
    prefix = t[: re.search("[\"']", t).start()].lower()
    if "b" in prefix:
        return "y" if t.isascii() else BAD
    if "f" in prefix:
        body = t[len(prefix) :]
        ends = 3 if body[:3] in ('"""', "'''") and len(body) >= 6 else 1
        return "s" if _holes(body[ends:-ends], "r" in prefix, 0) else BAD
    return "s"


#: What a hole holds, token by token, up to what ends its expression.
_IN_HOLE = re.compile(STRING + r"|[()\[\]{}]|!=|[<>=]=|:|!|\\|[^\"'()\[\]{}!:=<>\\]+|.", re.S)


def _holes(body: str, raw: bool, depth: int) -> bool:
    """Whether all holes of a formatted string, or of a format in a hole, are whole and hold expressions."""
    at = 0
    while m := re.compile(r"\\N\{[^}]*\}|\\.|\{\{|\}\}|[{}]" if not raw else r"\{\{|\}\}|[{}]", re.S).search(body, at):
        at = m.end()
        sign = m.group()
        if sign[0] == "\\" or sign in ("{{", "}}") and not depth:
            continue
        if sign[0] == "}":
            return False
        if sign == "{{":
            at -= 1
        begin, nested = at, 0
        while (x := _IN_HOLE.match(body, at)) and (nested or x.group() not in ("}", ":", "!")):
            nested += (x.group() in "([{") - (x.group() in ")]}") if len(x.group()) == 1 else 0
            at = x.end()
        if x is None:
            return False
        held = re.sub(r"(?<![=<>!])=\s*\Z", "", body[begin:at])
        text = GRAMMAR.reduce(STARTS.sub("", "".join(map(KINDS.__getitem__, TOKEN.findall(held)))))
        if text is None or not GRAMMAR.derived(text, "hole")[0]:
            return False
        if x.group() == "!":
            conversion = re.compile(r"\s*[rsa]\s*(?=[:}])").match(body, x.end())
            if not conversion:
                return False
            at = conversion.end()
        if body[at] == ":":
            begin, nested = at + 1, 0
            for y in re.compile(r"[{}]").finditer(body, begin):
                if y.group() == "}" and not nested:
                    break
                nested += 1 if y.group() == "{" else -1
            else:
                return False
            if depth > 1 or not _holes(body[begin : y.start()], raw, depth + 1):
                return False
            at = y.start()
        at += 1
    return True


KINDS = Kinds(GRAMMAR.tokens | {c: c for c in "()[]{}"}, _classify)
STARTS = re.compile(f"[{chr(INDENT)}-{chr(INDENT + 9999)}]+")
LINE = re.compile(f"([{chr(INDENT)}-{chr(INDENT + 9999)}])([^{chr(INDENT)}-{chr(INDENT + 9999)}]+)")
for _name in ("P", "K", "B"):
    GRAMMAR.content[_name] = lambda t: STARTS.sub("", t)
COLON = GRAMMAR.char(":")


def valid(source: str) -> bool:
    source = "\n" + source.removeprefix("\ufeff").replace("\r\n", "\n").replace("\r", "\n")
    text = GRAMMAR.reduce("".join(map(KINDS.__getitem__, TOKEN.findall(source))))
    if text is None:
        return False
    # Indentation is a kind of bracket: an indented block becomes one character, the innermost first.
    levels: list[tuple[int, list[str]]] = [(0, [])]

    def close() -> None:
        _, lines = levels.pop()
        inner = "".join(lines)
        header = levels[-1][1]
        if header and header[-1].endswith(COLON + "\n"):
            header[-1] = header[-1][:-1]
        header.append(block(inner))

    for start, line in LINE.findall(text):
        width = ord(start) - INDENT
        if width > levels[-1][0]:
            if not levels[-1][1] or not levels[-1][1][-1].endswith(COLON + "\n"):
                return False
            levels.append((width, []))
        while width < levels[-1][0]:
            close()
        if width != levels[-1][0]:
            return False
        levels[-1][1].append(line + "\n")
    while len(levels) > 1:
        close()
    return GRAMMAR.sequence("".join(levels[0][1]), "file")


_blocks: dict[str, str] = {}


def block(inner: str) -> str:
    known = _blocks.get(inner)
    if known is None:
        if len(_blocks) > 100_000:
            _blocks.clear()
        known = _blocks[inner] = GRAMMAR.stand_in("D", GRAMMAR.matches(inner, GRAMMAR.wanted["D"]))
    return known
