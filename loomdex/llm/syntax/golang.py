"""Go, with type parameters."""

from __future__ import annotations

import re

from loomdex.llm.syntax.gll import BAD, Grammar, Kinds

GRAMMAR = Grammar(
    """
file = package ';' ( import ';' )* ( decl ';' )*
package = 'package' ID
import = 'import' ( spec1 | P:imports )
imports = ( spec1 ( ';' spec1 )* ';'? )?
spec1 = ( ID | '.' )? STR
decl = func | other
func = 'func' ID K:typeparams? sig B:block? | 'func' P:params ID sig B:block?
other = 'type' ( typespec | P:typespecs ) | 'var' ( varspec | P:varspecs ) | 'const' ( constspec | P:constspecs )
typespecs = ( typespec ( ';' typespec )* ';'? )?
typespec = ID K:typeparams? '='? type
varspecs = ( varspec ( ';' varspec )* ';'? )?
varspec = ids type ( '=' exprs )? | ids '=' exprs
constspecs = ( constspec ( ';' constspec )* ';'? )?
constspec = ids ( type? '=' exprs )?
ids = ID ( ',' ID )*
sig = P:params result?
result = type
params = ( named ( ',' named )* ','? | untyped ( ',' untyped )* ','? )?
named = ID ( ',' ID )* '...'? type
untyped = '...'? type
typeparams = tparam ( ',' tparam )* ','?
tparam = ID constraint | ID
constraint = '~'? type ( '|' '~'? type )*
type = tname | '*' type | K:arraylen type | 'map' K:onetype type | 'chan' '<-'? type | '<-' 'chan' type | 'func' sig | 'struct' B:fields | 'interface' B:methods | P:onetype | P:params
onetype = type
tname = ID ( '.' ID )? K:types?
types = type ( ',' type )* ','?
arraylen = expr? | '...'
fields = ( field ( ';' field )* ';'? )?
field = ids type STR? | '*'? tname STR?
methods = ( method ( ';' method )* ';'? )?
method = ID sig | constraint
exprs = expr ( ',' ( expr | ROW ) )*
expr = unary ( BINOP unary )*
unary = UNOP* primary
primary = operand suffix* | complit suffix*
call = ( operand | complit ) suffix* P:args
operand = ID | NUM | STR | P:paren | 'func' sig B:block | conv P:args
conv = K:arraylen type | 'map' K:onetype type | 'chan' type | 'interface' B:methods | 'struct' B:fields | 'func' sig
complit = ( ID ( '.' ID )? K:types? | K:arraylen type | 'map' K:onetype type | 'struct' B:fields ) B:elements
suffix = '.' ID | '.' P:assertion | K:index | P:args
paren = expr | type
assertion = type | 'type'
args = arg
arg = expr '...'? | type
index = expr | types | expr? ':' expr? | expr? ':' expr ':' expr
elements = element
element = ( value ':' )? value
value = expr | B:elements
hexpr = hunary ( BINOP hunary )*
hunary = UNOP* hprimary
hprimary = operand suffix*
hexprs = hexpr ( ',' ( hexpr | ROW ) )*
simple = exprs | exprs ASSIGN exprs | exprs ':=' exprs | expr INCDEC | expr '<-' expr
hsimple = hexprs | hexprs ASSIGN hexprs | hexprs ':=' hexprs | hexpr INCDEC | hexpr '<-' hexpr
stmt = simple | other | 'go' call | 'defer' call | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | B:block | if | for | switch | select | ID ':' stmt?
if = 'if' ( hsimple? ';' )? hexpr B:block ( 'else' ( if | B:block ) )?
for = 'for' ( hexpr? | hsimple? ';' hexpr? ';' hsimple? | ( hexprs ( '=' | ':=' ) )? 'range' hexpr ) B:block
switch = 'switch' ( hsimple? ';' )? hsimple? B:cases
select = 'select' B:comms
item = stmt? ';'
block = item
caseitem = ( ( 'case' arg ( ',' ( arg | ROW ) )* | 'default' ) ':' )* stmt? ';'
commitem = ( ( 'case' simple | 'default' ) ':' )* stmt? ';'
fileitem = ( package | import | decl )? ';'
toplevel = fileitem
cases = caseitem
comms = commitem
BINOP = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^'
UNOP = '+' | '-' | '!' | '^' | '*' | '&' | '<-' | '~'
ASSIGN = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^='
INCDEC = '++' | '--'
""",
    {"ID": "i", "NUM": "n", "STR": "s", "ROW": "r"},
    content={name: lambda t: t if not t or t.endswith(SEMI) else t + SEMI for name in ("block", "cases", "comms")},
    lists={"block": ("item", (";",)), "cases": ("caseitem", (";",)), "comms": ("commitem", (";",)), "toplevel": ("fileitem", (";",))},
    commas={"elements": ("element", True, True), "args": ("arg", True, True)},
    folds=dict.fromkeys(("item", "caseitem", "commitem", "fileitem"), ("ROW", "expr", "type")),
)
SEMI = GRAMMAR.char(";")
_ch = GRAMMAR.char
TOKEN = re.compile(
    r"[ \t\r]+|//[^\n]*|/\*.*?\*/|\n|[^\W\d]\w*|`[^`]*`|\"(?:[^\"\\\n]|\\[^\n])*\"|'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'"
    r"|0[xX](?:_?[0-9a-fA-F])+(?:\.(?:[0-9a-fA-F_])*)?(?:[pP][+-]?\d+)?i?(?!\w)|0[bB](?:_?[01])+i?(?!\w)|0[oO]?(?:_?[0-7])+i?(?![\w.])|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?i?(?!\w)"
    r"|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|.",
    re.S,
)


def _classify(t: str) -> str:
    if t == "\n":
        return "\n"
    if t[:2] == "//" or t.isspace():
        return ""
    if t[:2] == "/*":
        return ("\n" if "\n" in t else "") if len(t) > 3 else BAD
    if t[0] in "\"`'":
        return "s" if len(t) > 1 else BAD
    if t[0].isdigit() or t[0] == "." and len(t) > 1:
        return "n"
    return "i" if t[0].isalpha() or t[0] == "_" else BAD


KINDS = Kinds(GRAMMAR.tokens | {c: c for c in "()[]{}"}, _classify)
#: A line that ends in one of these ends a statement.
ENDS = "ins)\\]}" + "".join(map(_ch, ("break", "continue", "fallthrough", "return", "++", "--")))
AUTO, REST = re.compile(f"(?<=[{ENDS}])\n"), re.compile("\n")


def valid(source: str) -> bool:
    text = "".join(map(KINDS.__getitem__, TOKEN.findall(source.removeprefix("\ufeff") + "\n")))
    text = GRAMMAR.reduce(REST.sub("", AUTO.sub(SEMI, text)))
    if text is None:
        return False
    text = text if text.endswith(SEMI) else text + SEMI
    items = [x for x in text.split(SEMI) if x]
    # The package clause is first and once, imports come before other declarations.
    kinds = ["p" if x[0] == _ch("package") else "i" if x[0] == _ch("import") else "d" for x in items]
    return re.fullmatch("pi*d*", "".join(kinds)) is not None and GRAMMAR.sequence(text, "toplevel")
