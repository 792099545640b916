"""JavaScript and TypeScript: one grammar, in which the dialect without types leaves the typed forms out."""

from __future__ import annotations

import re

from loomdex.llm.syntax.gll import BAD, Grammar, Kinds

RULES = """
block = stmt
module = stmt
E = ';' | NL
stmt = decl E | open
open = func | class | if | for | while | do | %with | switch | try | B:block | label | ';' | NL | exportopen | %otheropen
with = 'with' P:row NL? stmt
func = 'async'? 'function' '*'? ID? fsig B:block
fsig = @tp P:params @ret
class = deco* @abstract 'class' ID? @tp ( 'extends' lhs @targs )? @implements NL? B:members
deco = '@' ID ( '.' ID )* P:args? NL?
exportopen = %exports
exports = 'export' 'default'? ( func | deco* class ) | deco* 'export' 'default'? class | %exportopen
if = 'if' P:row NL? stmt ( NL? 'else' NL? stmt )?
while = 'while' P:row NL? stmt
do = 'do' NL? stmt NL? 'while' P:row ( E? | stmt )
for = 'for' 'await'? P:forhead NL? stmt
forhead = ( vars | exprs )? ';' exprs? ';' exprs? | ( ( 'const' | 'let' | 'var' | 'using' ) target @ann | aim | B:objpattern | K:arrpattern ) ( 'of' assign | 'in' exprs )
switch = 'switch' P:row NL? B:cases
cases = caseitem
caseitem = ( ( 'case' exprs | 'default' ) ':' NL? )* stmt | ( ( 'case' exprs | 'default' ) ':' NL? )+
try = 'try' NL? B:block NL? ( 'catch' P:catch? NL? B:block NL? ( 'finally' NL? B:block )? | 'finally' NL? B:block )
catch = target @ann
label = ID ':' NL? stmt
decl = vars | exprs | 'return' exprs? | 'throw' exprs | 'break' ID? | 'continue' ID? | 'debugger' | %module | do | %otherdecl
vars = ( 'let' | 'var' ) var ( ',' var )* | ( 'const' | 'using' ) fixed ( ',' fixed )*
var = ID @ann ( '=' assign )? | fixed
fixed = target @ann '=' assign | %fixed
target = ID | B:objpattern | K:arrpattern
objpattern = oprop
oprop = ID ( '=' assign )? | key ':' element | '...' ID
element = target ( '=' assign )? | aim ( '=' assign )?
arrpattern = hole
hole = ( '...'? element )?
module_ = import | export
import = %importas | 'import' ( STR | importwhat 'from' STR ) importwith?
importwith = ( 'with' | 'assert' ) B:object
importwhat = @type ( ID ( ',' ( '*' 'as' ID | B:names ) )? | '*' 'as' ID | B:names )
names = ( name ( ',' name )* ','? )?
name = @type ( anyname | STR ) ( 'as' ( anyname | STR ) )?
export = %exportas | 'export' ( vars | @type B:names ( 'from' STR importwith? )? | @type '*' ( 'as' ( anyname | STR ) )? 'from' STR importwith? | 'default' assign | %exportdecl )
exprs = assign ( ',' assign )*
row = assign
assign = cond | aim ASSIGN assign | ( B:objpattern | K:arrpattern ) '=' assign | arrow | 'yield' ( '*'? assign )?
arrow = 'async'? ( ID | @tp P:params @ret ) '=>' ( assign | B:block )
cond = bin ( '?' assign ':' assign )?
bin = bor ( ( '||' | '&&' ) bor )* | bor ( '??' bor )+
bor = term @as ( BOP term @as )*
term = un | post '**' term
un = %cast UOP* ( post | ( '++' | '--' ) aim )
post = lhs | aim ( '++' | '--' )
aim = ID | lhs member | P:aimed | %aim
aimed = aim
member = '.' ( anyname | PRIV ) | K:row
lhs = 'new'* primary suffix*
primary = ID | NUM | STR | TPL | RE | PRIV | P:row | K:array | B:object | 'function' '*'? ID? fsig B:block | 'async' 'function' '*'? ID? fsig B:block | deco* 'class' ID? @tp ( 'extends' lhs @targs )? @implements B:members | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' P:args | 'import' '.' ID | 'new' '.' ID
suffix = '.' ( anyname | PRIV ) | '?.' ( anyname | PRIV | P:args | K:row ) | K:row | P:args | TPL | %suffix
args = arg
arg = '...'? assign
array = slot
slot = ( '...'? assign )?
object = prop
prop = ID | key ':' assign | '...' assign | method
key = anyname | STR | NUM | K:assign1
assign1 = assign
method = ( 'async' | 'get' | 'set' | 'static' )* '*'? ( key | PRIV ) @opt fsig B:block
params = ( param ( ',' param )* ','? )?
param = deco* @mods '...'? target @opt @ann ( '=' assign )? | %thisparam
members = member
member = deco* @modsmember method E? | deco* @modsmember 'static'? 'accessor'? ( key | PRIV ) @optfield @ann ( '=' assign )? E | 'static' B:block E? | E | %othermember
anyname = ID | KW
BOP = '|' | '^' | '&' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '<<' | '>' '>' | '>' '>' '>' | '+' | '-' | '*' | '/' | '%' | 'in' | 'instanceof'
UOP = '!' | '~' | '+' | '-' | 'typeof' | 'void' | 'delete' | 'await'
ASSIGN = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??='
"""
#: What the forms with @ and the alternatives with % are in TypeScript; in JavaScript they are nothing.
TYPED = {
    "tp": "tp?", "ret": "ret?", "abstract": "( 'abstract' | 'declare' )*", "targs": "targs?", "implements": "( 'implements' type ( ',' type )* )?", "ann": "( '!'? ':' type )?", "type": "( 'type' | 'typeof' )?",
    "as": "( 'as' 'const' | ( 'as' | 'satisfies' ) type )*", "suffix": "'!' | targs P:args | targs TPL", "opt": "( '?' )?", "thisparam": "'this' ':' type", "optfield": "( '?' | '!' )?", "mods": "MOD*", "modsmember": "( MOD | 'abstract' | 'override' | 'declare' )*",
    "otheropen": "'declare'? ( interface | enum | namespace ) | overload E", "exportopen": "'export' 'default'? 'declare'? ( interface | enum | namespace ) | 'export' 'default'? overload E", "otherdecl": "'declare'? alias | 'declare' ( ambient | class )",
    "exportdecl": "'declare'? alias | 'declare' ( ambient | class ) | '=' assign", "exportas": "'export' 'as' 'namespace' ID", "importas": "'import' @type ID '=' ( 'require' P:args | ID ( '.' ID )* )", "fixed": "ID ( '!'? ':' type )", "cast": "( '<' ( type | 'const' ) '>' )*", "aim": "lhs '!' | P:row", "othermember": "index E | ( MOD | 'abstract' | 'override' )* ( 'async' | 'get' | 'set' | 'static' )* '*'? ( key | PRIV ) '?'? fsig E",
}
TYPES = """
tp = '<' tparam ( ',' tparam )* ','? '>'
tparam = ( 'const' | 'in' | 'out' )* ID ( 'extends' type )? ( '=' type )?
ret = ':' ( 'asserts'? ID 'is' type | 'asserts' ID | type )
targs = '<' type ( ',' type )* '>'
type = cond1 | 'new'? @tp P:fparams '=>' ( 'asserts'? ID 'is' type | type ) | 'abstract' 'new' @tp P:fparams '=>' type
cond1 = union ( 'extends' union '?' type ':' type )?
union = '|'? inter ( '|' inter )*
inter = '&'? tun ( '&' tun )*
tun = ( 'keyof' | 'readonly' | 'unique' | 'infer' )* tpost
tpost = tatom ( K:ttype? )*
tatom = ( ID | 'void' | 'null' | 'this' | 'undefined' ) ( '.' ID )* targs? | 'typeof' ( ID | 'this' | 'import' P:args ) ( '.' ( anyname | PRIV ) )* targs? | 'import' P:args ( '.' ID )* targs? | STR | '-'? NUM | TPL | 'true' | 'false' | P:ptype | K:tuple | B:typebody
ttype = type?
ptype = type
tuple = titem
titem = ( '...'? ID '?'? ':' )? '...'? type '?'?
fparams = params | ( type ( ',' type )* )?
typebody = mapped | ( tmember ( TS+ tmember )* TS* )? | TS+
TS = ';' | ',' | NL
tmember = MOD* ( 'get' | 'set' )? key '?'? ( ':' type )? | MOD* ( 'get' | 'set' )? key? '?'? fsig | 'new' fsig | index
index = MOD* 'static'? K:indexer ':' type
indexer = ID ':' type
mapped = NL* ( ( '+' | '-' )? 'readonly' )? K:mapper ( ( '+' | '-' )? '?' )? ( ':' type )? TS*
mapper = ID 'in' type ( 'as' type )?
interface = 'interface' ID tp? ( 'extends' type ( ',' type )* )? B:typebody
enum = 'const'? 'enum' ID B:enumbody
enumbody = ( ename ( ',' ename )* ','? )?
ename = key ( '=' assign )?
namespace = ( 'namespace' | 'module' | 'global' ) ( ID ( '.' ID )* | STR )? B:block
overload = 'declare'? 'async'? 'function' '*'? ID fsig
alias = 'type' ID tp? '=' type
ambient = vars | 'const' target @ann ( ',' target @ann )*
MOD = 'public' | 'private' | 'protected' | 'readonly' | 'static'
"""
# Reserved words, and those that are words only in their places.
RESERVED = "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new null return super switch this throw true false try typeof var void while with enum".split()
CONTEXTUAL = "as async await declare from get set let of static yield type interface namespace module abstract implements public private protected readonly override keyof infer unique is asserts satisfies using accessor global out assert undefined".split()


#: The alternatives that only modules, and only scripts that are none, have; strict code knows no ``with``.
MODULE, SLOPPY = {"module": "module_", "exports": "exports"}, {"with": "with"}


def _grammar(typed: bool, module: bool) -> Grammar:
    text = RULES + (TYPES if typed else "")
    given = (TYPED if typed else {}) | (MODULE if module else SLOPPY)
    text = re.sub(r"[@%](\w+)", lambda m: given.get(m[1], m[0]), text)
    text = re.sub(r"[@%](\w+)", lambda m: given.get(m[1], m[0]), text)  # some forms hold others
    if not module:
        text = text.replace(" | exportopen", "").replace("exportopen = %exports\n", "")
    text = re.sub(r"^(\w+ =) %\w+ \| ", r"\1 ", text, flags=re.M)
    text = re.sub(r" \| %\w+|[@%]\w+", "", text)
    also = {t: ("ID",) for t in CONTEXTUAL} | {t: ("KW",) for t in RESERVED}
    if not typed:
        also = {t: (*w,) for t, w in also.items()}
    drop = lambda t: t.replace("\n", "")
    content = {"P": drop, "K": drop} | {n: drop for n in ("object", "objpattern", "names", "enumbody")} | {n: lambda t: t + "\n" for n in ("block", "cases", "members")}
    return Grammar(text, {"ID": "i", "NUM": "n", "STR": "s", "TPL": "t", "RE": "r", "PRIV": "p", "NL": "\n"}, also=also, content=content, lists={"block": ("stmt", (";", "NL", "B")), "module": ("stmt", (";", "NL", "B")), "cases": ("caseitem", (";", "NL", "B")), "members": ("member", (";", "NL", "B"))}, commas=({"tuple": ("titem", True, True)} if typed else {}) | {"array": ("slot", True, True), "row": ("assign", False, False), "arrpattern": ("hole", True, True), "objpattern": ("oprop", True, True), "object": ("prop", True, True), "args": ("arg", True, True)})


_S, _D = r"'(?:[^'\\\n]|\\.)*'", r'"(?:[^"\\\n]|\\.)*"'
_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"
_BEFORE = r"(?:(?<=[(,=:\[!&|?{};+\-*%~^<>])|(?<=\breturn)|(?<=\bcase)|(?<=\btypeof)|(?<=\bof)|(?<=\bin)|(?<=\bdelete)|(?<=\bvoid)|(?<=\bthrow)|(?<=\bnew)|(?<=\belse)|(?<=\bdo)|(?<=\bawait)|(?<=\byield)|(?<=\A))"
TOKEN = re.compile(
    _BEFORE + r"(?:\s|" + _COMMENT + r")*/(?![/*])(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*"
    + r"|[^\S\n]+|\n\s*|" + _COMMENT + "|" + _S + "|" + _D + r"|#?(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$]|\\u[0-9a-fA-F]{4})*"
    + r"|0[xX][0-9a-fA-F_]+n?(?![\w$])|0[oO][0-7_]+n?(?![\w$])|0[bB][01_]+n?(?![\w$])|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?n?(?![\w$])"
    + r"|>>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|.",
    re.S,
)
#: The text of a template literal up to a hole or its end.
TEXT = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*", re.S)


def template(source: str, at: int) -> tuple[int, list[str]] | None:
    """Where the template literal that begins at ``at`` ends, and what its own holes hold; None if it has no end.

    A hole is read token by token, for braces, strings, comments, regular expressions and further templates may stand in it, as deep as they like.
    """
    stack, holes, begin, at = ["`"], [], 0, at + 1
    while stack:
        if stack[-1] == "`":
            at = TEXT.match(source, at).end()
            if source.startswith("${", at):
                at += 2
                begin = at if len(stack) == 1 else begin
                stack.append("${")
            elif source.startswith("`", at):
                at += 1
                stack.pop()
            else:
                return None
        elif m := TOKEN.match(source, at):
            t, at = m.group(), m.end()
            if t in ("{", "`"):
                stack.append(t)
            elif t == "}" and stack.pop() == "${" and len(stack) == 1:
                holes.append(source[begin : at - 1])
        else:
            return None
    return at, holes


def tokens(source: str) -> list[str]:
    """The tokens of a source; a template literal is one, a backtick alone is one that has no end."""
    if "`" not in source:
        return TOKEN.findall(source)
    out, at = [], 0
    while m := TOKEN.match(source, at):
        end = template(source, at) if m.group() == "`" else None
        now = end[0] if end else m.end()
        out.append(source[at:now])
        at = now
    return out


class Dialect:
    """A grammar with its tokens."""

    def __init__(self, typed: bool, module: bool = True):
        self.grammar = g = _grammar(typed, module)
        for t in RESERVED:
            g.char(t)
        # A shift is several signs, for they may also end as many lists of type arguments.
        self.kinds = Kinds(g.tokens | {c: c for c in "()[]{}"} | {">>": g.char(">") * 2, ">>>": g.char(">") * 3}, self._classify)
        ch = g.char
        binary = [t for t in (*"; , . ? : = + - * / % & | ^ < > == != === !== <= >= && || ?? => ?. ** << += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= ...".split(), "in", "instanceof") if t in g.tokens]
        no_end = "".join(map(re.escape, (*map(ch, binary), *map(ch, ("!", "~", "(", "[", "{", "else", "do", "const", "new", "typeof", "void", "delete", "case", "function", "class", "extends", "import", "export", "default", "var", "throw", "if", "for", "while", "switch")))))
        no_begin = "".join(map(re.escape, (*map(ch, binary), *map(ch, (")", "]", "(", "[", "}"))))).replace(re.escape(ch("...")), "")
        self.after, self.before = re.compile(f"(?<=[{no_end}])\n+"), re.compile(f"\n+(?=[{no_begin}])")

    def _classify(self, t: str) -> str:
        if t[0] == "\n":
            return "\n"
        if t.isspace():
            return ""
        if t[0] in "\"'":
            return "s" if len(t) > 1 else BAD
        if t[0] == "`":
            whole = template(t, 0)
            return "t" if whole and all(self.expression(h) for h in whole[1]) else BAD
        bare = t if t[0] == "/" else re.sub(r"^(?:\s|" + _COMMENT + ")*", "", t)
        if t[:2] in ("//", "/*") and (not bare or bare == t):
            return ("\n" if "\n" in t else "") if t[:2] == "//" or len(t) > 3 else BAD
        if bare[:1] == "/" and len(bare) > 1:
            return "r"
        if t[0] == "#":
            return "p" if len(t) > 1 else BAD
        if t[0].isdigit() or t[0] == "." and len(t) > 1:
            return "n"
        return "i" if t[0].isalpha() or t[0] in "_$\\" and t != "\\" else BAD

    def characters(self, source: str) -> str:
        text = "".join(map(self.kinds.__getitem__, tokens(source)))
        return self.before.sub("", self.after.sub("", text))

    def expression(self, source: str) -> bool:
        if re.fullmatch(r"\s*[A-Za-z_$][\w$.]*\s*", source):
            return True
        text = self.grammar.reduce(self.characters(source))  # line ends within its blocks count
        return text is not None and self.grammar.derived(text.replace("\n", ""), "exprs")[0]

    def valid(self, source: str) -> bool:
        source = re.sub(r"\A#![^\n]*", "", source.removeprefix("﻿"))
        text = self.grammar.reduce(self.characters(source))
        return text is not None and self.grammar.sequence(text + "\n", "module")


#: Code of modules, code of scripts, which is not strict, and typed code.
SCRIPT, SLOPPY_SCRIPT, TYPESCRIPT = Dialect(False), Dialect(False, False), Dialect(True)
GRAMMAR = TYPESCRIPT.grammar
