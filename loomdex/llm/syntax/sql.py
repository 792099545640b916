"""SQL: the common statements, with the forms of PostgreSQL, MySQL and SQLite in one grammar."""

from __future__ import annotations

import re

from loomdex.llm.syntax.gll import BAD, Grammar, Kinds

GRAMMAR = Grammar(
    """
script = item
item = stmt? ';'
stmt = query | insert | update | delete | create | alter | drop | 'truncate' 'table'? names | begin | 'set' ANY+ | 'pragma' ANY+ | 'use' name | 'grant' ANY+ | 'revoke' ANY+ | 'analyze' ANY* | 'vacuum' ANY* | ( 'explain' 'analyze'? | 'describe' ) stmt | 'comment' 'on' ANY+
begin = ( 'begin' | 'commit' | 'rollback' | 'end' ) ( 'transaction' | 'work' )? | 'start' 'transaction' | 'savepoint' ID | 'release' 'savepoint'? ID
query = with? body ( ( 'union' | 'intersect' | 'except' ) ( 'all' | 'distinct' )? body )* orderby? limit*
with = 'with' 'recursive'? cte ( ',' cte )*
cte = ID P:ids? 'as' ( 'not'? 'materialized' )? P:query
body = select | values | P:query | 'table' name
values = 'values' P:exprs ( ',' P:exprs )*
select = 'select' ( 'all' | 'distinct' ( 'on' P:exprs )? )? results ( 'from' tables )? ( 'where' e )? ( 'group' 'by' ( 'all' | groups ) )? ( 'having' e )? ( 'window' ID 'as' P:over ( ',' ID 'as' P:over )* )? ( 'qualify' e )?
results = result ( ',' result )*
result = '*' | name '.' '*' | e ( 'as'? alias )?
alias = ID | STR | DQ
tables = tablerefs
tablerefs = tableref ( ',' tableref )*
tableref = source join*
source = ( name P:args? | P:query | P:tables | 'lateral' P:query | 'unnest' P:args ) ( 'with' 'ordinality' )? ( 'as'? ( ID | DQ ) P:ids? )?
join = 'natural'? ( 'inner' | ( 'left' | 'right' | 'full' ) 'outer'? | 'cross' )? 'join' source ( 'on' e | 'using' P:ids )?
groups = group ( ',' group )*
group = e | ( 'rollup' | 'cube' ) P:exprs | 'grouping' 'sets' P:any
orderby = 'order' 'by' order ( ',' order )*
order = e ( 'collate' name )? ( 'asc' | 'desc' )? ( 'nulls' ( 'first' | 'last' ) )?
limit = 'limit' e ( ( ',' | 'offset' ) e )? | 'offset' e ( 'row' | 'rows' )? | 'fetch' ( 'first' | 'next' ) e? ( 'row' | 'rows' ) 'only' | 'for' ( 'update' | 'share' )
insert = with? ( 'insert' ( 'or' ( 'replace' | 'ignore' | 'rollback' | 'abort' | 'fail' ) )? | 'replace' | 'insert' 'ignore' ) 'into' name ( 'as'? ID )? P:ids? ( query | 'default' 'values' ) conflict? returning?
conflict = 'on' 'conflict' ( P:exprs ( 'where' e )? )? 'do' ( 'nothing' | 'update' 'set' sets ( 'where' e )? ) | 'on' 'duplicate' 'key' 'update' sets
returning = 'returning' results
update = with? 'update' name ( 'as'? ID )? 'set' sets ( 'from' tables )? ( 'where' e )? returning?
sets = set ( ',' set )*
set = ( name | P:ids ) '=' e
delete = with? 'delete' 'from' name ( 'as'? ID )? ( 'using' tables )? ( 'where' e )? returning?
create = 'create' ( 'or' 'replace' )? ( 'temp' | 'temporary' | 'unlogged' )? 'table' ifnot? name ( P:columns tableopts | P:ids? 'as' query ) | 'create' 'unique'? 'index' 'concurrently'? ifnot? name? 'on' name ( 'using' ID )? P:orders ( 'where' e )? | 'create' ( 'or' 'replace' )? ( 'temp' | 'temporary' )? 'recursive'? 'materialized'? 'view' ifnot? name P:ids? 'as' query | 'create' ( 'schema' | 'database' ) ifnot? name | 'create' 'sequence' ifnot? name ANY* | 'create' 'type' name 'as' ANY+ | 'create' ( 'or' 'replace' )? ( 'function' | 'procedure' | 'trigger' | 'extension' | 'role' | 'user' ) ANY+
ifnot = 'if' 'not' 'exists'
tableopts = ( 'without' ID | ID '='? ( ID | STR | NUM ) | 'default' 'charset' '=' ID | 'partition' 'by' ID P:exprs | 'strict' | ',' | 'as' query | 'with' P:any )*
columns = column ( ',' column )*
column = colname type? constraint* | tableconstraint
colname = ID | DQ | STR
constraint = ( 'constraint' ID )? ( 'primary' 'key' ( 'asc' | 'desc' )? ( 'autoincrement' | 'auto_increment' )? | 'not' 'null' | 'null' | 'unique' | 'default' default | 'check' P:check | references | 'collate' name | 'auto_increment' | 'autoincrement' | 'comment' STR | 'generated' 'always' 'as' ( P:check ( 'stored' | 'virtual' )? | 'identity' P:any? ) | 'as' P:check ( 'stored' | 'virtual' )? | 'on' 'update' e )
default = sign? NUM | STR | 'null' | 'true' | 'false' | name P:args? | P:check | ( '+' | '-' ) NUM
sign = '+' | '-'
check = e
references = 'references' name P:ids? ( 'on' ( 'delete' | 'update' ) ( 'cascade' | 'restrict' | 'set' ( 'null' | 'default' ) | 'no' 'action' ) | 'match' ID | 'not'? 'deferrable' ( 'initially' ID )? )*
tableconstraint = ( 'constraint' name )? ( 'primary' 'key' P:orders | 'unique' ( 'key' | 'index' )? ID? P:orders | 'check' P:check | 'foreign' 'key' P:ids references | ( 'key' | 'index' ) ID? P:orders | 'exclude' ANY+ )
orders = order ( ',' order )*
alter = 'alter' 'table' ( 'if' 'exists' )? name action ( ',' action )* | 'alter' ( 'view' | 'index' | 'sequence' | 'schema' | 'database' | 'type' ) ANY+
action = 'add' 'column'? ifnot? colname type constraint* | 'add' tableconstraint | 'drop' ( 'column' | 'constraint' )? ( 'if' 'exists' )? name ( 'cascade' | 'restrict' )? | 'rename' ( 'column'? name )? 'to' name | ( 'alter' | 'modify' ) 'column'? name ( ( 'set' 'data' )? 'type' type ( 'using' e )? | 'set' 'not' 'null' | 'drop' ( 'not' 'null' | 'default' ) | 'set' 'default' e | type constraint* ) | 'owner' 'to' name
drop = 'drop' ( 'table' | 'view' | 'index' | 'schema' | 'database' | 'sequence' | 'trigger' | 'function' | 'type' | 'materialized' 'view' ) ( 'if' 'exists' )? names ( 'on' name )? ( 'cascade' | 'restrict' )?
names = name ( ',' name )*
name = part ( '.' part )*
part = ID | DQ | '@' ID
ids = id ( ',' id )*
id = name ( 'asc' | 'desc' )?
type = ( ID | 'double' ID | DQ ) ID* P:any? ( ID | 'with' 'time' 'zone' | 'without' 'time' 'zone' )* K:index*
exprs = ( e ( ',' e )* )?
e = not ( ( 'and' | 'or' ) not )*
not = 'not'* cmp
cmp = bin ( CMP ( 'any' | 'all' | 'some' )? bin | 'is' 'not'? ( 'null' | 'true' | 'false' | 'unknown' | 'distinct' 'from' bin | bin ) | 'not'? 'between' ( 'symmetric' )? bin 'and' bin | 'not'? 'in' ( P:exprs | P:query | name ) | 'not'? ( 'like' | 'ilike' | 'glob' | 'regexp' | 'rlike' | 'similar' 'to' ) bin ( 'escape' bin )? | 'isnull' | 'notnull' )*
bin = un ( BOP un )*
un = ( '+' | '-' | '~' )* post
post = atom ( '::' type | K:index | '.' ID | 'collate' name | 'at' 'time' 'zone' atom )*
index = e? ( ':' e? )?
atom = NUM | STR+ | 'null' | 'true' | 'false' | PARAM | name | call | P:exprs | P:query | 'exists' P:query | case | 'cast' P:cast | 'interval' ( STR | NUM ) ID? | ID STR | 'array' K:exprs | K:exprs | 'row' P:exprs | 'extract' P:extract | 'default'
call = fname P:args ( 'filter' P:where )? ( 'within' 'group' P:over )? ( 'over' ( ID | P:over ) )?
fname = name | 'left' | 'right' | 'replace' | 'any' | 'all' | 'if' | 'values'
args = ( 'distinct' | 'all' )? ( '*' | arg ( ',' arg )* ( orderby )? )? | query
arg = e | ID ( '=>' | ':=' ) e | '*'
where = 'where' e
over = ID? ( 'partition' 'by' e ( ',' e )* )? orderby? ( ( 'rows' | 'range' | 'groups' ) ANY+ )?
case = 'case' e? ( 'when' e 'then' e )+ ( 'else' e )? 'end'
cast = e 'as' type
extract = ( ID | STR ) 'from' e
any = ANY*
CMP = '=' | '==' | '<>' | '!=' | '<' | '<=' | '>' | '>=' | '<=>' | '~' | '!~'
BOP = '+' | '-' | '*' | '/' | '%' | '||' | '&' | '|' | '<<' | '>>' | '^' | '->' | '->>' | '#' | '//'
ANY = ID | NUM | STR | DQ | P:any | K:any | KEY | OP | PARAM
""",
    {"ID": "i", "NUM": "n", "STR": "s", "DQ": "q", "PARAM": "p"},
    lists={"script": ("item", (";",))},
)
# The words that are reserved in each of the dialects; the grammar's other words may be names.
RESERVED = set("all and as between case check create cross default distinct drop else end except exists from full group having in inner insert intersect into is join left like limit natural not null on or order outer primary references right select set table then union unique update using values when where with foreign constraint delete alter".split())
for _t, _c in list(GRAMMAR.tokens.items()):
    if _t[0].isalpha():
        GRAMMAR.sets["KEY"].add(_c)
        if _t not in RESERVED:
            GRAMMAR.sets["ID"].add(_c)
    elif _t != ";":
        GRAMMAR.sets["OP"].add(_c)
for _terminals, _chars in GRAMMAR.looks:
    _chars.update(*(GRAMMAR.sets[t] for t in _terminals))
GRAMMAR.sets["OP"].add("o")
SEMI = GRAMMAR.char(";")
TOKEN = re.compile(
    r"\s+|--[^\n]*|#(?=[ !])[^\n]*|/\*.*?\*/|[eEbBxXnN]?'(?:[^']|'')*'|\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`|\$\$.*?\$\$|\$(\w+)\$.*?\$\1\$|\$\d+|\?|(?<![:\w]):[A-Za-z_]\w*|@{1,2}[A-Za-z_]\w*|0[xX][0-9a-fA-F]+(?!\w)|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?!\w)"
    r"|[^\W\d][\w$]*|<=>|->>|->|=>|::|:=|<>|!=|<=|>=|==|\|\||<<|>>|!~|//|.",
    re.S,
)


def _classify(t: str) -> str:
    if t.isspace() or t[:2] in ("--", "/*") and (t[1] == "-" or len(t) > 3) or t[0] == "#" and len(t) > 1:
        return ""
    if t[-1] == "'" and len(t) > 1 or t[0] == "$" and t[-1] == "$" and len(t) > 3:
        return "s"
    if t[0] in "\"`":
        return "q" if len(t) > 1 else BAD
    if t[0] in "?:@$" and (len(t) > 1 or t == "?"):
        return "p"
    if t[0].isdigit() or t[0] == "." and len(t) > 1:
        return "n"
    if t[0].isalpha() or t[0] == "_":
        return GRAMMAR.tokens.get(t.lower(), "i")
    return BAD


KINDS = Kinds({k: v for k, v in GRAMMAR.tokens.items() if not k[0].isalpha()} | {c: c for c in "()[]{}"}, _classify)


def valid(source: str) -> bool:
    text = "".join(KINDS[m.group()] for m in TOKEN.finditer(source.removeprefix("﻿")))
    text = GRAMMAR.reduce(text)
    return text is not None and GRAMMAR.sequence(text + SEMI, "script")
