"""CSS, with nesting and custom properties."""

from __future__ import annotations

import re

from loomdex.llm.syntax.gll import BAD, Grammar, Kinds

GRAMMAR = Grammar(
    """
sheet = rule
rule = selectors B:body | at | CDO
at = AT prelude? ( ';' | B:body )
prelude = ( any | ',' | ':' | '>' | '<' | '=' | '+' | '*' | '/' | '.' | '!' )+
body = entry
entry = selectors B:body | at | decl? ';'
selectors = comb? complex ( ',' comb? complex )*
complex = compound ( comb? compound )*
comb = '>' | '+' | '~' | '|' '|'
compound = ( ID | '*' | '&' | HASH | NUM | '.' ID | ':' ':'? ID P:inner? | K:inner | '|' )
inner = ( any | ',' | ':' | '>' | '<' | '=' | '+' | '*' | '/' | '.' | '~' | '|' | '^' | '$' | '&' | '!' | '-' | '%' | ';' | AT | CDO )*
any = ID | NUM | STR | HASH | URL | ID? P:inner | K:inner
decl = ID ':' value* ( '!' ID )? | VAR ':' inner B:inner? inner
value = any | ',' | '/' | '+' | '-' | '*' | '=' | '.' | B:inner
""",
    {"ID": "i", "NUM": "n", "STR": "s", "HASH": "h", "URL": "u", "AT": "a", "VAR": "v", "CDO": "c"},
    also={},
    lists={"sheet": ("rule", (";", "B")), "body": ("entry", (";", "B"))},
)
SEMI = GRAMMAR.char(";")
GRAMMAR.sets["ID"].add("v")
GRAMMAR.content["body"] = lambda t: t + SEMI
TOKEN = re.compile(
    r"\s+|/\*.*?\*/|<!--|-->|(?i:url)\(\s*[^\s\"'()\\]*\s*\)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|--(?:[\w-]|[^\x00-\x7f]|\\.)*|@-?(?:[A-Za-z_]|[^\x00-\x7f])[\w-]*|#(?:[\w-]|[^\x00-\x7f]|\\.)+"
    r"|[+-]?(?:\d+(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?:%|[A-Za-z]+\b)?|-?(?:[A-Za-z_]|[^\x00-\x7f]|\\[^\n])(?:[\w-]|[^\x00-\x7f]|\\[^\n])*|.",
    re.S,
)


def _classify(t: str) -> str:
    if t.isspace() or t[:2] == "/*" and len(t) > 3:
        return ""
    if t in ("<!--", "-->"):
        return "c"
    if t[0] in "\"'":
        return "s" if len(t) > 1 else BAD
    if t[:2] == "--":
        return "v"
    if t[0] == "@" and len(t) > 1:
        return "a"
    if t[0] == "#" and len(t) > 1:
        return "h"
    if t[:4].lower() == "url(":
        return "u"
    if any(c.isdigit() for c in t[:3]) and t[0] in "+-.0123456789":
        return "n"
    return "i" if len(t) > 1 or t.isalpha() or t == "_" or ord(t) > 127 else BAD


KINDS = Kinds(GRAMMAR.tokens | {c: c for c in "()[]{}"}, _classify)


def valid(source: str) -> bool:
    text = GRAMMAR.reduce("".join(map(KINDS.__getitem__, TOKEN.findall(source.removeprefix("\ufeff")))))
    return text is not None and GRAMMAR.sequence(text, "sheet")
