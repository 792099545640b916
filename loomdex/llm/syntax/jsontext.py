"""JSON as RFC 8259 has it."""

from __future__ import annotations

import re

from loomdex.llm.syntax.gll import BAD, Grammar, Kinds

GRAMMAR = Grammar(
    """
text = value
value = STR | NUM | 'true' | 'false' | 'null' | B:members | K:values
values = value
members = member
member = STR ':' value
""",
    {"STR": "s", "NUM": "n"},
    commas={"values": ("value", False, True), "members": ("member", False, True)},
)
TOKEN = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|[ \t\r\n]+|[A-Za-z_]+|.', re.S)


def _classify(t: str) -> str:
    if t[0] == '"' and len(t) > 1:
        return "s"
    if t[0].isspace():
        return "" if not t.strip(" \t\r\n") else BAD
    return "n" if t[-1].isdigit() and t[0] in "-0123456789" else BAD


KINDS = Kinds(GRAMMAR.tokens | {c: c for c in "[]{}"}, _classify)


def valid(source: str) -> bool:
    text = "".join(map(KINDS.__getitem__, TOKEN.findall(source.removeprefix("\ufeff"))))
    text = GRAMMAR.reduce(text)
    return text is not None and GRAMMAR.derived(text, "text")[0]
