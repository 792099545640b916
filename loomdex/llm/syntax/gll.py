"""A generalised LL recogniser with a graph-structured stack, over texts reduced bracket by bracket.

A text becomes a string with one character for each token. An innermost pair of brackets is
recognised first: its content is parsed from all nonterminals that a bracket of its kind may hold, in
all dialects together, and the pair is replaced by a single character that stands for the set of
those that derive it. So every parse is of a short string, and equal strings, which are most, are parsed once
a worker. Within a parse all alternatives run together on one graph-structured stack; any
context-free grammar will do, left-recursive and ambiguous ones too.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: Strings whose result a Python worker remembers; cleared at so many. Only speed depends on it.
REMEMBER = 200_000
KINDS = {"(": "P", "[": "K", "{": "B", "\ue0f0": "D"}
#: The characters that stand for brackets of each kind.
BASE = {"P": 0x10000, "K": 0x12000, "B": 0x14000, "D": 0x16000}
RANGES = {kind: f"{chr(base)}-{chr(base + 0x1FFF)}" for kind, base in BASE.items()}


class Grammar:
    """A grammar in EBNF: lines ``name = alternatives``, with quoted tokens, token classes in capitals, P:name, K:name, B:name
    and D:name for brackets and their contents, and ``( )``, ``?``, ``*``, ``+`` as usual. A line that begins with a blank goes on.

    ``classes`` gives the character of each token class; quoted tokens get one each. ``also`` lists, for tokens that may
    stand for others (as keywords that may be names do), what else they are. ``content`` prepares the content of a kind of bracket.
    ``lists`` names the nonterminals that are sequences of items: (item, what ends one: tokens, classes, kinds of bracket), see sequence().
    ``commas`` names those that are items with commas between: (item, whether a comma may end them, whether they may be empty).
    ``folds`` names, for items of sequences that hold rows with commas, (class of a fold, what its members derive, what they don't), see folded().
    """

    def __init__(
        self, text: str, classes: dict[str, str], also: dict[str, tuple[str, ...]] | None = None, content: dict[str, Callable[[str], str]] | None = None,
        lists: dict[str, tuple[str, tuple[str, ...]]] | None = None, commas: dict[str, tuple[str, bool, bool]] | None = None, folds: dict[str, tuple[str, str, str]] | None = None,
    ):
        self.classes, self.content, self.lists, self.commas, self.folds = classes, content or {}, lists or {}, commas or {}, folds or {}
        self.tokens: dict[str, str] = {}
        self.sets: dict[str, set[str]] = {}
        self.rules: dict[str, list] = {}
        for line in re.sub(r"\n[ \t]+", " ", text).strip().splitlines():
            if line.strip() and not line.startswith("#"):
                name, _, body = line.partition("=")
                self._define(name.strip(), re.findall(r"'[^']+'|[\w:]+|[()|?*+]", body))
        for name, char in classes.items():
            self.sets.setdefault(name, set()).add(char)
        for token, more in (also or {}).items():
            for name in more:
                self.sets.setdefault(name, set()).add(self.char(token))
        self._compile()
        self.comma = self.char(",")
        self.memo: dict[tuple[str, str], tuple[frozenset[str], bool]] = {}
        self.groups: dict[str, str] = {}
        self.group_chars: dict[tuple[str, frozenset[str]], str] = {}
        self.wanted = {k: tuple(sorted({s[2:] for s in self.sets if s.startswith(k + ":")})) for k in KINDS.values()}
        self.ends = {name: re.compile("[" + "".join(RANGES.get(x) or re.escape(classes.get(x) or self.char(x)) for x in after) + "]") for name, (_, after) in self.lists.items()}

    def char(self, token: str) -> str:
        """The character of a quoted token."""
        if token not in self.tokens:
            self.tokens[token] = c = token if token in "()[]{}" else chr(0xE100 + len(self.tokens))
            self.sets.setdefault(f"'{token}'", set()).add(c)
        return self.tokens[token]

    def _define(self, name: str, items: list[str]) -> None:
        at = 0

        def alternation() -> list[list[tuple]]:
            nonlocal at
            out: list[list[tuple]] = [[]]
            while at < len(items) and items[at] != ")":
                x = items[at]
                at += 1
                if x == "|":
                    out.append([])
                    continue
                inner: str | list = x
                if x == "(":
                    inner = alternation()
                    at += 1
                elif x[0] == "'":
                    self.char(x[1:-1])
                mark = ""
                if at < len(items) and items[at] in "?*+":
                    mark = items[at]
                    at += 1
                out[-1].append((inner, mark))
            return out

        self.rules.setdefault(name, []).extend(alternation())

    def _compile(self) -> None:
        def leaves(alternatives: list) -> list[str]:
            return [x for alt in alternatives for inner, _ in alt for x in (leaves(inner) if isinstance(inner, list) else [inner])]

        for alternatives in self.rules.values():
            for x in leaves(alternatives):
                if x not in self.rules:
                    self.sets.setdefault(x, set())
        empty: dict[str, bool] = dict.fromkeys(self.rules, False)
        first: dict[str, set[str]] = {n: set() for n in self.rules}

        def look(alt: list[tuple]) -> tuple[set[str], bool]:
            begins: set[str] = set()
            for inner, mark in alt:
                if isinstance(inner, list):
                    parts = [look(a) for a in inner]
                    begins |= set().union(*(p for p, _ in parts))
                    may = any(e for _, e in parts)
                else:
                    begins |= first.get(inner, {inner})
                    may = empty.get(inner, False)
                if not may and mark not in ("?", "*"):
                    return begins, False
            return begins, True

        changed = True
        while changed:
            changed = False
            for n, alternatives in self.rules.items():
                for alt in alternatives:
                    begins, may = look(alt)
                    changed |= not begins <= first[n] or may and not empty[n]
                    first[n] |= begins
                    empty[n] |= may
        # Code: a set is a token to match, a list a nonterminal to call, a tuple the places to go on at, None the end. Of each
        # place a fork leads to there are the characters that may come first there, or None where nothing need come.
        self.code: list = []
        self.entries: dict[str, list[tuple[int, set[str], bool]]] = {n: [] for n in self.rules}
        self.looks: list[tuple[set[str], set[str]]] = []
        code = self.code

        def one(inner: str | list) -> None:
            if not isinstance(inner, list):
                code.append(self.entries[inner] if inner in self.entries else self.sets[inner])
            elif len(inner) == 1:
                sequence(inner[0])
            else:
                fork, starts, jumps = len(code), [], []
                code.append(())
                for alt in inner:
                    starts.append(len(code))
                    sequence(alt)
                    jumps.append(len(code))
                    code.append(())
                code[fork] = tuple(starts)
                for j in jumps:
                    code[j] = (len(code),)

        def sequence(alt: list[tuple]) -> None:
            for inner, mark in alt:
                begin = len(code)
                if mark in ("?", "*"):
                    code.append(())
                one(inner)
                if mark == "*":
                    code.append((begin,))
                if mark in ("?", "*"):
                    code[begin] = (begin + 1, len(code))
                elif mark == "+":
                    code.append((begin, len(code) + 1))

        for n, alternatives in self.rules.items():
            for alt in alternatives:
                begins, may = look(alt)
                chars = set().union(*(self.sets[t] for t in begins)) if begins else set()
                self.looks.append((begins, chars))
                self.entries[n].append((len(code), chars, may))
                sequence(alt)
                code.append(None)
        names = {id(chars): name for name, chars in self.sets.items()}
        called = {id(entries): name for name, entries in self.entries.items()}

        def ahead(slot: int, seen: set[int]) -> tuple[set[str], bool]:
            """The terminals that may come first from a place on, and whether nothing need come before the rule's end."""
            symbol = code[slot]
            if symbol is None:
                return set(), True
            if slot in seen:
                return set(), False
            seen.add(slot)
            if type(symbol) is tuple:
                parts = [ahead(t, seen) for t in symbol]
                return set().union(*(p for p, _ in parts)), any(e for _, e in parts)
            if type(symbol) is set:
                return {names[id(symbol)]}, False
            begins, may = set(first[called[id(symbol)]]), empty[called[id(symbol)]]
            if may:
                rest, may = ahead(slot + 1, seen)
                begins |= rest
            return begins, may

        forks = {}
        for slot, symbol in enumerate(code):
            if type(symbol) is tuple:
                forks[slot] = []
                for target in symbol:
                    begins, may = ahead(target, set())
                    chars = None if may else set().union(*(self.sets[t] for t in begins)) if begins else set()
                    if chars is not None:
                        self.looks.append((begins, chars))
                    forks[slot].append((target, chars))
        for slot, targets in forks.items():
            code[slot] = tuple(targets)

    def derives(self, text: str, starts: tuple[str, ...]) -> tuple[frozenset[str], bool]:
        """Which of the nonterminals derive the whole text, and whether some could derive a longer one that begins with it."""
        end, code, longer = len(text), self.code, False
        text += "\0"
        stack: dict[tuple[int, int], tuple[list, set]] = {}  # (nonterminal, position) -> (edges, positions where it ended)
        seen: set[tuple[int, int, int]] = set()
        forked: set[tuple[int, int, int]] = set()
        todo: list[tuple[int, tuple, int]] = []
        found = set()
        for start in starts:
            entries = self.entries[start]
            if (id(entries), 0) not in stack:
                node = stack[id(entries), 0] = ([], set())
                for slot, chars, empty in entries:
                    if empty or text[0] in chars:
                        todo.append((slot, node, 0))
                    elif not end:
                        longer = True
        while todo:
            slot, node, i = todo.pop()
            while True:
                symbol = code[slot]
                if symbol is None:
                    edges, ended = node
                    if i not in ended:
                        ended.add(i)
                        for back, parent in edges:
                            key = (back, id(parent), i)
                            if key not in seen:
                                seen.add(key)
                                todo.append((back, parent, i))
                    break
                if type(symbol) is tuple:
                    if len(symbol) == 1:
                        slot = symbol[0][0]
                        continue
                    c, going, others, free = text[i], -1, None, False
                    for target, chars in symbol:
                        if chars is None:
                            free = True
                        elif c not in chars:
                            continue
                        if going < 0:
                            going = target
                        elif others is None:
                            others = [target]
                        else:
                            others.append(target)
                    if i == end and (going < 0 or 1 + len(others or ()) < len(symbol)):
                        longer = True
                    if going < 0:
                        break
                    if free or others:  # it may come here again
                        key = (slot, id(node), i)
                        if key in forked:
                            break
                        forked.add(key)
                        if others:
                            todo += [(other, node, i) for other in others]
                    slot = going
                    continue
                if type(symbol) is set:
                    if text[i] in symbol:
                        i += 1
                        slot += 1
                        continue
                    if i == end:
                        longer = True
                    break
                key = (id(symbol), i)
                below = stack.get(key)
                if below is None:
                    below = stack[key] = ([(slot + 1, node)], set())
                    for entry, chars, empty in symbol:
                        if empty or text[i] in chars:
                            todo.append((entry, below, i))
                        elif i == end:
                            longer = True
                else:
                    edge = (slot + 1, node)
                    if not any(b == slot + 1 and p is node for b, p in below[0]):
                        below[0].append(edge)
                        for j in below[1]:
                            mark = (slot + 1, id(node), j)
                            if mark not in seen:
                                seen.add(mark)
                                todo.append((slot + 1, node, j))
                break
        for start in starts:
            if end in stack[id(self.entries[start]), 0][1]:
                found.add(start)
        return frozenset(found), longer

    def derived(self, text: str, start: str) -> tuple[bool, bool]:
        """derives() for one nonterminal, remembered."""
        known = self.memo.get((start, text))
        if known is None:
            if len(self.memo) >= REMEMBER:
                self.memo.clear()
            known = self.memo[start, text] = self.derives(self.folded(text, *self.folds[start]) if start in self.folds else text, (start,))
        return bool(known[0]), known[1]

    def folded(self, text: str, name: str, is_one: str, is_none: str) -> str:
        """The text with each run of members between the commas of a row as one character. Every member is parsed by itself; one that
        derives ``is_one`` and not ``is_none`` can stand in such a row only as an item of its repetition, in which the character stands for one or more."""
        items = text.split(self.comma)
        if len(items) < 4:
            return text
        out = items[:1]
        for x in items[1:-1]:
            if self.derived(x, is_one)[0] and not self.derived(x, is_none)[0]:
                x = self.classes[name]
            if x != self.classes[name] or out[-1] != x:
                out.append(x)
        return self.comma.join([*out, items[-1]])

    def sequence(self, text: str, name: str) -> bool:
        """Whether text is a sequence of the items of a list, each with the separator that ends it.

        Items are tried from each place where one may begin, and made longer, separator by separator, as long as the
        parse could go on; so each is parsed by itself and equal ones are parsed once.
        """
        item, _ = self.lists[name]
        cuts = [m.end() for m in self.ends[name].finditer(text)]
        if not cuts or cuts[-1] < len(text):
            cuts.append(len(text))
        reach, place = {0}, {c: n for n, c in enumerate(cuts)}
        todo = [0]
        while todo:
            a = todo.pop()
            if a == len(text):
                return True
            for k in range(place[a] + 1 if a else 0, len(cuts)):
                b = cuts[k]
                whole, longer = self.derived(text[a:b], item)
                if whole and b not in reach:
                    reach.add(b)
                    todo.append(b)
                if not longer:
                    break
        return len(text) in reach

    def comma_list(self, text: str, name: str) -> bool:
        """Whether text is a row of the items of a list, with commas between them.

        A repetition folded over its items: each is parsed by itself, remembered, and made longer, comma by comma, only as long as the parse could go on.
        """
        item, trailing, empty = self.commas[name]
        if not text:
            return empty
        cuts = [m.start() for m in re.finditer(self.comma, text)]
        cuts.append(len(text))
        reach, todo, done = {0}, [0], len(text)
        number = {c + 1: n + 1 for n, c in enumerate(cuts)} | {0: 0}
        while todo:
            a = todo.pop()
            if a == done and trailing:
                return True
            for k in range(number[a], len(cuts)):
                b = cuts[k]
                whole, longer = self.derived(text[a:b], item)
                if whole:
                    if b == done:
                        return True
                    if b + 1 not in reach:
                        reach.add(b + 1)
                        todo.append(b + 1)
                if not longer:
                    break
        return False

    def matches(self, text: str, starts: tuple[str, ...]) -> frozenset[str]:
        """Which of the nonterminals, lists among them, derive the whole text."""
        plain = tuple(s for s in starts if s not in self.lists and s not in self.commas)
        found = set(self.derives(text, plain)[0]) if plain else set()
        return frozenset(found | {s for s in starts if s in self.lists and self.sequence(text, s) or s in self.commas and self.comma_list(text, s)})

    def group(self, opening: str, inner: str) -> str:
        """The character for a pair of brackets and its content."""
        whole = opening + inner
        known = self.groups.get(whole)
        if known is None:
            kind = KINDS[opening]
            found: set[str] = set()
            by: dict[str, list[str]] = {}
            for name in self.wanted[kind]:
                prepare = self.content.get(name) or self.content.get(kind)
                by.setdefault(prepare(inner) if prepare else inner, []).append(name)
            for text, names in by.items():
                found |= self.matches(text, tuple(names))
            known = self.stand_in(kind, frozenset(found))
            if len(self.groups) >= REMEMBER:
                self.groups.clear()
            self.groups[whole] = known
        return known

    def stand_in(self, kind: str, found: frozenset[str]) -> str:
        key = (kind, found)
        if key not in self.group_chars:
            c = self.group_chars[key] = chr(BASE[kind] + sum(k == kind for k, _ in self.group_chars))
            names = {f"{kind}:{f}" for f in found}
            for n in names:
                self.sets[n].add(c)
            for terminals, chars in self.looks:
                if terminals & names:
                    chars.add(c)
        return self.group_chars[key]

    BRACKETS = re.compile(r"[()\[\]{}]")
    CLOSES = {"(": ")", "[": "]", "{": "}"}

    def reduce(self, text: str) -> str | None:
        """The text with all brackets replaced, the innermost first, in one pass; None if they don't match."""
        opened: list[tuple[str, list[str]]] = [("", [])]
        at = 0
        for m in self.BRACKETS.finditer(text):
            sign = m.group()
            opened[-1][1].append(text[at : m.start()])
            at = m.end()
            if sign in "([{":
                opened.append((sign, []))
                continue
            opening, parts = opened.pop()
            if self.CLOSES.get(opening) != sign:
                return None
            opened[-1][1].append(self.group(opening, "".join(parts)))
        if len(opened) > 1:
            return None
        return "".join(opened[0][1]) + text[at:]


class Kinds(dict):
    """From a token to its character; unknown ones are classified once."""

    def __init__(self, tokens: dict[str, str], classify: Callable[[str], str]):
        super().__init__(tokens)
        self.fixed, self.classify = dict(tokens), classify

    def __missing__(self, token: str) -> str:
        c = self.classify(token)
        if len(self) > REMEMBER:
            self.clear()
            self.update(self.fixed)
        if len(token) <= 40:
            self[token] = c
        return c


#: The character of what is no token.
BAD = "\ue001"
