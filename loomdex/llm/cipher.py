"""Substitution ciphers: which letter each garbled sign stands for, learned by expectation-maximization against letter bigrams."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Sequence

import numpy as np

from loomdex.llm.letters import SYMBOL, Letters

#: Letters beyond ASCII that a sign may stand for are the most frequent of the corpus, so many.
ALPHABET = 300
#: What a given start counts for, in occurrences, and the share of what a sign is itself where nothing is given.
TRUST, ITSELF, ROUNDS = 8.0, 0.3, 12


def course(odds: Sequence[float], turn: float) -> list[bool]:
    """For a row of log odds the likeliest course of yes and no, where each change from one to the other costs ``-turn``."""
    if not odds:
        return []
    no, yes, back = 0.0, odds[0], []
    for x in odds[1:]:
        back.append((yes + turn > no, no + turn > yes))
        no, yes = max(no, yes + turn), max(yes, no + turn) + x
    state = yes > no
    out = [state]
    for from_yes, from_no in reversed(back):
        state = not from_no if state else from_yes
        out.append(state)
    return out[::-1]


def strange(sign: str) -> bool:
    """Whether a sign has no place between two small letters: symbols, controls, fractions and capitals; punctuation, small letters and the sign of a lost letter aren't meant."""
    return sign != "\ufffd" and unicodedata.category(sign) in ("So", "Sm", "Sc", "Sk", "Cc", "Co", "Cn", "No", "Lu")


def alphabet(letters: Letters, most: int = ALPHABET) -> list[str]:
    """The most frequent letters beyond ASCII of alphabets; East Asian ones aren't."""
    n = letters.singles.copy()
    n[:0x80] = 0
    n[0x2E80:] = 0
    return [chr(c) for c in np.argsort(-n, kind="stable")[: 4 * most].tolist() if n[c] > 0 and chr(c).isalpha()][:most]


def learn(contexts: Iterable[tuple[str, str, str, float]], letters: Letters, start: dict[str, str] | None = None, trust: float = TRUST) -> dict[str, tuple[str, float]]:
    """Of each sign the letter it stands for, and how sure that is.

    Contexts are (before, sign, after, times); the neighbours are letters, other signs or empty. With a ``start`` each sign
    begins as its letter there, which counts for ``trust`` occurrences; without one every letter of the alphabet may be meant.
    """
    rows = [(b[-1:], s, a[:1], n) for b, s, a, n in contexts if s]
    if not rows:
        return {}
    signs = sorted({s for _, s, _, _ in rows})
    number = {s: k for k, s in enumerate(signs)}
    meant = sorted({*alphabet(letters), *signs, *(start or {}).values()})
    meant = [c for c in meant if len(c) == 1]
    at = {c: k for k, c in enumerate(meant)}
    points = np.array([ord(c) for c in meant])
    symbol, extra = SYMBOL[points], np.where(points < 0x10000, letters.within[np.minimum(points, 0xFFFF)], letters.beyond)
    between = np.exp(letters.after[symbol[:, None], symbol[None, :]] + extra[None, :])
    prior = np.full((len(signs), len(meant)), 0.5 / len(meant))
    for s, k in number.items():
        if start is not None:
            prior[k, at[start.get(s, s)]] += trust
        else:
            prior[k, at[s]] += ITSELF
    q = prior / prior.sum(1, keepdims=True)
    sign = np.array([number[s] for _, s, _, _ in rows])
    times = np.array([n for *_, n in rows], dtype=float)

    def sides(which: int) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the neighbours: signs come first, then other letters, then nothing; of the latter two the likelihood."""
        others = sorted({r[which] for r in rows} - number.keys() - {""})
        place = {**number, **{c: len(signs) + k for k, c in enumerate(others)}, "": len(signs) + len(others)}
        known = np.ones((len(others) + 1, len(meant)))
        for k, c in enumerate(others):
            s = SYMBOL[ord(c)]
            known[k] = np.exp(letters.after[s, symbol] + extra) if which == 0 else np.exp(letters.after[symbol, s])
        return np.array([place[r[which]] for r in rows]), known

    before, known_before = sides(0)
    after, known_after = sides(2)
    for _ in range(ROUNDS):
        like = q[sign] * np.concatenate([q @ between, known_before])[before] * np.concatenate([q @ between.T, known_after])[after]
        like /= np.maximum(like.sum(1, keepdims=True), 1e-300)
        mass = prior.copy()
        np.add.at(mass, sign, like * times[:, None])
        q = mass / mass.sum(1, keepdims=True)
    best = q.argmax(1)
    return {s: (meant[best[k]], float(q[k, best[k]])) for s, k in number.items()}


def gains(contexts: Iterable[tuple[str, str, str, float]], letters: Letters, meant: dict[str, str]) -> dict[str, float]:
    """Of each sign the log odds, over all its contexts, of the letters that the signs are taken for against the signs as they stand."""
    rows = [(b[-1:], s, a[:1], n) for b, s, a, n in contexts if s in meant]
    out = dict.fromkeys(meant, 0.0)
    if rows:
        now = letters.scores([b + s + a for b, s, a, _ in rows])
        new = letters.scores(["".join(meant.get(c, c) for c in b + s + a) for b, s, a, _ in rows])
        for (_, s, _, n), x in zip(rows, new - now, strict=True):
            out[s] += n * float(x)
    return out
