"""Bigrams of letters over a whole corpus, exact and of fixed size, with classes of letters behind them."""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Ranges in which each letter is a symbol of its own; of others each row of 256 (beyond the basic plane each plane) is one.
FINE = ((0, 0x600), (0x1E00, 0x1F00), (0x2000, 0x2070), (0x20A0, 0x20D0), (0x2100, 0x2150), (0x2500, 0x25A0), (0x3040, 0x3100))
# Where scripts begin; letters of ASCII are one for themselves.
SCRIPTS = (0, 0x80, 0x250, 0x370, 0x400, 0x530, 0x590, 0x600, 0x780, 0x1E00, 0x1F00, 0x2000, 0x2E80, 0x3040, 0x3100, 0x3400, 0xA000, 0xAC00, 0xD800, 0xF900, 0xFB00, 0xFF00, 0x10000)
#: What is known of a letter's successors is mixed with their classes as if as many further pairs had been met as it has
#: different successors, and so many more; a letter has this share of its class by size alone.
WEIGHT, EVEN = 3.0, 0.03


def _symbols() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The symbol of each code point, and of each symbol its class and its number of code points."""
    point = np.arange(0x110000)
    fine = np.zeros(len(point), dtype=bool)
    for a, b in FINE:
        fine[a:b] = True
    row = np.where(point < 0x10000, point >> 8, 0x1000 + (point >> 16)) + 0x200000
    keys, first, symbol, size = np.unique(np.where(fine, point, row), return_index=True, return_inverse=True, return_counts=True)
    kinds: dict[tuple, int] = {}
    classes = []
    for p in first.tolist():
        p = 0x2019 if p == 0x27 else p  # both are apostrophes
        kind = unicodedata.category(chr(p))
        script = int(np.searchsorted(SCRIPTS, p, "right")) if kind[0] in "LM" else 0x80 <= p if kind[0] in "PSC" else 0
        script = {11: 2}.get(script, script) if kind[0] in "LM" else script  # further Latin letters
        classes.append(kinds.setdefault((kind if kind[0] in "LCZ" else kind[0], int(script)), len(kinds)))
    return symbol.astype(np.uint16), np.array(classes), size


SYMBOL, CLASS, SIZE = _symbols()
N = len(SIZE)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


class Letters:
    """The probability of a letter after another, in natural logarithm."""

    def __init__(self, pairs: np.ndarray, singles: np.ndarray):
        """``pairs`` counts pairs of symbols (N * N), ``singles`` code points of the basic plane."""
        self.name = uuid.uuid4().hex
        n_class = int(CLASS.max()) + 1
        pair = pairs.reshape(N, N).astype(np.float64)
        of_symbol = np.bincount(SYMBOL[:0x10000], weights=singles, minlength=N)[:N]
        of_class, symbols_of = np.bincount(CLASS, weights=of_symbol, minlength=n_class), np.bincount(CLASS, weights=SIZE, minlength=n_class)
        within = (1 - EVEN) * of_symbol / np.maximum(of_class, 1)[CLASS] + EVEN * SIZE / symbols_of[CLASS]
        by_class = np.zeros((n_class, N))
        np.add.at(by_class, CLASS, pair)
        by_class = np.array([np.bincount(CLASS, weights=r, minlength=n_class) for r in by_class]) + 0.5
        by_class /= by_class.sum(1, keepdims=True)
        behind = (by_class[:, CLASS] * within)[CLASS]
        self.kinds = np.log(by_class).astype(np.float32)
        with np.errstate(divide="ignore"):
            weight = WEIGHT + (pair > 0).sum(1, keepdims=True)
            self.after = np.log((pair + weight * behind) / (pair.sum(1, keepdims=True) + weight)).astype(np.float32)
            # A letter within its symbol: of letters that are symbols by themselves this is 1.
            share = (1 - EVEN) * singles / np.maximum(of_symbol, 1)[SYMBOL[:0x10000]] + EVEN / SIZE[SYMBOL[:0x10000]]
            self.within = np.log(np.where(SIZE[SYMBOL[:0x10000]] == 1, 1.0, share)).astype(np.float32)
        self.beyond = np.float32(np.log(1 / 0x10000))
        self.singles = singles

    def pairwise(self, p: np.ndarray) -> np.ndarray:
        """Of each letter but the first, the log probability after the one before it."""
        s = SYMBOL[p]
        later = p[1:]
        return self.after[s[:-1], s[1:]] + np.where(later < 0x10000, self.within[np.minimum(later, 0xFFFF)], self.beyond)

    def classes(self, text: str) -> float:
        """The log probability of the classes of a text's letters but the first, each after the one before it; which letters they are doesn't count."""
        c = CLASS[SYMBOL[points(text)]]
        return float(self.kinds[c[:-1], c[1:]].sum())

    def scores(self, texts: list[str]) -> np.ndarray:
        """Of each text, none empty, the log probability of all its letters but the first."""
        return self.segments(points("".join(texts)), np.cumsum([0, *map(len, texts)])[:-1])

    def segments(self, p: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """scores() of texts that lie one behind the other."""
        each = np.zeros(len(p), dtype=np.float64)
        if len(p) > 1:
            each[1:] = self.pairwise(p)
        each[starts] = 0
        return np.add.reduceat(each, starts)


def counts(documents: DataFrame, text: str = "text", without: Callable[[list[str]], list[str]] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of symbols (N * N) and code points of all texts, or of what ``without`` leaves of them. What comes to the driver has at most N * N + 65,536 rows, however large the corpus."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, singles = np.zeros(N * N, dtype=np.int64), np.zeros(0x10000, dtype=np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            p = points("\0".join(without(texts) if without else texts))
            if len(p):
                singles += np.bincount(p[p < 0x10000], minlength=0x10000)
                s = SYMBOL[p].astype(np.int64)
                slot, n = np.unique(s[:-1] * N + s[1:], return_counts=True)
                pairs[slot] += n
        for kind, each in enumerate((pairs, singles)):
            at = np.flatnonzero(each)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, dtype=np.int32)), pa.array(at), pa.array(each[at])], names=["kind", "slot", "n"])

    rows = documents.select(text).mapInArrow(run, "kind int, slot long, n long").groupBy("kind", "slot").agg(F.sum("n").alias("n")).toArrow()
    kind, slot, n = (rows.column(c).to_numpy() for c in ("kind", "slot", "n"))
    pairs, singles = np.zeros(N * N, dtype=np.int64), np.zeros(0x10000, dtype=np.int64)
    for k, each in ((0, pairs), (1, singles)):
        each[slot[kind == k]] = n[kind == k]
    singles[0] = 0  # what stood between the documents
    return pairs, singles
