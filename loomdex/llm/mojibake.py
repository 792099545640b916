"""Text garbled by decoding with a wrong character encoding: finding it and restoring the original.

A wrong decoding is a substitution cipher: each byte of the right encoding was read as some other
letter. Each source is a mixture of such ciphers and of clean text, learned by expectation-maximization
against letter bigrams: the ciphers that code pages give are the starts, and one more cipher of each
source starts from nothing, for pages that nobody listed. The expectation weighs for each document the
reading under every cipher by the bigrams; the maximization sets the ciphers' weights in each source
and then, from the documents that chose a cipher, which letter each of its bytes stands for. The learned
table is applied with str.translate() to the passages that it makes likelier.

Bigrams are counted over all documents, exactly, between some 2,400 symbols: each letter of the
alphabets is one, of East Asian letters each row of 256. Behind a pair that was never met stand the
classes of its letters (script and category), so that languages which the corpus lacks are told from
signs within words as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomdex.llm import cipher
from loomdex.llm.letters import Letters, counts, points
from loomdex.sources.tables import table, written

#: What a Python worker remembers of runs already read is cleared at so many; only speed depends on it.
REMEMBER = 60_000
#: Log odds of a document from which it counts as garbled, under a key whose right encoding is UTF-8 and under others. A key that its source
#: has taught to be likelier than at first needs less, but never less than the third.
LEAST_GAIN, LEAST_GAIN_OTHER, LEAST_OWN = 8.0, 12.0, 9.0
#: The prior of a key before anything is learned, and how many rounds learn.
PRIOR, ROUNDS = 1e-3, 4
#: Keys that read a document worse than the best by so much, in log odds, have no share in it that counts: twice what weights can make up for.
HOPELESS = 14.0
#: Log odds, by the classes of letters alone, that a swap of single-byte pages needs in a document: letters in the place of others of their class
#: are no sign of one, for they may be those of a language that the corpus lacks.
LEAST_PLACED = 3.0
#: Log odds under this are as good as this.
FLOOR = -8.0
#: Log odds for each byte that valid UTF-8 saves: by chance a row of letters is seldom valid.
VALID = 3.5
#: Log odds for a passage to end between two runs of letters beyond ASCII.
TURN = -2.5
LOST = "\ufffd"
#: Signs of lost letters; one by itself between quotes or brackets is written about.
LOST_LETTERS = re.compile(rf"(?<![\"'`(\[«“‘]){LOST}+|{LOST}+(?![\"'`)\]»”’{LOST}])|{LOST}{{2,}}")

# Code pages that text was read as by mistake, for right encodings of one byte a letter and for UTF-8; for UTF-8 further ones.
READ_AS = (
    "latin-1", "cp1252", "cp1250", "cp1251", "cp437", "cp850", "cp866", "mac_roman", "koi8-r", "iso8859-2", "iso8859-15", "cp1254", "cp1253",
    "cp852", "mac_cyrillic", "iso8859-5", "iso8859-7", "cp775", "cp1257", "iso8859-13", "iso8859-4", "cp737", "cp855", "cp857", "mac_latin2", "mac_greek", "mac_turkish")
ONLY_UTF8 = ("cp1255", "cp1256", "cp1258", "cp858", "cp860", "cp861", "cp862", "cp863", "cp864", "cp865", "cp869", "cp1125", "cp874", "koi8-u", "iso8859-3", "iso8859-6", "iso8859-8", "iso8859-9", "iso8859-10", "iso8859-14", "iso8859-16", "mac_iceland", "mac_croatian", "mac_romanian")
# Encodings that text was in.
WRITTEN_IN = (
    "utf-8", "cp1252", "cp1251", "koi8-r", "cp1250", "iso8859-2", "shift_jis", "euc_jp", "cp866", "gb18030", "mac_roman", "cp437", "euc_kr", "big5",
    "cp850", "cp852", "mac_cyrillic", "iso8859-5", "iso8859-7", "cp1253", "cp1254", "cp775", "cp1257", "iso8859-13", "iso8859-4", "iso8859-15", "cp737", "cp855", "cp857", "mac_latin2", "mac_greek", "mac_turkish")


def page(name: str) -> list[str]:
    """The 256 letters of a single-byte code page; bytes that it leaves undefined are the control characters of their number."""
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(name))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


PAGES = {name: page(name) for name in READ_AS + ONLY_UTF8}
#: To turn letters back into the bytes they were read from: translate() to latin-1.
TO_BYTES = {name: {ord(c): b for b, c in enumerate(letters) if b >= 0x80} for name, letters in PAGES.items()}
#: Letters that a page can't have produced: the latin-1 range outside it. They would be taken for bytes.
FOREIGN = {name: {c for c in range(0x80, 0x100) if c not in TO_BYTES[name]} for name in PAGES}
#: Pairs of single-byte pages become one translate() table.
SINGLE = {(a, b): {ord(x): y for x, y in zip(PAGES[a], page(b), strict=True) if x != y} for a in READ_AS for b in WRITTEN_IN if b not in ("utf-8", "shift_jis", "euc_jp", "gb18030", "euc_kr", "big5")}
DOUBLE = ("shift_jis", "euc_jp", "gb18030", "euc_kr", "big5")
#: What text read as a double-byte page by mistake was in.
UNDER_DOUBLE = ("utf-8", "cp1252", "cp1251", "koi8-r", *DOUBLE)
MULTI = ("utf-8", *DOUBLE)
KEYS: list[tuple[tuple[str, str], ...]] = [((a, b),) for a in READ_AS for b in WRITTEN_IN if a != b and not (b in ("gb18030", "euc_kr", "big5") and a not in ("latin-1", "cp1252"))]
KEYS += [((a, "utf-8"), (c, "utf-8")) for a in ("latin-1", "cp1252", "cp1251", "cp437", "mac_roman", "cp1250") for c in ("latin-1", "cp1252", "cp1251", "cp437", "mac_roman", "cp1250") if a == c or {a, c} <= {"latin-1", "cp1252"}]
KEYS += [((a, b),) for a in DOUBLE for b in UNDER_DOUBLE if a != b]
KEYS += [(("cp1252", "utf-8"),) * 3, (("latin-1", "utf-8"),) * 3]
KEYS += [((a, "utf-8"),) for a in ONLY_UTF8]
#: The number that stands for a cipher that no pair of pages gives.
OPEN = len(KEYS)
#: 1 for keys whose right encoding has several bytes a letter, which chance seldom makes valid.
MULTIBYTE = np.array([float(key[-1][1] in MULTI) for key in KEYS])
#: Runs in which letters beyond ASCII stand; double-byte encodings have second bytes in ASCII, so a letter after them counts too.
RUN = re.compile(r"[^\x00-\x7f]+")
RUN_DOUBLE = re.compile(r"(?:[^\x00-\x7f][\x40-\x7e]?)+")
UTF8 = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
#: Of each page the byte of each letter of the basic plane, -1 for what it hasn't; of each right page the letters of its bytes.
BYTE_OF = {}
for _name, _letters in PAGES.items():
    BYTE_OF[_name] = np.full(0x10000, -1, dtype=np.int16)
    BYTE_OF[_name][[ord(c) for c in _letters[0x80:]]] = np.arange(0x80, 0x100)
LETTER_OF = {b: np.array([ord(c) for c in page(b)], dtype=np.uint32) for b in WRITTEN_IN if b not in MULTI}
#: By the page read as: keys of one step to a single-byte page, and keys whose first step ends in UTF-8.
TO_SINGLE = {a: [(n, key[0][1]) for n, key in enumerate(KEYS) if len(key) == 1 and key[0][0] == a and key[0][1] in LETTER_OF] for a in PAGES}
TO_UTF8 = {a: [n for n, key in enumerate(KEYS) if key[0] == (a, "utf-8")] for a in PAGES}
TO_DOUBLE = [n for n, key in enumerate(KEYS) if key[-1][1] in DOUBLE]
FROM_DOUBLE = [n for n, key in enumerate(KEYS) if key[0][0] in DOUBLE and key[-1][1] not in DOUBLE]


def step(run: str, read_as: str, written_in: str) -> str | None:
    """A run of letters read anew, or None if it can't have come about so.

    For UTF-8, valid sequences within the run are read anew and the other letters are kept, for some may have been lost.
    """
    if read_as in DOUBLE:
        return step_double(run, read_as, written_in)
    if written_in not in MULTI:
        return run.translate(SINGLE[read_as, written_in])
    if any(ord(c) in FOREIGN[read_as] for c in run):
        return None
    try:
        raw = run.translate(TO_BYTES[read_as]).encode("latin-1")
    except UnicodeEncodeError:
        if written_in != "utf-8":
            return None
        out, hit = [], False  # other letters stand between; each stretch by itself
        for part in re.findall(r"[\x80-\xff]+|[^\x80-\xff]+", run.translate(TO_BYTES[read_as])):
            one = step_utf8(part.encode("latin-1"), read_as) if part[0] < "Ā" else None
            hit |= one is not None
            out.append(one if one is not None else "".join(PAGES[read_as][ord(c)] if ord(c) < 0x100 else c for c in part))
        return "".join(out) if hit else None
    if written_in == "utf-8":
        return step_utf8(raw, read_as)
    try:
        return raw.decode(written_in)
    except UnicodeDecodeError:
        return None


def step_double(run: str, read_as: str, written_in: str) -> str | None:
    """The same for a run read as a double-byte page. Of a letter at either end of a stretch some bytes may be lost; of UTF-8, all between must be valid."""
    out = []
    for part in re.split(f"({LOST})", run):
        try:
            raw = part.encode(read_as) if part != LOST else b""
            if written_in == "utf-8" and raw:
                head = re.match(rb"[\x80-\xbf]{0,3}", raw).end()
                tail = re.search(rb"(?:[\xc2-\xf4]|[\xe0-\xf4][\x80-\xbf]|[\xf0-\xf4][\x80-\xbf]{2})?\Z", raw[head:]).start() + head
                out.append(LOST * (head > 0) + raw[head:tail].decode(written_in) + LOST * (tail < len(raw)))
            else:
                out.append(raw.decode(written_in) if part != LOST else LOST)
        except UnicodeError:
            return None
    new = "".join(out)
    return new if new.strip(LOST) else None


def step_utf8(raw: bytes, read_as: str) -> str | None:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, at, letters = [], 0, PAGES[read_as]
    for m in UTF8.finditer(raw):
        try:
            good = m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [letters[b] for b in raw[at : m.start()]]
        out.append(good)
        at = m.end()
    if not at:
        return None
    return "".join(out) + "".join(letters[b] for b in raw[at:])


def reread(run: str, key: tuple[tuple[str, str], ...]) -> str | None:
    """A run under a key of one or more steps; None if it changes nothing."""
    now: str | None = run
    for read_as, written_in in key:
        now = step(now, read_as, written_in)
        if now is None:
            return None
    return now if now != run else None


# Pages in which hardly a word of any language is valid UTF-8.
TELLING = ("latin-1", "cp1252", "cp1250", "cp1254", "cp1255", "cp1257", "cp437", "cp850", "cp852")
RUNS = re.compile(r"[^\x00-\x7f]{2,}")
_suspect: dict[str, bool] = {}


def without_utf8(texts: list[str]) -> list[str]:
    """The texts without the runs of letters that are valid UTF-8 in such a page, so that what is garbled so doesn't count among the bigrams."""
    if len(_suspect) > REMEMBER:
        _suspect.clear()

    def suspect(run: str) -> bool:
        if (known := _suspect.get(run)) is None:
            known = _suspect[run] = False
            for a in TELLING:
                if not any(ord(c) in FOREIGN[a] for c in run):
                    try:
                        run.translate(TO_BYTES[a]).encode("latin-1").decode("utf-8")
                    except UnicodeError:
                        continue
                    known = _suspect[run] = True
                    break
        return known

    return [RUNS.sub(lambda m: "\0" if suspect(m.group()) else m.group(), t) for t in texts]


class Reader:
    """Reads the runs of texts under every key; what a run between its neighbours gave is remembered."""

    def __init__(self, letters: Letters):
        self.letters, self.seen, self.found = letters, {}, {}

    def learn(self, texts: list[str]) -> None:
        """Finds the runs of the texts, and reads all that weren't read yet, many at a time."""
        if len(self.seen) > REMEMBER:
            self.seen.clear()
        self.found = {}
        for text in texts:
            if text not in self.found:
                self.found[text] = tuple(
                    [(a, b, (text[a - 1 : a] if a else "", text[a:b], text[b : b + 1], double)) for a, b in map(re.Match.span, pattern.finditer(text))] for double, pattern in ((False, RUN), (True, RUN_DOUBLE))
                )
        for double in (False, True):
            todo = sorted({k for each in self.found.values() for *_, k in each[double]} - self.seen.keys())
            for lo in range(0, len(todo), 2000):
                self._read(todo[lo : lo + 2000], double)

    def _read(self, runs: list[tuple[str, str, str, bool]], double: bool) -> None:
        whole = [before + run + after for before, run, after, _ in runs]
        p, sizes = points("".join(whole)), np.array([len(x) for x in whole])
        starts = np.cumsum([0, *sizes])[:-1]
        base = self.letters.segments(p, starts)
        inner = p >= 0x80  # neighbours within reach are ASCII, or nothing
        basic = np.minimum(p, 0xFFFF)
        said: list[tuple[np.ndarray, int, np.ndarray]] = []
        more: list[tuple[int, int, str]] = []  # run, key, what it becomes
        for a, byte_of in BYTE_OF.items():
            byte = np.where(inner & (p < 0x10000), byte_of[basic], -1)
            has = np.logical_or.reduceat(byte >= 0, starts)
            if not has.any():
                continue
            if double:
                if a in READ_AS:
                    for r in np.flatnonzero(np.logical_and.reduceat((byte >= 0) | ~inner, starts)).tolist():
                        more += [(r, n, new) for n in TO_DOUBLE if KEYS[n][0][0] == a and (new := reread(runs[r][1], KEYS[n]))]
                continue
            if TO_SINGLE[a]:
                rows = np.flatnonzero(has)
                take = np.repeat(has, sizes)
                q, at, n_each = p[take], byte[take], sizes[rows]
                begin = np.cumsum([0, *n_each])[:-1]
                for n, b in TO_SINGLE[a]:
                    new = np.where(at >= 0, LETTER_OF[b][at], q)
                    value = self.letters.segments(new, begin) - base[rows] - 6.0 * np.add.reduceat(((new >= 0x80) & (new < 0xA0) | (new >= 0xE000) & (new < 0xF900)).astype(float), begin)
                    value[~np.logical_or.reduceat(new != q, begin)] = -np.inf
                    said.append((rows, n, value))
            raw = np.where(byte >= 0, byte, 0).astype(np.uint8).tobytes()
            hit = {int(np.searchsorted(starts, m.start(), "right")) - 1 for m in UTF8.finditer(raw)}
            more += [(r, n, new) for r in hit for n in TO_UTF8[a] if (new := reread(runs[r][1], KEYS[n]))]
        if double or (inner & (p >= 0x2E80)).any():
            for r in np.flatnonzero(np.logical_or.reduceat(p >= 0x2E80, starts)).tolist():
                more += [(r, n, new) for n in (FROM_DOUBLE if not double else TO_DOUBLE) if KEYS[n][0][0] in DOUBLE and (new := reread(runs[r][1], KEYS[n]))]
        if double:  # these encodings are for East Asian letters
            more = [x for x in more if 2 * sum(ord(c) >= 0x2E80 for c in x[2]) >= len(x[2])]
        if more:
            value = self.letters.scores([runs[r][0] + new + runs[r][2] for r, _, new in more]) - base[[r for r, _, _ in more]]
            value -= [6.0 * sum(0x80 <= ord(c) < 0xA0 or 0xE000 <= ord(c) < 0xF900 for c in new) for _, _, new in more]
            value += [VALID * (len(runs[r][1]) - len(new)) if KEYS[n][-1][1] == "utf-8" and KEYS[n][0][0] not in DOUBLE else 0.0 for r, n, new in more]
            said.append((np.array([r for r, _, _ in more]), np.array([n for _, n, _ in more]), value))
        row = np.concatenate([r for r, _, _ in said]) if said else np.zeros(0, dtype=int)
        key = np.concatenate([np.broadcast_to(n, r.shape) for r, n, _ in said]) if said else row
        value = np.concatenate([v for _, _, v in said]) if said else np.zeros(0)
        keep = value > FLOOR
        row, key, value = row[keep], key[keep].astype(np.int16), value[keep].astype(np.float32)
        order = np.argsort(row, kind="stable")
        row, key, value = row[order], key[order], value[order]
        ends = np.searchsorted(row, np.arange(len(runs) + 1))
        for r, run in enumerate(runs):
            a, b = ends[r], ends[r + 1]
            self.seen[run] = (key[a:b].copy(), value[a:b].copy(), bool(value[a:b].max() > 0)) if b > a else None

    def runs(self, text: str, double: bool) -> Iterator[tuple[int, int, tuple[np.ndarray, np.ndarray, bool] | None]]:
        """Of each run of a text that was learned its place and what it gave."""
        seen = self.seen
        for a, b, run in self.found[text][double]:
            yield a, b, seen[run]

    def odd(self, text: str) -> int:
        """How often signs stand within words that have no place there."""
        return sum(1 for *_, (before, run, after, _) in self.found[text][0] if before.islower() and after.islower() and before < "\x80" > after and any(map(cipher.strange, run)))

    def __call__(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """By key the evidence for it, and the log odds of all that it reads anew, single letters too.

        A run that stands in several places is judged by all of them together. A single letter that stands alone
        between signs or spaces is no evidence for a swap of single-byte pages, but helps to choose among keys.
        """
        evidence, whole = np.zeros(len(KEYS)), np.zeros(len(KEYS))
        for double in (False, True):
            seen, hopeful = self.seen, set()
            for *_, run in self.found[text][double]:
                if (gave := seen[run]) is not None and gave[2]:
                    hopeful.add(run[1])
            if not hopeful:
                continue
            found: dict[str, list] = {run: [] for run in hopeful}
            for a, b, run in self.found[text][double]:
                if run[1] in hopeful:
                    found[run[1]].append((seen[run], b - a > 1 or run[0].isalpha() or run[2].isalpha()))
            for each in found.values():
                n_counting = sum(counting for _, counting in each)
                told, counts = np.full(len(KEYS), FLOOR * len(each)), FLOOR * (n_counting + (len(each) - n_counting) * MULTIBYTE)
                for gave, counting in each:
                    if gave is not None:
                        told[gave[0]] += gave[1] - FLOOR
                        counts[gave[0]] += (gave[1] - FLOOR) * (1 if counting else MULTIBYTE[gave[0]])
                evidence += np.maximum(counts, 0)
                whole += np.maximum(told, 0)
        return evidence, whole

    def better_placed(self, text: str, a: int, b: int, key: int) -> float:
        """The log odds of a run under a key by the classes of letters alone."""
        before, after = text[a - 1 : a] if a else "", text[b : b + 1]
        return self.letters.classes(before + (reread(text[a:b], KEYS[key]) or text[a:b]) + after) - self.letters.classes(text[a - 1 if a else 0 : b + 1])

    def passages(self, text: str, key: int) -> list[tuple[int, int]]:
        """The runs to read anew under a key: the likeliest course of garbled and clean runs, where it costs to turn from one to the other."""
        places, odds = [], []
        for a, b, gave in self.runs(text, KEYS[key][-1][1] in DOUBLE):
            at = np.flatnonzero(gave[0] == key) if gave is not None else ()
            if len(at) or reread(text[a:b], KEYS[key]) is not None:
                places.append((a, b))
                odds.append(float(gave[1][at[0]]) if len(at) else FLOOR)
        return [x for x, yes in zip(places, cipher.course(odds, TURN), strict=True) if yes]


_readers: dict[str, Reader] = {}


def reader(letters: Letters) -> Reader:
    """The worker's reader of these letters, with what it remembers from earlier tasks."""
    if letters.name not in _readers:
        while len(_readers) > 1:
            _readers.pop(next(iter(_readers)))
        _readers[letters.name] = Reader(letters)
    return _readers[letters.name]


def learned(scored: DataFrame, totals: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR) -> DataFrame:
    """(source, key, weight): expectation-maximization of each source's weights of the keys.

    ``scored`` has doc_id, source, key, gain, ``totals`` source and n, its documents. The unchanged reading competes with gain 0. Sums are pre-aggregated by source
    and key, so a source that holds a third of all documents is no larger a group than others.
    """
    weights = scored.select("source", "key").distinct().withColumn("weight", F.lit(prior))
    for _ in range(rounds):
        odds = scored.join(weights, ["source", "key"]).withColumn("odds", F.col("weight") * F.exp(F.least("gain", F.lit(60.0))))
        share = odds.withColumn("share", F.col("odds") / (1 + F.sum("odds").over(Window.partitionBy("doc_id"))))
        sums = share.groupBy("source", "key").agg(F.sum("share").alias("mass"))
        weights = written(sums.join(totals, "source").select("source", "key", ((F.col("mass") + prior) / (F.col("n") + 1)).alias("weight")))
    return weights


def signs(text: str, spans: list[tuple[int, int]]) -> Iterator[tuple[str, str, str]]:
    """Of the letters beyond ASCII in the spans each with its neighbours."""
    for a, b in spans:
        for k in range(a, b):
            if text[k] >= "\x80":
                yield text[max(0, k - 1) : k], text[k], text[k + 1 : k + 2]


def tables(chosen: DataFrame, letters) -> DataFrame:
    """(source, key, signs, meant): for each source and key the letters that signs stand for, learned from the documents that chose it.

    ``chosen`` has source, key, text. Contexts are counted before they meet, so a group has no more rows than there are pairs of neighbours of its signs.
    """

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(letters.value)
        for batch in batches:
            out: dict[tuple, int] = {}
            texts = batch.column("text").to_pylist()
            read.learn(texts)
            for source, key, text in zip(batch.column("source").to_pylist(), batch.column("key").to_pylist(), texts, strict=True):
                spans = list(map(re.Match.span, RUN.finditer(text))) if key == OPEN else read.passages(text, key)
                for c in signs(text, spans):
                    out[source, key, *c] = out.get((source, key, *c), 0) + 1
            columns = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.string()) for c in columns[2:]), pa.array(list(out.values()), pa.int64())], names=["source", "key", "before", "sign", "after", "n"])

    def group(rows: pa.Table) -> pa.Table:
        source, key = rows.column("source")[0].as_py(), rows.column("key")[0].as_py()
        each = list(zip(*(rows.column(c).to_pylist() for c in ("before", "sign", "after", "n")), strict=True))
        if key == OPEN:
            odd = [x for x in each if cipher.strange(x[1])]
            found = {s: m for s, (m, share) in cipher.learn(odd, letters.value).items() if share >= 0.5 and m != s and m.isalpha()}
            gains = cipher.gains(odd, letters.value, found)
            found = {s: m for s, m in found.items() if gains[s] >= LEAST_GAIN_OTHER}  # over all of the source
        else:
            start = {chr(c): m for c, m in SINGLE[KEYS[key][0]].items()}
            found = {s: m for s, (m, _) in cipher.learn(each, letters.value, start).items()}
            found |= {s: m for s, m in start.items() if s not in found}
        return pa.table({"source": pa.array([source]), "key": pa.array([key], pa.int32()), "signs": pa.array(["".join(found)]), "meant": pa.array(["".join(found.values())])})

    single = [n for n, key in enumerate(KEYS) if len(key) == 1 and not MULTIBYTE[n] and key[0][0] not in DOUBLE]
    rows = chosen.where(F.col("key").isin(*single, OPEN)).select("source", "key", "text").mapInArrow(contexts, "source string, key int, before string, sign string, after string, n long")
    rows = rows.groupBy("source", "key", "before", "sign", "after").agg(F.sum("n").alias("n"))
    return rows.groupBy("source", "key").applyInArrow(group, "source string, key int, signs string, meant string")


def garbled(documents: DataFrame, rounds: int = ROUNDS, least_gain: float = LEAST_GAIN, least_gain_other: float = LEAST_GAIN_OTHER) -> DataFrame:
    """(doc_id, source, key, gain, lost, restored): each document that holds garbled text.

    ``documents`` has doc_id, text, source. restored is the text with every garbled passage read anew that can be; letters that
    were lost stay lost; it is null where nothing can be read anew. Null and empty texts, and rows without a doc_id, are none; a null source is a source of its own.
    key is the number of the pages in KEYS, OPEN for a cipher that its source alone taught, and null where only lost letters (U+FFFD, but for one shown between quotes or brackets) tell. Repeated rows give one.
    """
    spark: SparkSession = documents.sparkSession
    every = documents.where("doc_id is not null and text is not null").select("doc_id", "text", F.coalesce("source", F.lit("")).alias("source"))
    rows = every.where(F.rlike("text", F.lit(r"[^\x00-\x7F]")))  # only these can hold garbled text
    kind = documents.schema["doc_id"].dataType.simpleString()
    kept_type = to_arrow_type(documents.schema["doc_id"].dataType)

    def scored(rows: DataFrame, shared, every_key: bool) -> DataFrame:
        """The documents that some key reads better, and those with signs out of place, with the evidence for each key, or for the best one only."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = reader(shared.value)
            types = [kept_type, pa.string(), pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            for batch in (b.slice(lo, 4000) for b in batches for lo in range(0, b.num_rows, 4000)):
                out: list[list] = [[] for _ in types]
                texts = batch.column("text").to_pylist()
                read.learn(texts)
                for doc, text, source in zip(batch.column("doc_id").to_pylist(), texts, batch.column("source").to_pylist(), strict=True):
                    lost, (evidence, whole), odd = sum(map(len, LOST_LETTERS.findall(text))), read(text), read.odd(text)
                    found = []
                    if not every_key and evidence.max() >= 0.5 * least_gain:
                        found.append((int(evidence.argmax()), float(evidence.max()), 0.0, 0))
                    for n in np.flatnonzero((evidence >= 0.5 * least_gain) & (whole >= whole.max() - HOPELESS)).tolist() if every_key else ():
                        spans = read.passages(text, n)
                        if not MULTIBYTE[n] and sum(read.better_placed(text, a, b, n) for a, b in spans) < LEAST_PLACED:
                            continue
                        reading = "\0".join(f"{a}:{reread(text[a:b], KEYS[n])}" for a, b in spans)
                        found.append((n, float(evidence[n]), float(whole[n]), xxhash.xxh3_64_intdigest(reading.encode("utf-8", "surrogatepass")) >> 1))
                    if lost or odd:
                        found.append((OPEN, 0.0, 0.0, odd))
                    for k, row in enumerate(found):
                        for column, value in zip(out, (doc, source, text if k == 0 else None, lost, *row), strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "source", "text", "lost", "key", "gain", "whole", "reading"])

        return written(rows.mapInArrow(run, f"doc_id {kind}, source string, text string, lost int, key int, gain double, whole double, reading long"))

    # 1. Candidates by the bigrams of all documents; then again by those of clean text, without the documents that are surely garbled.
    pairs, singles = counts(every, without=without_utf8)
    first = scored(rows, spark.sparkContext.broadcast(Letters(pairs, singles)), False)  # of fixed size
    texts = first.where("text is not null").select("doc_id", "source", "text").dropDuplicates(["doc_id"])
    texts = texts.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))  # few bytes, but much to do
    sure = first.groupBy("doc_id").agg(F.max("gain").alias("gain"), F.max("lost").alias("lost"), F.max("text").alias("text")).where((F.col("gain") >= LEAST_OWN) | (F.col("lost") > 0))
    garbled_pairs, garbled_singles = counts(sure, without=without_utf8)
    shared = spark.sparkContext.broadcast(Letters(np.maximum(pairs - garbled_pairs, 0), np.maximum(singles - garbled_singles, 0)))  # of fixed size
    scored = scored(texts, shared, True)

    # 2. The weights of the keys in each source, and the key of each document.
    totals = every.groupBy("source").agg(F.count("*").alias("n"))
    known = scored.where(F.col("key") < OPEN).drop("text").distinct()
    weights = learned(known.select("doc_id", "source", "key", "gain"), totals, rounds)
    judged = known.join(weights, ["source", "key"], "left").withColumn("odds", F.col("gain") + F.log(F.coalesce("weight", F.lit(PRIOR))))
    # Keys that agree in what they restore speak for the same reading; its odds are those of all together.
    together = F.greatest(F.max("odds"), F.log(F.sum(F.exp(F.least("odds", F.lit(600.0))))))
    one = F.max_by(F.struct("source", "key", "gain", "whole", F.col("odds").alias("own")), F.struct("odds", -F.col("key"))).alias("r")
    judged = judged.groupBy("doc_id", "reading").agg(one, together.alias("odds")).select("doc_id", "r.*", "odds")
    utf8 = [n for n, key in enumerate(KEYS) if key[-1][1] == "utf-8"]
    least = F.when(F.col("key").isin(utf8), least_gain).otherwise(least_gain_other)
    judged = judged.where((F.col("gain") >= F.when(F.col("key").isin(utf8), least_gain).otherwise(LEAST_OWN)) & (F.col("odds") >= float(np.log(PRIOR)) + least))
    rank = F.struct(F.col("own") - F.col("gain") + F.col("whole"), -F.col("key"))
    best = judged.groupBy("doc_id").agg(F.max_by(F.struct("source", "key", "gain"), rank).alias("r")).select("doc_id", "r.*")
    seen = scored.groupBy("doc_id").agg(F.min("source").alias("any_source"), F.max("lost").alias("lost"), F.max(F.when(F.col("key") == OPEN, F.col("reading"))).alias("odd"))
    chosen = seen.join(best, "doc_id", "left").withColumn("key", F.coalesce("key", F.when(F.col("odd") > 0, OPEN)))
    chosen = chosen.where("key is not null or lost > 0").select("doc_id", F.coalesce("source", "any_source").alias("source"), "key", F.coalesce("gain", F.lit(0.0)).alias("gain"), "lost")
    chosen = written(chosen.join(texts.select("doc_id", "text"), "doc_id").repartition(int(spark.conf.get("spark.sql.shuffle.partitions"))))

    # 3. What each sign stands for in each source, and the texts with the passages translated.
    with_tables = chosen.join(tables(chosen, shared), ["source", "key"], "left")

    def restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = reader(shared.value)
        for batch in (b.slice(lo, 500) for b in batches for lo in range(0, b.num_rows, 500)):
            texts, keys, gains = (batch.column(c).to_pylist() for c in ("text", "key", "gain"))
            read.learn(texts)
            out: list[str | None] = []
            for row, (text, key, own, meant) in enumerate(zip(texts, keys, *(batch.column(c).to_pylist() for c in ("signs", "meant")), strict=True)):
                table = str.maketrans(own, meant) if own else {}
                if key is None or key == OPEN:
                    new = text.translate(table)
                    whole = shared.value.scores([text + ".", new + "."]) if key == OPEN and new != text else (0.0, 0.0)
                    gains[row] = float(whole[1] - whole[0])
                    out.append(new if gains[row] >= LEAST_OWN else None)
                    keys[row] = OPEN if out[-1] is not None else None
                    continue
                new, at = [], 0
                for a, b in read.passages(text, key):
                    new += [text[at:a], text[a:b].translate(table) if own else reread(text[a:b], KEYS[key])]
                    at = b
                out.append("".join(new) + text[at:])
            names = ["doc_id", "source", "key", "gain", "lost", "restored"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(keys, pa.int32()), pa.array(gains, pa.float64()), batch.column("lost"), pa.array(out, pa.string())], names=names)

    restored = with_tables.select("doc_id", "source", "text", "key", "gain", "lost", "signs", "meant").mapInArrow(restore, f"doc_id {kind}, source string, key int, gain double, lost int, restored string")
    return restored.where("key is not null or lost > 0").withColumn("gain", F.round("gain", 3))


def _documents(spark, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", "source")


def p10_found(spark, d: str) -> DataFrame:
    """The documents that hold garbled text."""
    return garbled(_documents(spark, d)).select("doc_id")


def p10_restored(spark, d: str) -> DataFrame:
    """The documents that hold garbled text, with the key and the restored text."""
    names = F.create_map(*[x for n, key in enumerate(KEYS) for x in (F.lit(n), F.lit("; ".join(f"{b} read as {a}" for a, b in key)))], F.lit(OPEN), F.lit("a cipher of its source"))
    return garbled(_documents(spark, d)).withColumn("key", names[F.col("key")])


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
SQL: dict[str, str] = {}
