"""Near-duplicate texts: a MinHash LSH forest for candidates, then exact verification.

Texts become sets of word triples. Equal sets are one node. Each tree of the forest orders the nodes by a
label of min-hashes, and nodes that share a prefix of the label are candidates. Prefixes are shortened
from DEPTH as far as a pair at the threshold needs to be found in TREES trees with the target recall. An item that
lies in a crowded branch at that length gets a longer prefix instead, and as many further trees as keep the recall; so on, branch by
branch, up to DEPTH. Every pair keeps its recall: either one of the two is in no crowded branch, so that no branch
they share is crowded, or both are in the forest of longer prefixes. What is crowded at DEPTH too is compared in
blocks. A sketch of 128 bits, compared within the branch, keeps pairs that are clearly less similar from
being emitted (it loses less than one in 50,000 true pairs at the threshold), and the rest are counted exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.sources.tables import cut, latest_by, table, written

TREES, DEPTH = 32, 8
TARGET_RECALL = 0.995
#: Nodes from which on a branch is crowded, and the most that are compared with one another in one block.
CROWDED, BLOCK = 200, 2000


def most_different(threshold: float) -> int:
    """Bits of 128 in which a candidate pair's sketches may differ: 5 standard deviations above the mean at the threshold."""
    p = (1 - threshold) / 2
    return int(128 * p + 5 * (128 * p * (1 - p)) ** 0.5)


#: Words (runs of letters, digits, underscores) and signs (any other non-blank character).
TOKEN = re.compile(r"\w+|[^\w\s]")
#: Rows that are worked on at a time, to bound a worker's memory.
ROWS = 256


def prefix_length(threshold: float, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest label prefix at which a pair at the threshold is found with the target probability."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= target:
            return k
    return 1


def trees_for(prefix: int, threshold: float, target: float = TARGET_RECALL, trees: int = TREES) -> int:
    """How many trees a prefix needs, so that a pair at the threshold shares it in one of them with the target probability."""
    n = trees
    while 1 - (1 - threshold**prefix) ** n < target:
        n += 1
    return n


def triple_hashes(texts: list[str], least: int) -> list[np.ndarray | None]:
    """Of each text the sorted distinct 64-bit hashes of its triples; None for a text under ``least`` words and signs."""
    known: dict[str, int] = {}
    out: list[np.ndarray | None] = []
    for text in texts:
        tokens = TOKEN.findall(text)
        if len(tokens) < max(least, 3):
            out.append(None)
            continue
        codes = [known.get(t) or known.setdefault(t, xxhash.xxh3_64_intdigest(t) | 1) for t in tokens]
        h = np.array(codes, dtype=np.uint64)
        with np.errstate(over="ignore"):
            x = h[:-2] * np.uint64(0x9E3779B97F4A7C15) + (h[1:-1] ^ (h[1:-1] >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F) + (h[2:] ^ (h[2:] >> np.uint64(31))) * np.uint64(0x165667B19E3779F9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(29)
        out.append(np.unique(x))
    return out


def _multipliers(n: int, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n min-hashes of 32 bits of each set."""
    flat, starts = np.concatenate(sets), np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), n), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j, m in enumerate(_multipliers(n)):
            out[:, j] = np.minimum.reduceat(((flat * m) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def nodes(texts: DataFrame, least: int, trees: int, prefix: int) -> DataFrame:
    """(id, version, n, set_a, set_b, bits_a, bits_b, keys) of each text with enough words and signs.

    n is the number of triples, set_a and set_b hash the whole set, keys are the trees' prefixes.
    """
    schema = pa.schema([("id", pa.string()), ("version", pa.int64()), ("n", pa.int32()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bits_a", pa.int64()), ("bits_b", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                sets = triple_hashes(part.column("text").to_pylist(), least)
                rows = [k for k, s in enumerate(sets) if s is not None]
                if not rows:
                    continue
                kept = [sets[k] for k in rows]
                sig = signatures(kept, max(trees * prefix, 128))  # the first are the same whatever the number
                whole = np.array([[(h := xxhash.xxh3_128_intdigest(s.tobytes())) & (2**64 - 1), h >> 64] for s in kept], dtype=np.uint64).view(np.int64)
                odd = (sig[:, :128] * np.uint32(0x9E3779B1)) >> np.uint32(31)
                bits = np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)
                label = sig[:, : trees * prefix].reshape(len(kept), trees, prefix).astype(np.uint64)
                keys = np.broadcast_to(np.arange(trees, dtype=np.uint64), (len(kept), trees)).copy()
                with np.errstate(over="ignore"):
                    for j in range(prefix):
                        keys = (keys ^ label[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
                        keys ^= keys >> np.uint64(30)
                take = pa.array(rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(kept) * trees + 1, trees, dtype=np.int32)), pa.array(keys.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(take), part.column("version").take(take), pa.array([len(s) for s in kept], pa.int32()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(bits[:, 0]), pa.array(bits[:, 1]), lists],
                    schema=schema,
                )

    return texts.mapInArrow(run, "id string, version long, n int, set_a long, set_b long, bits_a long, bits_b long, keys array<long>")


class NearDuplicates:
    """The pairs of texts that share at least ``threshold`` of their triples.

    ``texts`` has id, text, version. Each id counts once, with its latest version; rows with a null id or
    text, and texts of fewer than ``least`` words and signs, take no part. An empty table gives empty results.
    """

    def __init__(self, texts: DataFrame, threshold: float = 0.7, least: int = 60, trees: int = TREES, target: float = TARGET_RECALL):
        self.texts = texts.where("id is not null and text is not null").select("id", "text", F.coalesce(F.col("version").cast("long"), F.lit(-1)).alias("version"))
        self.threshold, self.least, self.target = threshold, least, target
        self.trees, self.prefix = trees, prefix_length(threshold, target, trees)
        long_enough = self.texts.where(F.octet_length("text") >= least)
        found = nodes(long_enough, least, trees, self.prefix)
        self.members = written(latest_by(found, ["id"], "version"))
        # A node for each distinct set; the least id stands for its copies.
        rest = ["version", "n", "bits_a", "bits_b", "keys"]
        self.nodes = self.members.groupBy("set_a", "set_b").agg(F.min_by(F.struct("id", *rest), "id").alias("r"), F.count("*").alias("copies")).select("set_a", "set_b", "copies", "r.*")

    def near(self, rows: DataFrame) -> DataFrame:
        """(a, b), a < b, of the (id, n, bits_a, bits_b, key) that share a key and whose sizes and sketches allow the threshold."""
        x, y = rows.alias("x"), rows.alias("y")
        differ = F.bit_count(F.col("x.bits_a").bitwiseXOR(F.col("y.bits_a"))) + F.bit_count(F.col("x.bits_b").bitwiseXOR(F.col("y.bits_b")))
        sizes = F.least("x.n", "y.n") >= self.threshold * F.greatest("x.n", "y.n")
        at = [F.col("x.key") == F.col("y.key"), F.col("x.id") < F.col("y.id"), sizes, differ <= most_different(self.threshold)]
        return x.join(y, at).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))

    def candidates(self, crowded: int = CROWDED, block: int = BLOCK) -> DataFrame:
        """(a, b), a < b: nodes that share a branch of the forest and whose sizes and sketches allow the threshold."""
        level, prefix, out = self.nodes.select("id", "version", "n", "bits_a", "bits_b", "keys"), self.prefix, None
        while True:
            branch = Window.partitionBy("key")
            rows = level.select("id", "n", "bits_a", "bits_b", F.explode("keys").alias("key")).withColumn("size", F.count("*").over(branch))
            if prefix >= DEPTH:
                break
            pairs = self.near(rows.where(F.col("size") <= crowded))
            out = pairs if out is None else out.unionByName(pairs)
            hot = rows.where(F.col("size") > crowded).select("id").distinct()
            again = written(level.select("id", "version").join(hot, "id"))
            if not again.limit(1).count():
                return out.distinct()
            prefix += 1
            texts = self.texts.join(again, ["id", "version"]).groupBy("id", "version").agg(F.min("text").alias("text"))
            level = written(nodes(texts, self.least, trees_for(prefix, self.threshold, self.target, self.trees), prefix))
        # The last level: a crowded branch is cut into parts, each of which meets each other once.
        parts = F.ceil(F.col("size") / block).cast("int")
        own = F.pmod(F.xxhash64("id"), parts).cast("int")
        pairs_of = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(F.least(p, own).alias("p"), F.greatest(p, own).alias("q")))
        cut = rows.withColumn("c", F.explode(pairs_of)).select("id", "n", "bits_a", "bits_b", F.xxhash64("key", "c.p", "c.q").alias("key"))
        last = self.near(cut)
        return (last if out is None else out.unionByName(last)).distinct()

    def verified(self) -> DataFrame:
        """(a, b, share) of the candidates whose exact share reaches the threshold, one row for two different sets."""
        pairs = written(self.candidates())
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        wanted = wanted.join(self.nodes.select("id", "version"), "id")
        texts = written(self.texts.join(wanted, ["id", "version"]).groupBy("id").agg(F.min("text").alias("text")))
        both = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
        threshold = self.threshold

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, ROWS):
                    part = batch.slice(lo, ROWS)
                    shares = []
                    for s, t in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist(), strict=True):
                        p, q = ({*zip(w, w[1:], w[2:])} for w in (TOKEN.findall(s), TOKEN.findall(t)))
                        both = len(p & q)
                        shares.append(both / (len(p) + len(q) - both))
                    keep = pa.array(s >= threshold for s in shares)
                    yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(shares, pa.float64())], names=["a", "b", "share"]).filter(keep)

        return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a string, b string, share double")

    def pairs(self) -> DataFrame:
        """(id_a, id_b), id_a < id_b: all pairs, those of equal sets and of the copies of similar sets too."""
        links = self.verified()
        copied = self.nodes.where("copies > 1").select(F.col("id").alias("node"), "set_a", "set_b")
        copies = self.members.select("id", "set_a", "set_b").join(copied, ["set_a", "set_b"]).select("node", "id")
        one = lambda c: copies.select(F.col("node").alias(c), F.col("id").alias(f"{c}_id"))
        wide = links.join(one("a"), "a", "left").join(one("b"), "b", "left").select(F.coalesce("a_id", "a").alias("p"), F.coalesce("b_id", "b").alias("q"))
        equal = copies.alias("x").join(copies.alias("y"), (F.col("x.node") == F.col("y.node")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("p"), F.col("y.id").alias("q"))
        return wide.unionByName(equal).select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b"))

    def groups(self) -> DataFrame:
        """(id, group_id, n_links): every text that takes part, its group's least id, and how many different texts it is linked to."""
        links = written(self.verified())
        labels = components(self.nodes.select("id"), links)
        degree = links.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n_links"))
        node = self.nodes.select("id", "set_a", "set_b").join(labels, "id").join(degree, "id", "left").drop("id")
        return self.members.select("id", "set_a", "set_b").join(node, ["set_a", "set_b"]).select("id", F.col("label").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, label): the least id reachable over the links (a, b).

    Labels are hooked to the neighbours' least and then shortened by pointer jumping, so the rounds grow with
    the logarithm of a component's diameter; each round is cut, and none gathers links or labels anywhere.
    Nodes without links are labelled by themselves without taking part in the rounds.
    """
    edges = written(links.select(F.col("a").alias("id"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("other"))))
    labels = cut(edges.select("id").distinct().withColumn("label", F.col("id")))
    while True:
        near = edges.join(labels.withColumnRenamed("id", "other"), "other").groupBy("id").agg(F.min("label").alias("near"))
        hooked = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        # The label's own node may have found a lesser one too.
        best = hooked.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("least"))
        jumped = hooked.join(best, F.col("label") == F.col("root"), "left").select("id", "old", F.least("label", F.coalesce("least", "label")).alias("label"))
        kept = cut(jumped)
        labels = kept.select("id", "label")
        if not kept.where("label <> old").limit(1).count():
            break
    return nodes.join(labels, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _chunks(spark, d: str) -> DataFrame:
    return table(spark, d, "chunks_new", "id", "source_code", "updated_at").select("id", F.col("source_code").alias("text"), F.col("updated_at").alias("version"))


def p6_found(spark, d: str) -> DataFrame:
    """All pairs of chunks of at least 60 words and signs whose source_code shares 0.7 of its triples."""
    return NearDuplicates(_chunks(spark, d)).pairs()


def p6_groups(spark, d: str) -> DataFrame:
    """The group of near-duplicates of every such chunk, with its number of links to different texts."""
    return NearDuplicates(_chunks(spark, d)).groups()


QUERIES = {"p6_found": p6_found, "p6_groups": p6_groups}
#: Every pair's shared triples, counted from an inverted index of all of them.
SQL = {
    "p6_found": r"""WITH t AS (SELECT id, regexp_extract_all(source_code, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s\p{Z}]') AS w FROM (SELECT id, source_code FROM chunks_new WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1) WHERE source_code IS NOT NULL),
        x AS (SELECT DISTINCT id, hash(w[i], w[i + 1], w[i + 2]) AS h FROM (SELECT id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 60)), n AS (SELECT id, count(*) AS n FROM x GROUP BY 1),
        s AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS common FROM x a JOIN x b ON a.h = b.h AND a.id < b.id GROUP BY 1, 2)
        SELECT id_a, id_b FROM s JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE common >= 0.7 * (na.n + nb.n - common)"""
}
