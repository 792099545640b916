"""Filling containers of fixed capacity: best-fit decreasing over a segment tree of remaining capacities.

The decisions of best-fit decreasing depend on an item's size alone, so they are
taken on the histogram of sizes (at most ``capacity`` rows a group, however many
items there are) and then handed out to the items by their rank among those of
equal size. The result is that of placing the items one by one, while no group
of items ever meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.sources.tables import latest_by, table

#: Ranks among items of equal size are worked out in so many slices, so that a hot size is many tasks.
SLICES = 256


class CapacityTree:
    """A segment tree over the remaining capacities 0..capacity; finds the tightest non-empty one that is large enough."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.used = [0] * (2 * self.leaves)

    def add(self, remaining: int, n: int) -> None:
        at = remaining + self.leaves
        while at:
            self.used[at] += n
            at //= 2

    def tightest(self, least: int) -> int | None:
        """The smallest remaining capacity >= least that some open class has; None if none has."""
        if least >= self.leaves:
            return None
        at = least + self.leaves
        if self.used[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.used[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(histogram: Iterable[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (size, from_rank, to_rank, first_container, per_container) that place every item.

    ``histogram`` has (size, count) with 0 <= size <= capacity. The items of one size
    with ranks in [from_rank, to_rank) go to the containers from first_container on,
    per_container to each. Containers are alike in runs of consecutive numbers, so
    one step serves a whole run: the tightest container, once it has taken an item,
    stays the tightest while the next of that size still fits.
    """
    tree, runs, rows, containers = CapacityTree(capacity), {}, [], 0

    def put(remaining: int, first: int, n: int) -> None:
        runs.setdefault(remaining, []).append((first, n))
        tree.add(remaining, 1)

    for size, count in sorted(histogram, reverse=True):
        rank = 0
        while rank < count:
            left = count - rank
            remaining = tree.tightest(size)
            if remaining is None:
                remaining, first = capacity, containers
                n = 1 if not size else -(-left // (capacity // size))
                containers += n
            else:
                first, n = runs[remaining].pop()
                tree.add(remaining, -1)
            each = left if not size else min(remaining // size, left)
            whole = min(n, left // each)
            rows.append((size, rank, rank + whole * each, first, each))
            rank += whole * each
            put(remaining - each * size, first, whole)
            if whole < n:
                rest = count - rank
                if 0 < rest < each:
                    rows.append((size, rank, count, first + whole, rest))
                    put(remaining - rest * size, first + whole, 1)
                    rank, whole = count, whole + 1
                if whole < n:
                    put(remaining, first + whole, n - whole)
    return rows


def sized_chunks(chunks: DataFrame, models: DataFrame, default_capacity: int = 512) -> DataFrame:
    """(id, embedding_model_id, tokens, capacity), each id once: its row with the latest updated_at.

    tokens is token_count, or floor(bytes of content / 4) where that is null or not
    positive (0 for null content). capacity is the model's max_sequence_length, or
    ``default_capacity`` for a model that is null, unknown or has none. Rows without an id are left out.
    """
    tokens = F.when(F.col("token_count") > 0, F.col("token_count").cast("long")).otherwise(F.floor(F.coalesce(F.octet_length("content"), F.lit(0)) / 4))
    rows = chunks.where("id is not null").select("id", "embedding_model_id", tokens.alias("tokens"), "updated_at")
    rows = latest_by(rows, ["id"], "updated_at")
    known = models.where("id is not null and max_sequence_length > 0").groupBy(F.col("id").alias("embedding_model_id")).agg(F.max("max_sequence_length").alias("capacity"))
    return rows.join(known, "embedding_model_id", "left").select("id", "embedding_model_id", "tokens", F.coalesce("capacity", F.lit(default_capacity)).cast("int").alias("capacity"))


def pack(items: DataFrame, slices: int = SLICES) -> DataFrame:
    """(id, piece, n_tokens, embedding_model_id, capacity, container): every id, in containers of its model.

    ``items`` has id (unique), embedding_model_id, tokens, capacity. An item longer than its
    capacity is divided into pieces that each fill a container and one rest; no other is divided.
    An item of no tokens gets a container too. A null model is a group of its own. An empty table gives an empty one.
    """
    group = ["embedding_model_id", "capacity"]
    full = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("long")
    items = items.withColumn("full", full).withColumn("rest", F.col("tokens") - F.col("full") * F.col("capacity"))
    name = F.coalesce("embedding_model_id", F.lit("(null)"))
    whole = (
        items.where("full > 0")
        .select("id", F.explode(F.sequence(F.lit(0), F.col("full").cast("int") - 1)).alias("piece"), *group)
        .select("id", "piece", F.col("capacity").cast("long").alias("n_tokens"), *group, F.concat(name, F.lit("/whole/"), "id", F.lit("/"), F.col("piece")).alias("container"))
    )
    rests = items.where("full = 0 or rest > 0").select("id", F.col("full").cast("int").alias("piece"), F.col("rest").alias("size"), *group, F.pmod(F.xxhash64("id"), F.lit(slices)).alias("slice"))

    # Counts by slice serve both the histogram and the ranks' offsets; they hold at most capacity * slices rows a group.
    counts = rests.groupBy(*group, "size", "slice").agg(F.count("*").alias("n"))
    before = Window.partitionBy(*group, "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "size", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = best_fit_decreasing(zip(pdf["size"].tolist(), pdf["n"].tolist(), strict=True), int(pdf["capacity"].iloc[0]))
        out = pd.DataFrame(rows, columns=["size", "from_rank", "to_rank", "first", "each"], dtype="int64")
        out.insert(0, "capacity", int(pdf["capacity"].iloc[0]))
        out.insert(0, "embedding_model_id", pdf["embedding_model_id"].iloc[0])
        return out

    histogram = counts.groupBy(*group, "size").agg(F.sum("n").alias("n"))
    places = histogram.groupBy(*group).applyInPandas(place, "embedding_model_id string, capacity int, size long, from_rank long, to_rank long, first long, each long")

    ranked = rests.withColumn("at", F.row_number().over(Window.partitionBy(*group, "size", "slice").orderBy("id")) - 1)
    i, o, p = ranked.alias("i"), offsets.alias("o"), places.alias("p")
    same = lambda a, b, *more: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in (*group, "size", *more)]
    i = i.join(o, same("i", "o", "slice")).select("i.*", (F.col("i.at") + F.col("o.offset")).alias("rank")).alias("i")
    inside = (F.col("i.rank") >= F.col("p.from_rank")) & (F.col("i.rank") < F.col("p.to_rank"))
    number = F.col("p.first") + F.floor((F.col("i.rank") - F.col("p.from_rank")) / F.col("p.each"))
    shared = i.join(p, [*same("i", "p"), inside]).select(
        "i.id", "i.piece", F.col("i.size").alias("n_tokens"), "i.embedding_model_id", "i.capacity", F.concat(F.coalesce("i.embedding_model_id", F.lit("(null)")), F.lit("/"), number).alias("container")
    )
    return shared.unionByName(whole)


def _sized(spark, d: str) -> DataFrame:
    return sized_chunks(table(spark, d, "chunks_new", "id", "embedding_model_id", "token_count", "content", "updated_at"), table(spark, d, "embedding_models", "id", "max_sequence_length"))


def p1_containers(spark, d: str) -> DataFrame:
    """Every chunk of chunks_new with the container of each of its pieces."""
    return pack(_sized(spark, d))


def p1_coverage(spark, d: str) -> DataFrame:
    """By model, from the packed pieces: chunks, their tokens, and the most tokens in a container, which must not be over capacity."""
    pieces = pack(_sized(spark, d))
    held = pieces.groupBy("embedding_model_id", "capacity", "container").agg(F.sum("n_tokens").alias("held"), F.sum((F.col("piece") == 0).cast("int")).alias("chunks"))
    return held.groupBy("embedding_model_id").agg(F.sum("chunks").alias("n_chunks"), F.sum("held").alias("n_tokens"), F.max(F.greatest(F.col("held") - F.col("capacity"), F.lit(0))).alias("over_capacity"))


def p1_fill(spark, d: str) -> DataFrame:
    """By model: containers, the least that could do, and the share of space left unused."""
    held = pack(_sized(spark, d)).groupBy("embedding_model_id", "capacity", "container").agg(F.sum("n_tokens").alias("held"))
    return held.groupBy("embedding_model_id", "capacity").agg(
        F.count("*").alias("n_containers"), F.ceil(F.sum("held") / F.first("capacity")).alias("least_possible"), F.round(1 - F.sum("held") / F.sum("capacity"), 6).alias("unused")
    )


QUERIES = {"p1_containers": p1_containers, "p1_coverage": p1_coverage, "p1_fill": p1_fill}
SQL = {
    "p1_coverage": """
        WITH latest AS (
          SELECT id, embedding_model_id, CASE WHEN token_count > 0 THEN token_count ELSE coalesce(strlen(content), 0) // 4 END AS tokens
          FROM chunks_new WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1)
        SELECT embedding_model_id, count(*) AS n_chunks, sum(tokens)::BIGINT AS n_tokens, 0::BIGINT AS over_capacity FROM latest GROUP BY 1"""
}
