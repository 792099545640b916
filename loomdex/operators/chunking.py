"""The line-budget chunker of texts that have no parser, as one fold inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_chunks(texts: DataFrame, key: str, text: str, budget: int = 800) -> DataFrame:
    """(key, chunk, content, line_start, line_end, char_start, char_end) of each text.

    Lines are added, each with a newline, until the next would bring a chunk over ``budget`` bytes; a longer line is a
    chunk by itself. Offsets are bytes. The last chunk's line_end is -1. Null and empty texts have no chunks; a newline at
    the end makes no line.
    """
    lines = F.split(F.regexp_replace(F.col(text), r"\n\z", ""), "\n")
    numbered = F.transform(lines, lambda x, n: F.struct(x.alias("t"), (n + 1).cast("int").alias("n"), F.octet_length(x).cast("int").alias("b")))
    part = "struct<first:int,last:int,size:int,from:int>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit(0).alias("first"), F.lit(0).alias("last"), F.lit(0).alias("size"), F.lit(0).alias("at"))

    def closed(acc: Column, last: Column) -> Column:
        return F.concat(acc["done"], F.array(F.struct(acc["first"].alias("first"), last.cast("int").alias("last"), acc["size"].alias("size"), (acc["at"] - acc["size"]).cast("int").alias("from"))))

    def add(acc: Column, x: Column) -> Column:
        flush = (acc["size"] + x["b"] > budget) & (acc["size"] > 0)
        fresh = flush | (acc["size"] == 0)
        return F.struct(
            F.when(flush, closed(acc, acc["last"])).otherwise(acc["done"]).alias("done"), F.when(fresh, x["n"]).otherwise(acc["first"]).cast("int").alias("first"), x["n"].alias("last"),
            (F.when(fresh, 0).otherwise(acc["size"]) + x["b"] + 1).cast("int").alias("size"), (acc["at"] + x["b"] + 1).cast("int").alias("at"),
        )

    folded = F.aggregate(numbered, start, add, lambda acc: F.when(acc["size"] > 0, closed(acc, F.lit(-1))).otherwise(acc["done"]))
    rows = texts.where(F.length(text) > 0).select(key, lines.alias("__lines"), F.posexplode(folded).alias("chunk", "c"))
    stop = F.when(F.col("c.last") == -1, F.size("__lines")).otherwise(F.col("c.last"))
    content = F.concat(F.array_join(F.slice("__lines", F.col("c.first"), stop - F.col("c.first") + 1), "\n"), F.lit("\n"))
    return rows.select(key, "chunk", content.alias("content"), F.col("c.first").alias("line_start"), F.col("c.last").alias("line_end"), F.col("c.from").alias("char_start"), (F.col("c.from") + F.col("c.size")).alias("char_end"))
