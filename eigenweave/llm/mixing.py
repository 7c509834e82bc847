"""Mix sources to target weights by hash-threshold histograms, in DataFrame operations only.

Every document has a fixed 64-bit hash. A source's target is a number of whole copies of it and a
rest; of the rest, the documents whose hash lies below the source's threshold are taken once more.
The threshold comes from nested histograms: words are summed by source and by the hash's leading
bits, the bucket in which the running sum passes the rest is the boundary, and only that bucket is
summed again by its next bits. Three levels of 10 bits part 2^30 ways, without a sort of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, check_input, kept, written

LEVELS, STEP = 3, 10


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, *more: Column) -> DataFrame:
    """(id, source, size, h, more) of docs: words of the text, and the hash bits that the levels use."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    h = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.shiftrightunsigned(h, 64 - LEVELS * STEP).alias("h"), *more)


def ranked(sizes: DataFrame) -> DataFrame:
    """sizes with `rank` from 0: sources in code point order, null last. No task sees more than its range of sources."""
    parts = sizes.withColumn("nameless", F.col("source").isNull()).repartitionByRange("nameless", "source").withColumn("part", F.spark_partition_id())
    parts = kept(parts)  # evaluated once, as another evaluation may cut the ranges elsewhere
    counts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row for each range
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("nameless", "source")) - 1
    both = parts.withColumn("inside", inside).join(counts.select(F.col("part").alias("p"), before.alias("before")), F.col("part") == F.col("p"))
    return both.withColumn("rank", F.col("before") + F.col("inside")).drop("nameless", "part", "p", "inside", "before")


def targets(sizes: DataFrame, weights: list[float], cap: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources in code point order, null last, have the weights in turn and share the total by them. A
    target stops at cap times its source's size; what is over is shared again by weight, until no
    target is above. Then target = min(cap * size, level * weight) with one level for all; a round
    of sharing is one aggregation of the sources that stop, and each makes more of them stop.
    """
    turn = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.col("rank"), F.lit(len(weights))) + 1).cast("int"))
    t = ranked(sizes).withColumn("w", turn).withColumn("top", F.lit(float(cap)) * F.col("source_size"))
    t = kept(t.select("source", "source_size", "w", "top", (F.col("top") / F.col("w")).alias("ratio")))
    total, all_w, stopped, level = *t.agg(F.sum("source_size"), F.sum("w")).first(), 0, None
    while all_w:
        level = total / all_w if level is None else (total - full) / (all_w - used)
        low = F.col("ratio") < F.lit(level)
        n, full, used = t.where(low).agg(F.count(F.lit(1)), F.coalesce(F.sum("top"), F.lit(0.0)), F.coalesce(F.sum("w"), F.lit(0.0))).first()
        if n == stopped or used >= all_w:
            break
        stopped = n
    return t.select("source", "source_size", F.least("top", F.lit(float(level or 0)) * F.col("w")).alias("target"))


def thresholds(rows: DataFrame, weights: tuple[float, ...], cap: float) -> DataFrame:
    """(g, source_size, target, whole, below) for each source of rows(source, size, h): whole copies, and one more if h < below."""
    if not weights or min(weights) <= 0 or cap < 1:
        raise ValueError("weights must be positive and cap at least 1")
    sizes = kept(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goal = targets(sizes, list(weights), cap).withColumnRenamed("source", "g").withColumn("whole", whole)
    goal = goal.withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")).withColumn("below", F.lit(0).cast("long"))
    goal = kept(goal)
    same = F.col("source").eqNullSafe(F.col("g"))
    for level in range(1, LEVELS + 1):
        at = rows.select("source", "size", F.shiftright("h", (LEVELS - level) * STEP).alias("bucket"))
        if level > 1:  # only the boundary bucket
            at = at.join(goal.select("g", "below"), same & (F.shiftright("bucket", STEP) == F.col("below"))).drop("g", "below")
        hist = at.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
        run = Window.partitionBy("source").orderBy("bucket")
        hist = hist.withColumn("to", F.sum("n").over(run)).withColumn("from", F.col("to") - F.col("n"))
        hit = hist.join(goal.select("g", "left"), same).where("`from` <= left and left < to")
        place = F.struct("bucket", "from", "to")
        hit = hit.groupBy("source").agg(F.min(place).alias("at")).select("source", "at.*")
        goal = goal.join(hit, same, "left").drop("source")
        first = F.col("below") * (1 << STEP)
        # no bucket is passed if nothing is left or, by rounding, if all of it is: then the last one
        inside = F.coalesce(F.col("bucket"), F.when(F.col("left") > 0, first + (1 << STEP)).otherwise(first))
        nearer = F.when(F.col("to") - F.col("left") < F.col("left") - F.col("from"), 1).otherwise(0) if level == LEVELS else F.lit(0)
        goal = goal.withColumn("below", (inside + nearer).cast("long")).withColumn("left", F.col("left") - F.coalesce(F.col("from"), F.lit(0)))
        goal = kept(goal.drop("bucket", "from", "to"))
    return goal.select("g", "source_size", "target", "whole", "below")


def _copies() -> Column:
    return (F.col("whole") + F.when(F.col("h") < F.col("below"), 1).otherwise(0)).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size long, source_size long, target double, copies int, taken long) for each row of docs.

    size is the number of words, 0 for a null text. copies is how often the mix takes the document,
    at most ceil(cap), and taken = copies * size. A null source is a source. The hash covers id and
    text, so that equal rows are taken alike and rows without an id are told apart by text. Reruns
    agree. A source without words has target 0 and takes nothing. An empty table gives an empty
    table. Other columns are left aside, whatever their names.
    """
    check_input(docs, id_col, text_col, source_col)
    rows = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    out = rows.join(thresholds(rows, weights, cap), F.col("source").eqNullSafe(F.col("g"))).withColumn("copies", _copies())
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), cap: float = 3, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as mix() takes it, with docs' own columns, whose names don't clash as a row travels as one struct.

    Nulls, ties and repeated rows as in mix(): equal rows are taken alike, a null source is a
    source. Documents without words go or stay by their hash. An empty table gives an empty table.
    """
    check_input(docs, id_col, text_col, source_col)
    goal = thresholds(written(sized(docs, id_col, text_col, source_col, seed), "sizes"), weights, cap)
    row = sized(docs, id_col, text_col, source_col, seed, F.struct(*docs.columns).alias("row"))
    out = row.join(goal, F.col("source").eqNullSafe(F.col("g"))).select("row", F.explode(F.array_repeat(F.lit(1), _copies())))
    return out.select("row.*")
