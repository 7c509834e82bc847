"""SimHash near-duplicate detection through deletion-variant signatures.

Two 64-bit fingerprints that differ in at most `distance` bits are linked. A fingerprint is cut
into `distance // 2 + 1` segments, fewer than the usual `distance + 1`, so that of any linked pair
one segment differs in at most one bit. A segment is indexed under each of its one-wildcard
variants (the segment with one bit deleted, and that bit's place). Segments that differ in at most
one bit share a variant, so an equality join on variants finds every linked pair, and the full
Hamming distance verifies it.

Only connectedness is asked for, so pairs inside a group are not listed. Links are found in rounds,
each of which contracts what it has connected:

1. In buckets of equal segments every fingerprint is compared with the one there that the most
   documents have. That connects most of a group of near copies at the cost of its size.
2. Buckets of one-wildcard variants that hold several components by now: a bucket of two is one
   pair, compared as it is counted. In larger ones, members outside the bucket's main component
   (one of the largest size class there) ask whether it has a member they are linked with.
3. Members still outside are joined with each other where their components differ.

Every pair that shares a variant is thereby compared, or lies in one component already.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import check_input, kept, written
from .components import connected_components
from .tokens import release

BITS = 64
#: Members of a bucket that one task compares with an outsider, at most about so many.
SALT = 8192
#: Shingles whose bits are counted at once, which bounds memory for very long texts.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of the word shingles of UTF-8 text, as an unsigned integer; 0 if it has no word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), seed)  # over half of one hash: its own bits
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(tokens) - words + 1
    s, e = starts[:n].tolist(), ends[words - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, BLOCK):
        h = np.fromiter([digest(joined[i:j], seed) for i, j in zip(s[k : k + BLOCK], e[k : k + BLOCK])], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """docs' columns but the text, with `fp` long. A null text counts as empty."""
    check_input(docs, text_col)
    kept = [c for c in docs.columns if c != text_col]
    src = docs.select(F.col(text_col).cast("binary").alias("__text"), *kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), words, seed) for t in b.column(0)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(fp.view(np.int64))], [*kept, "fp"])

    schema = docs.select(*kept).schema.add("fp", "long")
    return src.mapInArrow(run, schema)


def segments(distance: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments of which one differs in at most one bit."""
    n = max(2, distance // 2 + 1)  # keys of two segments or more fit 64 bits
    cuts = [round(i * bits / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(fp: Column, distance: int) -> Column:
    """Array of one key for each bit: the segment around it without that bit, and the bit's number."""
    keys = []
    for low, width in segments(distance):
        seg = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1)
        for i in range(width):
            rest = seg.bitwiseAND(~(1 << i))
            keys.append(F.shiftleft(rest.cast("long"), 6).bitwiseOR(F.lit(low + i).cast("long")))
    return F.array(*keys)


def _apart(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _equal_segments(fp: Column, distance: int) -> Column:
    return F.array(*(F.shiftleft(F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1).cast("long"), 6).bitwiseOR(F.lit(low).cast("long")) for low, width in segments(distance)))


def _edges(links: DataFrame, a: str, b: str) -> DataFrame:
    return links.select(F.col(a).alias("src"), F.col(b).alias("dst"))


def link_components(prints: DataFrame, distance: int = 4) -> DataFrame:
    """(fp, root) for every fp of prints(fp, n), which holds each fp once with its number of documents.

    Variants are shuffled twice: summed up within tasks to find the buckets that matter, and as rows
    to meet those. Joins on their keys are merge joins of two plain exchanges, which adaptive
    execution splits where a key is hot: a broadcast would be chosen for small inputs only.
    """
    if not 0 <= distance <= 40:
        raise ValueError("distance must be from 0 to 40: shorter segments index nothing")
    wide = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    fps = prints.select("fp", "n")
    near = fps.select("fp", "n", F.explode(_equal_segments(F.col("fp"), distance)).alias("key"))
    pivots = near.groupBy("key").agg(F.max(F.struct("n", "fp"))["fp"].alias("pivot"), F.min("fp").alias("lo"), F.max("fp").alias("hi"))
    pivots = pivots.where("lo != hi").select(F.col("key").alias("k"), "pivot")
    linked = (F.col("key") == F.col("k")) & (F.col("fp") != F.col("pivot")) & (_apart("fp", "pivot") <= distance)
    first = connected_components(_edges(near.join(pivots.hint("merge"), linked), "fp", "pivot"))
    grown = first.groupBy("root").agg(F.count(F.lit(1)).alias("members"))
    first = first.join(grown, "root").select(F.col("node").alias("fp"), "root", "members")
    known = fps.join(first, "fp", "left").select("fp", F.coalesce("root", "fp").alias("c"), F.coalesce("members", F.lit(1)).alias("members"))
    known = written(known, "known")

    # plain minima and maxima of numbers: hash aggregation sums up within a task before the shuffle
    each = known.repartition(wide, "fp").select("fp", "c", "members", F.explode(variants(F.col("fp"), distance)).alias("key"))
    among = lambda least, name: F.max(F.when(F.col("members") >= least, F.col("c"))).alias(name)
    buckets = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("fp").alias("lo"), F.max("fp").alias("hi"), F.min("c").alias("c0"), F.max("c").alias("c1"), among(2, "m1"), among(64, "m2"), among(4096, "m3"))
    chance = (F.col("size") == 2) & (_apart("lo", "hi") > distance)
    buckets = written(buckets.where((F.col("c0") != F.col("c1")) & ~chance), "buckets")
    twos = buckets.where("size = 2").select("c0", "c1")
    larger = buckets.where("size > 2").select(F.col("key").alias("k"), F.coalesce("m3", "m2", "m1", "c1").alias("main"), F.ceil(F.col("size") / SALT).cast("int").alias("salts"))
    members = each.select("key", "fp", "c").join(larger.hint("merge"), F.col("key") == F.col("k")).select("key", "fp", "c", "main", "salts")
    members = written(members, "members")
    outside = members.where("c != main")
    # a hot bucket's main members are dealt out by salt, and its few outsiders ask each of them
    asking = outside.select(F.col("key").alias("k"), F.col("fp").alias("other"), F.col("c").alias("own"), "main", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("s"))
    told = members.where("c = main").select("key", "fp", F.pmod(F.xxhash64("fp"), "salts").cast("int").alias("salt"))
    meets = (F.col("key") == F.col("k")) & (F.col("salt") == F.col("s")) & (_apart("fp", "other") <= distance)
    to_main = asking.join(told.hint("merge"), meets, "left_semi")
    second = connected_components(_edges(twos, "c0", "c1").unionByName(_edges(to_main, "own", "main")))
    second = second.select(F.col("node").alias("c"), F.col("root").alias("top"))

    left = outside.join(second, "c", "left").select("key", "fp", F.coalesce("top", "c").alias("c"))
    right = left.select(F.col("key").alias("k"), F.col("fp").alias("other"), F.col("c").alias("own"))
    pairs = left.join(right, (F.col("key") == F.col("k")) & (F.col("c") < F.col("own")) & (_apart("fp", "other") <= distance))
    third = connected_components(_edges(pairs, "c", "own")).select(F.col("node").alias("top"), F.col("root").alias("last"))
    named = known.drop("members").join(second, "c", "left").select("fp", F.coalesce("top", "c").alias("top"))
    return named.join(third, "top", "left").select("fp", F.coalesce("last", "top").alias("root"))


def labelled(docs: DataFrame, id_col: str, text_col: str, words: int, distance: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(id, fp, root, component) for each row of docs, and (fp, root, component) for each fingerprint; root names the component by one."""
    check_input(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = written(fingerprints(rows, "text", words, seed), "prints")
    reps = prints.groupBy("fp").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"))
    named = written(reps.join(link_components(reps, distance), "fp").select("fp", "rep", "root"), "named")
    least = kept(named.groupBy("root").agg(F.min("rep").alias("component")))  # by itself, so that the join is of two plain exchanges
    classes = named.join(least, "root").select("fp", "root", "component")
    return prints.join(classes, "fp").select("id", "fp", "root", "component"), classes


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """One row (id, fp long, component long) for each row of docs.

    component is the smallest id that links of at most `distance` differing bits reach. Null and
    wordless texts have fingerprint 0 and are linked like any other. Rows with a null id take part,
    but no component is named after them: it is null if no member has an id. Repeated rows come out
    as often as they came in. Other columns of docs are left aside, whatever their names. An empty
    table gives an empty table.
    """
    return labelled(docs, id_col, text_col, words, distance, seed)[0].select(F.col("id").alias(id_col), "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, distance: int = 4, seed: int = 42) -> DataFrame:
    """docs without near-duplicates: one row of each component stays, with its smallest id.

    Of its rows with that id one of those with the smallest fingerprint stays, so an id stays as
    often as it names components. Rows without an id stay only if no row of their component
    has one, and then one of them stays.
    """
    found, classes = labelled(docs, id_col, text_col, words, distance, seed)
    winners = found.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.max(F.col("id") == F.col("component")).alias("won")).where("won")
    winners = written(winners.select(F.col("id").alias(id_col), "rows"), "winners")
    # merged at any size: winners are most of the documents, so only a small input could broadcast them
    single = docs.join(winners.where("rows = 1").select(id_col).hint("merge"), id_col, "left_semi")
    out = single.select(docs.columns)
    repeated = winners.where("rows > 1").select(id_col)
    if not repeated.isEmpty():
        own = found.where(F.col("id") == F.col("component")).join(repeated.withColumnRenamed(id_col, "id"), "id", "left_semi")
        chosen = kept(own.groupBy("root").agg(F.min(F.struct("id", "fp")).alias("w")).select("w.id", "w.fp"))
        rows = docs.join(repeated, id_col, "left_semi").select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        picked = fingerprints(rows, "text", words, seed).join(chosen, ["id", "fp"], "left_semi").dropDuplicates(["id", "fp"])
        out = out.unionByName(picked.select("row.*"))
    nameless = classes.where("component is null").groupBy("root").agg(F.min("fp").alias("fp"))
    if not nameless.isEmpty():
        chosen = kept(nameless.select("fp"))
        rows = docs.where(F.col(id_col).isNull()).select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
        picked = fingerprints(rows, "text", words, seed).join(chosen, "fp", "left_semi").dropDuplicates(["fp"])
        out = out.unionByName(picked.select("row.*"))
    return out
