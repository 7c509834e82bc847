"""Quality rules whose thresholds adapt to language and source through mergeable quantile sketches.

A sketch is a histogram over logarithmic buckets (ratio GAMMA, so a quantile is off by half a
bucket at most). Sketches merge by adding counts, exactly and in any order: the sketch of a
language is the sum of its sources', the whole corpus' the sum of its languages', and a rerun gives
the same thresholds. They hold the documents that pass the base rules. Every language and source
has its own fences, which alone decide; a group of fewer than MIN_DOCS documents takes its
language's, a small language the corpus'. Fences are then joined to the documents and filter them.

A share of counts (symbols, equal lines, repeated words) counts only as far as it stands out of the
noise of small counts: k of n is max(0, k - NOISE * sqrt(k)) / n. Its fence is the median plus
TAIL_SPREADS times the way from there to the 0.9 quantile, so where most documents have none,
whatever stands out is rejected, and where a habit is common it is allowed. Word length has a fence on
either side, SPREADS times the way from the quartile to the median away from it. A side whose
quartile is the median itself (as in a group of copies) tells no spread: the next larger group that tells one gives the fence,
and if none does there is none.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_input, kept, written
from .tokens import release

GAMMA, ZERO = 1.005, 1e-4
MIN_DOCS = 100
SPACES, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
STATS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: metric: (numerator, denominator). All but the last are shares of counts, with an upper fence only.
METRICS = {"symbol_ratio": ("n_symbols", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"), "word_length": ("word_chars", "n_words")}
TWO_SIDED = "word_length"
NOISE, TAIL_SPREADS, SPREADS = 2.0, 16.0, 8.0
QUANTILES = (0.25, 0.5, 0.75, 0.9)
NONE = -(1 << 30)


def text_stats(data: bytes, text: str) -> tuple[int, ...]:
    """STATS of one text, given as UTF-8 and as a string."""
    words = data.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three which the text holds twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pair = ids[:-1] * len(number) + ids[1:]
    if len(number) > 1 << 20:  # three numbers don't fit 63 bits: number the pairs
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(number) + ids[2:]
    _, at, count = np.unique(window, return_inverse=True, return_counts=True)
    twice = count[at] > 1
    if not twice.any():
        return 0
    inside = np.zeros(n, bool)
    for k in range(3):
        inside[k : n - 2 + k] |= twice
    return int(inside.sum())


def document_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' columns but the text, and STATS as longs. A null text counts as empty."""
    check_input(docs, text_col)
    kept = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            rows = ((t.as_py() or "") for t in b.column(0))
            stats = np.array([text_stats(t.encode(), t) for t in rows], np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c) for c in stats.T)], [*kept, *STATS])

    schema = docs.select(*kept).schema
    for c in STATS:
        schema = schema.add(c, "long")
    return docs.select(F.col(text_col).alias("__text"), *kept).mapInArrow(run, schema)


def base_failed() -> Column:
    """Under 50 words, or over half of them in repeated windows."""
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _ratio(metric: str) -> Column:
    top, bottom = METRICS[metric]
    k = F.col(top).cast("double")
    out = k if metric == TWO_SIDED else F.greatest(F.lit(0.0), k - NOISE * F.sqrt(k))
    return F.when(F.col(bottom) > 0, out / F.col(bottom)).otherwise(F.lit(0.0))


def _bucket(value: Column) -> Column:
    return F.when(value < ZERO, F.lit(NONE)).otherwise(F.floor(F.log(value) / math.log(GAMMA)).cast("int"))


def _value(bucket: Column) -> Column:
    return F.when(bucket == NONE, 0.0).otherwise(F.pow(F.lit(GAMMA), bucket + 0.5))


def sketches(stats: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """(lang, source, metric, bucket, n): one mergeable sketch for each group and metric, over documents that pass the base rules."""
    each = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), _bucket(_ratio(m)).alias("bucket")) for m in METRICS))).alias("x")
    rows = stats.where(~base_failed()).select(F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), each)
    return rows.groupBy("lang", "source", "x.metric", "x.bucket").agg(F.count(F.lit(1)).alias("n"))


def quantiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """by, metric, docs, q25, q50, q75 and q90 of the sketches merged over `by`.

    A window here holds one sketch: at most 6,000 buckets lie between 1e-4 and 1e9, whatever the number of documents.
    """
    merged = sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "metric")
    merged = merged.withColumn("upto", F.sum("n").over(whole.orderBy("bucket"))).withColumn("docs", F.sum("n").over(whole))
    at = lambda q: _value(F.min(F.when(100 * F.col("upto") >= round(100 * q) * F.col("docs"), F.col("bucket")))).alias(f"q{round(100 * q)}")
    return merged.groupBy(*by, "metric").agg(F.max("docs").alias("docs"), *map(at, QUANTILES))


def fences(sketch: DataFrame, spreads: float = SPREADS, min_docs: int = MIN_DOCS, tail_spreads: float = TAIL_SPREADS) -> DataFrame:
    """(lang, source, <metric>_high, word_length_low) for every group in the sketches; null: no fence on that side."""
    q = ["docs", *(f"q{round(100 * x)}" for x in QUANTILES)]
    packed = lambda by, name: quantiles(sketch, by).select(*(F.col(c).alias(f"{name}_{c}") for c in by), F.col("metric").alias(f"{name}_m"), F.struct(*q).alias(name))
    own, lang, all_ = packed(["lang", "source"], "own"), packed(["lang"], "mid"), packed([], "top")
    joined = own.join(lang, (F.col("own_m") == F.col("mid_m")) & F.col("own_lang").eqNullSafe(F.col("mid_lang"))).join(all_, F.col("own_m") == F.col("top_m"))

    def first(told: Callable[[str], Column], fence: Callable[[str], Column]) -> Column:
        """The fence of the smallest group that is large enough and tells a spread."""
        large = {"own": F.col("own.docs") >= min_docs, "mid": F.col("mid.docs") >= min_docs, "top": F.lit(True)}
        return F.coalesce(*(F.when(enough & told(g), fence(g)) for g, enough in large.items()))

    tail = first(lambda g: F.lit(True), lambda g: F.col(f"{g}.q50") + tail_spreads * (F.col(f"{g}.q90") - F.col(f"{g}.q50")))
    above = first(lambda g: F.col(f"{g}.q25") < F.col(f"{g}.q50"), lambda g: F.col(f"{g}.q50") + spreads * (F.col(f"{g}.q50") - F.col(f"{g}.q25")))
    below = first(lambda g: F.col(f"{g}.q75") > F.col(f"{g}.q50"), lambda g: F.col(f"{g}.q50") - spreads * (F.col(f"{g}.q75") - F.col(f"{g}.q50")))
    here = lambda m, fence: F.max(F.when(F.col("own_m") == m, fence))
    out = [here(m, above if m == TWO_SIDED else tail).alias(f"{m}_high") for m in METRICS]
    return joined.groupBy(F.col("own_lang").alias("lang"), F.col("own_source").alias("source")).agg(*out, here(TWO_SIDED, below).alias(f"{TWO_SIDED}_low"))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spreads: float = SPREADS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, STATS, base_failed boolean, kept boolean) for each row of docs.

    base_failed: under 50 words, or over half of the words repeated. A document is kept if it isn't
    base_failed and each metric lies inside its group's fences; on a fence is inside. Null and empty
    texts have no words and fail; null languages and sources are groups of their own. Ids may be null or repeat, every row is
    judged. Other columns are left aside, whatever their names. An empty table gives an empty one.
    """
    check_input(docs, id_col, text_col, lang_col, source_col)
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    stats = written(document_stats(rows, "text"), "stats")
    return _verdicts(stats, spreads, min_docs).select(F.col("id").alias(id_col), *STATS, "base_failed", "kept")


def _verdicts(stats: DataFrame, spreads: float, min_docs: int) -> DataFrame:
    sketch = kept(sketches(stats, "lang", "source"))
    fence = kept(fences(sketch, spreads, min_docs).withColumnsRenamed({"lang": "f_lang", "source": "f_source"}))
    out = stats.join(fence, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    inside = _ratio(TWO_SIDED) >= F.coalesce(f"{TWO_SIDED}_low", F.lit(0.0))
    for m in METRICS:
        inside &= _ratio(m) <= F.coalesce(f"{m}_high", F.lit(float("inf")))
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & inside)


def passing(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spreads: float = SPREADS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of docs that judge() keeps, with docs' own columns: statistics are written with the rows.

    Null, empty and short texts go with the base rules; ids play no part, so rows that repeat or
    have none are judged each by itself. An empty table gives an empty table. Names of columns
    don't clash with the operator's own, as the row travels as one struct.
    """
    check_input(docs, text_col, lang_col, source_col)
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.struct(*docs.columns).alias("row"))
    stats = written(document_stats(rows, "text"), "stats")
    return _verdicts(stats, spreads, min_docs).where("kept").select("row.*")
