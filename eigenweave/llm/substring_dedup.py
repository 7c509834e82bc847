"""Substring dedup by unit hashing: of equal units in the corpus the earliest ranked stays.

A text is cut into units that cover it: lines, paragraphs (cut after blank lines) or sentences
(lines cut again after `.`, `!` or `?` and blanks). A unit is normalised (ASCII white space trimmed
and runs of it made one space, A-Z lower-cased) and hashed to 128 bits. Digests are grouped over
the whole corpus; a unit whose digest occurs at an earlier rank, by document id and then by place,
is a repeat and goes, however short it is.

Whole lines don't meet a passage that begins or ends inside a line. With `passages`, the sentences
of lines (or paragraphs) are units besides them: sentences repeated one after another make a run,
across lines and blank lines, and runs of at least so many words go too. Shorter runs of sentences
inside a line that is new as a whole are phrases which many texts share by nature.

Digests and places are shuffled, never texts. A very common unit is met by partial aggregation
first, and then by joins of two plain exchanges, which adaptive execution splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import check_input, written
from .tokens import release

#: A unit ends after a match.
ENDS = {"line": r"\n", "paragraph": r"\n[ \t]*\n\s*", "sentence": r"[.!?]+[ \t]+|\n"}
OUT_ROWS = 50_000


def cut(text: str, ends: re.Pattern) -> list[tuple[int, int]]:
    """Places of the units of a text, one after another."""
    at = [0, *(m.end() for m in ends.finditer(text))]
    if at[-1] < len(text):
        at.append(len(text))
    return list(zip(at, at[1:]))


def units(docs: DataFrame, unit: str, id_col: str, text_col: str, inner: bool = False) -> DataFrame:
    """(id, h, idx, outer, whole, start, end, words, d1, d2) for each unit with a word, which idx numbers.

    h tells texts with equal ids apart, start and end count code points. With `inner` the units are
    the sentences of each outer unit, which `outer` numbers, and `whole` says that a sentence is the
    only one there; an outer unit of several sentences has a row of its own, with a null idx.
    """
    if unit not in ENDS:
        raise ValueError(f"unit must be one of {', '.join(ENDS)}")
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("text"))
    names = ["idx", "outer", "whole", "start", "end", "words", "d1", "d2"]
    kinds = {"whole": "boolean", "d1": "long", "d2": "long"}
    schema = rows.select("id", "h").schema
    for n in names:
        schema = schema.add(n, kinds.get(n, "integer"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        ends, sentence = re.compile(ENDS[unit]), re.compile(ENDS["sentence"])
        for b in batches:
            row, cols, digests = [], ([], [], [], [], [], []), []

            def add(k: int, text: str, values: tuple) -> bool:
                words = text.encode().lower().split()
                if words:
                    row.append(k)
                    for c, x in zip(cols, (*values, len(words))):
                        c.append(x)
                    digests.append(xxhash.xxh3_128_digest(b" ".join(words)))
                return bool(words)

            def out() -> pa.RecordBatch:
                d = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                at = pa.array(row, pa.int64())
                own = [pa.array(c, pa.bool_() if n == "whole" else pa.int32()) for n, c in zip(names, cols)]
                return pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), *own, pa.array(d[:, 0]), pa.array(d[:, 1])], ["id", "h", *names])

            for k, text in enumerate(b.column(2)):
                text, idx = text.as_py(), 0
                for outer, (s, e) in enumerate(cut(text, ends)):
                    parts = [(s + x, s + y) for x, y in cut(text[s:e], sentence)] if inner else [(s, e)]
                    before, first = idx, len(row)
                    for x, y in parts:
                        idx += add(k, text[x:y], (idx, outer, not inner, x, y))
                    if inner and idx == before + 1:  # the sentence stands for the line, up to its ends
                        cols[2][first], cols[3][first], cols[4][first] = True, s, e
                    elif inner and idx > before:
                        add(k, text[s:e], (None, outer, True, s, e))
                if len(row) >= OUT_ROWS:
                    yield out()
                    row, cols, digests = [], ([], [], [], [], [], []), []
            yield out()

    return rows.mapInArrow(run, schema)


def _rank() -> Column:
    return F.struct(F.col("id").isNull().alias("nameless"), "id", "h", "start", F.col("idx").isNull().alias("outside"))


def repeats(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text", passages: int | None = None) -> DataFrame:
    """A row for each unit to remove: id, h, unit, start, end, words, first_id, first_start.

    unit names the kind; with `passages`, sentences in repeated runs of at least so many words come
    besides the repeated units themselves, unless a repeated unit holds them. Units of fewer than
    min_words words stay. first_id and first_start say where the earliest equal unit stands, which
    stays. Rows with a null id rank last, by their texts' hash. Rows that are equal in id and text
    have equal ranks: they stay or go together. Null, empty and wordless texts have no units. Other
    columns are left aside, whatever their names. An empty table gives an empty table.
    """
    check_input(docs, id_col, text_col)
    if passages is not None and unit == "sentence":
        raise ValueError("sentences make passages within lines or paragraphs")
    found = written(units(docs, unit, id_col, text_col, inner=passages is not None), "units")
    common = found.groupBy("d1", "d2").count().where("count > 1").select("d1", "d2")
    again = written(found.join(written(common, "common"), ["d1", "d2"], "left_semi"), "again")
    first = written(again.groupBy("d1", "d2").agg(F.min(_rank()).alias("first")), "first")
    later = again.join(first, ["d1", "d2"]).where(_rank() != F.col("first"))
    later = later.select("id", "h", "idx", "outer", "whole", "start", "end", "words", F.col("first.id").alias("first_id"), F.col("first.start").alias("first_start"))
    later = later.repartition("id", "h").distinct()  # dealt once by document, which all that follows takes as it is
    go = F.col("whole") & (F.col("words") >= min_words)
    if passages is not None:
        own = Window.partitionBy("id", "h").orderBy(F.col("idx").isNull(), "idx")
        later = later.withColumn("run", F.col("idx") - F.row_number().over(own))
        later = later.withColumn("together", F.sum("words").over(Window.partitionBy("id", "h", "run")))
        later = later.withColumn("inside", F.max(go & F.col("idx").isNull()).over(Window.partitionBy("id", "h", "outer")))
        go = F.when(F.col("idx").isNull(), go).otherwise(go | (F.col("together") >= passages) & ~F.col("inside"))
    kind = F.when(F.col("whole"), F.lit(unit)).otherwise("sentence").alias("unit")
    return later.where(go).select(F.col("id").alias(id_col), "h", kind, "start", "end", "words", "first_id", "first_start")


def without_repeats(docs: DataFrame, unit: str = "line", min_words: int = 1, id_col: str = "doc_id", text_col: str = "text", passages: int | None = None) -> DataFrame:
    """docs with repeated units cut from their texts, and `removed` array<struct<start, end>>: places in the original text.

    All rows and columns stay, null texts too, and a text of which all goes is empty. Equal rows are
    cut alike. Names of docs' columns don't clash, as its rows travel as one struct, but for a
    column `removed`, which raises. An empty table gives an empty table.
    """
    check_input(docs, id_col, text_col)
    if "removed" in docs.columns:
        raise ValueError("docs have a column removed already")
    gone = repeats(docs, unit, min_words, id_col, text_col, passages).groupBy(F.col(id_col).alias("g_id"), F.col("h").alias("g_h"))
    gone = written(gone.agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans")), "gone")
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    out = rows.join(gone, (F.col("h") == F.col("g_h")) & F.col("id").eqNullSafe(F.col("g_id")), "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:int,end:int>>"))
    edges = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    stops = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length("text")))
    text = F.when(F.size(spans) == 0, F.col("text")).otherwise(F.array_join(F.zip_with(edges, stops, lambda a, z: F.substring(F.col("text"), a + 1, z - a)), ""))
    return out.select(*(text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns), spans.alias("removed"))
