"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks.

Features of a block are the tags and names of the elements around it, its shape as text (length,
link share, stops, case, digits, place) and those of its neighbours' tags. The model is fitted on
TRAIN_PAGES labelled pages of varied layouts (page_samples), which bounds its cost and size
whatever is extracted; it is fitted once on the driver and travels with the task as a table of a few thousand
weights. Pages are independent, so extraction neither shuffles nor gathers anything.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import check_input
from .crf import LinearChain
from .dom import Block, blocks
from .page_samples import Pages

TRAIN_PAGES, EPOCHS, SEED = 700, 6, 11
STEPS = (2, 4, 8, 16, 32, 64, 128)
PHRASE = frozenset(("b", "a", "em", "i", "span", "strong", "font"))


def _shape(block: Block) -> list[str]:
    text = block.text
    n = len(text)
    words = text.count(" ") + 1
    size = sum(words >= s for s in STEPS)
    out = [f"size={size}", f"link={min(4, 4 * block.links // max(n, 1))}"]
    out.append("stop" if text[-1] in ".!?…:;\"'”)" else "open")
    if text.count(".") + text.count(",") >= 2:
        out.append("prose")
    if text.isupper():
        out.append("upper")
    if any(c in text for c in "©®|»·"):
        out.append("sign")
    if sum(map(str.isdigit, text)) * 4 > n:
        out.append("digits")
    return out


def features(page: list[Block]) -> list[list[str]]:
    """Active features of each block."""
    out, last = [], len(page)
    tags = [b.inside.tag if b.inside else "" for b in page]
    shapes = [_shape(b) for b in page]
    for k, b in enumerate(page):
        inner = next((e.tag for e in b.inside.path() if e.tag not in PHRASE), "") if b.inside else ""
        fs = ["bias", f"in={inner}", f"tag={tags[k]}", *shapes[k], f"{inner}:{shapes[k][0]}", f"{inner}:{shapes[k][1]}"]
        if b.inside:
            fs += b.inside.features
        fs.append(f"place={min(9, 10 * k // last)}")
        fs.append(f"before={tags[k - 1] if k else '-'}")
        fs.append(f"after={tags[k + 1] if k + 1 < last else '-'}")
        if k:
            fs.append(f"prev {shapes[k - 1][1]}")
        if k + 1 < last:
            fs.append(f"next {shapes[k + 1][1]}")
        out.append(fs)
    return out


def labelled(seed: int, pages: int) -> Iterator[tuple[list[Block], list[int]]]:
    """Generated pages as blocks and labels."""
    make = Pages(seed)
    for _ in range(pages):
        html, truth = make.page()
        found = blocks(html)
        if [b.text for b in found] != [t for t, _ in truth]:
            raise AssertionError("blocks differ from the page's own")
        yield found, [y for _, y in truth]


@lru_cache
def model(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> LinearChain:
    data = list(labelled(seed, pages))
    return LinearChain().fit([features(b) for b, _ in data], [y for _, y in data], epochs, seed=seed)


def main_text(html: str | None, crf: LinearChain) -> str:
    """Blocks that the model labels as the article's, joined by line feeds."""
    page = blocks(html or "", named_by(crf))
    return "\n".join(b.text for b, y in zip(page, crf.decode(features(page))) if y)


def named_by(crf: LinearChain) -> frozenset[str]:
    """The words of names that the model has weights for: no other changes a score."""
    found = getattr(crf, "known_names", None)
    if found is None:
        found = crf.known_names = frozenset(f[5:] for f in crf.weights if f.startswith("name="))
    return found


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", crf: LinearChain | None = None) -> DataFrame:
    """(id, url, text, n_chars long) for each row of pages.

    text is never null: a null, empty or text-less page, or one without an article, gives the empty
    text. Ids and urls may be null or repeat. Other columns are left aside, whatever their names.
    An empty table gives an empty table.
    """
    check_input(pages, id_col, url_col, html_col)
    fitted = crf or model()
    rows = pages.select(F.col(id_col), F.col(url_col), F.col(html_col).alias("__html"))
    schema = rows.select(id_col, url_col).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [main_text(x.as_py(), fitted) for x in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)
