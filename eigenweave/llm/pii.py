"""Personal data: fixed patterns, and terms that give protected entities away by co-occurrence.

Patterns find e-mail addresses, IP addresses, card and phone numbers. What is protected is an entity
at three levels: the value itself, the group it belongs to (an address's domain, the first half of an
IP address, a card's issuer, a phone's country) and its kind; a value that stands in one document
only has no corpus to measure, its domain or kind has. Corpus counts then measure what other words
disclose (information-theoretic sanitisation): with p from document counts, a term t discloses an
entity e by PMI(e; t) = log p(e, t) / (p(e) p(t)) of the IC(e) = -log p(e) that the entity carries. A
term is a disclosing one if PMI reaches a share `threshold` of IC, that is, if seeing it comes close
to seeing the entity, and if chance is ruled out: were t spread over documents without regard to e,
n(e, t) of its n(t) documents or more would hold e with a probability below exp(-n(t) KL), KL the
divergence of n(e, t) / n(t) from p(e), and n(t) KL must reach SURPRISE. Such terms are found
besides the pattern spans and generalised like these: with `everywhere` in every document that holds
them, else in those with the entity itself.

Documents are the one unit of all counts. Copies and near copies of a passage would make each of its
words a certain sign of its entity; so the terms around an entity in a document make a window, a
document is evidence unless its window is a near copy of one of that entity that ranks earlier, and
an entity or a pair needs `support` documents of evidence. Near copies share all ROWS min-hashes of
one of BANDS bands: at a Jaccard similarity of 0.06 a pair does so with a chance of 4e-9, at 0.8 of
0.99. All counts are over all documents; no group is gathered, no pair of windows is a row, and only
pairs of supported entities are expanded.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import check_input, kept, written
from .tokens import release

KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: Only the first digit of a run can start the leftmost match, which keeps long runs linear.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Terms are runs of letters and digits, the same for both engines.
TERM, NO_TERM = re.compile(r"[^\W_]+"), r"[^\p{L}\p{N}]+"
WINDOW, SUPPORT, THRESHOLD = 20, 3, 0.9
#: Nats: a pair that chance makes with a probability over 1e-9 is no evidence.
SURPRISE = 20.7
BANDS, ROWS = 24, 8
#: Terms whose hashes are broadcast: 8 bytes each, so 2 MB. More are met by a join after counting.
FEW_TERMS = 250_000
_FACTORS, _MASKS, _MIX = (np.random.RandomState(k).randint(0, 1 << 64, BANDS * ROWS, np.uint64) | np.uint64(1) for k in range(3))


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part @ domain: around each @ the run before it and the names after it."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in IN_LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the pattern matches that hold, by kind and place."""
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    if "." in text:
        out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p := part.lstrip("0")) < 4 and int(p or 0) < 256 for part in m.group().split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = re.sub("[^0-9]", "", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m.group())) <= 15]
    return out


def entities(kind: str, value: str) -> list[int]:
    """64-bit keys of a value, its group and its kind. Case and separators don't tell entities apart."""
    if kind in ("email", "ip"):
        plain = value.lower()
        group = plain.rpartition("@")[2] if kind == "email" else ".".join(plain.split(".")[:2])
    else:
        plain = re.sub("[^0-9]", "", value)
        group = plain[:6] if kind == "card" else re.match(r"\+([0-9]{1,3})", value)[1]
    names = (f"{kind}:{plain}", f"{kind}/{group}", kind)
    return [xxhash.xxh64_intdigest(x.encode()) - (1 << 63) for x in names]


def lowered(text: str) -> str:
    """text in lower case, as long as it was: U+0130 is the one letter that would become two."""
    return text.replace("\u0130", "i").lower()


def terms(text: str) -> list[tuple[str, int, int]]:
    """(term, start, end): runs of two letters or digits or more, in lower case."""
    return [(m.group(), *m.span()) for m in TERM.finditer(lowered(text)) if m.end() - m.start() > 1]


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The terms that overlap no span, in one sweep over both."""
    taken = sorted((s, e) for _, s, e in spans)
    out, k, reach = [], 0, 0
    for term in terms(text):
        while k < len(taken) and taken[k][0] < term[2]:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= term[1]:
            out.append(term)
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


FOUND = "base string, n_email long, n_ip long, n_card long, n_phone long, entities array<long>, windows array<struct<e:long, sig:long, bands:array<long>>>, terms array<string>"


def signature(near: list[str]) -> tuple[int, list[int]]:
    """64-bit digest of a set of terms in order, and its bands of min-hashes, each as one number."""
    sig = xxhash.xxh64_intdigest(" ".join(near).encode()) - (1 << 63)
    h = np.array([xxhash.xxh64_intdigest(t.encode(), 1) for t in near], np.uint64)
    least = ((h[:, None] ^ _MASKS) * _FACTORS).min(axis=0)
    mixed = (least ^ (least >> np.uint64(29))) * _MIX
    return sig, mixed.reshape(BANDS, ROWS).sum(axis=1, dtype=np.uint64).view(np.int64).tolist()


def _windows(text: str, spans: list[tuple[str, int, int]], width: int) -> tuple[list[dict], list[str]]:
    """One window for each entity at each level, of the terms around all of its places; and all terms of the text."""
    free = free_terms(text, spans)
    starts = [t[1] for t in free]
    near: dict[int, set[str]] = {}
    for kind, s, e in spans:
        k = bisect_left(starts, s)
        around = [t[0] for t in free[max(0, k - width) : k + width]]
        for key in entities(kind, text[s:e]):
            near.setdefault(key, set()).update(around)
    out = []
    for e, found in near.items():
        if found:
            sig, bands = signature(sorted(found))
            out.append({"e": e, "sig": sig, "bands": bands})
    return out, sorted({t[0] for t in free})


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")


def _scan(rows: DataFrame, width: int) -> DataFrame:
    schema = rows.select("id", "h").schema
    schema = T.StructType([*schema.fields, *T.StructType.fromDDL(FOUND).fields])
    window = pa.struct([("e", pa.int64()), ("sig", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            base, counts, ents, wins, held = [], [], [], [], []
            for text in b.column(2):
                text = text.as_py()
                spans = base_spans(text)
                base.append(joined(spans))
                counts.append([sum(k == kind for k, *_ in spans) for kind in KINDS])
                ents.append(sorted({key for k, s, e in spans for key in entities(k, text[s:e])}))
                own, all_ = _windows(text, spans, width) if spans else ([], [])
                wins.append(own)
                held.append(all_)
            cols = [pa.array(base, pa.string()), *(pa.array(c, pa.int64()) for c in zip(*counts))] if counts else [pa.array([], pa.string()), *[pa.array([], pa.int64())] * 4]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, pa.array(ents, pa.list_(pa.int64())), pa.array(wins, pa.list_(window)), pa.array(held, pa.list_(pa.string()))], [f.name for f in schema])

    return rows.mapInArrow(run, schema)


def independent(windows: DataFrame, support: int) -> DataFrame:
    """(e, sig) of the windows that are no near copy of an earlier window of their entity; the digest ranks them.

    A window that chance takes for a copy costs itself only: links are not followed further, so an
    entity's windows cannot melt into one however many there are.
    """
    enough = windows.select("e", "sig").distinct().groupBy("e").count().where(F.col("count") >= support).select("e")
    some = kept(windows.join(kept(enough), "e", "left_semi").dropDuplicates(["e", "sig"]))
    keyed = some.select("e", "sig", F.posexplode("bands").alias("band", "key"))
    first = keyed.groupBy("e", "band", "key").agg(F.min("sig").alias("first"), F.max("sig").alias("last")).where("first != last")
    copies = keyed.join(kept(first), ["e", "band", "key"]).where("sig != first").select("e", "sig").distinct()
    return kept(some.join(kept(copies), ["e", "sig"], "left_anti").select("e", "sig"))


def _words(text_col: str) -> Column:
    """The terms of a text, each once."""
    return F.explode(F.array_distinct(F.split(F.lower(F.translate(F.col(text_col), "\u0130", "i")), NO_TERM))).alias("t")


def disclosing(docs: DataFrame, found: DataFrame, text_col: str, support: int, threshold: float) -> DataFrame:
    """(e, t, share): terms whose PMI with an entity reaches the threshold's share of its information, chance ruled out.

    Counts are summed within each task before they are shuffled, so what moves is vocabularies, not
    words. Evidence is asked last, of the few pairs that pass all else: windows of t in a document of
    e that are no near copies.
    """
    windows = found.select(F.explode("windows").alias("w"), "terms").select("w.*", "terms")
    lead = independent(windows.drop("terms"), support)
    known = lead.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("e")
    sizes = found.select(F.explode("entities").alias("e")).groupBy("e").agg(F.count(F.lit(1)).alias("n_e"))
    known = kept(sizes.join(known, "e"))
    total = found.count()
    held = windows.drop("bands").join(known.select("e"), "e")
    pairs = held.select("e", F.explode("terms").alias("t")).groupBy("e", "t").agg(F.count(F.lit(1)).alias("n_et"))
    # what t reaches if it stands nowhere but in documents with spans, which no count over all documents exceeds
    p = F.col("n_e") / F.lit(float(max(total, 1)))
    some = found.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n_any"))
    pairs = pairs.where(F.col("n_et") >= support).join(known, "e").where(F.col("n_e") < total).where(F.col("n_et") * -F.log(p) >= SURPRISE)
    pairs = pairs.join(some, "t").where(F.log(F.col("n_et") / F.col("n_any") / p) >= (threshold - 1e-9) * -F.log(p))
    pairs = kept(pairs.select("e", "t", "n_et", "n_e"))
    terms_ = kept(pairs.select("t").distinct())
    n_terms = terms_.count()
    if not n_terms:
        return pairs.select("e", "t", F.lit(1.0).alias("share"))
    df = docs.select(_words(text_col)).where(F.length("t") > 1)
    count = F.count(F.lit(1)).alias("df")
    if n_terms <= FEW_TERMS:  # by their hashes first, and by themselves after counting
        few = F.broadcast(terms_.select(F.xxhash64("t").alias("x")))
        df = df.join(few, F.xxhash64("t") == F.col("x"), "left_semi").groupBy("t").agg(count)
    else:
        df = df.groupBy("t").agg(count).join(terms_, "t", "left_semi")
    n = F.greatest(F.col("df"), F.col("n_et")).cast("double")
    q = F.col("n_et") / n
    chance = n * (q * F.log(q / p) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - p))).otherwise(0.0))
    rated = pairs.join(df, "t").where(q > p).select("e", "t", (F.log(q / p) / -F.log(p)).alias("share"), chance.alias("chance"))
    rated = kept(rated.where((F.col("share") >= threshold) & (F.col("chance") >= SURPRISE)).drop("chance"))
    shown = held.select("e", "sig", F.explode("terms").alias("t")).join(rated, ["e", "t"]).select("e", "t", "share", "sig").distinct()
    shown = shown.join(lead, ["e", "sig"], "left_semi").groupBy("e", "t", "share").agg(F.count(F.lit(1)).alias("n"))
    return kept(shown.where(F.col("n") >= support).drop("n"))


def _term_spans(text: str, wanted: list[str], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    names = set(wanted)
    return [("term", s, e) for t, s, e in free_terms(text, spans) if t in names]


def _revealing(rows: DataFrame, found: DataFrame, support: int, threshold: float, everywhere: bool) -> DataFrame:
    """(k_id, k_h, terms) of the documents with disclosing terms to look for: all that hold one, or those with its entity."""
    pairs = disclosing(rows, found, "text", support, threshold)
    if pairs.isEmpty():
        return rows.select(F.col("id").alias("k_id"), F.col("h").alias("k_h"), F.array().cast("array<string>").alias("terms")).where("false")
    if everywhere:
        hit = rows.select("id", "h", _words("text")).join(pairs.select("t").distinct(), "t")
    else:
        hit = found.select("id", "h", F.explode("entities").alias("e")).distinct().join(pairs, "e")
    return kept(hit.groupBy(F.col("id").alias("k_id"), F.col("h").alias("k_h")).agg(F.sort_array(F.collect_set("t")).alias("terms")))


def _same() -> Column:
    return F.col("id").eqNullSafe(F.col("k_id")) & (F.col("h") == F.col("k_h"))


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, threshold: float = THRESHOLD, everywhere: bool = False) -> DataFrame:
    """A row for each row of docs: id, n_email, n_ip, n_card, n_phone, base, spans.

    base and spans are comma-joined kind:start:end in code points; base holds the patterns' spans by
    kind and start, spans those and then the disclosing terms' as kind `term`, looked for in every
    document with `everywhere`, else only where their entity stands too. A null or empty text
    has none. Ids may be null or repeat; rows equal in id and text get equal spans. Other columns
    are left aside, whatever their names. An empty table gives an empty table.
    """
    check_input(docs, id_col, text_col)
    texts = _texts(docs, id_col, text_col)
    found = written(_scan(texts, window), "found")
    revealing = _revealing(texts, found, support, threshold, everywhere)
    rows = texts.join(revealing, _same()).select("k_id", "k_h", "text", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            more = [joined(_term_spans(t, w, base_spans(t))) for t, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(more, pa.string())], ["k_id", "k_h", "more"])

    more = rows.mapInArrow(run, rows.select("k_id", "k_h").schema.add("more", "string")).distinct()
    out = found.select("id", "h", "n_email", "n_ip", "n_card", "n_phone", "base").join(kept(more), _same(), "left")
    spans = F.concat_ws(",", *(F.when(F.col(c) != "", F.col(c)) for c in ("base", "more")))
    return out.select(F.col("id").alias(id_col), "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with each span generalised to its kind; spans that overlap become one, named after the first."""
    parts, at = [], 0
    for kind, s, e in sorted(spans, key=lambda x: (x[1], -x[2])):
        if s >= at:
            parts += [text[at:s], f"[{kind.upper()}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, support: int = SUPPORT, threshold: float = THRESHOLD, everywhere: bool = False) -> DataFrame:
    """docs with every span of find_personal() replaced by its kind in brackets; null texts stay null, all rows and columns stay."""
    check_input(docs, id_col, text_col)
    texts = _texts(docs, id_col, text_col)
    found = written(_scan(texts, window), "found")
    revealing = _revealing(texts, found, support, threshold, everywhere)
    rows = docs.select(F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"))
    rows = rows.join(revealing, _same(), "left").select("text", "row", "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for b in batches:
            out = []
            for t, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                spans = base_spans(t) if t else []
                out.append(replaced(t, spans + _term_spans(t, w or [], spans)) if spans or w else t)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), b.column(1)], ["text", "row"])

    done = rows.mapInArrow(run, rows.select("text", "row").schema)
    return done.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns))
