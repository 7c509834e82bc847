import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eigenweave.llm import mixing, quality, queries
from eigenweave.llm.queries import op4_source_mixing, op5_quality_rules
from helpers import agrees

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def water(sizes, cap=3):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, done = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in done]
        left = total - sum(done.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > cap * sizes[s]]
        if not over:
            return done | share
        done |= {s: cap * sizes[s] for s in over}


def check(rows, texts):
    """rows: (doc key, source, size, source_size, target, taken)."""
    sizes = Counter()
    for key, source, size, *_ in rows:
        assert size == len(WORD.findall(texts[key] or ""))
        sizes[source] += size
    want = water(dict(sizes))
    taken, largest = Counter(), Counter()
    for _, source, size, source_size, target, got in rows:
        assert source_size == sizes[source] and target == pytest.approx(want[source])
        assert got <= 3 * size and (size == 0 or got % size == 0)
        taken[source] += got
        largest[source] = max(largest[source], size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= largest[s]


def test_mix_query(spark, sf, texts):
    source = {r["doc_id"]: r["source"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = [(r["doc_id"], source[r["doc_id"]], r["size"], r["source_size"], r["target"], r["taken"]) for r in op4_source_mixing(spark, sf).collect()]
    assert len(got) == len(texts)
    check(got, dict(texts))
    again = {r["doc_id"]: r["taken"] for r in op4_source_mixing(spark, sf).collect()}
    assert again == {r[0]: r[-1] for r in got}


def test_mix_caps_nulls_and_copies(spark, docs_of):
    rows = [(k, "w " * (1 + k % 7), "en", "hot") for k in range(300)] + [(1000 + k, "v " * 5, "en", "tiny") for k in range(2)] + [(2000 + k, "u " * 3, "en", None) for k in range(40)] + [(3000, None, "en", "none"), (3001, "", "en", "none"), (None, "x y z", "en", "Z"), (4000, "é a b", "en", "Z")]
    docs = docs_of(rows)
    texts = dict(enumerate(t for _, t, *_ in rows))
    keyed = {(i, t): k for k, (i, t, *_) in enumerate(rows)}
    got = mixing.mix(docs).collect()
    check([(keyed[r["doc_id"], rows_text], r["source"], r["size"], r["source_size"], r["target"], r["taken"]) for r in got for rows_text in [t for i, t, *_ in rows if i == r["doc_id"]][:1]], texts)
    made = mixing.mixed(docs)
    assert made.columns == docs.columns
    assert Counter(r["doc_id"] for r in made.collect()) == Counter({r["doc_id"]: r["copies"] for r in got if r["copies"]})
    assert mixing.mix(docs.where("false")).count() == 0 and mixing.mixed(docs.where("false")).count() == 0
    empty = mixing.mix(docs.where("source = 'none'")).collect()
    assert [r["taken"] for r in empty] == [0, 0] and {r["target"] for r in empty} == {0.0}
    with pytest.raises(ValueError):
        mixing.mix(docs, weights=())


def test_targets_equal_sharing_again_and_again(spark):
    r = np.random.RandomState(2)
    for sizes in ({f"s{k:03d}é" if k % 3 else f"S{k}": int(10 ** r.uniform(0, 6)) for k in range(200)} | {None: 77}, {f"g{k}": 4**k for k in range(14)}, {"one": 5}, {"a": 0, "b": 0}, {"a": 0, "b": 9, None: 1}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)
        got = {x["source"]: x["target"] for x in mixing.targets(df, [1, 2, 3], 3).collect()}
        want = water(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s], rel=1e-12) for s in want)
    assert mixing.targets(df.where("false"), [1, 2, 3], 3).count() == 0


def test_mix_is_native(spark, sf):
    plan = op4_source_mixing(spark, sf)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def stats(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    many = {w for w, c in Counter(windows).items() if c > 1}
    inside = {k + j for k, w in enumerate(windows) if w in many for j in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(inside)


def test_quality_query(spark, sf, texts):
    got = {r["doc_id"]: r for r in op5_quality_rules(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        n = stats(t)
        r = got[i]
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == n
        assert r["base_failed"] == (n[0] < 50 or 100 * n[4] > 50 * n[0]) and not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("name", ["op5_quality_rules", "op7_warc", "op10_embedding_dedup"])
def test_queries_equal_sql(spark, sf, name):
    assert agrees(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


@pytest.mark.parametrize("text", ["", "\n\n", "a a a a a", "a b c a b c", "x\n\nx\n x\ny\ny", "é|# é <b> & $5%", "one\x0btwo\x0cthree\r\nfour"])
def test_text_stats(text):
    n, chars, symbols, _, dup, repeated = quality.text_stats(text.encode(), text)
    assert (n, chars, symbols, dup, repeated) == stats(text)


def test_quality_separates_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    got = op5_quality_rules(spark, sf).join(labels, "doc_id").where("n_words >= 50").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in got}
    assert share[1] > 0.99 and share[0] < 0.05


def test_sketch_quantiles_merge(spark):
    rng = np.random.RandomState(0)
    rows = [(k % 2, int(x)) for k, x in enumerate(rng.randint(0, 5000, 4000))]
    df = spark.createDataFrame([(f"l{g}", f"s{k % 5}", x, 10_000, 0, 100, 0, 0) for k, (g, x) in enumerate(rows)], "lang string, source string, n_symbols long, word_chars long, n_lines long, n_words long, n_dup_lines long, n_repeat_words long")
    sketch = quality.sketches(df, "lang", "source")
    for by, pick in ((["lang"], lambda g: g == 0), ([], lambda g: True)):
        q = quality.quantiles(sketch, by).where("metric = 'symbol_ratio'" + (" and lang = 'l0'" if by else "")).first()
        k = np.array([v for g, v in rows if pick(g)], float)
        x = np.maximum(0, k - 2 * np.sqrt(k)) / 10_000
        for name, p in (("q25", 0.25), ("q50", 0.5), ("q75", 0.75), ("q90", 0.9)):
            assert q[name] == pytest.approx(np.quantile(x, p, method="inverted_cdf"), rel=0.006)


def prose(k, symbols=0, long=0, n=90):
    """n words of their own, the first ones with a symbol each or longer than usual."""
    return " ".join(f"w{k}x{j}{'#' if j < symbols else ''}{'abcdefgh' if j < long else ''}" for j in range(n))


def test_fences_follow_opposite_habits(docs_of):
    """What is usual in one source is rejected in the other, on either side: no fixed cutoff does that."""
    rows = [(k, prose(k % 7, long=k % 3), "en", "short") for k in range(150)] + [(1000 + k, prose(k % 7, symbols=30 + k % 5, long=85 + k % 3), "en", "long") for k in range(150)]
    rows += [(2000, rows[150][1], "en", "short"), (2001, rows[0][1], "en", "long"), (2002, prose(3, symbols=3), "en", "short")]
    got = {r["doc_id"]: r["kept"] for r in quality.judge(docs_of(rows)).collect()}
    assert all(got[k] for k in range(150)) and all(got[1000 + k] for k in range(150))
    assert not got[2000] and not got[2001] and got[2002]  # three symbols don't stand out of the noise


def test_copies_tell_no_spread(docs_of):
    rows = [(k, prose(1), "en", "copies") for k in range(300)] + [(1000 + k, prose(k % 9, long=k % 6), "en", "copies") for k in range(40)]
    rows += [(2000 + k, prose(k % 9, long=k % 6), "en", "other") for k in range(400)]
    assert all(r["kept"] for r in quality.judge(docs_of(rows)).collect())
    assert all(r["kept"] for r in quality.judge(docs_of(rows[:300])).collect())


def test_sketches_decide(spark):
    """On sf0.01 verdicts follow the fences: with fixed cutoffs in their place others come out, and every fence differs between groups."""
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stats = quality.document_stats(docs).cache()
    rows = stats.where(~quality.base_failed()).collect()
    kept = {r["doc_id"]: r["kept"] for r in op5_quality_rules(spark, sf).collect()}
    fixed = lambda r: r.n_symbols <= 0.05 * r.word_chars and r.n_dup_lines <= 0.5 * r.n_lines and r.n_repeat_words <= 0.45 * r.n_words and 3 * r.n_words <= r.word_chars <= 9 * r.n_words
    assert sum(kept[r.doc_id] != fixed(r) for r in rows) > 0 and sum(not kept[r.doc_id] for r in rows) > 20
    fence = quality.fences(quality.sketches(stats, "lang", "source")).collect()
    assert len({f.word_length_high for f in fence}) >= 4 and len({f.word_length_low for f in fence}) >= 4 and len({f.repeat_ratio_high for f in fence}) >= 4
    stats.unpersist()


def test_fences_fall_back_and_edges(docs_of):
    rows = [(k, prose(k % 9, long=k % 4), "en", "clean") for k in range(150)]
    rows += [(1000 + k, prose(k % 9, symbols=30 + k % 9, long=k % 4), "en", "markup") for k in range(150)]  # this source's own style
    rows += [(2000, prose(7, symbols=30), "en", "clean"), (2001, prose(8, long=60), "en", "small"), (2002, prose(9), "en", "small"), (None, prose(5), None, None), (2003, None, "en", "clean"), (2004, "", "xx", "y"), (2002, prose(9), "en", "small")]
    docs = docs_of(rows)
    got = Counter((r["doc_id"], r["kept"]) for r in quality.judge(docs).collect())
    assert sum(got.values()) == len(rows)
    assert all(got[k, True] for k in range(150)) and all(got[1000 + k, True] for k in range(150))
    assert got[2000, False] and got[2001, False] and got[2002, True] == 2 and got[None, True] and got[2003, False] and got[2004, False]
    kept = quality.passing(docs)
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter({i: n for (i, k), n in got.items() if k})
    assert quality.judge(docs.where("false")).count() == 0 and quality.passing(docs.where("false")).count() == 0
