import numpy as np

import corpus_pipeline
from eigenweave.llm import pii, queries
from eigenweave.llm.common import written
from helpers import duck
from test_mixing_quality import check as check_mix
from test_mixing_quality import stats
from test_simhash import brute


def test_stages_against_brute_force(spark, sf, texts, tokenizer):
    """Each stage on its own input, up to the last."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_rules", "near_dedup", "personal_data", "source_mixing", "sequence_packing"]

    kept = written(steps["quality_rules"](spark, docs, sf), "t1")
    names, rows = duck(queries.OP5_SQL, sf)  # written apart from the operator
    ids = {r["doc_id"] for r in kept.collect()}
    assert kept.columns == columns and ids == {r[names.index("doc_id")] for r in rows if r[names.index("kept")]}
    assert all(stats(t)[0] >= 50 for i, t in texts if i in ids)

    single = written(steps["near_dedup"](spark, kept, sf), "t2")
    _, root = brute([(i, t) for i, t in texts if i in ids])
    assert single.columns == columns and sorted(r["doc_id"] for r in single.collect()) == sorted(set(root.values()))

    clean = written(steps["personal_data"](spark, single, sf), "t3")
    assert clean.columns == columns and clean.count() == single.count()
    for r in clean.collect():
        assert not pii.base_spans(r["text"]) and r["n_chars"] == len(r["text"])

    mixed = written(steps["source_mixing"](spark, clean, sf), "t4")
    assert mixed.columns == columns
    times = {}
    for r in mixed.collect():
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    rows = clean.collect()
    sizes, total = {}, {}
    for r in rows:
        sizes[r["doc_id"]] = stats(r["text"])[0]
        total[r["source"]] = total.get(r["source"], 0) + sizes[r["doc_id"]]
    from test_mixing_quality import water

    goal = water(total)
    check_mix([(r["doc_id"], r["source"], sizes[r["doc_id"]], total[r["source"]], goal[r["source"]], times.get(r["doc_id"], 0) * sizes[r["doc_id"]]) for r in rows], {r["doc_id"]: r["text"] for r in rows})

    t = Tokenizer.from_file(tokenizer)
    text = {r["doc_id"]: r["text"] for r in rows}
    packed = steps["sequence_packing"](spark, mixed, sf).collect()
    want = {i: [*t.encode(text[i], add_special_tokens=False).ids, 1] for i in times}
    check_copies(packed, want, times)


def check_copies(packed, want, times):
    """Every document's ids lie in pieces exactly as often as it was taken; sequences are gapless, within limits and full."""
    cover = {i: np.zeros(len(ids) + 1, int) for i, ids in want.items()}
    seqs = {}
    for r in packed:
        assert r["length"] > 0 and r["doc_tokens"] == len(want[r["doc_id"]])
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        cover[r["doc_id"]][r["start"]] += 1
        cover[r["doc_id"]][r["start"] + r["length"]] -= 1
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, c in cover.items():
        assert (np.cumsum(c)[:-1] == times[i]).all()
    for parts in seqs.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048 and len(parts) <= 256 and (at == 2048 or at & (at - 1) == 0)


ODD = "doc_id long, text string, lang string, source string, n_chars long, row string, fp double, terms string, h int, id string, size string, word string"


def odd_docs(spark):
    """Nulls in every column, empty and long texts, copies, repeated ids, and columns that operators use inside."""
    r = np.random.RandomState(4)
    prose = lambda n, k=0: " ".join(f"word{x}" for x in r.randint(0, 5000, n)) + f" end{k}."
    rows = [(k, prose(60 + k, k), ["en", "de", None][k % 3], ["a", "b", None, "c"][k % 4]) for k in range(30)]
    rows += [(40, rows[3][1], "en", "a"), (3, rows[3][1], "en", "b"), (41, None, None, None), (42, "", "en", "a"), (None, prose(70), "en", "a"), (None, None, None, None), (43, prose(30_000), "de", "b"), (44, prose(60) + " mail me@x.example.org or +1 (212) 555-0100", "en", "c")]
    return spark.createDataFrame([(i, t, lang, s, len(t) if t else None, "r", 1.5, "t", 3, "i", "s", "w") for i, t, lang, s in rows], ODD)


def test_stages_on_odd_rows(spark, sf):
    docs = odd_docs(spark)
    every = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = written(stage(spark, docs, sf), "odd")
        if name != "sequence_packing":
            assert out.columns == docs.columns and {r["row"] for r in out.collect()} == {"r"} and {r["word"] for r in out.collect()} == {"w"}
        if name == "personal_data":
            got = out.collect()
            assert len(got) == every and sum(r["text"] is None for r in got) == 2 and "[EMAIL] or [PHONE]" in next(r["text"] for r in got if r["doc_id"] == 44)
        if name == "near_dedup":  # 40 and one row of id 3 are copies of the other; null and empty texts are one
            ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
            assert ids == sorted([(False, k) for k in [*range(30), 41, 43, 44]] + [(True, 0)])
        if name == "quality_rules":
            assert all(r["text"] and len(r["text"].split()) >= 50 for r in out.collect()) and out.count() >= 28
        if name == "sequence_packing":
            got = out.collect()
            assert sum(r["length"] for r in got if r["start"] == 0 and r["doc_id"] in (41, 42)) == 2
            assert len([r for r in got if r["start"] == 0]) == every


def test_stages_on_an_empty_table(spark, sf):
    docs = odd_docs(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0


def test_run_equals_stages(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "ids", "sequence_id"} <= set(out.columns)
