import hashlib
import re

import numpy as np
import pytest

from eigenweave.llm import embed_dedup, pii, queries, substring_dedup
from helpers import agrees

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def test_substring_query_equals_sql(spark, sf):
    assert agrees(queries.op1_substring_dedup(spark, sf), queries.OP1_SQL, sf)


@pytest.mark.parametrize("unit,want", [("line", ["a. b\n", "\n", " c"]), ("paragraph", ["a. b\n\n c"]), ("sentence", ["a. ", "b\n", "\n", " c"])])
def test_units_cover_the_text(unit, want):
    text = "a. b\n\n c"
    ends = re.compile(substring_dedup.ENDS[unit])
    got = [text[s:e] for s, e in substring_dedup.cut(text, ends)]
    assert "".join(got) == text
    assert got == (["a. b\n\n ", "c"] if unit == "paragraph" else want)


def brute_repeats(rows, passages=20):
    """(doc_id, unit, start, end, first_doc_id, first_start) by definition, for rows with ids that don't repeat."""
    found = []
    for i, text in sorted(rows):
        at, idx = 0, 0
        for ln, line in enumerate((text or "").split("\n")):
            line += "\n" if at + len(line) < len(text or "") else ""
            parts, k = [], 0
            for piece in re.findall(r".*?(?:[.!?]+[ \t]+|\n|$)", line, re.S):
                if piece.split():
                    parts.append((at + k, at + k + len(piece), " ".join(piece.lower().split())))
                k += len(piece)
            if len(parts) == 1:
                found.append((i, ln, idx, True, at, at + len(line), parts[0][2]))
            elif parts:
                found += [(i, ln, idx + j, False, *p) for j, p in enumerate(parts)]
                found.append((i, ln, None, True, at, at + len(line), " ".join(p[2] for p in parts)))
            idx += len(parts)
            at += len(line)
    first, later = {}, []
    for u in found:
        if u[6] in first:
            later.append((*u, *first[u[6]]))
        else:
            first[u[6]] = (u[0], u[4])
    gone = {(u[0], u[1]) for u in later if u[2] is None}
    runs, at = {}, {}
    for u in later:
        if u[2] is not None:
            at[u[0]] = at.get(u[0], -1) + 1
            runs.setdefault((u[0], u[2] - at[u[0]]), []).append(u)
    out = [(u[0], "line", u[4], u[5], u[7], u[8]) for u in later if u[3]]
    for run in runs.values():
        if sum(len(u[6].split()) for u in run) >= passages:
            out += [(u[0], "sentence", u[4], u[5], u[7], u[8]) for u in run if not u[3] and (u[0], u[1]) not in gone]
    return sorted(out)


def test_substring_query_equals_brute_force(spark, sf, texts):
    got = sorted((r["doc_id"], r["unit"], r["start"], r["end"], r["first_doc_id"], r["first_start"]) for r in queries.op1_substring_dedup(spark, sf).collect())
    assert got == brute_repeats(texts) and {r[1] for r in got} == {"line", "sentence"}


def test_every_repeated_line_goes(docs_of):
    docs = docs_of([(1, "Six words in this short line.\nOwn one."), (2, "Own two.\n  six WORDS in this  short line. \nEnd"), (3, "Six words in this short line. And more on the line."), (4, "End")])
    got = sorted((r["doc_id"], r["start"], r["end"], r["first_id"], r["first_start"]) for r in substring_dedup.repeats(docs).collect())
    assert got == [(2, 9, 43, 1, 0), (4, 0, 3, 2, 43)]
    assert substring_dedup.repeats(docs, min_words=6).count() == 1
    assert sorted(r["doc_id"] for r in substring_dedup.repeats(docs, "sentence").collect()) == [2, 3, 4]
    assert {r["doc_id"] for r in substring_dedup.repeats(docs, passages=20).collect()} == {2, 4}


def test_passages_inside_lines(docs_of):
    passage = "The quick brown fox runs. It jumps over one lazy dog today! Then it rests under an old oak tree for hours."
    rows = [(1, f"Start of one. {passage} End of one."), (2, f"Start of two. {passage} End of two."), (3, f"{passage}"), (4, "Start of four. It jumps over one lazy dog today! End of four."), (5, f"Start of one. {passage} End of one.\nMore.")]
    got = [(r["doc_id"], r["unit"], r["start"], r["end"]) for r in substring_dedup.repeats(docs_of(rows), passages=20).collect()]
    text = dict(rows)
    assert sorted({(i, u) for i, u, *_ in got}) == [(2, "sentence"), (3, "sentence"), (5, "line")]
    assert [text[5][s:e] for i, _, s, e in got if i == 5] == [f"Start of one. {passage} End of one.\n"]  # the line once, not its sentences too
    assert "".join(text[2][s:e] for _, s, e in sorted((i, s, e) for i, _, s, e in got if i == 2)) == passage + " "
    cut = {r["doc_id"]: r["text"] for r in substring_dedup.without_repeats(docs_of(rows), passages=20).collect()}
    assert cut == {1: text[1], 2: "Start of two. End of two.", 3: "", 4: text[4], 5: "More."}
    assert sorted((r["doc_id"], r["unit"], r["start"], r["end"], r["first_id"], r["first_start"]) for r in substring_dedup.repeats(docs_of(rows), passages=20).collect()) == brute_repeats(rows)


def test_repeats_edges(docs_of, spark):
    rows = [(5, "A line.\nOwn end."), (None, "A line."), (7, None), (8, ""), (9, " \n\t"), (3, "Own end."), (3, "Own end."), (2, "x " * 60_000 + "\nA line.")]
    docs = docs_of(rows)
    got = sorted(((r["doc_id"], r["start"], r["first_id"]) for r in substring_dedup.repeats(docs).collect()), key=str)
    assert got == [(5, 0, 2), (5, 8, 3), (None, 0, 2)]  # equal rows stay together
    out = substring_dedup.without_repeats(docs)
    assert out.columns == [*docs.columns, "removed"] and out.count() == len(rows)
    cut = {r["doc_id"]: r["text"] for r in out.collect()}
    assert cut[5] == "" and cut[None] == "" and cut[7] is None and cut[8] == "" and cut[9] == " \n\t" and cut[3] == "Own end." and len(cut[2]) == 120_008
    assert substring_dedup.repeats(docs.where("false")).count() == 0 and substring_dedup.without_repeats(docs.where("false")).count() == 0
    odd = spark.createDataFrame([(1, "a b\nc", "x", 5, 6, 7), (2, "a b", "y", 5, 6, 7)], "doc_id long, text string, __hash string, __id int, id int, h int")
    assert sorted((r["doc_id"], r["text"], r["__hash"], r["__id"], r["id"], r["h"]) for r in substring_dedup.without_repeats(odd).collect()) == [(1, "a b\nc", "x", 5, 6, 7), (2, "", "y", 5, 6, 7)]
    with pytest.raises(ValueError):
        substring_dedup.repeats(docs, "word")
    with pytest.raises(ValueError):
        substring_dedup.without_repeats(odd.withColumn("removed", odd.h))


def test_blank_lines_do_not_break_runs(docs_of):
    lines = [f"Line {k} has exactly six words." for k in range(6)]
    docs = docs_of([(1, "\n\n".join(lines)), (2, "Two.\n\n" + "\n\n \n".join(lines))])
    for unit in ("line", "paragraph"):
        assert sorted((r["doc_id"], r["words"]) for r in substring_dedup.repeats(docs, unit).collect()) == [(2, 6)] * 6
    docs = docs_of([(1, " ".join(lines)), (2, f"New here. {lines[0]}\n \n\n{lines[1]} New there. {lines[2]}")])
    got = substring_dedup.repeats(docs, "line", passages=12).collect()
    assert sorted((r["doc_id"], r["unit"], r["words"]) for r in got) == [(2, "sentence", 6)] * 2


def test_free_terms():
    import random

    r = random.Random(4)
    for _ in range(300):
        text = "".join(r.choice("ab1 .") for _ in range(40))
        spans = [("x", a, a + r.randint(1, 9)) for a in (r.randrange(40) for _ in range(r.randint(0, 5)))]
        assert pii.free_terms(text, spans) == [t for t in pii.terms(text) if not any(s < t[2] and t[1] < e for _, s, e in spans)]


def luhn(d):
    odd, even = d[::-1][::2], d[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(c), 10)) for c in even)) % 10 == 0


def plain(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p[-9:]) <= 255 and not p[:-9].strip("0") for p in m.group().split("."))]
    for m in CARD.finditer(text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15]


TRICKY = ["a@b.c", "a@b", "@b.c x@y.z@w.v", "a.@b-.c..d", "é@x.yz é.a@x.yz", "x@a.b.c.@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 1.256.1.1 001.02.3.4", "1.2.3", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "4111  1111", "+1 (212) 555-0100.", "+12", "+1" + "2" * 20, "++1 234 567 89", "+1-+2 345 678 90 12", "9" * 19, "0" * 16 + " 7", "1" * 30, "a@b.c" * 3, "%+-._@-.-"]


@pytest.mark.parametrize("text", TRICKY)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "+" + "(" * 200_000, "1." * 100_000, "." * 200_000 + "@x"):
        pii.base_spans(text)
    assert [s[0] for s in pii.base_spans("0" * 5000 + "1.2.3.4")] == ["ip"]


def test_pii_query_equals_brute_force(spark, sf, texts):
    got = {r["doc_id"]: r for r in queries.op9_pii(spark, sf).collect()}
    assert len(got) == len(texts)
    for i, t in texts:
        spans, r = plain(t), got[i]
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in spans) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and r["spans"].startswith(base)
        assert all(x.startswith("term:") for x in r["spans"][len(base) :].strip(",").split(",") if x)


def disclosure_docs():
    rng = np.random.RandomState(1)
    filler = lambda n: " ".join(f"w{x}" for x in rng.randint(0, 400, n))
    rows = [(k, f"{filler(25)} Zorblat, {filler(3)} zora@example.org the {filler(25)}") for k in range(6)]
    rows += [(100 + k, f"{filler(40)} the {filler(10)} c{k}@example.org {filler(10)}") for k in range(30)]
    rows += [(200 + k, f"{filler(60)} the") for k in range(300)]
    one = f"{filler(20)} Hapaxia lone{7}@example.org {filler(20)}"
    rows += [(600 + k, one) for k in range(8)] + [(700, "ZORBLAT and zora@example.org; Zorblat's"), (701, "Zorblat alone"), (None, None), (None, "")]
    return rows


def test_disclosing_terms(docs_of):
    rows = disclosure_docs()
    got = {r["doc_id"]: r for r in pii.find_personal(docs_of(rows)).collect()}
    named = lambda i: sorted(text[int(s) : int(e)].lower() for x in got[i]["spans"].split(",") if x.startswith("term") for _, s, e in [x.split(":")] for text in [dict(rows)[i]])
    for k in range(6):
        assert named(k) == ["zorblat"]
    assert named(700) == ["zorblat", "zorblat"]
    assert named(701) == [] and named(600) == [] and all(named(200 + k) == [] for k in range(300))
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(docs_of(rows)).collect() if r["doc_id"] is not None}
    assert clean[700] == "[TERM] and [EMAIL]; [TERM]'s" and clean[701] == "Zorblat alone" and "Hapaxia [EMAIL]" in clean[600]


def test_windows_that_share_a_frequent_word_are_not_copies(docs_of):
    rng = np.random.RandomState(2)
    words = [f"w{x}" for x in range(400)]
    low = min(words, key=lambda w: pii.xxhash.xxh64_intdigest(w.encode(), 1))
    filler = lambda n: " ".join([*rng.choice(words, n), low])
    rows = [(k, f"{filler(18)} Zorblat zora@example.org {filler(18)}") for k in range(6)]
    quote = filler(18).split()
    rows += [(100 + k, " ".join([*quote[:k], f"x{k}", *quote[k + 1 :], "Hapaxia hana@example.org", *quote])) for k in range(12)]
    rows += [(200 + k, filler(40)) for k in range(300)]
    got = {r["doc_id"]: r["spans"] for r in pii.find_personal(docs_of(rows)).collect()}
    assert all(got[k].count("term:") == 1 for k in range(6)) and not any("term:" in got[100 + k] for k in range(12))


def test_disclosing_terms_in_whole_documents_and_without_the_entity(spark, tmp_path):
    import corpus_pipeline

    rng = np.random.RandomState(3)
    filler = lambda n: " ".join(f"w{x}" for x in rng.randint(0, 400, n))
    rows = [(k, f"Zorblat {filler(60)} zora@example.org {filler(25)}") for k in range(6)]
    rows += [(10, "Only ZORBLAT here"), (11, "nothing here")] + [(200 + k, filler(60)) for k in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spans = {r["doc_id"]: r["spans"] for r in queries.op9_pii(spark, str(tmp_path)).collect()}
    assert all(spans[k].endswith(",term:0:7") for k in range(6)) and spans[10] == "term:5:12"
    assert all(not spans[i] for i, _ in rows[7:])
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, docs, str(tmp_path)).collect()}
    assert clean[10] == "Only [TERM] here" and clean[11] == "nothing here" and all(clean[k].startswith("[TERM] w") for k in range(6))


def brute_terms(rows, support=3, threshold=0.9, width=20):
    """The disclosing terms by definition: documents counted one by one."""
    from collections import defaultdict
    from math import log

    has, windows, docs_of_term = defaultdict(set), defaultdict(dict), defaultdict(set)
    for k, (_, text) in enumerate(rows):
        spans = plain(text or "")
        free = [(m[0].lower(), *m.span()) for m in re.finditer(r"[^\W_]+", text or "") if len(m[0]) > 1]
        for t in {t for t, *_ in free}:
            docs_of_term[t].add(k)
        free = [t for t in free if not any(s < t[2] and t[1] < e for _, s, e in spans)]
        near = defaultdict(set)
        for kind, s, e in spans:
            before = sum(t[1] < s for t in free)
            for key in pii.entities(kind, text[s:e]):
                has[key].add(k)
                near[key] |= {t[0] for t in free[max(0, before - width) : before + width]}
        for key, words in near.items():
            if words:
                windows[key][k] = (pii.signature(sorted(words)), {t[0] for t in free})
    found = set()
    for key, by_doc in windows.items():
        distinct = {sig: bands for (sig, bands), _ in by_doc.values()}
        if len(distinct) < support:
            continue
        least = {}
        for sig, bands in distinct.items():
            for at, b in enumerate(bands):
                least[at, b] = min(sig, least.get((at, b), sig))
        lead = {sig for sig, bands in distinct.items() if all(least[at, b] == sig for at, b in enumerate(bands))}
        if len(lead) < support or len(has[key]) == len(rows):
            continue
        p = len(has[key]) / len(rows)
        for t in set.union(*(w for _, w in by_doc.values())):
            with_t = {k for k, (_, w) in by_doc.items() if t in w}
            if len(lead & {by_doc[k][0][0] for k in with_t}) < support:
                continue
            n = max(len(with_t), len(docs_of_term[t]))
            q = len(with_t) / n
            if q > p and log(q / p) / -log(p) >= threshold and n * (q * log(q / p) + ((1 - q) * log((1 - q) / (1 - p)) if q < 1 else 0)) >= pii.SURPRISE:
                found.add(t)
    return found


def wanted(rows):
    names = brute_terms(rows)
    out = {}
    for i, text in rows:
        base = plain(text or "")
        more = [("term", *m.span()) for m in re.finditer(r"[^\W_]+", text or "") if m[0].lower() in names and not any(s < m.end() and m.start() < e for _, s, e in base)]
        out.setdefault(i, []).append(",".join(f"{k}:{a}:{b}" for k, a, b in base + more))
    return names, out


def test_spans_in_full_equal_brute_force(spark, texts, tmp_path):
    """Everything the query returns, on a corpus with planted terms at the level of a value, of a domain and of a kind."""
    rng = np.random.RandomState(8)
    filler = lambda n: " ".join(f"w{x}" for x in rng.randint(0, 300, n))
    rows = [(k, f"{filler(30)} Zorblat {filler(4)} zora@a{k}x.example.org {filler(20)}") for k in range(5)]
    rows += [(k, f"{filler(30)} Acmeco {filler(9)} staff{k}@acme.example.com {filler(20)}") for k in range(10, 22)]
    rows += [(k, f"{filler(30)} hotline {filler(9)} +1 (2{k}) 555-01{k} {filler(20)} and zora@zora.example.org") for k in range(30, 42)]
    rows += [(k, f"{filler(30)} one off{k}@x{k}.example.net {filler(20)} 10.{k}.0.1") for k in range(50, 60)]
    rows += [(100 + k, f"{filler(40)}\nİstanbul") for k in range(200)] + [(400, "ACMECO hotline Zorblat"), (401, None), (402, "")]
    rows += [(1000 + i, t) for i, t in texts[:60]]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    names, want = wanted(rows)
    assert {"acmeco", "hotline"} <= names and not any(w.startswith("w") for w in names)
    got = {}
    for r in queries.op9_pii(spark, str(tmp_path)).collect():
        got.setdefault(r["doc_id"], []).append(r["spans"])
    assert got == want and got[400] == ["term:0:6,term:7:14"]


def test_levels_of_entities():
    value, domain, kind = pii.entities("email", "A.b@Mail.Example.com")
    assert pii.entities("email", "c@mail.example.COM")[1:] == [domain, kind] and pii.entities("email", "a.B@mail.example.com")[0] == value
    assert pii.entities("ip", "1.2.3.4")[1] == pii.entities("ip", "1.2.9.9")[1] != pii.entities("ip", "1.3.3.4")[1]
    assert pii.entities("card", "4111 1111 1111 1111") == pii.entities("card", "4111-1111-11111111") and pii.entities("phone", "+49 (30) 123 456")[1] == pii.entities("phone", "+49-999 888 77")[1]
    assert pii.lowered("İstanbul ÀB") == "istanbul àb"


def test_pii_edges(docs_of):
    docs = docs_of([(None, "a@b.cd"), (1, None), (2, ""), (1, "a@b.cd"), (1, "a@b.cd")])
    assert sorted(r["n_email"] for r in pii.find_personal(docs).collect()) == [0, 0, 1, 1, 1]
    out = pii.sanitised(docs)
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["", "None", "[EMAIL]", "[EMAIL]", "[EMAIL]"]
    assert pii.find_personal(docs.where("false")).count() == 0 and pii.sanitised(docs.where("false")).count() == 0
    assert pii.replaced("abcdef", [("email", 1, 4), ("card", 2, 5)]) == "a[EMAIL]f"


def links(rows, threshold):
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    n = len(rows)
    near = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = rows[a], rows[b]
            if a != b and x[2] is not None and x[2] == y[2] and ok(x[1]) and ok(y[1]) and len(x[1]) == len(y[1]):
                u, v = np.array(x[1], float), np.array(y[1], float)
                near[a, b] = u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= threshold
    reach = near | np.eye(n, dtype=bool)
    for _ in range(12):
        reach = reach @ reach
    out = []
    for a in range(n):
        ids = [rows[b][0] for b in range(n) if reach[a, b] and rows[b][0] is not None]
        c = min(ids) if ids else None
        out.append((rows[a][0], int(near[a].sum()), c, rows[a][0] == c))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [16, 2048])
def test_embeddings_equal_brute_force(spark, block):
    rng = np.random.RandomState(block)
    base = rng.randn(12, 10)
    rows = []
    for k in range(220):
        v = (base[k % 12] + rng.randn(10) * rng.choice([0, 0.1, 0.3, 1])).astype(np.float32)
        rows.append((k, v.tolist(), int(k % 3)))
    rows += [(300, rows[0][1], 0), (301, [2 * x for x in rows[0][1]], 0), (302, rows[0][1], 1), (303, rows[0][1], None), (300, rows[0][1], 0)]
    rows += [(310, None, 1), (311, [0.0] * 10, 1), (312, [float("nan")] * 10, 1), (313, [float("inf")] + [0.0] * 9, 1), (314, [None] + [1.0] * 9, 1), (315, [], 1), (316, [-0.0] * 10, 1), (317, [1.0, 0.0], 1), (318, [1.0, 0.01], 1), (None, rows[5][1], 2)]
    df = spark.createDataFrame([(*r, "x", 1.0) for r in rows], "vec_id long, embedding array<float>, label int, rep string, n double")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df, 0.93, block=block).collect()), key=str)
    assert got == links(rows, 0.93)


def test_embeddings_query(spark, sf):
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    x = np.array([r[1] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in queries.op10_embedding_dedup(spark, sf).collect()}
    assert got == {r[0]: int(c) for r, c in zip(rows, near.sum(1))}


def test_embeddings_without_any_valid(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [0.0], None)], "vec_id long, embedding array<float>, label int")
    assert sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embed_dedup.near_duplicates(df).collect()) == [(1, 0, 1, True), (2, 0, 2, True)]
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("same", [True, False])
def test_tiles_equal_brute_force(same, monkeypatch):
    monkeypatch.setattr(embed_dedup, "INNER", 37)
    rng = np.random.RandomState(6)
    centres = rng.randn(9, 24) * np.linspace(2, 0.2, 24)
    a = centres[rng.randint(0, 9, 250)] + rng.randn(250, 24) * rng.choice([0.02, 0.3], (250, 1))
    b = a if same else centres[rng.randint(0, 9, 180)] + rng.randn(180, 24) * 0.1
    wa, wb = rng.randint(1, 5, len(a)), rng.randint(1, 5, len(b))
    wb = wa if same else wb
    links, i, j = embed_dedup.tile_links(a, b, wa, wb, embed_dedup.basis(a), 0.93, same)
    u, v = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    near = u @ v.T >= 0.93
    if same:
        np.fill_diagonal(near, False)
        assert np.allclose(links, near @ wa)
        full = near
    else:
        assert np.allclose(links, np.concatenate((near @ wb, near.T @ wa)))
        full = np.block([[np.zeros((250, 250), bool), near], [near.T, np.zeros((180, 180), bool)]])
    x, y = np.nonzero(full)
    assert (embed_dedup.forest(len(full), x, y) == embed_dedup.forest(len(full), i, j)).all()
    assert len(i) < near.sum()  # a forest, not the pairs


def test_pairs_stop_only_where_they_may():
    rng = np.random.RandomState(0)
    a = rng.randn(300, 64) * np.linspace(3, 0.1, 64)
    a[150:] = a[:150] + rng.randn(150, 64) * 0.05
    axes = embed_dedup.basis(a)
    i, j = embed_dedup.linked_pairs(a, a, axes, 0.9, True)
    u = a / np.linalg.norm(a, axis=1, keepdims=True)
    want = np.argwhere(np.triu(u @ u.T >= 0.9, 1))
    assert sorted(zip(i.tolist(), j.tolist())) == sorted(map(tuple, want.tolist()))
    assert embed_dedup.forest(5, np.array([3, 1]), np.array([4, 3])).tolist() == [0, 1, 2, 1, 1]
