import random
import re

import numpy as np
import pytest
import xxhash

from eigenweave.llm import simhash
from eigenweave.llm.components import connected_components, forest
from eigenweave.llm.queries import op8_simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, linked):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            up[n] = up[up[n]]
            n = up[n]
        return n

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(rows):
    fp = {i: plain(t) for i, t in rows}
    ids = sorted(fp)
    f = np.array([fp[i] for i in ids], np.uint64)
    links = [(ids[k], ids[k + 1 + j]) for k in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(f[k] ^ f[k + 1 :]) <= 4)]
    return fp, roots(ids, links)


def test_query_equals_brute_force(spark, sf, texts):
    fp, root = brute(texts)
    got = op8_simhash(spark, sf).collect()
    assert len(got) == len(texts)
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{fp[i]:016x}", root[i]) for i in fp}


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c", "a b c d", "A\tb\x0bC d  e\nf", "é À b ß c", "x y z w v", "the " * 50])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_very_long_text():
    text = " ".join(f"w{k % 1999}" for k in range(70_000))
    assert simhash.fingerprint(text.encode()) == plain(text)


def test_components_of_planted_balls(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(12)]
    prints = {0}
    for b in base:
        at = b
        for _ in range(40):  # chains and stars around a base
            for bit in r.sample(range(64), r.randint(0, 4)):
                at ^= 1 << bit
            prints.add(at)
            at = r.choice((b, at))
    prints |= {r.getrandbits(64) for _ in range(300)}
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    rows = spark.createDataFrame([(x, 1 + k % 3) for k, x in enumerate(signed)], "fp long, n long")
    for distance in (0, 3, 4, 6):
        f = np.array(sorted(signed), np.int64).view(np.uint64)
        links = [(signed_a, signed_b) for k, signed_a in enumerate(sorted(signed)) for signed_b in np.array(sorted(signed))[k + 1 :][np.bitwise_count(f[k] ^ f[k + 1 :]) <= distance].tolist()]
        want = roots(signed, links)
        got = {r["fp"]: r["root"] for r in simhash.link_components(rows, distance).collect()}
        groups = lambda m: sorted(sorted(x for x in m if m[x] == v) for v in set(m.values()))
        assert groups(got) == groups(want)


def test_segments_leave_one_bit_to_the_nearest():
    for distance in range(10):
        cuts = simhash.segments(distance)
        assert sum(w for _, w in cuts) == 64 and distance // len(cuts) <= 1


def test_forest_and_rounds_agree_with_brute_force(spark):
    r = random.Random(7)
    for n, m in ((50, 30), (400, 500), (3000, 2600)):
        edges = [(r.randrange(n) * 7 - 50, r.randrange(n) * 7 - 50) for _ in range(m)]
        want = roots({x for e in edges for x in e}, edges)
        nodes = sorted(want)
        at = {x: k for k, x in enumerate(nodes)}
        i, j = (np.array([at[e[s]] for e in edges]) for s in (0, 1))
        assert [nodes[k] for k in forest(len(nodes), i, j)] == [want[x] for x in nodes]
    chain = np.random.RandomState(0).permutation(20_000)
    assert (forest(20_000, chain[:-1], chain[1:]) == 0).all()
    df = spark.createDataFrame(edges[:600], "src long, dst long")
    linked = {x for e in edges[:600] if e[0] != e[1] for x in e}
    want = roots(linked, [e for e in edges[:600] if e[0] != e[1]])
    for one_task in (0, 50, 10_000):
        got = {x["node"]: x["root"] for x in connected_components(df, one_task).collect()}
        assert set(got) == linked and len(set(got.values())) == len(set(want.values())) and all((got[a] == got[b]) for a, b in edges[:600] if a != b)


def test_hot_bucket_is_dealt_to_many_tasks(spark, monkeypatch):
    """1,500 fingerprints that share a segment, one bucket of three salts: members far apart keep their components, outsiders meet the main one."""
    monkeypatch.setattr(simhash, "SALT", 500)
    rng = np.random.RandomState(5)
    ball = {int(0x155555) | int(x) << 21 for x in rng.randint(0, 1 << 43, 1500)}  # equal low segments, the rest random
    centre = int(rng.randint(0, 1 << 62))
    near = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.randint(0, 64, (1500, 2))} | {centre}
    signed = [x - (1 << 64) if x >> 63 else x for x in ball | near]
    got = {r["fp"]: r["root"] for r in simhash.link_components(spark.createDataFrame([(x, 1) for x in signed], "fp long, n long")).collect()}
    f = np.array(sorted(signed), np.int64)
    u = f.view(np.uint64)
    links = [(int(f[k]), int(x)) for k in range(len(f)) for x in f[k + 1 :][np.bitwise_count(u[k] ^ u[k + 1 :]) <= 4]]
    want = roots(f.tolist(), links)
    groups = lambda m: sorted(sorted(x for x in m if m[x] == v) for v in set(m.values()))
    assert groups(got) == groups(want)


def test_components_of_a_path_and_a_star(spark):
    edges = [(k, k + 1) for k in range(0, 200)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert len(got) == 401 and len({got[k] for k in range(201)}) == 1 and len({got[k] for k in range(1000, 1200)}) == 1
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_nulls_repeats_and_one_kept(docs_of):
    long = " ".join(f"word{k}" for k in range(80))
    rows = [(3, long), (1, long + " more"), (2, None), (4, ""), (5, "alone in the world here"), (5, "alone in the world here"), (None, long), (None, "only nameless words stand here now"), (None, "only nameless words stand here now")]
    docs = docs_of(rows)
    fp, _ = brute([(k, t) for k, (_, t) in enumerate(rows)])
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    comp = {(r["doc_id"], r["fp"]): r["component"] for r in got}
    assert {c for (i, f), c in comp.items() if i in (2, 4)} == {2} and comp[5, next(f for i, f in comp if i == 5)] == 5
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    same = {c for (i, f), c in comp.items() if i in (1, 3)}
    assert ids == sorted([(False, c) for c in same | {2, 5}] + [(True, 0)])
    assert simhash.near_duplicates(docs.where("false")).count() == 0 and simhash.keep_one(docs.where("false")).count() == 0


def test_one_row_of_each_component_where_ids_repeat(docs_of):
    text = lambda seed: " ".join(f"w{x}" for x in np.random.RandomState(seed).randint(0, 10**6, 80))
    rows = [(1, text(1)), (1, text(2)), (2, text(2)), (0, text(3)), (4, text(3)), (4, text(4)), (0, text(3))]
    kept = sorted((r["doc_id"], r["text"]) for r in simhash.keep_one(docs_of(rows)).collect())
    assert kept == sorted({rows[0], rows[1], rows[3], rows[5]})
