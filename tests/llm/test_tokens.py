import random
import zlib

import numpy as np
import pytest

from eigenweave.llm import packing, token_files
from eigenweave.llm.common import scratch
from eigenweave.llm.packing import Limits, Packer
from eigenweave.llm.queries import op3_packing, op6_token_files
from eigenweave.llm.tokens import Encoder, pieces

ODDMENTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "é", "1", "23", ".", "!!", " \n", " ", "　", "'ll", "\r\n", "_", "字", "\x1c", "😀", "\x01", "\x02", "\x85", "﻿", "word", "Été,", "the", "\n\n", "µ", "×", "<|endoftext|>"]


@pytest.fixture(scope="module")
def plain(tokenizer):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer)  # the contract's call, nothing set
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("memo", [20, 100_000])
def test_encoder_equals_library(tokenizer, plain, texts, memo):
    r = random.Random(1)
    odd = ["".join(r.choice(ODDMENTS) for _ in range(r.randrange(60))) for _ in range(3000)]
    enc = Encoder(tokenizer, memo)
    for batch in (odd, [t for _, t in texts], ["", " ", "\n"], []):
        assert [x.tolist() for x in enc.encode(batch)] == [plain(t) for t in batch]


def test_strings_of_special_tokens(tokenizer, plain):
    from tokenizers import Tokenizer

    r = random.Random(2)
    odd = ["".join(r.choice([*ODDMENTS, "<|endoftext|>", "<|endoftext", "|>", "<"]) for _ in range(r.randrange(20))) for _ in range(2000)]
    assert [x.tolist() for x in Encoder(tokenizer).encode(odd)] == [plain(t) for t in odd]
    assert Encoder(tokenizer).encode(["<|endoftext|>"])[0].tolist() == [50256]
    t = Tokenizer.from_file(tokenizer)
    t.encode_special_tokens = True
    assert [x.tolist() for x in Encoder(tokenizer, text_specials=True).encode(odd)] == [t.encode(x, add_special_tokens=False).ids for x in odd]


def test_files_of_other_tokenizers(texts):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t, enc = Tokenizer.from_file(path), Encoder(path)
    some = [x for _, x in texts[:40]] + ["", "It's <|endoftext|> a Test  ok"]
    assert not enc.memoable and [x.tolist() for x in enc.encode(some)] == [t.encode(x, add_special_tokens=False).ids for x in some]


def test_long_texts(tokenizer, plain):
    text = "lorem ipsum dolor, " * 9000 + "x" * 50_000 + "\n\n" + "a  b " * 5000
    assert "".join(pieces(text, 1000)) == text
    assert Encoder(tokenizer).encode([text])[0].tolist() == plain(text)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_query(spark, sf, texts, plain):
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in op6_token_files(spark, sf).collect()}
    at = 0
    for i, t in sorted(texts):
        ids = [*plain(t), 2]
        assert got.pop(i) == (at, len(ids), crc(ids))
        at += len(ids)
    assert not got


def test_token_files_edges(spark, docs_of, tokenizer, plain):
    rows = [(9, "nine"), (None, "no id"), (3, None), (3, ""), (5, "x " * 40_000), (5, "same"), (5, "same")]
    out = scratch(spark, "files")
    manifest = token_files.write_token_files(docs_of(rows).repartition(3), out, tokenizer)
    got = sorted(token_files.read_token_files(spark, out).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [None, 3, 3, 5, 5, 5, 9] and manifest["docs"] == 7
    at = 0
    for r in got:
        assert r["start"] == at and len(r["ids"]) == 4 * r["n_tokens"]
        at += r["n_tokens"]
    assert at == manifest["tokens"] and np.frombuffer(got[0]["ids"], "<u4").tolist() == [*plain("no id"), 2]
    empty = scratch(spark, "files")
    assert token_files.write_token_files(docs_of(rows).where("false"), empty, tokenizer)["docs"] == 0
    assert token_files.read_token_files(spark, empty).count() == 0


def check_pieces(rows, want, tokens=2048, segments=256):
    """rows: (doc key, start, length, crc or ids, doc_tokens, sequence, offset); want: ids of each doc key."""
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r[0], []).append(r)
        by_seq.setdefault(r[5], []).append(r)
    assert set(by_doc) == set(want)
    for key, parts in by_doc.items():
        at = 0
        for p in sorted(parts, key=lambda p: p[1]):
            assert p[1] == at and p[2] > 0 and p[4] == len(want[key])
            assert p[3] == crc(want[key][at : at + p[2]])
            at += p[2]
        assert at == len(want[key])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for p in sorted(parts, key=lambda p: p[6]):
            assert p[6] == at
            at += p[2]
        assert at <= tokens and len(parts) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    return padding


def test_packing_query(spark, sf, texts, plain):
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    rows = [tuple(r[c] for c in cols) for r in op3_packing(spark, sf).collect()]
    assert check_pieces(rows, {i: [*plain(t), 1] for i, t in texts}) == 0


def test_packing_edges(docs_of, tokenizer):
    docs = docs_of([(1, None), (2, ""), (None, "word " * 5000), (4, "a b c")])
    out = packing.pack_documents(docs, tokenizer).collect()
    assert sum(r["length"] for r in out if r["doc_id"] in (1, 2)) == 2
    assert sum(r["length"] for r in out if r["doc_id"] is None) == 5001 or sum(r["length"] for r in out if r["doc_id"] is None) == next(r["doc_tokens"] for r in out if r["doc_id"] is None)
    assert packing.pack_documents(docs.where("false"), tokenizer).count() == 0


def batches_of(docs, size):
    import pyarrow as pa

    for k in range(0, len(docs), size):
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs[k : k + size]], pa.int64()), pa.array([t for _, t in docs[k : k + size]])], ["id", "text"])


def split_lengths(column):
    """A stand-in for the encoder: a text names its number of ids."""
    return [np.arange(int(t.as_py()), dtype=np.uint32) for t in column]


def test_long_documents_keep_their_tails_only():
    import tracemalloc

    docs = [(k, str(50_000 + k % 7)) for k in range(4000)]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    tracemalloc.start()
    total = 0
    for b in packing.pieces_of(batches_of(docs, 100), split_lengths, 1, Limits(), 0, names):
        total += sum(b.column(2).to_pylist())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert total == sum(int(t) + 1 for _, t in docs)
    assert peak < 120e6  # 100 documents at once are 20 MB; with whole documents waiting it was 762 MB


def test_tiny_documents_need_no_padding():
    r = random.Random(3)
    docs = [(k, str(r.randint(1, 6))) for k in range(20_000)]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    rows = []
    for b in packing.pieces_of(batches_of(docs, 4000), split_lengths, 1, Limits(), 0, names):
        rows += zip(*(c.to_pylist() for c in b.columns))
    want = {i: [*range(int(t)), 1] for i, t in docs}
    assert check_pieces([(i, s, n, zlib.crc32(ids), d, q, at) for i, s, n, d, q, at, ids in rows], want) == 0


def test_instruction_packing(spark, sf, plain):
    from eigenweave.llm.queries import instruction_packing

    rows = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    tokens, loss = {}, {}
    for r in rows:
        n = len(plain(r["text"])) + 1
        tokens[r["conv_id"]] = tokens.get(r["conv_id"], 0) + n
        loss[r["conv_id"]] = loss.get(r["conv_id"], 0) + n * (r["role"] == "assistant")
    got = instruction_packing(spark, sf).collect()
    assert {r["conv_id"]: (r["tokens"], r["loss_tokens"]) for r in got} == {i: (n, loss[i]) for i, n in tokens.items()} and len(got) == len(tokens)
    seqs = {}
    for r in got:
        if r["sequence_id"] is None:
            assert r["tokens"] > 4096 or r["loss_tokens"] > 2048
        else:
            seqs.setdefault(r["sequence_id"], []).append(r)
    for parts in seqs.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["tokens"]
        assert at <= 4096 and len(parts) <= 8 and sum(r["loss_tokens"] for r in parts) <= 2048
    edge = spark.createDataFrame([(None, "user", "a"), (None, None, "b"), (1, "assistant", None), (1, "user", "")], "conv_id long, role string, text string")
    own = {r["conv_id"]: (r["tokens"], r["loss"]) for r in packing.conversation_tokens(edge, packing_tokenizer()).collect()}
    assert own == {None: (4, 0), 1: (2, 1)} and packing.conversation_tokens(edge.where("false"), packing_tokenizer()).count() == 0


def packing_tokenizer():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def test_dot_product_packing_keeps_all_limits():
    r = random.Random(5)
    limits = Limits(100, 7, 40)
    p = Packer(limits, cut=False, pool=64)
    items = {}
    for k in range(1500):
        tokens = r.choice((0, r.randint(1, 100), r.randint(1, 20)))
        items[k] = (tokens, r.randint(0, min(tokens, 40)))
        p.add(k, *items[k])
    p.finish()
    assert sorted(k for _, _, k, _, _ in p.placed) == list(range(1500))
    seqs = {}
    for s, at, k, start, n in p.placed:
        assert start == 0 and n == items[k][0]
        seqs.setdefault(s, []).append((at, n, items[k][1]))
    for parts in seqs.values():
        parts.sort()
        assert sum(n for _, n, _ in parts) <= 100 and len(parts) <= 7 and sum(x for *_, x in parts) <= 40
        at = 0
        for place, n, _ in parts:
            assert place == at
            at += n
    need = [sum(t for t, _ in items.values()) / 100, 1500 / 7, sum(x for _, x in items.values()) / 40]
    assert len(seqs) <= 1.15 * max(need)  # close to the tightest limit


def test_cutting_under_a_loss_limit():
    p = Packer(Limits(64, 3, 48), cut=True, pool=8)
    for k in range(100):
        p.add(k, 1 + 37 * k % 150, 1 + 37 * k % 150)
    p.finish()
    seqs, docs = {}, {}
    for s, _, k, start, n in p.placed:
        seqs.setdefault(s, []).append(n)
        docs.setdefault(k, []).append((start, n))
    assert all(sum(x) <= 48 and len(x) <= 3 for x in seqs.values())
    for k, parts in docs.items():
        assert sum(n for _, n in parts) == 1 + 37 * k % 150


def test_examples_frame(spark):
    rows = [(f"e{k}" if k % 9 else None, 1 + k % 50, k % 10) for k in range(300)]
    got = packing.pack_examples(spark.createDataFrame(rows, "id string, t int, l int"), "id", "t", "l", Limits(64, 4, 20)).collect()
    assert len(got) == 300 and sum(r["length"] for r in got) == sum(t for _, t, _ in rows)
    apart = packing.pack_examples(spark.createDataFrame([("a", 99, 1), ("b", 9, 30), ("c", 9, 9)], "id string, t int, l int"), "id", "t", "l", Limits(64, 4, 20), over="apart").collect()
    assert {r["id"]: (r["sequence_id"] is None, r["length"]) for r in apart} == {"a": (True, 99), "b": (True, 9), "c": (False, 9)}
    with pytest.raises(Exception, match="fits no sequence"):
        packing.pack_examples(spark.createDataFrame([("a", 99, 1)], "id string, t int, l int"), "id", "t", "l", Limits(64, 4, 20)).collect()
    for bad in ((0, 1, 1), (1, 0, 1)):
        with pytest.raises(ValueError):
            Limits(*bad)
