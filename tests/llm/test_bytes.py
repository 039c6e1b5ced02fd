"""Operators on bytes and chunks: suffix arrays, content-defined chunks, token ids."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from millrace.llm import batches, bpe, chunks, queries, substrings, suffixes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def cut_by_hand(texts, length=200):
    texts = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                hit[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if hit[i] and (not i or not hit[i - 1]))
        out.append((len(t), sum(hit), spans, sha256(bytes(x for x, h in zip(t, hit, strict=True) if not h)).hexdigest()))
    return out


def test_hashes_follow_the_bytes_alone():
    data = np.frombuffer(b"abcabc" * 30000, dtype=np.uint8)
    starts = np.array([0, 3, 65535, 131071 - 131071 % 3])
    starts = starts - starts % 3
    assert len(set(batches.span_hashes(data, starts, starts + 5).tolist())) == 1
    assert len(set(batches.window_hashes(data, 7).tolist())) == 3


def test_cover_reaches_every_pair():
    for period in (8, 32, 64):
        inside, steps = suffixes.cover(period)
        i, j = np.meshgrid(np.arange(period), np.arange(period), indexing="ij")
        assert inside[(i + steps) % period].all() and inside[(j + steps) % period].all()


@pytest.mark.parametrize("block", [64, 1 << 17])
def test_blocks_come_in_order(monkeypatch, block):
    monkeypatch.setattr(suffixes, "BLOCK", block)
    random.seed(block)
    text = "".join(random.choice("ab") for _ in range(800)) * 3 + "b" * 700 + "ab" * 300
    data = np.concatenate([np.frombuffer(text.encode(), dtype=np.uint8), np.zeros(600, dtype=np.uint8)])
    order = np.concatenate(list(suffixes.sorted_blocks(data, np.arange(len(text)), len(text), 200)))
    assert sorted(order.tolist()) == list(range(len(text)))
    heads = [text[i : i + 200] for i in order]
    assert heads == sorted(heads)


@pytest.mark.parametrize("hot", [256, 1])
def test_repeated_passages_by_hand(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)  # 1: every bucket is split down to single starts
    random.seed(hot)
    base = "".join(random.choice("ab é\n") for _ in range(2500))
    texts = [None, "", "z" * 450, "w" * 200, "w" * 199]
    for i in range(40):
        k = random.randrange(2000)
        t = base[k : k + random.randrange(100, 700)]
        texts.append("x" * random.randrange(300) * (i % 3 == 0) + t[:150] + "#" * (i % 7 == 0) + t[150:] + str(i) * random.randrange(100) * (i % 5 == 0))
    texts.append(texts[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in suffixes.dedup(docs).collect()}
    assert [got[i] for i in range(len(texts))] == cut_by_hand(texts)


def long_letters(seed):
    return np.random.default_rng(seed).integers(97, 123, 66_000).astype(np.uint8)


@pytest.mark.parametrize("seed", [26, 0])  # at these the first core of a stretch stands before the edge of a block, and the last one of the stretch before behind it
def test_cores_over_the_edge_of_a_block(seed):
    data = long_letters(seed)
    s, e, p, _, _ = suffixes.anchors(data, np.array([0, len(data)]))
    core, _, at, first, last = suffixes._pieces(data, s, e, p, 8, 200)
    block = (at - last) // 8
    inner = at - 8 * block
    assert (np.diff(inner) < 0).any()
    one = [int(batches.mix(batches.sum_hashes(data, inner[i : i + 1], inner[i : i + 1] + 193, seed=3) + block[i : i + 1].astype(np.uint64)).view(np.int64)[0]) for i in np.flatnonzero(abs(inner - (1 << 16)) < 400)]
    assert core[abs(inner - (1 << 16)) < 400].tolist() == one


def test_odd_documents(spark, documents, no_documents):
    rows = documents.collect()
    expected = cut_by_hand([r.text for r in rows])
    got = sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.dedup(documents).collect())
    assert got == sorted(expected)
    kept = suffixes.without_repeats(documents)
    assert kept.columns == documents.columns
    for before, after in zip(sorted(rows, key=str), sorted(kept.collect(), key=str), strict=True):
        assert len(after.text or "") == (after.n_chars or 0) or after.n_chars == before.n_chars
    assert suffixes.dedup(no_documents).count() == suffixes.without_repeats(no_documents).count() == 0


def test_chunks_resist_insertions():
    random.seed(4)
    body = "".join(random.choice("abcdefgh ") for _ in range(6000))
    split = lambda t: {t[a:b] for a, b in zip(*(x.tolist() for x in substrings.bounds(*batches.utf8(pa.array([t])))), strict=True)}
    assert len(split(body) - split(body[:3000] + "!?" + body[3000:])) <= 4
    data, offsets = batches.utf8(pa.array([body, "", body[:40], "ab"]))
    starts, ends = substrings.bounds(data, offsets)
    assert (np.sort(ends[:-1]) == starts[1:]).all() and {0, 6000, 6040} <= set(starts.tolist())
    hand = [sum(int(chunks.GEAR[data[i - d]]) << d for d in range(32)) % 2**32 for i in range(100, 110)]
    assert chunks.gear(data)[100:110].tolist() == hand


def test_later_copies_of_chunks_go(spark, documents, no_documents):
    random.seed(9)
    word = lambda: "".join(random.choice("abcdefghij") for _ in range(6))
    passage = " ".join(word() for _ in range(60))
    texts = [" ".join(word() for _ in range(80)) + (" " + passage + " " if i in (3, 7, 8) else " ") + word() for i in range(12)]
    docs = spark.createDataFrame([*enumerate(texts), (20, texts[1]), (20, texts[1]), (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in substrings.dedup(docs).collect()}
    assert {i for i, r in got.items() if r.n_removed} == {7, 8, 20}
    assert all(got[i].n_removed >= 2 * substrings.LEAST and passage not in got[i].kept for i in (7, 8))
    assert got[20].n_removed >= len(texts[1]) - substrings.LEAST
    # the same by hand
    first, hand = set(), {}
    for i, t in sorted({(r.doc_id, r.text) for r in docs.where("text is not null").collect()}):
        data, offsets = batches.utf8(pa.array([t]))
        gone = 0
        for a, b in zip(*(x.tolist() for x in substrings.bounds(data, offsets)), strict=True):
            chunk = t.encode()[a:b]
            gone += (b - a) * (b - a >= substrings.LEAST and chunk in first)
            first.add(chunk)
        hand[i] = gone
    assert {i: r.n_removed for i, r in got.items() if i is not None} == hand
    assert substrings.dedup(documents).count() == documents.count() and substrings.dedup(no_documents).count() == 0


def anywhere(data, offsets):
    at = np.flatnonzero(data[1:] & 0xC0 != 0x80) + 1
    return at[~np.isin(at, offsets)]


@pytest.mark.parametrize(("bits", "points"), [(10, bpe.safe), (4, bpe.safe), (5, anywhere)])
def test_pieces_give_the_ids_of_the_whole(documents, bits, points):
    random.seed(bits)
    texts = [r.text for r in documents.collect()]
    texts += ["".join(random.choice([" ", "\n", "\t", "a", "'s", "é", "日", "\u00a0", "\u3000", "12", ".", "<|endoftext|>", "the "]) for _ in range(900)) for _ in range(20)]
    texts += ["".join(random.choice(" \nab'st1.é") for _ in range(3000)) for _ in range(5)]
    whole = Tokenizer.from_file(PATH)
    codec = bpe.Codec(PATH)
    for text, pieces in zip(texts, bpe.encode_rows(codec, pa.array(texts), bits, points), strict=True):
        ids = whole.encode(text or "", add_special_tokens=False).ids
        assert [i for p in pieces for i in p[0]] == ids
        assert "".join(p[2] for p in pieces) == whole.decode(ids, skip_special_tokens=False)


def test_other_vocabularies_are_not_ranked():
    assert bpe.Codec(public_tokenizers.path("word_bpe_49k.json")).ranks is None and bpe.Codec(PATH).ranks is not None


def test_ids_of_the_table(spark, documents, no_documents):
    whole = Tokenizer.from_file(PATH)
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sorted(tuple(r) for r in bpe.encoded(texts, PATH).collect())
    want = []
    for r in texts.collect():
        ids = whole.encode(r.text or "", add_special_tokens=False).ids
        want.append((r.doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(whole.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want)
    with_ids = bpe.with_ids(documents, PATH)
    assert with_ids.columns == [*documents.columns, "ids"]
    back = bpe.decoded(with_ids.drop("text"), PATH).collect()
    assert sorted(r.text for r in back) == sorted(r.text or "" for r in documents.collect())
    assert bpe.encoded(no_documents, PATH).count() == 0 and queries.byte_bpe() == PATH
