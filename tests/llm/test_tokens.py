import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from jsonloom.llm import packing, token_counts
from jsonloom.llm.queries import QUERIES

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   a", "a  b", "a\n\n b ", "x \r\n y", "▁a ▁▁b", "日本語 テスト 𠮷", "<s> </s> <unk> <|endoftext|>x", "a" * 60, "\t\tif (x):\r\n\t return", "1234 12.5e7", "\x00a", " " * 37 + "x", "a" + " " * 21, "It's we'll don't!", "ÀÉÎ ÿß Straße. É", "İstanbul ΣΑΣ", "12ab ½ ²", "ﬁ é", "\x85a\xa0b", None]


def noisy():
    rng = random.Random(5)
    return ODD + ["".join(rng.choice(" \n\rabceBthÉé▁.,'(){}%<|>;109日") for _ in range(rng.randrange(30))) for _ in range(400)]


def test_counts_equal_the_library():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = noisy()
    assert token_counts.counts(texts, PIECES).tolist() == [len(sp.encode(t)) if t else 0 for t in texts]


def test_ids_equal_the_library():
    tok = Tokenizer.from_file(WORDS)
    for text, got in zip(noisy(), packing.encode(noisy(), WORDS, 2)):
        ids = tok.encode(text, add_special_tokens=False).ids if text else []
        assert got == np.array([*ids, 2], "<u4").tobytes(), text


def test_count_query(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op9_rank_synchronous_token_counts"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def test_counts_of_odd_rows(spark, odd, none):
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rows = token_counts.count_tokens(odd).collect()
    assert sorted((r.n_bytes, r.n_tokens) for r in rows) == sorted((len((r.text or "").encode()), len(sp.encode(r.text or ""))) for r in odd.collect())
    assert token_counts.count_tokens(none).collect() == []


@pytest.mark.parametrize(("n", "lengths"), [(1, [1]), (7, [4, 2, 1]), (16, [16]), (35, [16, 16, 2, 1])])
def test_piece_lengths(n, lengths):
    assert packing.piece_lengths(n, 16) == lengths


def check_packing(rows, texts, limit):
    tok = Tokenizer.from_file(WORDS)
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert all(r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= limit for r in rows)
    spans = {}
    for r in rows:
        spans.setdefault(r.doc_id, []).append(r)
    for doc, text in texts.items():
        ids = [*(tok.encode(text, add_special_tokens=False).ids if text else []), 2]
        at = 0
        for r in sorted(spans[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids)


def test_packing_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check_packing(QUERIES["op10_power_of_two_packing"](spark, SF).collect(), texts, 4096)


def test_packing_odd_rows(spark, odd, none):
    rows = packing.pack(odd, limit=64).collect()
    assert sorted(r.sequence_id for r in rows) == list(range(len(rows)))
    assert sum(r.length for r in rows) == sum(len(x) // 4 for x in packing.encode([r.text for r in odd.collect()], WORDS, 2))
    buckets = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert buckets == sorted(buckets, reverse=True)
    assert packing.pack(none).collect() == []


def test_very_long_words_equal_the_library():
    """A million letters without a break, within seconds: time grows with the length."""
    import random
    import time

    import public_tokenizers
    import sentencepiece
    from tokenizers import Tokenizer

    from jsonloom.llm import token_counts

    rng = random.Random(6)
    prose = "".join(rng.choice(["the", "un", "ing", "house", "water", "is", "a", "qu", "er", "s"]) for _ in range(330_000))[:1_000_000]
    words = [prose, "ab" * 40_000 + "a", "a" * 70_001, "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(200_000)), "".join(rng.choice("的一是不了人我在有他这") for _ in range(50_000)), "x" * 97, "hello" * 20]
    piece, word = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    library = sentencepiece.SentencePieceProcessor(model_file=piece)
    began = time.process_time()
    got = [int(token_counts.counts([w], piece)[0]) for w in words]
    mine = time.process_time() - began
    assert got == [len(library.encode(w)) for w in words]
    tokenizer = Tokenizer.from_file(word)
    plain = [w.lower() for w in words]
    began = time.process_time()
    ids = packing.encode(plain, word, 2)
    mine += time.process_time() - began
    assert mine < 60, mine
    for x, w in zip(ids, plain, strict=True):
        assert np.frombuffer(x, "<u4")[:-1].tolist() == tokenizer.encode(w, add_special_tokens=False).ids


def test_merging_in_three_ways_is_one():
    """Merges at random, also ones whose products meet in pairs of lower rank."""
    from jsonloom.llm import merging

    rng = np.random.default_rng(3)
    for seed in range(60):
        n = int(rng.integers(3, 7))
        ranks = {(int(a), int(b)): r for r, (a, b) in enumerate(dict.fromkeys(map(tuple, rng.integers(0, n + 12, (30, 2)).tolist())))}
        product = rng.integers(n, n + 12, len(ranks)) if seed % 2 else np.arange(n, n + len(ranks))
        pair = lambda a, b, t=ranks: np.array([t.get((int(x), int(y)), merging.NONE) for x, y in zip(a, b, strict=True)], np.int64)
        sym = rng.integers(0, n, 400)
        seq = np.sort(rng.integers(0, 4, 400))
        rounds = merging.by_rounds(sym.copy(), seq, pair, product)
        ranked = merging.by_ranks(sym.copy(), seq, pair, product)
        assert [x.tolist() for x in rounds] == [x.tolist() for x in ranked]
        for s in range(4):
            assert merging.by_queue(sym[seq == s].tolist(), pair, product).tolist() == rounds[0][rounds[1] == s].tolist()
