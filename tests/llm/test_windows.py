import hashlib
import random
import re

import numpy as np
import pytest

from jsonloom.llm.substring_dedup import remove_repeats
from jsonloom.llm.windows import Words, sliding, window_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    """Kept words of each (doc_id, text), documents in order."""
    places, out = {}, {}
    docs = sorted({(-1 if d is None else d, t or "") for d, t in rows})
    for at, (d, t) in enumerate(docs):
        words = WORD.findall(t)
        for i in range(len(words) - window + 1):
            places.setdefault(tuple(words[i : i + window]), (at, i))
    for at, (d, t) in enumerate(docs):
        words = WORD.findall(t)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if places[tuple(words[i : i + window])] != (at, i):
                gone[i : i + window] = [True] * window
        out[(d, t)] = (len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g))
    return out


def test_words():
    texts = ["a b  c\n a", "", None, " x y é ", "\x0b\x0c"]
    words = Words(texts)
    assert [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)] == [w for t in texts for w in WORD.findall(t or "")]
    h = words.hashes()
    assert h[0] == h[3] and len(set(h.tolist())) == len(h) - 1


def test_window_hashes_and_sliding():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 3, 400).astype(np.uint64)
    for n in (1, 2, 5, 10, 20):
        h = window_hashes(x, n)[: len(x) - n + 1]
        same = {}
        for i, v in enumerate(h.tolist()):
            assert same.setdefault(v, tuple(x[i : i + n])) == tuple(x[i : i + n])
        assert len(same) == len({tuple(x[i : i + n]) for i in range(len(x) - n + 1)})
        low = sliding(x, n, np.minimum, np.uint64(9))
        assert all(low[i] == x[i : i + n].min() for i in range(len(x)))


@pytest.mark.parametrize("window", [4, 20])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    base = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(6)) for _ in range(80)) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choice(base).split()
        a, b = sorted(rng.sample(range(80), 2))
        own = [f"u{rng.randrange(9)}" for _ in range(rng.randrange(30))]
        rows.append((i, " ".join(own + words[a:b] + own + (words[a:b] if rng.random() < 0.3 else []))))
    rows += [(60, rows[3][1]), (61, "x " * 50), (62, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, window=window).collect()}
    expected = brute(rows, window)
    assert got == {d: expected[(d, t)] for d, t in rows}


def test_odd_rows(spark, odd):
    out = remove_repeats(odd, window=20, keep=["score", "ordinal", "key"]).collect()
    expected = brute([(r.doc_id, r.text) for r in odd.collect()], 20)
    assert len(out) == odd.count()
    for r in out:
        assert (r.n_words, r.n_removed, r.kept) == expected[(-1 if r.doc_id is None else r.doc_id, r.text or "")]
        assert (r.score, r.ordinal, r["key"]) == (1.5, 7, "k")


def test_empty_table(spark, none):
    assert remove_repeats(none, keep=["lang"]).collect() == []


def test_query_against_brute_force(spark):
    from jsonloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    expected = brute(rows, 20)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in QUERIES["op2_level_wise_doubling"](spark, sf).collect()}
    assert got == {d: (*expected[(d, t)][:2], hashlib.sha256(expected[(d, t)][2].encode()).hexdigest()) for d, t in rows}


def test_levels_from_any_start(spark):
    """One level, two or three: the same words go."""
    import random

    from jsonloom.llm.substring_dedup import remove_repeats

    rng = random.Random(9)
    passages = [" ".join(f"{rng.choice('abc')}{rng.randrange(6)}" for _ in range(rng.randrange(8, 60))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else f"w{rng.randrange(30)}" for _ in range(rng.randrange(1, 30)))) for i in range(80)] + [(80, None), (81, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    digest = lambda **how: {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(df, window=20, **how).collect()}
    ten = digest()
    assert ten == digest(start=5) and sum(x[1] for x in ten.values()) > 100
    alone = spark.createDataFrame([(i, " ".join(f"x{i}_{j}" for j in range(50))) for i in range(5)], "doc_id long, text string")
    assert {r.n_removed for r in remove_repeats(alone, window=16, start=2).collect()} == {0}
    for wrong in (3, 20, 40):
        with pytest.raises(ValueError):
            remove_repeats(df, window=20, start=wrong)


def test_places_that_do_not_fit_are_an_error(spark):
    from jsonloom.llm.substring_dedup import word_bits

    assert word_bits(spark.createDataFrame([(7, "a b c d e f")], "ordinal long, text string")) == 3
    with pytest.raises(ValueError, match="63 bits"):
        word_bits(spark.createDataFrame([(1 << 61, "a b c d e f g h i")], "ordinal long, text string"))


def test_words_of_two_letters_in_the_pattern_that_meets_modulo_two_to_64():
    """Long words of two letters that sums with powers of one base take for equal."""
    pattern = [bin(i).count("1") % 2 for i in range(2048)]
    a, b = "".join("ab"[x] for x in pattern), "".join("ba"[x] for x in pattern)
    assert len(set(Words([a, b]).hashes().tolist())) == 2


def test_kept_columns_with_names_of_results(spark):
    from jsonloom.llm.substring_dedup import remove_repeats

    out = remove_repeats(spark.createDataFrame([(1, "a b", "own", 9)], "doc_id long, text string, kept string, n_removed int"), keep=["kept", "n_removed"])
    assert [r.asDict() for r in out.collect()] == [{"doc_id": 1, "kept_": "own", "n_removed_": 9, "text": "a b", "kept": "a b", "n_words": 2, "n_removed": 0}]
