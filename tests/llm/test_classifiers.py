import zlib

import numpy as np
import pytest

from jsonloom.llm import language_id as L
from jsonloom.llm import toxicity as T
from jsonloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def remainder(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_suffix_automaton_knows_all_substrings_and_no_others():
    rng = np.random.default_rng(2)
    s = rng.integers(0, 3, 60).tolist()
    follow = L.suffix_automaton(s)
    known = {tuple(s[i:j]) for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
    for length in range(1, 7):
        for code in range(3**length):
            word, state = [code // 3**k % 3 for k in range(length)], 0
            for x in word:
                state = follow[state].get(x, None) if state is not None else None
            assert (state is not None) == (tuple(word) in known)


def test_phrases_equal_a_plain_parse():
    taught = {"a": ["the cat sat on the mat and the dog ran off", "once upon a time"], "b": ["le chat est sur le tapis rouge"]}
    parser = L.Parser(taught)
    texts = ["the dog sat on a red mat, once!", "Le chat rouge", "zzz ÿÿ 日本", "", "12 34", "the cat " * 100]
    count, lens, letters = parser.phrases(texts)
    for i, lang in enumerate(parser.langs):
        joined = [x for t in taught[lang] for x in [*parser.symbols([t])[0].tolist(), L.SPACE]]
        text = "".join(map(chr, joined))
        for j, t in enumerate(texts):
            x = parser.symbols([t])[0].tolist()
            total = 0
            for at in range(0, len(x), L.SEGMENT):
                piece, phrase, n = x[at : at + L.SEGMENT], "", 1
                for c in piece:
                    if phrase + chr(c) in text:
                        phrase += chr(c)
                    else:
                        n, phrase = n + 1, chr(c) if chr(c) in text else ""
                total += n
            assert count[i, j] == total
    assert letters.tolist() == [True, True, True, False, False, True]
    assert parser.predict(texts)[0][:2] == ["a", "b"] and parser.predict(texts)[0][3:5] == ["und", "und"]


def test_language_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op8_cross_parsing_language"](spark, SF).collect()
    assert len(rows) == len(langs) and all(0 <= r.score <= 1 and r.held_out == (remainder(r.doc_id, 4) == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in held]) > 0.98


def test_language_odd_rows(spark, odd, none):
    rows = L.identify(odd, keep=["text", "n"]).collect()
    assert len(rows) == odd.count()
    assert all(r.lang_pred == "und" and r.score == 0 for r in rows if not any(c.isalpha() for c in r.text or ""))
    assert all(r.lang_pred in ("en", "de", "ja", "fr") for r in rows if any(c.isalpha() for c in r.text or ""))
    assert L.identify(none).collect() == []
    unlabelled = odd.withColumn("lang", odd["lang"].substr(9, 9)).where("lang = 'no'")
    assert L.identify(unlabelled).collect() == []


def test_rare_letters_are_told_apart():
    rng = np.random.default_rng(5)
    common, letters = [chr(0x4E00 + i) for i in range(400)], [chr(0x10A0 + i) for i in range(30)]
    taught = {"many": ["".join(rng.choice(common, 200)) + " " for _ in range(60)], "none": ["ΟΔΟΣ ab"], "rare": ["".join(rng.choice(letters[:15], 40))], "seldom": ["".join(rng.choice(letters[15:], 40))]}
    parser = L.Parser(taught)
    assert not (parser.symbol[[ord(c) for t in taught.values() for x in t for c in x]] == L.OTHER).any()
    assert parser.predict([taught["rare"][0][5:25], taught["seldom"][0][5:25], taught["many"][3][:50], "δοσ"])[0] == ["rare", "seldom", "many", "none"]
    texts = ["".join(rng.choice(common + letters + list("ab zé"), 700)), taught["rare"][0], taught["many"][0] + taught["many"][7], "日本"]
    wide, narrow = L.Parser(taught, dense=10_000), L.Parser(taught, dense=0)
    assert wide.rare is None and parser.rare is not None and narrow.width == 3
    for other in (parser, narrow):
        assert all(np.array_equal(a, b) for a, b in zip(wide.phrases(texts), other.phrases(texts), strict=True))


def test_languages_with_long_or_late_texts_are_learned(spark):
    words = {"aa": "balo miku rena tosi", "bb": "zgry wplk drne hsto", "cc": "ouvi eaul iqua oeno"}
    rows = [(i, "aa", f"{words['aa']} " * 5) for i in range(40)] + [(100 + i, "bb", f"{words['bb']} " * (2500 + i)) for i in range(4)]
    rows += [(200 + i, "cc", [None, "", "12 34"][i % 3]) for i in range(400)] + [(600 + i, "cc", f"{words['cc']} " * 5) for i in range(8)]
    rows += [(1000, None, words["aa"]), (1001, None, words["bb"]), (1002, None, words["cc"])]
    got = {r.doc_id: r.lang_pred for r in L.identify(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()}
    assert [got[i] for i in (1000, 1001, 1002)] == ["aa", "bb", "cc"]
    assert {got[100 + i] for i in range(4)} == {"bb"} and len(got) == len(rows)


def test_toxic_words_are_found(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("aeiourst"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(1500):
        text = rng.choice(words, 40).tolist()
        toxic = i % 7 == 0
        if toxic:
            text[int(rng.integers(40))] = "zyx" + "".join(rng.choice(list("aeiou"), 2))
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(toxic), 1))
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string, score string"), spark.createDataFrame(labels, "doc_id long, toxic int, text int")
    got = T.score(docs, marks).collect()
    assert len(got) == 1500 and all(r.held_out == (remainder(r.doc_id, 5) == 0) for r in got)
    held = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 7 == 0) for r in held]) > 0.97


def test_toxic_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op7_kneser_ney_toxicity"](spark, SF).collect()
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and labels.get(r.doc_id) is not None]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([[a > b for b in zeros] for a in ones]) > 0.95


def test_toxicity_odd_rows(spark, odd, none):
    marks = spark.createDataFrame([(1, 1), (2, 0), (5, 0), (None, 1), (6, None), (8, 1), (8, 0)], "doc_id long, toxic int")
    rows = T.score(odd, marks).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert T.score(none, marks).collect() == []
    flat = T.score(odd, marks.where("false")).collect()
    assert len({r.score for r in flat}) == 1


class Plain:
    """Kneser-Ney models of both classes with shared continuation counts, written out over dictionaries."""

    def __init__(self, counts):
        self.counts, self.grams, d = counts, set(counts[0]) | set(counts[1]), T.DISCOUNT
        self.d, self.letters = d, {g[-1] for g in self.grams}

    def shared(self, context, letter):
        """The share of a letter among the kinds of parts that go on from a context."""
        if context is None:
            return 1 / len(self.letters)
        k = len(context) + 1
        kinds = {g[-k - 1 :] for g in self.grams}
        total = sum(x[1:-1] == context for x in kinds)
        below = self.shared(context[1:] if context else None, letter)
        if not total:
            return below
        own = sum(x[1:] == context + letter for x in kinds)
        follow = len({x[1:] for x in kinds if x[1:-1] == context})
        return (max(own - self.d, 0) + self.d * follow * below) / total

    def chance(self, label, context, letter):
        n = self.counts[label]
        total, follow = sum(v for g, v in n.items() if g[:-1] == context), sum(v > 0 and g[:-1] == context for g, v in n.items())
        below = self.shared(context[1:], letter)
        if not total:
            return below
        return max(n.get(context + letter, 0) - self.d, 0) / total + self.d * follow / total * below


def small_models():
    texts = [["aab", "aac", "aba", "bab", "aab", "c"], ["aab", "bca", "bb", "cab"]]
    counts = [{}, {}]
    for label, words in enumerate(texts):
        chars, _ = T.grams_of(words)
        for row in chars:
            g = "".join(map(chr, row))
            counts[label][g] = counts[label].get(g, 0) + 1
    grams = sorted(set(counts[0]) | set(counts[1]))
    n = [np.array([c.get(g, 0) for g in grams]) for c in counts]
    return Plain(counts), T.Model(grams, *n), grams


def test_models_sum_to_one():
    """The probabilities of all that may follow a known context sum to one, for both classes."""
    plain, _, grams = small_models()
    for context in {g[:-1] for g in grams}:
        for label in (0, 1):
            assert abs(sum(plain.chance(label, context, x) for x in plain.letters) - 1) < 1e-12


def test_model_against_brute_force():
    """Ratios of parts, known and unknown, and what a text adds up to, against models that are written out."""
    plain, model, _ = small_models()
    words = ["aab", "abc", "bca", "ccc", "a", "zab", "cabba"]
    expected = []
    for w in words:
        text, total = T.PAD * (T.ORDER - 1) + w + T.END, 0.0
        for i in range(T.ORDER - 1, len(text)):
            context, letter = text[i - T.ORDER + 1 : i], text[i]
            if letter in plain.letters or any(g[:-1] == context for g in plain.grams):
                total += np.log(plain.chance(1, context, letter) / plain.chance(0, context, letter))
        expected.append(np.logaddexp(np.log1p(-T.SHARE), np.log(T.SHARE) + total))
    assert np.allclose(model.weigh(words), expected, atol=1e-12)
    got = T.normalised([" ".join(words), "", None, "aab aab"], model, T.Known(0.0))
    assert np.allclose(got, [sum(expected) / np.sqrt(len(words)), 0, 0, 2 * expected[0] / np.sqrt(2)])


def test_parts_seen_once_count(spark):
    """A rare toxic word that one labelled document has makes a text with it more suspicious than one without."""
    rows = [(i, f"plain words about day {i % 9} and night", 0) for i in range(300)] + [(1000 + i, f"plain words with vile{'xyz'[i % 3]} in them", 1) for i in range(60)] + [(2000, "plain words with grobnik in them", 1)]
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows] + [(3001, "words about grobnik and day"), (3002, "words about gardens and day")], "doc_id long, text string")
    marks = spark.createDataFrame([(d, y) for d, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in T.score(docs, marks).collect()}
    assert remainder(2000, 25) >= 5 and got[3001] > got[3002]


@pytest.mark.parametrize("slope", [0.5, 3.0])
def test_logistic(slope):
    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(slope * x - 1)))).astype(float)
    a, b = T.fit_logistic(x, y)
    assert abs(a - slope) < 0.35 and abs(b + 1) < 0.3


def test_kept_columns_with_names_of_results(spark):
    docs = spark.createDataFrame([(1, "some words", "en", 7.0, "x")], "doc_id long, text string, lang string, score double, lang_pred string")
    out = L.identify(docs, keep=["text", "score", "lang_pred"])
    row = out.collect()[0].asDict()
    assert row["score_"] == 7.0 and row["lang_pred_"] == "x" and row["lang_pred"] == "en" and row["text"] == "some words"
