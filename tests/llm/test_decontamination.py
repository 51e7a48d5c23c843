from jsonloom.llm.decontamination import Tokens, matches
from jsonloom.llm.queries import QUERIES

QUESTION = "Tom bought 12 apples for 3.50 dollars each and gave 5 of them to Mary, then he walked 4 km to the old market near the river."


def bench(spark, *texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, extra string")


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def found(d, b):
    return {(r.doc_id, r.item_id): r for r in matches(d, b).collect()}


def test_tokens():
    t = Tokens(["Tom has 3.5 kg of É apples, and Mary 12km. The end", None, "", "1,000 x"])
    assert [t.value(i) for i in range(len(t.start))] == ["tom", "has", "3.5", "kg", "of", "é", "apples", "and", "mary", "12", "km", "the", "end", "1,000", "x"]
    assert [i for i in range(len(t.start)) if t.number[i]] == [2, 9, 13]
    assert [i for i in range(len(t.start)) if t.unit[i]] == [3, 10]
    assert [i for i in range(len(t.start)) if t.name[i]] == [5, 8]


def test_copies_and_changed_questions(spark):
    other = QUESTION.replace("12", "20").replace("3.50", "1.25").replace("Mary", "Anna").replace("km", "miles").replace("5 of", "7 of")
    swapped = "x y z " + QUESTION.lower() + " and more"
    mixed = "Read this: " + QUESTION.replace(",", "") + " Indeed."
    d = docs(spark, "lead in " + QUESTION, "Here we go. " + other, swapped, mixed, "Nothing of the kind happened on that day in the old town by the sea.", None, "")
    got = found(d, bench(spark, QUESTION, "tiny one"))
    assert set(got) == {(0, 0), (1, 0), (2, 0), (3, 0)}
    assert not got[(0, 0)].changed and got[(1, 0)].changed and got[(0, 0)].n_covered == got[(0, 0)].n_item


def test_inconsistent_slots_do_not_count(spark):
    item = "they paid 7 coins on day 7 and again 7 coins on day 7 so 7"
    same, broken = item.replace("7", "9"), "they paid 1 coins on day 2 and again 3 coins on day 4 so 5"
    assert set(found(docs(spark, same, broken), bench(spark, item))) == {(0, 0)}


def test_short_items_and_odd_rows(spark, odd, none):
    b = bench(spark, "red green blue white black", "a", None, "", " ".join(f"p{i}" for i in range(40)))
    got = found(docs(spark, "deep red green blue white black sea", "a b c"), b)
    assert {k for k in got} == {(0, 0)}
    rows = matches(odd, b).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, 8), (False, 9), (True, 0)]
    assert matches(none, b).collect() == [] and matches(odd, b.where("false")).collect() == []


def test_query_against_brute_force(spark):
    import re

    sf = "/root/testdata/sf0.01"
    norm = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    items = {r.item_id: norm(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: norm(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = {(d, i) for d, t in texts.items() for i, x in items.items() if f" {x} " in f" {t} "}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_template_decontamination"](spark, sf).collect()}
    assert whole and whole <= got
    grams = {i: {tuple(x.split()[j : j + 8]) for j in range(len(x.split()) - 7)} for i, x in items.items()}
    for d, i in got - whole:
        words = texts[d].split()
        assert any(tuple(words[j : j + 8]) in grams[i] for j in range(len(words) - 7))


def test_slot_heavy_and_very_short_items_by_their_words(spark):
    b = bench(spark, "Compute 12 + 35 - 7 + 9 + 4", "What now, Ada?", "12 35", "Mississippi", "1 2 3 4 5 6 7 8 9 10")
    d = docs(spark, "Please compute 12 + 35 - 7 + 9 + 4 today", "Compute 13 + 35 - 7 + 9 + 4", "so what now, ada? she said", "Mississippi", "the Mississippi", "count 1 2 3 4 5 6 7 8 9 10 up", "what then, ada?")
    assert set(found(d, b)) == {(0, 0), (0, 2), (2, 1), (3, 3), (5, 4)}


def test_names_that_begin_sentences(spark):
    item = "Ana has 3 cats. Ben has 4 dogs. Who has more pets?"
    d = docs(spark, item, item.replace("Ben", "Dan"), item.replace("Ana", "Eva").replace("Ben", "Dan").replace("3", "6"), "Ana has 3 cats. Ben sold 4 pigs. Who has less food?")
    got = found(d, bench(spark, item))
    assert set(got) == {(0, 0), (1, 0), (2, 0)}
    assert not got[(0, 0)].changed and got[(1, 0)].changed and got[(2, 0)].changed
    # words that begin sentences and change in several ways spoil nothing
    long = "The farmer brought 12 apples to market on a cold morning in early spring. The baker sold 5 loaves."
    assert (0, 0) in found(docs(spark, long.replace("The farmer", "A farmer").replace("12", "15")), bench(spark, long))


def plain_tokens(text):
    """Words of an ASCII text with their kinds, by a regular expression."""
    import re

    from jsonloom.llm import decontamination as D

    out, at = [], 0
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[A-Za-z_][A-Za-z0-9_]*", text):
        w, between = m[0], text[at : m.start()]
        number = w[0].isdigit() or w.lower() in D.NUMBERS
        unit = not number and bool(out) and out[-1][1] == "num" and w.lower() in D.UNITS
        capital = w[0].isupper() and not number and not unit
        name = capital and bool(out) and not any(c in between for c in '.!?:;"\n')
        out.append((w.lower(), "num" if number else "unit" if unit else "", capital, name))
        at = m.end()
    return out


def plain_windows(text, lengths):
    """(place, length, codes, values by place, whether names may begin sentences) of all windows of all forms."""
    from jsonloom.llm import decontamination as D

    tokens, out = plain_tokens(text), []
    for form in ("raw", "plain", "named", "initial"):
        for n in lengths:
            for i in range(len(tokens) - n + 1):
                part = tokens[i : i + n]
                heavy = sum(k != "" for _, k, _, _ in part)
                if form == "raw":
                    if (n >= D.SHORTEST and 2 * heavy <= n) or (n == 1 and len(tokens) != 1):
                        continue
                    codes = [w for w, _, _, _ in part]
                else:
                    codes = [k or ("name" if (form == "named" and name) or (form == "initial" and cap) else w) for w, k, cap, name in part]
                    codes = [f"<{c}>" if c in ("num", "unit", "name") and c != w else c for c, (w, _, _, _) in zip(codes, part, strict=True)]
                    slots = sum(c[0] == "<" for c in codes)
                    if 2 * slots > n or n < D.SHORTEST or (form == "named" and not any(t[3] for t in part)) or (form == "initial" and not any(t[2] and not t[3] for t in part)):
                        continue
                out.append((i, n, tuple(codes), {j: part[j][0] for j in range(n) if codes[j][0] == "<"}, form == "initial"))
    return out, len(tokens)


def plain_matches(docs, items, window=8):
    from jsonloom.llm import decontamination as D

    sizes = {i: len(plain_tokens(t)) for i, t in items.items()}
    lengths = sorted({n for n in sizes.values() if 0 < n < window}) + [window]
    cover = lambda spans: len({p for at, n in spans for p in range(at, at + n)})
    asked = {i: [w for w in plain_windows(t, lengths)[0] if w[1] in (window, sizes[i])] for i, t in items.items()}
    out = {}
    for d, text in docs.items():
        mine = plain_windows(text, lengths)[0]
        for i, theirs in asked.items():
            offsets = {}
            for at, n, codes, values, first in mine:
                for b_at, b_n, b_codes, b_values, b_first in theirs:
                    if codes == b_codes:
                        offsets.setdefault(at - b_at, []).append((b_at, n, {(b_values[j], values[j]) for j in values}, first or b_first))
            spans, pairs = set(), set()
            for hits in offsets.values():
                options = []
                for chosen in (hits, [h for h in hits if not h[3]]):
                    own = set().union(*(h[2] for h in chosen))
                    one = len(own) == len({a for a, _ in own})
                    options.append((one, {h[:2] for h in chosen}, own))
                (wide_ok, wide, wide_pairs), (ok, inner, inner_pairs) = options
                places, own = (inner, inner_pairs) if ok else ({h[:2] for h in hits if not h[2]}, set())
                if wide_ok and cover(wide) > cover(places):
                    places, own = wide, wide_pairs
                spans |= places
                pairs |= own
            n = cover(spans)
            if n >= D.LONG or (n and n >= D.SHARE * sizes[i]):
                out[d, i] = (n, sizes[i], len(pairs), any(a != b for a, b in pairs))
    return out


def test_changed_questions_against_brute_force(spark):
    """Numbers, names and units changed at random, in one way or in several, against windows and slots written out."""
    import random

    rng = random.Random(12)
    names, units, words = ["Ana", "Ben", "Cora", "Dov"], ["km", "miles", "kg", "hours"], "walked carried the old market near river bought apples pears each then gave some many left before how far did".split()

    def question():
        out = []
        for _ in range(rng.randrange(5, 30)):
            out.append(rng.choice([rng.choice(words), rng.choice(words), rng.choice(words), str(rng.randrange(3, 40)), f"{rng.randrange(9)}.5 {rng.choice(units)}", rng.choice(names), "seven"]))
            if rng.random() < 0.12:
                out[-1] += rng.choice([".", "?", ","])
        return " ".join(out)

    items = {i: question() for i in range(25)} | {30: "Six", 31: "apples pears", 32: "3 km 4 km 5"}

    def changed(text):
        import re

        known = {}
        swap = lambda m: known.setdefault(m[0], str(rng.randrange(50, 60))) if rng.random() < 0.9 else str(rng.randrange(60, 99))
        text = re.sub(r"\d+", swap, text) if rng.random() < 0.7 else text
        for name in names:
            if rng.random() < 0.4:
                text = text.replace(name, rng.choice(["Eve", "Finn"]))
        return text

    docs = {}
    for d in range(160):
        text = changed(rng.choice(list(items.values()))) if rng.random() < 0.8 else question()
        cut = text.split()[rng.randrange(3) :]
        docs[d] = " ".join([*rng.choices(words, k=rng.randrange(4)), *cut, *rng.choices(words, k=rng.randrange(4))])
    docs |= {200: "six", 201: "apples pears", 202: "Read: 3 km 4 km 5", 203: "3 km 4 km 6"}
    got = matches(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()
    expected = plain_matches(docs, items)
    assert sum(x[3] for x in expected.values()) > 20 and len(expected) > 80
    assert {(r.doc_id, r.item_id): (r.n_covered, r.n_item, r.n_slots, r.changed) for r in got} == expected


def test_typography_and_repeated_rows(spark):
    item = "The teacher's red bag - the one by the door - holds 14 books, 3 pens and a map of the town."
    curly = "Intro. “The teacher’s red bag — the one by the door — holds 14 books, 3 pens and a map of the town…”"
    got = matches(docs(spark, item, curly, "nothing"), bench(spark, item)).collect()
    assert sorted((r.doc_id, r.n_covered == r.n_item) for r in got) == [(0, True), (1, True)]
    twice = spark.createDataFrame([(5, item), (5, item), (None, item), (None, item), (6, "x")], "doc_id long, text string")
    assert sorted(r.doc_id or 0 for r in matches(twice, bench(spark, item)).collect()) == [0, 0, 5, 5]
    signs = "今日は天気がいいから散歩しましょう"
    assert set(found(docs(spark, f"話：「{signs}」と言った", "天気"), bench(spark, signs))) == {(0, 0)}
