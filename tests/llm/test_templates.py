"""Templates, windows and slots against a brute-force version; heroes, numerals and rows without an id."""

import random

import pytest
import regex

from quillstone.llm import decontaminate as d

HERO = "Maria buys three apples at 2 dollars each and seven pears for her brother Tom; how much money does she have left if she had 40 dollars when she came to the market"


def brute_tokens(text):
    t = regex.sub(r"(?<![\p{L}\p{M}\p{N}])\p{Lu}\p{Ll}\p{L}*", lambda m: m[0] if m[0] in d.STARTERS else d.NAME + m[0], text or "")
    found, after_number = [], False
    for m in regex.finditer(rf"{d.NAME}?[\p{{L}}\p{{M}}]+|\p{{N}}+(?:[.,:/]\p{{N}}+)*", t):
        w = m[0]
        if regex.match(r"\p{N}", w) or w in d.NUMERALS:
            found.append(d.NUMBER + w)
        elif after_number and w.lower() in d.UNITS and regex.match(r"(?:$|[^\p{L}\p{M}\p{N}])", t[m.end() :]):
            found.append(d.UNIT + w.lower())
        else:
            found.append(w.lower())
        after_number = found[-1][0] == d.NUMBER
    return found


def marked(token):
    return token < "\x04"


def brute_pairs(text, item, size=d.WINDOW):
    """For each offset of equal template or exact windows whose slots are one to one: the item's places."""
    a, b = brute_tokens(item), brute_tokens(text)
    kind = lambda w: tuple(t[0] if marked(t) else t for t in w)
    value = lambda w: tuple(t.lstrip("\x01\x02\x03") for t in w)
    plain = [sum(not marked(t) for t in a[i : i + size]) >= d.PLAIN_WORDS for i in range(len(a) - size + 1)]
    at = {}
    for i in range(len(a) - size + 1):
        for j in range(len(b) - size + 1):
            x, y = a[i : i + size], b[j : j + size]
            if (plain[i] and kind(x) == kind(y)) or value(x) == value(y):
                places, slots = at.setdefault(j - i, (set(), set()))
                places.add(i)
                slots |= {(s, s if value([s]) == value([t]) else t) for s, t in zip(x, y, strict=True) if marked(s)}
    good = [places for places, slots in at.values() if len({s for s, _ in slots}) == len(slots) == len({t for _, t in slots})]
    every = set().union(*good) if good else set()
    runs = [0]
    for places in good:
        for i in places:
            n = 1
            while i + n in places:
                n += 1
            runs.append(n)
    return len(every), sum(plain[i] for i in every), max(runs), len(plain), sum(plain)


def found(spark, texts, items, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in d.matches(docs, bench, **options).collect()}


def test_windows_and_slots_by_brute_force(spark):
    r = random.Random(8)
    names, verbs = ["Anna", "Boris", "Clara", "The", "Zed"], ["buys", "sells", "eats", "finds", "two", "km", "hours"]
    word = lambda: r.choice([r.choice(names), r.choice(verbs), r.choice(verbs), str(r.randint(1, 30)), r.choice("pears plums and of so".split()), r.choice([".", ",", "-"])])
    items = [" ".join(word() for _ in range(r.randint(12, 30))) for _ in range(8)]
    texts = []
    for item in items * 3:
        words = item.split()
        swap = dict(zip(names, r.sample(names, len(names)), strict=True)) if r.random() < 0.6 else {}
        words = [swap.get(w, str(int(w) + 1) if w.isdigit() and swap else w) for w in words]
        if r.random() < 0.4:
            words[r.randrange(len(words))] = word()
        texts.append(" ".join([word() for _ in range(9)] + words[r.randint(0, 3) :] + [word() for _ in range(9)]))
    got = found(spark, texts, items)
    for i, text in enumerate(texts):
        for k, item in enumerate(items):
            n_all, n_plain, n_run, whole, plain = brute_pairs(text, item)
            if not n_all:
                assert (i, k) not in got
                continue
            by_plain = plain > 0 and n_plain * whole >= n_all * plain
            row = got[i, k]
            assert (row.n_windows, row.item_windows, row.n_run) == ((n_plain, plain) if by_plain else (n_all, whole)) + (n_run,), (text, item)


@pytest.mark.parametrize("hero", ["Ann", "Mary Ann", "Mary Ann Lee"])
def test_a_hero_at_the_start_is_renamed(spark, hero):
    item = HERO.replace("Maria", hero, 1)
    other = HERO.replace("Maria", " ".join(["Karla", "Luise", "Mai"][: len(hero.split())]), 1).replace("Tom", "Ulf").replace("three", "nine").replace("seven", "four").replace("40", "55")
    docs = spark.createDataFrame([(1, "Here it is. " + other), (2, "Nothing of the kind is here, only some words that say nothing")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    assert [r.doc_id for r in d.contaminated(docs, bench).collect()] == [1]


def test_rows_are_dropped_by_their_own_text(spark):
    docs = spark.createDataFrame([(None, HERO), (None, "clean"), (1, HERO), (1, "clean"), (2, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, HERO)], "item_id long, text string")
    assert sorted(map(str, d.drop_contaminated(docs, bench).collect())) == sorted(map(str, docs.where("text is null or text = 'clean'").collect()))


def test_a_very_long_text(spark):
    docs = spark.createDataFrame([(1, "word " * 200_000 + HERO)], "doc_id long, text string")
    assert d.contaminated(docs, spark.createDataFrame([(1, HERO)], "item_id long, text string")).count() == 1
