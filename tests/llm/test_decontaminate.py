"""Decontamination: passages of long items, repeated items, copies in other letters."""

import random

from quillstone.llm import decontaminate


def prose(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(3, 9))) for _ in range(n))


def contaminated(spark, texts, items, **options):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(d, b, **options).collect()}


def around(passage):
    return prose(1, 30) + " " + passage + " " + prose(2, 30)


def test_a_passage_of_a_long_item_is_caught(spark):
    items = [(0, prose(3, 40)), (1, prose(4, 200))]
    words = [t.split() for _, t in items]
    texts = [around(" ".join(words[0][7:27])), around(" ".join(words[1][90:140])), around(" ".join(words[1][20:33])), around(" ".join(words[1][20:32]))]
    got = contaminated(spark, texts, items)
    assert set(got) == {(0, 0), (1, 1), (2, 1)} and [got[k].n_run for k in sorted(got)] == [13, 43, 6]


def test_an_item_that_is_repeated_is_one_item(spark):
    item = prose(5, 17)
    short = " ".join(item.split()[:12])  # 5 of 10 windows
    got = contaminated(spark, [around(short)], [(1, item)] * 3 + [(1, prose(6, 50))])
    assert got[0, 1].item_windows == 10 and got[0, 1].coverage == 0.5


def test_an_item_of_numbers_is_caught_word_for_word(spark):
    sums = "What is 12 + 34 * 56 - 78?"
    long = "Add 12, 15, 18, 21, 24, 27, 30, 33, 36 and 39"  # no window has four plain words
    got = contaminated(spark, [sums, around(long), "what is 12 + 34 * 56 - 79?", around(long.replace("27", "28"))], [(0, sums), (1, long)])
    assert set(got) == {(0, 0), (1, 1)}


def test_case_and_line_breaks_do_not_hide_names(spark):
    words = prose(7, 40).split()
    words[3::4] = ["".join(w).title() for w in words[3::4]]  # a name in every window
    item = " ".join(words)
    got = contaminated(spark, [around(item), around(item.lower()), around(item.replace(" ", "\n")), around(item.upper())], [(0, item)])
    assert {k: v.coverage for k, v in got.items()} == {(i, 0): 1 for i in range(4)}
