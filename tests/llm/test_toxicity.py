"""Expressions that training saw once."""

import random

from quillstone.llm import toxicity


def test_words_of_one_training_row_are_learnt(spark):
    r = random.Random(1)
    vocabulary = ["".join(r.choices("aeioulnrst", k=r.randint(2, 8))) for _ in range(300)]
    rows, marks = [], []
    for i in range(300):
        words = r.choices(vocabulary, k=40)
        if i % 3 == 0:  # spelt differently in each row
            words[5:8] = ["blorgf" + "".join(r.choices("aeiou", k=6)) for _ in range(3)]
        rows.append((i, " ".join(words)))
        marks.append((i, int(i % 3 == 0)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    held = toxicity.score_held_out(docs, labels).where("held_out").join(labels, "doc_id").collect()
    assert sum(x.predicted for x in held if x.toxic) > 0.9 * sum(x.toxic for x in held)
    assert not any(x.predicted for x in held if not x.toxic)
