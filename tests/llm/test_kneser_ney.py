"""The toxicity models against Kneser-Ney by dictionaries, on a small alphabet."""

import functools
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from quillstone.llm import toxicity

ORDER, D, S = 4, toxicity.DISCOUNT, toxicity.STRENGTH


class Plain:
    """Kneser-Ney with shared backoff as the module's docstring says it, one byte at a time."""

    def __init__(self, counts: dict[bytes, tuple[int, int]]):
        self.classes, self.ahead = (Counter(), Counter()), [set() for _ in range(ORDER)]
        for word, n in counts.items():
            spelt = b"\x01" + word + b"\x02"
            for i in range(1, len(spelt)):
                for c in (0, 1):
                    self.classes[c][spelt[max(0, i - ORDER + 1) : i], spelt[i]] += n[c]
                for k in range(1, ORDER):
                    if i >= k:
                        self.ahead[k].add(spelt[i - k : i + 1])

    @functools.lru_cache(maxsize=None)  # noqa: B019
    def shared(self, context: bytes, byte: int) -> float:
        """By continuation counts: how many bytes stand before context and byte."""
        if not context:
            lower = 1 / 256
        else:
            lower = self.shared(context[1:], byte)
        grams = Counter(g[1:] for g in self.ahead[len(context) + 1] if g[1:-1] == context)
        total = sum(grams.values())
        return lower if not total else (max(grams[context + bytes([byte])] - D, 0) + D * len(grams) * lower) / total

    def smoothed(self, counts: Counter, context: bytes, byte: int, lower: float, strength: float) -> float:
        seen = {b: n for (h, b), n in counts.items() if h == context and n}
        total = sum(seen.values()) + strength
        return lower if not total else (max(seen.get(byte, 0) - D, 0) + (strength + D * len(seen)) * lower) / total

    @functools.lru_cache(maxsize=None)  # noqa: B019
    def next(self, c: int, context: bytes, byte: int) -> float:
        both = self.smoothed(self.classes[0] + self.classes[1], context, byte, self.shared(context[1:], byte), 0.0)
        return self.smoothed(self.classes[c], context, byte, both, S)

    def log(self, c: int, word: bytes) -> float:
        spelt = b"\x01" + word + b"\x02"
        return sum(math.log(self.next(c, spelt[max(0, i - ORDER + 1) : i], spelt[i])) for i in range(1, len(spelt)))


@pytest.fixture(scope="module")
def small():
    r = random.Random(5)
    counts: dict[bytes, tuple[int, int]] = {}
    for _ in range(60):
        word = "".join(r.choices("abc", weights=(5, 3, 1), k=r.randint(1, 6))).encode()
        counts[word] = (r.choice((0, 0, 1, 2, 5)), r.choice((0, 1, 1, 3)))
    counts = {w: n for w, n in counts.items() if sum(n)}
    words = sorted(counts)
    n = np.array([counts[w] for w in words], dtype=float)
    return Plain(counts), toxicity.train(words, n[:, 1], n[:, 0], ORDER), words


def test_ratios_by_brute_force(small):
    plain, model, words = small
    r = random.Random(6)
    unseen = ["".join(r.choices("abcd", k=r.randint(1, 7))).encode() for _ in range(40)]
    for word, got in zip(words + unseen, model.ratios(words + unseen), strict=True):
        assert got == pytest.approx(plain.log(1, word) - plain.log(0, word), abs=1e-5), word


def test_each_model_is_a_distribution(small):
    plain, _, words = small
    for context in {(b"\x01" + w)[-3:] for w in words}:
        for c in (0, 1):
            assert sum(plain.next(c, context, b) for b in range(256)) == pytest.approx(1, abs=1e-9)


def test_evidence_is_the_likelihood_of_the_whole_text(spark, small):
    """A word counts as often as it stands there; ordinary words speak for the ordinary class."""
    plain, model, words = small
    share = toxicity.SHARE
    text = [words[i % len(words)] for i in (0, 3, 3, 3, 7, 11, 0)]
    each = [math.log(1 - share + share * math.exp(plain.log(1, w) - plain.log(0, w))) for w in text]
    got = toxicity.score(spark.createDataFrame([(1, b" ".join(text).decode())], "doc_id long, text string"), model).first().score
    assert got == pytest.approx(1 / (1 + math.exp(-toxicity.scaled(np.array([sum(each) / len(each)]))[0])), abs=1e-6)
    assert min(each) < 0


def test_long_runs_are_read_whole_in_pieces(spark):
    run = b"x" * 1000
    assert b"".join(toxicity.words_of(run)) == run
    assert max(map(len, toxicity.words_of(b"a " + run))) == toxicity.PIECE
    long_ = spark.createDataFrame([(1, "spite " * 200_000), (2, "漢" * 300_000)], "doc_id long, text string")
    model = toxicity.train([b"spite", b"calm"], np.array([5.0, 1.0]), np.array([1.0, 5.0]))
    assert toxicity.score(long_, model).count() == 2


def test_training_holds_little_for_a_byte():
    """All orders of one part of the n-grams, then the next: hashes of all places at once took over 100 bytes a place."""
    r = random.Random(7)
    words = sorted({bytes(r.choices(b"abcdefghijklmnopqrstuvwxyz", k=r.randint(3, 12))) for _ in range(40_000)})
    n = np.array([[r.randint(0, 3), r.randint(1, 9)] for _ in words], dtype=float)
    tracemalloc.start()
    toxicity.train(words, n[:, 0], n[:, 1])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 75 * sum(len(w) + 2 for w in words)
