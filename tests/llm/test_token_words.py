"""How new words reach the tokenizer in op8."""

import random
import re

import pytest

import public_tokenizers
from quillstone.llm import tokens
from quillstone.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


class Spy:
    """A tokenizer that notes the texts it is given one by one."""

    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def __getattr__(self, name):
        return getattr(self.tokenizer, name)

    def encode_batch(self, texts, **more):
        self.asked += texts
        return self.tokenizer.encode_batch(texts, **more)


def test_new_words_of_letters_do_not_go_one_by_one(whole):
    deal = random.Random(1)
    words = ["".join(deal.choices("aeiourstnlüéß", k=deal.randint(3, 12))) + deal.choice(["", "", ",", ".", "'s", ".$$$"]) for _ in range(5000)]
    e = tokens.Encoder(PATH)
    e.tokenizer = spy = Spy(e.tokenizer)
    assert e([" ".join(words).encode()])[0].tolist() == [*whole.encode(" ".join(words), add_special_tokens=False).ids, 2]
    assert len(spy.asked) <= 10


def test_every_letter_is_left_as_it_is_and_joins_its_neighbours(whole):
    letters = [c for c in map(chr, range(0x500)) if re.match(f"[{tokens.LETTERS}]", c)]
    assert len(letters) > 100
    run = "".join(letters) + "".join(letters[::-1]) + "".join(c * 2 for c in letters)
    assert whole.normalizer.normalize_str(run) == run and len(whole.pre_tokenizer.pre_tokenize_str(run)) == 1


def test_texts_of_odd_characters_equal_the_tokenizer(whole):
    deal = random.Random(2)
    some = ["a", "b", "é", "ß", "ж", "σ", "ς", "Σ", "İ", "ł", "E", "Ü", "'", "'s", "'LL", ".", ",", "=", "<", ">", "|", "1", "٣", "²", "́", "̸", "ﬁ", "中", "한", "ᄀ", "ᅡ", "\x00", "\x1c", "\x85", " ", " ", "‍", "😀", "</w>", "<|endoftext|>", "<|ENDOFTEXT|>"]
    texts = ["".join(deal.choice(some) if deal.random() < 0.7 else deal.choice([" ", "\n", "\t", "\x0b", "abc", "xyz"]) for _ in range(deal.randint(0, 30))) for _ in range(4000)]
    want = [[*whole.encode(t, add_special_tokens=False).ids, 2] for t in texts]
    for held in (5, 600_000):
        e = tokens.Encoder(PATH, words_held=held)
        assert [x.tolist() for i in range(0, len(texts), 97) for x in e([t.encode() for t in texts[i : i + 97]])] == want
    assert tokens.Encoder(PATH)([]) == []


def test_a_text_that_fails_leaves_no_word_without_ids(whole):
    e = tokens.Encoder(PATH)
    with pytest.raises(UnicodeDecodeError):
        e([b"good words \xff"])
    assert e([b"good words"])[0].tolist() == [*whole.encode("good words", add_special_tokens=False).ids, 2]
