"""What a Python worker holds between tasks."""

import public_tokenizers

from quillstone.llm import shared, tokens
from quillstone.llm.queries import TOKENIZER


def test_tasks_of_another_kind_drop_the_encoder():
    make = lambda: tokens.encoder(public_tokenizers.path(TOKENIZER), tokens.END_ID)
    first = make()
    assert list(shared.freeing(lambda b: (make() is first for _ in b), keeps=True)(iter([0, 1]))) == [True, True]
    assert list(shared.freeing(lambda b: b)(iter([0]))) == [0]
    assert make() is not first
