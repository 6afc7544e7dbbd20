"""Placeholders padded beyond the length at which an answer is taken for a text."""
import numpy as np
import pytest

from folioscope.llm import pairs


@pytest.mark.parametrize("text", ["null" + " " * 60 + "|", "null" + "." * 80, "N/A " + "-" * 300, "=" * 70 + " null " + "=" * 70, "| " * 40 + "n/a"])
def test_padded_placeholders_say_nothing(text):
    assert pairs._say_nothing(text)
    assert pairs.judge("What is the role of the hash tree?", text, pairs.models_of(np.zeros(pairs.CELLS))) == "empty"


@pytest.mark.parametrize("text", ["null" + "." * 80 + " is the value of the field [c1].", "The value is null. " * 5])
def test_texts_with_such_words_say_something(text):
    assert not pairs._say_nothing(text)
