"""Words both stretched and parted are written out as the decoder alone would do it."""
import pytest

from folioscope.llm import abuse


@pytest.mark.parametrize("text, want", [("mooo-ron", "moron"), ("biii-tch", "bitch"), ("fuuuu-ck", "fuck"), ("mor-on", "moron"), ("well-known", "well-known"), ("co-op", "co-op")])
def test_parted_words(text, want):
    assert abuse.restore(text) == want


def test_the_gate_lets_every_decodable_word_through():
    model = abuse.speller()
    for w in filter(None, model.word):
        for at in range(len(w)):
            stretched = w[:at] + w[at] * 3 + w[at + 1 :]
            if stretched.isalpha() and model.decode(stretched):
                assert abuse.squeeze(stretched) in model.squeezed
