"""The models of question and answer pairs: batches against single texts, wordings that no seed holds, and what decides on truncation."""
import numpy as np
import pytest

from folioscope.llm import pairs as P

TEXTS = ["The tree binds KEY-1 (see c2) [c1]. It holds.", "", "Der Baum bindet\njedes Blatt:", "a", "x_y <- HASH.Sign(3)\n2.", "¿Qué es? 😀 Nada."]


def test_batches_count_as_single_texts_do():
    ends = [True, True, False, True, True, True]
    assert (P.count_texts(TEXTS, ends) == sum(P.count_texts([t], [e]) for t, e in zip(TEXTS, ends))).all()
    model = P.bayes(P.seed_model())
    said = [P.prose(t) for t in TEXTS]
    assert np.allclose(P.posteriors(said, model), np.concatenate([P.posteriors([t], model) for t in said]))
    rng = np.random.default_rng(1)
    end, seen = rng.integers(0, 9, P.ENDINGS).astype(np.float32), rng.integers(9, 20, P.ENDINGS).astype(np.float32)
    shown = [P.signs(t) for t in TEXTS]
    assert np.allclose(P.end_chances(shown, end, seen), [P.end_chances([t], end, seen)[0] for t in shown])


def test_contexts_by_brute_force():
    codes, place, _ = P._codes(["abc", "", "bc"])
    got = P._contexts(codes, place)
    # the same signs before a position give the same bucket, whatever text stood before
    one, two = P._codes(["bc"])[0], P._codes(["bc"])[1]
    assert (got[3:] == P._contexts(one, two)).all() and (got[2, :2] == P._contexts(one, two)[1, :2]).all() and got[2, 2] != P._contexts(one, two)[1, 2]


def test_unit_ends():
    text = P.signs("It holds [c1]. The tree: ends; so\nyes")
    codes, place, _ = P._codes([text])
    assert [text[i] for i in P._unit_ends(codes, place)] == ["s", "e", "s", "o"]


@pytest.mark.parametrize("text", [
    "I'm afraid this falls outside the material I was given.", "This cannot be determined from the text.", "No comment.", "This is not something the pages talk about.", "Das kann ich nicht sagen.", "On ne trouve rien là-dessus.",
    "Good question! Sadly I was not able to find an answer in the documents.", "Nada de esto aparece en los documentos, así que no puedo contestar.", "Ich kann diese Frage nicht beantworten.", "SORRY, I DO NOT KNOW.",
])
def test_refusals_in_other_words(text):
    assert P._refuses(text)


@pytest.mark.parametrize("text", [
    "If the root is not found, the receiver must refuse the request [c2].", "The key cannot be read from the memory of the device.", "No block may be larger than 16 bytes.", "The document does not change when the number of readers grows.",
    "Sorry for the delay. The answer is 352 bytes.", "An attacker who cannot guess the seed gains nothing.",
])
def test_answers_with_such_words(text):
    assert not P._refuses(text)


@pytest.mark.parametrize("question, answer", [
    ("What is the role of the hash tree in FooBar-128?", "What role does the hash tree have in FooBar-128?"), ("Which parameter set does FooBar require?", "FooBar requires which parameter set?"),
    ("Why must the trust anchor be reserved?", "Why does the trust anchor have to be reserved?"),
])
def test_questions_asked_again_are_copies(question, answer):
    assert P._copies(question, answer)


def test_short_answers_need_no_gate():
    models = P.models_of(np.zeros(P.CELLS))
    for q, a in (("Quel est le rôle de KEY-1 ?", "303 bytes"), ("What is it?", "Nein"), ("Why?", "KESKAPHO-MAC-192 [c1]"), ("Where is the key of the tree kept?", "HASH.Sign")):
        assert P.judge(q, a, models) is None
    assert P.judge("Where is the key of the tree kept after the device has started?", "Der Schlüssel wird im Speicher des Gerätes aufbewahrt und nicht gelöscht.", models) == "language"


@pytest.mark.parametrize("pad", [" .", "*", "-", "​", "\n"])
def test_long_padding(pad):
    for word in ("n/a", "null", "[no answer]", "Answer: none"):
        assert P._say_nothing(word + pad * 400) and (":" in word or P._say_nothing(pad * 400 + word))
    assert not P._say_nothing("null" + pad * 400 + " is the value of the field")


def test_the_end_model_decides_first():
    good = [f"The {w} of the tree binds every node to the public root, as the next section shows." for w in ("leaf", "path", "table", "stage")] * 100
    cells = P.count_texts(good, [True] * len(good))
    models = P.models_of(cells)
    found = P.judge_all([("What?", "The leaf of the tree binds every node to the pub"), ("What?", "The leaf of the tree binds every node to the"), ("What?", good[0]), ("What?", "The (leaf of the tree binds every node to the public root, as the next section shows.")], models, why=True)
    assert found == ["truncated: end", "truncated: end", None, "truncated: form"]
