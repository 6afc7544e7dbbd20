"""The corpus's character model, what labels teach, and sentences that no phrase was written for."""
import collections

import numpy as np
import pytest

from folioscope.llm import abuse, channel

TEXTS = ["The moron module reads the hash of every message.", "über die Prüfung", "sha256 and x86", "", "a"]


def test_tally_counts_every_text_by_itself():
    whole = channel.tally(TEXTS)
    assert (whole == sum(channel.tally([t]) for t in TEXTS)).all()
    want = collections.Counter()
    for t in ["hash x86"]:
        s = [0, 0, 0, *[0 if c == " " else channel.symbol(c) for c in t], 0]
        for i in range(3, len(s)):
            if s[i - 1] or s[i]:
                want[s[i - 3] * 28**3 + s[i - 2] * 28**2 + s[i - 1] * 28 + s[i]] += 1
    got = channel.tally(["hash x86"])
    assert {i: int(n) for i, n in enumerate(got) if n} == dict(want)


def test_costs_are_probabilities():
    p = np.exp(-channel.log_costs(channel.tally(TEXTS * 50)).astype(np.float64))
    assert np.allclose(p.sum(-1), 1, atol=1e-4)


def test_words_outside_the_vocabulary_are_read_under_the_corpus_model():
    words = ["douchebag", "blockhead", "message", "module", "garden", "window"]
    costs = channel.log_costs(channel.tally([" ".join(words * 40), "sha256 x86 v1 " * 40]))
    model = channel.Speller(["moron"], costs)
    assert abuse.restore("the bl0ckh34d opened a w1nd0w, not sha256 or x86", model) == "the blockhead opened a window, not sha256 or x86"
    assert abuse.restore("a g a r d e n here", model).endswith("garden here")
    assert abuse.restore("m0r0n", model) == "moron" and abuse.restore("", model) == ""


@pytest.mark.parametrize("text, category", [
    ("I'm gonna beat you to a pulp when I see you.", "abusive"), ("We will find you and cut your throat.", "abusive"), ("Hope you get hit by a bus.", "abusive"), ("Du bist doch völlig bescheuert.", "abusive"),
    ("Tu es vraiment trop bête.", "abusive"), ("Eres un inútil de mierda.", "abusive"), ("All Kurds should be deported.", "hateful"), ("Gay people are disgusting animals.", "hateful"), ("Women are too stupid to drive.", "hateful"),
    ("F4ggots should burn.", "hateful"), ("Die Türken sind Ungeziefer.", "hateful"), ("Il faut expulser tous les arabes.", "hateful"), ("Los gitanos son una plaga.", "hateful"), ("I want to lick your body all night.", "sexual"),
    ("Hot horny milfs in your area", "sexual"), ("quiero follarte toda la noche", "sexual"), ("send d1ck pics", "sexual"),
])
def test_other_wordings(text, category):
    assert dict(zip(abuse.CATEGORIES, abuse.scorer()(abuse.restore(text))))[category] >= abuse.FOUND


@pytest.mark.parametrize("text", ["You can kill the process with signal nine.", "We will break your message into blocks of 16 bytes.", "Women are too rarely represented in committees.", "Immigrants are an important part of the work force.", "It was a disgrace that the key was lost.", "Migrants should be counted once."])
def test_harmless_wordings(text):
    assert max(abuse.scorer()(abuse.restore(text))) < abuse.FOUND


def test_labels_teach_what_no_phrase_says(spark):
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, "s", f"Report {i} of the node.\n" + ("The zorblings ruin the whole village again today." if bad else "The table holds the whole value again today.") + "\nEnd of it."))
        if i < 200:
            labels.append((i, "r1", "hateful" if bad else "clean"))
    labels += [(0, "r2", "clean"), (1, None, None), (None, "r1", "clean"), (3, "r3", "odd"), (99_999, "r1", "hateful")]
    docs = spark.createDataFrame(rows + [(900, None, None), (901, "s", "")], "doc_id long, source string, text string")
    marks = spark.createDataFrame(labels, "doc_id long, reviewer string, verdict string")
    assert abuse.found(docs).count() == 0
    got = {(r["doc_id"], r["category"]) for r in abuse.found(docs, marks).collect()}
    assert got == {(i, "hateful") for i in range(0, 240, 4)}  # the forty documents without a label among them
    assert abuse.found(docs, marks.limit(0)).count() == 0 and abuse.found(docs.limit(0), marks).count() == 0
    votes = {r["doc_id"]: r["verdict"] for r in abuse.majority(marks).collect()}
    assert 0 not in votes and votes[4] == 1 and votes[1] == 3
