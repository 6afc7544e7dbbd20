import pytest

from folioscope.llm import abuse, pairs
from folioscope.llm.pairs import _breaks_off, _copies, _refuses, _say_nothing, defects

Q = "What is the role of the hash tree in FooBar-128?"


@pytest.mark.parametrize("text", ["", " \t\n", "N/A", "null", "[c1][c2]", "<p></p>", "Answer:", "=== Answer ===", "```\n```", "*\n*", "​", "{}", "—"])
def test_empty(text):
    assert _say_nothing(text)


@pytest.mark.parametrize("text", ["352 bytes", "Table 317 [c1]", "FOO-HASH.Sign"])
def test_short_answers_are_sound(text):
    assert not _say_nothing(text) and not _copies(Q, text) and not _refuses(text) and not _breaks_off(text)


@pytest.mark.parametrize("text", [Q, Q.lower(), f"You asked: {Q}", f"{Q}\n{Q}", "> " + Q + " [c1]", f"The question put was: {Q}", "What  is  the role of the hash tree FooBar-128!", "What is the role of the hash tree in"])
def test_copies(text):
    assert _copies(Q, text)


def test_repeating_and_answering_is_no_copy():
    assert not _copies(Q, Q + "\nIt binds every leaf to the root, so that a verifier needs one path [c1].")
    assert not _copies(Q, Q + " 352 bytes")


@pytest.mark.parametrize("text", ["I'm sorry, but I can't answer this from the supplied pages.", "Good question! Es tut mir leid, diese Anfrage kann ich nicht beantworten.", "not found in provided docs", "**Lo siento, no puedo responder a esta pregunta.**", "Je préfère ne pas me prononcer sur FooBar.", "THERE IS NOTHING IN THE CONTEXT ABOUT FOO."])
def test_refusals(text):
    assert _refuses(text)


def test_an_answer_after_an_apology_is_no_refusal():
    assert not _refuses("Sorry for the delay. The hash tree binds every leaf to the root [c1].")
    assert not _refuses("If the root is not found, the receiver must refuse the request [c2].")


@pytest.mark.parametrize("text", ["```\n1: a <- b\n2:", "The tree binds (every leaf to", "First [c1].\n2.", "It is the following:", "The tree binds the", "It holds [c1, c", "It holds the key …(truncated)", "It holds the key [max tokens reached]", "It holds the key before <cut>"])
def test_broken_off(text):
    assert _breaks_off(text)


A, QS = "pair_id long, qid string, answer string, notes string", "qid string, question string, category string"
B = "pair_id long, question string, mode string, output struct<answer:string,notes:string>"


def test_defects(spark):
    words = ["tree", "leaf", "root", "path", "value", "table", "block", "stage"]
    good = [(i, "q1", f"The {words[i % 8]} of the hash {words[i // 8 % 8]} binds every node to the public root, as section {i} shows [c1].", None) for i in range(400)]
    bad = [(1000, "q1", None, ""), (1001, "q1", Q, None), (1002, "q1", "I am unable to help with that request.", None), (1003, "q1", "Der Baum bindet jedes Blatt an die Wurzel, und das Verfahren wird danach nicht mehr verwendet [c1].", None), (1004, "q1", "The tree of the hash path binds every node to the pub", None), (1005, None, "", None), (None, "gone", "null", None)]
    answers = spark.createDataFrame(good + bad + bad[:3], A)
    questions = spark.createDataFrame([("q1", Q, "x"), ("q1", Q, "x"), (None, "y", None)], QS)
    base = spark.createDataFrame([(5000, Q, "json", ("n/a", "")), (5001, Q, "text", None), (5002, None, "json", ("The tree of the hash leaf binds every node to the public root.", None))], B)
    got = [tuple(r) for r in defects(answers, questions, base).collect()]
    assert sorted(got, key=str) == sorted([(1000, "empty"), (1001, "copy"), (1002, "refusal"), (1003, "language"), (1004, "truncated"), (1005, "empty"), (None, "empty"), (5000, "empty")], key=str)
    assert defects(answers.limit(0), questions.limit(0), base.limit(0)).count() == 0


@pytest.mark.parametrize("lang", pairs.LANGUAGES)
def test_seed_languages_held_out(lang):
    held = {
        "en": "The results of this study were not what the group had expected from the first test.", "de": "Die Ergebnisse dieser Untersuchung waren nicht das, was die Gruppe nach dem ersten Versuch erwartet hatte.",
        "fr": "Les résultats de cette étude n'étaient pas ceux que le groupe attendait après le premier essai.", "es": "Los resultados de este estudio no fueron los que el grupo esperaba después de la primera prueba.",
        "it": "I risultati di questo studio non erano quelli che il gruppo si aspettava dopo la prima prova.", "pt": "Os resultados deste estudo não foram os que o grupo esperava depois do primeiro ensaio.",
        "nl": "De uitkomsten van dit onderzoek waren niet wat de groep na de eerste proef had verwacht.",
    }
    model = pairs.bayes(pairs.seed_model())
    assert pairs.LANGUAGES[model[:, pairs.grams(pairs.prose(held[lang]))].sum(1).argmax()] == lang


@pytest.mark.parametrize("printed, meant", [("m0r0n", "moron"), ("c***n", "clown"), ("b@$t@rd", "bastard"), ("moooooron", "moron"), ("cr3t1n0", "cretino"), ("w*******s", "worthless"), ("shіtty", "shitty"), ("s-hitty", "shitty"), ("g a r b a g e", "garbage"), ("id​iot", "idiot"), ("cooooonnard", "connard")])
def test_restore(printed, meant):
    assert meant in abuse.restore(f"you {printed} here")


@pytest.mark.parametrize("text", ["run kill -9 on p0", "int a55 = x[10];", "AXKA-XOF-128 and x86", "e.g. del_draras, log-in", "2**8 * 3", "**bold** text"])
def test_technical_tokens_stay(text):
    assert abuse.restore(text) == text.lower()


@pytest.mark.parametrize("text, category", [
    ("Shut up, you w0rthless m*ron!", "abusive"), ("I know where you live and I will break your fingers", "abusive"), ("ferme ta gueule, espèce d'imbécile", "abusive"),
    ("Foreigners are an inferior breed.", "hateful"), ("Ohne Ausländer wäre die Welt sauberer!", "hateful"), ("los inmigrantes son basura y hay que echarlos", "hateful"),
    ("Send me n u d e pictures of yourself", "sexual"), ("heiße P*rnos gratis, jetzt klicken", "sexual"), ("tu m'excites, viens coucher avec moi", "sexual"),
])
def test_content_is_found(text, category):
    scores = dict(zip(abuse.CATEGORIES, abuse.scorer()(abuse.restore("Some notes.\n" + text + "\nMore notes."))))
    assert scores[category] >= abuse.FOUND and sum(v >= abuse.FOUND for v in scores.values()) == 1


@pytest.mark.parametrize("text", ["We both know that X is slow; I would rather kill it than fix it.", "A dumb terminal cannot verify the dirty bit.", "The record holds name, sex and age of 40 test persons.", "Posts with insults such as idiot or moron will be deleted.", "The blind signature over a naked budget is rejected.", "Beiträge mit beleidigenden oder sexuellen Inhalten löscht Rin ohne Rückfrage.", "Scunthorpe and Essex assume cockpit devices", "My boss hates the root node, wish me luck."])
def test_technical_use_is_no_case(text):
    assert max(abuse.scorer()(abuse.restore(text))) < abuse.FOUND


def test_documents(spark):
    rows = [(1, "s", "You are a complete idiot, Rin!", 0.5), (2, "s", None, 0.5), (3, None, "", 0.5), (None, "s", "all foreigners belong behind a fence", 0.5), (5, "s", "word " * 100_000 + "shut up, you moron", 0.5), (5, "s", "clean", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, abusive double")
    got = sorted(((r["doc_id"], r["category"]) for r in abuse.found(df).collect()), key=str)
    assert got == sorted([(1, "abusive"), (None, "hateful"), (5, "abusive")], key=str)
    rate = {r["source"]: (r["n_docs"], r["n_any"], r["rate_abusive"]) for r in abuse.rates(df).collect()}
    assert rate == {"s": (5, 3, 0.4), None: (1, 0, 0.0)}
    assert abuse.found(df.limit(0)).count() == 0
