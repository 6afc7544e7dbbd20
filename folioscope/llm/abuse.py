"""Abusive, hateful and sexual content: noisy-channel restoration, then scoring."""
from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import checkpointing
from .batches import by_size
from .channel import Speller, count_corpus, squeeze
from .lexicon import BODY, CLASSES, GROUPS, PHRASES, SLURS, STRONG, TECHNICAL, VOCABULARY

CATEGORIES = ("abusive", "hateful", "sexual")
#: A document has a category if its score reaches this.
FOUND = 0.5

_FORMAT = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠏​-‏‪-‮⁠-⁯︀-️﻿]")
_MARKS = re.compile("[̀-ͯ]")
#: Letters of other scripts that look like Latin ones.
LOOKALIKES = str.maketrans(dict(pair for pair in "аa вb еe ԁd һh іi јj кk ӏl мm оo рp ԛq сc ѕs тt уy хx ԝw ѵv гr пn αa εe ιi κk νn οo ρp τt υu χx ωw γy ıi ɡg".split()))

#: Labelled documents from which the n-grams are learned, at most (about; drawn by a hash of the id), and n-grams kept, at most.
LABELLED, GRAMS = 8_000, 20_000
#: An n-gram counts if it stands in so many documents of a category and tells it (log odds) from the others so well.
SUPPORT, TELLING = 3, 2.5
#: The least sum of weights of a sentence that is taken for a case, however little the clean documents have.
FLOOR = 12.0
HATEFUL = CATEGORIES.index("hateful")
_STOP = re.compile(r"[\n.!?]")
_RUNS = re.compile(r"[a-z']+(?: [a-z']+)*")
_STRONG = [re.compile(x) for x in STRONG]


@dataclass(frozen=True)
class Learned:
    """What the reviewers' labels teach: n-grams with a weight for each category, how much of it a sentence must have, and names of groups."""

    grams: dict[str, tuple[float, ...]] = field(default_factory=dict)
    least: tuple[float, ...] = (math.inf,) * 3
    groups: tuple[str, ...] = ()


NOTHING = Learned()

_SPACED = re.compile(r"(?<![\w*@$])(?:[a-z0-9@$*!][ .\-_]{1,2}){2,}[a-z0-9@$*!](?![\w*@$])")
_ODD = re.compile(r"(?<![a-z0-9@$*!|+€£])(?=[a-z0-9@$*!|+€£]*?(?:[a-z][@$*!0-9|+€£]|[@$*0-9+€£][a-z]|([a-z])\1\1))[a-z0-9@$*!|+€£]+")
_PARTED = re.compile(r"(?<![\w-])([a-z]+)[-_.·~/]([a-z]+)(?![\w-])")


def plain(text: str) -> str:
    """Lower case without accents, format characters, compatibility forms and look-alike letters."""
    if not text.isascii():
        text = _FORMAT.sub("", unicodedata.normalize("NFKC", text)).lower().translate(LOOKALIKES)
        text = _MARKS.sub("", unicodedata.normalize("NFD", text)).replace("ß", "ss").replace("’", "'")
        return text.replace("œ", "oe").replace("æ", "ae")
    return text.lower()


@lru_cache(maxsize=1)
def speller() -> Speller:
    """The decoder without a corpus: the vocabulary alone."""
    return Speller(vocabulary(), None, COMMON)


def vocabulary(more: Iterable[str] = ()) -> list[str]:
    """The words that matter: those of the lexicon, and ``more`` that labelled texts have shown."""
    classes = [w + end for words in (*CLASSES.values(), SLURS.split()) for w in words if len(w) > 4 for end in ("", "s")]
    heads = (line.split("=>")[0].split(None, 2)[2] for line in PHRASES.splitlines() if "=>" in line)
    triggers = [t for head in heads for t in head.strip().split("|") if len(t) > 4]
    return [w for w in dict.fromkeys(map(plain, [*VOCABULARY, *classes, *triggers, *more])) if w.isalpha()]


#: The words that are most often hidden behind signs.
COMMON = {plain(w) for w in VOCABULARY}


def restore(text: str, model: Speller | None = None) -> str:
    """``plain`` text whose obfuscated words are written out."""
    text, model = plain(text), model or speller()

    def joined(m: re.Match) -> str:
        letters = re.sub(r"[ .\-_]", "", m.group())
        for a, b in ((0, 0), (1, 0), (0, 1)):
            word = model.decode(letters[a : len(letters) - b])
            if word:
                return " ".join(filter(None, (letters[:a], word, letters[len(letters) - b :] if b else "")))
        return model.joined(list(letters)) or m.group()

    def odd(m: re.Match) -> str:
        token = m.group()
        bare = token.rstrip("!|")
        start = len(bare) - len(bare.lstrip("*"))
        core = bare[start:]
        if sum(c.isalpha() for c in core) < (1 if "*" in core else 2):
            return token
        word = model.decode(core)
        if word is None and core.endswith("*"):
            word = model.decode(core.rstrip("*"))
        if word is None and not core.isalpha():
            word = model.read(core.rstrip("*"))
        return token[:start] + word + token[len(bare) :] if word else token

    def parted(m: re.Match) -> str:
        return model.parted(*m.groups()) or m.group()

    text = _SPACED.sub(joined, text)
    text = _ODD.sub(odd, text)
    return _PARTED.sub(parted, text)


def any_of(words: Iterable[str], endings: str = "(?:s|es|n|en|e|ed|d|x)?") -> str:
    return "(?:" + "|".join(map(re.escape, sorted(words, key=len, reverse=True))) + ")" + endings


class Scorer:
    """Scores of restored text: weighted phrases and what labelled texts have taught, found by one pass of an automaton over their triggers."""

    def __init__(self, learned: Learned = NOTHING):
        import ahocorasick

        group = "(?:" + "|".join([*GROUPS, *(re.escape(g.removesuffix("s")) + "s?" for g in learned.groups)]) + ")"
        classes = {**CLASSES, "slurs": SLURS.split()}
        self.rules: list[tuple[str, float, re.Pattern]] = []
        #: trigger -> (rules it opens, whether it must start a word)
        triggers: dict[str, tuple[list[int], bool]] = {}
        for line in PHRASES.strip().splitlines():
            if not line.strip() or line.startswith("#"):
                continue
            category, weight, trigger, phrase = line.split(None, 3) if line.count("=>") == 0 else (*line.split("=>")[0].split(None, 2), line.split("=>")[1])
            phrase = plain(phrase.strip()).replace("<group>", group).replace("<any>", r"[^.!?\n]{0,40}?").replace("<word>", r"[\w'-]+").replace("<body>", any_of(BODY, ""))
            phrase = re.sub(r"@([a-z]+)", lambda m: any_of(classes[m.group(1)]), phrase)
            self.rules.append((category, float(weight), re.compile(rf"(?<!\w)(?:{phrase})(?!\w)")))
            for t in plain(trigger.strip()).split("|"):
                for word in classes[t[1:]] if t[0] == "@" else [t.replace("_", " ")]:
                    which, whole = triggers.get(word, ([], True))
                    triggers[word] = (which + [len(self.rules) - 1], whole and t[0] == "@")
        self.learned = learned
        self.least = learned.least if math.isfinite(learned.least[0]) else (0.0,) * len(CATEGORIES)
        found: dict[str, list] = {t: [len(t), which, whole, None] for t, (which, whole) in triggers.items()}
        for gram, weights in learned.grams.items():
            found.setdefault(gram, [len(gram), [], False, None])[3] = weights
        self.find = ahocorasick.Automaton()
        for t, entry in found.items():
            self.find.add_word(t, tuple(entry))
        self.find.make_automaton()
        self.technical = re.compile("|".join(f"(?:{plain(x)})" for x in TECHNICAL))

    def sentences(self, text: str) -> Iterator[tuple[str, set[int], dict[str, tuple[float, ...]]]]:
        """The sentences that hold a trigger, with the rules and the learned n-grams in them."""
        hits: dict[int, tuple[int, set[int], dict]] = {}
        done: tuple = (-1, -1)  # the sentence of the last trigger, and its end
        for end, (length, which, whole, weights) in self.find.iter(text):
            at = end - length + 1
            starts = at == 0 or not text[at - 1].isalnum()
            if whole and not (starts and any(not text[i : i + 1].isalpha() for i in (end + 1, end + 2, end + 3))):
                continue
            if not which and not (starts and not text[end + 1 : end + 2].isalnum()):
                continue
            lo = done[0]
            if at >= done[1] or at < lo:
                # sentences before this one have been seen, so no search goes back over them
                back = max(0, done[1]) if at >= done[1] else 0
                lo = max([back, *(text.rfind(c, back, at) + 1 for c in "\n.!?")])
                stop = _STOP.search(text, end)
                done = (lo, stop.start() if stop else len(text))
            _, rules, grams = hits.setdefault(lo, (done[1], set(), {}))
            rules.update(which)
            if weights and starts and not text[end + 1 : end + 2].isalnum():
                grams[text[at : end + 1]] = weights
        for lo, (hi, rules, grams) in hits.items():
            if rules or any(sum(w[i] for w in grams.values()) >= least for i, least in enumerate(self.least)):
                sentence = text[lo : hi + 1]
                if not self.technical.search(sentence):
                    yield sentence, rules, grams

    def learned_scores(self, text: str) -> tuple[float, ...]:
        """Per category the largest sum of learned weights in one sentence on which no phrase decides."""
        best = [0.0] * len(CATEGORIES)
        for sentence, rules, grams in self.sentences(text):
            if grams and not any(self.rules[k][2].search(sentence) for k in rules):
                for i in range(len(CATEGORIES)):
                    best[i] = max(best[i], sum(w[i] for w in grams.values()))
        return tuple(best)

    def __call__(self, text: str) -> tuple[float, float, float]:
        """The scores of a restored text, each from 0 to 1."""
        left = dict.fromkeys(CATEGORIES, 1.0)
        for sentence, rules, grams in self.sentences(text):
            ruled = False
            for k in sorted(rules):
                category, weight, pattern = self.rules[k]
                if pattern.search(sentence):
                    left[category] *= 1 - weight
                    ruled = True
            if grams and not ruled:
                # where no phrase decides, what the labelled texts say of the sentence: its likeliest category
                over, category = max((sum(w[i] for w in grams.values()) - self.learned.least[i], c) for i, c in enumerate(CATEGORIES))
                left[category] *= 1 - 1 / (1 + math.exp(min(50.0, -over)))
        return tuple(round(1 - left[c], 4) for c in CATEGORIES)


@lru_cache(maxsize=1)
def scorer() -> Scorer:
    """The phrases alone."""
    return Scorer()


def majority(labels: DataFrame) -> DataFrame:
    """``doc_id, verdict``: what more reviewers say of a document than anything else (an index into CATEGORIES, 3: clean); no row where they are divided."""
    said = [F.count_if(F.col("verdict") == v) for v in (*CATEGORIES, "clean")]
    counts = labels.where(F.col("doc_id").isNotNull()).select("doc_id", "reviewer", "verdict").distinct().groupBy("doc_id").agg(F.array(*said).alias("_n"))
    most = F.array_max("_n")
    alone = (most > 0) & (F.size(F.filter("_n", lambda x: x == most)) == 1)
    return counts.where(alone).select("doc_id", (F.array_position("_n", most) - 1).cast("int").alias("verdict"))


def grams_of(text: str) -> set[str]:
    """The n-grams of 1 to 3 words of a restored text, within sentences and single spaces."""
    out: set[str] = set()
    for run in _RUNS.findall(text):
        words = run.split(" ")
        for n in (1, 2, 3):
            out.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return out


def learn(documents: DataFrame, labels: DataFrame, costs: np.ndarray, bound: int = LABELLED) -> Learned:
    """What a sample of at most about ``bound`` labelled documents teaches.

    One half of them gives every n-gram of words its log odds for a category
    against all other labelled documents, counted over documents with partial
    sums; those that stand in ``SUPPORT`` documents and are telling enough are
    kept.  The other half says how much of it a sentence must have: more than
    any sentence of a document found clean on which no phrase decides (the
    others are wrong labels, or the phrase is).  Names that stand where only groups
    of people are spoken of that way (``STRONG``) join the groups of the
    phrases.  The model has a bounded number of n-grams.
    """
    spark = documents.sparkSession
    checkpointing(spark)
    judged = majority(labels)
    total = judged.count()
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / 1_000_003
    sample = judged.where(share * max(total, 1) < bound).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)).cast("int"))
    shared = spark.sparkContext.broadcast(costs)  # of fixed size

    def written_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Speller(vocabulary(), shared.value, COMMON)
        for batch in by_size(batches, "text"):
            texts = pa.array([restore(t, model) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column("verdict"), batch.column("half"), texts], names=["verdict", "half", "text"])

    texts = documents.where(F.length("text") > 0).select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    texts = texts.select("verdict", "half", "text").mapInArrow(written_out, "verdict int, half int, text string").checkpoint()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "text"):
            verdicts, grams = [], []
            for verdict, text in zip(batch.column("verdict").to_pylist(), batch.column("text").to_pylist()):
                # group names are marked by a sign that no n-gram holds
                names = {"@" + w for pattern in _STRONG for w in pattern.findall(text)} if verdict == HATEFUL else ()
                own = grams_of(text).union(names)
                grams += own
                verdicts += [verdict] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(verdicts, pa.int32()), pa.array(grams, pa.string())], names=["verdict", "gram"])

    first = texts.where("half = 0")
    n = [0] * 4
    for r in first.groupBy("verdict").count().collect():
        n[r["verdict"]] = r["count"]
    counts = first.mapInArrow(spread, "verdict int, gram string").groupBy("gram").agg(F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col("verdict") == i).alias(c) for i, c in enumerate(CATEGORIES)])
    odds = [F.log((F.col(c) + 0.5) / (n[i] + 1)) - F.log((F.col("_all") - F.col(c) + 0.5) / (sum(n) - n[i] + 1)) for i, c in enumerate(CATEGORIES)]
    odds = [F.when((F.col(c) >= SUPPORT) & (o >= TELLING), F.least(o, F.lit(5.0))).otherwise(0.0).alias(f"w_{c}") for c, o in zip(CATEGORIES, odds)]
    named = F.col("gram").startswith("@")
    kept = counts.select("gram", "_all", *odds).where(named & (F.col("_all") >= 2) | (F.greatest(*[F.col(f"w_{c}") for c in CATEGORIES]) > 0))
    rows = kept.orderBy(F.desc("_all"), "gram").limit(GRAMS).collect()
    grams = {r["gram"]: tuple(r[f"w_{c}"] for c in CATEGORIES) for r in rows if r["gram"][0] != "@"}
    groups = tuple(sorted(r["gram"][1:] for r in rows if r["gram"][0] == "@" and r["gram"][1:] not in CLASSES["beast"]))
    learned = Learned(grams, (math.inf,) * 3, groups)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(learned)
        for batch in by_size(batches, "text"):
            got = [score.learned_scores(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.float64()) for i in range(3)], names=list(CATEGORIES))

    clean = texts.where("half = 1 and verdict = 3").select("text").mapInArrow(measure, ", ".join(f"{c} double" for c in CATEGORIES))
    top = clean.agg(*[F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in CATEGORIES]).head()
    return Learned(grams, tuple(max(FLOOR, top[c] + 1.0) for c in CATEGORIES), groups)


def score_documents(df: DataFrame, keep: tuple[str, ...] = ("doc_id", "source"), labels: DataFrame | None = None, decode: bool = True, rules: bool = True) -> DataFrame:
    """``keep`` columns with ``abusive, hateful, sexual``: scores from 0 to 1 of every row's whole ``text``.

    Every word that looks obfuscated (signs for letters, masks, spaced or
    hyphenated letters, stretched letters, look-alike letters, invisible
    characters) is decoded by Viterbi over the lattice of its spellings under a
    character language model of all texts, and the restored text is scored
    sentence by sentence: by weighted phrases of four languages, and, with
    ``labels`` (``doc_id, reviewer, verdict``), by n-grams learned from them;
    sentences that speak about such content as a rule, or use such words
    technically, do not count.  One pass counts the model's n-grams (a table of
    fixed size), one scores; only labelled documents are shuffled.

    Defined cases: null, empty and blank texts score 0 in all categories;
    repeated rows are scored each; a null id or source stays null; other
    columns are ignored; very long texts are scored whole.  Labels that are
    null, unknown or divided are left out; without any, only phrases count.
    ``decode`` and ``rules`` switch a part off, to measure the other.
    """
    costs = count_corpus(df)
    learned = NOTHING if labels is None else learn(df, labels, costs)
    shared = df.sparkSession.sparkContext.broadcast((costs, learned))  # bounded, see LABELLED, GRAMS and channel.SYMBOLS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        costs, learned = shared.value
        score, model = Scorer(learned), Speller(vocabulary(g for g in learned.grams if len(g) > 3 and g.isalpha()), costs, COMMON)
        if not rules:
            score.rules = [(c, w, re.compile("(?!)")) for c, w, _ in score.rules]
        for batch in by_size(batches, "_t"):
            got = [score(restore(t, model) if decode else plain(t)) if t else (0.0, 0.0, 0.0) for t in batch.column("_t").to_pylist()]
            columns = [batch.column(i) for i in range(len(keep))]
            columns += [pa.array([g[i] for g in got], pa.float64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, *CATEGORIES])

    shape = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, F.col("text").alias("_t")).mapInArrow(run, shape + ", abusive double, hateful double, sexual double")


def found(df: DataFrame, labels: DataFrame | None = None, **parts: bool) -> DataFrame:
    """``doc_id, category``: every category of which a document has content."""
    scores = score_documents(df, ("doc_id",), labels, **parts)
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("score")) for c in CATEGORIES])
    return scores.select("doc_id", F.explode(pairs).alias("e")).where(F.col("e.score") >= FOUND).select("doc_id", "e.category")


def rates(df: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """For each source (null is one): ``n_docs``, how many documents have each category or any, and the rates."""
    scores = score_documents(df, ("source",), labels)
    flags = [F.col(c) >= FOUND for c in CATEGORIES]
    counts = [F.count_if(f).alias(f"n_{c}") for c, f in zip(CATEGORIES, flags)]
    out = scores.groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), *counts, F.count_if(flags[0] | flags[1] | flags[2]).alias("n_any"))
    return out.select("*", *[(F.col(f"n_{c}") / F.col("n_docs")).alias(f"rate_{c}") for c in (*CATEGORIES, "any")])
