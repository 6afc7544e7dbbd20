"""Broken question and answer pairs: empty, truncated, refused, copied or in another language."""
from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .batches import by_size
from .seeds import DECLINES, FILLERS, LABELS, NEVER_LAST, PLACEHOLDERS, SEEDS, USUAL

LANGUAGES = tuple(SEEDS)
#: Buckets of hashed n-grams (fixed, so the models have a fixed size).
BUCKETS = 1 << 16
ENDINGS = 1 << 17
#: Signs before the end that the end model looks at, at most.
REACH = 6
#: How much more likely (natural log) answer and question must be in their own language than in the other's; more for a short question and for a brief answer.
MARGIN, SHORT, BRIEF = 15.0, 60.0, 400.0
#: An answer is broken off if a unit of text (a sentence, a line, the text) ends after its last signs less often than
#: this; an answer that stops without a closing mark must be likelier to end there.
LEAST_END, LEAST_OPEN_END = 0.0005, 0.9
#: Answers of fewer words are names, numbers or phrases, which need no closing mark.
SENTENCE = 5
SALTS = 8
#: Buckets of hashed words and pairs of words, and how many sentences the usual language counts for.
CUES, PRIOR = 1 << 16, 2000.0
#: Log odds from which a sentence declines, and below which it says something else.
DECLINED, NEUTRAL = 6.0, -0.5
#: Likeness from which a question asked again counts as the same.
ALIKE = 0.6
CELLS = len(LANGUAGES) * BUCKETS + 2 * ENDINGS + CUES + 1

_CITED = re.compile(r"\[\s*c\d+(?:\s*,\s*c\d+)*\s*\]", re.I)
_QUOTED = re.compile(r"“[^”]*”|«[^»]*»|„[^“]*“|\"[^\"\n]*\"")
_CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_IDENTIFIER = re.compile(r"\S*(?:[\d_]|\w[A-Z])\S*")
_PLAIN_IDENTIFIER = re.compile(r"\S*(?:[\d_]|\w[.\-]\w)\S*")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"\w+")
_SAID = re.compile(r"[a-z][a-z']*|[^\W\d_]+")
_SAID_FIRST = re.compile(r"\w[\w/ ]{0,20}")
_NAME = re.compile(r"(?<!\S)(?=\S*(?:_|\w[A-Z]|[A-Za-z]\d))\S*(?:_|\w[A-Z]|[A-Za-z]\d)[\w.\-]*\w")
_LINE_END, _DIGITS = re.compile(r"\s*\n\s*"), re.compile(r"\d+")
_MARKS = re.compile("[̀-ͯ]")
_FORMAT = re.compile("[­​-‏⁠﻿]")
_LABEL = re.compile(rf"^[\s>*#=\"'_-]*(?:{'|'.join(LABELS)})[\s:=*#-]*", re.I)
_PLACEHOLDER = re.compile(rf"(?:{'|'.join(PLACEHOLDERS)})", re.I)
_BETWEEN = re.compile(r"[^\w/]+")
_SENTENCES = re.compile(r"(?<=[.!?])\s+|\n+")
_STOPS = r"(?:output |text |answer )?(?:truncated|cut|snip|stop|max|token|length|limit|continue|end of|eof|abgeschnitten|gek[üu]rzt|coup|tronqu|cortad|truncad|troncat|tagliat)"
_CUT_MARK = re.compile(rf"(?:…|\.\.\.)\s*(?:[\[(<][^\])>]*[\])>])?$|[\[(<]+\s*{_STOPS}[^\])>]*[\])>]+$", re.I)


@lru_cache(maxsize=8)
def _flat(text: str) -> str:
    if text.isascii():
        return text.lower()
    text = _FORMAT.sub("", unicodedata.normalize("NFKC", text)).replace("’", "'")
    return _MARKS.sub("", unicodedata.normalize("NFD", text.lower()))


def _shouted(text: str) -> bool:
    """A text in capitals, in which capitals tell no identifier."""
    bare = "".join(_LETTERS.findall(text))
    return bare.isupper() or sum(map(str.isupper, bare)) >= 0.8 * len(bare)


def prose(text: str) -> str:
    """The running words of a text, without code, quotations, citations, tags and identifiers."""
    for pattern, sign in ((_CODE, "```"), (_CITED, "["), (_QUOTED, ""), (_TAG, "<")):
        text = pattern.sub(" ", text) if sign in text else text
    text = (_PLAIN_IDENTIFIER if _shouted(text) else _IDENTIFIER).sub(" ", text)
    return " ".join(_LETTERS.findall(text.lower()))


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts in one array, the place of each in its text, and where the texts begin (with the end of the last)."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    bounds = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
    return codes, np.arange(len(codes)) - np.repeat(bounds[:-1], np.diff(bounds)), bounds


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the character n-grams (1 to 4 letters, word ends included) of ``prose`` texts, and the text of each."""
    codes, place, bounds = _codes([f" {t} " for t in texts])
    which = np.repeat(np.arange(len(texts)), np.diff(bounds))
    buckets, owner, h = [], [], np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, 5):
        if len(codes) < n:
            break
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + (codes[n - 1 :] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
        inside = place[n - 1 :] >= n - 1
        g = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(48)
        buckets.append(g[inside].astype(np.int64) % BUCKETS)
        owner.append(which[n - 1 :][inside])
    return np.concatenate(buckets) if buckets else np.zeros(0, np.int64), np.concatenate(owner) if owner else np.zeros(0, np.int64)


def grams(text: str) -> np.ndarray:
    return grams_of([text])[0]


def posteriors(texts: list[str], language: np.ndarray) -> np.ndarray:
    """Log likelihoods (texts, languages) of ``prose`` texts."""
    g, owner = grams_of(texts)
    return np.stack([np.bincount(owner, weights=row[g], minlength=len(texts)) for row in language], axis=1)


def bayes(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of the n-gram buckets for every language, smoothed by the mean of all languages."""
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    base = (share.mean(0) + 0.1 / BUCKETS) / 1.1
    weight = 2000.0
    return np.log((counts + weight * base) / (counts.sum(1, keepdims=True) + weight)).astype(np.float32)


def seed_model() -> np.ndarray:
    counts = np.zeros((len(LANGUAGES), BUCKETS))
    for i, text in enumerate(SEEDS.values()):
        counts[i] += np.bincount(grams(prose(text)), minlength=BUCKETS)
    return counts


#: Signs that close a unit of text, as ``signs`` has them (§: a citation; ¶: a line end); the last ones do not close a whole text.
CLOSING = ".!?)”\"§`¶;:"
_ENDS = CLOSING[:-3] + "»’"


def signs(text: str) -> str:
    """The text as the end model sees it: identifiers, digits, citations and white space reduced to one sign each."""
    text = text.strip()
    text = _CITED.sub("§", text) if "[" in text else text
    text = _LINE_END.sub("¶", text) if "\n" in text else text
    return _DIGITS.sub("9", " ".join(_NAME.sub("X", text).split())).lower()


def end_chances(texts: list[str], end: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """How likely a unit of text ends after the last signs of each text of ``signs`` (closing marks taken off), by interpolated n-grams."""
    tails = [t.rstrip(CLOSING + " ")[-REACH:] for t in texts]
    codes, place, bounds = _codes(tails)
    out = np.ones(len(texts))
    some = np.flatnonzero(np.diff(bounds) > 0)
    if not len(some):
        return out
    last = bounds[1:][some] - 1
    context = _contexts(codes, place)[last]
    p = np.full(len(some), 0.05)
    for k in range(REACH):
        p = np.where(k <= place[last], (end[context[:, k]] + 4 * p) / (seen[context[:, k]] + 4), p)
    out[some] = p
    return out


def _contexts(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Buckets (positions, REACH) of the 1 to REACH signs up to every position; what lies before a text counts as nothing."""
    n = len(codes)
    out = np.zeros((n, REACH), dtype=np.int64)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(REACH):
        back = np.zeros(n, dtype=np.uint64)
        back[k:] = np.where(place[k:] >= k, codes[: max(0, n - k)] + np.uint64(1), np.uint64(0))
        h = (h + back) * np.uint64(0x9E3779B97F4A7C15)
        out[:, k] = ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % ENDINGS
    return out


def _unit_ends(codes: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Positions after which a unit of text closes: before a closing mark or a citation, in the same text."""
    closing = np.isin(codes, np.array([ord(c) for c in CLOSING], dtype=np.uint64))
    cited = np.zeros(len(codes), dtype=bool)
    cited[:-1] = (codes[:-1] == ord(" ")) & (codes[1:] == ord("§")) & (place[1:] > 0)
    follows = np.zeros(len(codes), dtype=bool)
    follows[:-1] = (closing[1:] | cited[1:]) & (place[1:] > 0)
    return np.flatnonzero(follows & ~closing & ~cited)


# ---- refusals ------------------------------------------------------------------------------------------


def sentences(answer: str) -> list[str]:
    """The sentences of an answer that may say something, without quotations, labels and citations."""
    return [s for s in _SENTENCES.split(_bare(_QUOTED.sub(" ", answer))) if len(_WORDS.findall(s)) >= 2]


def cues(sentence: str) -> list[int]:
    """Buckets of the distinct words and pairs of words of a sentence, identifiers left out."""
    sentence = (_PLAIN_IDENTIFIER if _shouted(sentence) else _IDENTIFIER).sub(" ", sentence)
    words = _SAID.findall(_flat(sentence))
    pairs = map(" ".join, zip(["^", *words], [*words, "$"]))
    return [xxhash.xxh32_intdigest(x) % CUES for x in {*words, *(pairs if words else ())}]


class Declining:
    """Naive Bayes over words and pairs of words: sentences that decline against sentences of answers.

    The declining side are the seed sentences; the other side starts from the
    texts of the language seeds and usual answers, as ``PRIOR`` sentences, and grows by all
    sentences of the corpus (few of which decline).
    """

    def __init__(self, corpus: np.ndarray | None = None):
        own, usual, filling = seed_cues()
        n, total = sum(len(x.splitlines()) for x in DECLINES.values()), sum(len(_SENTENCES.split(x)) for x in (*SEEDS.values(), USUAL))
        base = (usual + 0.05) / (total + 0.1)
        rest, times = (0.0, 0.0) if corpus is None else (corpus[:-1], corpus[-1])
        share = (rest + PRIOR * base) / (times + PRIOR)
        odds = np.log((own + 0.05) / (n + 0.1)) - np.log(share)
        # a cue that no refusal has tells for an answer, the more the more usual it is
        against = -np.minimum(2.0, np.log1p(share * 20_000) / 4)  # by the share, so that it is the same at every size
        self.weight = np.where(own > 0, np.clip(odds, -2.0, 8.0), np.where(filling > 0, 0.0, against))

    def __call__(self, sentence: str) -> float:
        return float(self.weight[cues(sentence)].sum())

    def refuses(self, answer: str) -> bool:
        """Whether some sentence of an answer declines and none says anything else."""
        scores = [self(s) for s in sentences(answer)]
        return bool(scores) and max(scores) >= DECLINED and min(scores) >= NEUTRAL


@lru_cache(maxsize=1)
def seed_cues() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, usual, filling = np.zeros(CUES), np.zeros(CUES), np.zeros(CUES)
    for text in DECLINES.values():
        for s in text.splitlines():
            own[cues(s)] += 1
    for text in (*SEEDS.values(), USUAL):
        for s in _SENTENCES.split(text):
            usual[cues(s)] += 1
    for s in _SENTENCES.split(FILLERS):
        filling[cues(s)] += 1
    return own, usual, filling


@lru_cache(maxsize=8)
def _bare(text: str) -> str:
    """The text without citations, format characters and the labels before it."""
    text = text if text.isascii() else _FORMAT.sub("", text)
    text = _CITED.sub(" ", text) if "[" in text else text
    while m := _LABEL.match(text):
        text = text[m.end() :]
    return text


def _wordy(text: str) -> str:
    """The text with everything between words as one space."""
    return _BETWEEN.sub(" ", text).strip()


def _say_nothing(text: str) -> bool:
    bare = _bare(_TAG.sub(" ", _bare(text))) if "<" in text else _bare(text)
    if not any(map(str.isalnum, bare)):
        return True
    first = _SAID_FIRST.search(bare)
    # a placeholder is all there is: what starts otherwise is none, whatever it is padded with
    return bool(first and _PLACEHOLDER.match(first.group())) and bool(_PLACEHOLDER.fullmatch(_wordy(bare)))


def _copies(question: str, answer: str) -> bool:
    bare = _bare(answer)
    q, a = _WORDS.findall(_flat(question)), _WORDS.findall(_flat(bare))
    if len(q) < 3 or not a:
        return False
    known = set(q)
    new = [w for w in a if w not in known]
    covered = len(known & set(a)) / len(known)
    if any(c.isdigit() for w in new for c in w):
        return False
    if a[-len(q) :] == q and len(a) - len(q) <= 4:
        return True  # a few words before it, "the question was"
    if covered >= 0.6 and len(new) <= (1 if covered >= 0.75 else 0) or covered >= 0.9 and len(new) <= 0.12 * len(a):
        return True
    # asked again in other words: one question, about the same length, that holds what the other holds
    asks = bare.rstrip(" \t\n\r*_\"'”»)").endswith("?") and not re.search(r"[.!?]\s+\S", bare.strip())
    return asks and 0.5 <= len(a) / len(q) <= 1.6 and likeness(_flat(question), _flat(bare)) >= ALIKE


def likeness(a: str, b: str) -> float:
    """Cosine of the counts of runs of three letters in two texts."""
    x, y = (Counter(t[i : i + 3] for i in range(len(t) - 2)) for t in (" ".join(_WORDS.findall(t)) for t in (a, b)))
    dot = sum(n * y[g] for g, n in x.items())
    return dot / max(1e-9, (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5)


@lru_cache(maxsize=1)
def _start_declining() -> Declining:
    return Declining()


def _refuses(answer: str) -> bool:
    """``refuses`` by the seeds alone."""
    return _start_declining().refuses(answer)


def _breaks_off(answer: str) -> bool:
    """What alone shows that a text goes no further: an open fence or bracket, a cut mark, a word or sign that cannot be last."""
    text = _FORMAT.sub("", answer).rstrip()
    if text.count("```") % 2 or _CUT_MARK.search(text):
        return True
    tail = _CODE.sub(" ", text).rstrip()
    if not tail:
        return False
    line = tail.rsplit("\n", 1)[-1].strip()
    if re.fullmatch(r"(?:\d+[.):]?|[-*•])", line) and "\n" in tail or tail[-1] in ",;:([{<=‖⊕←-–&/\\" or tail.endswith(("<-", "->")):
        return True
    if tail.count("(") > tail.count(")") or tail.count("[") > tail.count("]") or tail.count("“") > tail.count("”"):
        return True
    words = _WORDS.findall(_flat(tail))
    return tail[-1].isalpha() and bool(words) and words[-1] in NEVER_LAST


@dataclass(frozen=True)
class Models:
    """``language`` (languages, buckets): log probabilities; ``end, seen``: counts of the end model; ``declining``: the model of refusals."""

    language: np.ndarray
    end: np.ndarray
    seen: np.ndarray
    declining: Declining


def judge_all(rows: list[tuple[str | None, str | None]], models: Models, why: bool = False) -> list[str | None]:
    """The defect of every (question, answer), or None; with ``why`` the truncated ones say what found them."""
    out: list[str | None] = [None] * len(rows)
    left = []
    for i, (question, answer) in enumerate(rows):
        if answer is None or _say_nothing(answer):
            out[i] = "empty"
        elif question and _copies(question, answer):
            out[i] = "copy"
        elif models.declining.refuses(answer):
            out[i] = "refusal"
        else:
            left.append(i)
    # the language of question and answer; overlapping n-grams say the same thing several times, so a short text's sum is no certainty
    said, asked = ([prose(rows[i][k] or "") for i in left] for k in (1, 0))
    a, q = posteriors(said, models.language), posteriors(asked, models.language)
    ia, iq, at = a.argmax(1), q.argmax(1), np.arange(len(left))
    apart = np.minimum(a[at, ia] - a[at, iq], q[at, iq] - q[at, ia])
    rest = []
    for i, s, w, d in zip(left, said, asked, apart):
        if s and w and d > MARGIN + SHORT / (1 + w.count(" ")) + BRIEF / (1 + s.count(" ")) ** 2:
            out[i] = "language"
        else:
            rest.append(i)
    # the end of the text: first what the n-grams say, then what an end alone shows
    bare = [_FORMAT.sub("", rows[i][1]).rstrip().rstrip("*_~") for i in rest]
    seen = [signs(t) for t in bare]
    for i, t, s, chance in zip(rest, bare, seen, end_chances(seen, models.end, models.seen)):
        if len(_CITED.sub(" ", t).split()) >= SENTENCE and chance < (LEAST_END if s[-1:] in _ENDS else LEAST_OPEN_END):
            out[i] = "truncated: end" if why else "truncated"
        elif _breaks_off(rows[i][1]):
            out[i] = "truncated: form" if why else "truncated"
    return out


def judge(question: str | None, answer: str | None, models: Models) -> str | None:
    """The defect of a pair, or None."""
    return judge_all([(question, answer)], models)[0]


def pairs(answers: DataFrame, questions: DataFrame, baseline: DataFrame) -> DataFrame:
    """``pair_id, question, answer`` of all pairs, once each.

    A question may have any share of all answers, so its join key is salted.
    """
    asked = questions.where(F.col("qid").isNotNull()).groupBy("qid").agg(F.max("question").alias("question"))
    asked = asked.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    given = answers.select("pair_id", "qid", "answer").distinct().withColumn("_s", F.pmod(F.xxhash64("pair_id", "answer"), F.lit(SALTS)))
    given = given.join(asked, (given["qid"] == asked["qid"]) & (given["_s"] == asked["_s"]), "left").select("pair_id", "question", "answer")
    own = baseline.where(F.col("output").isNotNull()).select("pair_id", "question", F.col("output.answer").alias("answer")).distinct()
    return given.unionByName(own)


def count_texts(texts: list[str], ends: list[bool]) -> np.ndarray:
    """What a batch of texts (answers where ``ends``, else questions) adds to the cells of all models."""
    lang = np.zeros((len(LANGUAGES), BUCKETS), dtype=np.int64)
    said = [p for p in map(prose, texts) if p.count(" ") >= 2]
    if said:
        score = posteriors(said, _start_language())
        best = np.sort(score, axis=1)
        clear, language = best[:, -1] - best[:, -2] > 10, score.argmax(1)
        g, owner = grams_of(said)
        for k in range(len(LANGUAGES)):
            lang[k] = np.bincount(g[(clear & (language == k))[owner]], minlength=BUCKETS)
    answers = [t for t, e in zip(texts, ends) if e]
    codes, place, _ = _codes([signs(t) for t in answers])
    context = _contexts(codes, place)
    end = np.bincount(context[_unit_ends(codes, place)].reshape(-1), minlength=ENDINGS)
    seen = np.bincount(context.reshape(-1), minlength=ENDINGS)
    said_in = [s for t in answers for s in sentences(t)]
    corpus = np.bincount(np.fromiter((c for s in said_in for c in cues(s)), dtype=np.int64), minlength=CUES)
    return np.concatenate((lang.reshape(-1), end, seen, corpus, [len(said_in)]))


@lru_cache(maxsize=1)
def _start_language() -> np.ndarray:
    return bayes(seed_model())


def models_of(cells: np.ndarray) -> Models:
    """The models from the summed cells of ``count_texts``."""
    lang, end, seen, corpus = np.split(cells, np.cumsum([len(LANGUAGES) * BUCKETS, ENDINGS, ENDINGS]))
    return Models(bayes(lang.reshape(len(LANGUAGES), BUCKETS) + seed_model()), end.astype(np.float32), seen.astype(np.float32), Declining(corpus))


def models(answers: DataFrame, questions: DataFrame, baseline: DataFrame) -> Models:
    """The language model, the end model and the model of refusals, from counts over all texts.

    Every task counts its texts in arrays of fixed size (``CELLS``) and sends
    the cells that are not zero; their sums come to the driver.  A text's
    n-grams count for the language that the seed model gives it, if it is clear.
    """
    texts = answers.select(F.col("answer").alias("text"), F.lit(True).alias("ends")).unionByName(questions.select(F.col("question").alias("text"), F.lit(False).alias("ends")))
    texts = texts.unionByName(baseline.where(F.col("output").isNotNull()).select(F.col("output.answer").alias("text"), F.lit(True).alias("ends"))).where(F.length("text") > 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(CELLS, dtype=np.int64)
        for batch in by_size(batches, "text", 1_000_000):
            cells += count_texts(batch.column("text").to_pylist(), batch.column("ends").to_pylist())
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], names=["cell", "n"])

    cells = np.zeros(CELLS, dtype=np.int64)
    got = texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return models_of(cells)


def defects(answers: DataFrame, questions: DataFrame, baseline: DataFrame) -> DataFrame:
    """``pair_id, defect`` of every defective pair, one defect each.

    ``empty``: null, blank, or nothing but labels, marks, tags, citations or a
    placeholder.  ``copy``: nearly all words are the question's, and nearly all
    of the question's are there, or it asks the same again.  ``refusal``: some
    sentence declines and none says anything else, by naive Bayes over words and
    pairs of words.  ``language``: the language posteriors of question and answer
    (character n-gram naive Bayes) differ clearly.  ``truncated``: the last
    signs of the text hardly ever end one (n-gram likelihood of the end over
    all answers), or it stops inside a fence, bracket, list item or phrase.
    The first that holds, in this order, is given.

    Defined cases: rows sent twice count once; rows of ``baseline`` without
    ``output`` are left out; a question that is missing or null only allows
    empty, refusal and truncated; a null id stays null; other columns are
    ignored; empty tables give an empty result.
    """
    shared = answers.sparkSession.sparkContext.broadcast(models(answers, questions, baseline))  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_size(batches, "answer", 1_000_000):
            ids, asked, given = (batch.column(c).to_pylist() for c in ("pair_id", "question", "answer"))
            found = [(i, d) for i, d in zip(ids, judge_all(list(zip(asked, given)), shared.value)) if d]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], names=["pair_id", "defect"])

    return pairs(answers, questions, baseline).mapInArrow(run, "pair_id long, defect string")
