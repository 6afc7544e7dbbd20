"""A character language model of the corpus, and the noisy channel through which odd spellings are read."""
from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .batches import by_size

#: Symbols of the language model: 0 what parts words, 1 to 26 letters, 27 digits and signs that stand inside words.
SYMBOLS, OTHER = 28, 27
#: Length of the model's n-grams.  Its table has SYMBOLS ** ORDER cells, whatever the corpus.
ORDER = 4
INSIDE = "0123456789@$*!|+€£"
#: What a printed sign may stand for besides itself.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
#: Costs (negative log probabilities) of the channel: a sign for a letter, a mask, a sign set in, a digit set in, a stretched letter, a gap between spaced letters.
LEET, MASK, DROP, LOST, FOLD, GAP = 0.3, 1.2, 2.5, 6.0, 0.2, 0.7
#: How often a word that is not among the common ones is meant, against one that is.
RARE = 0.02
#: Ways kept at every sign when the corpus model alone reads a word.
BEAM = 64


@lru_cache(maxsize=1)
def _symbols() -> np.ndarray:
    """The symbol of every code point: letters count as their Latin base letter."""
    out = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x250):
        base = unicodedata.normalize("NFD", chr(c).lower())[0]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
    for c in INSIDE:
        out[ord(c)] = OTHER
    return out


def tally(texts: list[str]) -> np.ndarray:
    """Counts of the symbol n-grams of whole texts."""
    codes = np.frombuffer(("\n\n\n" + "\n\n\n".join(texts) + "\n").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    s = _symbols()[codes].astype(np.int32)
    cells = ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]
    return np.bincount(cells[(s[2:-1] > 0) | (s[3:] > 0)], minlength=SYMBOLS**ORDER)


def log_costs(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities of a symbol after three others, interpolated with shorter contexts."""
    c = counts.reshape((SYMBOLS,) * ORDER).astype(np.float64)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for n in range(1, ORDER + 1):
        seen = c.sum(axis=tuple(range(ORDER - n)))
        p = (seen + 5 * p) / (seen.sum(-1, keepdims=True) + 5)
    return -np.log(p).astype(np.float32)


def count_corpus(df: DataFrame, text: str = "text") -> np.ndarray:
    """``log_costs`` of all texts.  Tasks send the cells of a table of fixed size; their sums come to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, dtype=np.int64)
        for batch in by_size(batches, "_t"):
            total += tally([t for t in batch.column("_t").to_pylist() if t])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    got = df.select(F.col(text).alias("_t")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SYMBOLS**ORDER, dtype=np.int64)
    counts[got.column("cell").to_numpy()] = got.column("n").to_numpy()
    return log_costs(counts)


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 0 if c == " " else OTHER


class Speller:
    """The Viterbi decoder of noisy spellings under a character language model.

    The model is the corpus's n-gram model, and beside it the vocabulary of
    words that matter, as a tree of prefixes: the letter after a prefix has the
    share of the prefix's words that go on with it.  The decoder walks the
    lattice of what every printed sign may stand for (itself, a letter it looks
    like, any letter for a mask, nothing, or one or two letters for a run) and
    keeps for every state the cheapest way to it.  A word of the vocabulary is
    taken unless the token as printed is likelier under the corpus model;
    without one the likeliest letters under the corpus model alone are taken,
    again only if they are likelier than the token as printed.
    """

    def __init__(self, words: list[str], costs: np.ndarray | None = None, common: set[str] | None = None):
        self.next: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.weight: list[float] = [0]
        self.costs = costs
        for w in dict.fromkeys(words):
            at, times = 0, 1 if common is None or w in common else RARE
            self.weight[0] += times
            for c in w:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.word.append(None)
                    self.weight.append(0)
                at = self.next[at][c]
                self.weight[at] += times
            self.word[at] = w
        self.squeezed = {squeeze(w) for w in self.word if w}
        self.read = lru_cache(maxsize=100_000)(self._read)
        self.parted = lru_cache(maxsize=100_000)(self._parted)

    def price(self, text: str) -> float:
        """What a token costs under the corpus model, as it stands."""
        a = b = c = 0
        spent = 0.0
        for s in [*map(symbol, text), 0]:
            spent += float(self.costs[a, b, c, s])
            a, b, c = b, c, s
        return spent

    def ways(self, sign: str, count: int) -> list[tuple[str, float]]:
        """What a run of one printed sign may stand for, and the cost of each."""
        if sign == "*":
            return [("?" * count, MASK * count)] + ([("", DROP)] if count == 1 else [])
        out: list[tuple[str, float]] = []
        for letter in (sign, *STANDS_FOR.get(sign, "")):
            cost = 0.0 if letter == sign else LEET
            out.append((letter * count, cost * count))
            if count > 1:
                out += [(letter, cost + FOLD), (letter * 2, cost + FOLD)]
        return out if sign.isalpha() else [*out, ("", LOST if sign.isdigit() else DROP)]

    def decode(self, printed: str) -> str | None:
        """The vocabulary word that most likely was meant, or None."""
        states: dict[int, float] = {0: 0.0}
        for m in re.finditer(r"(.)\1*", printed):
            after: dict[int, float] = {}
            for letters, cost in self.ways(m.group(1), len(m.group())):
                front = {s: c + cost for s, c in states.items()}
                for c in letters:
                    moved: dict[int, float] = {}
                    for s, spent in front.items():
                        for letter in self.next[s] if c == "?" else (c,):
                            to = self.next[s].get(letter)
                            if to is not None:
                                cost_to = spent + math.log(self.weight[s] / self.weight[to])
                                if cost_to < moved.get(to, math.inf):
                                    moved[to] = cost_to
                    front = moved
                    if not front:
                        break
                for s, spent in front.items():
                    if spent < after.get(s, math.inf):
                        after[s] = spent
            states = after
            if not states:
                return None
        ends = [(c, self.word[s]) for s, c in states.items() if self.word[s]]
        if not ends:
            return None
        spent, word = min(ends)
        return word if word == printed or self.costs is None or min(spent, self.price(word) + LEET) <= self.price(printed) else None

    def _read(self, printed: str) -> str | None:
        """The likeliest letters behind a token under the corpus model alone, or None if the token as printed is likelier."""
        if self.costs is None:
            return None
        beams: dict[tuple[int, int, int], tuple[float, str]] = {(0, 0, 0): (0.0, "")}
        for m in re.finditer(r"(.)\1*", printed):
            after: dict[tuple[int, int, int], tuple[float, str]] = {}
            for letters, cost in self.ways(m.group(1), len(m.group())):
                if letters and letters[0] not in "?abcdefghijklmnopqrstuvwxyz":
                    continue  # a reading has letters only
                front = {k: (v[0] + cost, v[1]) for k, v in beams.items()}
                for c in letters:
                    moved: dict[tuple[int, int, int], tuple[float, str]] = {}
                    for (x, y, z), (spent, made) in front.items():
                        for s in range(1, 27) if c == "?" else (symbol(c),):
                            total = spent + float(self.costs[x, y, z, s])
                            key = (y, z, s)
                            if key not in moved or total < moved[key][0]:
                                moved[key] = (total, made + chr(96 + s))
                    front = moved if len(moved) <= BEAM else dict(sorted(moved.items(), key=lambda e: e[1])[:BEAM])
                for k, v in front.items():
                    if k not in after or v < after[k]:
                        after[k] = v
            beams = after
            if not beams:
                return None
        spent, made = min((v[0] + float(self.costs[(*k, 0)]), v[1]) for k, v in beams.items())
        return made if made != printed and spent < self.price(printed) else None

    def _parted(self, left: str, right: str) -> str | None:
        """A word with one sign set into it; two words of their own stay apart."""
        return self.decode(left + right) if squeeze(left + right) in self.squeezed else None

    def joined(self, letters: list[str]) -> str | None:
        """Spaced letters as one word, if the corpus model finds that likelier than so many words of one letter."""
        if self.costs is None:
            return None
        word = "".join(letters)
        word = self.read(word) or word
        apart = sum(self.price(c) for c in letters)
        return word if word.isalpha() and self.price(word) + GAP * (len(letters) - 1) < apart else None


def squeeze(word: str) -> str:
    """Each run of one letter as that letter; ``decode`` changes the letters of a word of letters in no other way."""
    return re.sub(r"(.)\1+", r"\1", word)
