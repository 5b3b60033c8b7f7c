"""Abusive, hateful or sexual content by nearest labelled examples (problem 10).

A document is cut into sentences; each is compared with labelled examples by exact TF-IDF cosine, and the distance-weighted
votes of the ``K`` nearest give a score for each category, with the examples as evidence. Terms are words and pairs of
words in a spelling that survives disguise: letters set apart are joined, digits and signs that stand for letters are read
as letters, accents, vowels, repeated letters and asterisks fall away.

* Examples come from a bounded sample of labelled documents (``TOXIC``, ``CLEAN``). A label says that a document is toxic, not
  where or how, and may be wrong: sentences with terms that tell toxic documents from clean ones are candidates, a candidate
  is toxic if most of the labels of the documents near it say so (its own is one of them), and its category is that of the
  written examples of ``abuse_examples`` and of toxic candidates that it is nearest to. Candidates that are near toxic ones
  and stand in clean documents are examples of ``none``.
* One pass over the texts writes their spelled sentences and counts the document frequencies of all terms over all documents.
  Those of the examples (a bounded set) and of common terms (``COMMON``, bounded too) go into the index; the others stay in a
  table, which is joined to the terms of the sentences that can be near an example. As the inverse frequency of a term that
  isn't common has a lower bound, so has a sentence's norm without that table, and no other sentence can be near one.
* The index holds postings by example in blocks with their largest weight (block-max); a query walks the examples in order
  and skips blocks whose bounds can't reach the K-th best (Block-Max WAND), so results are those of a full scan. Sentences
  whose bound over the examples of a category stays below ``NEAR`` cannot be near one and score 0 without a walk.
* Scores are calibrated by isotonic regression of the label on the raw score, each half of the sample scored with the examples
  of the other; a document holds a category from a calibrated score of ``HELD``.

Defined results: null, empty and blank texts score 0 and hold no category; equal similarities go to the earlier example.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.llm.abuse_examples import EXAMPLES
from cuelake.llm.noise import head_label
from cuelake.llm.turns import isotonic
from cuelake.llm.mixing import source_key
from cuelake.session import arrow_batch, bounded_sample, materialise, spread, struct

CATEGORIES = ("abuse", "hate", "sexual")
K = 7
#: Cosine from which an example counts as near, and calibrated score from which a category is held.
NEAR, HELD = 0.42, 0.5
#: Bounds of the fit: toxic and clean labelled documents, their characters.
TOXIC, CLEAN, LONGEST = 1500, 3000, 20_000
#: A telling term: its least z-score, and the largest share of clean documents that have it. Candidates from each document.
TELLING, RARE, CANDIDATES = 2.0, 0.01, 2
#: Cosine of candidates whose labels count for each other, and share of toxic labels from which one is toxic or not.
ALIKE, SURE, CLEAR = 0.3, 0.5, 0.35
BLOCK = 32
#: Terms a task holds while it counts.
HELD_TERMS = 300_000
#: Terms in more than this share of the documents have their frequencies in the index; they are at most the mean number of
#: different terms of a document over the share.
COMMON = 0.001

_SPACED = re.compile(r"(?<![\w*])(?:[^\W_] ){2,}[^\W_](?![\w*])")
_WORD = re.compile(r"[^\W_](?:[^\W_]|[*@$!|'’](?=[\w*@$!|]))*|[*@$](?=\w)(?:[\w*@$!|])*")
_LEET = str.maketrans({"4": "a", "3": "e", "1": "i", "0": "o", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("асеорхуіјѕһԁԛԝкмнтвАСЕОРХУІЈЅВКМНТαοερνικτυχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aceopxyijshdqwkmhtbACEOPXYIJSBKMHTaoepviktuxABEZHIKMNOPTYX")
_LATIN_LETTER = re.compile("[A-Za-zÀ-ɏ]")
_REPEAT = re.compile(r"(.)\1+")
# Line ends, Thai and Greek letters as in ``sentences``.
_LINES = "\r\n\v\f\x1c-\x1e\x85\u2028\u2029"
_THAI, _GREEK = "\u0e01-\u0e3a\u0e40-\u0e4e", "\u0370-\u03ff\u1f00-\u1fff"
_LINE = re.compile(f"\r\n|[{_LINES}]")
#: Units are what stands between final marks or line breaks; a wrong cut at an abbreviation does no harm here.
_UNIT_ASCII = re.compile(rf"(?<=[.!?])[\"')\]]*\s+|(?<=[a-z][.!?])(?=[A-Z])|[{_LINES}]+")
#: Also after the Greek question mark and full-width dots outside numbers.
_UNIT = re.compile(
    rf"(?<=[.!?…])[\"'»”’)\]]*\s+|(?<=[a-zà-ÿ][.!?])(?=[A-ZÀ-Ý¡¿])|(?<=[。！？।॥؟])[」』”’》）]*\s*|(?<=．)(?!\d)[」』”’》）]*\s*|[{_LINES}]+|(?<=[{_GREEK}][;\u037e])[\"'»”’)\]]*\s+"
)
#: White space between Thai letters ends a sentence or a part of one (or a line of a caption); so parts are units, and up to
#: ``JOINED`` neighbouring ones together as well.
_THAI_SPACE, JOINED = re.compile(rf"(?<=[{_THAI}])\s+(?=[{_THAI}])"), 4
_LABELLED = re.compile(r"^.{0,40}?[:：\]]")
_CUE_LINE = re.compile(r"^(?:\d+\s*\n)?[ \t]*\d[\d:.,]*\s*-->\s*\d[\d:.,]*[^\n]*$", re.MULTILINE)
_TAG = re.compile(r"</?[a-z][^<>]{0,60}>", re.IGNORECASE)
_BULLET = re.compile(r"^[\s>#*•\-–—_]+(?=\w)")


@lru_cache(maxsize=1 << 17)
def spelling(word: str) -> str:
    """What is left of a word's spelling under disguise."""
    if not word.isascii() and _LATIN_LETTER.search(word):
        word = word.translate(_LOOKALIKE)
    w = word.lower()
    if any(c.isdigit() for c in w) and (any(c.isalpha() for c in w)):
        w = w.translate(_LEET)
    elif w.isdigit():
        return ""
    else:
        w = w.replace("@", "a").replace("$", "s").replace("|", "l").replace("!", "i")
    w = "".join(c for c in unicodedata.normalize("NFKD", w) if c.isalpha() or c == "*")
    if not w.isascii():
        return w.replace("*", "")
    w = _REPEAT.sub(r"\1", w)
    bones = re.sub(r"[aeiou*]", "", w)
    bones = _REPEAT.sub(r"\1", bones)
    return bones or w.replace("*", "")[:1]


def words_of(sentence: str) -> list[str]:
    """Words in the spelling that survives disguise; scripts without spaces as pairs of characters."""
    s = sentence if sentence.isascii() else unicodedata.normalize("NFKC", sentence)
    s = _SPACED.sub(lambda m: m.group().replace(" ", ""), s)
    if s.isascii():
        return [w for w in map(spelling, _WORD.findall(s)) if w]
    out: list[str] = []
    for w in map(spelling, _WORD.findall(s)):
        if len(w) > 3 and 0x0E00 <= ord(w[0]) <= 0xD7A3:
            out += [w[i : i + 2] for i in range(len(w) - 1)]
        elif w:
            out.append(w)
    return out


def terms(sentence: str) -> Counter:
    """Words and pairs of neighbouring words of a sentence."""
    return bag(words_of(sentence))


def units(text: str | None) -> list[str]:
    """Sentences of a document; captions are joined across their cues first, labels and bullets fall away."""
    if not text or not text.strip():
        return []
    if "-->" in text:
        text = _CUE_LINE.sub(" ", _LINE.sub("\n", text))
        text = re.sub(r"\s*\n\s*", " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    out = []
    for s in (_UNIT_ASCII if text.isascii() else _UNIT).split(text):
        s = s.strip()
        if s and not s[0].isalnum():
            s = _BULLET.sub("", s)
        if s and _LABELLED.match(s):
            s = head_label(s)[1].strip()
        if not s:
            continue
        parts = [s] if s.isascii() else _THAI_SPACE.split(s)
        if len(parts) == 1:
            out.append(s)
        else:
            out += [" ".join(parts[i : i + n]) for i in range(len(parts)) for n in range(1, min(JOINED, len(parts) - i) + 1)]
    return out


def bag(words: list[str]) -> Counter:
    """Words and pairs of neighbouring words."""
    out = Counter(words)
    out.update(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
    return out


class Index:
    """Examples as TF-IDF vectors under a block-max inverted index. Queries are lists of spelled words."""

    def __init__(self, examples: list[tuple[str, str]], frequency: dict[str, int], documents: int, common: dict[str, int] | None = None) -> None:
        """``common`` holds the frequencies of all terms in more than ``COMMON`` of the documents, if it is given."""
        self.examples = examples
        self.frequency, self.documents = frequency, documents
        self.labels = [c for c, _ in examples]
        self.idf = {}
        vectors = [terms(s) for _, s in examples]
        for v in vectors:
            for t in v:
                self.idf[t] = self.inverse(frequency.get(t, 0))
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.most: dict[str, float] = {}
        for i, v in enumerate(vectors):
            w = {t: n * self.idf[t] for t, n in v.items()}
            norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
            for t, x in w.items():
                postings[t].append((i, x / norm))
                if self.labels[i] != "none":
                    self.most[t] = max(self.most.get(t, 0.0), x / norm)
        self.postings = {t: ([i for i, _ in p], [x for _, x in p]) for t, p in postings.items()}
        self.blocks = {t: [(p[0][min(k + BLOCK, len(p[0])) - 1], max(p[1][k : k + BLOCK])) for k in range(0, len(p[0]), BLOCK)] for t, p in self.postings.items()}
        self.whole = {t: max(b for _, b in blocks) for t, blocks in self.blocks.items()}
        # Least squared weights of terms without an example: as known of common ones, of others by the share that they don't reach.
        self.least = {t: self.inverse(n) ** 2 for t, n in (common or {}).items() if t not in self.idf}
        self.rarer = 1.0 if common is None else max(1.0, self.inverse(int(COMMON * documents)) ** 2)

    def inverse(self, frequency: int) -> float:
        """Inverse document frequency; at least 1."""
        return math.log((1 + self.documents) / (1 + frequency)) + 1.0

    def others(self, words: list[str]) -> Counter:
        """Terms that no example has."""
        return Counter({t: n for t, n in bag(words).items() if t not in self.idf})

    def rest(self, others: Counter) -> float:
        """Squared weights of the terms that no example has, by the frequencies given to the index."""
        return round(sum((n * self.inverse(self.frequency.get(t, 0))) ** 2 for t, n in others.items()), 9)

    def known(self, words: list[str]) -> dict[str, float]:
        """Weights of the terms that examples have."""
        idf, w = self.idf, {}
        previous = None
        for word in words:
            x = idf.get(word)
            if x is None:
                previous = None
                continue
            w[word] = w.get(word, 0.0) + x
            if previous is not None:
                pair = f"{previous} {word}"
                x = idf.get(pair)
                if x is not None:
                    w[pair] = w.get(pair, 0.0) + x
            previous = word
        return w

    def may_be_near(self, words: list[str]) -> bool:
        """False only if no example of a category is as near as ``NEAR``, whatever the frequencies of other terms are."""
        w = self.known(words)
        if not w:
            return False
        most = self.bound(w)
        least = sum(x * x for x in w.values())
        known, of, rarer = self.idf, self.least.get, self.rarer
        for t, n in bag(words).items():
            if t not in known:
                least += n * n * of(t, rarer)
        return most >= (NEAR - 1e-9) * math.sqrt(least)

    def vector(self, words: list[str], rest: float | None = None) -> dict[str, float]:
        """Weights of the example terms over the norm of all terms; ``rest`` is the other terms' part of it."""
        w = self.known(words)
        if not w:
            return {}
        if rest is None:
            rest = self.rest(self.others(words))
        norm = math.sqrt(rest + sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    def bound(self, v: dict[str, float]) -> float:
        """No example of a category is more similar than this."""
        most = self.most
        return sum(x * most[t] for t, x in v.items() if t in most)

    def nearest(self, v: dict[str, float], k: int = K) -> list[tuple[float, int]]:
        """The k most similar examples (similarity, number), exactly, by Block-Max WAND."""
        cursors = [[t, x, 0] for t, x in v.items() if x > 0]
        best: list[tuple[float, int]] = []
        least = 0.0
        ends = len(self.examples)

        def at(c: list) -> int:
            ids = self.postings[c[0]][0]
            return ids[c[2]] if c[2] < len(ids) else ends

        while cursors:
            cursors.sort(key=at)
            while cursors and at(cursors[-1]) == ends:
                cursors.pop()
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[1] * self.whole[c[0]]
                if total > least:
                    pivot = i
                    break
            if pivot < 0:
                break
            d = at(cursors[pivot])
            while pivot + 1 < len(cursors) and at(cursors[pivot + 1]) == d:
                pivot += 1
            # Bound by the blocks that could hold d.
            total, nearest_end = 0.0, ends
            for c in cursors[: pivot + 1]:
                blocks = self.blocks[c[0]]
                b = c[2] // BLOCK
                while b < len(blocks) and blocks[b][0] < d:
                    b += 1
                if b < len(blocks):
                    total += c[1] * blocks[b][1]
                    nearest_end = min(nearest_end, blocks[b][0])
            if total > least:
                if at(cursors[0]) == d:
                    score = 0.0
                    for c in cursors:
                        if at(c) != d:
                            break
                        score += c[1] * self.postings[c[0]][1][c[2]]
                        c[2] += 1
                    if score > least or len(best) < k:
                        best.append((score, d))
                        best.sort(key=lambda r: (-r[0], r[1]))
                        del best[k:]
                        if len(best) == k:
                            least = best[-1][0]
                else:
                    for c in cursors[:pivot]:
                        if at(c) < d:
                            c[2] = bisect_left(self.postings[c[0]][0], d, c[2])
            else:
                to = nearest_end + 1
                if pivot + 1 < len(cursors):
                    to = min(to, at(cursors[pivot + 1]))
                to = max(to, d + 1)
                for c in cursors[: pivot + 1]:
                    if at(c) < to:
                        c[2] = bisect_left(self.postings[c[0]][0], to, c[2])
        return best

    def votes(self, words: list[str], rest: float | None = None) -> tuple[dict[str, float], int]:
        """Score of each category for a sentence, and the nearest example of the best one (-1: none)."""
        if not self.may_be_near(words):
            return {}, -1
        v = self.vector(words, rest)
        if self.bound(v) < NEAR:
            return {}, -1
        found = [(s, i) for s, i in self.nearest(v) if s > 0.2]
        if not found or found[0][0] < NEAR:
            return {}, -1
        weight = [(s**4, i) for s, i in found]  # near examples count much more than far ones
        total = sum(w for w, _ in weight)
        out: dict[str, float] = {}
        for w, i in weight:
            if self.labels[i] != "none":
                out[self.labels[i]] = out.get(self.labels[i], 0.0) + w / total
        near = {}
        for s, i in found:
            near.setdefault(self.labels[i], (s, i))
        out = {c: x * min(1.0, 0.5 + (near[c][0] - NEAR) * 2.5) for c, x in out.items() if near[c][0] >= NEAR}
        top = max(out, key=out.get, default=None)
        return out, near[top][1] if top else -1


def telling_terms(bags: list[tuple[set[str], int]]) -> dict[str, float]:
    """Terms of documents that tell toxic ones from clean ones: z-scores of their smoothed log odds from ``TELLING`` on."""
    toxic, clean = Counter(), Counter()
    n = [0, 0]
    for held, label in bags:
        n[label] += 1
        (toxic if label else clean).update(held)
    out = {}
    for t, k in toxic.items():
        m = clean[t]
        p = 2.0 * (k + m) / sum(n)
        if m > max(1.0, RARE * n[0]):
            continue
        a, b = k + p, m + p
        z = (math.log(a / (n[1] + 2.0 - a)) - math.log(b / (n[0] + 2.0 - b))) / math.sqrt(1 / a + 1 / b)
        if z >= TELLING:
            out[t] = z
    return out


def learned(sample: list[tuple[list[str], list[list[str]], int]], inverse: Callable[[str], float], weight: tuple[float, float] = (1.0, 1.0)) -> list[tuple[str, str]]:
    """Examples (category, sentence) from labelled documents of (sentences, their spelled words, label). ``weight`` says for how
    many documents a clean and a toxic one of the sample stand, as more toxic ones are taken."""
    bags = [({t for words in spelt for t in bag(words)}, label) for _, spelt, label in sample]
    telling = telling_terms(bags)
    seeds = [(c, words_of(s)) for c, v in EXAMPLES.items() for s in v.strip().split("\n")]
    clean = Counter(t for held, label in bags if not label for t in held)
    few = max(1.0, RARE * sum(not label for _, label in bags))
    for c, words in seeds:
        for t in bag(words) if c != "none" else ():
            if clean[t] <= few:
                telling.setdefault(t, TELLING)
    # Candidates: the sentences of each document that have most of the telling terms; equal bags of terms are one.
    candidates: dict[tuple, tuple[str, Counter, set[int]]] = {}
    for i, (said, spelt, _) in enumerate(sample):
        ranked = []
        for s, words in zip(said, spelt, strict=True):
            own = bag(words)
            x = sum(telling.get(t, 0.0) for t in own) / math.sqrt(len(own) or 1)
            if x > 0:
                ranked.append((-x, s, own))
        for _, s, own in sorted(ranked, key=lambda r: r[:2])[:CANDIDATES]:
            candidates.setdefault(tuple(sorted(own.items())), (s, own, set()))[2].add(i)
    rows = [candidates[k] for k in sorted(candidates)]

    def unit(own: Counter) -> dict[str, float]:
        w = {t: n * inverse(t) for t, n in own.items()}
        norm = math.sqrt(sum(x * x for x in w.values())) or 1.0
        return {t: x / norm for t, x in w.items()}

    vectors = [unit(own) for _, own, _ in rows]
    sharing: dict[str, list[int]] = defaultdict(list)
    for j, v in enumerate(vectors):
        for t in v.keys() & telling.keys():
            sharing[t].append(j)

    def dot(a: dict[str, float], b: dict[str, float]) -> float:
        if len(a) > len(b):
            a, b = b, a
        return sum(x * b[t] for t, x in a.items() if t in b)

    # Labels of the documents near each candidate, itself included, weighted by cosine.
    stands = [w / (weight[1] or 1.0) for w in weight]
    base = sum(label * stands[1] for _, _, label in sample) / max(1e-9, sum(stands[label] for _, _, label in sample))
    near: list[list[tuple[float, int]]] = []
    share = []
    for j, v in enumerate(vectors):
        others = sorted({k for t in v.keys() & telling.keys() for k in sharing[t]})
        alike = [(x, k) for k in others if (x := dot(v, vectors[k])) >= ALIKE]
        near.append(alike)
        votes: dict[int, float] = {}
        for x, k in alike:
            for i in rows[k][2]:
                votes[i] = max(votes.get(i, 0.0), x * stands[sample[i][2]])
        share.append((sum(x for i, x in votes.items() if sample[i][2]) + base) / (sum(votes.values()) + 1.0))
    # Categories: each toxic candidate starts with its likeness to the written examples and takes over that of those near it.
    written = [(c, unit(bag(words))) for c, words in seeds if c != "none"]
    toxic = [j for j in range(len(rows)) if share[j] >= SURE]
    start: dict[int, dict[str, float]] = {}
    for j in toxic:
        likeness = dict.fromkeys(CATEGORIES, 0.0)
        own = {t: x for t, x in vectors[j].items() if clean[t] <= few}
        for c, w in written:
            likeness[c] = max(likeness[c], dot(own, w) ** 2)
        total = sum(likeness.values()) or 1.0
        start[j] = {c: x / total for c, x in likeness.items()}
    held = start
    for _ in range(8):
        held = {j: {c: 0.2 * start[j][c] + 0.8 * sum(x * x * held[k][c] for x, k in near[j] if k in start) / sum(x * x for x, k in near[j] if k in start) for c in CATEGORIES} for j in toxic}
    out = []
    for j in toxic:
        best = max(CATEGORIES, key=lambda c: held[j][c])
        if held[j][best] > 0:
            out.append((best, rows[j][0]))
    isin = set(toxic)
    out += [("none", rows[j][0]) for j in range(len(rows)) if share[j] <= CLEAR and any(k in isin for _, k in near[j])]
    return [(c, s) for c, v in EXAMPLES.items() for s in v.strip().split("\n")] + out


class Scorer:
    """Index and calibration."""

    def __init__(self, index: Index, steps: list[tuple[float, float]]) -> None:
        self.index, self.steps = index, steps

    def document(self, text: str | None) -> dict[str, float]:
        """Raw score of each category."""
        return self.sentences([words_of(s) for s in units(text)])

    def sentences(self, spelt: list[list[str]]) -> dict[str, float]:
        best: dict[str, float] = {}
        for words in spelt:
            for c, x in self.index.votes(words)[0].items():
                best[c] = max(best.get(c, 0.0), x)
        return best

    def calibrated(self, raw: float) -> float:
        at = bisect_right(self.steps, (raw + 1e-9, 2.0))
        return self.steps[at - 1][1] if at else 0.0


_TEXTS = struct("doc_id long, source string, blank boolean, said array<string>, spelt array<string>, term string, n long")


def _spelled(documents: DataFrame) -> DataFrame:
    """One row for each document with its sentences as they are and as spelled words, and rows ``term, n``: documents that
    hold each term, added up within a task (``term`` "" has the number of documents)."""
    schema = to_arrow_schema(_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        spelled: dict[str, list[str]] = {}

        def counted() -> pa.RecordBatch:
            rows = [(None, None, None, None, None, t, n) for t, n in counts.items()]
            counts.clear()
            return arrow_batch(rows, schema)

        for b in batches:
            rows = []
            for doc, source, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                said = list(dict.fromkeys(units(text)))
                spelt = []
                held = {""} if text is not None else set()
                for s in said:
                    words = spelled.get(s)
                    if words is None:
                        if len(spelled) > 50_000:
                            spelled.clear()
                        words = spelled[s] = words_of(s)
                    spelt.append(" ".join(words))
                    held.update(words)
                    held.update(map(" ".join, zip(words, words[1:], strict=False)))
                rows.append((doc, source, text is None or not text.strip(), said, spelt, None, None))
                counts.update(held)
            yield arrow_batch(rows, schema)
            if len(counts) > HELD_TERMS:
                yield counted()
        yield counted()

    return materialise(spread(documents.select("doc_id", "source", "text")).mapInArrow(run, _TEXTS))


def _looked_up(counts: DataFrame, wanted: set[str]) -> dict[str, int]:
    """Frequencies of a bounded set of terms."""
    rows = counts.sparkSession.createDataFrame([(t,) for t in sorted(wanted)], "term string")
    return {r["term"]: r["n"] for r in counts.join(F.broadcast(rows), "term").collect()}


def fit(texts: DataFrame, labels: DataFrame, counts: DataFrame) -> Scorer:
    """Index and calibration from the written examples, a bounded sample of labelled documents and counts over all documents."""
    voted = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic")).where("toxic <> 0.5")
    length = F.aggregate("said", F.lit(0), lambda a, s: a + F.length(s))
    rows = materialise(texts.where("size(said) > 0").join(voted, "doc_id").where(length <= LONGEST).select("doc_id", "said", "spelt", (F.col("toxic") > 0.5).cast("int").alias("toxic")))
    sizes = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = [(r["said"], [s.split(" ") if s else [] for s in r["spelt"]], label) for label, most in ((1, TOXIC), (0, CLEAN)) for r in bounded_sample(rows.where(F.col("toxic") == label), "doc_id", most, sizes.get(label, 0)).collect()]
    frequency = _looked_up(counts, {"", *(t for _, spelt, _ in taken for words in spelt for t in bag(words))})
    documents = frequency.get("", 0)
    common = {r["term"]: r["n"] for r in counts.where((F.col("n") > COMMON * documents) & (F.col("term") != "")).collect()}
    inverse = lambda t: math.log((1 + documents) / (1 + frequency.get(t, 0))) + 1.0
    weight = tuple(sizes.get(k, 0) / max(1, sum(label == k for *_, label in taken)) for k in (0, 1))
    made = lambda part: Index(list(dict.fromkeys(learned(part, inverse, weight))), frequency, documents, common)
    # Calibration: each half of the sample is scored with the examples of the other one, and each label weighs as many
    # documents as its part of the sample stands for.
    by_raw: dict[float, list[float]] = defaultdict(lambda: [0.0, 0.0])
    for half in (0, 1):
        judge = Scorer(made(taken[half::2]), [])
        for _, spelt, label in taken[1 - half :: 2]:
            by_raw[round(max(judge.sentences(spelt).values(), default=0.0), 3)][label] += weight[label]
    index = made(taken)
    scorer = Scorer(index, [])
    if len(by_raw) > 1:
        raw = sorted(by_raw)
        total = np.array([sum(by_raw[x]) for x in raw])
        fitted = isotonic(np.array([by_raw[x][1] for x in raw]) / total, total)
        scorer.steps = [(x, round(float(p), 6)) for x, p in zip(raw, fitted, strict=True)]
    else:
        scorer.steps = [(x / 10, x / 10) for x in range(11)]
    index.frequency = {}
    return scorer


_UNITS = struct("doc_id long, source string, blank boolean, place int, sentence string, spelt string")
_OTHERS = struct("spelt string, term string, n long")
_VOTES = struct("spelt string, abuse double, hate double, sexual double, top double, example string")
_SCORES = struct("doc_id long, source string, score double, abuse double, hate double, sexual double, evidence string, example string")


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each document: calibrated ``score`` and scores by category, the deciding sentence and its example."""
    written = _spelled(documents)
    texts = written.where("term IS NULL").drop("term", "n")
    counts = materialise(written.where("term IS NOT NULL").groupBy("term").agg(F.sum("n").alias("n")))
    fitted = fit(texts, labels, counts)
    scorer = documents.sparkSession.sparkContext.broadcast(fitted)
    as_units, as_others, as_votes, as_scores = map(to_arrow_schema, (_UNITS, _OTHERS, _VOTES, _SCORES))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sentences that can be near an example; one row without a sentence for documents that have none."""
        index = scorer.value.index
        seen: dict[str, bool] = {}
        for b in batches:
            rows = []
            columns = (b.column(i).to_pylist() for i in range(4))
            for at, (doc, source, blank, spelt) in enumerate(zip(*columns, strict=True)):
                found = []
                for i, s in enumerate(spelt):
                    near = seen.get(s)
                    if near is None:
                        if len(seen) > 50_000:
                            seen.clear()
                        near = seen[s] = bool(s) and index.may_be_near(s.split(" "))
                    if near:
                        found.append(i)
                if found:
                    said = b.column(4)[at].as_py()
                    rows += [(doc, source, False, i, said[i], spelt[i]) for i in found]
                else:
                    rows.append((doc, source, blank, -1, None, None))
            yield arrow_batch(rows, as_units)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Terms that no example has; "" keeps the sentences without any."""
        index = scorer.value.index
        for b in batches:
            yield arrow_batch([(s, t, n) for s in b.column(0).to_pylist() for t, n in [("", 0), *index.others(s.split(" ")).items()]], as_others)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = scorer.value.index
        for b in batches:
            rows = []
            for s, rest in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found, near = index.votes(s.split(" "), rest)
                rows.append((s, *(found.get(c, 0.0) for c in CATEGORIES), max(found.values(), default=0.0), index.examples[near][1] if near >= 0 else None))
            yield arrow_batch(rows, as_votes)

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scorer.value
        for b in batches:
            rows = []
            for doc, source, blank, *raw, said, example in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                rows.append((doc, source, 0.0 if blank else s.calibrated(max(raw)), *(s.calibrated(x) if x > 0 else 0.0 for x in raw), said, example))
            yield arrow_batch(rows, as_scores)

    held = materialise(texts.select("doc_id", "source", "blank", "spelt", "said").mapInArrow(passing, _UNITS))
    said = held.where("sentence IS NOT NULL")
    weight = F.col("n") * (F.log(F.lit(1.0 + fitted.index.documents) / (F.coalesce("df", F.lit(0)) + 1)) + 1)
    terms_ = said.select("spelt").distinct().mapInArrow(others, _OTHERS).join(counts.withColumnRenamed("n", "df"), "term", "left")
    voted = terms_.groupBy("spelt").agg(F.round(F.sum(weight * weight), 9).alias("rest")).mapInArrow(votes, _VOTES)
    best = F.max_by(F.when(F.col("top") > 0, F.struct("sentence", "example")), F.struct("top", -F.col("place")))
    scored = said.join(voted, "spelt").groupBy("doc_id", "source", "blank").agg(*[F.max(c).alias(c) for c in CATEGORIES], best.alias("best"))
    scored = scored.select("doc_id", "source", "blank", *CATEGORIES, "best.sentence", "best.example")
    none = held.where("sentence IS NULL").select("doc_id", "source", "blank", *[F.lit(0.0).alias(c) for c in CATEGORIES], "sentence", F.lit(None).cast("string").alias("example"))
    return none.unionByName(scored).mapInArrow(scores, _SCORES)


def held_categories(scores: DataFrame) -> DataFrame:
    """Rows ``doc_id, category`` of the categories a document holds by its calibrated scores."""
    pairs = F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("x")) for c in CATEGORIES])
    return scores.select("doc_id", F.explode(pairs).alias("p")).where(f"p.x >= {HELD}").select("doc_id", "p.category")


def rates_by_source(scores: DataFrame) -> DataFrame:
    """``source, n_documents, abuse_rate, hate_rate, sexual_rate, flagged_rate``; sources by trimmed lower case."""
    any_held = F.greatest(*CATEGORIES) >= HELD
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    source = F.coalesce(source_key("source"), F.lit("(none)"))
    return scores.groupBy(source.alias("source")).agg(F.count(F.lit(1)).alias("n_documents"), *[rate(F.col(c) >= HELD).alias(f"{c}_rate") for c in CATEGORIES], rate(any_held).alias("flagged_rate"))
