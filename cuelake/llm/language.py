"""Languages of recordings and of the parts of mixed segments (problem 3).

Word-first backoff: a word that the model knows is scored by its log frequency in each language; an unknown word by its
longest known character n-grams, from order ``NGRAM`` down to single letters. Scripts that one language uses decide at
once; Han and kana are scored by character. A segment is cut into stretches by a Viterbi path over its words with a cost
for every change of language. The model is fitted on a bounded sample of labelled transcripts (``SAMPLE`` recordings with
the smallest hash of their key, at most ``LONGEST`` characters each) plus a seed of common words; as labels are partly
wrong, the sentences of the sample are relabelled by the first model before the second fit. Its vocabulary is capped at
``VOCABULARY`` words for each language, so the broadcast is bounded whatever the corpus. Every row of the corpus is scored.

Defined results: texts without letters have no language; personal details, notes, labels and fillers do not count;
a recording without text has no row; ties go to the language that comes first in ``LANGUAGES``.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.llm.pii import details, masked
from cuelake.llm.sentences import sentence_spans
from cuelake.session import arrow_batch, bounded_sample, struct

LANGUAGES = ("en", "es", "fr", "de", "pt", "ru", "ja", "zh", "ar", "hi", "el", "th", "ko")
LATIN = LANGUAGES[:5]
SAMPLE, LONGEST, VOCABULARY = 1500, 20_000, 30_000
NGRAM = 5
#: Cost in nats of a change of language, and the most a single word may say for one language against another.
CHANGE, CAP = 5.0, 4.0

# Names and three-letter codes of languages, as labels have them.
NAMES = {
    "en": "english eng anglais inglés ingles englisch inglês", "es": "spanish spa español espanol castellano espagnol spanisch esp", "fr": "french fra fre français francais französisch francés",
    "de": "german deu ger deutsch allemand alemán alemao alemão", "pt": "portuguese por português portugues portugais portugiesisch", "ru": "russian rus русский russisch russe",
    "ja": "japanese jpn 日本語 jp japonés japonais japanisch", "zh": "chinese zho chi 中文 汉语 漢語 mandarin cmn cn chino chinois chinesisch", "ar": "arabic ara العربية arabe árabe arabisch",
    "hi": "hindi hin हिन्दी हिंदी", "el": "greek ell gre ελληνικά griego grec griechisch gr", "th": "thai tha ไทย ภาษาไทย tailandés", "ko": "korean kor 한국어 kr coreano coréen koreanisch",
}
_BY_NAME = {w: k for k, v in NAMES.items() for w in v.split()} | {k: k for k in LANGUAGES}
NO_LABEL = {"", "und", "unk", "unknown", "auto", "none", "null", "n/a", "mul", "mis", "zxx", "?", "xx"}

# Common words, the seed of the word tables.
SEED = {
    "en": "the of and to in is that it was for on are as with his they at be this have from or one had by not but what all were we when your can said there an each which she do how their if will up other about out many then them these so some her would make like him into time has look two more go see no way could people my than first been who its now find long down day did get come made may over after also because while without why before between nobody everyone",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra tan durante siempre día tanto ella tres sí nuestro nuestra quién",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont la ont avec son aux d'un cette d'une ou être nous été comme mais on tout sa fait aussi leur bien peut ces y deux ans même après sans autres avant encore si quand elle entre notre vers dont moins où je vous ils très faire depuis c'est l'on pendant alors personne toujours était puis chez mon ma mes votre quel pourquoi",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines es jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer unser meine niemand warum weil ohne",
    "pt": "de a o que e do da em um para com não uma os no se na por mais as dos como mas ao ele das à seu sua ou quando muito nos já eu também só pelo pela até isso ela entre depois sem mesmo aos seus quem nas me esse eles você essa num nem suas meu às minha numa pelos elas qual nós lhe deles essas esses pelas este dele tu te vocês foi são está tem ser havia era nosso nossa porque onde aqui sempre ninguém hoje então",
    "ja": "のにはをたがでてとしれさあるいるもするからなことこれそれ私今日人年大学東京本当同僚",
    "zh": "的一是不了在人有我他这个们中来上大为和国地到以说时要就出会可也你对生能而子那得于着下自之年过发后作里用道行所然家种事成方多经么去法学如都同现当没动面起看定天分还进好小部其些主样理心她本前开但因只从想实们说真们谁吗",
}

_RUN = re.compile(r"(?P<L>[A-Za-zÀ-ÖØ-öø-ɏ]+(?:['’][A-Za-zÀ-ÖØ-öø-ɏ]+)*)|(?P<ru>[Ѐ-ӿ]+)|(?P<el>[Ͱ-Ͽἀ-῿]+)|(?P<ar>[؀-ۿݐ-ݿ]+)|(?P<hi>[ऀ-ॿ]+)|(?P<th>[฀-๿]+)|(?P<ko>[가-힯ᄀ-ᇿ㄰-㆏]+)|(?P<C>[ぁ-ゖゝ-ゟァ-ヺヽ-ヿー々㐀-䶿一-鿿]+)")
_HAN = re.compile(r"[㐀-䶿一-鿿]")
#: Letters that weigh as much as a Latin one, by script.
_WEIGHT = {"C": 2.5, "ko": 2.0, "th": 1.0}
#: Least evidence of a language in a mixed segment: words, letters.
_LEAST = {"L": (3, 8), "ru": (3, 8), "el": (3, 8), "ar": (3, 7), "hi": (3, 6), "th": (1, 8), "ko": (2, 5), "C": (1, 6)}


def label_language(label: str | None) -> str | None:
    """Two letters for a label in any notation; null if it names no language."""
    if label is None:
        return None
    s = label.strip().casefold()
    if s in NO_LABEL:
        return None
    if s in _BY_NAME:
        return _BY_NAME[s]
    head = re.split(r"[-_ (]", s)[0]
    if head in NO_LABEL:
        return None
    return _BY_NAME.get(head, head if len(head) == 2 else None)


class Model:
    """Log frequencies of words, Latin character n-grams, and Han and kana characters."""

    def __init__(self, words: dict[str, Counter], characters: dict[str, Counter]) -> None:
        self.words: dict[str, tuple[float, ...]] = {}
        totals = [sum(words[k].values()) + 1 for k in LATIN]
        kept: dict[str, list[int]] = {}
        for i, k in enumerate(LATIN):
            for w, n in sorted(words[k].items(), key=lambda x: (-x[1], x[0]))[:VOCABULARY]:
                kept.setdefault(w, [0] * 5)[i] = n
        grams: dict[str, list[float]] = {}
        for w, row in kept.items():
            if sum(row) >= 2:
                self.words[w] = self._shares([(n + 0.3) / t for n, t in zip(row, totals, strict=True)])
            padded = f"^{w}$"
            weight = [math.log1p(n) for n in row]
            for size in range(1, NGRAM + 1):
                for a in range(len(padded) - size + 1):
                    have = grams.setdefault(padded[a : a + size], [0.0] * 5)
                    for i in range(5):
                        have[i] += weight[i]
        mass = [sum(math.log1p(n) for n in words[k].values()) + 1 for k in LATIN]
        self.grams = {g: self._shares([(n + 0.5) / m for n, m in zip(row, mass, strict=True)]) for g, row in grams.items() if sum(row) >= 2}
        both = {c for k in ("ja", "zh") for c in characters[k]}
        size = [sum(characters[k].values()) + len(both) + 1 for k in ("ja", "zh")]
        self.characters = {c: max(-CAP, min(CAP, math.log((characters["ja"][c] + 0.5) / size[0]) - math.log((characters["zh"][c] + 0.5) / size[1]))) for c in both}
        self._cache: dict[str, tuple[float, ...]] = {}

    @staticmethod
    def _shares(p: list[float]) -> tuple[float, ...]:
        logs = [math.log(x) for x in p]
        top = max(logs)
        return tuple(max(x - top, -CAP) for x in logs)

    def word(self, w: str) -> tuple[float, ...]:
        """Log scores of a lower-case Latin word for LATIN, the best at 0."""
        found = self.words.get(w)
        if found is not None:
            return found
        found = self._cache.get(w)
        if found is None:
            padded, at, parts = f"^{w}$", 0, []
            while at < len(padded):
                for size in range(min(NGRAM, len(padded) - at), 0, -1):
                    g = self.grams.get(padded[at : at + size])
                    if g is not None:
                        parts.append(g)
                        at += max(1, size - 1)
                        break
                else:
                    at += 1
            raw = [sum(g[i] for g in parts) / max(1, len(parts)) for i in range(5)] if parts else [0.0] * 5
            top = max(raw)
            found = tuple(max(x - top, -CAP / 2) for x in raw)
            if len(self._cache) > 100_000:
                self._cache.clear()
            self._cache[w] = found
        return found

    def character(self, c: str) -> float:
        """Log ratio of Japanese to Chinese of a character."""
        found = self.characters.get(c)
        if found is None:
            found = 0.0 if _HAN.match(c) else CAP
        return found if _HAN.match(c) else max(found, 2.0)


def _count(pairs: Iterator[tuple[str, str]]) -> tuple[dict[str, Counter], dict[str, Counter]]:
    words = {k: Counter() for k in LATIN}
    characters = {k: Counter() for k in ("ja", "zh")}
    for k, v in SEED.items():
        if k in words:
            words[k].update(dict.fromkeys(v.split(), 20))
        else:
            characters[k].update(dict.fromkeys(v, 20))
    for language, text in pairs:
        if language in words:
            words[language].update(m.group().lower() for m in _RUN.finditer(text) if m.lastgroup == "L")
        elif language in characters:
            characters[language].update(c for m in _RUN.finditer(text) if m.lastgroup == "C" for c in m.group())
    return words, characters


def fit(rows: list[tuple[str | None, str]]) -> Model:
    """A model of labelled texts. The first fit takes labels as they are; then the words of each sentence are counted for
    the languages that the model before gives them, which mends wrong labels and mixed texts."""
    labelled = [(k, t) for label, t in rows if (k := label_language(label)) in LANGUAGES]
    model = Model(*_count(iter(labelled)))
    lines = [t[a:b] for _, t in labelled for a, b in sentence_spans(t)]
    for _ in range(2):
        words, characters = _count(iter(()))
        for line in lines:
            for kind, runs, path in (_latin_words(model, line), _cjk_characters(model, line)):
                counts = words if kind == "L" else characters
                for run, k in zip(runs, path, strict=True):
                    counts[k][run] += 1
        model = Model(words, characters)
    return model


def _latin_words(model: Model, text: str) -> tuple[str, list[str], list[str]]:
    runs = [m.group().lower() for m in _RUN.finditer(text) if m.lastgroup == "L"]
    return "L", runs, [LATIN[i] for i in _latin_path([model.word(w) for w in runs])] if runs else []


def _cjk_characters(model: Model, text: str) -> tuple[str, list[str], list[str]]:
    runs = [c for m in _RUN.finditer(text) if m.lastgroup == "C" for c in m.group()]
    return "C", runs, [("ja", "zh")[i] for i in _cjk_path([model.character(c) for c in runs])] if runs else []


def _latin_path(scores: list[tuple[float, ...]]) -> list[int]:
    """Languages of Latin words, by Viterbi; most texts need only the sums."""
    totals = [sum(s[i] for s in scores) for i in range(5)]
    best = max(range(5), key=lambda i: totals[i])
    single = True
    for i in range(5):
        if i != best:
            run = top = 0.0
            for s in scores:
                run = max(0.0, run + s[i] - s[best])
                top = max(top, run)
            if top > CHANGE:
                single = False
                break
    if single:
        return [best] * len(scores)
    value, back = list(scores[0]), []
    for s in scores[1:]:
        top = max(range(5), key=lambda i: value[i])
        step, new = [], []
        for i in range(5):
            stay, move = value[i], value[top] - CHANGE
            step.append(i if stay >= move else top)
            new.append(max(stay, move) + s[i])
        back.append(step)
        value = new
    at = max(range(5), key=lambda i: value[i])
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def _cjk_path(scores: list[float]) -> list[int]:
    """0 for Japanese, 1 for Chinese, for characters with log ratios (an early end for unmixed texts)."""
    value, back = [scores[0] / 2, -scores[0] / 2], []
    for s in scores[1:]:
        step = [0 if value[0] >= value[1] - CHANGE * 2 else 1, 1 if value[1] >= value[0] - CHANGE * 2 else 0]
        value = [max(value[0], value[1] - CHANGE * 2) + s / 2, max(value[1], value[0] - CHANGE * 2) - s / 2]
        back.append(step)
    at = 0 if value[0] >= value[1] else 1
    path = [at]
    for step in reversed(back):
        at = step[at]
        path.append(at)
    return path[::-1]


def evidence(model: Model, text: str) -> dict[str, tuple[int, float, float]]:
    """Different words, weighted letters and log odds for every language with a part in the text."""
    words: Counter = Counter()
    letters: Counter = Counter()
    odds: Counter = Counter()
    latin: list[tuple[float, ...]] = []
    runs: list[str] = []
    cjk: list[float] = []
    previous = ""
    for m in _RUN.finditer(text):
        kind, run = m.lastgroup, m.group()
        if kind == "L":
            low = run.lower()
            if len(run) > 1 and low not in model.words and (run.isupper() or (run[0].isupper() and previous not in ".!?¿¡«“\"„:")):
                scores = (0.0,) * 5  # most likely a name
            else:
                scores = model.word(low)
            latin.append(scores)
            runs.append(low)
        elif kind == "C":
            cjk.extend(model.character(c) for c in run)
        else:
            words[kind] += 1
            letters[kind] += len(run) * _WEIGHT.get(kind, 1.0)
            odds[kind] += CAP
        previous = text[m.end() : m.end() + 2].strip()[-1:] if m.end() < len(text) else ""
    if latin:
        seen: set[tuple[str, str]] = set()
        for i, s, w in zip(_latin_path(latin), latin, runs, strict=True):
            k = LATIN[i]
            if (k, w) not in seen:  # a name said again and again is no clause
                seen.add((k, w))
                words[k] += 1
            letters[k] += len(w)
            odds[k] += s[i] - max(x for j, x in enumerate(s) if j != i)
    if cjk:
        for i, s in zip(_cjk_path(cjk), cjk, strict=True):
            k = "zh" if i else "ja"
            letters[k] += _WEIGHT["C"]
            odds[k] += -s if i else s
        for k in ("ja", "zh"):
            if letters[k]:
                words[k] = 1
    return {k: (words[k], letters[k], odds[k]) for k in letters}


def content(text: str) -> str:
    """The text with notes, labels, fillers and personal details blanked."""
    t = masked(text)
    if len(t) != len(text):
        return t
    for a, b, _ in details(text):
        t = t[:a] + " " * (b - a) + t[b:]
    return t


def mixed_languages(shares: dict[str, tuple[int, float, float]]) -> list[tuple[str, float]]:
    """Languages, with confidence, that each have a clause in a text; fewer than two if it isn't mixed."""
    out = []
    total = sum(x[1] for x in shares.values())
    for k, (n, size, odds) in shares.items():
        script = "L" if k in LATIN else "C" if k in ("ja", "zh") else k
        least_words, least_letters = _LEAST[script]
        if n >= least_words and size / _WEIGHT.get(script, 1.0) >= least_letters and odds >= 3.0:
            out.append((k, round(1 / (1 + math.exp(-min(30.0, odds / 2))) * min(1.0, 0.5 + size / total), 6)))
    return sorted(out)


def fit_on(transcripts: DataFrame) -> Broadcast:
    """The model of a bounded sample of labelled transcripts, broadcast."""
    rows = transcripts.select("media_id", "language", "text").where(f"language IS NOT NULL AND text IS NOT NULL AND length(text) BETWEEN 1 AND {LONGEST}")
    sample = bounded_sample(rows, "media_id", SAMPLE).select("language", "text")
    return transcripts.sparkSession.sparkContext.broadcast(fit([tuple(r) for r in sample.collect()]))


_PARTS = struct("media_id long, seg_ix int, lang string, letters double, odds double, confidence double, mixed boolean")


def language_parts(rows: DataFrame, model: Broadcast) -> DataFrame:
    """``media_id, seg_ix, lang, letters, odds, confidence, mixed``: every language that has a part in a text."""
    schema = to_arrow_schema(_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in batches:
            out = []
            for media, seg, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if not text:
                    continue
                shares = evidence(m, content(text))
                mixed = dict(mixed_languages(shares))
                for k, (_, size, odds) in shares.items():
                    out.append((media, seg, k, float(size), float(odds), mixed.get(k, 0.0), len(mixed) > 1 and k in mixed))
            if out:
                yield arrow_batch(out, schema)

    return rows.select("media_id", "seg_ix", "text").mapInArrow(run, _PARTS)


def with_label(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the two letters of a label column; done on the JVM by a map of the notations."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_BY_NAME.items()) for x in pair])
    s = F.lower(F.regexp_replace(F.coalesce(F.col(column), F.lit("")), r"(?U)^\s+|\s+$", ""))
    head = F.element_at(F.split(s, r"[-_ (]"), 1)
    none = F.array(*[F.lit(x) for x in sorted(NO_LABEL)])
    value = F.when(F.array_contains(none, s) | F.array_contains(none, head), F.lit(None).cast("string")).otherwise(
        F.coalesce(F.try_element_at(known, s), F.try_element_at(known, head), F.when(F.length(head) == 2, head))
    )
    return df.withColumn(name, value)


def recording_languages(parts: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``media_id, lang, confidence, label``: the language most of each recording is in, and what its label says."""
    sums = parts.groupBy("media_id", "lang").agg(F.sum("letters").alias("letters"))
    rank = F.array_position(F.array(*map(F.lit, LANGUAGES)), F.col("lang"))
    best = sums.groupBy("media_id").agg(F.max_by("lang", F.struct("letters", -rank)).alias("lang"), (F.max("letters") / F.sum("letters")).alias("confidence"))
    labels = with_label(transcripts.select("media_id", "language"), "language", "label")
    return best.join(labels.select("media_id", "label"), "media_id")
