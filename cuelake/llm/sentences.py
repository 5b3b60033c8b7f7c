"""Sentence boundaries by a hidden-event n-gram model (problem 1).

Between the words of a text stands a hidden event, boundary or none. Where no final mark, no line break and no white
space between letters of a script without spaces stands, the event is impossible, so the lattice has a choice only at
*sites*. A site is described by classes of its surroundings, in reading order: the token before the mark (word, number,
initial, kinds of abbreviation, script), the mark with the quotes it closes, the event, the gap, and what follows. An
interpolated n-gram model (Witten-Bell) over these symbols, estimated from the annotated text of ``boundary_text``, gives
the weight of either event; neighbouring sites whose contexts touch are chained, and forward-backward yields the
posterior of a boundary for every site. Line breaks are boundaries with certainty; within numbers, addresses and
quotations that are part of a sentence the event is impossible.

Every stretch of words between two boundaries so found has events between all its words, and between all characters in scripts
without spaces: a second n-gram model, over words and word shapes of the same annotated text without its marks, gives the
posterior of every gap, and sentences are about ``WORDS`` words long a priori. It counts where the stretch is rather speech
without punctuation than one sentence, by its words, its length and whether a mark bounds it.

Work is one pass over each text, without an exchange: one very long text costs time in proportion to its length and
memory for its sites and the words of a stretch. Defined results: null and blank texts have no sentences, a short text without marks is one sentence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.llm.boundary_text import AT_END, BEFORE_NUMBER, INSIDE, TEXT, TITLES
from cuelake.session import spread

ORDER = 5
#: A boundary is set where its posterior is at least so much.
THRESHOLD = 0.5
#: Mean length of sentences without punctuation, in words and in characters of scripts without spaces, and the words such a character counts for.
WORDS, CHARACTERS, CHARACTER = 9.0, 18.0, 0.5
#: Log odds of a stretch to be one sentence rather than speech without punctuation, how much more where a mark bounds it, and how
#: much less for each word it is long.
ONE, MARKED, LENGTH = 12.0, 12.0, 0.2
#: Weight of what the words tell beside that, as a model of a small text is too sure.
TOLD = 0.5

_CLOSERS = "\"'»”’“)\\]」』】）〕›"
_LETTER_TH = "ก-ฺเ-๎"
#: Final marks in a run with the quotes and brackets they close (a space may stand before »), line breaks, and white
#: space between Thai letters.
_SITE = re.compile(
    rf"(?P<mark>[.!?…。！？．।॥؟]+|(?<=[Ͱ-Ͽἀ-῿])[;;])(?P<close>[{_CLOSERS}]*(?:[   ]?[»”](?![^\W\d_]))?)"
    rf"|(?P<line>[\r\n\v\f\x1c-\x1e\x85  ]+)"
    rf"|(?<=[{_LETTER_TH}])(?P<thai>\s+)(?=[{_LETTER_TH}])"
)
_BEFORE = re.compile(r"\S*$")
#: A day or rank after an article or preposition that asks for one.
_ORDINAL = re.compile(r"(?<![\w])(?:der|die|das|den|dem|des|am|im|vom|zum|beim|ab|bis|seit|jede[rnms]?|ihr(?:e[rnms]?)?|mein(?:e[rnms]?)?|unser(?:e[rnms]?)?)\s+\d{1,2}$", re.IGNORECASE)
_LINE = re.compile(r"[\r\n\v\f\x1c-\x1e\x85  ]")
_ADDRESS = re.compile(r"[^\s<>()«»“”\"，。、@]{0,64}@[^\s<>()«»“”\"，。、]+|(?<![\w@])(?:[hH][tT][tT][pP][sS]?://|www\.)\S+|(?<![\w@.])[a-z0-9\-]+(?:\.[a-z0-9\-]+)+(?:/[^\s]*)?(?![\w@])")
_OPEN = {"«": "»", "„": "“”", "“": "”", "「": "」", "『": "』", "（": "）", "(": ")", "【": "】", "[": "]", "‹": "›"}

_TITLES, _NUMBER, _INSIDE, _AT_END = map(frozenset, (TITLES, BEFORE_NUMBER, INSIDE, AT_END))


def quoted_spans(line: str) -> list[tuple[int, int]]:
    """Matched quotes and brackets of a line as (open, close) offsets; straight quotes pair in turn."""
    out: list[tuple[int, int]] = []
    stack: list[tuple[str, int]] = []
    closes: Counter = Counter()  # how many open quotes each closing one could close
    straight = -1
    for m in _QUOTES.finditer(line):
        c, i = m.group(), m.start()
        if c == '"':
            if straight < 0:
                straight = i
            else:
                out.append((straight, i))
                straight = -1
        elif c in _OPEN and not (c == "“" and stack and stack[-1][0] == "„"):
            stack.append((c, i))
            closes.update(_OPEN[c])
        elif closes[c]:
            found = False
            while not found:
                opened, at = stack.pop()
                closes.subtract(_OPEN[opened])
                found = c in _OPEN[opened]
            out.append((at, i))
    return out


_QUOTES = re.compile(r"[\"«»„“”「」『』（）()【】\[\]‹›]")


def _script(c: str) -> str:
    o = ord(c)
    if 0x3040 <= o <= 0x30FF or 0x3400 <= o <= 0x9FFF or 0xF900 <= o <= 0xFAFF:
        return "CJK"
    if 0x0E00 <= o <= 0x0E7F:
        return "THAI"
    if c.isupper() or c.istitle():
        return "UP"
    if c.islower():
        return "LOW"
    if c.isdigit():
        return "DIG"
    if c.isalpha():
        return "NOCASE"
    return "OTHER"


def _left(word: str) -> str:
    """Class of what stands before a mark."""
    w = word.lstrip("\"'«“‘„([¿¡「『（")
    if not w:
        return "NONE"
    k = w.lower()
    if len(w) < 12:
        if k in _TITLES and (w[0].isupper() or not w[0].isascii() or k in ("d", "m")) and not (len(w) == 1 and w.isupper() and w.isascii() and k not in ("m", "d")):
            return "TITLE"
        if k in _AT_END and not (len(w) == 1 and w.isupper()):
            return "ATEND"
        if k in _INSIDE:
            return "INSIDE"
        if k in _NUMBER and not (len(w) == 1 and w.isupper() and w != "S"):
            return "BEFNUM"
        tail = re.split(r"[.\-’']", k)[-1]
        if "." in w and all(len(p) <= 2 for p in w.split(".")):
            return "ATEND" if w.isupper() else "INSIDE"
        if len(tail) == 1 and tail.isalpha() and w[-1].isupper():
            return "INIT"
    c = w[-1]
    s = _script(c)
    if s in ("UP", "LOW", "NOCASE"):
        if len(w) == 1:
            return "INIT" if s == "UP" else "LETTER" if s == "LOW" else "WORD"
        return "WORD"
    if s == "OTHER":
        return "WORD" if c in "º°ª%" or 0x0900 <= ord(c) <= 0x0DFF or ord(c) > 0x300 else "PUNCT"
    return s


def _mark(mark: str, close: str) -> str:
    if mark.startswith(("..", "…")) or mark.endswith(("..", "…")):
        kind = "DOTS"
    elif mark == ".":
        kind = "DOT"
    elif "?" in mark or "!" in mark:
        kind = "EXQ"
    elif mark[0] in "。！？．":
        kind = "CJKEND"
    else:
        kind = "STOP"
    return kind + "+Q" if close else kind


def _right(text: str, at: int) -> str:
    """Class of what follows from ``at`` on (white space is skipped)."""
    n = len(text)
    for i in range(at, min(n, at + 8)):
        c = text[i]
        if c.isspace():
            continue
        if c in "«“‘„¿¡「『\"([（【":
            return "OPEN"
        if c in ",;:，、；：،)]»”’'%":
            return "CONT"
        if c in "-–—":
            return "DASH"
        if c in "$€£¥+#":
            return "DIG"
        if c.isalpha() and i > at and i + 1 < n and text[i + 1] == "." and c.isupper() and c.isascii():
            return "INITIAL"
        return _script(c)
    return "END" if at >= n else "OTHER"


class BoundaryModel:
    """Interpolated n-gram model over site symbols with a hidden event."""

    def __init__(self, text: str = TEXT) -> None:
        self.counts: dict[tuple, Counter] = defaultdict(Counter)
        self.symbols: set[str] = set()
        for paragraph in text.strip().split("\n"):
            parts = paragraph.split("|")
            for join in (" ", " ", " ", ""):
                line, ends, at = "", set(), 0
                for i, part in enumerate(parts):
                    # Without a space only where marks still tell sentences apart.
                    sep = "" if i == 0 else (join if re.search(r"[.!?。！？।]$", parts[i - 1]) and not parts[i - 1].endswith("..") else " ")
                    if i and not (sep or _script(part[0]) in ("UP", "CJK") or part[0] in "¿¡「"):
                        sep = " "
                    line += sep + part
                    if i:
                        ends.add(at)
                    at = len(line)
                self._learn(line, ends)
        self.vocabulary = len(self.symbols) + 1
        self._weights: dict[tuple, tuple[float, float]] = {}

    def _learn(self, line: str, ends: set[int]) -> None:
        history: tuple = ("W",)
        last = -9
        for site in sites(line):
            if site.kind != "choice":
                continue
            if site.start_token - last > 1:
                history = ("W",)
            event = "B" if site.end in ends or site.end >= len(line) else "N"
            for s in (site.left, site.mark, event, site.gap, site.right):
                self.symbols.add(s)
                for k in range(min(len(history), ORDER - 1) + 1):
                    self.counts[history[len(history) - k :]][s] += 1
                history = (*history, s)[-(ORDER - 1) :]
            last = site.end

    def probability(self, symbol: str, history: tuple) -> float:
        p = 1.0 / self.vocabulary
        for k in range(min(len(history), ORDER - 1) + 1):
            seen = self.counts.get(history[len(history) - k :])
            if seen:
                total, kinds = sum(seen.values()), len(seen)
                p = (seen.get(symbol, 0) + kinds * p) / (total + kinds)
        return p

    def weights(self, site: tuple, before: tuple) -> tuple[float, float]:
        """Weight of (none, boundary) of a site described by its symbols, after a history."""
        key = (site, before)
        found = self._weights.get(key)
        if found is None:
            out = []
            for event in ("N", "B"):
                history, p = before, 1.0
                for s in (site[0], site[1], event, site[2], site[3]):
                    p *= self.probability(s, history)
                    history = (*history, s)[-(ORDER - 1) :]
                out.append(p)
            found = self._weights[key] = (out[0], out[1])
            if len(self._weights) > 200_000:
                self._weights.clear()
        return found


class Site:
    __slots__ = ("end", "gap", "kind", "left", "mark", "next", "right", "start_token")

    def __init__(self, end: int, nxt: int, kind: str, left: str = "", mark: str = "", gap: str = "", right: str = "", start_token: int = 0) -> None:
        self.end, self.next, self.kind, self.left, self.mark, self.gap, self.right, self.start_token = end, nxt, kind, left, mark, gap, right, start_token


def sites(text: str) -> Iterator[Site]:
    """Places where a sentence may end (``choice``), surely does (``line``) or would but for the quotation around (``inner``), in order."""
    opens: list[int] = []
    reach: list[int] = []
    closing: set[int] = set()
    taken: list[tuple[int, int]] = []
    line_end, at_taken = -1, 0
    for m in _SITE.finditer(text):
        start, end = m.span()
        if m.group("line"):
            yield Site(start, end, "line")
            continue
        if start >= line_end:
            # The line around the site: its quotes and addresses.
            begin = line_end if line_end >= 0 else 0
            nl = _LINE.search(text, start)
            line_end = nl.start() if nl else len(text)
            while begin < start and _LINE.search(text, begin, start):
                begin = _LINE.search(text, begin, start).end()
            line = text[begin:line_end]
            # Where quotes open, and how far those that opened so far reach.
            spans = sorted((a + begin, b + begin) for a, b in quoted_spans(line)) if _QUOTES.search(line) else []
            opens, closing = [a for a, _ in spans], {b for _, b in spans}
            reach = list(accumulate((b for _, b in spans), max))
            taken = [(x.start() + begin, x.end() + begin) for x in _ADDRESS.finditer(line)] if ("@" in line or "." in line) else []
            at_taken = 0
        mark = m.group("mark")
        if mark is None:  # white space in Thai
            before = bisect_left(opens, start)
            yield Site(start, end, "inner" if before and reach[before - 1] > start else "choice", "THAI", "SPACE", "S", "THAI", start)
            continue
        close = m.group("close") or ""
        mark_end = start + len(mark)
        while at_taken < len(taken) and taken[at_taken][1] <= start:
            at_taken += 1
        if at_taken < len(taken) and taken[at_taken][0] < start and mark_end < taken[at_taken][1]:
            continue  # within an address
        # Closers belong to the mark only if they close something; a straight quote that opens does not.
        if close:
            k = mark_end
            while k < end and (text[k] in "   " or k in closing or text[k] in "'’"):
                k += 1
            while k > mark_end and text[k - 1] in "   ":
                k -= 1
            end, close = k, text[mark_end:k]
        before = bisect_left(opens, start)
        kind = "inner" if before and reach[before - 1] >= end else "choice"  # inside a quotation or bracket that goes on
        nxt = text[end : end + 1]
        word = _BEFORE.search(text, max(0, start - 24), start).group()
        if mark == "." and nxt.isalnum() and not nxt.isupper() and _script(nxt) in ("LOW", "DIG"):
            continue  # within a number, address or abbreviation
        if mark == "." and nxt in "-/_@" and nxt:
            continue
        if nxt in ",;:，、؛،" and nxt:
            continue
        left = _left(word)
        if left == "DIG" and mark == "." and _ORDINAL.search(text, max(0, start - 24), start):
            left = "ORDINAL"
        gap = "E" if not nxt else "S" if nxt.isspace() else "G"
        yield Site(end, end, kind, left, _mark(mark, close), gap, _right(text, end), start - len(word))


@lru_cache(maxsize=1)
def model() -> BoundaryModel:
    return BoundaryModel()


class WordModel:
    """Trigrams of words with boundary events between them, for text without punctuation; characters of scripts without spaces are words."""

    def __init__(self, text: str = TEXT) -> None:
        rows = [[[w.lower() for w in _WORD.findall(part)] for part in line.split("|")] for line in text.strip().split("\n")]
        seen = Counter(w for line in rows for part in line for w in part)
        self.known = {w for w, n in seen.items() if n > 1}
        self.counts: dict[tuple, Counter] = defaultdict(Counter)
        gaps, ends = [0, 0], [0, 0]  # after words and after characters
        for line in rows:
            parts = [p for p in line if p]
            history = ("B",)
            for p in parts:
                for i, w in enumerate(map(self.symbol, p)):
                    for e in ((w,) if i == 0 else ("N", w)):
                        self._add(history, e)
                        history = (*history, e)[-3:]
                self._add(history, "B")
                history = (*history, "B")[-3:]
                for w in p:
                    gaps[_unspaced(w)] += 1
                ends[_unspaced(p[-1])] += 1
        self.vocabulary = len({k for c in self.counts.values() for k in c}) + 1
        # The annotated sentences are short; the events get the odds of sentences of WORDS words.
        self.shift, self.shift_unspaced = ((1 / mean) / (1 - 1 / mean) * (g - e) / e for mean, g, e in zip((WORDS, CHARACTERS), gaps, ends, strict=True))
        self._rows: dict[tuple, tuple] = {}
        self._kinds: dict[str, tuple[str, bool]] = {}

    def symbol(self, w: str) -> str:
        if w in self.known:
            return w
        if _unspaced(w):
            return "HIRA" if "぀" <= w[0] <= "ゟ" else "KATA" if "゠" <= w[0] <= "ヿ" else _script(w[0])
        return f"{_script(w[0])}{'' if w.isascii() and len(w) < 5 else '+'}"

    def _add(self, history: tuple, e: str) -> None:
        for k in range(len(history) + 1):
            self.counts[history[len(history) - k :]][e] += 1

    def probability(self, e: str, history: tuple) -> float:
        p = 1.0 / self.vocabulary
        for k in range(len(history) + 1):
            found = self.counts.get(history[len(history) - k :])
            if found:
                total, kinds = sum(found.values()), len(found)
                p = (found.get(e, 0) + kinds * p) / (total + kinds)
        return p

    def _kind(self, word: str) -> tuple[str, bool]:
        """Symbol of a word, and whether it is a character of a script without spaces."""
        found = (self.symbol(word.lower()), _unspaced(word))
        if len(word) <= 64:
            self._kinds[word] = found
            if len(self._kinds) > 200_000:
                self._kinds.clear()
        return found

    def _row(self, key: tuple) -> tuple[tuple, tuple, tuple, tuple]:
        """Weights (none, boundary) of the step from a symbol to the next, after none and after a boundary before the first;
        then the same against those of one sentence."""
        (a, unspaced), (b, _) = key
        on, new = self.probability(b, (a, "N")), self.probability(b, ("B",))
        shift = self.shift_unspaced if unspaced else self.shift
        events = [(self.probability("N", (before, a)), self.probability("B", (before, a)) * shift) for before in ("N", "B")]
        row = self._rows[key] = (*((x * on, y * new) for x, y in events), *((x / (x + y), y / (x + y) * new / on) for x, y in events))
        return row

    def steps(self, words: list[str]) -> list[tuple[tuple, tuple, tuple, tuple]]:
        kinds = [self._kinds.get(w) or self._kind(w) for w in words]
        return [self._rows.get(key) or self._row(key) for key in zip(kinds, kinds[1:], strict=False)]

    def several(self, words: list[str], steps: list[tuple[tuple, tuple, tuple, tuple]], marked: bool = False) -> float:
        """Log odds that words without any final mark between them are several sentences: how much likelier they are by the sum
        over all placements of boundaries (less likely counts as equal, as words unknown to the model look so), and the length."""
        told, n, b = 0.0, 0.0, 1.0
        for _, _, after_n, after_b in steps:
            x, y = n * after_n[0] + b * after_b[0], n * after_n[1] + b * after_b[1]
            total = x + y
            n, b = x / total, y / total
            told += math.log(total)
        unspaced = sum(map(_unspaced, words))
        return TOLD * max(0.0, told) + LENGTH * (len(words) - (1 - CHARACTER) * unspaced) - (ONE + MARKED if marked else ONE)

    def posteriors(self, words: list[str], steps: list[tuple[tuple, tuple, tuple, tuple]] | None = None) -> list[float]:
        """Posterior of a boundary after each word but the last, by forward-backward over all gaps."""
        steps = self.steps(words) if steps is None else steps
        forward = [(0.0, 1.0)]
        for row in steps:
            f = [sum(forward[-1][p] * row[p][e] for p in (0, 1)) for e in (0, 1)]
            forward.append((f[0] / (f[0] + f[1]), f[1] / (f[0] + f[1])))
        back, out = (1.0, 1.0), []
        for i in range(len(steps) - 1, -1, -1):
            n, b = forward[i + 1][0] * back[0], forward[i + 1][1] * back[1]
            out.append(b / (n + b))
            new = [sum(steps[i][p][e] * back[e] for e in (0, 1)) for p in (0, 1)]
            back = (new[0] / math.fsum(new), new[1] / math.fsum(new))
        return out[::-1]


_UNSPACED = "\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\u0e01-\u0e3a\u0e40-\u0e4e"
#: What stands between white space from its first letter or digit to its last (with vowel signs), characters of scripts without
#: spaces alone, in Thai with their vowels.
_WORD = re.compile(
    r"[\u0e40-\u0e44]?[\u0e01-\u0e2e][\u0e2f-\u0e3a\u0e45-\u0e4e]*"
    rf"|[{_UNSPACED}]"
    rf"|[^\W_](?:[^\s{_UNSPACED}]*(?:[^\W_{_UNSPACED}]|[\u0300-\u036f\u064b-\u065f\u0900-\u0963\u0971-\u0dff]))?"
)


def _unspaced(word: str) -> bool:
    c = word[0]
    return c >= "ก" and (c <= "๎" or "々" <= c <= "\u9fff" or "\uf900" <= c <= "\ufaff")


@lru_cache(maxsize=1)
def word_model() -> WordModel:
    return WordModel()


def unmarked(text: str, begin: int, end: int, marked: bool = False) -> list[tuple[int, int, float]]:
    """Gaps between the words of a stretch without a boundary, with their posteriors, as (end, start of what follows, posterior);
    none where one sentence is likelier than several. ``marked``: a final mark bounds it."""
    m = word_model()
    words = _WORD.findall(text, begin, end)
    steps = m.steps(words)
    if m.several(words, steps, marked) < 0:
        return []
    out = []
    a = None
    for b, p in zip(_WORD.finditer(text, begin, end), (0.0, *m.posteriors(words, steps)), strict=True):
        if a is not None:
            # The last white space before the word, else before what opens before a character.
            nxt = b.start()
            while nxt > a.end() and not text[nxt - 1].isspace():
                nxt -= 1
            at = nxt
            while at > a.end() and text[at - 1].isspace():
                at -= 1
            if at == nxt:
                nxt = b.start()
                while nxt > a.end() and text[nxt - 1] in _OPEN:
                    nxt -= 1
                at = nxt
            out.append((at, nxt, p))
        a = b
    return out


def posteriors(text: str) -> list[tuple[int, int, float]]:
    """(end, start of what follows, posterior of a boundary) of every site of a text and of the gaps between words where no
    site is a boundary, by forward-backward."""
    m = model()
    out: list[tuple[int, int, float]] = []
    chain: list[tuple[Site, tuple, float, float]] = []

    def close() -> None:
        """Forward-backward over sites whose contexts touch."""
        if len(chain) == 1:
            s, key, _, _ = chain[0]
            n, b = m.weights(key, ("W",))
            out.append((s.end, s.next, b / (n + b)))
        elif chain:
            weight = []
            for i, (s, key, _, _) in enumerate(chain):
                if i == 0:
                    weight.append([m.weights(key, ("W",))] * 2)
                else:
                    p = chain[i - 1][1]
                    weight.append([m.weights(key, (p[1], e, p[2], p[3])) for e in ("N", "B")])
            forward = [list(weight[0][0])]
            for w in weight[1:]:
                f = forward[-1]
                row = [f[0] * w[0][e] + f[1] * w[1][e] for e in (0, 1)]
                total = sum(row)
                forward.append([x / total for x in row])
            back = [1.0, 1.0]
            result = []
            for i in range(len(chain) - 1, -1, -1):
                n, b = forward[i][0] * back[0], forward[i][1] * back[1]
                result.append(b / (n + b))
                if i:
                    w = weight[i]
                    back = [w[p][0] * back[0] + w[p][1] * back[1] for p in (0, 1)]
                    total = sum(back)
                    back = [x / total for x in back]
            out.extend((s.end, s.next, p) for (s, _, _, _), p in zip(chain, reversed(result), strict=True))
        chain.clear()

    last = -9
    lines: list[tuple[int, int]] = []
    inner: list[int] = []  # marks that end a sentence within a quotation
    for s in sites(text):
        if s.kind == "line":
            close()
            lines.append((s.end, s.next))
            out.append((s.end, s.next, 1.0))
            continue
        key = (s.left, s.mark, s.gap, s.right)
        if s.kind == "inner":
            n, b = m.weights(key, ("W",))
            if b >= n:
                inner.append(s.end)
            continue
        if s.start_token - last > 1:
            close()
        chain.append((s, key, 0.0, 0.0))
        last = s.end
    close()
    # Events between the words of all stretches from mark to mark.
    gaps: list[tuple[int, int, float]] = []
    unmarked_ends = set(lines)
    begin, after_mark = 0, False
    for cut in (*sorted({*((end, nxt) for end, nxt, p in out if p >= THRESHOLD), *((at, at) for at in inner)}), None):
        end, nxt = cut or (len(text), len(text))
        mark = cut is not None and cut not in unmarked_ends
        gaps.extend(unmarked(text, begin, end, mark or after_mark))
        begin, after_mark = nxt, mark
    if gaps:
        taken = {end for end, _, _ in out}
        out = sorted([*out, *(g for g in gaps if g[0] not in taken)])
    return out


def sentence_spans(text: str | None) -> list[tuple[int, int]]:
    """Offsets (code points, end exclusive) of the sentences of a text, without white space around them."""
    if not text:
        return []
    out: list[tuple[int, int]] = []
    begin = 0
    for end, nxt, p in (*posteriors(text), (len(text), len(text), 1.0)):
        if p < THRESHOLD:
            continue
        a, b = begin, end
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            out.append((a, b))
        begin = nxt
    return out


def sentences(df: DataFrame, key: str, text: str = "text", with_text: bool = False) -> DataFrame:
    """Rows ``key, char_from, char_to`` (and ``sentence``), one for each sentence of a text column. Other columns drop."""
    fields = [df.schema[key], T.StructField("char_from", T.LongType()), T.StructField("char_to", T.LongType())]
    out = T.StructType([*fields, T.StructField("sentence", T.StringType())] if with_text else fields)
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, froms, tos, said = [], [], [], []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for a, z in sentence_spans(t):
                    keys.append(k)
                    froms.append(a)
                    tos.append(z)
                    if with_text:
                        said.append(t[a:z])
            columns = [keys, froms, tos, said] if with_text else [keys, froms, tos]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return spread(df.select(key, text).where(f"`{text}` IS NOT NULL")).mapInArrow(run, out)
