"""What is not speech in a recognised segment: time stamps, sound notes, speaker labels and fillers."""

from __future__ import annotations

import re
import unicodedata

# Words of sound notes (stems, in lower case), by language.
SOUND = """
music musica música musique musik музык 音楽 音乐 音樂 موسيقى संगीत μουσικ ดนตรี เพลง 음악
playing intro outro jingle theme song singing
applause applauds clapping clap aplauso aplausos applaudissement applaus beifall аплодисмент 拍手 掌声 鼓掌 تصفيق तालियां तालियाँ χειροκρότ ปรบมือ 박수
laughter laughs laughing laugh chuckles giggles risas risa risos risada rires rire gelächter lachen lacht смех смеёт 笑い 笑声 笑 ضحك हंसी हँसी γέλι หัวเราะ 웃음
inaudible unintelligible indistinct inaudivel inaudível ininteligible inintelligible unverständlich неразборчиво 聞き取れない 听不清 غير مسموع अस्पष्ट ακατάληπτ 들리지
crosstalk overlapping chatter noise ruido ruído bruit geräusch rauschen шум 雑音 噪音 ضوضاء शोर θόρυβ เสียง 소음 잡음
coughs cough coughing tos tosse toux husten hustet кашель 咳 咳嗽 سعال खांसी βήχ ไอ 기침
sighs sigh breath breathing sneezes sniffs clears throat suspiro soupir seufzt вздох
door closes opens slams knocks knocking phone rings ringing bell beep beeps puerta porte porta tür дверь ドア 门
silence pause silencio silêncio stille тишина 沈黙 沉默 صمت
background static cheering cheers whistle whistles footsteps typing thunder wind
""".split()

# Hesitations that are never words of the sentence, in lower case.
HESITATIONS = """
um umm uh uhm er erm hmm hm mhm mmm mm eh em euh heu hum hein hã äh ähm öh öhm
м-м э-э эм эээ ммм мм え えー えーと えっと あのー うーん うん 嗯 呃 额 آه ممم إمم اه
अं हम्म उम εε εεε χμ εμ เอ่อ อืม 음 어 으음
""".split()
# Phrases that fill a pause when set off by a comma or dots, in lower case.
PHRASES = [
    "you know", "o sea", "este", "enfin bon", "ben", "bah", "né", "tipo", "é", "also äh", "ну это", "λοιπόν εε", "แบบว่า",
    "这个嘛", "那个", "这个", "يعني", "मतलब", "तो", "그", "그니까", "그러니까", "저기", "뭐랄까", "i mean", "sort of", "kind of", "pois", "então", "halt", "na",
]
#: Names of parts in a talk that may stand as a label without more.
ROLES = "host guest caller moderator interviewer interviewee narrator presenter operator agent customer speaker".split()
UNKNOWN = {"", "?", "??", "unknown", "unk", "n/a", "na", "none", "null", "speaker ?", "speaker unknown", "unknown speaker", "-", "--"}

STAMP = r"(?:[\[(（]\s*\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d{1,3})?\s*[\])）]|(?<![\d:.,])\d{1,3}:\d{2}:\d{2}(?:[.,]\d{1,3})?(?![\d:]))"
_STAMP = re.compile(STAMP)
_HEAD_STAMP = re.compile(r"^\s*\d{1,3}:\d{2}(?:[.,]\d{1,3})?(?=\s|$)")
_BOXED = re.compile(r"\[[^\[\]]*\]|【[^【】]*】|\([^()]*\)|（[^（）]*）|<[^<>]{1,40}>|\*[^*\n]{1,40}\*|♪[^♪]*♪|[♪♫]+")
_WORD = re.compile(r"[^\W_]+(?:['’\-][^\W_]+)*", re.UNICODE)
_SPEAKER = re.compile(r"^(?:speaker|spkr|spk|s|sprecher|sprecherin|locuteur|hablante|orador|falante|спикер|話者|说话人|참가자)[\s_\-#.]*0*(\d+)$")
_HEAD = re.compile(r"^\s*(?:(>>+|[-–—])\s*)?(?:\[([^\[\]:]{1,30})\]\s*:?|\(([^():]{1,30})\)\s*:|([^\W\d_][\w .\-'’]{0,28}?)\s*[:：](?=\s|$))\s*")
_SPACE = re.compile(r"\s+")


def _is_sound(inside: str) -> bool:
    words = [w.lower() for w in _WORD.findall(inside)]
    return bool(words) and len(words) <= 4 and any(w == s or (len(s) > 3 and w.startswith(s)) or (not s.isascii() and s in w) for w in words for s in SOUND)


def canonical_speaker(label: str | None) -> str | None:
    """One key for all spellings of a speaker; null for null, blank and unknown ones."""
    if label is None:
        return None
    s = unicodedata.normalize("NFKC", label).casefold()
    s = re.sub(r"(?<=\w)\s*\([^)]*\)\s*$", "", s)
    s = _SPACE.sub(" ", s.strip(" \t\r\n[](){}<>:：-–—*\"'.,")).strip()
    if s in UNKNOWN:
        return None
    m = _SPEAKER.match(s)
    return f"speaker {int(m.group(1))}" if m else s


def _is_label(inside: str, marked: bool) -> bool:
    """Whether text at the head, before a colon or in brackets, names a speaker."""
    key = canonical_speaker(inside)
    if key is None or len(key) > 28:
        return False
    if _SPEAKER.match(key) or key in ROLES or re.match(r"^speaker \d+$", key):
        return True
    words = key.split()
    if len(words) > 2:
        return False
    if marked:
        return not _is_sound(inside)
    first = inside.strip()
    return len(words) == 1 and len(first) > 1 and first[0].isupper() and first.isalpha() and "LATIN" in unicodedata.name(first[0], "") and not _is_sound(inside)


def head_label(text: str) -> tuple[str | None, str]:
    """The speaker named at the head of a text (after stamps and sound notes) and the text after it."""
    rest = text
    for _ in range(6):
        rest = rest.lstrip()
        m = _STAMP.match(rest) or _HEAD_STAMP.match(rest)
        if m:
            rest = rest[m.end() :]
            continue
        m = _BOXED.match(rest)
        if m and (m.group(0)[0] in "<*♪♫" or _is_sound(m.group(0))):
            rest = rest[m.end() :]
            continue
        break
    m = _HEAD.match(rest)
    if m:
        mark, boxed, round_, bare = m.groups()
        inside = boxed or round_ or bare
        if _is_label(inside, bool(mark)):
            return canonical_speaker(inside), rest[m.end() :]
        if boxed and not _is_sound(boxed) and boxed.strip()[:1].isupper() and len(boxed.split()) == 1:
            return canonical_speaker(boxed), rest[m.end() :]
    return None, text


def without_notes(text: str, fill: str = " ") -> str:
    """The text with time stamps and sound notes replaced (``fill`` may keep offsets: one character for each)."""
    put = (lambda m: fill * len(m.group(0))) if len(fill) == 1 and fill != " " else (lambda m: " ")
    text = _STAMP.sub(put, text)
    text = _HEAD_STAMP.sub(put, text)

    def boxed(m: re.Match) -> str:
        s = m.group(0)
        return put(m) if s[0] in "<*♪♫" or _is_sound(s) else s

    return _BOXED.sub(boxed, text)


_PHRASES = sorted({*PHRASES, *HESITATIONS}, key=len, reverse=True)
_ONLY_FILLERS = re.compile(r"^(?:\W*(?:" + "|".join(map(re.escape, _PHRASES)) + r")(?!\w))*\W*$", re.IGNORECASE)
_HESITATION = re.compile(r"(?<![\w'’\-])(?:" + "|".join(map(re.escape, sorted(HESITATIONS, key=len, reverse=True))) + r")(?![\w'’\-])\s*(?:[,，、،]|\.\.\.|…)?\s*", re.IGNORECASE)
_PAUSE = re.compile(r"(?<![\w'’\-])(?:" + "|".join(map(re.escape, sorted(PHRASES, key=len, reverse=True))) + r")\s*(?:[,，、،]|\.\.\.|…)(?!\w)\s*", re.IGNORECASE)


def speech(text: str) -> tuple[str | None, str]:
    """The speaker that the head of a text names, and what is said: without stamps, notes, label and fillers."""
    label, rest = head_label(text)
    if _NOTED.search(rest):
        rest = without_notes(rest)
    if _ONLY_FILLERS.match(rest):
        return label, ""
    said = _SPACE.sub(" ", rest).strip()
    return label, said


_NOTED = re.compile(r"[\[(（【<*♪♫]|\d:\d")


def spoken(text: str) -> str:
    """What is said in a text; empty if nothing is."""
    return speech(text)[1]


def cleaned(s: str) -> str:
    """A readable form of what is said: without hesitations and pause phrases inside, spaces before marks mended."""
    if not s:
        return ""
    t = _SPACE.sub(" ", _PAUSE.sub("", _HESITATION.sub("", s))).strip()
    t = re.sub(r"\s+([,.!?;:，。！？、،؟।])", r"\1", t) if not re.search(r"\s[!?;:»]", s) else t
    if t and s[:1].isupper() and t[:1].islower():
        t = t[0].upper() + t[1:]
    return t if any(ch.isalnum() for ch in t) else s


def clean_utterance(text: str) -> str:
    return cleaned(spoken(text))
