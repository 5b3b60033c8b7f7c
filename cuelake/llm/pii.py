"""Personal details in free text: finding them and replacing them by typed placeholders (problem 4).

Found are e-mail addresses (also spelt out), phone numbers, personal document numbers, street addresses with a house
number and names of persons. A placeholder names the type and a pseudonym: numbers and dates that pass the checks of
their kind are permuted within their format by a keyed Feistel network, so the same number, however it is written, gets
the same pseudonym in every document, and the holder of the key can turn it back; texts (addresses, names, e-mails) get
a keyed tag. Work is one pass over each text without an exchange.

Defined results: null stays null, an empty text stays empty; details do not overlap, the leftmost and longest wins;
time stamps, sound notes, speaker labels and fillers are no details and do not tear one apart.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.llm.noise import HESITATIONS, head_label, without_notes
from cuelake.session import arrow_batch

TYPES = ("email", "phone", "national_id", "address", "person")

# ---- keyed permutation within a format -------------------------------------------------------------------------------

ROUNDS = 10


def _round(key: bytes, tweak: str, i: int, half: int, modulus: int) -> int:
    d = hmac.new(key, f"{tweak}:{i}:{half}".encode(), hashlib.sha256).digest()
    return int.from_bytes(d, "big") % modulus


def _feistel(a: int, b: int, size: tuple[int, int], tweak: str, key: bytes, back: bool) -> tuple[int, int]:
    """A keyed permutation of the pairs below ``size``: rounds add to one half what the other one and the key say."""
    for i in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
        sign = -1 if back else 1
        if i % 2 == 0:
            a = (a + sign * _round(key, tweak, i, b, size[0])) % size[0]
        else:
            b = (b + sign * _round(key, tweak, i, a, size[1])) % size[1]
    return a, b


def _radix(c: str) -> int:
    return 10 if c.isdigit() else 26 if "A" <= c <= "Z" or "a" <= c <= "z" else 1


def permute_format(text: str, key: bytes, back: bool = False) -> str:
    """A keyed permutation of all texts of one format: digits and Latin letters are the digits of one number of mixed radix,
    which goes through the Feistel network as a whole; case, separators and everything else keep their places."""
    places = [(i, _radix(c)) for i, c in enumerate(text) if _radix(c) > 1]
    if not places:
        return text
    read = lambda c: unicodedata.digit(c) if c.isdigit() else ord(c.upper()) - 65
    half = len(places) // 2
    size, value = [1, 1], [0, 0]
    for n, (i, r) in enumerate(places):
        side = int(n >= half)
        size[side] *= r
        value[side] = value[side] * r + read(text[i])
    a, b = _feistel(value[0], value[1], (size[0], size[1]), "/".join(str(r) for _, r in places), key, back)
    out = list(text)
    for side, part in ((1, places[half:]), (0, places[:half])):
        x = (a, b)[side]
        for i, r in reversed(part):
            x, d = divmod(x, r)
            out[i] = str(d) if r == 10 else chr(d + (97 if text[i].islower() else 65))
    return "".join(out)


def permute_digits(digits: str, key: bytes, back: bool = False) -> str:
    """A keyed permutation of all strings of so many decimal digits."""
    return permute_format(digits, key, back)


def permute_number(value: int, size: int, key: bytes, back: bool = False) -> int:
    """A keyed permutation of 0 .. size - 1: the digit permutation, walked until it falls into the range."""
    width = len(str(size - 1))
    while True:
        value = int(permute_digits(f"{value:0{width}d}", key, back))
        if value < size:
            return value


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def permute_date(day: dt.date, key: bytes, back: bool = False) -> dt.date:
    return dt.date.fromordinal(_FIRST + permute_number(day.toordinal() - _FIRST, _LAST - _FIRST + 1, key, back))


# Country calling codes of one and two digits; all others have three.
_CODES = {"1", "7", *"20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()}


def _national(text: str) -> tuple[str, list[int]]:
    """The national number of a phone number without its trunk digit, and the places of its digits in the text."""
    places = [i for i, c in enumerate(text) if c.isdigit()]
    d = "".join(str(unicodedata.digit(text[i])) for i in places)
    skip = 0
    if text.lstrip().startswith("+"):
        skip = next((n for n in (1, 2) if d[:n] in _CODES), 3)
        if d[skip : skip + 1] == "0":
            skip += 1  # (0) after the country code
    elif d.startswith("0") or (len(d) == 11 and d.startswith("1")):
        skip = 1
    return d[skip:], places[skip:]


def permute_phone(text: str, key: bytes, back: bool = False) -> str:
    """The national number permuted among those of its length that don't begin with 0; country code, trunk digit and the way
    it is written stay, so one number written nationally and internationally keeps one national number."""
    number, places = _national(text)
    new = number
    while True:
        new = permute_digits(new, key, back)
        if new[:1] != "0" or number[:1] == "0":
            break
    out = list(text)
    for i, c in zip(places, new, strict=True):
        out[i] = c
    return "".join(out)


_DNI = "TRWAGMYFPDXBNJZSQVHLCKE"


def _mod11(digits: str) -> str:
    out = digits
    for _ in range(2):
        s = sum(int(d) * w for d, w in zip(out, range(len(out) + 1, 1, -1), strict=True))
        out += str((s * 10) % 11 % 10)
    return out


def pseudonym(kind: str, text: str, key: bytes) -> str:
    """The pseudonym of a detail: within the format for numbers, a keyed tag of 128 bits for texts."""
    if kind == "phone":
        return permute_phone(text, key)
    if kind == "national_id":
        cue = re.match(r"\W*[^\W\d_]{3,}(?:\W+(?:no|nr|nº|n\.º|number)\b\.?)?\W+(?=[A-Za-z0-9])", text)
        t = text[cue.end() :] if cue else text
        d = re.sub(r"\D", "", t)
        out = list(t)
        at = [i for i, c in enumerate(t) if c.isdigit()]
        m = re.fullmatch(r"(\d{8})-?([A-Z])", t)
        if m and _DNI[int(d) % 23] == m.group(2):
            new = permute_digits(d, key)
            out[-1] = _DNI[int(new) % 23]
        elif re.fullmatch(r"\d{3}\.\d{3}\.\d{3}-\d{2}|\d{11}", t) and _mod11(d[:9]) == d:
            new = _mod11(permute_digits(d[:9], key))
        elif re.fullmatch(r"\d{3}-\d{2}-\d{4}|\d{9}", t):
            new = permute_digits(d, key)
        else:
            # Spaces and dashes are no part of the value, so they don't change its pseudonym.
            kept = [i for i, c in enumerate(t) if _radix(c) > 1]
            for i, c in zip(kept, permute_format("".join(t[i] for i in kept), key), strict=True):
                out[i] = c
            return "".join(out)
        for i, c in zip(at, new, strict=True):
            out[i] = c
        return "".join(out)
    same = re.sub(r"\W+", " ", unicodedata.normalize("NFKC", text).casefold()).strip()
    if kind == "email":
        same = re.sub(r"\s", "", re.sub(r"\s*\(at\)\s*|\s+at\s+", "@", re.sub(r"\s+dot\s+", ".", text.casefold())))
    return hmac.new(key, f"{kind}:{same}".encode(), hashlib.sha256).hexdigest()[:32]


# ---- finding -----------------------------------------------------------------------------------------------------------

_UP = "A-ZÀ-ÖØ-ÞĀŁŚŽŠČİ"
_NAMEWORD = rf"[{_UP}](?:[a-zà-öø-ÿāēīōūłńśźżščřěůığ]+|(?<=[OD])['’][{_UP}][a-zà-öø-ÿ]+)"
_PARTICLE = r"(?:(?:de|da|do|dos|del|della|van|von|der|di|la|le|du|al|el|bin|ibn)\s+){1,2}"
_FAMILY = rf"(?:{_PARTICLE})?{_NAMEWORD}(?:-{_NAMEWORD})*"

_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+\-]*(?:@|\s+@\s*|\s*@\s+|\s*[\(\[]\s*(?:at|AT|At)\s*[\)\]]\s*)[A-Za-z0-9][A-Za-z0-9\-]*(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}"
    r"|[A-Za-z0-9][\w+\-]*(?:\s+dot\s+[A-Za-z0-9][\w+\-]*)*\s+at\s+[A-Za-z0-9][A-Za-z0-9\-]*(?:\s+dot\s+[A-Za-z0-9\-]{2,})+"
    r"|[A-Za-z0-9][\w.+\-]*\s+at\s+[A-Za-z0-9][A-Za-z0-9\-]*(?:\s+dot\s+[A-Za-z0-9\-]{2,})+"
)

_B, _E = r"(?<![\w.@/\-])", r"(?![\w@/]|-\d|\.\d)"
_BC, _EC = r"(?<![A-Za-z0-9.@/\-])", r"(?![A-Za-z0-9@/]|-\d|\.\d)"  # other scripts may touch the number
_ID = re.compile(
    rf"{_BC}(?:(?:[Pp]assport|[Pp]asaporte|[Pp]asseport|[Pp]assaporte|[Rr]eisepass)\s+(?:(?:no|nr|nº|n\.º|number)\.?\s+)?)?[A-Z]{{1,2}}\d{{6,8}}{_EC}"
    rf"|{_BC}[A-Z]{{2}}\s?\d{{2}}\s?\d{{2}}\s?\d{{2}}\s?[A-D]{_EC}"
    rf"|{_BC}\d{{3}}-\d{{2}}-\d{{4}}{_EC}"
    rf"|{_BC}\d{{3}}\.\d{{3}}\.\d{{3}}-\d{{2}}{_EC}"
    rf"|{_BC}[XYZ]?\d{{7,8}}-?[A-Z]{_EC}"
    rf"|{_BC}\d{{9}}{_EC}"
)
# Words before which a bare number is of a document.
_ID_CUE = re.compile(
    r"(?:identity|national|insurance|passport|security|tax)\s+(?:number|no\.?|card)|\bID\b|identidad|identit[éà]|identidade|Ausweis|Personal|документ|паспорт|ταυτότητα|هوية|पहचान|身份证|証明|주민|บัตรประชาชน|\bit\s+is\b|\bCPF\b|\bDNI\b|\bNIF\b|\bSSN\b",
    re.IGNORECASE,
)
_PHONE_CUE = re.compile(r"\b(?:call|phone|tel|mobile|cell)|llám|teléfono|número\s+es|telefon|téléphone|numéro\s+est|Nummer\s+ist|numero|телефон|τηλέφωνο|رقم|नंबर|电话|電話|번호|เบอร์", re.IGNORECASE)
_PHONE = re.compile(
    rf"{_BC}(?:\+\d{{1,3}}[\s.\-]?(?:\(0\)\s?)?\d{{1,5}}(?:[\s.\-]?\d{{2,6}}){{1,5}}"
    rf"|(?:\+?1[\s.\-]?)?\(\d{{3}}\)\s?\d{{3}}[\s.\-]?\d{{4}}"
    rf"|(?:1[\s.\-])?\d{{3}}[\s.\-]\d{{3}}[\s.\-]\d{{4}}"
    rf"|0\d{{1,4}}[\s/.\-]\d{{2,8}}(?:[\s.\-]\d{{2,6}}){{0,4}}"
    rf"|\(0\d{{1,4}}\)\s?\d{{3,8}}(?:[\s.\-]\d{{2,6}}){{0,3}}"
    rf"|0\d{{9,10}}|1?\d{{10}}){_EC}"
)

_ROAD_EN = r"(?:Lane|Road|Street|Avenue|Court|Drive|Close|Terrace|Crescent|Boulevard|Square|Grove|Hill|Gardens|Mews|Parade|Row|Walk|Way|Place|St|Rd|Ave|Blvd|Dr|Ln)\b\.?"
_CAP = rf"[{_UP}][\w'’\-]*"
_OF = r"(?:(?:de|del|da|do|dos|das|des|du|la|las|los|le|les|l['’]|d['’]|von|der|dem)\s*)"
_UNIT = r"(?:(?:[Ff]lat|[Aa]pt|[Aa]partment|[Uu]nit|[Ss]uite|[Rr]oom)\.?\s*(?:no\.?\s*)?\d{1,4}[A-Za-z]?\s*,\s*)"
_DE_ROAD = r"(?:straße|strasse|str\.|gasse|weg|platz|hof|kamp|winkel|allee|ring|damm|ufer|steig|berg|markt|graben|tor|wall|stieg|pfad|garten|feld|park|chaussee|zeile|grund|bogen|anger|brücke|wiese)"
_ADDRESS = re.compile(
    rf"{_UNIT}?{_B}\d{{1,5}}[A-Za-z]?,?\s+(?:{_CAP}\s+){{1,4}}{_ROAD_EN}(?:\s*,\s*(?:[Ff]lat|[Aa]pt|[Uu]nit)\.?\s*\d{{1,4}}[A-Za-z]?)?"
    rf"|{_B}\d{{1,5}}\s*(?:bis|ter|quater)?\s*,?\s+(?:rue|avenue|boulevard|place|chemin|impasse|quai|allée|allee|route|cours|square|passage)\s+(?:{_OF}){{0,3}}{_CAP}(?:[\s\-]+(?:{_OF}){{0,2}}{_CAP}){{0,3}}"
    rf"|(?<![\w])(?:[Cc]alle|[Cc]/|[Aa]venida|[Aa]vda\.?|[Aa]v\.|[Pp]laza|[Pp]aseo|[Cc]amino|[Rr]ua|[Tt]ravessa|[Pp]raça|[Ll]argo|[Aa]lameda|[Ee]strada)\s*(?:{_OF}){{0,3}}{_CAP}(?:\s+(?:{_OF}){{0,2}}{_CAP}){{0,3}}\s*,?\s*(?:n\.?\s?[ºo°]\.?\s*|núm\.\s*)?\d{{1,5}}[A-Za-z]?(?!\d)(?:\s*,\s*\d{{1,3}}\.?\s?[ºª°]\.?\s*(?:[A-Z]\b|esq\.?º?|dto\.?º?|dcha\.?|izq\.?|frente)?\.?º?)?"
    rf"|(?<![\w])(?:(?:{_CAP}\s+){{0,2}}(?:Straße|Strasse|Allee|Platz|Weg|Gasse|Ring|Damm|Ufer)|(?:Am|Im|An\s+der|Auf\s+dem|Zum|Zur|Alte[rn]?|Neue[rn]?|Unter\s+den|Hinter\s+dem)\s+{_CAP}|[{_UP}][\w\-]*{_DE_ROAD})\s+\d{{1,4}}\s?[a-z]?\b(?!\s*(?:dB|Euro|Meter|Minuten|Uhr|\.\d|:\d))"
    rf"|(?:ул\.|улица|пр\.|проспект|пер\.|переулок)\s*[А-ЯЁ][\w\-]*(?:\s+[А-ЯЁ][\w\-]*)?\s*,?\s*(?:д\.|дом)?\s*\d{{1,4}}[а-я]?(?:\s*,\s*кв\.\s*\d+)?"
    rf"|(?:οδός|οδό|λεωφόρος)\s+[Α-ΩΆ-Ώ][\w\-]*(?:\s+[Α-ΩΆ-Ώ][\w\-]*)?\s+\d{{1,4}}"
    rf"|(?:شارع)\s+[\w\s]{{2,30}}?\s+\d{{1,4}}|ถนน\s?\S{{2,30}}\s+\d{{1,4}}"
)

# Words that begin a sentence or a noun phrase in capitals and are no given or family names.
_NO_NAME = frozenset(
    """
the a an this that these those is are was were do does did has have had can could will would shall should may might must without with within while when where who what why how which whose
because before after behind during then there here today yesterday tomorrow now our my your his her their its we you he she they it i in on at to from for by of about into over under between
half everyone everybody nobody somebody anyone someone everything nothing call send go come take give see look please passport anyway well so right also just both each
monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december speaker host guest caller moderator
dr mr mrs ms prof st sr sra dra mme mlle hr fr herr frau miss sir lady lord professor doctor no yes hello dear thanks thank music playing intro north south east west new old great upper lower
street road lane avenue court drive square lake river mountain mount hill park bridge valley island bay sea ocean city town village county university college school church hospital hotel station airport museum club
el la los las un una unos unas mi mis tu su sus nuestro nuestra nuestros nuestras sin con de del al en por para según hoy luego entonces cuando mientras como qué quién cuál cómo dónde está es son era lo le les
calle avenida plaza paseo camino rua travessa praça largo alameda entre mira oye escribe llama gracias pues bueno
le les un une des mon ma mes notre nos votre vos sans avec dans pour par sur selon aujourd hier demain ensuite alors puis comme quand qui que quel quelle quoi où est sont merci bon bref
der die das den dem des ein eine einen einem einer eines mein meine meinen meiner unser unsere unseren unserer dein deine sein seine ihr ihre ohne mit für von vom zu zum zur bei beim im in am an auf aus nach vor über unter hinter
und oder aber wenn weil als wie was wer wo warum heute gestern morgen dann siehe schreiben sie es wir ich du er hat haben ist sind war na ja also
o os as um uma uns umas meu minha meus minhas nosso nossa nossos nossas sem com em no na nos nas por para segundo hoje ontem amanhã depois então quando enquanto como quem qual onde está são era obrigado bom
""".split()
)
_TITLE = re.compile(
    r"(?<![\w])(?:Dr|Dra|Prof|Profa|Mr|Mrs|Ms|Mx|Sr|Sra|Srta|Mme|Mlle|M|Hr|Herr|Frau|Señora?|Senhora?|Professor|Professora|Doctor|Doctora|Doktor|Don|Doña|Miss|Sir|Madame|Monsieur)\b\.?\s+"
    rf"(?P<name>(?:(?:{_NAMEWORD}|[{_UP}]\.)\s+){{0,2}}{_FAMILY})"
)
_CYR_TITLE = re.compile(r"(?<![\w])(?:г-н|г-жа|проф\.|д-р|господин|госпожа|κ\.|κα\.?|δρ\.?|Δρ\.?)\s+(?P<name>[А-ЯЁΑ-ΩΆ-Ώ][\w\-]+(?:\s+[А-ЯЁΑ-ΩΆ-Ώ][\w\-]+)?)")
# Endings of Russian family names.
_CYR_PERSON = re.compile(r"(?<![\w@.\-])(?P<name>[А-ЯЁ][а-яё]+\s+(?:[А-ЯЁ][а-яё]+(?:ович|евич|овна|евна|ична)\s+)?[А-ЯЁ][а-яё]*(?:ов|ова|ев|ева|ёв|ёва|ин|ина|ын|ына|ский|ская|цкий|цкая|енко|швили|дзе))(?![\w@])")
# What comes before a name of one word only. And titles in scripts without capitals.
_NAME_IS = re.compile(rf"(?:[Mm]y\s+name\s+is|[Mm]ein\s+Name\s+ist|\b[Ii]ch\s+heiße|[Mm]e\s+llamo|[Mm]i\s+nombre\s+es|[Jj]e\s+m['’]appelle|[Mm]on\s+nom\s+est|[Cc]hamo-me|[Mm]eu\s+nome\s+é)\s+(?P<name>{_FAMILY})(?![\w@'’]|\.\w)")
_NAME_IS_CYR = re.compile(r"[Мм]еня\s+зовут\s+(?P<name>[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+){0,2})|(?:[Мμ]ε\s+λένε)\s+(?P<other>[Α-ΩΆ-Ώ][\w]+(?:\s+[Α-ΩΆ-Ώ][\w]+)?)")
_PERSON = re.compile(rf"(?<![\w@.\-'’])(?P<given>{_NAMEWORD}(?:-{_NAMEWORD})?)\s+(?:(?P<mid>[{_UP}])\.\s+)?(?P<family>{_FAMILY})(?![\w@'’]|\.\w)")
# Words before a name that give a person away.
_CUE_LEFT = re.compile(r"(?<!\w)(?:name\s+is|names\s+are|ask\s+for|thank|thanks\s+to|called|named|with|by|and|heiße|heißt|Name\s+ist|danken?|mit|von|und|bei|llamo|llama|nombre\s+es|gracias\s+a|con|por|y|e|appelle|nom\s+est|[Mm]erci\s+à|avec|par|et|chamo|chama|nome\s+é|[Oo]brigad[oa]\s+a|com)[\s,]*$")
_GERMAN = re.compile(r"(?<![\w])(?:der|die|das|und|ein|eine|mit|dem|den|zum|zur|ist|nicht|im|am|wir|ich|wohne|rief|noch|für)(?![\w])", re.IGNORECASE)
_HES = re.compile(r"(?<![\w'’\-])(?:" + "|".join(map(re.escape, sorted(HESITATIONS, key=len, reverse=True))) + r"|you\s+know)(?![\w'’\-])\s*(?:,|\.\.\.|…)", re.IGNORECASE)


def masked(text: str) -> str:
    """The text with notes, stamps, the head label and fillers blanked, character for character."""
    label, rest = head_label(text)
    out = text
    if label is not None:
        out = " " * (len(text) - len(rest)) + rest
    out = without_notes(out, "\x00").replace("\x00", " ")
    return _HES.sub(lambda m: " " * len(m.group()), out)


def _digits(s: str) -> int:
    return sum(c.isdigit() for c in s)


def details(text: str | None) -> list[tuple[int, int, str]]:
    """(from, to, type) of the personal details of a text, in order, without overlaps."""
    if not text or not text.strip():
        return []
    t = masked(text)
    if len(t) != len(text):
        t = text
    has_digit = any(c.isdigit() for c in t)
    found: list[tuple[int, int, str]] = []
    taken: list[tuple[int, int]] = []

    def put(a: int, b: int, kind: str) -> bool:
        while b > a and t[b - 1] in " ,;":
            b -= 1
        if any(a < y and x < b for x, y in taken):
            return False
        taken.append((a, b))
        found.append((a, b, kind))
        return True

    if "@" in t or "at" in t or "AT" in t:
        for m in _EMAIL.finditer(t):
            put(m.start(), m.end(), "email")
    if has_digit:
        for m in _ADDRESS.finditer(t):
            put(m.start(), m.end(), "address")
        for m in _ID.finditer(t):
            s = m.group()
            if re.fullmatch(r"\d{9}", s):
                before = t[max(0, m.start() - 60) : m.start()]
                cues = [x.end() for x in _ID_CUE.finditer(before)], [x.end() for x in _PHONE_CUE.finditer(before)]
                if cues[1] and (not cues[0] or max(cues[1]) > max(cues[0])):
                    continue
            put(m.start(), m.end(), "national_id")
        for m in _PHONE.finditer(t):
            if 9 <= _digits(m.group()) <= 15:
                put(m.start(), m.end(), "phone")
    german = len(_GERMAN.findall(t)) >= 2
    at, run = 0, None
    while True:
        m = _PERSON.search(t, at)
        if not m:
            break
        given, family = m.group("given").lower(), m.group("family").lower()
        if given in _NO_NAME or any(w in _NO_NAME for w in re.split(r"[\s\-]+", family)[-1:]):
            at, run = m.start() + max(1, len(m.group("given"))), None
            continue
        ok = True
        nxt = re.match(rf"\s+{_CAP}", t[m.end() :])
        if nxt and re.match(rf"\s+(?:{_ROAD_EN}|Lake|River|Hill|Park|Bridge|Valley|Square|Market|University|Hotel|School)\b", t[m.end() :]):
            ok = False
        if german and nxt and re.match(rf"\s+{_NAMEWORD}(?!\w)", t[m.end() :]):
            # A noun before a name ("Kollegin Anna Schmidt"): what stands before it still counts as the cue.
            run, at = (m.start() if run is None else run), m.start("family")
            continue
        first, run = (m.start() if run is None else run), None
        before = t[max(0, first - 24) : first]
        if re.search(r"(?:[Cc]alle|[Cc]/|[Aa]venida|[Rr]ua|[Tt]ravessa|[Pp]laza|[Pp]raça|rue|avenue|[Ss]t\.|[Ss]ainte?|in\s+der|[Aa]m|\d)\s+(?:del|de|da|do|la|des|du|der)?\s*$", before):
            ok = False
        if ok and not m.group("family")[0].isupper() and not _CUE_LEFT.search(before):
            ok = False
        if ok and german and not _CUE_LEFT.search(before):
            ok = False
        if ok:
            put(m.start(), m.end(), "person")
        at = m.end()
    for rx in (_CYR_PERSON, _NAME_IS, _NAME_IS_CYR):
        for m in rx.finditer(t):
            name = "name" if m.group("name") else "other"
            if m.group(name).split()[0].lower() not in _NO_NAME:
                put(m.start(name), m.end(name), "person")
    for rx in (_TITLE, _CYR_TITLE):
        for m in rx.finditer(t):
            words = re.split(r"[\s\-.]+", m.group("name").lower())
            if not any(w in _NO_NAME for w in words if w not in ("de", "da", "do", "del", "la", "le", "der", "von")):
                put(m.start("name"), m.end("name"), "person")
    found.sort()
    return found


#: Dates in digits: year first (also with 年月日) or last.
_DATE = re.compile(
    r"(?<![\w.\-/])(?:(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{1,2})(?P=s)(?P<d>\d{1,2})|(?P<a>\d{1,2})(?P<t>[-/.])(?P<b>\d{1,2})(?P=t)(?P<z>\d{4}))(?![\w]|[.\-/:]\d)"
    r"|(?<!\d)(?P<cy>\d{4})年(?P<cm>\d{1,2})月(?P<cd>\d{1,2})日"
)


def _day(year: str, month: str, day: str) -> dt.date | None:
    try:
        found = dt.date(int(year), int(month), int(day))
    except ValueError:
        return None
    return found if _FIRST <= found.toordinal() <= _LAST else None


def date_pseudonym(m: re.Match, key: bytes, back: bool = False) -> str:
    """A valid date permuted within its format; others as they are. Day and month that can be read both ways are day first."""
    pad = lambda n, like: str(n) if len(like) == 1 else f"{n:02d}"
    if m["z"]:
        a, t, b, z = m["a"], m["t"], m["b"], m["z"]
        if day := _day(z, b, a):
            new = permute_date(day, key, back)
            return f"{pad(new.day, a)}{t}{pad(new.month, b)}{t}{new.year}"
        if day := _day(z, a, b):
            new = permute_date(day, key, back)
            while new.day <= 12:  # stays one that can be read month first only
                new = permute_date(new, key, back)
            return f"{pad(new.month, a)}{t}{pad(new.day, b)}{t}{new.year}"
        return m.group()
    year, month, day_ = (m["y"], m["m"], m["d"]) if m["y"] else (m["cy"], m["cm"], m["cd"])
    if not (day := _day(year, month, day_)):
        return m.group()
    new = permute_date(day, key, back)
    month, day_ = pad(new.month, month), pad(new.day, day_)
    return f"{new.year}{m['s']}{month}{m['s']}{day_}" if m["y"] else f"{new.year}年{month}月{day_}日"


def _dates_replaced(text: str, key: bytes) -> str:
    def one(m: re.Match) -> str:
        new = date_pseudonym(m, key)
        return m.group() if new == m.group() else f"<date {new}>"

    return _DATE.sub(one, text)


def redacted(text: str | None, key: bytes) -> str | None:
    """The text with a typed placeholder, ``<type pseudonym>``, for each detail and each valid date."""
    if text is None:
        return None
    out, at = [], 0
    for a, b, kind in details(text):
        out.append(_dates_replaced(text[at:a], key))
        out.append(f"<{kind} {pseudonym(kind, re.sub(r'\s+', ' ', masked(text)[a:b]).strip(), key)}>")
        at = b
    out.append(_dates_replaced(text[at:], key))
    return "".join(out)


@lru_cache(maxsize=4)
def _arrow(schema: T.StructType) -> pa.Schema:
    return to_arrow_schema(schema)


def find_details(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Rows ``keys..., pii_type, occurrence, char_from, char_to``; occurrences of a type are counted from 1."""
    out = T.StructType([*(df.schema[k] for k in keys), T.StructField("pii_type", T.StringType()), T.StructField("occurrence", T.IntegerType()), T.StructField("char_from", T.LongType()), T.StructField("char_to", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for *k, t in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
                seen: dict[str, int] = {}
                for a, z, kind in details(t):
                    seen[kind] = seen.get(kind, 0) + 1
                    rows.append((*k, kind, seen[kind], a, z))
            if rows:
                yield arrow_batch(rows, schema)

    return df.select(*keys, text).where(f"`{text}` IS NOT NULL").mapInArrow(run, out)


def redact(df: DataFrame, keys: list[str], text: str, key: bytes) -> DataFrame:
    """Rows ``keys..., text`` with every detail replaced; ``key`` is a secret of at least 16 bytes."""
    if len(key) < 16:
        raise ValueError("the key needs at least 16 bytes")
    out = T.StructType([*(df.schema[k] for k in keys), T.StructField(text, T.StringType())])
    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = pa.array([redacted(t, key) for t in b.column(b.num_columns - 1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], done], schema=schema)

    return df.select(*keys, text).mapInArrow(run, out)
