"""Text functions as column expressions; the same patterns serve the SQL counterparts."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\p{Z}]"
TOKEN = r"[\p{L}\p{N}]+"
#: The look-behind split pattern of sentences, and lengths of run-on sentences and their pieces in words.
SENTENCE_SPLIT = r"""(?:(?<=[.!?…])|(?<=[.!?…]["'»”’)\]]))\s+(?=["'«“‘(\[¿¡]?[A-ZÁÉÍÓÚÑÜ0-9])"""
RUN_ON_WORDS, PIECE_WORDS = 60, 30
LINE_BREAK = r"\r\n|[\n\r\x0B\x0C\x{85}\x{2028}\x{2029}]"


@lru_cache(maxsize=1)
def fold_maps() -> tuple[str, str, str]:
    """(from, to, class of marks): folding of lower-case letters by the rule NFKD without combining marks.

    Letters that decompose into several (ligatures, Hangul syllables) stay; the final sigma folds to sigma."""
    source, target, marks = ["ς"], ["σ"], []
    for o in (*range(0xA0, 0x3400), *range(0xFF00, 0xFFF0)):
        c = chr(o)
        if unicodedata.combining(c):
            marks.append(o)
            continue
        if c.lower() != c or c == "ς":
            continue
        d = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(d) == 1 and d != c and d.isalnum():
            source.append(c)
            target.append(d)
    ranges, first = [], None
    for i, o in enumerate(marks):
        first = o if first is None else first
        if i + 1 == len(marks) or marks[i + 1] != o + 1:
            ranges.append(f"\\x{{{first:X}}}-\\x{{{o:X}}}")
            first = None
    return "".join(source), "".join(target), "[" + "".join(ranges) + "]"


def fold(c: Column) -> Column:
    """Lower case without accents."""
    source, target, marks = fold_maps()
    return F.translate(F.regexp_replace(F.lower(c), marks, ""), source, target)


def fold_token(c: Column) -> Column:
    """``fold`` of a token, which has no marks of its own; plain ASCII, the common case, is only put in lower case."""
    source, target, _ = fold_maps()
    return F.when(c.rlike(r"^\p{ASCII}*$"), F.lower(c)).otherwise(F.translate(F.lower(c), source, target))


def fold_python(text: str) -> str:
    """Exact folding of one text: lower case, NFKD, no combining marks."""
    return "".join(ch for ch in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def fold_exact(s):  # noqa: ANN001, ANN201
    """Arrow variant for texts with ligatures or Hangul."""
    return s.map(lambda x: None if x is None else fold_python(x))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{SPACE}+", " "))


def tokens(c: Column) -> Column:
    """Maximal runs of letters and digits."""
    return F.regexp_extract_all(c, F.lit(TOKEN), F.lit(0))


def split_sentences(c: Column) -> Column:
    """Array of sentences of a text: lines are split, white space is collapsed, run-ons are cut into pieces."""
    blocks = F.filter(F.transform(F.split(c, r"\n+"), collapse), lambda b: b != "")
    whole = F.filter(F.flatten(F.transform(blocks, lambda b: F.split(b, SENTENCE_SPLIT))), lambda s: s != "")

    def cut(s: Column) -> Column:
        words = F.split(s, " ")
        size = F.size(words)
        pieces = F.transform(F.sequence(F.lit(0), size - 1, F.lit(PIECE_WORDS)), lambda i: F.array_join(F.slice(words, i + 1, PIECE_WORDS), " "))
        return F.when(size > RUN_ON_WORDS, pieces).otherwise(F.array(s))

    return F.flatten(F.transform(whole, cut))


# Patterns of commitments and next steps, and of framing that only looks like one (folded text).
ACTIONS = [
    r"\b(?:we|i|you|they|he|she|someone)\s+(?:really\s+)?(?:need|needs|have|has|got)\s+to\b",
    r"\b(?:we|i|you|they)\s+(?:should|must|ought to)\b",
    r"\blet'?s\b",
    r"\b(?:i'll|i will|we'll|we will|i'm going to|we're going to|i am going to|we are going to)\b",
    r"\b(?:make sure|don'?t forget|remember to|follow up|action items?|to-do|next steps?)\b",
    r"\bhay que\b",
    r"\b(?:tenemos|tengo|tienes|tienen|hay) que\b",
    r"\bvamos a\b",
    r"\b(?:debemos|deberiamos|necesitamos|necesito|necesitas)\b",
    r"\b(?:no (?:te )?olvides|no nos olvidemos|recuerda|recuerden|acuerdate)\b",
    r"\b(?:quedamos en|queda pendiente|proximo paso|siguiente paso|me encargo|te encargas|se encarga)\b",
]
FRAMING = [
    r"\blet'?s (?:talk|get started|start|begin|dive|move on|go back|see|look|recap|jump)\b",
    r"\bvamos a (?:hablar|ver|empezar|comenzar|pasar|seguir|platicar|charlar|conversar|dar paso|repasar)\b",
    r"\b(?:we're|we are|i'm|i am) going to (?:talk|start|begin|cover|look|discuss)\b",
    r"\b(?:we|i) will (?:talk|start|begin|cover|look|discuss)\b",
]


def is_action_item(sentence: Column) -> Column:
    folded = F.replace(fold(sentence), F.lit("’"), F.lit("'"))
    action, framing = "|".join(ACTIONS), "|".join(FRAMING)
    return ~strip(sentence).endswith("?") & folded.rlike(action) & F.regexp_replace(folded, framing, " ").rlike(action)


def clean_title(c: Column) -> Column:
    trimmed = F.regexp_replace(collapse(c), r"""^[ \-–—:|•*#"']+|[ \-–—:|•*#"']+$""", "")
    return F.rtrim(F.substring(trimmed, 1, 100))


def srt_safe(c: Column) -> Column:
    return F.replace(c, F.lit("-->"), F.lit("->"))


def vtt_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def resolve_language(name: str | None, detected: Column) -> Column:
    pretty = {"en": "English", "es": "Spanish"}
    if name and name != "auto":
        return F.lit(pretty.get(name, name))
    return F.when(detected == "en", "English").when(detected == "es", "Spanish").otherwise("the same language as the transcript")


def json_object(c: Column) -> Column:
    """From the first opening to the last closing brace."""
    return F.nullif(F.regexp_extract(c, r"(?s)\{.*\}", 0), F.lit(""))


def parse_summary(reply: Column) -> Column:
    """``struct<tldr, summary, key_points, action_items>`` of a model's reply; without an object the reply is the summary."""
    schema = "tldr string, summary string, key_points array<string>, action_items array<string>"
    data = F.from_json(json_object(reply), schema)
    items = lambda x: F.filter(F.transform(F.coalesce(x, F.array().cast("array<string>")), strip), lambda s: s != "")
    empty = F.array().cast("array<string>")
    good = F.coalesce(data["tldr"].isNotNull() | data["summary"].isNotNull() | data["key_points"].isNotNull() | data["action_items"].isNotNull(), F.lit(False))
    return F.struct(
        F.when(good, strip(F.coalesce(data["tldr"], F.lit("")))).otherwise("").alias("tldr"),
        F.when(good, strip(F.coalesce(data["summary"], F.lit("")))).otherwise(strip(reply)).alias("summary"),
        F.when(good, items(data["key_points"])).otherwise(empty).alias("key_points"),
        F.when(good, items(data["action_items"])).otherwise(empty).alias("action_items"),
    )


# Words that carry no topic, without accents: English and Spanish function words and fillers of speech. English
# forms that follow a rule are built below.
ENGLISH = """
a about above after again against all almost also although always am among an and another any anyway are around as at back be became because become
been before below between both but by can cannot could did do does done down during each either else enough even every few for from further get
getting go got had has have he her here him his how however i if in into is it just least less let like made make many may maybe me might mine more
most much must my neither never no nobody none nor not nothing now of off often on once one only onto or other otherwise our out over own per perhaps
quite rather really right said same say see seem several shall she should since so some sometimes somewhat still such sure than that the their them
then there therefore these they thing things think this those though through thus to together too toward towards under until up upon us use used very
via want wanted was way we well went were what when where whether which while who whole whom whose why will with within without would yes yet you your
ll ve re
"""
ENGLISH_FILLERS = """
yeah yep yup okay ok oh uh um umm hmm huh ah er erm mm gonna gotta wanna kinda sorta basically actually literally honestly totally absolutely
obviously definitely probably pretty stuff kind sort lot lots bit mean means know knew guess guys guy thanks thank hey hello hi welcome today anyway
cool awesome great good nice fine alright bye look listen talk talking said saying tell told stuff first second third next last new old big small
little two three four five six seven eight nine ten eleven twelve twenty hundred thousand show episode everybody everyone folks
"""
SPANISH = """
a al algo alguien algun alguna algunas alguno algunos ante antes aqui asi aun aunque bajo bien cada casi como con contra cual cuales cualquier cuando
cuanto de del desde donde dos el ella ellas ello ellos en entonces entre era eramos eran eres es esa esas ese eso esos esta estaba estado estamos
estan estar estas este esto estos estoy fue fueron fui ha hace hacer hacia han has hasta hay he hemos la las le les lo los mas me mi mia mias mio mios
mis mismo mucha muchas mucho muchos muy nada ni ningun ninguna no nos nosotras nosotros nuestra nuestras nuestro nuestros nunca o os otra otras otro
otros para pero poco por porque pues que quien quienes se sea segun ser si sido siempre sin sino sobre solo somos son soy su sus tal tambien tan tanto
te tenemos tener tengo ti tiene tienen toda todas todo todos tu tus un una unas uno unos usted ustedes va vamos van vez y ya yo
"""
SPANISH_FILLERS = """
bueno pues vale oye mira claro osea digamos tipo verdad eh este ahi aca hola gracias bienvenidos bienvenidas hoy cosa cosas manera forma parte hablar
hablamos dicho decir dice digo creo vez veces primero segundo tercero siguiente ultimo nuevo nueva gran grande pequeno bien mal igual uno dos tres
cuatro cinco seis siete ocho nueve diez once doce veinte cien mil programa episodio seccion
"""
_ENGLISH_FORMS = (
    {f"{a}{b}" for a in ("any", "every", "some") for b in ("body", "one", "thing")}
    | {f"{a}self" for a in ("my", "your", "him", "her", "it")} | {f"{a}selves" for a in ("our", "your", "them")}
    | {f"{a}s" for a in ("her", "our", "their", "your", "it", "other", "let", "get", "make", "say", "seem", "want", "way")}
    | {f"{a}n" for a in ("do", "did", "does", "is", "was", "are", "were", "could", "would", "should", "wo", "has", "have", "had", "ai")}
    | {f"{a}ing" for a in ("be", "do", "go", "hav", "mak", "us")} | {f"{a}ever" for a in ("", "what", "when", "who")} | {"getting", "gotten", "goes", "gone", "seemed"}
)
#: The default; callers may give a list of their own (file or table).
STOPWORDS = sorted({*(ENGLISH + ENGLISH_FILLERS + SPANISH + SPANISH_FILLERS).split(), *_ENGLISH_FORMS})


def stopword_table(spark: SparkSession, words: list[str] | None = None) -> DataFrame:
    """One column ``term`` of folded stopwords; at most a million, so that the broadcast is bounded."""
    folded = sorted({fold_python(w) for w in (STOPWORDS if words is None else words)})
    if len(folded) > 1_000_000:
        raise ValueError("stopword list too long to broadcast")
    return spark.createDataFrame([(w,) for w in folded], "term string")


def stopwords_of(path: str) -> list[str]:
    """Words of a text file, white space between them."""
    with open(path, encoding="utf-8") as f:
        return re.findall(r"\S+", f.read())
