"""Queries of the transcript operators over the test tables, with their DuckDB counterparts."""

from __future__ import annotations

import json
import math
import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuelake.functions import text as ft
from cuelake.functions import times as fm
from cuelake.operators import batch, captions, chapters, completion, recognition, segments, summary, terms
from cuelake.operators.nested import readable_payloads
from cuelake.plans.general import READABLE
from cuelake.session import materialise, read_table
from cuelake.sources.files import decode_transcripts, payload_errors, transcript_json

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a query, with its SQL if it has one."""

    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- parts of the SQL ----------------------------------------------------------------------------------------------------


_WHITE = "[\\s\\p{Z}\\x1C-\\x1F\\x85]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def _fold(x: str) -> str:
    source, target, marks = ft.fold_maps()
    return f"translate(regexp_replace(lower({x}), '{marks}', '', 'g'), '{source}', '{target}')"


def _sentences(x: str) -> str:
    split = r"""([.!?…]["''»”’)\]]?)\s+(["''«“‘(\[¿¡]?[A-ZÁÉÍÓÚÑÜ0-9])"""
    block = _strip("regexp_replace(b, '[\\s\\p{Z}]+', ' ', 'g')")
    whole = f"flatten(list_transform(list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '\\n+'), lambda b: {block}), lambda b: b <> ''), lambda b: string_split(regexp_replace(b, '{split}', concat('\\1', chr(1), '\\2'), 'g'), chr(1))))"
    return f"flatten(list_transform(list_filter({whole}, lambda s: s <> ''), lambda s: CASE WHEN len(string_split(s, ' ')) > 60 THEN list_transform(range(0, len(string_split(s, ' ')), 30), lambda i: array_to_string(list_slice(string_split(s, ' '), i + 1, i + 30), ' ')) ELSE [s] END))"


def _stamp(x: str, sep: str) -> str:
    ms = f"CAST(round_even(greatest(coalesce({x}, 0.0), 0.0) * 1000, 0) AS BIGINT)"
    return f"printf('%02d:%02d:%02d{sep}%03d', {ms} // 3600000, ({ms} // 60000) % 60, ({ms} // 1000) % 60, {ms} % 1000)"


def _chapter_stamp(x: str) -> str:
    t = f"greatest(CAST(trunc({x}) AS BIGINT), 0)"
    return f"CASE WHEN {t} >= 3600 THEN printf('%d:%02d:%02d', {t} // 3600, ({t} // 60) % 60, {t} % 60) ELSE printf('%02d:%02d', ({t} // 60) % 60, {t} % 60) END"


_S = "s AS (SELECT DISTINCT media_id, seg_ix, start_s, end_s, text, speaker FROM segments WHERE media_id IS NOT NULL AND seg_ix IS NOT NULL), t AS (SELECT * FROM s WHERE start_s IS NOT NULL AND end_s IS NOT NULL)"
_P = f"{_S}, p AS (SELECT media_id, seg_ix, start_s, end_s, {_strip('text')} AS text, speaker FROM t WHERE {_strip('text')} <> '')"
_STOP = "(VALUES " + ", ".join(f"('{w}')" for w in ft.STOPWORDS) + ")"
_C = "c AS (SELECT DISTINCT media_id, cue_index, start_s, end_s, lines, speaker, label FROM cues WHERE media_id IS NOT NULL AND cue_index IS NOT NULL)"


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "transcripts").select("media_id", "text")


def _segments(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "segments")


def _cues(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "cues").where("media_id IS NOT NULL AND cue_index IS NOT NULL").select("media_id", "cue_index", "start_s", "end_s", "lines", "speaker", "label").distinct()


# ---- segments ------------------------------------------------------------------------------------------------------------

_TURNS = f"""{_S}, g AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY media_id ORDER BY seg_ix) > 1.2 THEN 1 ELSE 0 END AS step FROM t),
    u AS (SELECT *, CAST(sum(step) OVER (PARTITION BY media_id ORDER BY seg_ix) AS BIGINT) AS turn FROM g),
    v AS (SELECT media_id, seg_ix, start_s, end_s, turn, 'Speaker ' || CAST(turn % 2 + 1 AS VARCHAR) AS speaker FROM u)"""


@query(f"WITH {_TURNS} SELECT media_id, seg_ix, turn, speaker FROM v")
def speaker_turns(spark: SparkSession, folder: str) -> DataFrame:
    return segments.speaker_turns(_segments(spark, folder)).select("media_id", "seg_ix", F.col("turn").cast("long").alias("turn"), "speaker")


@query(f"""WITH {_TURNS} SELECT media_id, speaker, count(DISTINCT turn) AS n_turns, count(*) AS n_segments,
    CAST(sum(greatest(CAST(round_even((end_s - start_s) * 1000, 0) AS BIGINT), 0)) AS BIGINT) AS talk_ms FROM v GROUP BY media_id, speaker""")
def speaker_talk_time(spark: SparkSession, folder: str) -> DataFrame:
    return segments.talk_time(segments.speaker_turns(_segments(spark, folder)))


@query(f"""WITH {_P}, q AS (SELECT media_id, seg_ix, text, coalesce(nullif(speaker, ''), 'Speaker 1') AS speaker FROM p),
    g AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY media_id ORDER BY seg_ix) THEN 0 ELSE 1 END AS b FROM q),
    h AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY seg_ix) AS block FROM g),
    i AS (SELECT media_id, block, min(speaker) || ': ' || string_agg(text, ' ' ORDER BY seg_ix) AS line FROM h GROUP BY media_id, block)
    SELECT media_id, string_agg(line, chr(10) || chr(10) ORDER BY block) AS dialogue FROM i GROUP BY media_id""")
def dialogue_merge(spark: SparkSession, folder: str) -> DataFrame:
    return segments.dialogue(_segments(spark, folder))


@query(f"""WITH {_P}, sp AS (SELECT DISTINCT media_id FROM p WHERE speaker IS NOT NULL AND speaker <> ''), q AS (SELECT media_id, seg_ix, text, coalesce(nullif(speaker, ''), 'Speaker 1') AS speaker FROM p WHERE media_id IN (SELECT media_id FROM sp)),
    g AS (SELECT *, CASE WHEN speaker = lag(speaker) OVER (PARTITION BY media_id ORDER BY seg_ix) THEN 0 ELSE 1 END AS b FROM q), h AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY seg_ix) AS block FROM g),
    i AS (SELECT media_id, block, min(speaker) || ': ' || string_agg(text, ' ' ORDER BY seg_ix) AS line FROM h GROUP BY media_id, block), j AS (SELECT media_id, string_agg(line, chr(10) || chr(10) ORDER BY block) AS body FROM i GROUP BY media_id),
    k AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY media_id ORDER BY seg_ix) <= 2.0 THEN 0 ELSE 1 END AS b FROM p WHERE media_id NOT IN (SELECT media_id FROM sp)), l AS (SELECT *, sum(b) OVER (PARTITION BY media_id ORDER BY seg_ix) AS n FROM k),
    m AS (SELECT media_id, n, string_agg(text, ' ' ORDER BY seg_ix) AS t FROM l GROUP BY media_id, n), o AS (SELECT media_id, string_agg(t, chr(10) || chr(10) ORDER BY n) AS body FROM m GROUP BY media_id)
    SELECT media_id, CASE WHEN media_id IN (SELECT media_id FROM transcripts WHERE diarization = 'pause-heuristic') THEN '{segments.APPROXIMATE}' || chr(10) || chr(10) ELSE '' END || body || chr(10) AS body FROM j UNION ALL SELECT media_id, body || chr(10) FROM o""")
def transcript_text(spark: SparkSession, folder: str) -> DataFrame:
    """The transcript of every recording as text."""
    return segments.transcript_text(_segments(spark, folder), read_table(spark, folder, "transcripts").where("diarization = 'pause-heuristic'"))


@query(f"""WITH {_P}, g AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER (PARTITION BY media_id ORDER BY seg_ix) <= 2.0 THEN 0 ELSE 1 END AS b FROM p),
    h AS (SELECT *, CAST(sum(b) OVER (PARTITION BY media_id ORDER BY seg_ix) - 1 AS BIGINT) AS paragraph_ix FROM g)
    SELECT media_id, paragraph_ix, string_agg(text, ' ' ORDER BY seg_ix) AS paragraph FROM h GROUP BY media_id, paragraph_ix""")
def paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return segments.paragraphs(_segments(spark, folder)).withColumn("paragraph_ix", F.col("paragraph_ix").cast("long"))


_WINDOWS = """d AS (SELECT media_id, coalesce(duration, 0.0) AS d FROM transcripts),
    e AS (SELECT media_id, d, unnest(generate_series(0, CASE WHEN d <= 30 THEN 0 ELSE CAST(ceil((d - 30.0) / 28.0) AS BIGINT) END)) AS k FROM d),
    f AS (SELECT media_id, CAST(k AS INTEGER) AS chunk_ix, k * 28.0::DOUBLE AS chunk_start, CASE WHEN d <= 0 THEN 0.0 ELSE least(k * 28.0::DOUBLE + 30.0, d) END AS chunk_end FROM e),
    g AS (SELECT *, (lead(chunk_start) OVER (PARTITION BY media_id ORDER BY chunk_ix) + chunk_end) / 2 AS hi FROM f),
    w AS (SELECT *, lag(hi) OVER (PARTITION BY media_id ORDER BY chunk_ix) AS lo FROM g)"""


@query(f"WITH {_WINDOWS} SELECT media_id, chunk_ix, chunk_start, chunk_end, lo, hi FROM w")
def chunk_windows(spark: SparkSession, folder: str) -> DataFrame:
    return segments.chunk_windows(read_table(spark, folder, "transcripts"))


@query(f"""WITH {_WINDOWS}, a AS (SELECT media_id, segments, unnest(range(len(segments))) AS seg_ix FROM transcripts WHERE segments IS NOT NULL),
    b AS (SELECT media_id, CAST(seg_ix AS INTEGER) AS seg_ix, segments[seg_ix + 1] AS x FROM a),
    c AS (SELECT b.media_id, seg_ix, x.start_s AS start_s, x.end_s AS end_s, x.text AS text, coalesce(x.words, []) AS words, chunk_ix, coalesce(lo, -1e300) AS lo, coalesce(hi, 1e300) AS hi
          FROM b JOIN w ON b.media_id = w.media_id AND ((x.start_s < chunk_end AND x.end_s > chunk_start) OR (lo IS NULL AND hi IS NULL))),
    h AS (SELECT *, list_filter(words, lambda v: v.start_s >= lo AND v.start_s < hi) AS kept FROM c),
    i AS (SELECT * FROM h WHERE (len(words) = 0 AND start_s >= lo AND start_s < hi) OR len(kept) > 0)
    SELECT media_id, chunk_ix, seg_ix, CASE WHEN len(kept) < len(words) AND kept[1].start_s <> words[1].start_s THEN kept[1].start_s ELSE start_s END AS start_s,
        CASE WHEN len(kept) < len(words) AND kept[-1].start_s <> words[-1].start_s THEN kept[-1].end_s ELSE end_s END AS end_s,
        CASE WHEN len(kept) < len(words) AND len(words) > 0 THEN {_strip("array_to_string(list_transform(kept, lambda v: v.word), '')")} ELSE text END AS text, CAST(len(kept) AS INTEGER) AS n_words FROM i""")
def stitch_words(spark: SparkSession, folder: str) -> DataFrame:
    """Every chunk hears the segments that it meets; each word goes to the chunk that owns its start."""
    recordings = read_table(spark, folder, "transcripts")
    rows = recordings.select("media_id", F.posexplode("segments").alias("seg_ix", "x")).select("media_id", "seg_ix", "x.start_s", "x.end_s", "x.text", "x.words")
    w = segments.chunk_windows(recordings).withColumnRenamed("media_id", "m")
    heard = rows.join(w, (F.col("media_id") == F.col("m")) & (((F.col("start_s") < F.col("chunk_end")) & (F.col("end_s") > F.col("chunk_start"))) | (F.col("lo").isNull() & F.col("hi").isNull())))
    return segments.stitch(heard).select("media_id", "chunk_ix", "seg_ix", "start_s", "end_s", "text", F.size("words").alias("n_words"))


@query(f"""WITH {_S}, q AS (SELECT DISTINCT media_id, cue_index, start_s AS a, end_s AS z, speaker AS who FROM cues WHERE speaker IS NOT NULL AND end_s > start_s),
    j AS (SELECT t.media_id, t.seg_ix, who, row_number() OVER (PARTITION BY t.media_id, t.seg_ix ORDER BY least(end_s, z) - greatest(start_s, a) DESC, cue_index) AS r
          FROM t JOIN q ON t.media_id = q.media_id AND t.start_s < q.z AND q.a < t.end_s WHERE t.end_s > t.start_s)
    SELECT t.media_id, t.seg_ix, t.start_s, t.end_s, coalesce(j.who, 'Speaker 1') AS speaker FROM t LEFT JOIN j ON t.media_id = j.media_id AND t.seg_ix = j.seg_ix AND j.r = 1""")
def overlap_diarize(spark: SparkSession, folder: str) -> DataFrame:
    turns = _cues(spark, folder).where("speaker IS NOT NULL").select("media_id", F.col("cue_index").alias("turn_ix"), F.col("start_s").alias("t_start"), F.col("end_s").alias("t_end"), F.col("speaker").alias("t_speaker"))
    return segments.overlap_speakers(_segments(spark, folder), turns.distinct())


@query(f"""WITH {_S}, q AS (SELECT *, {_strip("coalesce(text, '')")} AS said FROM t)
    SELECT media_id, count(*) AS n_segments, max(end_s) AS duration, bool_or(coalesce(speaker <> '', false)) AS has_speakers,
        coalesce(string_agg(nullif(said, ''), ' ' ORDER BY start_s, seg_ix), '') AS text FROM q GROUP BY media_id""")
def recording_stats(spark: SparkSession, folder: str) -> DataFrame:
    return segments.recording_stats(_segments(spark, folder))


@query(f"""WITH RECURSIVE {_S}, o AS (SELECT *, {_strip("coalesce(text, '')")} AS said, row_number() OVER (PARTITION BY media_id ORDER BY seg_ix) AS n FROM t),
    r AS (SELECT media_id, n, said, start_s AS anchor, 0 AS bucket_ix, end_s - start_s >= 30.0 AS shut FROM o WHERE n = 1
        UNION ALL SELECT o.media_id, o.n, o.said, CASE WHEN r.shut THEN o.start_s ELSE r.anchor END, r.bucket_ix + CASE WHEN r.shut THEN 1 ELSE 0 END, o.end_s - CASE WHEN r.shut THEN o.start_s ELSE r.anchor END >= 30.0
        FROM r JOIN o ON o.media_id = r.media_id AND o.n = r.n + 1)
    SELECT media_id, bucket_ix, min(anchor) AS bucket_start, string_agg(said, ' ' ORDER BY n) AS bucket_text FROM r GROUP BY media_id, bucket_ix""")
def timed_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return segments.timed_buckets(_segments(spark, folder))


# ---- scalars ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {_S} SELECT media_id, seg_ix, {_stamp('start_s', ',')} AS srt, {_stamp('end_s', '.')} AS vtt, {_chapter_stamp('start_s')} AS chapter FROM s")
def timestamps(spark: SparkSession, folder: str) -> DataFrame:
    rows = _segments(spark, folder).where("media_id IS NOT NULL AND seg_ix IS NOT NULL").select("media_id", "seg_ix", "start_s", "end_s").dropDuplicates(["media_id", "seg_ix"])
    return rows.select("media_id", "seg_ix", fm.format_timestamp(F.col("start_s")).alias("srt"), fm.format_timestamp(F.col("end_s"), ".").alias("vtt"), fm.format_chapter_timestamp(F.col("start_s")).alias("chapter"))


_FIND = r"\d{1,3}:\d{2}(?::\d{2})?(?:[.,]\d+)?"


@query(f"""WITH {_S}, q AS (SELECT media_id, seg_ix, regexp_extract(text, '{_FIND}') AS stamp FROM s), r AS (SELECT *, string_split(replace(stamp, ',', '.'), ':') AS x FROM q WHERE stamp <> '')
    SELECT media_id, seg_ix, stamp, CASE WHEN len(x) = 2 THEN CAST(x[1] AS INTEGER) * 60 + CAST(x[2] AS DOUBLE) WHEN len(x) = 3 THEN CAST(x[1] AS INTEGER) * 3600 + CAST(x[2] AS INTEGER) * 60 + CAST(x[3] AS DOUBLE) END AS seconds FROM r""")
def parse_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    rows = _segments(spark, folder).where("media_id IS NOT NULL AND seg_ix IS NOT NULL").select("media_id", "seg_ix", "text").dropDuplicates(["media_id", "seg_ix"])
    found = rows.withColumn("stamp", F.regexp_extract("text", f"({_FIND})", 1)).where("stamp <> ''")
    return found.select("media_id", "seg_ix", "stamp", fm.parse_timestamp(F.col("stamp")).alias("seconds"))


@query(f"""WITH q AS (SELECT media_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}]+') AS w FROM transcripts WHERE text IS NOT NULL),
    r AS (SELECT media_id, w, unnest(range(len(w))) AS i FROM q) SELECT media_id, CAST(i AS INTEGER) AS pos, w[i + 1] AS surface, {_fold("w[i + 1]")} AS folded FROM r""")
def fold_tokens(spark: SparkSession, folder: str) -> DataFrame:
    rows = _texts(spark, folder).where("text IS NOT NULL").select("media_id", F.posexplode(ft.tokens(F.col("text"))).alias("pos", "surface"))
    return rows.withColumn("folded", ft.fold_token(F.col("surface")))


_SENT = f"n AS (SELECT media_id, {_sentences('text')} AS l FROM transcripts), m AS (SELECT media_id, l, unnest(range(len(l))) AS i FROM n), sents AS (SELECT media_id, CAST(i AS INTEGER) AS sent_ix, l[i + 1] AS sentence FROM m)"


@query(f"WITH {_SENT} SELECT media_id, sent_ix, sentence, CAST(len(string_split(sentence, ' ')) AS INTEGER) AS n_words FROM sents")
def split_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return terms.sentences(_texts(spark, folder))


def _matches(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, '{'|'.join(patterns).replace(chr(39), chr(39) * 2)}')"


_ACTED = f"replace({_fold('sentence')}, '’', '''')"
_FRAMED = f"regexp_replace({_ACTED}, '{'|'.join(ft.FRAMING).replace(chr(39), chr(39) * 2)}', ' ', 'g')"
_DOCS = f"n AS (SELECT doc_id AS media_id, {_sentences('text')} AS l FROM documents), m AS (SELECT media_id, l, unnest(range(len(l))) AS i FROM n), sents AS (SELECT media_id, CAST(i AS INTEGER) AS sent_ix, l[i + 1] AS sentence FROM m)"


@query(f"""WITH {_DOCS}, a AS (SELECT *, {_fold('sentence')} AS k FROM sents WHERE NOT ends_with({_strip('sentence')}, '?') AND {_matches(_ACTED, ft.ACTIONS)} AND {_matches(_FRAMED, ft.ACTIONS)}),
    b AS (SELECT *, row_number() OVER (PARTITION BY media_id, k ORDER BY sent_ix) AS r FROM a), c AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY sent_ix) AS o FROM b WHERE r = 1)
    SELECT media_id, sent_ix, sentence FROM c WHERE o <= 8""")
def action_items(spark: SparkSession, folder: str) -> DataFrame:
    """First eight distinct action items of every document (the cap is the operator's)."""
    return summary.action_items(terms.sentences(read_table(spark, folder, "documents").select(F.col("doc_id").alias("media_id"), "text")))


_CLEAN = """rtrim(substr(regexp_replace(regexp_replace(regexp_replace(regexp_replace(l, '[\\s\\p{Z}]+', ' ', 'g'), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g'), '^[ \\-–—:|•*#"'']+|[ \\-–—:|•*#"'']+$', '', 'g'), '$^', ''), 1, 100), ' ')"""
_LINES = f"q AS (SELECT doc_id, regexp_split_to_array(text, '{ft.LINE_BREAK}') AS x FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, x, unnest(range(len(x))) AS i FROM q), y AS (SELECT doc_id, CAST(i AS INTEGER) AS line_ix, x[i + 1] AS l FROM r)"


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", ft.LINE_BREAK)).alias("line_ix", "l"))


@query(f"WITH {_LINES}, z AS (SELECT doc_id, line_ix, {_CLEAN} AS title FROM y) SELECT doc_id, line_ix, title FROM z WHERE title <> ''")
def clean_titles(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder).select("doc_id", "line_ix", ft.clean_title(F.col("l")).alias("title")).where("title <> ''")


_CHAPTER = chapters.LINE
_HEADED = f"""regexp_replace({_strip('l')}, '^[-*• ]+', '')"""


@query(f"""WITH {_LINES}, z AS (SELECT doc_id, line_ix, {_strip(_HEADED)} AS l FROM y), a AS (SELECT doc_id, line_ix, regexp_extract(l, '{_CHAPTER}', 1) AS stamp, {_strip(f"regexp_extract(l, '{_CHAPTER}', 2)")} AS title FROM z),
    b AS (SELECT *, string_split(stamp, ':') AS x FROM a WHERE stamp <> '' AND title <> ''), c AS (SELECT *, CASE WHEN len(x) = 2 THEN CAST(x[1] AS INTEGER) * 60 + CAST(x[2] AS DOUBLE) ELSE CAST(x[1] AS INTEGER) * 3600 + CAST(x[2] AS INTEGER) * 60 + CAST(x[3] AS DOUBLE) END AS start_s FROM b)
    SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start_s, line_ix) - 1 AS INTEGER) AS chapter_no, start_s, title FROM c""")
def chapter_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters of every line of every document that has the form of one, by time."""
    found = chapters.listed_chapters(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return found.select("doc_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_s", "place")) - 1).alias("chapter_no"), "start_s", "title")


@query(f"""WITH {_C}, q AS (SELECT media_id, cue_index, unnest(lines) AS line FROM c WHERE lines IS NOT NULL)
    SELECT media_id, cue_index, line, replace(line, '-->', '->') AS srt, replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS vtt FROM q""")
def escaped_lines(spark: SparkSession, folder: str) -> DataFrame:
    rows = _cues(spark, folder).select("media_id", "cue_index", F.explode("lines").alias("line"))
    return rows.select("media_id", "cue_index", "line", ft.srt_safe(F.col("line")).alias("srt"), ft.vtt_escape(F.col("line")).alias("vtt"))


@query("""SELECT media_id, CASE WHEN language = 'en' THEN 'English' WHEN language = 'es' THEN 'Spanish' ELSE 'the same language as the transcript' END AS instruction FROM transcripts""")
def language_instruction(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "transcripts").select("media_id", ft.resolve_language("auto", F.col("language")).alias("instruction"))


@query(f"""SELECT doc_id, {_strip("coalesce(kind, '')")} AS tldr, {_strip("coalesce(text, '')")} AS summary, array_to_string(list_filter([{_strip("coalesce(source, '')")}, {_strip("coalesce(lang, '')")}], lambda x: x <> ''), chr(10)) AS key_points, '' AS action_items FROM documents""")
def summary_replies(spark: SparkSession, folder: str) -> DataFrame:
    """A model's reply, an object amid prose with the whole text in it, parsed for every document."""
    reply = F.concat(F.lit("Here it is:\n```"), F.to_json(F.struct(F.col("kind").alias("tldr"), F.col("text").alias("summary"), F.array("source", "lang").alias("key_points"))), F.lit("```"))
    return read_table(spark, folder, "documents").select("doc_id", ft.parse_summary(reply).alias("s")).select("doc_id", "s.tldr", "s.summary", F.array_join("s.key_points", "\n").alias("key_points"), F.array_join("s.action_items", "\n").alias("action_items"))


# ---- terms -----------------------------------------------------------------------------------------------------------------


def _content(table: str, keys: str, text: str) -> str:
    return f"""_w AS (SELECT {keys}, regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}]+') AS w FROM {table}), _x AS (SELECT {keys}, w, unnest(range(len(w))) AS i FROM _w),
    _y AS (SELECT {keys}, i AS pos, w[i + 1] AS surface, {_fold("w[i + 1]")} AS term FROM _x), terms AS (SELECT * FROM _y WHERE length(term) > 2 AND NOT regexp_full_match(term, '\\p{{Nd}}+') AND term NOT IN (SELECT * FROM {_STOP}))"""


_TF = f"{_SENT}, {_content('sents', 'media_id, sent_ix', 'sentence')}, tf AS (SELECT media_id, sent_ix, term, count(*) AS tf FROM terms GROUP BY ALL)"
_IDF = f"{_TF}, nn AS (SELECT media_id, count(*) AS n FROM sents GROUP BY media_id), idf AS (SELECT media_id, term, count(*) AS df, ln((1 + any_value(n)) / (1 + count(*))) + 1.0 AS idf FROM tf JOIN nn USING (media_id) GROUP BY media_id, term)"
_VEC = f"{_IDF}, raw AS (SELECT media_id, sent_ix, term, tf * idf AS r FROM tf JOIN idf USING (media_id, term)), vec AS (SELECT media_id, sent_ix, term, r / sqrt(sum(r * r) OVER (PARTITION BY media_id, sent_ix)) AS w FROM raw)"


def _sents(spark: SparkSession, folder: str) -> DataFrame:
    return terms.sentences(_texts(spark, folder))


def _vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    s = materialise(_sents(spark, folder))
    t = terms.sentence_terms(s)
    return materialise(terms.vectors(t, terms.inverse_frequency(t, s))), s


@query(f"WITH {_TF} SELECT media_id, sent_ix, term, tf FROM tf")
def term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return terms.sentence_terms(_sents(spark, folder))


@query(f"WITH {_IDF} SELECT media_id, term, df, round(idf, 6) AS idf FROM idf")
def inverse_frequency(spark: SparkSession, folder: str) -> DataFrame:
    s = _sents(spark, folder)
    return terms.inverse_frequency(terms.sentence_terms(s), s).withColumn("idf", F.round("idf", 6))


@query(f"WITH {_VEC} SELECT media_id, sent_ix, term, round(w, 6) AS w FROM vec")
def tfidf_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _vectors(spark, folder)[0].withColumn("w", F.round("w", 6))


@query(f"""WITH {_VEC} SELECT a.media_id, a.sent_ix AS a, b.sent_ix AS b, round(sum(a.w * b.w), 6) AS w FROM vec a JOIN vec b ON a.media_id = b.media_id AND a.term = b.term AND a.sent_ix < b.sent_ix
    WHERE a.media_id IN (SELECT media_id FROM nn WHERE n <= 700) GROUP BY ALL""")
def similarity_edges(spark: SparkSession, folder: str) -> DataFrame:
    return terms.similarity_edges(*_vectors(spark, folder)).withColumn("w", F.round("w", 6))


@query(f"""WITH {_VEC}, c AS (SELECT media_id, term, sum(w) AS c FROM vec GROUP BY media_id, term), k AS (SELECT media_id, sqrt(sum(c * c)) AS k FROM c GROUP BY media_id)
    SELECT media_id, sent_ix, round(sum(w * c / k), 6) AS score FROM vec JOIN c USING (media_id, term) JOIN k USING (media_id) GROUP BY media_id, sent_ix""")
def centroid_rank(spark: SparkSession, folder: str) -> DataFrame:
    return terms.centroid(_vectors(spark, folder)[0]).withColumn("score", F.round("score", 6))


@query(f"""WITH RECURSIVE {_VEC}, ed AS (SELECT a.media_id, a.sent_ix AS a, b.sent_ix AS b, sum(a.w * b.w) AS w FROM vec a JOIN vec b ON a.media_id = b.media_id AND a.term = b.term AND a.sent_ix <> b.sent_ix
        WHERE a.media_id IN (SELECT media_id FROM nn WHERE n <= 700) GROUP BY ALL), ow AS (SELECT media_id, a, sum(w) AS o FROM ed GROUP BY media_id, a),
    sh AS (SELECT media_id, a, b, w / o AS share FROM ed JOIN ow USING (media_id, a) UNION ALL SELECT media_id, sent_ix, sent_ix, 0.0 FROM sents WHERE media_id IN (SELECT media_id FROM nn WHERE n <= 700)),
    r AS (SELECT 0 AS it, media_id, sent_ix, 1.0::DOUBLE / n AS score, n FROM sents JOIN nn USING (media_id) WHERE n <= 700
        UNION ALL (SELECT it + 1, r.media_id, b, 0.15 / any_value(n) + 0.85 * sum(score * share), any_value(n) FROM r JOIN sh ON r.media_id = sh.media_id AND r.sent_ix = sh.a WHERE it < 60 GROUP BY it, r.media_id, b))
    SELECT media_id, sent_ix, round(score, 6) AS score FROM r WHERE it = 60""")
def text_rank(spark: SparkSession, folder: str) -> DataFrame:
    v, s = _vectors(spark, folder)
    return terms.text_rank(v, s, tolerance=0.0).withColumn("score", F.round("score", 6))  # all rounds, as in the SQL, which has no early end


_RANK = f"""{_VEC}, ed AS (SELECT a.media_id, a.sent_ix AS a, b.sent_ix AS b, sum(a.w * b.w) AS w FROM vec a JOIN vec b ON a.media_id = b.media_id AND a.term = b.term AND a.sent_ix <> b.sent_ix GROUP BY ALL),
    ow AS (SELECT media_id, a, sum(w) AS o FROM ed GROUP BY media_id, a), sh AS (SELECT media_id, a, b, w / o AS share FROM ed JOIN ow USING (media_id, a) UNION ALL SELECT media_id, sent_ix, sent_ix, 0.0 FROM sents),
    r AS (SELECT 0 AS it, media_id, sent_ix, 1.0::DOUBLE / n AS score, n FROM sents JOIN nn USING (media_id)
        UNION ALL (SELECT it + 1, r.media_id, b, 0.15 / any_value(n) + 0.85 * sum(score * share), any_value(n) FROM r JOIN sh ON r.media_id = sh.media_id AND r.sent_ix = sh.a WHERE it < 60 GROUP BY it, r.media_id, b)),
    tv AS (SELECT DISTINCT media_id, sent_ix FROM vec), wc AS (SELECT *, len(string_split(sentence, ' ')) AS words FROM sents),
    fs AS (SELECT wc.media_id, wc.sent_ix, sentence, n, round(score * CASE WHEN tv.sent_ix IS NULL THEN 0.0 WHEN words < 6 THEN 0.5 WHEN words > 45 THEN 0.8 ELSE 1.0 END, 9) AS score
        FROM wc JOIN r ON r.media_id = wc.media_id AND r.sent_ix = wc.sent_ix AND it = 60 LEFT JOIN tv ON tv.media_id = wc.media_id AND tv.sent_ix = wc.sent_ix),
    fb AS (SELECT *, max(score) OVER (PARTITION BY media_id) AS top FROM fs), fo AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, sent_ix) AS k FROM fb WHERE score > 0 OR top <= 0),
    nb AS (SELECT media_id, a, list(b) AS near FROM ed WHERE w > 0.6 GROUP BY media_id, a), fn AS (SELECT fo.*, coalesce(near, []) AS near, least(5, greatest(2, round_even(n / 12.0, 0))) AS n1, least(6, greatest(3, round_even(n / 10.0, 0))) AS n2 FROM fo LEFT JOIN nb ON nb.media_id = fo.media_id AND nb.a = fo.sent_ix),
    pk AS (SELECT media_id, k, [sent_ix] AS ov, CAST([] AS INTEGER[]) AS pt FROM fn WHERE k = 1 UNION ALL
        SELECT fn.media_id, fn.k, CASE WHEN len(ov) < n1 AND len(list_intersect(near, ov)) = 0 THEN list_append(ov, sent_ix) ELSE ov END, CASE WHEN len(ov) >= n1 AND len(pt) < n2 AND len(list_intersect(near, ov)) = 0 AND len(list_intersect(near, pt)) = 0 THEN list_append(pt, sent_ix) ELSE pt END
        FROM pk JOIN fn ON fn.media_id = pk.media_id AND fn.k = pk.k + 1),
    pf AS (SELECT media_id, arg_max(ov, k) AS ov, arg_max(pt, k) AS pt FROM pk GROUP BY media_id),
    ai AS (SELECT *, {_fold('sentence')} AS fk FROM sents WHERE NOT ends_with({_strip('sentence')}, '?') AND {_matches(_ACTED, ft.ACTIONS)} AND {_matches(_FRAMED, ft.ACTIONS)}),
    aj AS (SELECT *, row_number() OVER (PARTITION BY media_id, fk ORDER BY sent_ix) AS q FROM ai), ak AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY sent_ix) AS p FROM aj WHERE q = 1),
    al AS (SELECT media_id, string_agg(sentence, chr(10) ORDER BY sent_ix) AS items FROM ak WHERE p <= 8 GROUP BY media_id),
    su AS (SELECT pf.media_id, (SELECT sentence FROM fn WHERE fn.media_id = pf.media_id AND fn.k = 1) AS tldr, (SELECT string_agg(sentence, ' ' ORDER BY sent_ix) FROM sents z WHERE z.media_id = pf.media_id AND list_contains(ov, sent_ix)) AS summary,
        coalesce((SELECT string_agg(sentence, chr(10) ORDER BY sent_ix) FROM sents z WHERE z.media_id = pf.media_id AND list_contains(pt, sent_ix)), '') AS key_points, coalesce(items, '') AS action_items, 'extractive' AS method FROM pf LEFT JOIN al ON al.media_id = pf.media_id)"""


@query(f"WITH RECURSIVE {_RANK} SELECT * FROM su")
def extractive_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of all transcripts; lists are given as lines."""
    rows = summary.summaries(_texts(spark, folder))
    return rows.select("media_id", "tldr", "summary", F.array_join("key_points", "\n").alias("key_points"), F.array_join("action_items", "\n").alias("action_items"), "method")


@query(f"""WITH RECURSIVE {_RANK} SELECT media_id, '# Summary' || chr(10) || chr(10) || '_Offline extractive summary: quoted sentences ranked by TF-IDF centrality._' || chr(10) || chr(10) || '## TL;DR' || chr(10) || chr(10) || tldr || chr(10) || chr(10) || '## Overview' || chr(10) || chr(10) || summary
    || CASE WHEN key_points <> '' THEN chr(10) || chr(10) || '## Key points' || chr(10) || chr(10) || '- ' || replace(key_points, chr(10), chr(10) || '- ') ELSE '' END
    || CASE WHEN action_items <> '' THEN chr(10) || chr(10) || '## Action items' || chr(10) || chr(10) || '- [ ] ' || replace(action_items, chr(10), chr(10) || '- [ ] ') ELSE '' END || chr(10) AS markdown FROM su""")
def summary_markdown(spark: SparkSession, folder: str) -> DataFrame:
    return summary.summary_markdown(summary.summaries(_texts(spark, folder)))


_SURF = f"{_P}, o AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY start_s, seg_ix) - 1 AS i0 FROM p), {_content('o', 'media_id, i0, start_s', 'text')}"


def _ordered(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    o = chapters.ordered_segments(_segments(spark, folder))
    return o, chapters.segment_terms(o)


@query(f"""WITH {_SURF}, k AS (SELECT media_id, term, surface, count(*) AS n, min(i0 * 1000000 + pos) AS f FROM terms GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY media_id, term ORDER BY n DESC, f) AS r FROM k)
    SELECT media_id, term, surface, n FROM r WHERE r = 1""")
def surface_mode(spark: SparkSession, folder: str) -> DataFrame:
    """The most common spelling of every term of a recording; ties go to the one that comes first."""
    k = _ordered(spark, folder)[1].groupBy("media_id", "term", "surface").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("i", "pos")).alias("f"))
    best = k.groupBy("media_id", "term").agg(F.min_by(F.struct("surface", "n"), F.struct((-F.col("n")).alias("m"), "f")).alias("b"))
    return best.select("media_id", "term", "b.surface", "b.n")


_BLOCK = f"""{_SURF}, t0 AS (SELECT media_id, min(start_s) AS t0 FROM o GROUP BY media_id), bl AS (SELECT media_id, term, floor((start_s - t0) / 40.0) AS block FROM terms JOIN t0 USING (media_id)),
    bn AS (SELECT media_id, count(DISTINCT block) AS n FROM bl GROUP BY media_id), bidf AS (SELECT media_id, term, count(DISTINCT block) AS df, ln(any_value(n)::DOUBLE / count(DISTINCT block)) AS idf FROM bl JOIN bn USING (media_id) GROUP BY media_id, term)"""


@query(f"WITH {_BLOCK} SELECT media_id, term, df, round(idf, 6) AS idf FROM bidf")
def block_idf(spark: SparkSession, folder: str) -> DataFrame:
    o, t = _ordered(spark, folder)
    return chapters.block_idf(t, o).withColumn("idf", F.round("idf", 6))


@query(f"""WITH {_BLOCK}, f AS (SELECT media_id, term, count(*) AS tf, round(count(*) * any_value(idf), 9) AS score FROM terms JOIN bidf USING (media_id, term) GROUP BY media_id, term),
    r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, term) AS r FROM f) SELECT media_id, CAST(r AS INTEGER) AS rank, term, tf, round(score, 6) AS score FROM r WHERE r <= 5""")
def top_terms(spark: SparkSession, folder: str) -> DataFrame:
    """The five most distinctive terms of every recording."""
    o, t = _ordered(spark, folder)
    f = t.join(chapters.block_idf(t, o), ["media_id", "term"]).groupBy("media_id", "term").agg(F.count(F.lit(1)).alias("tf"), F.round(F.count(F.lit(1)) * F.first("idf"), 9).alias("score"))
    r = f.withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("score"), "term"))).where("rank <= 5")
    return r.select("media_id", "rank", "term", "tf", F.round("score", 6).alias("score"))


_SIM = f"""{_BLOCK}, wt AS (SELECT media_id, i0, start_s, term, count(*) * any_value(idf) AS x FROM terms JOIN bidf USING (media_id, term) WHERE idf > 0 GROUP BY media_id, i0, start_s, term),
    pr AS (SELECT a.media_id, a.i0, term, sum(CASE WHEN b.i0 < a.i0 THEN x ELSE 0.0 END) AS p, sum(CASE WHEN b.i0 >= a.i0 THEN x ELSE 0.0 END) AS q FROM o a JOIN wt b ON a.media_id = b.media_id AND a.i0 > 0
        AND ((b.i0 < a.i0 AND b.start_s >= a.start_s - 40.0) OR (b.i0 >= a.i0 AND b.start_s < a.start_s + 40.0)) GROUP BY a.media_id, a.i0, term),
    sm AS (SELECT media_id, i0, CASE WHEN sum(p * p) > 0 AND sum(q * q) > 0 THEN sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))) END AS sim FROM pr GROUP BY media_id, i0)"""


@query(f"WITH {_SIM} SELECT o.media_id, CAST(o.i0 AS INTEGER) AS i, o.start_s, round(sim, 6) AS sim FROM o LEFT JOIN sm ON o.media_id = sm.media_id AND o.i0 = sm.i0")
def window_similarity(spark: SparkSession, folder: str) -> DataFrame:
    o, t = _ordered(spark, folder)
    return chapters.window_similarity(o, t, chapters.block_idf(t, o)).withColumn("sim", F.round("sim", 6))


@query(f"""WITH {_SIM}, ga AS (SELECT media_id, i0, start_s, start_s - lag(end_s) OVER (PARTITION BY media_id ORDER BY i0) AS gap FROM o),
    st AS (SELECT ga.media_id, ga.i0, ga.start_s, CASE WHEN gap >= 3.0 THEN 2.0 + gap WHEN round(sim, 9) < 0.3 THEN 1.0 - round(sim, 9) END AS strength FROM ga LEFT JOIN sm ON ga.media_id = sm.media_id AND ga.i0 = sm.i0 WHERE ga.i0 > 0)
    SELECT media_id, CAST(i0 AS INTEGER) AS i, start_s, round(strength, 6) AS strength FROM st WHERE strength IS NOT NULL""")
def chapter_candidates(spark: SparkSession, folder: str) -> DataFrame:
    o, t = _ordered(spark, folder)
    sims = chapters.window_similarity(o, t, chapters.block_idf(t, o)).withColumn("sim", F.round("sim", 9))
    return chapters.candidates(o, sims).withColumn("strength", F.round("strength", 6))


_CAND = f"""{_SIM}, ga AS (SELECT media_id, i0, start_s, start_s - lag(end_s) OVER (PARTITION BY media_id ORDER BY i0) AS gap FROM o),
    st AS (SELECT ga.media_id, ga.i0, ga.start_s, CASE WHEN gap >= 3.0 THEN 2.0 + gap WHEN round(sim, 9) < 0.3 THEN 1.0 - round(sim, 9) END AS strength FROM ga LEFT JOIN sm ON ga.media_id = sm.media_id AND ga.i0 = sm.i0 WHERE ga.i0 > 0)"""


def _split_longest(source: str, name: str) -> str:
    """One more start in each long recording with fewer than three."""
    return f"""{name}a AS (SELECT media_id, last, starts, unnest(range(len(starts))) AS k FROM {source} WHERE len(starts) < 3 AND last >= 180),
    {name}b AS (SELECT media_id, starts[k + 1] AS a, coalesce(starts[k + 2], last) AS z FROM {name}a),
    {name}c AS (SELECT b.media_id, b.a, b.z, o.start_s AS t, coalesce(round(sm.sim, 9), 1.0) AS sim FROM {name}b b JOIN o ON o.media_id = b.media_id AND o.start_s >= b.a + 30.0 AND o.start_s <= b.z - 30.0 LEFT JOIN sm ON sm.media_id = o.media_id AND sm.i0 = o.i0),
    {name}d AS (SELECT media_id, t, row_number() OVER (PARTITION BY media_id ORDER BY a - z, a, sim, abs(t - (a + z) / 2), t) AS r FROM {name}c),
    {name} AS (SELECT g.media_id, g.last, CASE WHEN d.t IS NULL THEN g.starts ELSE list_sort(list_append(g.starts, d.t)) END AS starts FROM {source} g LEFT JOIN {name}d d ON d.media_id = g.media_id AND d.r = 1)"""


def _regular(source: str, key: str) -> str:
    """Regular, numbered chapters ``nu`` of rows ``key, n, s, t`` with clean titles."""
    return f"""rg AS (SELECT {key}, n, CASE WHEN s < 10 THEN [{{'s': 0.0::DOUBLE, 't': t}}] WHEN lower(t) = 'intro' THEN [{{'s': 0.0::DOUBLE, 't': 'Intro'}}] ELSE [{{'s': 0.0::DOUBLE, 't': 'Intro'}}, {{'s': s, 't': t}}] END AS acc FROM {source} WHERE n = 1
        UNION ALL SELECT x.{key}, x.n, CASE WHEN x.s - acc[-1].s < 10 THEN list_append(acc[1:len(acc) - 1], {{'s': acc[-1].s, 't': x.t}}) WHEN lower(x.t) = lower(acc[-1].t) THEN acc ELSE list_append(acc, {{'s': x.s, 't': x.t}}) END
        FROM rg JOIN {source} x ON x.{key} = rg.{key} AND x.n = rg.n + 1),
    rf AS (SELECT {key}, arg_max(acc, n) AS acc FROM rg GROUP BY {key}), re AS (SELECT {key}, acc, unnest(range(len(acc))) AS k FROM rf),
    rn AS (SELECT {key}, CAST(k AS INTEGER) AS chapter_no, acc[k + 1].s AS start_s, acc[k + 1].t AS t, row_number() OVER (PARTITION BY {key}, lower(acc[k + 1].t) ORDER BY k) AS r FROM re),
    nu AS (SELECT {key}, chapter_no, start_s, CASE WHEN r > 1 THEN t || ' (part ' || r || ')' ELSE t END AS title FROM rn)"""


_TOPICS = f"""{_CAND}, en AS (SELECT o.media_id, greatest(max(end_s), coalesce(max(tr.duration), 0.0)) AS last FROM o LEFT JOIN transcripts tr ON tr.media_id = o.media_id GROUP BY o.media_id),
    li AS (SELECT media_id, last, least(15, greatest(2, floor(last / 120) + 1)) AS most FROM en),
    ca AS (SELECT media_id, start_s AS t, row_number() OVER (PARTITION BY media_id ORDER BY round(strength, 9) DESC, start_s) AS n FROM st WHERE strength IS NOT NULL),
    gr AS (SELECT media_id, CAST(0 AS BIGINT) AS n, [0.0::DOUBLE] AS starts FROM li UNION ALL
        SELECT gr.media_id, ca.n, CASE WHEN len(starts) < most AND t >= 60 AND last - t >= 60 AND len(list_filter(starts, lambda x: abs(t - x) < 60)) = 0 THEN list_append(starts, t) ELSE starts END
        FROM gr JOIN ca ON ca.media_id = gr.media_id AND ca.n = gr.n + 1 JOIN li ON li.media_id = gr.media_id),
    g0 AS (SELECT li.media_id, last, list_sort(arg_max(starts, n)) AS starts FROM gr JOIN li ON li.media_id = gr.media_id GROUP BY li.media_id, last), {_split_longest("g0", "g1")}, {_split_longest("g1", "g2")},
    sp AS (SELECT media_id, last, starts, unnest(range(len(starts))) AS k FROM g2), ch AS (SELECT media_id, last, CAST(k AS INTEGER) AS no, starts[k + 1] AS a, coalesce(starts[k + 2], last + 1.0) AS z FROM sp),
    tw AS (SELECT media_id, term, surface, count(*) AS n, min(i0 * 1000000 + pos) AS f FROM terms GROUP BY ALL), ts AS (SELECT media_id, term, sum(n) AS total, min(f) AS said, first(surface ORDER BY n DESC, f) AS surface FROM tw GROUP BY ALL),
    ct AS (SELECT ch.media_id, no, term, count(*) AS tf FROM terms t JOIN ch ON t.media_id = ch.media_id AND t.start_s >= a AND t.start_s < z GROUP BY ALL),
    cs AS (SELECT ct.*, total, said, surface, coalesce(idf, 0.0) AS idf, max(coalesce(idf, 0.0)) OVER (PARTITION BY ct.media_id, no) > 0 AS u FROM ct JOIN ts USING (media_id, term) LEFT JOIN bidf USING (media_id, term)),
    sc AS (SELECT *, round(tf * tf / total * CASE WHEN u THEN idf ELSE 1.0 END, 9) AS score FROM cs),
    tn AS (SELECT *, row_number() OVER (PARTITION BY media_id, no, regexp_replace(term, 's+$', '') ORDER BY score DESC, said) AS tr FROM sc WHERE NOT u OR score > 0),
    rk AS (SELECT media_id, no, list(CASE WHEN lower(surface) = surface THEN upper(substr(surface, 1, 1)) || substr(surface, 2) ELSE surface END ORDER BY score DESC, said) AS w FROM tn WHERE tr = 1 GROUP BY media_id, no),
    op AS (SELECT ch.media_id, ch.no, a, last, CASE WHEN w IS NULL THEN ['Chapter ' || (ch.no + 1)] ELSE list_concat([array_to_string(w[1:3], ' ')], list_transform(w[4:], lambda x: array_to_string(list_concat(w[1:2], [x]), ' '))) END AS opts FROM ch LEFT JOIN rk ON rk.media_id = ch.media_id AND rk.no = ch.no),
    un AS (SELECT media_id, no, a, last, opts[1] AS title, [lower(opts[1])] AS used FROM op WHERE no = 0 UNION ALL SELECT media_id, no, a, last, title, list_append(used, lower(title)) FROM (
        SELECT op.media_id, op.no, op.a, op.last, used, coalesce(list_filter(opts, lambda t: NOT list_contains(used, lower(t)))[1], list_filter(list_transform(range(2, 40), lambda n: opts[-1] || ' (part ' || n || ')'), lambda t: NOT list_contains(used, lower(t)))[1]) AS title
        FROM un JOIN op ON op.media_id = un.media_id AND op.no = un.no + 1)),
    cl AS (SELECT media_id, no, greatest(a, 0.0) AS s, last, {_CLEAN.replace("(l,", "(title,")} AS t FROM un), ck AS (SELECT media_id, s, t, row_number() OVER (PARTITION BY media_id ORDER BY s, no) AS n FROM cl WHERE t <> '' AND (last <= 0 OR s = 0 OR s <= last - 10)), {_regular("ck", "media_id")}"""


@query(f"WITH RECURSIVE {_TOPICS} SELECT media_id, chapter_no, start_s, title FROM nu")
def topic_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Titled chapters of every recording."""
    return chapters.chapters(_segments(spark, folder), read_table(spark, folder, "transcripts"))


@query(f"WITH RECURSIVE {_TOPICS} SELECT media_id, string_agg({_chapter_stamp('start_s')} || ' ' || title, chr(10) ORDER BY chapter_no) AS chapters FROM nu GROUP BY media_id")
def chapter_text(spark: SparkSession, folder: str) -> DataFrame:
    """The chapter list of every recording as text."""
    return chapters.chapter_text(topic_chapters(spark, folder))


_LISTED = f"""{_LINES}, z AS (SELECT doc_id, line_ix, {_strip(_HEADED)} AS l FROM y), a AS (SELECT doc_id, line_ix, regexp_extract(l, '{_CHAPTER}', 1) AS stamp, {_strip(f"regexp_extract(l, '{_CHAPTER}', 2)")} AS title FROM z),
    b AS (SELECT *, string_split(stamp, ':') AS x FROM a WHERE stamp <> '' AND title <> ''), c AS (SELECT *, CASE WHEN len(x) = 2 THEN CAST(x[1] AS INTEGER) * 60 + CAST(x[2] AS DOUBLE) ELSE CAST(x[1] AS INTEGER) * 3600 + CAST(x[2] AS INTEGER) * 60 + CAST(x[3] AS DOUBLE) END AS start_s FROM b),
    d AS (SELECT doc_id, line_ix, start_s AS s, {_CLEAN.replace("(l,", "(title,")} AS t FROM c), ck AS (SELECT doc_id, s, t, row_number() OVER (PARTITION BY doc_id ORDER BY s, line_ix) AS n FROM d WHERE t <> '')"""


@query(f"WITH RECURSIVE {_LISTED}, {_regular('ck', 'doc_id')} SELECT doc_id, chapter_no, start_s, title FROM nu")
def normalized_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapter lists found in documents, made regular (first at 0, short ones merged, repeats numbered)."""
    found = chapters.listed_chapters(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return chapters.numbered(chapters.regular(found.withColumn("duration", F.lit(None).cast("double")), "doc_id"), "doc_id")


@query(f"""WITH {_SURF}, k AS (SELECT media_id, term, count(*) AS n, min(i0 * 1000000 + pos) AS f FROM terms GROUP BY media_id, term), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, f) AS r FROM k)
    SELECT media_id, string_agg(upper(substr(term, 1, 1)) || substr(term, 2), ' ' ORDER BY r) AS title FROM r WHERE r <= 4 GROUP BY media_id""")
def frequency_titles(spark: SparkSession, folder: str) -> DataFrame:
    return chapters.frequency_titles(_ordered(spark, folder)[1])


@query(f"""WITH RECURSIVE {_TOPICS} SELECT o.media_id, o.seg_ix, nu.chapter_no, nu.title FROM o LEFT JOIN nu ON nu.media_id = o.media_id AND nu.start_s <= o.start_s
    QUALIFY row_number() OVER (PARTITION BY o.media_id, o.seg_ix ORDER BY nu.start_s DESC) = 1""")
def chapter_of_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The chapter of every spoken segment."""
    return chapters.chapter_of_segments(_segments(spark, folder), topic_chapters(spark, folder))


@query()
def model_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """Chapters by a stand-in model. By the checksum of the prompt, whatever its length, it fails for a quarter of the
    recordings (those fall back), names the first line only for a quarter (those are filled) and every line of the others."""

    def complete(messages: list[dict]) -> str:
        prompt = messages[1]["content"]
        share = zlib.crc32(prompt.encode()) % 4
        if share == 0:
            raise RuntimeError("no answer")
        lines = prompt.split("\n")[: 1 if share == 1 else None]
        return "\n".join(f"{line[1:].split(']')[0]} {' '.join(line.split()[1:4])}" for line in lines)

    return completion.model_chapters(_segments(spark, folder), complete, read_table(spark, folder, "transcripts"))


# ---- captions --------------------------------------------------------------------------------------------------------------

_LINT = f"""{_C}, q AS (SELECT media_id, cue_index, start_s, end_s, coalesce(lines, []) AS l, lag(start_s) OVER w AS ps, lag(end_s) OVER w AS pe FROM c WINDOW w AS (PARTITION BY media_id ORDER BY cue_index, start_s, end_s)),
    r AS (SELECT *, CASE WHEN end_s > start_s THEN list_sum(list_transform(l, lambda x: coalesce(length(x), 0))) / (end_s - start_s) END AS cps0 FROM q),
    z AS (SELECT *, CASE WHEN end_s > start_s AND len(l) = 0 THEN 0.0 ELSE cps0 END AS cps FROM r),
    a AS (SELECT media_id, CAST(count(*) AS INTEGER) AS n_cues, CAST(count_if(start_s < pe) AS INTEGER) AS overlaps, CAST(count_if(start_s < ps) AS INTEGER) AS out_of_order, CAST(count_if(cps > 17.0 + 1e-9) AS INTEGER) AS fast_cues,
        round(coalesce(max(cps), 0.0), 6) AS max_cps, CAST(sum(len(list_filter(l, lambda x: length(x) > 42 AND contains(x, ' ')))) AS INTEGER) AS wide_lines, CAST(count_if(len(l) > 2) AS INTEGER) AS tall_cues,
        CAST(count_if(len(list_filter(l, lambda x: coalesce({_strip('x')}, '') <> '')) = 0 OR coalesce(end_s <= start_s, true)) AS INTEGER) AS empty_cues FROM z GROUP BY media_id)"""


@query(f"""WITH {_LINT} SELECT *, a.overlaps + out_of_order + wide_lines + tall_cues + empty_cues = 0 AS ok, concat_ws(' | ', n_cues || ' cues', a.overlaps || ' overlaps', fast_cues || ' above 17 chars/s (max ' || printf('%.1f', max_cps) || ')',
    wide_lines || ' lines over 42 chars', CASE WHEN out_of_order > 0 THEN out_of_order || ' out of order' END, CASE WHEN tall_cues > 0 THEN tall_cues || ' cues over 2 lines' END) AS report FROM a""")
def caption_lint(spark: SparkSession, folder: str) -> DataFrame:
    return captions.lint(_cues(spark, folder))


@query(f"""WITH {_C}, q AS (SELECT media_id, cue_index, concat_ws(chr(10), CAST(cue_index AS VARCHAR), {_stamp('start_s', ',')} || ' --> ' || {_stamp('end_s', ',')}, CASE WHEN len(lines) > 0 THEN array_to_string(list_transform(lines, lambda x: replace(coalesce(x, ''), '-->', '->')), chr(10)) END) AS block FROM c)
    SELECT media_id, rtrim(string_agg(block, chr(10) || chr(10) ORDER BY cue_index), chr(10)) || chr(10) AS srt FROM q GROUP BY media_id""")
def srt_text(spark: SparkSession, folder: str) -> DataFrame:
    return captions.to_srt(_cues(spark, folder))


@query(f"""WITH {_C}, q AS (SELECT media_id, cue_index, start_s, end_s, speaker, coalesce(lines, []) AS l, label IS NOT NULL AND starts_with(coalesce(lines[1], ''), label) AS cut, {_strip("substr(coalesce(lines[1], ''), length(label) + 1)")} AS bare FROM c),
    r AS (SELECT *, list_transform(CASE WHEN cut AND bare <> '' THEN list_concat([bare], l[2:]) WHEN cut THEN l[2:] ELSE l END, lambda x: replace(replace(replace(coalesce(x, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')) AS e FROM q),
    v AS (SELECT media_id, cue_index, {_stamp('start_s', '.')} || ' --> ' || {_stamp('end_s', '.')} AS t, CASE WHEN coalesce(speaker, '') <> '' AND len(e) > 0 THEN list_concat(['<v ' || replace(replace(replace(speaker, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '>' || e[1]], e[2:]) ELSE e END AS e FROM r)
    SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || rtrim(string_agg(array_to_string(list_concat([t], e), chr(10)), chr(10) || chr(10) ORDER BY cue_index), chr(10)) || chr(10) AS vtt FROM v GROUP BY media_id""")
def vtt_text(spark: SparkSession, folder: str) -> DataFrame:
    return captions.to_vtt(_cues(spark, folder))


def _worded(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "transcripts").select("media_id", F.posexplode("segments").alias("seg_ix", "x"))
    return rows.select("media_id", "seg_ix", "x.start_s", "x.end_s", "x.text", "x.speaker", "x.words")


def _wrap(x: str, n: str) -> str:
    """Greedy lines of at most 42 characters; ``n`` names the lambdas' variables."""
    words = f"list_filter(string_split_regex({x}, '{_WHITE}+'), lambda w{n}: w{n} <> '')"
    return f"""CASE WHEN regexp_replace({x}, '{_WHITE}', '', 'g') = '' THEN CAST([] AS VARCHAR[]) ELSE list_reduce(list_transform({words}, lambda v{n}: [v{n}]), lambda a{n}, b{n}: CASE WHEN length(a{n}[-1]) + 1 + length(b{n}[1]) <= 42 THEN list_append(a{n}[1:len(a{n}) - 1], a{n}[-1] || ' ' || b{n}[1]) ELSE list_append(a{n}, b{n}[1]) END) END"""


def _words_in(words: frozenset[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in sorted(words)) + "]"


_ENDS, _CLAUSE = "[.!?…。！？][\"''»”’)\\]]*$", "[,;:，、；：—–][\"''»”’)\\]]*$"
_TRIM = ".,;:!?¡¿\"''()[]«»“”‘’"


def _laid(source: str) -> str:
    """Lines ``ln`` of the drafts ``media_id, seg_ix, part, a, z, t, chars, speaker, label, mask`` of a table, and timed cues ``fin``."""
    cost = f"""abs(u - d) / 42.0 - (CASE WHEN regexp_matches(ws[k], '{_ENDS}') THEN 1.0 WHEN regexp_matches(ws[k], '{_CLAUSE}') THEN 0.6 ELSE 0.0 END::DOUBLE + 0.3::DOUBLE * CAST(list_contains({_words_in(captions.BREAK_BEFORE)}, lower(trim(ws[k + 1], '{_TRIM}'))) AS INTEGER))
        + (0.5::DOUBLE * CAST(list_contains({_words_in(captions.NO_BREAK_AFTER)}, lower(trim(ws[k], '{_TRIM}'))) AS INTEGER) + 0.05::DOUBLE * CAST(u > d AS INTEGER))"""
    return f"""y1 AS (SELECT *, row_number() OVER () AS id, list_filter(string_split_regex(t, '{_WHITE}+'), lambda w: w <> '') AS ws, {_wrap("t", "1")} AS gl FROM {source}),
    y2 AS (SELECT id, ws, unnest(range(1, len(ws))) AS k FROM y1 WHERE len(gl) = 2), y3 AS (SELECT id, ws, k, length(array_to_string(ws[1:k], ' ')) AS u, length(array_to_string(ws[k + 1:], ' ')) AS d FROM y2),
    y4 AS (SELECT id, ws, k, {cost} AS cost FROM y3 WHERE greatest(u, d) <= 42), y5 AS (SELECT id, ws, k, row_number() OVER (PARTITION BY id ORDER BY cost, k DESC) AS r FROM y4),
    y6 AS (SELECT y1.*, list_transform(CASE WHEN y5.k IS NULL THEN gl ELSE [array_to_string(y1.ws[1:y5.k], ' '), array_to_string(y1.ws[y5.k + 1:], ' ')] END, lambda x: CASE WHEN mask IS NULL THEN x ELSE replace(x, mask, label) END) AS ln FROM y1 LEFT JOIN y5 ON y5.id = y1.id AND y5.r = 1),
    y7 AS (SELECT *, coalesce(chars, list_sum(list_transform(ln, lambda x: length(x)))) AS n, row_number() OVER v AS o, lead(a) OVER v - 0.04::DOUBLE AS until FROM y6 WINDOW v AS (PARTITION BY media_id ORDER BY a, seg_ix, part)),
    fz AS (SELECT media_id, CAST(0 AS BIGINT) AS o, 0.0::DOUBLE AS free, 0.0::DOUBLE AS s, 0.0::DOUBLE AS e FROM (SELECT DISTINCT media_id FROM y7) UNION ALL
        SELECT media_id, o, e + 0.04::DOUBLE, s, e FROM (SELECT media_id, o, s, least(greatest(z, s + greatest(0.7::DOUBLE, n / 17.0::DOUBLE)), greatest(coalesce(until, 'inf'::DOUBLE), s + 0.1::DOUBLE)) AS e
            FROM (SELECT y7.media_id, y7.o, z, n, until, greatest(a, free) AS s FROM fz JOIN y7 ON y7.media_id = fz.media_id AND y7.o = fz.o + 1))),
    fin AS (SELECT y7.media_id, CAST(y7.o AS INTEGER) AS cue_index, s AS start_s, e AS end_s, ln, speaker, CASE WHEN mask IS NOT NULL THEN label END AS label FROM y7 JOIN fz ON fz.media_id = y7.media_id AND fz.o = y7.o)"""


def _even(source: str) -> str:
    """Drafts ``pd`` timed by characters, of segments ``media_id, seg_ix, s, e, x, speaker, label``."""
    return f"""q1 AS (SELECT *, repeat(chr(1), length(label)) AS m, {_wrap("coalesce(repeat(chr(1), length(label)) || ' ', '') || x", "2")} AS gl FROM {source}), q2 AS (SELECT *, unnest(range(0, len(gl), 2)) AS g FROM q1),
    q3 AS (SELECT *, CAST(g // 2 AS INTEGER) AS part, list_sum(list_transform(gl[g + 1:g + 2], lambda l: length(l))) AS c, greatest(list_sum(list_transform(gl, lambda l: length(l))), 1) AS total FROM q2),
    q4 AS (SELECT *, greatest(0.0::DOUBLE, e - s) * (c / total::DOUBLE) AS share FROM q3), q5 AS (SELECT media_id, seg_ix, list(share ORDER BY part) AS sh FROM q4 GROUP BY media_id, seg_ix),
    pd AS (SELECT q4.media_id, q4.seg_ix, part, list_reduce(list_concat([s], sh[1:part]), lambda f, g: f + g) AS a, list_reduce(list_concat([s], sh[1:part + 1]), lambda f, g: f + g) AS z, array_to_string(gl[g + 1:g + 2], ' ') AS t, CAST(c AS BIGINT) AS chars, speaker, label,
        CASE WHEN part = 0 THEN m END AS mask FROM q4 JOIN q5 ON q5.media_id = q4.media_id AND q5.seg_ix = q4.seg_ix)"""


_SPOKEN = f"""r0 AS (SELECT media_id, segments, unnest(range(len(segments))) AS i FROM transcripts WHERE segments IS NOT NULL), r1 AS (SELECT media_id, CAST(i AS INTEGER) AS seg_ix, segments[i + 1] AS g FROM r0),
    r2 AS (SELECT media_id, seg_ix, g.start_s AS s, g.end_s AS e, {_strip("g.text")} AS x, nullif(g.speaker, '') AS who, g.words AS words FROM r1 WHERE g.start_s IS NOT NULL AND g.end_s IS NOT NULL AND {_strip("g.text")} <> '')"""


def _said(a: str, z: str, n: str) -> str:
    return f"{_strip(f"array_to_string(list_transform(tk[{a} + 1:{z}], lambda s{n}: s{n}.w), '')")}"


def _fits(a: str, z: str, label: str, n: str) -> str:
    """Whether words a .. z - 1 make one cue (at least two words, or one with a label)."""
    text = f"coalesce({label} || ' ', '') || {_said(a, z, n)}"
    lines = _wrap(text, n)
    return f"(len(list_filter([{lines}], lambda o{n}: len(o{n}) <= 2 AND len(list_filter(o{n}, lambda p{n}: length(p{n}) > 42)) = 0)) = 1 AND ({z} - {a} = 1 OR tk[{z}].e - tk[{a} + 1].s <= 7.0))"


_TIMED = f"""r3 AS (SELECT media_id, seg_ix, s, e, x, who AS speaker, CASE WHEN who IS NOT NULL AND who IS DISTINCT FROM last_value(who IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY seg_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN '[' || who || ']' END AS label,
        list_filter(coalesce(words, []), lambda w: w.start_s IS NOT NULL AND w.end_s IS NOT NULL AND regexp_replace(coalesce(w.word, ''), '{_WHITE}', '', 'g') <> '') AS hw, list_filter(string_split_regex(x, '{_WHITE}+'), lambda w: w <> '') AS wr FROM r2),
    r4 AS (SELECT *, lower(regexp_replace(array_to_string(list_transform(hw, lambda w: w.word), ''), '{_WHITE}', '', 'g')) = lower(array_to_string(wr, '')) AS same FROM r3),
    r5 AS (SELECT *, CASE WHEN len(hw) > 0 AND (same OR len(hw) = len(wr)) THEN list_transform(range(1, len(hw) + 1), lambda i: {{'s': list_max(list_transform(hw[1:i], lambda h: h.start_s)), 'e': greatest(hw[i].end_s, list_max(list_transform(hw[1:i], lambda h: h.start_s))),
        'w': CASE WHEN same THEN hw[i].word WHEN i = 1 THEN wr[1] ELSE ' ' || wr[i] END}}) END AS tk FROM r4),
    r6 AS (SELECT media_id, seg_ix, tk, label, len(tk) AS nt, list_transform(range(0, len(tk)), lambda k: CASE WHEN k = 0 THEN 0.0::DOUBLE ELSE tk[k + 1].s - tk[k].e END) AS gp,
        list_transform(range(0, len(tk)), lambda k: k > 0 AND regexp_matches({_strip("tk[k].w")}, '{_ENDS}')) AS cl, list_transform(range(0, len(tk)), lambda k: k > 0 AND regexp_matches({_strip("tk[k].w")}, '{_CLAUSE}')) AS cm FROM r5 WHERE tk IS NOT NULL),
    r7 AS (SELECT *, list_filter(range(1, nt), lambda k: gp[k + 1] >= 1.0 OR (gp[k + 1] >= 0.5 AND cl[k + 1])) AS forced, list_transform(range(0, nt), lambda k: CASE WHEN k = 0 THEN 0 WHEN cl[k + 1] THEN 3 WHEN gp[k + 1] >= 0.5 THEN 2 WHEN cm[k + 1] THEN 1 ELSE 0 END) AS rank FROM r6),
    cu AS (SELECT media_id, seg_ix, CAST(0 AS BIGINT) AS a, CAST([] AS BIGINT[][]) AS cues FROM r7 UNION ALL SELECT media_id, seg_ix, CASE WHEN over THEN z ELSE cut END, CASE WHEN over THEN list_concat(cues, [[a, cut], [cut, z]]) ELSE list_append(cues, [a, cut]) END FROM (
        SELECT *, z < stop AND cut < z AND NOT {_fits("cut", "(z + 1)", "NULL", "3")} AS over FROM (
            SELECT *, CASE WHEN z = stop OR len(places) = 0 OR list_max(list_transform(places, lambda k: rank[k + 1])) = 0 THEN z ELSE list_max(list_filter(places, lambda k: rank[k + 1] = list_max(list_transform(places, lambda j: rank[j + 1])))) END AS cut FROM (
                SELECT *, list_filter(range(a + 1, z), lambda k: length({_said("a", "k", "4")}) >= 0.3 * greatest(length({_said("a", "z", "5")}), 1)) AS places FROM (
                    SELECT *, coalesce(list_filter(range(a + 2, stop + 1), lambda z: NOT {_fits("a", "z", "mk", "6")})[1] - 1, stop) AS z FROM (
                        SELECT cu.media_id, cu.seg_ix, cu.a, cu.cues, tk, rank, coalesce(list_filter(forced, lambda k: k > cu.a)[1], nt) AS stop, CASE WHEN len(cues) = 0 THEN repeat(chr(1), length(label)) END AS mk
                        FROM cu JOIN r7 ON r7.media_id = cu.media_id AND r7.seg_ix = cu.seg_ix WHERE cu.a < nt)))))),
    cv AS (SELECT media_id, seg_ix, arg_max(cues, a) AS cues FROM cu GROUP BY media_id, seg_ix), cw AS (SELECT media_id, seg_ix, cues, unnest(range(len(cues))) AS part FROM cv),
    wd AS (SELECT cw.media_id, cw.seg_ix, CAST(part AS INTEGER) AS part, tk[cues[part + 1][1] + 1].s AS a, tk[cues[part + 1][2]].e AS z, coalesce(CASE WHEN part = 0 THEN repeat(chr(1), length(label)) END || ' ', '') || {_said("cues[part + 1][1]", "cues[part + 1][2]", "7")} AS t, NULL::BIGINT AS chars, speaker, label,
        CASE WHEN part = 0 THEN repeat(chr(1), length(label)) END AS mask FROM cw JOIN r5 ON r5.media_id = cw.media_id AND r5.seg_ix = cw.seg_ix),
    ev AS (SELECT media_id, seg_ix, s, e, x, speaker, label FROM r5 WHERE tk IS NULL), {_even("ev")}, al AS (SELECT * FROM wd UNION ALL SELECT * FROM pd), {_laid("al")}"""
_CUE_COLUMNS = "media_id, cue_index, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s, array_to_string(ln, chr(10)) AS lines, speaker, label"


def _flat(cues: DataFrame) -> DataFrame:
    return cues.select("media_id", "cue_index", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"), F.array_join("lines", "\n").alias("lines"), "speaker", "label")


@query(f"WITH RECURSIVE {_SPOKEN}, {_TIMED} SELECT {_CUE_COLUMNS} FROM fin")
def word_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of all recordings, cut and timed by words where they can be trusted, with labels at speaker changes."""
    return _flat(captions.build_cues(_worded(spark, folder), speaker_labels=True))


@query(f"WITH RECURSIVE {_SPOKEN}, ev AS (SELECT media_id, seg_ix, s, e, x, NULL::VARCHAR AS speaker, NULL::VARCHAR AS label FROM r2), {_even('ev')}, {_laid('pd')} SELECT {_CUE_COLUMNS} FROM fin")
def proportional_cues(spark: SparkSession, folder: str) -> DataFrame:
    """Cues of all recordings, timed by characters."""
    return _flat(captions.build_cues(_worded(spark, folder), use_words=False))


@query(f"""WITH RECURSIVE {_SPOKEN}, {_TIMED}, {_LINT.replace(_C, "c AS (SELECT media_id, cue_index, start_s, end_s, ln AS lines, speaker, label FROM fin)").replace(" q AS (", " lq AS (").replace("FROM q)", "FROM lq)").replace(" r AS (", " lr AS (").replace("FROM r)", "FROM lr)").replace(" z AS (", " lz AS (").replace(" a AS (", " la AS (").replace("FROM z GROUP", "FROM lz GROUP")} SELECT *, la.overlaps + out_of_order + wide_lines + tall_cues + empty_cues = 0 AS ok, concat_ws(' | ', n_cues || ' cues', la.overlaps || ' overlaps', fast_cues || ' above 17 chars/s (max ' || printf('%.1f', max_cps) || ')',
    wide_lines || ' lines over 42 chars', CASE WHEN out_of_order > 0 THEN out_of_order || ' out of order' END, CASE WHEN tall_cues > 0 THEN tall_cues || ' cues over 2 lines' END) AS report FROM la""")
def built_caption_lint(spark: SparkSession, folder: str) -> DataFrame:
    return captions.lint(captions.build_cues(_worded(spark, folder), speaker_labels=True))


# ---- batches ---------------------------------------------------------------------------------------------------------------


_PIECES = f"t AS (SELECT media_id, regexp_replace(text, '^{_WHITE}+|{_WHITE}+$', '', 'g') AS x FROM transcripts WHERE text IS NOT NULL), p AS (SELECT media_id, x, CASE WHEN length(x) <= 2000 THEN [x] ELSE list_filter(string_split(regexp_replace(regexp_replace(x, '([.!?]){_WHITE}+', concat('\\1', chr(1)), 'g'), '\\n+', chr(1), 'g'), chr(1)), lambda s: regexp_replace(s, '{_WHITE}', '', 'g') <> '') END AS l FROM t WHERE x <> '')"


@query(f"""WITH RECURSIVE {_PIECES}, w AS (SELECT media_id, CAST(1 AS BIGINT) AS n, [l[1]] AS acc FROM p WHERE len(l) > 0 UNION ALL
        SELECT w.media_id, n + 1, CASE WHEN length(acc[-1]) + 1 + length(l[n + 1]) <= 2000 THEN list_append(acc[1:len(acc) - 1], acc[-1] || ' ' || l[n + 1]) ELSE list_append(acc, trim(right(acc[-1], 100) || ' ' || l[n + 1])) END FROM w JOIN p ON p.media_id = w.media_id AND n < len(l)),
    f AS (SELECT media_id, arg_max(acc, n) AS acc FROM w GROUP BY media_id), g AS (SELECT media_id, acc, unnest(range(len(acc))) AS k FROM f) SELECT media_id, CAST(k AS INTEGER) AS chunk_ix, acc[k + 1] AS chunk FROM g""")
def packed_texts(spark: SparkSession, folder: str) -> DataFrame:
    return completion.packed(_texts(spark, folder), 2000, 100)


_DECODED = f"""WITH {READABLE}, f AS (SELECT *, try_cast(x ->> '$.start' AS DOUBLE) AS a, try_cast(x ->> '$.end' AS DOUBLE) AS z, trim(coalesce(x ->> '$.text', '')) AS t FROM e WHERE raw_id IN (SELECT raw_id FROM g)),
    h AS (SELECT raw_id, count(*) AS n_segments, CAST(sum(len(w)) AS BIGINT) AS n_words, min(a) AS first_start, max(z) AS last_end, coalesce(string_agg(t, ' ' ORDER BY seg_ix) FILTER (t <> ''), '') AS said FROM f GROUP BY raw_id)
    SELECT a.raw_id, coalesce(j ->> '$.language', '') AS language, coalesce(nullif(try_cast(j ->> '$.duration' AS DOUBLE), 0.0), last_end, 0.0) AS duration, coalesce(j ->> '$.model_size', '') AS model_size, coalesce(j ->> '$.diarization', '') AS diarization,
        coalesce(nullif(j ->> '$.text', ''), said, '') AS text, coalesce(n_segments, 0) AS n_segments, coalesce(n_words, 0) AS n_words, first_start, last_end FROM a JOIN g ON g.raw_id = a.raw_id LEFT JOIN h ON h.raw_id = a.raw_id"""


def _measured(rows: DataFrame) -> DataFrame:
    """Transcript rows with numbers in place of their segments."""
    sizes = F.aggregate("segments", F.lit(0).cast("long"), lambda n, s: n + F.size(s["words"]))
    edge = lambda f, name: f(F.transform("segments", lambda s: s[name]))
    return rows.select("raw_id", "language", "duration", "model_size", "diarization", "text", F.size("segments").cast("long").alias("n_segments"), sizes.alias("n_words"), edge(F.array_min, "start_s").alias("first_start"), edge(F.array_max, "end_s").alias("last_end"))


@query(_DECODED)
def transcript_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Readable payloads as transcript rows with defaults."""
    return _measured(decode_transcripts(read_table(spark, folder, "raw_transcripts"), "raw_id"))


@query(f"""WITH {READABLE} SELECT raw_id, seg_ix, try_cast(x ->> '$.start' AS DOUBLE) AS start_s, try_cast(x ->> '$.end' AS DOUBLE) AS end_s, coalesce(x ->> '$.text', '') AS text, x ->> '$.speaker' AS speaker, CAST(len(w) AS INTEGER) AS n_words,
    coalesce(array_to_string(list_transform(w, lambda y: coalesce(y ->> '$.word', '')), ''), '') AS words FROM e WHERE raw_id IN (SELECT raw_id FROM g)""")
def transcript_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments of the readable payloads."""
    rows = decode_transcripts(read_table(spark, folder, "raw_transcripts"), "raw_id").select("raw_id", F.posexplode("segments").alias("seg_ix", "x"))
    return rows.select("raw_id", "seg_ix", "x.start_s", "x.end_s", "x.text", "x.speaker", F.size("x.words").alias("n_words"), F.array_join(F.transform("x.words", lambda w: w["word"]), "").alias("words"))


@query(_DECODED)
def transcript_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Transcript rows written as JSON and read again."""
    rows = decode_transcripts(read_table(spark, folder, "raw_transcripts"), "raw_id")
    return _measured(decode_transcripts(rows.select("raw_id", transcript_json().alias("payload")), "raw_id"))


@query(f"""WITH {READABLE}, m AS (SELECT raw_id, min(seg_ix) AS k FROM e WHERE NOT coalesce(ok AND wok, false) GROUP BY raw_id) SELECT j.raw_id, CASE WHEN j.j IS NULL THEN 'broken' WHEN m.k IS NOT NULL THEN 'malformed' ELSE 'foreign' END AS kind,
        CASE WHEN j.j IS NULL THEN 'no JSON' WHEN m.k IS NOT NULL THEN 'segment ' || m.k ELSE 'no list of segments' END AS message
    FROM j JOIN raw_transcripts USING (raw_id) LEFT JOIN m ON m.raw_id = j.raw_id WHERE payload IS NOT NULL AND j.raw_id NOT IN (SELECT raw_id FROM g)""")
def unreadable_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return payload_errors(read_table(spark, folder, "raw_transcripts").where("payload IS NOT NULL"), "raw_id")


_FILES = "f AS (SELECT DISTINCT '/media/' || replace(file_name, '.transcript.json', CASE WHEN raw_id % 3 = 0 THEN '.WAV' ELSE '.mp3' END) AS path FROM raw_transcripts WHERE file_name IS NOT NULL)"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    raw = read_table(spark, folder, "raw_transcripts").where("file_name IS NOT NULL")
    suffix = F.when(F.col("raw_id") % 3 == 0, ".WAV").otherwise(".mp3")
    return batch.media_files(raw.select(F.concat(F.lit("/media/"), F.replace(F.col("file_name"), F.lit(".transcript.json"), suffix)).alias("path")).distinct())


@query(f"""WITH {_FILES}, g AS (SELECT path, regexp_extract(path, '([^/]+)(\\.[^.]+)$', 1) AS stem, regexp_extract(path, '(\\.[^.]+)$', 1) AS suffix FROM f)
    SELECT path, CASE WHEN row_number() OVER (PARTITION BY lower(stem) ORDER BY path) = 1 THEN stem ELSE stem || '-' || lower(ltrim(suffix, '.')) END AS folder FROM g""")
def folder_names(spark: SparkSession, folder: str) -> DataFrame:
    return batch.folder_names(_files(spark, folder))


@query("""WITH r AS (SELECT printf('rec-%08d', media_id) AS name, coalesce(regexp_replace(text, '[\\s\\p{Z}]+', '', 'g') <> '', false) AS ok, media_id % 7 = 0 AS skipped, coalesce(language, '') AS language, coalesce(duration, 0.0) AS duration, coalesce(len(segments), 0) AS n_outputs FROM transcripts),
    s AS (SELECT *, '## ' || name || ' — ' || CASE WHEN skipped THEN 'skipped (up to date)' WHEN ok THEN 'ok' ELSE 'FAILED' END || chr(10) || CASE WHEN skipped THEN '- outputs kept' WHEN ok THEN '- language: ' || language || chr(10) || '- duration: ' || printf('%.1f', duration) || 's' || chr(10) || '- outputs: ' || n_outputs ELSE '- error: no text' END AS section FROM r)
    SELECT '# Batch report' || chr(10) || chr(10) || 'Processed ' || count(*) || ' file(s): ' || count_if(ok) || ' succeeded, ' || (count(*) - count_if(ok)) || ' failed.' || CASE WHEN count_if(skipped) > 0 THEN ' ' || count_if(skipped) || ' already up to date (skipped).' ELSE '' END
        || chr(10) || chr(10) || string_agg(section, chr(10) || chr(10) ORDER BY name) || chr(10) AS report FROM s""")
def batch_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "transcripts").select(
        F.format_string("rec-%08d", "media_id").alias("name"), F.coalesce(F.regexp_replace("text", ft.SPACE + "+", "") != "", F.lit(False)).alias("ok"), (F.col("media_id") % 7 == 0).alias("skipped"), F.coalesce("language", F.lit("")).alias("language"),
        F.coalesce("duration", F.lit(0.0)).alias("duration"), F.coalesce(F.size("segments"), F.lit(0)).alias("n_outputs"), F.lit("no text").alias("error"),
    )
    return batch.batch_report(rows.withColumn("n_outputs", F.greatest("n_outputs", F.lit(0))))


@query("""WITH f AS (SELECT raw_id, file_name, CAST(raw_id * 10 AS BIGINT) AS size FROM raw_transcripts)
    SELECT raw_id, file_name AS name, size FROM f WHERE NOT (raw_id % 4 = 0) OR file_name IS NULL""")
def unfinished_files(spark: SparkSession, folder: str) -> DataFrame:
    """Files without a finished run: manifests exist for every second file, all their outputs for every fourth."""
    raw = read_table(spark, folder, "raw_transcripts")
    files = raw.select("raw_id", F.col("file_name").alias("name"), (F.col("raw_id") * 10).alias("size"), F.col("raw_id").cast("string").alias("folder"))
    done = raw.where("raw_id % 2 = 0").select(F.col("raw_id").cast("string").alias("folder"), F.col("file_name").alias("source_name"), (F.col("raw_id") * 10).alias("source_size"), F.array(F.lit("a.srt"), F.lit("a.vtt")).alias("outputs"))
    there = raw.select(F.col("raw_id").cast("string").alias("folder"), F.lit("a.srt").alias("output")).unionByName(raw.where("raw_id % 4 = 0").select(F.col("raw_id").cast("string").alias("folder"), F.lit("a.vtt").alias("output")))
    return batch.unfinished(files, done, there).select("raw_id", "name", "size")


@query("""SELECT media_id, to_json({tool: 'cuelake', version: '0.1.0', finished_at: strftime(finished_at, '%Y-%m-%dT%H:%M:%SZ'), source: {name: 'rec-' || media_id, size: length(text)}, language: language, duration: round_even(duration, 3), outputs: ['transcript.txt'], warnings: ['w'], captions: NULL::VARCHAR,
    options: {model: model_size, chunk: 30}})::VARCHAR AS manifest FROM transcripts""")
def manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Markers of finished runs."""
    rows = read_table(spark, folder, "transcripts").select("media_id", F.concat(F.lit("rec-"), F.col("media_id").cast("string")).alias("source_name"), F.length("text").cast("long").alias("source_size"), "language", "duration", F.array(F.lit("transcript.txt")).alias("outputs"), F.array(F.lit("w\nx")).alias("warnings"), F.lit(None).cast("string").alias("captions"), "finished_at", F.struct(F.col("model_size").alias("model"), F.lit(30).alias("chunk")).alias("options"))
    return batch.manifest(rows).select("media_id", "manifest")


@query(f"WITH {READABLE} SELECT raw_id, file_name FROM raw_transcripts WHERE raw_id IN (SELECT raw_id FROM g)")
def readable_files(spark: SparkSession, folder: str) -> DataFrame:
    return readable_payloads(read_table(spark, folder, "raw_transcripts")).select("raw_id", "file_name")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) > INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS b FROM events WHERE ts IS NOT NULL),
    f AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS session_start, max(ts) AS last_event, count(*) AS n_events FROM f GROUP BY user_id, k""")
def event_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of users by silences of more than half an hour (gap-based turns over wall-clock time)."""
    e = read_table(spark, folder, "events").where("ts IS NOT NULL")
    s = e.groupBy("user_id", F.session_window("ts", "30 minutes").alias("w")).agg(F.min("ts").alias("session_start"), F.max("ts").alias("last_event"), F.count(F.lit(1)).alias("n_events"))
    return s.drop("w")


# ---- outside models, by stand-ins ------------------------------------------------------------------------------------------


def _hears(path: str, start: float, end: float, language: str | None) -> tuple[str, list]:
    """A stand-in recogniser: a word at every whole second, four to a segment."""
    seconds = [t for t in range(math.ceil(start), math.ceil(end)) if t >= start]
    groups = [seconds[i : i + 4] for i in range(0, len(seconds), 4)]
    return language or "en", [(g[0] - start, g[-1] + 1 - start, " ".join(f"w{t}" for t in g), [(t - start, t + 1 - start, f" w{t}") for t in g]) for g in groups]


@query("""WITH d AS (SELECT media_id, coalesce(duration, 0.0) AS d FROM transcripts), e AS (SELECT media_id, d, unnest(range(0, CAST(ceil(d) AS BIGINT))) AS t FROM d)
    SELECT d.media_id, 'en' AS language, d.d AS duration, coalesce(string_agg('w' || t, ' ' ORDER BY t), '') AS text, NULL::VARCHAR AS error FROM d LEFT JOIN e ON e.media_id = d.media_id GROUP BY d.media_id, d.d""")
def recognised(spark: SparkSession, folder: str) -> DataFrame:
    """Recordings heard in overlapping chunks by a stand-in: every word comes out once, in order."""
    media = read_table(spark, folder, "transcripts").select("media_id", F.col("media_id").cast("string").alias("path"), "duration")
    return recognition.transcribe(media, recognition.once_for_each_worker("stand-in", lambda: _hears), probe=lambda path: None)[1]


@query(f"""WITH {_P}, b AS (SELECT *, bool_or(contains(text, '?')) OVER (PARTITION BY media_id, seg_ix // 40) AS bad FROM p)
    SELECT media_id, seg_ix, CASE WHEN bad THEN text ELSE 'es ' || text END AS text, CASE WHEN bad THEN 'no question' END AS error FROM b""")
def translated_segments(spark: SparkSession, folder: str) -> DataFrame:
    """Segments in another language by a stand-in that fails for batches with a question, which keep their texts."""

    def complete(messages: list[dict]) -> str:
        lines = messages[1]["content"].split("\n")
        if any("?" in x for x in lines):
            raise RuntimeError("no question")
        return "no list" if len(lines) % 2 and "numbered" in messages[0]["content"] else f"es {messages[1]['content']}" if "numbered" not in messages[0]["content"] else json.dumps([f"es {x.split('. ', 1)[1]}" for x in lines])

    return completion.translated(segments.spoken_segments(_segments(spark, folder)), complete, "Spanish")


@query(f"""WITH RECURSIVE {_RANK}, x AS (SELECT media_id, {_strip("text")} AS x FROM transcripts WHERE {_strip("text")} <> '')
    SELECT x.media_id, length(x) || ' characters' AS tldr, 's' AS summary, '' AS key_points, '' AS action_items, 'model' AS method, NULL::VARCHAR AS warning FROM x WHERE NOT contains(x, '!')
    UNION ALL SELECT su.*, 'too loud' FROM su JOIN x USING (media_id) WHERE contains(x, '!')""")
def model_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries by a stand-in model, extractive where it fails."""

    def complete(messages: list[dict]) -> str:
        text = messages[1]["content"]
        if "!" in text:
            raise RuntimeError("too loud")
        return json.dumps({"tldr": f"{len(text)} characters", "summary": "s"})

    rows = completion.summaries_or_extractive(_texts(spark, folder), complete, 1_000_000)
    return rows.select("media_id", "tldr", "summary", F.array_join("key_points", "\n").alias("key_points"), F.array_join("action_items", "\n").alias("action_items"), "method", "warning")


@query(f"""SELECT CAST(media_id AS VARCHAR) AS media_id, CASE WHEN {_strip("coalesce(text, '')")} <> '' THEN CAST(length(text) AS VARCHAR) END AS result, CASE WHEN {_strip("coalesce(text, '')")} = '' THEN 'ValueError: no text' END AS error FROM transcripts""")
def isolated_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Work on every recording; one that fails carries its error and leaves the others alone."""

    def work(text: str | None) -> str:
        if not (text or "").strip():
            raise ValueError("no text")
        return str(len(text))

    return batch.isolated(_texts(spark, folder), "media_id", "text", work)


@query("""SELECT path, regexp_matches(lower(path), '\\.(mp4|mkv|mov|avi|webm|flv|wmv|m4v|mpg|mpeg)$') AS is_video FROM (SELECT DISTINCT replace(file_name, '.transcript.json', ['.WAV', '.mp4', '.MKV', '.txt'][raw_id % 4 + 1]) AS path FROM raw_transcripts WHERE file_name IS NOT NULL)
    WHERE regexp_matches(lower(path), '.\\.(mp3|wav|m4a|flac|ogg|aac|wma|opus|mp4|mkv|mov|avi|webm|flv|wmv|m4v|mpg|mpeg)$')""")
def media_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Media among files, with and without a picture."""
    suffix = F.get(F.array(*map(F.lit, (".WAV", ".mp4", ".MKV", ".txt"))), (F.col("raw_id") % 4).cast("int"))
    raw = read_table(spark, folder, "raw_transcripts").where("file_name IS NOT NULL").select(F.replace(F.col("file_name"), F.lit(".transcript.json"), suffix).alias("path")).distinct()
    return batch.media_files(raw).select("path", "is_video")
