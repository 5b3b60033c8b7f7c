import json
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import rows_of
from cuelake.functions import text as ft
from cuelake.functions import times as fm
from cuelake.operators import batch, captions, chapters, completion, recognition, segments, summary, terms
from cuelake.sources import files

SEGMENT = "media_id long, seg_ix int, start_s double, end_s double, text string, speaker string"


def seg(spark, rows):
    return spark.createDataFrame([(1, i, *r) for i, r in enumerate(rows)], SEGMENT)


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("seconds", "srt", "chapter"), [(0.0, "00:00:00,000", "00:00"), (None, "00:00:00,000", "00:00"), (-3.0, "00:00:00,000", "00:00"), (61.0005, "00:01:01,000", "01:01"), (59.9996, "00:01:00,000", "00:59"), (3661.5, "01:01:01,500", "1:01:01"), (360000.0, "100:00:00,000", "100:00:00")]
)
def test_timestamps(spark, seconds, srt, chapter):
    c = F.lit(seconds).cast("double")
    assert one(spark, fm.format_timestamp(c)) == srt
    assert one(spark, fm.format_chapter_timestamp(c)) == chapter


@pytest.mark.parametrize(("text", "value"), [("01:02", 62.0), ("1:00:01,5", 3601.5), (" 00:01.250 ", 1.25), ("x", None), ("", None), ("1:2:3:4", None), ("a:b", None)])
def test_parse_timestamp(spark, text, value):
    assert one(spark, fm.parse_timestamp(F.lit(text))) == value


def test_turns_pass_on_after_silence_only(spark):
    df = seg(spark, [(0.0, 1.0, "a", None), (2.0, 3.0, "b", None), (4.5, 5.0, "c", None), (7.0, 8.0, "d", None)])
    got = [(r.seg_ix, r.turn, r.speaker) for r in segments.speaker_turns(df).orderBy("seg_ix").collect()]
    assert got == [(0, 0, "Speaker 1"), (1, 0, "Speaker 1"), (2, 1, "Speaker 2"), (3, 2, "Speaker 1")]
    with pytest.raises(ValueError, match="at least"):
        segments.speaker_turns(df, speakers=0)


def test_dialogue_and_paragraphs(spark):
    df = seg(spark, [(0.0, 1.0, " Hi ", "A"), (1.0, 2.0, "there", "A"), (2.0, 2.5, "  ", "B"), (2.5, 3.0, "Yes", None), (9.0, 10.0, "No", "A")])
    assert segments.dialogue(df).first()["dialogue"] == "A: Hi there\n\nSpeaker 1: Yes\n\nA: No"
    assert [r.paragraph for r in segments.paragraphs(df).orderBy("paragraph_ix").collect()] == ["Hi there Yes", "No"]


def test_two_recordings_never_meet_and_order_is_free(spark):
    a = seg(spark, [(0.0, 1.0, "x", "A"), (1.0, 2.0, "y", "A")])
    b = a.withColumn("media_id", F.lit(2).cast("long"))
    both = a.unionByName(b).orderBy(F.desc("seg_ix"))
    assert rows_of(segments.dialogue(both)) == [(1, "A: x y"), (2, "A: x y")]


@pytest.mark.parametrize(("duration", "want"), [(0.0, [(0.0, 0.0)]), (20.0, [(0.0, 20.0)]), (30.0, [(0.0, 30.0)]), (58.0, [(0.0, 30.0), (28.0, 58.0)]), (59.0, [(0.0, 30.0), (28.0, 58.0), (56.0, 59.0)])])
def test_chunk_windows(spark, duration, want):
    w = segments.chunk_windows(spark.createDataFrame([(1, duration)], "media_id long, duration double")).orderBy("chunk_ix").collect()
    assert [(r.chunk_start, r.chunk_end) for r in w] == want
    assert w[0].lo is None and w[-1].hi is None


def test_chunks_lose_and_double_nothing(spark):
    """A recogniser that hears a word every two seconds, decoded in overlapping chunks."""
    said = [(2.0 * i, 2.0 * i + 1.5, f" w{i}") for i in range(35)]

    def recognise(path, start, end, language):
        found = [(s - start, e - start, w.strip(), [(s - start, e - start, w)]) for s, e, w in said if s < end and e > start]
        return language or "en", found

    media = spark.createDataFrame([(1, "a.wav", 70.0)], "media_id long, path string, duration double")
    merged, recordings = recognition.transcribe(media, recognise)
    got = merged.orderBy("seg_ix").collect()
    assert [r.text for r in got] == [w.strip() for _, _, w in said] and [r.seg_ix for r in got] == list(range(35))
    assert recordings.first().language == "en" and recordings.first().text == " ".join(w.strip() for _, _, w in said)


def test_straddling_segment_is_rebuilt(spark):
    words = [(20.0, 21.0, " a"), (24.0, 25.0, " b"), (25.0, 26.0, " c"), (27.0, 28.0, " d")]
    schema = "media_id long, start_s double, end_s double, text string, words array<struct<start_s:double,end_s:double,word:string>>, lo double, hi double"
    df = spark.createDataFrame([(1, 20.0, 28.5, "a b c d", words, None, 25.0), (2, 20.0, 28.5, "a b c d", words, 25.0, None), (3, 24.0, 26.0, "bare", [], None, 25.0), (4, 25.0, 26.0, "bare", [], None, 25.0)], schema)
    got = {r.media_id: (r.start_s, r.end_s, r.text) for r in segments.stitch(df).collect()}
    assert got == {1: (20.0, 25.0, "a b"), 2: (25.0, 28.5, "c d"), 3: (24.0, 26.0, "bare")}


def test_most_overlap_wins_over_buckets(spark):
    df = seg(spark, [(50.0, 130.0, "a", None), (200.0, 201.0, "b", None), (300.0, 302.0, "c", None)])
    turns = spark.createDataFrame([(1, 0, 40.0, 80.0, "X"), (1, 1, 80.0, 200.0, "Y"), (1, 2, 299.0, 301.0, "P"), (1, 3, 301.0, 302.0, "Q")], "media_id long, turn_ix int, t_start double, t_end double, t_speaker string")
    assert [r.speaker for r in segments.overlap_speakers(df, turns).orderBy("seg_ix").collect()] == ["Y", "Speaker 1", "P"]


def test_buckets_anchor_on_their_first_segment(spark):
    df = seg(spark, [(0.0, 10.0, "a", None), (10.0, 31.0, "b", None), (31.0, 40.0, "c", None), (40.0, 60.0, "d", None), (60.0, 62.0, "e", None)])
    assert [(r.bucket_start, r.bucket_text) for r in segments.timed_buckets(df).orderBy("bucket_ix").collect()] == [(0.0, "a b"), (31.0, "c d e")]


def test_sentences_and_run_ons(spark):
    text = 'He said "Go." Then left. ¿Qué pasa? ¡Nada! 3 items.\nnew line\n' + "w " * 130
    got = one(spark, ft.split_sentences(F.lit(text)))
    assert got[:6] == ['He said "Go."', "Then left.", "¿Qué pasa?", "¡Nada!", "3 items.", "new line"]
    assert [len(s.split()) for s in got[6:]] == [30, 30, 30, 30, 10]


@pytest.mark.parametrize(("sentence", "want"), [("We need to call them.", True), ("Let’s talk about it.", False), ("Let's talk, and we must pay.", True), ("Do we need to go?", False), ("Hay que llamar mañana.", True), ("Vamos a hablar de todo.", False), ("It rains.", False)])
def test_action_items(spark, sentence, want):
    assert one(spark, ft.is_action_item(F.lit(sentence))) is want


def test_fold(spark):
    for s in ["También Ñandú", "ÀÉÎÕÜ çß", "Ёлка", "がぎぐ", "हिन्दी डॉ", "ΆΈΉ"]:
        assert one(spark, ft.fold(F.lit(s))) == ft.fold_python(s)


def test_summary_reply(spark):
    reply = 'Sure:\n```{"tldr": " a ", "summary": "b", "key_points": ["x", " "], "action_items": null}```'
    s = one(spark, ft.parse_summary(F.lit(reply)))
    assert (s.tldr, s.summary, s.key_points, s.action_items) == ("a", "b", ["x"], [])
    assert one(spark, ft.parse_summary(F.lit(" no json "))).summary == "no json"


def text_rank(vectors, n, d=0.85):
    w = [[0.0] * n for _ in range(n)]
    for i in range(n):
        for j in range(n):
            if i != j:
                w[i][j] = sum(x * vectors[j].get(t, 0.0) for t, x in vectors[i].items())
    score = [1 / n] * n
    for _ in range(60):
        new = [(1 - d) / n + d * sum(score[i] * w[i][j] / sum(w[i]) for i in range(n) if sum(w[i]) > 0) for j in range(n)]
        if sum(abs(a - b) for a, b in zip(new, score, strict=True)) < 1e-9:
            return new
        score = new
    return score


def test_text_rank_and_centroid_equal_plain_loops(spark):
    text = "Copper pipes carry water. The copper pipes leak. Water leaks from pipes in winter. Nobody likes winter. Yes no."
    s = terms.sentences(spark.createDataFrame([(1, text)], "media_id long, text string"))
    t = terms.sentence_terms(s)
    v = terms.vectors(t, terms.inverse_frequency(t, s))
    held = {}
    for r in v.collect():
        held.setdefault(r.sent_ix, {})[r.term] = r.w
    n = s.count()
    vectors = [held.get(i, {}) for i in range(n)]
    assert all(abs(sum(x * x for x in u.values()) - 1) < 1e-9 for u in vectors if u)
    got = [r.score for r in terms.text_rank(v, s).orderBy("sent_ix").collect()]
    assert got == pytest.approx(text_rank(vectors, n), abs=1e-6)
    total = {}
    for u in vectors:
        for k, x in u.items():
            total[k] = total.get(k, 0.0) + x
    norm = math.sqrt(sum(x * x for x in total.values()))
    want = {i: sum(x * total[k] / norm for k, x in u.items()) for i, u in enumerate(vectors) if u}
    assert {r.sent_ix: r.score for r in terms.centroid(v).collect()} == pytest.approx(want)


def test_summary_has_no_twins_and_keeps_order(spark):
    rng = random.Random(1)
    words = ["copper", "winter", "river", "kitchen", "garden", "market", "bridge", "signal"]
    text = " ".join(f"The {rng.choice(words)} meets the {rng.choice(words)} beside {rng.choice(words)} number {i}." for i in range(40)) + " We need to buy copper. We need to buy copper."
    for limit in (700, 10):
        r = summary.summaries(spark.createDataFrame([(1, text), (2, text)], "media_id long, text string"), limit=limit).orderBy("media_id").collect()
        assert r[0].tldr == r[1].tldr and r[0].tldr in r[0].summary
        assert r[0].action_items == ["We need to buy copper."]
        assert 3 <= len(r[0].key_points) <= 6 and not set(r[0].key_points) & set(re.split(r"(?<=\.) ", r[0].summary))
    md = summary.summary_markdown(summary.summaries(spark.createDataFrame([(1, text)], "media_id long, text string"))).first()["markdown"]
    assert md.startswith("# Summary\n\n_Offline") and "- [ ] We need to buy copper.\n" in md


def topic_stream(spark):
    rng = random.Random(3)
    topics = [["copper", "pipes", "boiler", "radiator", "valve"], ["violin", "concert", "orchestra", "melody", "rhythm"], ["harvest", "tractor", "wheat", "barley", "meadow"]]
    rows = [(5.0 * i, 5.0 * i + 4.5, " ".join(rng.choice(topics[i // 24]) for _ in range(8)), None) for i in range(72)]
    return seg(spark, rows)


def test_chapters_follow_topics_whatever_the_row_order(spark):
    df = topic_stream(spark)
    a = rows_of(chapters.chapters(df).orderBy("chapter_no"))
    assert [r[2] for r in a] == [0.0, 120.0, 240.0]
    assert rows_of(chapters.chapters(df.orderBy(F.rand(1)).repartition(5))) == a
    assert len({r[3] for r in a}) == 3


def _regular(spark, items, duration):
    rows = spark.createDataFrame([(1, i, s, t, duration) for i, (s, t) in enumerate(items)], "media_id long, place int, start_s double, title string, duration double")
    return [(r.start_s, r.title) for r in chapters.numbered(chapters.regular(rows)).orderBy("chapter_no").collect()]


def test_chapter_choice_and_normalisation(spark):
    assert chapters.choose_starts([(0.9, 100.0), (0.95, 130.0), (0.5, 30.0), (3.0, 300.0)], 340.0, 5) == [0.0, 130.0]
    assert _regular(spark, [(5.0, "- A -"), (8.0, " B "), (70.0, "B"), (100.0, "C"), (130.0, "b"), (200.0, ""), (299.0, "late")], 300.0) == [(0.0, "B"), (100.0, "C"), (130.0, "b (part 2)")]
    assert _regular(spark, [(50.0, "A")], None) == [(0.0, "Intro"), (50.0, "A")]
    assert _regular(spark, [(1.0, "A"), (40.0, "a"), (45.0, "B")], None) == [(0.0, "A"), (45.0, "B")]
    assert _regular(spark, [], 10.0) == []
    assert chapters.with_least([0.0], [10.0, 40.0, 60.0, 90.0], [None, 0.4, 0.1, 0.2], 100.0, 2, 30.0) == [0.0, 60.0]
    assert chapters.with_least([0.0], [10.0], [None], 100.0, 3, 30.0) == [0.0]


def test_titles_stay_unique():
    used = set()
    made = [chapters.unique_title(w, used, 3, "Part 9") for w in (["A", "B", "C", "D"], ["A", "B", "C", "D"], ["a", "b", "c", "d"], [], [])]
    assert made == ["A B C", "A B D", "a b d (part 2)", "Part 9", "Part 9 (part 2)"]


def test_line_layout():
    assert captions.wrap("a bb ccc", 4) == ["a bb", "ccc"]
    assert captions.wrap("x" * 50 + " y", 42) == ["x" * 50, "y"]
    assert captions.balance("I tested the backup drive and the restore took an hour", 42) == ["I tested the backup drive", "and the restore took an hour"]
    assert captions.balance("Thanks, Leo. I want to start with the first thing", 42)[0] == "Thanks, Leo."


@pytest.mark.parametrize("seed", range(6))
def test_cues_are_readable_sequential_and_lose_nothing(spark, seed):
    rng = random.Random(seed)
    rows, at = [], 0.0
    for media in (1, 2):
        at = 0.0
        for i in range(12):
            words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", "."]) for _ in range(rng.randint(1, 30))]
            start, timed = at, []
            for w in words:
                timed.append((at, at + 0.3, f" {w}"))
                at += rng.choice([0.3, 0.31, 0.9, 1.6])
            rows.append((media, i, start, at, " ".join(words), rng.choice([None, "A", "B"]), timed if rng.random() < 0.7 else None))
            at += rng.choice([-0.5, 0.0, 2.0])
    df = spark.createDataFrame(rows, SEGMENT + ", words array<struct<start_s:double,end_s:double,word:string>>")
    for labels in (False, True):
        cues = captions.build_cues(df, speaker_labels=labels).orderBy("media_id", "cue_index").collect()
        for media in (1, 2):
            own = [c for c in cues if c.media_id == media]
            assert [c.cue_index for c in own] == list(range(1, len(own) + 1))
            assert all(a.end_s <= b.start_s + 1e-9 for a, b in zip(own, own[1:], strict=False))
            assert all(len(x) <= 42 and len(c.lines) <= 2 for c in own for x in c.lines)
            said = " ".join(re.sub(r"^\[\w\] ", "", " ".join(c.lines)) for c in own).split()
            assert sorted(said) == sorted(w for r in rows if r[0] == media for w in r[4].split())
    r = captions.lint(captions.build_cues(df)).first()
    assert r.overlaps == 0 and r.wide_lines == 0


def test_captions_round_trip(spark):
    cues = spark.createDataFrame([(1, 1, 0.0, 1.0, ["a --> b", "<c>"], "A&B", None), (1, 2, 1.0, 2.5, ["[A&B] x"], "A&B", "[A&B]")], "media_id long, cue_index int, start_s double, end_s double, lines array<string>, speaker string, label string")
    assert captions.to_srt(cues).first()["srt"] == "1\n00:00:00,000 --> 00:00:01,000\na -> b\n<c>\n\n2\n00:00:01,000 --> 00:00:02,500\n[A&B] x\n"
    assert captions.to_vtt(cues).first()["vtt"] == "WEBVTT\n\n00:00:00.000 --> 00:00:01.000\n<v A&amp;B>a --&gt; b\n&lt;c&gt;\n\n00:00:01.000 --> 00:00:02.500\n<v A&amp;B>x\n"


def test_packing_keeps_its_tail():
    text = " ".join(f"Sentence number {i}." for i in range(60))
    chunks = completion.pack_text(text, 200, 20)
    assert chunks[1].startswith(chunks[0][-20:].strip()) and all(len(c) <= 220 for c in chunks)
    assert completion.pack_text("x" * 900, 200) == ["x" * 900] and completion.pack_text(" ") == []


def test_map_reduce_and_translation(spark):
    def complete(messages):
        text = messages[1]["content"]
        if "Translate" in messages[0]["content"]:
            return json.dumps([line.split(". ", 1)[1].upper() for line in text.split("\n")]) if "JSON" in messages[0]["content"] and "bad" not in text else "?" if "JSON" in messages[0]["content"] else text.upper()
        return json.dumps({"tldr": str(len(text)), "summary": "s", "key_points": [], "action_items": []})

    texts = spark.createDataFrame([(1, "Short."), (2, "Sentence here. " * 40)], "media_id long, text string")
    got = {r.media_id: r.summary.tldr for r in completion.map_reduce_summary(texts, complete, 200).collect()}
    assert got[1] == "6" and got[2] != "600"
    df = spark.createDataFrame([(1, 0, "one"), (1, 1, "two"), (1, 40, "bad")], "media_id long, seg_ix int, text string")
    assert rows_of(completion.translated(df, complete, "Spanish")) == [(1, 0, "ONE", None), (1, 1, "TWO", None), (1, 40, "BAD", None)]


def test_retries():
    waits, answers = [], [(503, {"Retry-After": "200"}, "x"), (429, {}, "y"), (200, {}, "done")]
    assert completion.with_retries(lambda: answers.pop(0), sleep=waits.append, rng=lambda: 0.5) == "done"
    assert waits == [90.0, 1.5]
    with pytest.raises(completion.ServiceError) as e:
        completion.with_retries(lambda: (401, {}, "no key"), sleep=waits.append)
    assert e.value.fatal and e.value.attempts == 1


def test_folder_names(spark):
    paths = ["/m/ep01.mp3", "/m/ep01.wav", "/m/EP01.MP4", "/m/ep01-wav.mp3", "/m/b.flac", "/m/notes.txt", "/m/.mp3"]
    named = batch.folder_names(batch.media_files(spark.createDataFrame([(p,) for p in paths], "path string")))
    got = {r.path: r.folder for r in named.collect()}
    assert set(got) == {p for p in paths if p.lower().endswith((".mp3", ".wav", ".mp4", ".flac")) and p != "/m/.mp3"}
    assert len({f.lower() for f in got.values()}) == len(got)
    assert got["/m/b.flac"] == "b" and got["/m/EP01.MP4"] == "EP01" and got["/m/ep01.mp3"] == "ep01-mp3"


def test_isolated_failures(spark):
    df = spark.createDataFrame([(1, "a"), (2, "boom"), (3, "c")], "media_id long, text string")

    def work(t):
        if t == "boom":
            raise ValueError("bad\ntext")
        return t.upper()

    assert rows_of(batch.isolated(df, "media_id", "text", work)) == [("1", "A", None), ("2", None, "ValueError: bad text"), ("3", "C", None)]


def test_files_round_trip(spark, tmp_path):
    raw = spark.createDataFrame([(1, '{"language":"en","segments":[{"start":0,"end":2,"text":"Hi","speaker":"A","words":[{"start":0,"end":1,"word":" Hi"}]}]}')], "raw_id long, payload string")
    t = files.decode_transcripts(raw, "raw_id")
    r = t.first()
    assert (r.duration, r.text, r.language, r.segments[0].words[0].word) == (2.0, "Hi", "en", " Hi")
    files.write_files(t.select(F.lit("one/transcript.json").alias("path"), files.transcript_json().alias("content")), str(tmp_path))
    again = files.decode_transcripts(files.read_payloads(spark, str(tmp_path / "one")), "path").first()
    assert (again.segments, again.text, again.duration) == (r.segments, r.text, r.duration)
    assert [x.path.rsplit("/", 1)[-1] for x in files.media_listing(spark, str(tmp_path / "one")).collect()] == ["transcript.json"]


def test_blocks_of_a_long_recording_are_tied(spark, monkeypatch):
    from cuelake.operators import ordered

    rng = random.Random(9)
    rows, at = [], 0.0
    for i in sorted(rng.sample(range(60), 40)):
        rows.append((1, i, at, at + 1.0, f"w{i}", rng.choice(["A", "B"])))
        at += rng.choice([1.0, 3.0, 3.5])
    df = spark.createDataFrame(rows, SEGMENT)
    whole = [rows_of(f(df)) for f in (segments.speaker_turns, segments.dialogue, segments.paragraphs)]
    monkeypatch.setattr(ordered, "BLOCK", 7)
    assert [rows_of(f(df)) for f in (segments.speaker_turns, segments.dialogue, segments.paragraphs)] == whole
