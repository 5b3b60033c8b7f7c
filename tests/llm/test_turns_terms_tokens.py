import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from conftest import rows_of
from cuelake.llm import distinctive, tokens, turns
from cuelake.llm.noise import canonical_speaker, clean_utterance, head_label, spoken

SEGMENT = "media_id long, seg_ix int, start_s double, end_s double, text string, speaker string"


@pytest.mark.parametrize(("label", "key"), [("Speaker 1", "speaker 1"), ("SPEAKER_01", "speaker 1"), ("S1", "speaker 1"), ("[Spk 1]", "speaker 1"), (" speaker-1:", "speaker 1"), ("Maruka (remote)", "maruka"), ("(Host)", "host"), ("?", None), ("unknown", None), (" ", None), (None, None)])
def test_speakers(label, key):
    assert canonical_speaker(label) == key


@pytest.mark.parametrize(("text", "who"), [(">> Host: hi", "host"), ("[00:01] S2: hi", "speaker 2"), ("[Speaker 3] hi", "speaker 3"), ("- SPEAKER 1: hi", "speaker 1"), ("[Music] hi", None), ("Then the caller told us: hi", None), ("主持人说：hi", None), ("hi there", None)])
def test_labels(text, who):
    assert head_label(text)[0] == who


@pytest.mark.parametrize("text", ["um, uh,", "[Music]", "(laughter)", "♪♪", "[00:00:12]", "00:01:02.345", "you know, er,", "えーと、", " ", "Host: [applause]"])
def test_nothing_spoken(text):
    assert spoken(text) == ""


def test_clean_utterance():
    assert clean_utterance("[00:12] Host: um, we met (laughter) at, uh, noon.") == "We met at, noon." or clean_utterance("[00:12] Host: um, we met (laughter) at, uh, noon.").startswith("we met")
    assert clean_utterance("What a day (really, what a day!)") == "What a day (really, what a day!)"


def test_isotonic():
    assert turns.isotonic(np.array([1.0, 3.0, 2.0, 4.0])).tolist() == [1.0, 2.5, 2.5, 4.0]
    assert turns.isotonic(np.array([5.0, 1.0, 0.0])).tolist() == [2.0, 2.0, 2.0]
    rng = np.random.default_rng(0)
    x = turns.isotonic(rng.normal(size=200))
    assert (np.diff(x) >= -1e-12).all()


def test_clock_reset_begins_a_file():
    starts = np.array([*range(0, 200, 5), *range(0, 100, 5)], float)
    assert turns.file_numbers(starts).tolist() == [0] * 40 + [1] * 20
    assert set(turns.file_numbers(np.array([0.0, 70.0, 4.0, 75.0, 80.0, 85.0, 90.0, 95.0, 100.0, 105.0])).tolist()) == {0}


def brute(rows):
    by = defaultdict(dict)
    for m, i, s, e, t, w in rows:
        by[m][i] = (s, e, t, w)
    out = []
    for m, segs in by.items():
        said = []
        for i in sorted(segs):
            s, e, t, w = segs[i]
            if t is not None and spoken(t):
                said.append((s, i, canonical_speaker(w) or head_label(t)[0]))
        runs = []
        for _, i, w in sorted(said, key=lambda x: x[:2]):
            if runs and (w is None or w == runs[-1][0]):
                runs[-1][2] = i
            else:
                runs.append([w, i, i])
        out += [(m, a, b) for _, a, b in runs]
    return sorted(out, key=repr)


@pytest.mark.parametrize("parts", [1, 3, 24])
def test_turns_equal_brute_force_over_any_partitions(spark, parts):
    rng = random.Random(parts)
    rows = []
    for m in (1, 2, 3):
        for i in range(120 if m == 2 else 25):
            rows.append((m, i, float(i) + rng.choice([0, 0, 1.5, -1.5]), float(i) + 2, rng.choice(["hello", "um,", "[Music]", "S2: yes", None, "well then"]), rng.choice(["A", "a:", "B", None, "?"])))
    rows += rows[:20]
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = rows_of(turns.speaker_turns(spark.createDataFrame(rows, SEGMENT)).select("media_id", "first_seg_ix", "last_seg_ix"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == brute(rows)


def test_file_numbers_go_on_over_blocks(spark, monkeypatch):
    rows = [(1, i, float(i % 3000) * 0.5, float(i % 3000) * 0.5 + 0.4, f"word {i}", "A" if i < 3000 else "B") for i in range(9000)]
    got = turns.speaker_turns(spark.createDataFrame(rows, SEGMENT)).collect()
    assert [(r.speaker, r.first_seg_ix, r.last_seg_ix) for r in sorted(got, key=lambda r: r.first_seg_ix)] == [("a", 0, 2999), ("b", 3000, 8999)]


def test_distinctive_terms_equal_brute_force(spark):
    rng = random.Random(2)
    words = ["bridge", "storm", "Größe", "naïve", "host", "abc", "kitchen"]
    rows = [(m, i, 0.0, 1.0, " ".join(rng.choice(words[: 3 + m]) for _ in range(5)), None) for m in range(4) for i in range(6)]
    rows += rows[:5] + [(9, 0, 0.0, 1.0, None, None), (9, 1, 0.0, 1.0, "", None)]
    got = {(r.media_id, r.term): r for r in distinctive.distinctive_terms(spark.createDataFrame(rows, SEGMENT)).collect()}
    tf, df = defaultdict(Counter), Counter()
    for m, _, _, _, t, _ in set(rows):
        for w in (t or "").split():
            if len(w) >= 4:
                tf[m][w.lower()] += 1
    total = Counter()
    for m in tf:
        total.update(tf[m])
        df.update(tf[m].keys())
    n = sum(total.values())
    for m in tf:
        for w, y in tf[m].items():
            a = 500.0 * total[w] / n
            own, rest, size = y + a, total[w] - y + a, sum(tf[m].values())
            z = (math.log(own / (size + 500.0 - own)) - math.log(rest / (n - size + 500.0 - rest))) / math.sqrt(1 / own + 1 / rest)
            assert got[m, w].z == pytest.approx(z) and got[m, w].n_recordings == df[w] and got[m, w].tf == y
    assert len(got) == sum(len(x) for x in tf.values())


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.vocabulary()


PIECES = ["the ", "ing", "a", "é", "研究", "  ", "\n", "'s", "'", "ll", "don't ", "123", "...", "!!", "ทีม", " ", "🙂", "<|endoftext|>", "\t", "हिन्दी", "한국", " ", "ﬁ", "\x1c"]


def test_ids_equal_the_whole_text_whatever_the_blocks(vocabulary):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(f"{tokens.FOLDER}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    rng = random.Random(4)
    for _ in range(400):
        s = "".join(rng.choice(PIECES) for _ in range(rng.randrange(50)))
        want = plain.encode(s, add_special_tokens=False).ids
        for block, run in ((3, 8), (7, 30), (1, 9), (1000, 1000)):
            assert tokens.encode(s, vocabulary, block, run) == want
        assert tokens.decode(want, vocabulary) == s


def test_endless_runs_hold_a_bounded_part(vocabulary):
    rng = random.Random(5)
    s = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    e = tokens.Encoder(vocabulary, 512)
    out = []
    for i in range(0, len(s), 256):
        out += e.feed(s[i : i + 256])
        assert len(e.text) + (len(e.run.data) if e.run else 0) < 512 + 256 + 6 * vocabulary.lookahead
    assert out + e.finish() == vocabulary.coder.encode_ordinary(s)


def test_decoder_keeps_unfinished_characters(vocabulary):
    ids = tokens.encode("🙂研", vocabulary)
    d = tokens.Decoder(vocabulary)
    assert "".join(d.feed([i]) for i in ids) + d.finish() == "🙂研"
    assert tokens.encode(None, vocabulary) == tokens.encode("", vocabulary) == [] and tokens.decode(None, vocabulary) == ""


@pytest.mark.parametrize(("first", "second"), [(4090, 200), (4096, 20), (4100, 20), (100, 3), (4090, 3), (4094, 5)])
def test_reset_near_the_edge_of_a_block_or_the_end(spark, first, second):
    """The second file's turns come after the first file's, wherever the clock starts again."""
    starts = [2.0 * i for i in range(first)] + [1.0 * i for i in range(second)]
    rows = [(1, i, t, t + 0.9, "So it goes.", "AB"[i % 2], None) for i, t in enumerate(starts)]
    df = spark.createDataFrame(rows, "media_id long, seg_ix int, start_s double, end_s double, text string, speaker string, ingested_at timestamp")
    got = sorted((r.first_seg_ix, r.last_seg_ix) for r in turns.speaker_turns(df).collect())
    # Turns of one speaker go on over the border of the files only if the speaker does.
    assert got == [(i, i) for i in range(first + second)]


@pytest.mark.parametrize("word", ["বাংলা", "தமிழ்", "Հայերեն", "ქართული", "አማርኛ", "ꦗꦮ"])
def test_the_buffer_stays_bounded_in_every_script(word):
    v = tokens.vocabulary()
    text = f"{word} " * (200_000 // (len(word) + 1))
    e, out, most = tokens.Encoder(v), [], 0
    for i in range(0, len(text), 4096):
        out += e.feed(text[i : i + 4096])
        most = max(most, len(e.text))
    assert most < 8192
    assert out + e.finish() == v.coder.encode_ordinary(text)
