import math
import random
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cuelake.llm import abuse, mixing
from cuelake.llm.abuse_examples import EXAMPLES


@given(st.dictionaries(st.integers(0, 8), st.floats(0.01, 10), min_size=1), st.integers(0, 200))
@settings(max_examples=150, deadline=None)
def test_sainte_lague_is_highest_quotients(weights, seats):
    want = dict.fromkeys(weights, 0)
    for _ in range(seats):
        k = max(weights, key=lambda k: weights[k] / (2 * want[k] + 1))
        want[k] += 1
    got = mixing.sainte_lague(weights, seats)
    assert sum(got.values()) == seats
    # Equal up to ties of quotients.
    q = lambda r: sorted(round(weights[k] / (2 * i + 1), 9) for k in weights for i in range(r[k]))
    assert q(got) == pytest.approx(q(want))


@pytest.mark.parametrize("shards", [1, 4])
def test_mix_reaches_its_shares_within_the_caps(spark, shards):
    rng = random.Random(shards)
    words = ["bridge", "storm", "host", "kitchen", "river"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(20, 60))), rng.choices(["big", "Small ", "mid", "none"], [80, 5, 15, 5])[0]) for i in range(1500)]
    documents = spark.createDataFrame([*rows, (9001, None, "big"), (9002, "", "big"), (9003, "x y", None)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.2, 4), ("mid", 0.15, 2), ("gone", 0.05, 2)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(documents, targets, block=64, shards=shards)
    caps = {"big": 1, "small": 4, "mid": 2}
    got = mixed.collect()
    assert all(1 <= r.n_times <= caps[r.source] for r in got) and len({r.doc_id for r in got}) == len(got)
    shares = {r.source: r.actual_share for r in report.collect()}
    for s, want in (("big", 0.6 / 0.95), ("small", 0.2 / 0.95), ("mid", 0.15 / 0.95), ("gone", 0.0)):
        assert shares[s] == pytest.approx(want, abs=0.01)
    again = mixing.mix(documents.repartition(7), targets, block=64, shards=shards)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_small_sources_are_not_torn_and_long_documents_count(spark, monkeypatch):
    """A source of a hundred documents beside one of many shards reaches its quota; the order doesn't prefer short ones."""
    monkeypatch.setattr(mixing, "PER_SHARD", 50)
    rows = [(i, "bridge storm " * 50, "small") for i in range(100)] + [(1000 + i, "river host " * (5 + i % 60), "big") for i in range(4000)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("small", 0.05, 1), ("big", 0.95, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(documents, targets)
    shares = {r.source: r.actual_share for r in report.collect()}
    assert shares["small"] == pytest.approx(0.05, abs=0.005)
    sizes = [r.n_tokens for r in mixed.where("source = 'big'").collect()]
    whole = [r.n for r in mixing.sized_documents(documents, ["big"]).selectExpr("n_tokens AS n").collect()]
    assert sum(sizes) / len(sizes) == pytest.approx(sum(whole) / len(whole), rel=0.1)


def test_mix_of_nothing(spark):
    documents = spark.createDataFrame([(1, "a", "x")], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("y", 1.0, 1)], "source string, target_share double, max_repeats int")
    mixed, report = mixing.mix(documents, targets)
    assert mixed.count() == 0 and report.first().actual_share == 0.0


@pytest.mark.parametrize(("a", "b"), [("sh**ld", "should"), ("4g41n", "again"), ("bellllong", "belong"), ("IDIOT", "idiot"), ("imbécil", "imbecil"), ("nасkt", "nackt")])
def test_disguises_share_a_spelling(a, b):
    assert abuse.spelling(a) == abuse.spelling(b)


def test_letters_set_apart_are_joined():
    assert abuse.terms("you f o o l , stop") == abuse.terms("you fool , stop")


@pytest.fixture(scope="module")
def index():
    own = [(c, s) for c, v in EXAMPLES.items() for s in v.strip().split("\n")]
    counts = Counter(t for _, s in own for t in set(abuse.terms(s)))
    return abuse.Index(own, counts, len(own))


def test_block_max_search_is_exact(index):
    rng = random.Random(6)
    words = [w for _, s in index.examples for w in s.split()]
    for _ in range(300):
        v = index.vector(abuse.words_of(" ".join(rng.choice(words) for _ in range(rng.randint(1, 12)))))
        scores = Counter()
        for t, x in v.items():
            for i, w in zip(*index.postings[t], strict=True):
                scores[i] += x * w
        want = sorted(((s, i) for i, s in scores.items()), key=lambda r: (-r[0], r[1]))[: abuse.K]
        got = index.nearest(v)
        assert [round(s, 9) for s, _ in got] == [round(s, 9) for s, _ in want]
        best = max((s for i, s in scores.items() if index.labels[i] != "none"), default=0.0)
        assert index.bound(v) >= best - 1e-9


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("HOST: You are the dumb*st jerk, you m0ron, you i d i o t.", {"abuse"}), ("Their race should be w*ped out, put them all in camps.", {"hate"}), ("Watching p0rn made me so h o r n y, send nude photos.", {"sexual"}),
        ("I felt like such an idiot when I lost my ticket.", set()), ("The court heard that he had threatened his neighbour.", set()), ("The nurse explained breast screening to the class.", set()), ("", set()),
    ],
)
def test_categories_of_written_examples_in_disguise(index, text, want):
    scores = abuse.Scorer(index, []).document(text)
    assert {c for c, x in scores.items() if x >= 0.5} == want


def test_captions_are_joined_over_cues():
    text = "1\n00:00:01,000 --> 00:00:02,000\nKill the child process first, then\n\n2\n00:00:02,000 --> 00:00:03,000\nthe dumb terminal comes back."
    assert abuse.units(text) == ["Kill the child process first, then the dumb terminal comes back."]


THAI_RUN = ["ทีมวิจัยลืมรายการคำถามหลังจากเงียบไปนาน", "ช่างเสียงย้ายรายงานการเก็บเกี่ยว", "แขกรับเชิญอธิบายตารางเรือก่อนอาหารกลางวันครับ", "พิธีกรทดสอบซอสมะเขือเทศตอนสิ้นเดือน"] * 4


@pytest.mark.parametrize("said", ["แกมันไอ้โง่ หุบปากซะ", "แกมันไอ้โง่\nหุบปากซะ"])
def test_abuse_inside_long_thai_texts(index, said):
    """A part of a long line or of a caption file without any final mark."""
    line = " ".join([*THAI_RUN[:8], said.replace("\n", " "), *THAI_RUN[8:]])
    cues = [*THAI_RUN[:8], said, *THAI_RUN[8:]]
    stamp = "00:00:0{}.000 --> 00:00:0{}.500".format
    captions = "WEBVTT\n\n" + "\n\n".join(f"{stamp(i % 10, i % 10)}\n{c}" for i, c in enumerate(cues))
    for text in (line, captions):
        assert abuse.Scorer(index, []).document(text).get("abuse", 0.0) >= 0.5
    assert abuse.Scorer(index, []).document(" ".join(THAI_RUN)) == {}


@pytest.mark.parametrize("end", ["\r", "\v", "\x0c", "\x85", "\u2028", "\u2029", "\u0965 ", "\uff0e"])
def test_units_end_at_line_ends_and_marks(end):
    assert [u.rstrip("\u0965\uff0e") for u in abuse.units(f"erster Teil{end}zweiter Teil")] == ["erster Teil", "zweiter Teil"]


def test_units_end_at_greek_question_marks():
    assert abuse.units("Ποιος είδε; Μετά ήρθε\u037e Τέλος") == ["Ποιος είδε;", "Μετά ήρθε\u037e", "Τέλος"]
    assert abuse.units("1\r00:00:01,000 --> 00:00:02,000\rKill the child\r\r2\r00:00:02,000 --> 00:00:03,000\rprocess first.") == ["Kill the child process first."]


#: Frames of toxic sentences that no written example has, and of harmless ones; slots make instances differ.
FRAMES = {
    "abuse": ["Get out of my studio, you {} coward, before I smash your teeth.", "Only a {} idiot like you would ruin a {} show.", "Choke on your {} soup, you worthless liar."],
    "hate": ["Every one of those {} islanders is a thief and a parasite.", "Burn the {} homes of the islanders and drive them out.", "The islanders breed like {} rats and spread disease."],
    "sexual": ["He licked her {} nipples until she moaned in the {} tent.", "Naked and horny they fucked behind the {} curtain.", "Send me nude photos from the {} bath, I want sex."],
}
HARMLESS = ["The host praised the {} bridge on the way home.", "We had to wait for the {} ferry before lunch.", "Nobody had planned the {} storm of that day.", "The choir sang a {} song in the {} hall.", "A reporter read the {} list of questions."]
SLOTS = "red blue old new tall wooden silver broken quiet narrow heavy golden empty frozen painted distant".split()


def _labelled_corpus(seed, n=600, wrong=0.05):
    """(texts, true categories, labels of the first half) of documents with invented sentences."""
    rng = random.Random(seed)
    fill = lambda f: f.format(*(rng.choice(SLOTS) for _ in range(2)))
    texts, truth, labels = [], [], []
    for i in range(n):
        c = rng.choice(abuse.CATEGORIES) if i % 4 == 0 else None
        said = [fill(f) for f in rng.sample(HARMLESS, 3)] + ([fill(rng.choice(FRAMES[c]))] if c else [])
        rng.shuffle(said)
        texts.append(" ".join(said))
        truth.append(c)
        labels.append(int((c is not None) != (rng.random() < wrong)))
    return texts, truth, labels


def test_held_out_accuracy(spark):
    """Examples are learned from labelled documents, one in twenty labels wrong; documents without a label are judged."""
    texts, truth, toxic = _labelled_corpus(7)
    documents = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, toxic[i]) for i in range(400)], "doc_id long, toxic int")
    held = {(r.doc_id, r.category) for r in abuse.held_categories(abuse.score_documents(documents, labels)).collect() if r.doc_id >= 400}
    want = {(i, c) for i, c in enumerate(truth) if c and i >= 400}
    assert len(held & want) / len(want) > 0.9 and len(held - want) / max(1, len(held)) < 0.05


def test_no_written_example_stands_in_the_test_tables():
    """Examples must not be taken from the texts on which the operator is measured."""
    import os

    import duckdb

    if not os.path.isdir("/root/testdata/sf0.1"):
        pytest.skip("needs the test tables")
    texts = duckdb.connect().sql("SELECT lower(text) FROM '/root/testdata/sf0.1/documents.parquet' WHERE text IS NOT NULL").fetchall()
    whole = "\n".join(t for (t,) in texts)
    assert [s for v in EXAMPLES.values() for s in v.strip().split("\n") if s.lower() in whole] == []


def test_cosine_over_frequencies_of_all_terms(spark):
    """Common words outside the examples weigh little, rare ones much: scores are those of a plain TF-IDF cosine."""
    common = "window lantern copper meadow violin harbour"
    texts = [f"{common}. Number {w} came." for w in ("one", "two", "red", "blue", "far", "near")] * 5
    said = "You filthy liar, you pig, you rat, go to hell and rot there"
    texts += [f"{said} {common}.", f"{said} xylophone quagmire zeppelin obelisk walrus tundra."]
    documents = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    n = Counter(t for x in texts for t in {t for u in abuse.units(x) for t in abuse.terms(u)})
    idf = lambda t: math.log((1 + len(texts)) / (1 + n[t])) + 1

    def vector(s):
        w = {t: k * idf(t) for t, k in abuse.terms(s).items()}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {t: x / norm for t, x in w.items()}

    own = [(c, s) for c, v in EXAMPLES.items() for s in v.strip().split("\n")]
    exact = abuse.Index(own, n, len(texts))
    got = {r.doc_id: r for r in abuse.score_documents(documents, labels).collect()}
    assert len(got) == len(texts)
    for i in (len(texts) - 2, len(texts) - 1):
        v = vector(texts[i])
        plain = sorted((-round(sum(x * v.get(t, 0.0) for t, x in vector(s).items()), 9), k) for k, (_, s) in enumerate(own))[: abuse.K]
        assert [(round(s, 9), k) for s, k in exact.nearest(exact.vector(abuse.words_of(texts[i])))][:1] == [(-plain[0][0], plain[0][1])]
        raw = abuse.Scorer(exact, []).document(texts[i])
        steps = abuse.Scorer(exact, [(x / 10, x / 10) for x in range(11)])
        assert [got[i][c] for c in abuse.CATEGORIES] == pytest.approx([steps.calibrated(raw.get(c, 0.0)) for c in abuse.CATEGORIES], abs=0.101)  # steps of a tenth
        assert (got[i].evidence, got[i].example) == (texts[i], own[plain[0][1]][1])
    nearest = [exact.nearest(exact.vector(abuse.words_of(t)))[0][0] for t in texts[-2:]]
    assert nearest[0] > nearest[1] + 0.05
