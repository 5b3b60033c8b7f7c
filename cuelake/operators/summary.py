"""Extractive summaries: ranked sentences, near-duplicates left out, action items."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import fold, is_action_item
from cuelake.operators.terms import GRAPH_LIMIT, inverse_frequency, sentence_terms, sentences, text_rank, vectors
from cuelake.session import materialise, partitions_for

# Fixed values of the method.
SIMILAR, LONG_WORDS, SHORT_WORDS, MOST_POINTS, MOST_ACTIONS = 0.6, 45, 6, 6, 8


def ranked_sentences(sents: DataFrame, stopwords: list[str] | None = None, limit: int = GRAPH_LIMIT) -> DataFrame:
    """``media_id, sent_ix, sentence, n, score, terms``: centrality times a factor for length."""
    terms = sentence_terms(sents, stopwords)
    vecs = materialise(vectors(terms, inverse_frequency(terms, sents)))
    n = sents.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    base = text_rank(vecs, sents, limit)
    lists = vecs.groupBy("media_id", "sent_ix").agg(F.array_sort(F.collect_list(F.struct("term", "w"))).alias("terms"))
    rows = sents.join(n, "media_id").join(base, ["media_id", "sent_ix"], "left").join(lists, ["media_id", "sent_ix"], "left")
    factor = F.when(F.col("terms").isNull(), 0.0).when(F.col("n_words") < SHORT_WORDS, 0.5).when(F.col("n_words") > LONG_WORDS, 0.8).otherwise(1.0)
    return rows.select("media_id", "sent_ix", "sentence", "n", F.round(F.coalesce("score", F.lit(0.0)) * factor, 9).alias("score"), "terms")


def _picked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by recording and rank: walks each recording once and holds the chosen sentences only."""
    media, overview, points, want = None, [], [], (0, 0)

    def dot(a: dict, b: dict) -> float:
        if len(a) > len(b):
            a, b = b, a
        return sum(w * b[t] for t, w in a.items() if t in b)

    for b in batches:
        out = []
        for r in b.itertuples(index=False):
            if r.media_id != media:
                media, overview, points = r.media_id, [], []
                want = (int(min(5, max(2, round(r.n / 12)))), int(min(MOST_POINTS, max(3, round(r.n / 10)))))
                out.append((media, r.sent_ix, r.sentence, "tldr"))
            if len(overview) >= want[0] and len(points) >= want[1]:
                continue
            vector = {} if r.terms is None else {x["term"]: x["w"] for x in r.terms}
            if any(dot(vector, o) > SIMILAR for o in overview):
                continue  # too near to the overview, so no key point either
            if len(overview) < want[0]:
                overview.append(vector)
                out.append((media, r.sent_ix, r.sentence, "overview"))
            elif all(dot(vector, o) <= SIMILAR for o in points):
                points.append(vector)
                out.append((media, r.sent_ix, r.sentence, "point"))
        yield pd.DataFrame(out, columns=["media_id", "sent_ix", "sentence", "role"])


def action_items(sents: DataFrame, most: int = MOST_ACTIONS) -> DataFrame:
    """``media_id, sent_ix, sentence``: first occurrences (folded) of action items, in order, at most ``most``."""
    rows = sents.where(is_action_item(F.col("sentence"))).withColumn("k", fold(F.col("sentence")))
    first = rows.withColumn("r", F.row_number().over(Window.partitionBy("media_id", "k").orderBy("sent_ix"))).where("r = 1")
    return first.withColumn("r", F.row_number().over(Window.partitionBy("media_id").orderBy("sent_ix"))).where(F.col("r") <= max(1, most)).select("media_id", "sent_ix", "sentence")


def summaries(texts: DataFrame, stopwords: list[str] | None = None, limit: int = GRAPH_LIMIT) -> DataFrame:
    """``media_id, tldr, summary, key_points, action_items, method`` for every text with a sentence."""
    sents = materialise(sentences(texts))  # read four times below
    ranked = ranked_sentences(sents, stopwords, limit)
    best = F.max("score").over(Window.partitionBy("media_id"))
    order = ranked.withColumn("_best", best).where("score > 0 OR _best <= 0").withColumn("_rank", -F.col("score")).drop("_best", "score")
    walk = order.repartition(partitions_for(order), "media_id").sortWithinPartitions("media_id", "_rank", "sent_ix").drop("_rank")
    chosen = walk.mapInPandas(_picked, "media_id long, sent_ix int, sentence string, role string")
    role = lambda name: F.array_sort(F.collect_list(F.when(F.col("role") == name, F.struct("sent_ix", "sentence"))))
    text = lambda c: F.transform(c, lambda x: x["sentence"])
    parts = chosen.groupBy("media_id").agg(F.max(F.when(F.col("role") == "tldr", F.col("sentence"))).alias("tldr"), role("overview").alias("o"), role("point").alias("p"))
    actions = action_items(sents).groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("sent_ix", "sentence"))).alias("a"))
    return parts.join(actions, "media_id", "left").select(
        "media_id", "tldr", F.array_join(text(F.col("o")), " ").alias("summary"), text(F.col("p")).alias("key_points"),
        F.coalesce(text(F.col("a")), F.array().cast("array<string>")).alias("action_items"), F.lit("extractive").alias("method"),
    )


def summary_markdown(rows: DataFrame, title: str = "Summary", note: str = "_Offline extractive summary: quoted sentences ranked by TF-IDF centrality._") -> DataFrame:
    """``media_id, markdown``: sections that are empty are left out."""
    nl = F.lit("\n")
    section = lambda name, body, when: F.when(when, F.concat(F.lit(f"## {name}\n\n"), body, F.lit("\n\n"))).otherwise("")
    bullets = lambda c, mark: F.array_join(F.transform(c, lambda x: F.concat(F.lit(mark), x)), "\n")
    text = F.concat(
        F.lit(f"# {title}\n\n"), F.when(F.col("method") == "extractive", F.lit(note + "\n\n")).otherwise(""),
        section("TL;DR", F.col("tldr"), F.col("tldr") != ""), section("Overview", F.col("summary"), F.col("summary") != ""),
        section("Key points", bullets("key_points", "- "), F.size("key_points") > 0), section("Action items", bullets("action_items", "- [ ] "), F.size("action_items") > 0),
    )
    return rows.select("media_id", F.concat(F.regexp_replace(text, r"\n+$", ""), nl).alias("markdown"))
