"""Sentences, terms and TF-IDF of recordings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from cuelake.functions.text import fold_token, split_sentences, stopword_table, tokens
from cuelake.session import partitions_for, spread, struct

#: Fixed value: most sentences for the pairwise graph; beyond it the centroid ranks.
GRAPH_LIMIT = 700


def sentences(texts: DataFrame) -> DataFrame:
    """``media_id, sent_ix, sentence, n_words`` of a ``media_id, text`` table."""
    rows = spread(texts.select("media_id", "text")).select("media_id", F.posexplode(split_sentences(F.coalesce("text", F.lit("")))).alias("sent_ix", "sentence"))
    return rows.withColumn("n_words", F.size(F.split("sentence", " ")))


def content_terms(rows: DataFrame, text: str, stopwords: list[str] | None = None) -> DataFrame:
    """One row for each content word of a text column: ``pos, surface, term`` beside the other columns of ``rows``.

    Words of at most two letters, numbers and stopwords (a broadcast anti-join) drop out."""
    # Folded within the array, so that the filters and the join below don't fold again.
    words = F.transform(tokens(F.col(text)), lambda t, i: F.struct(i.alias("pos"), t.alias("surface"), fold_token(t).alias("term")))
    words = F.filter(words, lambda w: (F.length(w["term"]) > 2) & ~w["term"].rlike(r"^\p{Nd}+$"))
    each = rows.select(*[c for c in rows.columns if c != text], F.explode(words).alias("_w")).select(*[c for c in rows.columns if c != text], "_w.pos", "_w.surface", "_w.term")
    return each.join(F.broadcast(stopword_table(rows.sparkSession, stopwords)), "term", "left_anti")


def sentence_terms(sents: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """``media_id, sent_ix, term, tf``."""
    return content_terms(sents.select("media_id", "sent_ix", "sentence"), "sentence", stopwords).groupBy("media_id", "sent_ix", "term").agg(F.count(F.lit(1)).alias("tf"))


def inverse_frequency(terms: DataFrame, sents: DataFrame) -> DataFrame:
    """``media_id, term, df, idf`` with idf = ln((1 + n) / (1 + df)) + 1 and n all sentences of the recording."""
    n = sents.groupBy("media_id").agg(F.count(F.lit(1)).alias("n"))
    df = terms.groupBy("media_id", "term").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "media_id").select("media_id", "term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1.0).alias("idf"))


def vectors(terms: DataFrame, idf: DataFrame) -> DataFrame:
    """``media_id, sent_ix, term, w``: unit vectors."""
    raw = terms.join(idf, ["media_id", "term"]).withColumn("r", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("r") * F.col("r")).over(Window.partitionBy("media_id", "sent_ix")))
    return raw.select("media_id", "sent_ix", "term", (F.col("r") / norm).alias("w"))


def graph_recordings(sents: DataFrame, limit: int = GRAPH_LIMIT) -> DataFrame:
    """Recordings whose sentences are few enough for pairs."""
    return sents.groupBy("media_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= limit)


def similarity_edges(vecs: DataFrame, sents: DataFrame, limit: int = GRAPH_LIMIT) -> DataFrame:
    """``media_id, a, b, w`` (a < b): cosines of sentence pairs that share a term, in recordings of at most ``limit``
    sentences, so a recording has at most limit squared / 2 pairs. Larger recordings are ranked by ``centroid``."""
    small = vecs.join(graph_recordings(sents, limit).select("media_id"), "media_id", "left_semi")
    left = small.select("media_id", "term", F.col("sent_ix").alias("a"), F.col("w").alias("wa"))
    right = small.select("media_id", "term", F.col("sent_ix").alias("b"), F.col("w").alias("wb"))
    return left.join(right, ["media_id", "term"]).where("a < b").groupBy("media_id", "a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("w"))


def centroid(vecs: DataFrame) -> DataFrame:
    """``media_id, sent_ix, score``: dot of every sentence with the normalised sum of all, linear in the terms."""
    total = vecs.groupBy("media_id", "term").agg(F.sum("w").alias("c"))
    norm = total.groupBy("media_id").agg(F.sqrt(F.sum(F.col("c") * F.col("c"))).alias("n"))
    return vecs.join(total, ["media_id", "term"]).join(norm, "media_id").groupBy("media_id", "sent_ix").agg(F.sum(F.col("w") * F.col("c") / F.col("n")).alias("score"))


_RANKED = struct("media_id long, sent_ix int, score double")


def text_rank(vecs: DataFrame, sents: DataFrame, limit: int = GRAPH_LIMIT, damping: float = 0.85, iterations: int = 60, tolerance: float = 1e-9) -> DataFrame:
    """``media_id, sent_ix, score`` of sentences: power iteration on the cosine graph of recordings of at most ``limit``
    sentences, likeness to the ``centroid`` in larger ones. Sentences without an edge keep the teleport share; their mass is not
    handed on.

    The vectors of a small recording meet in one task in the order of their sentences (one exchange), as a sparse matrix of the terms
    that more than one sentence has; pairs exist there only, as at most ``limit`` squared numbers."""
    schema = to_arrow_schema(_RANKED)
    spans = sents.groupBy("media_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    large = centroid(vecs.join(spans.where(F.col("n") > limit), "media_id", "left_semi"))
    rows = spans.where(F.col("n") <= limit).join(vecs, "media_id", "left").select("media_id", "n", F.coalesce("sent_ix", F.lit(0)).alias("sent_ix"), "term", F.coalesce("w", F.lit(0.0)).alias("w"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def graph(size: int, at: np.ndarray, term: np.ndarray, w: np.ndarray) -> np.ndarray:
            cosine = np.zeros((size, size))
            order = np.argsort(term, kind="stable")
            edges = np.flatnonzero(np.diff(term[order])) + 1
            for own in np.split(order, edges):
                if len(own) > 1:
                    cosine[np.ix_(at[own], at[own])] += np.outer(w[own], w[own])
            np.fill_diagonal(cosine, 0.0)
            out = cosine.sum(axis=1)
            share = np.divide(cosine, out[:, None], out=np.zeros_like(cosine), where=out[:, None] > 0).T
            score = np.full(size, 1.0 / size)
            for _ in range(iterations):
                new = (1 - damping) / size + damping * (share @ score)
                done = np.abs(new - score).sum() < tolerance
                score = new
                if done:
                    break
            return score

        def ranked(media: int, size: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            column = lambda name: pa.chunked_array([p.column(name) for p in parts])
            at, w = column("sent_ix").to_numpy(), column("w").to_numpy()
            term = column("term").combine_chunks().dictionary_encode().indices.fill_null(0).to_numpy(zero_copy_only=False)
            score = graph(size, at, term, w)
            return pa.RecordBatch.from_arrays([pa.array([media] * size, pa.int64()), pa.array(range(size), pa.int32()), pa.array(score)], schema=schema)

        held: list[pa.RecordBatch] = []
        owner, size = None, 0
        for b in batches:
            media = b.column("media_id").to_numpy()
            for a, z in zip(cuts := [0, *(np.flatnonzero(np.diff(media)) + 1).tolist()], [*cuts[1:], len(media)], strict=True):
                if a == z:
                    continue
                if media[a] != owner:
                    if held:
                        yield ranked(owner, size, held)
                    owner, size, held = int(media[a]), b.column("n")[a].as_py(), []
                held.append(b.slice(a, z - a))
        if held:
            yield ranked(owner, size, held)

    small = rows.repartition(partitions_for(rows), "media_id").sortWithinPartitions("media_id", "sent_ix").mapInArrow(run, _RANKED)
    return small.unionByName(large)
