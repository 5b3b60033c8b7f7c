"""How characteristic a term is of a recording (problem 2).

z-score of the log-odds ratio of a recording against all other recordings, with an informative Dirichlet prior whose
pseudo-counts are in proportion to the counts of the whole collection (``PRIOR`` of them in all):

    delta = ln((y + a) / (n + A - y - a)) - ln((Y - y + a) / (N - n + A - (Y - y) - a)),   z = delta / sqrt(1/(y + a) + 1/(Y - y + a))

with y of n tokens in the recording, Y of N in the collection, a = A * Y / N. Segment rows are counted once, terms are
counted within a row first, so what is shuffled is one row per (recording, term, segment) at most. Totals of terms are
joined back by term; the few terms that make up a large part of all rows (more than one in ``HOT`` of them, so fewer
than HOT terms, whatever the data) are joined by broadcast, the rest by shuffle, so no task gets a hot term.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.session import materialise

#: Letters of a term and its least length.
TERM = "[A-Za-z\\u00C0-\\u00D6\\u00D8-\\u00F6\\u00F8-\\u00FF]+"
LEAST = 4
#: Pseudo-counts of the prior.
PRIOR = 500.0
#: A term with more than 1/HOT of all (recording, term) rows is hot; there are fewer than HOT of them.
HOT = 1000


def recording_terms(segments: DataFrame) -> DataFrame:
    """``media_id, term, tf, n_segments``: repeated rows once; null and blank texts have no terms."""
    rows = segments.select("media_id", "seg_ix", "text").where("text IS NOT NULL AND media_id IS NOT NULL").dropDuplicates(["media_id", "seg_ix"])
    terms = F.filter(F.regexp_extract_all(F.col("text"), F.lit(f"({TERM})"), F.lit(1)), lambda t: F.length(t) >= LEAST)
    each = rows.select("media_id", "seg_ix", F.explode(F.transform(terms, F.lower)).alias("term"))
    once = each.groupBy("media_id", "term", "seg_ix").agg(F.count(F.lit(1)).alias("n"))
    return once.groupBy("media_id", "term").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("n_segments"))


def distinctive_terms(segments: DataFrame, prior: float = PRIOR) -> DataFrame:
    """``media_id, term, tf, n_segments, n_recordings, z`` for every term of every recording. Empty input: no rows."""
    counts = materialise(recording_terms(segments))
    by_term = materialise(counts.groupBy("term").agg(F.sum("tf").alias("all_tf"), F.count(F.lit(1)).alias("n_recordings")))
    by_media = counts.groupBy("media_id").agg(F.sum("tf").alias("n"))
    sums = by_term.agg(F.sum("all_tf").alias("N"), F.sum("n_recordings").alias("rows"))
    total = sums.first()
    if total is None or not total["N"]:
        return counts.select("media_id", "term", "tf", "n_segments", F.lit(0).cast("long").alias("n_recordings"), F.lit(0.0).alias("z"))
    hot = by_term.where(F.col("n_recordings") > total["rows"] / HOT)
    terms = counts.join(F.broadcast(hot), "term").unionByName(counts.join(F.broadcast(hot.select("term")), "term", "left_anti").join(by_term, "term"))
    y, n, big_y, big_n = F.col("tf").cast("double"), F.col("n").cast("double"), F.col("all_tf").cast("double"), F.lit(float(total["N"]))
    a = F.lit(prior) * big_y / big_n
    own = y + a
    rest = big_y - y + a
    delta = F.log(own / (n + F.lit(prior) - own)) - F.log(rest / F.greatest(big_n - n + F.lit(prior) - rest, F.lit(1e-9)))
    z = delta / F.sqrt(F.lit(1.0) / own + F.lit(1.0) / rest)
    return terms.join(by_media, "media_id").select("media_id", "term", "tf", "n_segments", "n_recordings", z.alias("z"))
