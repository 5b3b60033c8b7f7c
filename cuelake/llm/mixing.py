"""Mixing sources to target shares of tokens (problem 9).

Sizes are tokens of a public tokenizer. The mix is as large as the repeat caps allow: T = min over available sources of
(cap * size / share). Blocks of ``BLOCK`` tokens are apportioned to sources by the method of Sainte-Lague (highest
quotients share / (2k + 1)), then the blocks of a source to its shards in the same way, so every shard has an integer
quota. A shard goes through all its documents as often as the quota allows and fills the rest from its documents in a
seeded order until the quota is reached; the document that crosses it is taken if more than half of it fits. Documents stay
whole; one occurs at most ``max_repeats`` times.

A source has one shard for every ``PER_SHARD`` of its own documents, so a small one isn't torn and one that holds a third of all
rows is spread; the driver sees one number per (source, shard), at most ``SHARDS`` of each source. Quotas come from divisor search instead of block-by-block allocation, which gives the same
seats (ties to the earlier key).

Defined results: sources are compared by trimmed lower case; documents of sources without a target, null sources and
documents without tokens are not in the mix; a target source without documents gets nothing and the others keep their
proportions; without any available source the mix is empty; targets of one source are summed, the least cap holds.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cuelake.llm.tokens import FOLDER, VOCABULARY, count_column
from cuelake.session import materialise

BLOCK = 256
#: Most shards of a source, and documents for which another shard is opened.
SHARDS, PER_SHARD = 16_384, 100_000
SEED = 17
#: Most target sources; the targets are broadcast.
MOST_SOURCES = 10_000


def sainte_lague(weights: dict, seats: int) -> dict:
    """Seats by highest quotients w / (2k + 1). Ties go to the earlier key; zero weights get none."""
    keys = [k for k, w in weights.items() if w > 0]
    out = dict.fromkeys(weights, 0)
    if not keys or seats <= 0:
        return out
    total = sum(weights[k] for k in keys)
    # Seats surely won: each gets at least round(share of (seats - number of keys)); the rest goes one by one.
    low = max(0.0, (seats - len(keys)) / total)
    for k in keys:
        out[k] = max(0, math.floor(weights[k] * low + 0.5) - 1)
    heap = [(-weights[k] / (2 * out[k] + 1), i, k) for i, k in enumerate(keys)]
    heapq.heapify(heap)
    left = seats - sum(out.values())
    for _ in range(left):
        _, i, k = heapq.heappop(heap)
        out[k] += 1
        heapq.heappush(heap, (-weights[k] / (2 * out[k] + 1), i, k))
    return out


def source_key(column: str):
    return F.lower(F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", ""))


def _targets(targets: DataFrame) -> dict[str, tuple[float, int]]:
    rows = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").withColumn("source", source_key("source"))
    found = rows.groupBy("source").agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("cap")).orderBy("source").limit(MOST_SOURCES + 1).collect()
    if len(found) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} target sources")
    return {r["source"]: (float(r["share"]), int(r["cap"])) for r in found}


def sized_documents(documents: DataFrame, sources: list[str], folder: str = FOLDER, name: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, n_tokens`` of the documents of target sources with at least one token."""
    rows = documents.select("doc_id", source_key("source").alias("source"), "text").where(F.col("source").isin(sources) & F.col("text").isNotNull() & (F.length("text") > 0))
    return count_column(rows, "text", "n_tokens", folder, name).where("n_tokens > 0")


def plan(totals: dict[tuple[str, int], int], targets: dict[str, tuple[float, int]], block: int = BLOCK) -> dict[tuple[str, int], int]:
    """Quota in blocks of every (source, shard)."""
    own: dict[str, dict[tuple[str, int], int]] = {}
    for k, n in sorted(totals.items()):
        own.setdefault(k[0], {})[k] = n
    size = {s: sum(shards.values()) for s, shards in own.items()}
    available = {s: targets[s] for s in targets if size.get(s, 0) > 0}
    if not available:
        return {}
    whole = sum(share for share, _ in available.values())
    tokens = min(cap * size[s] * whole / share for s, (share, cap) in available.items())
    seats = sainte_lague({s: share for s, (share, _) in available.items()}, max(1, int(tokens // block)))
    out: dict[tuple[str, int], int] = {}
    for s in available:
        out |= sainte_lague(own[s], seats[s])
    return out


def mix(documents: DataFrame, targets: DataFrame, block: int = BLOCK, seed: int = SEED, shards: int | None = None, folder: str = FOLDER, name: str = VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, source, n_tokens, n_times``, report of ``source, target_share, max_repeats, available_tokens,
    mixed_tokens, actual_share, n_documents``)."""
    spark = documents.sparkSession
    wanted = _targets(targets)
    sized = materialise(sized_documents(documents, list(wanted), folder, name))
    # One row for each target source, so at most MOST_SOURCES.
    counts = [(r["source"], shards or max(1, min(SHARDS, math.ceil(r["n"] / PER_SHARD)))) for r in sized.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()]
    sized = sized.join(F.broadcast(spark.createDataFrame(counts, "source string, _shards int")), "source")
    sized = sized.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("_shards")).cast("int")).drop("_shards")
    totals = {(r["source"], r["shard"]): int(r["n"]) for r in sized.groupBy("source", "shard").agg(F.sum("n_tokens").alias("n")).collect()}
    quota = plan(totals, wanted, block)
    size: dict[str, int] = {}
    for (s, _), n in totals.items():
        size[s] = size.get(s, 0) + n
    rows = []
    for (s, k), q in quota.items():
        passes, rest = divmod(q * block, totals[s, k])
        cap = wanted[s][1]
        rows.append((s, k, min(passes, cap), rest if passes < cap else 0))
    quotas = spark.createDataFrame(rows, "source string, shard int, passes long, rest long")
    placed = sized.join(F.broadcast(quotas), ["source", "shard"])  # at most SHARDS rows of each target source
    # In the seeded order, but for documents of which less than half could ever fit: those come last and stay out.
    order = Window.partitionBy("source", "shard").orderBy((F.col("n_tokens") >= 2 * F.col("rest")).cast("int"), F.xxhash64("doc_id", F.lit(seed + 1)), "doc_id")
    before = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    extra = (before + F.col("n_tokens") / 2 < F.col("rest")).cast("long")
    mixed = placed.withColumn("n_times", F.col("passes") + extra).where("n_times > 0").select("doc_id", "source", "n_tokens", "n_times")
    shares = spark.createDataFrame([(s, share, cap, size.get(s, 0)) for s, (share, cap) in wanted.items()], "source string, target_share double, max_repeats int, available_tokens long")
    sums = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("n_times")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_documents"))
    report = shares.join(sums, "source", "left").fillna(0, ["mixed_tokens", "n_documents"])
    total = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))  # one row per target source
    report = report.withColumn("actual_share", F.round(F.when(total > 0, F.col("mixed_tokens") / total).otherwise(0.0), 6))
    return mixed, report.select("source", "target_share", "max_repeats", "available_tokens", "mixed_tokens", "actual_share", "n_documents")
