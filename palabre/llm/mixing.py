"""Mixtures of sources at target shares, with capped repetition.

Sizes are tokens of a public tokenizer. Each source first gets its quota; the whole copies of all its
documents that fit in are certain, the rest is drawn by Pareto order sampling: a document with inclusion
probability p and a uniform number u from a hash of its key has the rank (u / (1 - u)) / (p / (1 - p)),
and the documents of the smallest ranks are taken until the rest of the quota is full.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bpe import BYTE_BPE_50K, token_counts

LEVEL = 1 << 12  # cells of a level of the search for the cut
LEVELS = 4  # levels: as fine as a double
RANKS = 100.0  # logarithms of the odds lie within
SOURCES_MAX = 100_000  # rows of the list of targets; a longer list is refused


def _totals(sized: DataFrame, targets: DataFrame) -> list[dict]:
    per = sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.sum(F.col("weight") * F.col("n_tokens")).alias("mass"))
    wanted = targets.filter(F.col("source").isNotNull() & (F.col("part_cible") > 0)).groupBy("source").agg(F.sum("part_cible").alias("share"), F.min("repetitions_max").alias("most"))
    rows = wanted.join(per, "source", "left").limit(SOURCES_MAX + 1).collect()
    if len(rows) > SOURCES_MAX:
        raise ValueError(f"more than {SOURCES_MAX} sources")
    return [dict(source=r["source"], share=float(r["share"]), most=int(r["most"] or 1), tokens=int(r["tokens"] or 0), mass=float(r["mass"] or 0)) for r in sorted(rows, key=lambda r: r["source"])]


def plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Quota, whole copies and rest of each source.

    Without ``total_tokens`` the mixture is the largest in which every source that has tokens keeps its
    share; a source without any is out of reach and its share falls to the others in proportion. With it,
    a source that can't fill its share gives all it may.
    """
    rows = _totals(sized, targets)
    there = [r for r in rows if r["tokens"] > 0]
    whole = sum(r["share"] for r in there)
    for r in rows:
        r["norm"] = r["share"] / whole if r["tokens"] > 0 else 0.0
    size = float(total_tokens) if total_tokens is not None else min((r["most"] * r["tokens"] / r["norm"] for r in there), default=0.0)
    for r in rows:
        r["quota"] = min(r["norm"] * size, float(r["most"] * r["tokens"]))
        r["copies"] = min(r["most"], int(r["quota"] // r["tokens"] + 1e-9)) if r["tokens"] else 0
        r["rest"] = max(0.0, r["quota"] - r["copies"] * r["tokens"])
    return rows


def mixture(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, weight: str | None = None, seed: int = 42, path: str = BYTE_BPE_50K) -> DataFrame:
    """(``doc_id``, source, n_tokens, copies) of the documents taken, ``copies`` at most repetitions_max.

    ``weight`` names a column of relative inclusion weights within a source (1 where absent or null).
    Documents without tokens, of a null source or of one without a target are never taken. Repeated rows
    of the same key are ranked alike, and drawn together. The result depends on keys and seed alone, not on
    order or partitions. A share is missed by less than a document a source. Empty tables give no rows.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"), (F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(1.0)), F.lit(0.0)) if weight else F.lit(1.0)).alias("weight"))
    slim = slim.filter(F.col("source").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    sized = cut(token_counts(slim, ["doc_id", "source", "weight"], "text", path).filter(F.col("n_tokens") > 0))
    rows = plan(sized, targets, total_tokens)
    spark = docs.sparkSession
    quotas = spark.createDataFrame([(r["source"], r["copies"], r["rest"], r["mass"]) for r in rows if r["quota"] > 0], "source string, base int, rest double, mass double")
    d = sized.join(F.broadcast(quotas), "source")  # one row a source, at most SOURCES_MAX
    p = F.least(F.lit(1.0), F.when(F.col("mass") > 0, F.col("rest") * F.col("weight") / F.col("mass")).otherwise(F.lit(0.0)))
    u = (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("source"), F.col("doc_id").cast("string"))), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(2.0**52)
    odds = F.log(u / (F.lit(1.0) - u)) - F.log(F.col("p") / (F.lit(1.0) - F.col("p")))
    rank = F.when(F.col("p") <= 0, F.lit(RANKS)).when(F.col("p") >= 1, F.lit(-RANKS)).otherwise(F.greatest(F.lit(-RANKS), F.least(F.lit(RANKS), odds)))
    d = d.withColumn("p", p).withColumn("rank", rank)
    d = _cut_by_rank(d, [r for r in rows if r["rest"] > 0])
    return d.withColumn("copies", (F.col("base") + F.col("taken")).cast("int")).filter(F.col("copies") > 0).select(F.col("doc_id").alias(doc_id), "source", "n_tokens", "copies")


def _cut_by_rank(d: DataFrame, rows: list[dict]) -> DataFrame:
    """``d`` with ``taken``: 1 for the documents of the smallest ranks of a source whose tokens fill its rest, else 0.

    The cut is found by counting: tokens by cell of the rank, then by cell within the one where the rest
    fills up. At most ``LEVEL`` counts of each source are brought to the driver, however large the source;
    what goes back is one row a source.
    """
    spark = d.sparkSession
    span = {r["source"]: (-RANKS, RANKS) for r in rows}
    left = {r["source"]: float(r["rest"]) for r in rows}
    bound: dict[str, float] = {}
    for level in range(LEVELS):
        if not span:
            break
        spans = spark.createDataFrame([(s, float(a), float(b)) for s, (a, b) in sorted(span.items())], "source string, lo double, hi double")
        inside = d.join(F.broadcast(spans), "source").filter((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))  # at most SOURCES_MAX rows
        cell = F.least(F.lit(LEVEL - 1), F.floor((F.col("rank") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(LEVEL)).cast("int"))
        by: dict[str, list[tuple[int, int, int]]] = {s: [] for s in span}
        for r in inside.groupBy("source", cell.alias("cell")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect():
            by[r["source"]].append((r["cell"], int(r["n"]), int(r["docs"])))
        for s, (a, b) in list(span.items()):
            width = (b - a) / LEVEL
            for c, n, docs in sorted(by[s]):
                if n > left[s]:
                    x, y = a + c * width, a + (c + 1) * width
                    if docs > 1 and level < LEVELS - 1:
                        span[s] = (x, y)
                    else:  # what stands at the cut is taken if the quota is missed by less that way
                        bound[s] = y if n - left[s] < left[s] else x
                    break
                left[s] -= n
            else:
                bound[s] = b
            if s in bound:
                del span[s]
    bounds = spark.createDataFrame([(s, float(b)) for s, b in sorted(bound.items())], "source string, bound double")
    return d.join(F.broadcast(bounds), "source", "left").withColumn("taken", ((F.col("rest") > 0) & F.coalesce(F.col("rank") < F.col("bound"), F.lit(False))).cast("int")).drop("bound")


def shares(taken: DataFrame, targets: DataFrame, source: str = "source") -> DataFrame:
    """Target and actual share of each source, tokens, documents and the most copies of one of them."""
    got = taken.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    whole = got.agg(F.sum("tokens").alias("whole"))
    t = targets.select("source", "part_cible", "repetitions_max").join(got, "source", "left").crossJoin(F.broadcast(whole))  # one row
    tokens = F.coalesce("tokens", F.lit(0))
    return t.select("source", "part_cible", "repetitions_max", tokens.alias("tokens"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), (tokens / F.col("whole")).alias("part_obtenue"))
