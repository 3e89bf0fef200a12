"""Statistics as plans: multiple tests, ranks, shrinkage, hash-driven null models, regressions from sums."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import md5_draws


def hash_uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on its parts alone: the same on every engine, run and partitioning."""
    key = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def benjamini_hochberg(df: DataFrame, p: str, name: str = "adjusted") -> DataFrame:
    """Step-up correction of a registry of tests: p n / rank, made monotone from the largest. Null p stay null and don't count."""
    w = Window.orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)  # a row a test
    k = df.filter(F.col(p).isNotNull())
    k = k.withColumn("_r", F.row_number().over(Window.orderBy(p))).withColumn("_n", F.count("*").over(Window.partitionBy()))
    k = k.withColumn(name, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_n") / F.col("_r")).over(w))).drop("_r", "_n")
    return k.unionByName(df.filter(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(n1, n0, auc) from rank sums, ties half. Ranks come from counts of different scores, not from a sort of the rows."""
    c = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(score).agg(F.sum(F.col(label).cast("int")).alias("p"), F.count("*").alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = c.withColumn("rank", below + (F.col("n") + 1) / 2.0)
    g = r.agg(F.sum("p").alias("n1"), F.sum(F.col("n") - F.col("p")).alias("n0"), F.sum(F.col("rank") * F.col("p")).alias("s"))
    n1, n0 = F.col("n1").cast("double"), F.col("n0").cast("double")
    return g.select("n1", "n0", F.when((n1 > 0) & (n0 > 0), (F.col("s") - n1 * (n1 + 1) / 2) / (n1 * n0)).alias("auc"))


def shrink_normal(df: DataFrame, value: str, n: str, default: float = 8.0, low: float = 1.0, high: float = 200.0, least: int = 8) -> DataFrame:
    """``df`` with ``shrunk``: each mean drawn to the general mean by k / (k + n).

    k is the ratio of the variance within to that between, by moments, held in [low, high]; with fewer than
    ``least`` rows it is ``default``; without dispersion between rows it is ``high``.
    """
    v, m = F.col(value), F.col(n).cast("double")
    s = df.agg(F.count("*").alias("_rows"), (F.sum(v * m) / F.sum(m)).alias("_mean"), F.var_samp(v).alias("_var"), F.avg(1.0 / m).alias("_inv"), F.avg(v * (1 - v)).alias("_in"))
    between = F.col("_var") - F.col("_in") * F.col("_inv")
    k = F.when(F.col("_rows") < least, F.lit(default)).when(between <= 0, F.lit(high)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), F.col("_in") / between)))
    return df.crossJoin(F.broadcast(s.withColumn("_k", k))).withColumn("shrunk", (v * m + F.col("_mean") * F.col("_k")) / (m + F.col("_k"))).drop("_rows", "_mean", "_var", "_inv", "_in", "_k")  # one row


def shuffled(df: DataFrame, block: list[str], key: str, label: str, draws: int, seed: str) -> DataFrame:
    """Each draw's pairing of keys with labels permuted inside blocks: (block, key, draw, label).

    Rows are ordered by a hash of seed, draw and key and given back by place. Draws are rows, so they spread
    over the cluster; aggregate them at once, nothing holds them all.
    """
    d = df.select(*block, F.col(key).alias("_k"), F.col(label).alias("_v")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    w = Window.partitionBy("draw", *block)
    a = d.select("draw", *block, "_k", F.row_number().over(w.orderBy("_k")).alias("_i"))
    b = d.select("draw", *block, "_v", F.row_number().over(w.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col("draw").cast("string"), F.col("_k").cast("string"))), "_k")).alias("_i"))
    return a.join(b, ["draw", *block, "_i"]).select("draw", *block, F.col("_k").alias(key), F.col("_v").alias(label))


def null_draws(groups: DataFrame, keys: str, draws: int, seed: str, statistic: Callable[[np.ndarray, dict], np.ndarray | None], known: Callable[[dict], float | None] | None = None) -> DataFrame:
    """(draw, x): the mean over groups of a statistic, for each hash-driven draw.

    ``groups`` has a row a group with its small arrays; ``keys`` names the array of strings that are hashed with
    seed and draw. ``statistic`` gets the hashes (2, keys, draws) and the row and gives a value a draw, or None for
    a group that has none. ``known`` gives the value of a group that has the same in every draw, whose keys needn't be
    hashed, else None. Groups stay where they are: a partition gives one sum a draw.
    """

    def sums(batches):
        total, n = np.zeros(draws), 0
        for b in batches:
            for row in b.to_pylist():
                x = known(row) if known else None
                if x is None:
                    x = statistic(md5_draws(seed, row[keys], draws), row)
                if x is not None:
                    total += x
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, draws + 1), pa.int32()), pa.array(total), pa.array(np.full(draws, n), pa.int64())], ["draw", "s", "c"])

    return groups.mapInArrow(sums, "draw int, s double, c bigint").groupBy("draw").agg((F.sum("s") / F.sum("c")).alias("x"))


def permutation_test(observed: DataFrame, draws: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(observed, expected, sd, z, p, n): two-sided around the null mean with the +1 correction.

    ``observed.x`` is one row, ``draws.x`` a row a draw; draws within ``slack`` of it count as as far. A null without dispersion gives a null z.
    """
    m = draws.agg(F.avg("x").alias("expected"), F.stddev_samp("x").alias("sd"), F.count("x").alias("n"))
    both = observed.select(F.col("x").alias("observed")).crossJoin(m)
    k = draws.crossJoin(F.broadcast(both)).agg(F.count_if(F.abs(F.col("x") - F.col("expected")) >= F.abs(F.col("observed") - F.col("expected")) - slack).alias("k"))  # one row
    z = F.when(F.col("sd") > 1e-12, (F.col("observed") - F.col("expected")) / F.col("sd"))
    return both.crossJoin(k).select("observed", "expected", "sd", z.alias("z"), ((F.col("k") + 1) / (F.col("n") + 1)).alias("p"), "n")


def change_point(series: DataFrame, order: str, value: str, margin: int = 4) -> DataFrame:
    """(order, gain) of every split of a series with at least ``margin`` values on both sides: reduction of squared error."""
    w = Window.orderBy("_o").rowsBetween(Window.unboundedPreceding, 0)  # a row a point of the series
    d = series.select(F.col(order).alias("_o"), F.col(value).alias("_v"))
    t = d.agg(F.count("*").alias("_n"), F.sum("_v").alias("_s"))
    x = d.select("_o", F.count("*").over(w).alias("_i"), F.sum("_v").over(w).alias("_a")).crossJoin(F.broadcast(t))  # one row
    i, n, a, s = (F.col(c) for c in ("_i", "_n", "_a", "_s"))
    x = x.filter((i >= margin) & (n - i >= margin))
    return x.select(F.col("_o").alias(order), (a * a / i + (s - a) * (s - a) / (n - i) - s * s / n).alias("gain"))


def normal_equations(df: DataFrame, xs: list[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y with an intercept, and the number of complete rows: sums made on the executors, p squared numbers."""
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    k = len(cols)
    d = df.dropna(subset=[*xs, y])
    row = d.agg(F.count("*").alias("n"), *[F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)], *[F.sum(cols[i] * F.col(y)).alias(f"b{i}") for i in range(k)]).collect()[0]
    a = np.array([[row[f"a{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)], dtype=float), row["n"]


def ols(df: DataFrame, xs: list[str], y: str, cluster: str | None = None) -> DataFrame:
    """(term, estimate, se, t): least squares with HC1 errors, or clustered ones. Scores are summed by cluster before the outer product."""
    a, b, n = normal_equations(df, xs, y)
    inv = np.linalg.pinv(a)
    beta = inv @ b
    k = len(beta)
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]
    d = df.dropna(subset=[*xs, y, *([cluster] if cluster else [])])
    e = F.col(y) - sum((F.lit(float(beta[i])) * cols[i] for i in range(k)), F.lit(0.0))
    s = d.select(*([cluster] if cluster else []), *[(cols[i] * e).alias(f"s{i}") for i in range(k)])
    if cluster:
        s = s.groupBy(cluster).agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(k)])
    r = s.agg(F.count("*").alias("g"), *[F.sum(F.col(f"s{i}") * F.col(f"s{j}")).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).collect()[0]
    m = np.array([[r[f"m{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)
    g = r["g"]
    scale = (g / max(1, g - 1) * (n - 1) / max(1, n - k)) if cluster else n / max(1, n - k)
    se = np.sqrt(np.maximum(np.diag(inv @ m @ inv) * scale, 0))
    return df.sparkSession.createDataFrame([(t, float(beta[i]), float(se[i]), float(beta[i] / se[i]) if se[i] > 0 else None) for i, t in enumerate(["intercept", *xs])], "term string, estimate double, se double, t double")


def newton(step: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], k: int, ridge: float = 0.0, most: int = 25, tolerance: float = 1e-9) -> np.ndarray:
    """Maximum of a concave likelihood from its gradient and information, which ``step`` sums over the cluster."""
    beta = np.zeros(k)
    for _ in range(most):
        g, h = step(beta)
        move = np.linalg.solve(h + (ridge + 1e-10) * np.eye(k), g - ridge * beta)
        beta = beta + move
        if np.abs(move).max() < tolerance:
            break
    return beta


def _sums(df: DataFrame, k: int, weight: Column, score: Column, cols: list[Column]) -> tuple[np.ndarray, np.ndarray]:
    r = df.agg(*[F.sum(cols[i] * score).alias(f"g{i}") for i in range(k)], *[F.sum(weight * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).collect()[0]
    return np.array([r[f"g{i}"] or 0.0 for i in range(k)], dtype=float), np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)], dtype=float)


def logit(df: DataFrame, xs: list[str], y: str, ridge: float = 0.0) -> np.ndarray:
    """Logistic regression with intercept by Newton steps; each is one aggregation of p squared sums."""
    d = df.dropna(subset=[*xs, y]).select(*xs, F.col(y).cast("double").alias("_y"))
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]

    def step(beta):
        mu = 1.0 / (1.0 + F.exp(-sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0))))
        return _sums(d, len(cols), mu * (1 - mu), F.col("_y") - mu, cols)

    return newton(step, len(cols), ridge)


def poisson(df: DataFrame, xs: list[str], y: str, exposure: str) -> np.ndarray:
    """Poisson regression with the logarithm of the exposure as offset."""
    d = df.dropna(subset=[*xs, y, exposure]).filter(F.col(exposure) > 0)
    cols = [F.lit(1.0), *[F.col(x).cast("double") for x in xs]]

    def step(beta):
        mu = F.col(exposure) * F.exp(sum((F.lit(float(b)) * c for b, c in zip(beta, cols)), F.lit(0.0)))
        return _sums(d, len(cols), mu, F.col(y) - mu, cols)

    return newton(step, len(cols))


def conditional_logit(df: DataFrame, session: list[str], xs: list[str], chosen: str, ridge: float = 0.0) -> np.ndarray:
    """Choice of one among a session's members: softmax in each session, gradient and information summed over sessions."""
    d = df.dropna(subset=xs).select(*session, *[F.col(x).cast("double").alias(x) for x in xs], F.col(chosen).cast("double").alias("_y"))
    k = len(xs)

    def step(beta):
        e = F.exp(sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, xs)), F.lit(0.0)))
        g = d.withColumn("_e", e).groupBy(*session).agg(
            F.sum("_e").alias("z"), F.sum("_y").alias("n"), *[F.sum(F.col("_e") * F.col(x)).alias(f"m{i}") for i, x in enumerate(xs)], *[F.sum(F.col("_y") * F.col(x)).alias(f"y{i}") for i, x in enumerate(xs)],
            *[F.sum(F.col("_e") * F.col(xs[i]) * F.col(xs[j])).alias(f"q{i}_{j}") for i in range(k) for j in range(i, k)],
        )
        g = g.filter("n = 1")
        mean = lambda i: F.col(f"m{i}") / F.col("z")
        r = g.agg(*[F.sum(F.col(f"y{i}") - mean(i)).alias(f"g{i}") for i in range(k)], *[F.sum(F.col(f"q{i}_{j}") / F.col("z") - mean(i) * mean(j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).collect()[0]
        return np.array([r[f"g{i}"] or 0.0 for i in range(k)]), np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    return newton(step, k, ridge)


def luce(wins: DataFrame, rounds: int = 12, shape: float = 1.5, rate: float = 0.5, cut: Callable[[DataFrame], DataFrame] | None = None, tolerance: float | None = None, every: int = 5) -> DataFrame:
    """(id, strength) of a one-winner Luce model with a Gamma prior, by minorise-maximise steps over contests.

    ``wins``: (contest, id, won); a contest without exactly one winner isn't in the likelihood and is left out. Each
    step sums the strengths of a contest and each member's exposure; nothing leaves the executors. ``cut``
    materialises every few steps, so the plan doesn't grow. With a ``tolerance`` the steps end once no strength
    changes by as much; if ``rounds`` don't get there, it raises.
    """
    single = wins.groupBy("contest").agg(F.sum(F.col("won").cast("int")).alias("o")).filter("o = 1").select("contest")
    wins = wins.join(single, "contest")
    wins = cut(wins) if cut else wins
    field = wins.select("contest", "id")
    theta = wins.groupBy("id").agg(F.sum(F.col("won").cast("int")).alias("w")).withColumn("strength", F.lit(1.0))
    change = None
    for k in range(1, rounds + 1):
        s = field.join(theta.select("id", "w", "strength"), "id").withColumn("inv", 1.0 / F.sum("strength").over(Window.partitionBy("contest")))
        d = s.groupBy("id", "w", F.col("strength").alias("was")).agg(F.sum("inv").alias("d"))
        theta = d.select("id", "w", "was", ((F.col("w") + shape - 1) / (F.col("d") + rate)).alias("strength"))
        if k % every and k < rounds:
            continue
        theta = cut(theta) if cut else theta
        if tolerance is not None:
            change = theta.agg(F.max(F.abs(F.col("strength") - F.col("was")))).collect()[0][0] or 0.0
            if change < tolerance:
                break
    if tolerance is not None and (change is None or change >= tolerance):
        raise RuntimeError(f"strengths still change by {change} after {rounds} rounds")
    return theta.select("id", F.col("w").alias("wins"), "strength")


def cox(df: DataFrame, strata: str, time: str, event: str, xs: list[str]) -> np.ndarray:
    """Cox model stratified by group with Efron's ties: risk sums run down the times of a stratum, one row a time."""
    k = len(xs)
    d = df.dropna(subset=[strata, time, *xs])

    def step(beta):
        e = F.exp(sum((F.lit(float(b)) * F.col(x) for b, x in zip(beta, xs)), F.lit(0.0)))
        d2 = d.withColumn("_e", e).withColumn("_d", F.col(event).cast("double"))
        names = {"z": F.col("_e"), **{f"m{i}": F.col("_e") * F.col(xs[i]) for i in range(k)}, **{f"q{i}_{j}": F.col("_e") * F.col(xs[i]) * F.col(xs[j]) for i in range(k) for j in range(i, k)}}
        g = d2.groupBy(strata, time).agg(F.sum("_d").alias("n"), *[F.sum(F.col("_d") * F.col(x)).alias(f"y{i}") for i, x in enumerate(xs)], *[F.sum(v).alias(n) for n, v in names.items()], *[F.sum(F.col("_d") * v).alias(f"d_{n}") for n, v in names.items()])
        w = Window.partitionBy(strata).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
        g = g.select("n", *[f"y{i}" for i in range(k)], *[f"d_{n}" for n in names], *[F.sum(n).over(w).alias(n) for n in names]).filter("n > 0")
        t = g.withColumn("l", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).withColumn("f", F.col("l") / F.col("n"))
        at = {n: F.col(n) - F.col("f") * F.col(f"d_{n}") for n in names}
        mean = lambda i: at[f"m{i}"] / at["z"]
        r = t.agg(*[F.sum(F.col(f"y{i}") / F.col("n") - mean(i)).alias(f"g{i}") for i in range(k)], *[F.sum(at[f"q{i}_{j}"] / at["z"] - mean(i) * mean(j)).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).collect()[0]
        return np.array([r[f"g{i}"] or 0.0 for i in range(k)]), np.array([[r[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(k)] for i in range(k)])

    return newton(step, k)


def correspondence(df: DataFrame, columns: list[str], axes: int = 2) -> DataFrame:
    """(column, level, axis1..): multiple correspondence analysis from the table of co-occurrences of levels (Burt), which is small."""
    d = df.dropna(subset=columns)
    long = [F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in columns]
    both = d.select(F.explode(F.array(*long)).alias("a"), F.array(*long).alias("all")).select("a", F.explode("all").alias("b"))
    cells = both.groupBy("a", "b").agg(F.count("*").alias("n")).collect()  # levels squared
    names = sorted({(r["a"]["c"], r["a"]["v"]) for r in cells})
    at = {x: i for i, x in enumerate(names)}
    burt = np.zeros((len(names), len(names)))
    for r in cells:
        burt[at[(r["a"]["c"], r["a"]["v"])], at[(r["b"]["c"], r["b"]["v"])]] = r["n"]
    p = burt / max(burt.sum(), 1)
    m = p.sum(0)
    s = (p - np.outer(m, m)) / np.sqrt(np.outer(m, m))
    value, vector = np.linalg.eigh(s)
    order = np.argsort(-value)[:axes]
    coords = vector[:, order] / np.sqrt(m)[:, None] * np.sqrt(np.maximum(value[order], 0))
    coords = coords * np.where(coords[np.abs(coords).argmax(0), range(coords.shape[1])] < 0, -1, 1)
    return df.sparkSession.createDataFrame([(c, v, *map(float, coords[i])) for i, (c, v) in enumerate(names)], "champ string, niveau string, " + ", ".join(f"axe{i + 1} double" for i in range(coords.shape[1])))
