"""Items that appear together: exact pair counts against a fitted bipartite configuration null.

Under the null, item i is in basket g with probability x_i y_g / (1 + x_i y_g), independently of all
else, with x and y fitted so that the expected frequency of every item and the expected size of every
basket are the observed ones. Items of one frequency share x and baskets of one size share y, so that
only the distinct frequencies and sizes are fitted. The count of a pair is Poisson-binomial under the
null; its upper tail is the pair's p-value, and Benjamini-Hochberg controls false discoveries over all
pairs of items, those never seen together included.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.common import shelve
from noteweave.llm.discovery import with_q_values

#: Distinct basket sizes and item frequencies are merged into so many classes at most (by near equal
#: size); it bounds the driver's part of the fit and changes no count. Above it y is approximate, while x
#: is solved for each distinct frequency, so that every item's expected frequency is the observed one.
CLASSES = 512
#: A basket of more items than this is split into parts that make their pairs in tasks of their own.
LONG_BASKET = 1_000


def _classes(values: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean value and count of each class, and the class of each of ``values`` (ascending)."""
    if len(values) <= most:
        return values.astype(float), counts.astype(float), np.arange(len(values))
    edge = np.log(values.astype(float))
    group = np.unique(np.floor((edge - edge[0]) / (edge[-1] - edge[0] + 1e-12) * most), return_inverse=True)[1]
    n = np.bincount(group, counts)
    return np.bincount(group, counts * values) / n, n, group


def fit_null(item_freq: np.ndarray, item_n: np.ndarray, basket_size: np.ndarray, basket_n: np.ndarray, *, rounds: int = 2000, tolerance: float = 1e-8) -> tuple[np.ndarray, np.ndarray]:
    """x of each item class and y of each basket class, by fixed-point iteration."""
    total = float((item_freq * item_n).sum())
    x, y = item_freq / np.sqrt(max(total, 1)), basket_size / np.sqrt(max(total, 1))
    for _ in range(rounds):
        new_x = item_freq / ((basket_n * y)[None, :] / (1 + np.outer(x, y))).sum(1)
        new_y = basket_size / ((item_n * new_x)[None, :] / (1 + np.outer(y, new_x))).sum(1)
        moved = max(np.abs(new_x / x - 1).max(initial=0), np.abs(new_y / y - 1).max(initial=0))
        x, y = new_x, new_y
        if moved < tolerance:
            break
    else:
        if moved > 1e-3:
            warnings.warn(f"after {rounds} rounds expected frequencies or sizes are still off by up to {moved:.1e} of themselves", stacklevel=2)
    return x, y


def solve_fitness(freq: np.ndarray, y: np.ndarray, basket_n: np.ndarray, start: np.ndarray, *, rounds: int = 100) -> np.ndarray:
    """x of each frequency, given y: where the expected frequency is the observed one. Newton's steps in log x,
    kept within brackets; a frequency of all baskets has no finite x and keeps its start."""
    x, able = start.astype(float).copy(), freq < basket_n.sum() * (1 - 1e-9)
    for block in np.array_split(np.flatnonzero(able), able.sum() // 1000 + 1):
        want, t = freq[block].astype(float), np.log(x[block])
        low, high = np.full(len(block), -700.0), np.full(len(block), 300.0)
        for _ in range(rounds):
            p = np.exp(t)[:, None] * y
            p = p / (1 + p)
            miss = p @ basket_n - want
            low, high = np.where(miss < 0, t, low), np.where(miss > 0, t, high)
            if np.abs(miss / want).max(initial=0) < 1e-10:
                break
            t = t - miss / ((p * (1 - p)) @ basket_n).clip(1e-300)
            t = np.where((t > low) & (t < high), t, (low + high) / 2)
        x[block] = np.exp(t)
    return x


def _dot(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """q @ m on the worker's own core: a BLAS with threads of its own would fight with the other workers."""
    return np.einsum("ij,j->i", q, m)


def log_upper_tail(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """log10 P(K >= n) for K a sum of ``m[s]`` Bernoulli trials of probability ``q[:, s]`` each.

    Counts above the mean take the Lugannani-Rice saddlepoint with continuity correction, whose error is a
    few per cent of the p-value at most; counts near or below a small mean are summed from the pmf, which
    the Fourier transform of the characteristic function gives; others are near enough to normal.
    """
    out = np.zeros(len(n))
    mean, sd = _dot(q, m), np.sqrt(_dot(q * (1 - q), m).clip(1e-12))
    above = n - 0.5 > mean + np.minimum(1.0, 0.5 * sd)
    few, some = ~above & (mean < 12), ~above & (mean >= 12) & (mean < 60)
    for rows, tail in ((above, lambda r: _saddle(n[r].astype(float), q[r], m)), (few, lambda r: _transformed(n[r], q[r], m, 64)), (some, lambda r: _transformed(n[r], q[r], m))):
        at = np.flatnonzero(rows)
        for block in np.array_split(at, len(at) // 500 + 1):
            if len(block):
                out[block] = tail(block)
    rest = np.flatnonzero(~above & (mean >= 60))
    out[rest] = _log10_normal_tail((n[rest] - 0.5 - mean[rest]) / sd[rest])
    return out


def _transformed(n: np.ndarray, q: np.ndarray, m: np.ndarray, length: int = 256) -> np.ndarray:
    turn = np.exp(2j * np.pi * np.arange(length // 2 + 1) / length)
    waves = np.stack([np.exp(np.log(1 - q + q * w) @ m) for w in turn], 1)
    pmf = np.fft.irfft(np.conj(waves), length, axis=1)
    tail = np.where(np.arange(length)[None, :] >= n[:, None], pmf, 0).sum(1)
    return np.log10(tail.clip(1e-12, 1))


def _saddle(n: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    at = n - 0.5
    t = np.zeros(len(n))
    for _ in range(60):
        e = q * np.exp(t)[:, None]
        r = e / (1 - q + e)
        step = (_dot(r, m) - at) / _dot(r * (1 - r), m).clip(1e-12)
        t -= step.clip(-1, 1)
        if np.abs(step).max(initial=0) < 1e-10:
            break
    e = q * np.exp(t)[:, None]
    r = e / (1 - q + e)
    cumulant = _dot(np.log(1 - q + e), m)
    w = np.sign(t) * np.sqrt((2 * (t * at - cumulant)).clip(1e-12))
    u = 2 * np.sinh(t / 2) * np.sqrt(_dot(r * (1 - r), m))
    log_tail = _log10_normal_tail(w) * np.log(10)
    density = -0.5 * w * w - 0.5 * np.log(2 * np.pi)
    extra = np.exp((density - log_tail).clip(max=700)) * (1 / u - 1 / w)
    return (log_tail + np.log1p(extra.clip(-0.999))) / np.log(10)


def _log10_normal_tail(z: np.ndarray) -> np.ndarray:
    """log10 of the normal upper tail, also far out."""
    from math import erfc

    near = np.array([erfc(v / np.sqrt(2)) / 2 for v in z.clip(-30, 30)])
    big = z.clip(5)
    far = -0.5 * big * big - np.log(big * np.sqrt(2 * np.pi)) + np.log1p(-1 / big**2 + 3 / big**4 - 15 / big**6)
    return np.where(z < 10, np.log10(near.clip(1e-300)), far / np.log(10))


def pair_counts(baskets: DataFrame, *, long_basket: int = LONG_BASKET) -> DataFrame:
    """a, b, n: in how many baskets both items lie; a < b by code point.

    ``baskets`` (basket, items: array of distinct texts). Equal baskets are counted once with their number;
    pairs are summed on the map side. Baskets of more than ``long_basket`` items are dealt out by first items,
    so that no task makes all pairs of one.
    """
    sets = baskets.select(F.array_sort("items").alias("s")).where(F.size("s") > 1)
    folded = sets.groupBy("s").agg(F.count("*").alias("w")).withColumn("k", F.size("s"))
    short = folded.where(F.col("k") <= long_basket).select("w", "s", F.posexplode("s").alias("i", "a"))
    parts = F.ceil(F.col("k") / long_basket * F.col("k") / long_basket).cast("int")
    dealt = folded.where(F.col("k") > long_basket).withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.repartition("part", F.xxhash64("s")).select("w", "s", "part", "parts", F.posexplode("s").alias("i", "a")).where(F.pmod("i", "parts") == F.col("part"))
    firsts = short.unionByName(dealt.select("w", "s", "i", "a"))
    pairs = firsts.select("w", "a", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("w").alias("n"))


def surprising_pairs(baskets: DataFrame, *, min_count: int = 3, min_share: float = 0.0, min_lift: float = 0.0, classes: int = CLASSES) -> DataFrame:
    """Pairs with their counts, lift over independence, and surprise under the null.

    ``baskets`` has a row per basket: basket, items (array of texts). Null items and repeats within a
    basket don't count, baskets without items are no baskets. Result: a, b (a < b by code point), n, n_a,
    n_b, baskets, lift = n·N/(n_a·n_b), expected (under the null), log10_p, q_value, for pairs with
    n >= ``min_count``, n/N >= ``min_share`` and lift > ``min_lift``.

    Every pair that occurs is counted and tested, and ``q_value`` ranks it among all pairs of items (those that
    never meet have p = 1); only then the thresholds take pairs out. An empty table gives no rows.
    """
    clean = shelve(baskets.select("basket", F.array_distinct(F.array_compact("items")).alias("items")).where(F.size("items") > 0), "baskets")
    sizes = clean.groupBy(F.size("items").alias("size")).agg(F.count("*").alias("n")).orderBy("size")
    size_rows = sizes.toPandas()  # one row per distinct basket size
    total = int(size_rows["n"].sum())
    freq = shelve(clean.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("freq")), "items")
    freq_rows = freq.groupBy("freq").agg(F.count("*").alias("n")).orderBy("freq").toPandas()  # one row per distinct frequency
    i_freq, i_n, i_class = _classes(freq_rows["freq"].to_numpy(), freq_rows["n"].to_numpy(), classes) if total else (np.ones(1), np.ones(1), np.zeros(0, int))
    g_size, g_n, _ = _classes(size_rows["size"].to_numpy(), size_rows["n"].to_numpy(), classes) if total else (np.ones(1), np.ones(1), np.zeros(0, int))
    x, y = fit_null(i_freq, i_n, g_size, g_n) if total else (np.ones(1), np.ones(1))
    own = x[i_class]
    if len(i_freq) < len(freq_rows):
        own = solve_fitness(freq_rows["freq"].to_numpy(), y, g_n, own)
    fitness = pd.Series(own, index=freq_rows["freq"].to_numpy()) if total else pd.Series(dtype=float)

    def tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            xa, xb = (fitness.reindex(d[c]).to_numpy()[:, None] * y[None, :] for c in ("n_a", "n_b"))
            q = xa / (1 + xa) * (xb / (1 + xb))
            yield d.assign(expected=_dot(q, g_n), log10_p=log_upper_tail(d["n"].to_numpy(), q, g_n))

    n_a, n_b = (freq.select(F.col("item").alias(c), F.col("freq").alias(f"n_{c}")) for c in "ab")
    counted = pair_counts(clean).join(n_a, "a").join(n_b, "b").withColumn("lift", F.col("n").cast("double") * total / (F.col("n_a").cast("double") * F.col("n_b")))
    counted = counted.select("a", "b", "n", "n_a", "n_b", F.lit(total).cast("long").alias("baskets"), "lift")
    # tails cost far more than their rows weigh, so rows are spread over all cores whatever their size
    context = clean.sparkSession.sparkContext
    counted = counted.repartition(max(context.defaultParallelism, int(clean.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "a", "b")
    tested = shelve(counted.mapInPandas(tails, "a string, b string, n long, n_a long, n_b long, baskets long, lift double, expected double, log10_p double"), "pairs")
    kinds = int(freq_rows["n"].sum()) if total else 0
    least = max(min_count, min_share * total * (1 - 1e-9))
    return with_q_values(tested, kinds * (kinds - 1) // 2).where((F.col("n") >= F.lit(least)) & (F.col("lift") > min_lift))
