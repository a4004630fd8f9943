"""Intervals and tests for differences between two sides of runs."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runloom.operators import ranks
from runloom.operators.runs import hashed
from runloom.session import written

#: The standard normal quantile at 0.975.
Z95 = 1.959963984540054


def wilson(x: Column, n: Column, z: float = Z95) -> tuple[Column, Column]:
    p, d = x / n, 1 + z * z / n
    mid, half = (p + z * z / (2 * n)) / d, z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / d
    return mid - half, mid + half


def newcombe(x1: Column, n1: Column, x2: Column, n2: Column, z: float = Z95) -> tuple[Column, Column]:
    """Newcombe's hybrid interval of x1/n1 - x2/n2 from two Wilson intervals; null without trials."""
    n1, n2 = F.nullif(n1.cast("double"), F.lit(0.0)), F.nullif(n2.cast("double"), F.lit(0.0))
    p1, p2 = x1 / n1, x2 / n2
    (l1, u1), (l2, u2) = wilson(x1, n1, z), wilson(x2, n2, z)
    d = p1 - p2
    return d - F.sqrt((p1 - l1) * (p1 - l1) + (u2 - p2) * (u2 - p2)), d + F.sqrt((u1 - p1) * (u1 - p1) + (p2 - l2) * (p2 - l2))


#: A prime below 2^31: products of two remainders fit 64 bits in any engine.
PRIME = (1 << 31) - 1
#: A sample of at most so many values is broadcast for resampling.
MOST_VALUES = 4 << 20
#: With up to FEW runs the sums of several ordered picks stand in a table of at most TABLE numbers (below 2^16).
FEW, TABLE = 32, 4096
#: Draws that are made at once.
BLOCK = 512
#: So many different values at most are drawn by their counts.
MOST_DIFFERENT = 1 << 14


def picks(b: np.ndarray, i: np.ndarray, n: int) -> np.ndarray:
    """The row, below n, that draw b takes at place i: fifth powers modulo a prime, twice; the same in any engine."""
    u = (b * 1_000_003 + i * 7_919 + 12_345) % PRIME
    for k in (31, 0):
        s = u * u % PRIME
        u = (s * s % PRIME * u % PRIME + k * b) % PRIME
    return u % n


def _interval(means: DataFrame, alpha: float) -> list[Column]:
    return [F.percentile("m", F.lit(alpha / 2)).alias("lo"), F.percentile("m", F.lit(1 - alpha / 2)).alias("hi")]


def bootstrap_mean(values: DataFrame, value: str, draws: int = 20_000, seed: int = 0, key: str = "instance_id", alpha: float = 0.05) -> DataFrame:
    """Percentile interval of the mean over rows: lo, hi, mean, n.

    Each draw takes n of the n rows again, by picks() over their order by key, whatever n is.
    Up to MOST_VALUES values are broadcast, and each task makes some of the draws. Beyond,
    they stand in blocks of so many: a task has one block and some of the draws, makes these
    draws' picks and adds up those that fall into its block. Fewer than two values, or equal
    ones, are their own interval. No value: a mean of 0 with n = 0.
    """
    spark = values.sparkSession
    v = values.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("key"), F.col(value).cast("double").alias("v"))
    t = v.agg(F.count(F.lit(1)).alias("n"), F.avg("v").alias("mean"), F.min("v").alias("a"), F.max("v").alias("b")).first()
    if t.n < 2 or t.a == t.b:
        point = float(t["mean"] or 0.0)
        return spark.createDataFrame([(point, point, point, t.n)], "lo double, hi double, mean double, n long")
    means = _small_draws(v, int(t.n), draws, seed) if t.n <= MOST_VALUES else _wide_draws(v, int(t.n), draws, seed)
    return means.agg(*_interval(means, alpha)).select("lo", "hi", F.lit(float(t["mean"])).alias("mean"), F.lit(t.n).alias("n"))


def bootstrap_counted(values: DataFrame, value: str, draws: int = 20_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """As bootstrap_mean(), with draws of its own: how often a draw takes each different value is a multinomial of how often these are there, however many rows there are.

    With over MOST_DIFFERENT values it is bootstrap_mean(). Each BLOCK of draws has a
    generator, so the tasks it is dealt to change nothing.
    """
    spark = values.sparkSession
    c = written(values.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c")), "counts")
    t = c.agg(F.count(F.lit(1)).alias("k"), F.coalesce(F.sum("c"), F.lit(0)).alias("n"), (F.sum(F.col("v") * F.col("c")) / F.sum("c")).alias("mean")).first()
    if t.k < 2:
        point = float(t["mean"] or 0.0)
        return spark.createDataFrame([(point, point, point, t.n)], "lo double, hi double, mean double, n long")
    if t.k > MOST_DIFFERENT:
        return bootstrap_mean(values, value, draws, seed, alpha=alpha)
    own = c.toArrow().sort_by("v")  # a bounded number of values
    x, n, total = own["v"].to_numpy(), own["c"].to_numpy(), int(t.n)

    def draw(batches):
        for pdf in batches:
            for block in pdf["id"]:
                rng, count = _seeded(seed, "mean", int(block)), min(BLOCK, draws - int(block) * BLOCK)
                step = max(1, (1 << 20) // len(x))
                m = [rng.multinomial(total, n / total, min(step, count - a)) @ x / total for a in range(0, count, step)]
                yield pd.DataFrame({"m": np.concatenate(m)})

    blocks = -(-draws // BLOCK)
    means = spark.range(0, blocks, 1, blocks).mapInPandas(draw, "m double")
    return means.agg(*_interval(means, alpha)).select("lo", "hi", F.lit(float(t["mean"])).alias("mean"), F.lit(total).alias("n"))


def _ordered(v: DataFrame) -> DataFrame:
    """Keys as numbers, if all of them are."""
    kind = "long" if v.where(F.col("key").try_cast("long").isNull()).isEmpty() else "string"
    return v.select(F.col("key").cast(kind).alias("key"), "v")


def _small_draws(v: DataFrame, n: int, draws: int, seed: int) -> DataFrame:
    """(b, m): the mean of each draw, of values that fit a broadcast."""
    own = _ordered(v).toArrow().sort_by([("key", "ascending"), ("v", "ascending")])  # a bounded number of values
    x = v.sparkSession.sparkContext.broadcast(np.asarray(own.column("v")))

    def draw(batches):
        for pdf in batches:
            b = pdf["id"].to_numpy()
            step = max(1, (1 << 21) // n)
            m = [x.value[picks(b[k : k + step, None] + seed * 1_000_000, np.arange(n)[None, :], n)].mean(axis=1) for k in range(0, len(b), step)]
            yield pd.DataFrame({"b": b, "m": np.concatenate(m) if m else np.zeros(0)})

    tasks = max(1, min(draws // BLOCK, v.sparkSession.sparkContext.defaultParallelism * 2))
    return v.sparkSession.range(0, draws, 1, tasks).mapInPandas(draw, "b long, m double")


def _wide_draws(v: DataFrame, n: int, draws: int, seed: int) -> DataFrame:
    """(b, m): the mean of each draw, from what each block of values gives to it."""
    most = MOST_VALUES
    rows = ranks.numbered(_ordered(v), [F.col("key"), F.col("v")], "at")
    parts = -(-draws // BLOCK)
    rows = rows.select((F.col("at") / most).cast("int").alias("block"), "at", "v", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        low, part = int(pdf["block"].iloc[0]) * most, int(pdf["part"].iloc[0])
        x = pdf.sort_values("at")["v"].to_numpy()
        b = np.arange(part * BLOCK, min(draws, (part + 1) * BLOCK))
        sums = np.zeros(len(b))
        for i in range(0, n, 1 << 12):
            p = picks(b[:, None] + seed * 1_000_000, np.arange(i, min(n, i + (1 << 12)))[None, :], n) - low
            own = (p >= 0) & (p < len(x))
            sums += np.where(own, x[np.where(own, p, 0)], 0.0).sum(axis=1)
        return pd.DataFrame({"b": b, "s": sums})

    return rows.groupBy("block", "part").applyInPandas(draw, "b long, s double").groupBy("b").agg((F.sum("s") / n).alias("m"))


def _tasks(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism * 4


def _seeded(seed: int, *parts: object) -> np.random.Generator:
    """A generator of its own for each instance, from its whole id."""
    return np.random.default_rng([seed, int.from_bytes(hashlib.blake2b(repr(parts).encode(), digest_size=8).digest(), "big")])


def relative_change_bootstrap(runs: DataFrame, value: str, draws: int = 20_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Mean over instances of the % change of `value`, with runs resampled within each instance: change, lo, hi, instances. As relative_changes()."""
    return relative_changes(runs, [value], None, draws, seed, alpha).select(*[F.col(f"{value}_{c}").alias(c) for c in ("change", "lo", "hi", "instances")])


def relative_changes(runs: DataFrame, values: list[str], some: Column | None = None, draws: int = 20_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Means over instances of the % changes of values, with runs resampled within each instance: of each value its _change, _lo, _hi and _instances, and the same of the runs that are `some`, as _some_change and so on.

    Equal runs of an instance's side are counted before anything is shuffled; all values are
    read from the same picks of runs, seeded by the instance's whole id. With few runs a draw
    is a number or more of a table of all ordered picks, with very few one of a table of all
    picks of both sides; else how often it takes each value is a multinomial of their counts.
    Instances are dealt to blocks of some 64; a block adds up its instances' changes by draw,
    so only a row for each draw and block is shuffled again. An instance without runs of a
    side, or with a baseline that sums to 0, is left out; a resampled baseline of mean 0 gives
    no change for that draw.
    """
    cols = [f"v{q}" for q in range(len(values))]
    parts = 1 if some is None else 2
    rows = runs.select(F.col("instance_id").cast("string").alias("instance_id"), "run_type", (F.lit(False) if some is None else F.coalesce(some, F.lit(False))).alias("some"), *[F.col(v).cast("double").alias(c) for v, c in zip(values, cols, strict=True)])
    rows = rows.where(F.coalesce(*cols).isNotNull() & F.col("instance_id").isNotNull())
    counts = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("c"))
    blocks = max(1, min(1024, rows.agg(F.approx_count_distinct("instance_id")).first()[0] // 64))

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["instance_id", "run_type", "some", *cols])
        names, kinds, in_some, n = (pdf[c].to_numpy() for c in ("instance_id", "run_type", "some", "c"))
        x = pdf[cols].to_numpy(dtype=float)
        base, mutant = kinds == "baseline", kinds == "mutant"
        sums, k = np.zeros((parts, draws + 1, len(cols))), np.zeros((parts, draws + 1, len(cols)), dtype=np.int64)
        plain = np.zeros(parts, dtype=np.int64)
        cuts = np.flatnonzero(np.r_[True, names[1:] != names[:-1], True]) if len(names) else []
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            picks_ = _Picks(_seeded(seed, names[i]), draws)
            for part in range(parts):
                picks_.start()
                own = np.arange(i, j)[in_some[i:j]] if part else np.arange(i, j)
                sides = [(x[at], n[at]) for at in (own[base[own]], own[mutant[own]])]
                if len(sides[0][0]) and len(sides[1][0]):
                    plain[part] += _added(picks_, sides, sums[part], k[part])
        sums -= 100.0 * plain[:, None, None]
        k += plain[:, None, None]
        each = {f"{c}{part}_{q}": y[part, :, q] for c, y in (("s", sums), ("k", k)) for part in range(parts) for q in range(len(cols))}
        return pd.DataFrame({"b": np.arange(-1, draws)} | each)

    # so many tasks that work, not bytes, is dealt evenly
    counts = counts.withColumn("_block", F.pmod(F.xxhash64("instance_id"), F.lit(blocks))).repartition(_tasks(runs), "_block")
    at = [f"{part}_{q}" for part in range(parts) for q in range(len(cols))]
    d = counts.groupBy("_block").applyInPandas(draw, ", ".join(["b long", *[f"s{i} double, k{i} long" for i in at]]))
    per = d.groupBy("b").agg(*[x for i in at for x in ((F.sum(f"s{i}") / F.nullif(F.sum(f"k{i}"), F.lit(0))).alias(f"m{i}"), F.sum(f"k{i}").alias(f"k{i}"))])
    out = []
    for part in range(parts):
        for q, v in enumerate(values):
            m, name = F.col(f"m{part}_{q}"), f"{v}_some" if part else v
            bound = lambda p, m=m: F.percentile(F.when(F.col("b") >= 0, m), F.lit(p))
            out += [F.max(F.when(F.col("b") < 0, m)).alias(f"{name}_change"), bound(alpha / 2).alias(f"{name}_lo"), bound(1 - alpha / 2).alias(f"{name}_hi"), F.coalesce(F.max(F.when(F.col("b") < 0, F.col(f"k{part}_{q}"))), F.lit(0)).alias(f"{name}_instances")]
    return per.agg(*out)


def _added(picks_: _Picks, sides: list, sums: np.ndarray, k: np.ndarray) -> int:
    """Adds an instance's changes to the sums, the first row for the change itself, and counts them; or adds 100 more to each, and gives 1."""
    (b, bc), (m, mc) = sides
    if b.shape[1] <= 2 and max(bc.sum(), mc.sum()) <= FEW and (b > 0).all() and not np.isnan(m).any():
        m = m * (100 * bc.sum() / mc.sum())
        sums[0] += (mc @ m) / (bc @ b)
        sums[1:] += _ratios(picks_, np.repeat(b, bc, axis=0), np.repeat(m, mc, axis=0))
        return 1
    for q in range(b.shape[1]):
        one = []
        for x, n in sides:
            known = ~np.isnan(x[:, q])
            v, which = np.unique(x[known, q], return_inverse=True)
            one.append((v, np.bincount(which, n[known], len(v)).astype(np.int64)))
        (bv, bn), (mv, mn) = one
        if not len(bv) or not len(mv) or bv @ bn == 0:
            continue
        bm, mm = (_means(picks_.rng, v, n, picks_.draws) for v, n in one)
        with np.errstate(divide="ignore", invalid="ignore"):
            c = np.concatenate([[(mv @ mn / mn.sum()) / (bv @ bn / bn.sum()) - 1], (mm - bm) / bm]) * 100
        good = np.isfinite(c)
        sums[:, q] += np.where(good, c, 0)
        k[:, q] += good
    return 0


class _Picks:
    """Places in tables for each draw, from 32 random bits: chances differ by less than n / 2^32 of themselves. What is reported apart may take the same bits, from start() on."""

    def __init__(self, rng: np.random.Generator, draws: int) -> None:
        self.rng, self.draws, self.made, self.used = rng, draws, [], 0

    def start(self) -> None:
        self.used = 0

    def below(self, n: int) -> np.ndarray:
        if self.used == len(self.made):
            self.made.append(self.rng.bit_generator.random_raw((self.draws + 1) // 2).view(np.uint32)[: self.draws])
        u = np.multiply(self.made[self.used], np.uint64(n), dtype=np.uint64)
        self.used += 1
        u >>= np.uint64(32)
        return u.view(np.int64)


def _ratios(picks_: _Picks, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Of each draw and value (one or two) the sum of as many picks of m's rows over that of b's."""
    draws, width, kind = picks_.draws, b.shape[1], complex if b.shape[1] == 2 else float  # a pair of values is one number, added as one
    flat = lambda x: x.view(float).reshape(-1, width)
    taken = lambda table: flat(np.ascontiguousarray(table).view(kind)[:, 0].take(picks_.below(len(table))))
    b, m = (np.ascontiguousarray(x).view(kind)[:, 0] for x in (b, m))
    n, k = len(b) ** len(b), len(m) ** len(m)
    if n * k <= 2 * TABLE:
        return taken((flat(_all_sums(m, len(m)))[:, None] / flat(_all_sums(b, len(b)))[None]).reshape(-1, width))
    over = flat(_picked_sums(picks_, m))
    if n <= TABLE:
        over *= taken(1 / flat(_all_sums(b, len(b))))
    else:
        over /= flat(_picked_sums(picks_, b))
    return over.reshape(draws, width)


def _all_sums(rows: np.ndarray, k: int) -> np.ndarray:
    """The sums of all ordered picks of k rows."""
    table = rows
    for _ in range(k - 1):
        table = np.add.outer(table, rows).ravel()
    return table


def _picked_sums(picks_: _Picks, rows: np.ndarray) -> np.ndarray:
    n, sums, table = len(rows), None, None
    at_once = int(np.log(TABLE) / np.log(n) + 1e-9) if n > 1 else 1
    for left in range(n, 0, -at_once):
        if table is None or left < at_once:
            table = _all_sums(rows, min(left, at_once))
        part = table.take(picks_.below(len(table)))
        sums = part if sums is None else np.add(sums, part, out=sums)
    return sums


def _means(rng: np.random.Generator, x: np.ndarray, counts: np.ndarray, draws: int) -> np.ndarray:
    """The means of draws of as many runs again, from their different values and how often each is there."""
    n, out = int(counts.sum()), np.empty(draws)
    if len(x) == 1:
        return np.full(draws, x[0])
    if n <= FEW:
        rows, at_once, sums = np.repeat(x, counts), int(np.log(TABLE) / np.log(n) + 1e-9), np.zeros(draws)
        for left in range(n, 0, -at_once):
            table = rows
            for _ in range(min(left, at_once) - 1):
                table = np.add.outer(table, rows).ravel()
            sums += table[rng.integers(0, len(table), draws, dtype=np.uint16)]
        return sums / n
    step = max(1, (1 << 20) // len(x))
    for a in range(0, draws, step):
        out[a : a + step] = rng.multinomial(n, counts / n, min(step, draws - a)) @ x / n
    return out


def binomial_redraw(rates: DataFrame, draws: int = 20_000, seed: int = 0, alpha: float = 0.05) -> DataFrame:
    """Interval, in percentage points, of the mean difference of rates when each instance's successes are drawn anew: lo, hi, mean, n.

    rates: instance_id, p1, p2 (0 to 1), n1, n2 (trials, the same for all instances of a
    side). Instances of equal rate and trials are one binomial of all their trials together,
    so a side has a draw for each different rate, seeded by it, however many instances there are.
    """

    def draw(batches):
        out, k = np.zeros(draws), 0
        for pdf in batches:
            for r in pdf.itertuples():
                own = _seeded(seed, r.side, r.n, r.p).binomial(int(r.c) * int(r.n), r.p, draws) / max(1, r.n) * 100
                out += own if r.side == 1 else -own
                k += r.c if r.side == 1 else 0
        yield pd.DataFrame({"b": np.arange(draws), "s": out, "k": k})

    rows = rates.select(F.col("instance_id").cast("string").alias("id"), *[F.col(c).cast("double").alias(c) for c in ("p1", "p2")], "n1", "n2").where("p1 IS NOT NULL AND p2 IS NOT NULL")
    sides = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("side"), F.col(f"p{i}").alias("p"), F.col(f"n{i}").cast("long").alias("n")) for i in (1, 2)])).alias("x")).groupBy("x.side", "x.p", "x.n").agg(F.count(F.lit(1)).alias("c"))
    d = sides.mapInPandas(draw, "b long, s double, k long").groupBy("b").agg((F.sum("s") / F.nullif(F.sum("k"), F.lit(0))).alias("m"))
    return d.agg(*_interval(d, alpha)).join(F.broadcast(rows.agg(F.avg((F.col("p1") - F.col("p2")) * 100).alias("mean"), F.count(F.lit(1)).alias("n"))))


def sign_flip(diffs: np.ndarray, draws: int = 100_000, seed: int = 0, exact: int = 24) -> float:
    """Two-sided p of the mean under random signs; zeros are dropped; all 2^n signs up to `exact` differences."""
    d = np.asarray(diffs, dtype=float)
    d = d[d != 0]
    n = len(d)
    if not n:
        return 1.0
    observed, hits, total = abs(d.sum()) - 1e-9 * np.abs(d).sum(), 0, 0
    if n <= exact:
        low = min(n, 14)
        signs = 1 - 2 * ((np.arange(1 << low)[:, None] >> np.arange(low)) & 1)
        part = signs @ d[:low]
        for k in range(1 << (n - low)):
            rest = ((1 - 2 * ((k >> np.arange(n - low)) & 1)) * d[low:]).sum()
            hits += int((np.abs(part + rest) >= observed).sum())
        return hits / (1 << n)
    rng = np.random.default_rng(seed)
    while total < draws:
        k = min(4096, draws - total)
        hits += int((np.abs((1 - 2 * rng.integers(0, 2, (k, n))) @ d) >= observed).sum())
        total += k
    return (hits + 1) / (draws + 1)


#: Signs that one number gives; groups of which a task adds up draws at once.
_BITS, _GROUPS = 30, 32


def words(w: np.ndarray, h: np.ndarray) -> np.ndarray:
    """A number below 2^31 for the wth 30 draws of a row whose key hashes to h: as in picks(), so the same in any engine."""
    return picks(w, h, PRIME)


def sign_flip_test(values: DataFrame, value: str, group: str, key: str = "instance_id", draws: int = 100_000, exact: int = 24) -> DataFrame:
    """(group, n, p): the two-sided p of each group's mean under random signs of its differences.

    Zeros are dropped; n counts them. Groups of up to `exact` others try all signs. In larger
    ones each row has a sign for each draw by a hash of its key; a task adds up its rows by
    group and draw, so rows of a group never meet, and only sums are shuffled. A draw counts
    whose sum is as far from 0 as the observed one, but for rounding; the observed one itself
    is one of them.
    """
    h = F.pmod(hashed(F.lit("flip"), F.col(key).cast("string")), F.lit(PRIME))
    rows = values.where(F.col(value).isNotNull()).select(F.col(group), F.col(value).cast("double").alias("v"), h.alias("h"))
    kind = rows.schema[group].dataType.simpleString()
    per = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") != 0).alias("k"), (F.abs(F.sum("v")) - 1e-9 * F.sum(F.abs("v"))).alias("least"))
    per = written(per, "groups")
    g = broadcast_up_to(per.select(F.col(group).alias("_g"), "k"), 1_000_000)
    rows = rows.where("v != 0").join(g, F.col(group).eqNullSafe(F.col("_g"))).select(group, "v", "h", "k")

    def test(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({group: [pdf[group].iloc[0]], "p": [sign_flip(np.sort(pdf["v"].to_numpy()), exact=exact)]})

    few = rows.where(F.col("k") <= exact).select(group, "v").groupBy(group).applyInPandas(test, f"{group} {kind}, p double")
    blocks = -(-draws // _BITS)

    def added(batches):
        sums: dict = {}
        for pdf in batches:
            for name, one in pdf.groupby(group, dropna=False):
                own = sums.setdefault(None if pd.isna(name) else name, np.zeros((blocks, _BITS)))
                v, hs = one["v"].to_numpy(), one["h"].to_numpy()
                for i in range(0, len(v), 64):
                    u = words(np.arange(blocks)[:, None], hs[None, i : i + 64]).astype(np.uint32)
                    part = v[i : i + 64]
                    for bit in range(_BITS):
                        own[:, bit] += part.sum() - 2 * (((u >> bit) & 1).astype(float) @ part)
                if len(sums) >= _GROUPS:
                    yield from _given(sums, group, draws)
                    sums = {}
        yield from _given(sums, group, draws)

    many = rows.where(F.col("k") > exact).select(group, "v", "h").repartition(_tasks(values), "h").mapInPandas(added, f"{group} {kind}, b int, s double")
    many = many.groupBy(group, "b").agg(F.sum("s").alias("s")).join(broadcast_up_to(per.select(F.col(group).alias("_g"), "least"), 1_000_000), F.col(group).eqNullSafe(F.col("_g")))
    many = many.groupBy(group).agg(((F.count_if(F.abs("s") >= F.col("least")) + 1) / (draws + 1)).alias("p"))
    p = few.unionByName(many).select(F.col(group).alias("_g"), "p")
    return per.join(p, F.col(group).eqNullSafe(F.col("_g")), "left").select(group, "n", F.coalesce("p", F.lit(1.0)).alias("p"))


def sign_flip_counted(values: DataFrame, value: str, draws: int = 100_000, exact: int = 24, seed: int = 0) -> DataFrame:
    """(n, p): as sign_flip_test() of one group, with draws of its own: of differences of one size the positive ones are a binomial, however many there are. No row without values."""
    v = values.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    c = written(v.groupBy("v").agg(F.count(F.lit(1)).alias("c")), "counts")
    t = c.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("v") != 0, F.col("c"))), F.lit(0)).alias("k"), F.sum(F.col("v") * F.col("c")).alias("s"), F.sum(F.abs("v") * F.col("c")).alias("a")).first()
    rows = lambda n, p: v.sparkSession.createDataFrame([(n, p)] if n else [], "n long, p double")
    if t.k <= exact:
        few = c.where("v != 0").toPandas()
        return rows(t.n, sign_flip(np.sort(np.repeat(few["v"].to_numpy(), few["c"].to_numpy())), exact=exact))
    least = abs(t.s) - 1e-9 * t.a

    def added(batches):
        s = np.zeros(draws)
        for pdf in batches:
            for size, n in zip(pdf["v"].tolist(), pdf["c"].tolist(), strict=True):
                rng = _seeded(seed, "flip", size)
                if n <= 64:
                    up = np.bitwise_count(rng.bit_generator.random_raw(draws) >> np.uint64(64 - n))
                else:
                    up = rng.binomial(n, 0.5, draws)
                s += size * (2.0 * up - n)
        yield pd.DataFrame({"b": np.arange(draws, dtype=np.int32), "s": s})

    sizes = c.where("v != 0").groupBy(F.abs("v").alias("v")).agg(F.sum("c").alias("c")).repartition(_tasks(values), "v")
    sums = sizes.mapInPandas(added, "b int, s double").groupBy("b").agg(F.sum("s").alias("s"))
    return sums.agg(F.lit(t.n).alias("n"), ((F.count_if(F.abs("s") >= least) + 1) / (draws + 1)).alias("p"))


def _given(sums: dict, group: str, draws: int):  # noqa: ANN202
    for name, s in sums.items():
        yield pd.DataFrame({group: [name] * draws, "b": np.arange(draws, dtype=np.int32), "s": s.reshape(-1)[:draws]})


def broadcast_up_to(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, with a broadcast hint if it has up to so many rows."""
    return F.broadcast(df) if df.count() <= rows else df
