"""H1 -- distributed exact quantiles (continuous interpolation, A8).

Spark's built-in ``percentile`` merges one value->count map per group in a
single task, which does not survive a high-cardinality column at scale.
Here the same numbers come from a few passes, by one method at every size:

1. count the numbers and NaNs and take a KLL sketch of the numbers; read at
   a margin around every wanted rank it gives a band that likely holds it;
2. in one pass, count the rows below every band and take out the rows inside,
   grouped by value. A rank outside its band moves the band to the side the
   counts name, and the pass is repeated for such bands; a band of more than
   ``BAND_DISTINCT`` rows is first counted and narrowed by a sketch of its own
   rows, until it is smaller or holds few distinct values;
3. rank each band's values by itself, starting at its exact count of rows below.

Nothing but bands and counts reaches the driver, and no task ranks more than
one band's distinct values. NaN ranks above every number. Interpolation is
``lo + frac * (hi - lo)`` at ``pos = (n - 1) * p``; equal neighbours give the
neighbour itself."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

KLL_K = 4000                 # sketch size; normalized rank error ~7e-4
BAND_MARGIN = 0.002          # band half-width in rank fraction (~3 errors)
BAND_DISTINCT = 200_000      # distinct values that one task ranks
AGG_BANDS = 48               # bands counted in one aggregate (two fields each keep it in generated code)

_NAN = float("nan")


def _interpolate(pos: float, a: float, b: float, same: bool) -> float:
    frac = pos - math.floor(pos)
    if same or frac == 0.0 or a == b:
        return a
    return a + frac * (b - a)


def band_edges(probs: Sequence[float]) -> list[float]:
    """Rank fractions at which the sketch is read: band edges around every
    p, plus 0 and 1 (a KLL sketch keeps the exact minimum and maximum)."""
    return sorted({0.0, 1.0} | {min(1.0, max(0.0, p + d))
                                for p in probs for d in (-BAND_MARGIN, BAND_MARGIN)})


def _number(v: Column) -> Column:
    v = v.cast("double")
    return F.when(~F.isnan(v), v)


def sketch_aggs(v: Column, n: str, nan: str, sketch: str) -> list[Column]:
    """Numbers, NaNs and the KLL sketch of the numbers; can ride along in any aggregate."""
    return [F.count(_number(v)).alias(n), F.count_if(F.isnan(v.cast("double"))).alias(nan),
            F.kll_sketch_agg_double(_number(v), KLL_K).alias(sketch)]


def sketch_edges(sketch: Column, count: Column, probs: Sequence[float], name: str) -> Column:
    """The sketch read at the band edges; NULL when it saw no number, as an
    empty sketch cannot be read."""
    edges = F.array(*[F.kll_sketch_get_quantile_double(sketch, F.lit(e)) for e in band_edges(probs)])
    return F.when(count > 0, edges).alias(name)


@dataclass
class _Band:
    key: object
    ranks: tuple[int, int]
    lo: float
    hi: float
    least: float             # the ranks' values are known to lie in [least, most]
    most: float
    rows: float              # rows expected inside
    below: int = 0
    margin: float = BAND_MARGIN
    found: dict = field(default_factory=dict)

    def settle(self, below: int, inside: int, distinct: int | None, narrow: Callable) -> bool:
        """Take the exact counts; True if the band holds its ranks and is small."""
        low, high = self.ranks[0] >= below, self.ranks[1] < below + inside
        if not (low and high):
            # move to the side of the miss; the other edge stays if it also holds a rank
            lo, hi = self.lo, self.hi
            if not low:
                self.lo = self.least
                self.hi = hi if self.ranks[1] >= below else lo
            if not high:
                self.hi = self.most
                self.lo = self.lo if self.ranks[0] < below + inside else hi
            self.rows, self.margin = math.inf, min(0.25, 4 * self.margin)
            return False
        if distinct is None and inside > BAND_DISTINCT:
            self.rows = inside           # more rows than the sketch promised: look at it closer
            return False
        self.below, self.least, self.most = below, self.lo, self.hi
        if distinct is not None and distinct > BAND_DISTINCT and self.lo < self.hi:
            self.lo, self.hi = narrow([(r - below) / max(inside - 1, 1) + d
                                       for r, d in zip(self.ranks, (-self.margin, self.margin))])
            self.rows = 4 * self.margin * inside
            return False
        return True


def _bands(stats: list, probs: Sequence[float]) -> tuple[dict, list[_Band]]:
    """Per key the wanted positions, and the bands to search: one per key and
    wanted position. ``stats``: rows of (k, n, nan, q)."""
    edges, plan, bands = band_edges(probs), {}, []
    for r in stats:
        n, total = r["n"], r["n"] + r["nan"]
        if not total:
            continue
        plan[r["k"]] = [(total - 1) * float(p) for p in probs]
        at = dict(zip(edges, r["q"] or []))
        for p, pos in zip(probs, plan[r["k"]]):
            ranks = [x for x in (math.floor(pos), math.ceil(pos)) if x < n]
            if not ranks:
                continue                 # NaN is above every number
            # NaNs shift the numbers' fractions, and a margin of less than two ranks is none: search all numbers
            lo, hi, rows = at[0.0], at[1.0], n
            if not r["nan"] and BAND_MARGIN * n >= 2:
                lo, hi, rows = at[max(0.0, p - BAND_MARGIN)], at[min(1.0, p + BAND_MARGIN)], 2 * BAND_MARGIN * n
            bands.append(_Band(r["k"], (ranks[0], ranks[-1]), lo, hi, at[0.0], at[1.0], rows))
    return plan, bands


def _answers(spark, stats: list, probs: Sequence[float], counts: Callable, values: Callable) -> dict:
    """The loop over passes 2 and 3. ``counts(bands)`` gives (below, inside,
    distinct, sketch) per band; ``values(bands)`` the rows (tid, v) of each band
    and below it, these with v NULL."""
    plan, bands = _bands(stats, probs)
    todo, w = list(bands), Window.partitionBy("tid").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    while todo:
        # only bands of many rows need their distinct values estimated and a sketch to narrow them by
        large, small = [b for b in todo if b.rows > BAND_DISTINCT], [b for b in todo if b.rows <= BAND_DISTINCT]
        for band, (below, inside, distinct, sketch) in zip(large, counts(large) if large else []):
            def narrow(fractions, s=sketch):
                reads = [F.kll_sketch_get_quantile_double(F.lit(s), F.lit(min(1.0, max(0.0, f)))) for f in fractions]
                return tuple(spark.range(1).select(*reads).first())
            if band.settle(below, inside, distinct, narrow):
                band.rows = 0                # many rows of few values
        todo = large
        if not small:
            continue
        taken = materialize(values(small).groupBy("tid", "v").agg(F.count(F.lit(1)).alias("c")))
        sums = {r["tid"]: r for r in taken.groupBy("tid").agg(
            F.sum(F.when(F.col("v").isNull(), F.col("c")).otherwise(0)).alias("below"),
            F.sum(F.when(F.col("v").isNotNull(), F.col("c")).otherwise(0)).alias("inside"), F.count("v").alias("distinct")).collect()}
        held = {}
        for i, band in enumerate(small):
            below, inside, distinct = (sums[i][c] for c in ("below", "inside", "distinct")) if i in sums else (0, 0, 0)
            if band.settle(below, inside, distinct if distinct <= BAND_DISTINCT else None, None):
                held[i] = band
            else:
                todo.append(band)
        targets = spark.createDataFrame([(i, r - b.below) for i, b in held.items() for r in sorted(set(b.ranks))], "t int, r bigint")
        hits = (taken.where(F.col("v").isNotNull()).join(targets.select("t").distinct(), F.col("tid") == F.col("t"), "left_semi")
                .withColumn("cum", F.sum("c").over(w)).join(targets, F.col("tid") == F.col("t"))
                .where((F.col("cum") > F.col("r")) & (F.col("cum") - F.col("c") <= F.col("r")))
                .select("tid", "r", "v").collect() if held else [])
        for h in hits:
            held[h["tid"]].found[h["r"] + held[h["tid"]].below] = h["v"]
    at = {}
    for b in bands:
        at.update({(b.key, r): v for r, v in b.found.items()})
    return {k: [_interpolate(pos, at.get((k, math.floor(pos)), _NAN), at.get((k, math.ceil(pos)), _NAN),
                             math.floor(pos) == math.ceil(pos)) for pos in positions]
            for k, positions in plan.items()}


def _inside(v: Column, b: _Band) -> Column:
    return (v >= F.lit(b.lo)) & (v <= F.lit(b.hi))


GROUP_ROWS = 10_000          # rows of a group that are sorted as one array


def _at(values: Column, pos: Column) -> Column:
    """Interpolation of a sorted array at a position (from 0)."""
    low, frac = F.floor(pos).cast("int"), pos - F.floor(pos)
    a, b = F.get(values, low), F.get(values, F.ceil(pos).cast("int"))
    return F.when((frac == 0) | (a == b), a).otherwise(a + frac * (b - a))


def grouped_quantiles(long_df: DataFrame, probs: Sequence[float], key: str = "k", value: str = "v") -> DataFrame:
    """Exact continuous quantiles of ``value`` for every ``key``: k, and q, an
    array in the order of ``probs``. Keys without non-null values are absent;
    values are DOUBLE.

    Nothing of a key reaches the driver. A group of at most ``GROUP_ROWS`` rows
    is sorted as one array. Larger ones are read through bands, a table of one
    row per key and probability, joined to the rows by key: one pass sketches
    the groups, one takes the bands' rows out and counts those below. The bands'
    values are ranked by range partitions, however many a band has. A band that
    misses its ranks, known by its counts, is taken again as wide as its group."""
    src = long_df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v")).where(F.col("k").isNotNull() & F.col("v").isNotNull())
    sizes = materialize(src.groupBy("k").agg(F.count(F.lit(1)).alias("n")))
    small = sizes.where(F.col("n") <= GROUP_ROWS).select("k")
    arrays = src.join(small, "k").groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("all"))
    last = F.size("all").cast("double") - 1
    out = arrays.select("k", F.array(*[_at(F.col("all"), last * F.lit(float(p))) for p in probs]).alias("q"))
    large = sizes.where(F.col("n") > GROUP_ROWS)
    if large.isEmpty():
        return out
    return out.unionByName(_banded(src.join(large.select("k"), "k"), probs))


def _banded(src: DataFrame, probs: Sequence[float]) -> DataFrame:
    numbers = src.where(~F.isnan("v"))
    sketched = src.groupBy("k").agg(*sketch_aggs(F.col("v"), "n", "nan", "s"))
    edges, at = band_edges(probs), {e: i for i, e in enumerate(band_edges(probs))}
    stats = sketched.select("k", "n", "nan", sketch_edges(F.col("s"), F.col("n"), probs, "e"))
    narrow = (F.col("nan") == 0) & (F.col("n") * BAND_MARGIN >= 2)       # NaNs shift the fractions
    whole = (F.col("e")[0], F.col("e")[len(edges) - 1])

    def edge(p: float, side: int) -> Column:
        return F.when(narrow, F.col("e")[at[min(1.0, max(0.0, p + side * BAND_MARGIN))]]).otherwise(whole[side > 0])

    pos = [(F.col("n") + F.col("nan") - 1) * F.lit(float(p)) for p in probs]
    rows = F.array(*[F.struct(F.lit(i).alias("i"), x.alias("pos"), edge(p, -1).alias("lo"), edge(p, 1).alias("hi"))
                     for i, (p, x) in enumerate(zip(probs, pos))])
    bands = materialize(stats.select("k", "n", whole[0].alias("least"), whole[1].alias("most"), F.inline(rows))
                        .withColumn("r0", F.floor("pos")).withColumn("r1", F.least(F.ceil("pos"), F.col("n") - 1)))
    found, todo = None, bands.where(F.col("r0") < F.col("n"))            # NaN is above every number
    for _ in range(2):
        limits = todo.select("k", "i", "lo", "hi")
        v = F.col("v")
        taken = materialize(numbers.join(limits, "k").where(v <= F.col("hi")).select("k", "i", F.when(v >= F.col("lo"), v).alias("v"))
                            .groupBy("k", "i", "v").agg(F.count(F.lit(1)).alias("c")))
        c = F.col("c")
        sums = taken.groupBy("k", "i").agg(F.sum(F.when(v.isNull(), c).otherwise(0)).alias("below"), F.sum(c).alias("upto"))
        judged = materialize(todo.join(sums, ["k", "i"], "left").withColumn(
            "holds", F.coalesce((F.col("r0") >= F.col("below")) & (F.col("r1") < F.col("upto")), F.lit(False))))
        held = judged.where("holds").select("k", "i", "r0", "r1")
        ranked = _cumulated(taken)
        hits = (ranked.join(held, ["k", "i"]).where(v.isNotNull()).groupBy("k", "i")
                .agg(*[F.min(F.when((F.col("cum") > F.col(r)) & (F.col("cum") - c <= F.col(r)), v)).alias(a) for r, a in (("r0", "a"), ("r1", "b"))]))
        found = hits if found is None else found.unionByName(hits)
        missed = judged.where("NOT holds")
        if missed.isEmpty():
            break
        todo = missed.drop("below", "upto", "holds").withColumns({"lo": F.col("least"), "hi": F.col("most")})
    frac = F.col("pos") - F.floor("pos")
    a, b = F.coalesce("a", F.lit(_NAN)), F.when(F.ceil("pos") < F.col("n"), F.col("b")).otherwise(F.lit(_NAN))
    q = F.when((frac == 0) | (a == b), a).otherwise(a + frac * (b - a))
    each = bands.join(found, ["k", "i"], "left").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("i", q.alias("q")))).alias("all"))
    return each.select("k", F.col("all.q").alias("q"))


def _cumulated(taken: DataFrame) -> DataFrame:
    """``cum``: of each (k, i) the rows up to a value, this one's included.
    Rows are spread by ranges of (k, i, v), so a group may lie over many tasks."""
    parts = materialize(taken.repartitionByRange("k", "i", F.col("v").asc_nulls_first()).withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("k", "i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("k", "i", "part").agg(F.sum("c").alias("s"))
    offsets = sums.select("k", "i", "part", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("off"))
    within = Window.partitionBy("k", "i", "part").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("own", F.sum("c").over(within)).join(offsets, ["k", "i", "part"]).withColumn("cum", F.col("off") + F.col("own"))


def column_quantiles(df: DataFrame, expr: Column, probs: Sequence[float],
                     where: Column | None = None) -> list[float | None]:
    """Exact quantiles of one expression (NULLs ignored)."""
    return multi_column_quantiles(df, {"_": expr}, probs, where=where)["_"]


def multi_column_quantiles(df: DataFrame, exprs: dict[str, Column],
                           probs: Sequence[float],
                           where: Column | None = None,
                           stats: list | None = None) -> dict[str, list]:
    """Exact quantiles for several columns; every pass serves all of them, so
    the number of passes does not depend on the number of columns. ``stats``
    may carry each column's pass 1 (rows of k = column name, n, nan, q)."""
    if not exprs:
        return {}
    spark = df.sparkSession
    src = df.where(where) if where is not None else df
    names = list(exprs)
    src = src.select(*[exprs[c].cast("double").alias(f"x{i}") for i, c in enumerate(names)])
    of = {c: F.col(f"x{i}") for i, c in enumerate(names)}
    if stats is None:
        stats = []
        for at in range(0, len(names), AGG_BANDS):
            part = names[at:at + AGG_BANDS]
            aggs = [a for c in part for i in [names.index(c)] for a in sketch_aggs(of[c], f"n{i}", f"m{i}", f"s{i}")]
            sums = src.agg(*aggs)
            row = sums.select(*[c for c in sums.columns if c[0] != "s"],
                              *[sketch_edges(F.col(f"s{names.index(c)}"), F.col(f"n{names.index(c)}"), probs,
                                             f"q{names.index(c)}") for c in part]).first()
            stats += [{"k": c, "n": row[f"n{i}"], "nan": row[f"m{i}"], "q": row[f"q{i}"]}
                      for c in part for i in [names.index(c)]]

    def counts(bands):
        out = []
        for start in range(0, len(bands), AGG_BANDS):
            aggs, some = [], bands[start:start + AGG_BANDS]
            for i, b in enumerate(some):
                v, mine = of[b.key], _inside(of[b.key], b)
                aggs += [F.count_if(v < F.lit(b.lo)).alias(f"b{i}"), F.count_if(mine).alias(f"i{i}"),
                         F.approx_count_distinct(F.when(mine, v)).alias(f"d{i}"), F.kll_sketch_agg_double(F.when(mine, v), KLL_K).alias(f"s{i}")]
            row = src.agg(*aggs).first()
            out += [tuple(row[f"{c}{i}"] for c in "bids") for i in range(len(some))]
        return out

    def values(bands):
        each = F.array(*[F.when(of[b.key] <= F.lit(b.hi), F.struct(F.lit(i).alias("tid"), F.when(of[b.key] >= F.lit(b.lo), of[b.key]).alias("v")))
                         for i, b in enumerate(bands)])
        return src.select(F.inline(F.filter(each, lambda x: x.isNotNull())))

    got = _answers(spark, stats, probs, counts, values)
    return {c: got.get(c, [None] * len(probs)) for c in names}
