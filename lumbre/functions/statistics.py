"""Statistical commands. Each is an aggregate in Spark and closed formulas on its one-row result, and returns a DataFrame."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumbre.errors import EngineError
from lumbre.operators.project import col, require
from lumbre.types import safe_number

BINS = 5
Z95 = 1.959963984540054


def number(df: DataFrame, name: str) -> Column:
    require(df, name)
    return col(name).cast("double") if isinstance(df.schema[name].dataType, T.NumericType) else safe_number(col(name))


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def _frame(df: DataFrame, schema: str, *rows: tuple) -> DataFrame:
    return df.sparkSession.createDataFrame(list(rows), schema)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2.0))


def two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def moments(df: DataFrame, name: str) -> DataFrame:
    """One row: n, media, varianza, desviacion (population), cv, asimetria, curtosis (excess), minimo, maximo, varianza_muestral (0 if n < 2)."""
    x = _finite(number(df, name))
    n = F.count(x)
    return df.agg(
        n.alias("n"), F.avg(x).alias("media"), F.var_pop(x).alias("varianza"), F.stddev_pop(x).alias("desviacion"), (F.stddev_pop(x) / F.nullif(F.avg(x), F.lit(0.0))).alias("cv"),
        F.skewness(x).alias("asimetria"), F.kurtosis(x).alias("curtosis"), F.min(x).alias("minimo"), F.max(x).alias("maximo"), F.when(n > 1, F.coalesce(F.var_samp(x), F.lit(0.0))).otherwise(0.0).alias("varianza_muestral"),
    )


def advanced_profile(df: DataFrame, name: str) -> DataFrame:
    """operacion, variable, n, media, desviacion, p90, p95; a percentile is the first value whose share reaches it."""
    x = _finite(number(df, name))
    disc = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY _x)")
    return df.select(x.alias("_x")).agg(F.lit("perfil_avanzado").alias("operacion"), F.lit(name).alias("variable"), F.count("_x").alias("n"), F.avg("_x").alias("media"), F.stddev_pop("_x").alias("desviacion"), disc(0.9).alias("p90"), disc(0.95).alias("p95"))


def weighted_percentiles(df: DataFrame, name: str, weight: str, shares: tuple[float, ...] = (0.9, 0.95)) -> DataFrame:
    """p, value: the first value whose cumulative weight reaches p of all. Weights add up per distinct value first.

    The running sum over the distinct values is taken in ranges of the value, each from its range's total, so that no
    task holds them all.
    """
    x = _finite(number(df, name))
    w = _finite(number(df, weight))
    per = df.select(x.alias("v"), w.alias("w")).filter("v is not null and w > 0").groupBy("v").agg(F.sum("w").alias("w"))
    total = per.agg(F.sum("w").alias("total"))
    bounds = per.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    cells = per.join(F.broadcast(bounds)).withColumn("cell", F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(F.lit(0).cast("long")))
    sums = cells.groupBy("cell").agg(F.sum("w").alias("cw"))
    before = sums.select("cell", F.coalesce(F.sum("cw").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("before"))
    cum = cells.join(F.broadcast(before), "cell").select("v", (F.col("before") + F.sum("w").over(Window.partitionBy("cell").orderBy("v"))).alias("cum")).join(F.broadcast(total))
    return cum.agg(*(F.min(F.when(F.col("cum") >= p * F.col("total"), F.col("v"))).alias(f"p{p * 100:g}") for p in shares))


def histogram(df: DataFrame, name: str, bins: int = BINS) -> DataFrame:
    """operacion, variable, bins, bajo_minimo, sobre_maximo: equal bins from the least to the greatest value, the last one closed. A constant column raises."""
    x = _finite(number(df, name))
    edge = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")).collect()[0]
    if edge["lo"] is None or not edge["lo"] < edge["hi"]:
        raise EngineError("DATA", f"{name} has no range")
    width = (edge["hi"] - edge["lo"]) / bins
    at = F.least(F.floor((x - F.lit(edge["lo"])) / F.lit(width)), F.lit(bins - 1))
    return df.agg(F.lit("histograma").alias("operacion"), F.lit(name).alias("variable"), F.array(*(F.count_if(at == i) for i in range(bins))).alias("bins"), F.lit(0).cast("long").alias("bajo_minimo"), F.lit(0).cast("long").alias("sobre_maximo"))


def normality(df: DataFrame, name: str) -> DataFrame:
    """Jarque-Bera: n / 6 (S^2 + K^2 / 4), p = exp(-JB / 2); at least 8 values that vary."""
    x = _finite(number(df, name))
    r = df.agg(F.count(x).alias("n"), F.skewness(x).alias("s"), F.kurtosis(x).alias("k"), F.var_pop(x).alias("v")).collect()[0]
    if r["n"] < 8 or not r["v"]:
        raise EngineError("DATA", f"{name} has too few values, or a constant one")
    jb = r["n"] / 6 * (r["s"] ** 2 + r["k"] ** 2 / 4)
    p = math.exp(-jb / 2)
    return _frame(df, "operacion string, variable string, metodo string, estadistico double, p double, normal boolean, aproximado boolean", ("normalidad", name, "jarque_bera", jb, p, p >= 0.05, True))


def _event(df: DataFrame, name: str) -> Column:
    require(df, name)
    if isinstance(df.schema[name].dataType, T.BooleanType):
        return col(name)
    if isinstance(df.schema[name].dataType, T.NumericType):
        return col(name) > 0
    return col(name).isin("1", "true", "verdadero") | F.coalesce(safe_number(col(name)) > 0, F.lit(False))


def _events(df: DataFrame, event: str, exposure: str) -> tuple[int, float]:
    r = df.agg(F.count_if(_event(df, event)).alias("e"), F.sum(_finite(number(df, exposure))).alias("x")).collect()[0]
    if not r["x"] or r["x"] <= 0:
        raise EngineError("DATA", "the exposure must be positive")
    return r["e"], r["x"]


def _factor(factor: float) -> float:
    if not math.isfinite(factor) or factor <= 0:
        raise EngineError("ARGUMENT", "factor")
    return factor


def rate(df: DataFrame, event: str, exposure: str, factor: float) -> DataFrame:
    e, x = _events(df, event, exposure)
    return _frame(df, "operacion string, evento string, exposicion double, incidentes long, tasa double", ("tasa", event, x, e, e / x * _factor(factor)))


def poisson_cdf(k: int, mean: float) -> float:
    """P(X <= k). Terms are summed outward from the largest, from its logarithm, so that large means don't underflow."""
    if k < 0:
        return 0.0
    if mean == 0:
        return 1.0
    top = min(k, int(mean))
    log_top = top * math.log(mean) - mean - math.lgamma(top + 1)
    total, term, i = 1.0, 1.0, top
    while i > 0 and term > 1e-18 * total:
        term *= i / mean
        total += term
        i -= 1
    term, i = 1.0, top
    while i < k and term > 1e-18 * total:
        i += 1
        term *= mean / i
        total += term
    return min(1.0, math.exp(log_top + math.log(total)))


def _bisect(low: float, high: float, above) -> float:
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        low, high = (middle, high) if above(middle) else (low, middle)
    return (low + high) / 2


def poisson_interval(events: int, confidence: float = 0.95) -> tuple[float, float]:
    """The exact (Garwood) interval of a Poisson mean."""
    tail = (1 - confidence) / 2
    low = 0.0 if events == 0 else _bisect(0.0, float(events), lambda m: 1 - poisson_cdf(events - 1, m) < tail)
    high = events + 1.0
    while poisson_cdf(events, high) > tail:
        high *= 2
    return low, _bisect(0.0 if events == 0 else float(events), high, lambda m: poisson_cdf(events, m) > tail)


def poisson_normal_interval(events: int, exposure: float, factor: float, z: float = Z95) -> tuple[float, float, float]:
    """rate, lower, upper by the normal approximation, lower at least 0."""
    value, spread = events / exposure * factor, z * math.sqrt(events) / exposure * factor
    return value, max(0.0, value - spread), value + spread


def poisson(df: DataFrame, event: str, exposure: str, factor: float) -> DataFrame:
    e, x = _events(df, event, exposure)
    f = _factor(factor)
    low, high = poisson_interval(e)
    return _frame(df, "operacion string, eventos long, tasa double, ic_inferior double, ic_superior double", ("poisson", e, e / x * f, low / x * f, high / x * f))


def correlation(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson over rows that have both; at least 3, and both must vary. muestra_pequena: fewer than 30."""
    a, b = _finite(number(df, x)), _finite(number(df, y))
    both = a.isNotNull() & b.isNotNull()
    p, q = F.when(both, a), F.when(both, b)
    r = df.agg(F.count(p).alias("n"), F.corr(p, q).alias("r"), F.var_pop(p).alias("vx"), F.var_pop(q).alias("vy")).collect()[0]
    if r["n"] < 3 or not r["vx"] or not r["vy"] or min(r["vx"], r["vy"]) * r["n"] <= 2.220446049250313e-16:
        raise EngineError("DATA", "too few pairs, or no variance")
    return _frame(df, "operacion string, pares long, coeficiente double, muestra_pequena boolean", ("correlacion", r["n"], max(-1.0, min(1.0, r["r"])), r["n"] < 30))


#: Cells of the rank count, cut at quantiles of the distinct values.
RANK_CELLS = 256


def ranked_values(values: DataFrame, column: str, *sums: Column) -> DataFrame:
    """Distinct values with `_n` (how many rows have each), the sums asked for, and `rank`, the least rank of the value: 1 + how many rows are smaller.

    Rows are collapsed to distinct values before anything else, so a frequent value is one row and nothing is joined back.
    The running count goes by cells between quantiles of the distinct values (a sketch of bounded size), each from what
    lies below it: an outlier widens one cell and no more, and no task sorts more than its cells.
    """
    counts = values.groupBy(F.col(column).alias("_v")).agg(F.count(F.lit(1)).alias("_n"), *sums)
    cuts = counts.agg(F.percentile_approx("_v", [i / RANK_CELLS for i in range(1, RANK_CELLS)], 100 * RANK_CELLS).alias("q")).collect()[0]["q"] or []
    cuts = sorted(set(cuts))

    def place(low: int, high: int) -> Column:
        """How many cuts lie below the value, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col("_v") <= cuts[middle], place(low, middle)).otherwise(place(middle + 1, high))

    cells = counts.withColumn("cell", place(0, len(cuts)))
    below = cells.groupBy("cell").agg(F.sum("_n").alias("cn"))
    before = below.select("cell", F.coalesce(F.sum("cn").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    inner = Window.partitionBy("cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    return cells.join(F.broadcast(before), "cell").withColumn("rank", F.col("before") + F.coalesce(F.sum("_n").over(inner), F.lit(0).cast("long")) + 1).drop("cell", "before")


def wilcoxon(df: DataFrame, before: str, after: str, correct: bool = False) -> DataFrame:
    """Signed ranks of after - before, zeros dropped.

    By default ties share their least rank, the statistic is the sum of signed ranks W+ - W-, and it is held against the
    mean and variance of W+, as scripts expect. correct: mid-ranks, the statistic W+, variance with the tie term.
    """
    d = (_finite(number(df, after)) - _finite(number(df, before))).alias("d")
    diffs = df.select(d).filter("d is not null and d <> 0").select("d", F.abs("d").alias("a"))
    ranked = ranked_values(diffs, "a", F.count_if(F.col("d") > 0).alias("above"), F.sum(F.signum("d")).alias("signs"))
    if correct:
        rank, n3 = F.col("rank") + (F.col("_n") - 1) / 2, F.col("_n").cast("double") ** 3
        r = ranked.agg(F.sum("_n").alias("n"), F.sum(rank * F.col("above")).alias("w"), F.sum(n3 - F.col("_n")).alias("ties")).collect()[0]
    else:
        r = ranked.agg(F.sum("_n").alias("n"), F.sum(F.col("rank") * F.col("signs")).alias("w"), F.lit(0.0).alias("ties")).collect()[0]
    n = r["n"]
    if not n:
        raise EngineError("DATA", "no differences other than zero")
    mean, variance = n * (n + 1) / 4, n * (n + 1) * (2 * n + 1) / 24 - (r["ties"] or 0) / 48
    z = (r["w"] - mean) / math.sqrt(variance) if variance > 0 else 0.0
    return _frame(df, "operacion string, pares long, estadistico double, p double", ("wilcoxon", n, float(r["w"]), two_sided(z)))


def mann_whitney(df: DataFrame, value: str, group: str, first: str) -> DataFrame:
    """n_first, n_second, u, z, p: U of the first group, with mid-ranks."""
    v = df.select(_finite(number(df, value)).alias("x"), (col(group).cast("string") == first).alias("f")).filter("x is not null and f is not null")
    ranked = ranked_values(v, "x", F.count_if("f").alias("first"))
    rank = F.col("rank") + (F.col("_n") - 1) / 2
    r = ranked.agg(F.sum("first").alias("n1"), F.sum(F.col("_n") - F.col("first")).alias("n2"), F.sum(rank * F.col("first")).alias("s")).collect()[0]
    n1, n2 = r["n1"], r["n2"]
    if not n1 or not n2:
        raise EngineError("ARGUMENT", "both groups need values")
    u = r["s"] - n1 * (n1 + 1) / 2
    z = (u - n1 * n2 / 2) / math.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return _frame(df, "n_first long, n_second long, u double, z double, p double", (n1, n2, float(u), z, two_sided(z)))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n of the pairs that occur, without nulls and empty texts."""
    text = lambda c: F.nullif(col(c).cast("string"), F.lit(""))
    require(df, a, b)
    return df.select(text(a).alias("a"), text(b).alias("b")).filter("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _running(marks: DataFrame) -> DataFrame:
    """(v, below): the sum of kc over smaller v, by cells of 1,024 ranks."""
    cell = F.floor(F.col("rank") / 1024)
    sums = marks.groupBy(cell.alias("cell")).agg(F.sum("kc").alias("cn"))
    zero = F.lit(0).cast("long")
    before = sums.select("cell", F.coalesce(F.sum("cn").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("before"))
    inner = Window.partitionBy("cell").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    return marks.withColumn("cell", cell).join(F.broadcast(before), "cell").select("v", (F.col("before") + F.coalesce(F.sum("kc").over(inner), zero)).alias("below"))


def chi_square(df: DataFrame, a: str, b: str) -> DataFrame:
    """operacion, filas, columnas, estadistico, gl, celdas_bajas (cells with fewer than 5 expected).

    sum (o - e)^2 / e over all cells is N (sum o^2 / (r c) - 1), so that empty cells need not be formed; the low cells
    are counted from the distinct totals.
    """
    cells = contingency(df, a, b)
    rows, cols = cells.groupBy("a").agg(F.sum("n").alias("r")), cells.groupBy("b").agg(F.sum("n").alias("c"))
    total = cells.agg(F.sum("n").alias("n")).collect()[0]["n"] or 0
    nr, nc = rows.count(), cols.count()
    if nr < 2 or nc < 2:
        raise EngineError("DATA", "two values of each column are needed")
    s = cells.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n").cast("double") ** 2 / (F.col("r").cast("double") * F.col("c"))).alias("s")).collect()[0]["s"]
    kinds_r, kinds_c = rows.groupBy("r").agg(F.count(F.lit(1)).alias("kr")), cols.groupBy("c").agg(F.count(F.lit(1)).alias("kc"))
    # A row total r makes low cells with the column totals below 5 N / r: how many there are is read off the columns' ranks.
    marks = ranked_values(kinds_c.select(F.col("c").cast("double").alias("v"), "kc").unionByName(kinds_r.select((F.lit(5.0 * total) / F.col("r")).alias("v"), F.lit(0).cast("long").alias("kc"))).groupBy("v").agg(F.sum("kc").alias("kc")), "v", F.sum("kc").alias("kc"))
    below = _running(marks.select(F.col("_v").alias("v"), "kc", "rank"))
    low = kinds_r.select((F.lit(5.0 * total) / F.col("r")).alias("v"), "kr").join(below, "v").agg(F.sum(F.col("kr") * F.col("below")).alias("k")).collect()[0]["k"] or 0
    return _frame(df, "operacion string, filas long, columnas long, estadistico double, gl long, celdas_bajas long", ("chi_cuadrado", nr, nc, max(0.0, total * (s - 1)), (nr - 1) * (nc - 1), low))


def chi_square_p(statistic: float, freedom: int) -> float:
    """Wilson and Hilferty's approximation."""
    if not math.isfinite(statistic) or statistic < 0 or freedom <= 0:
        return 0.0
    z = ((statistic / freedom) ** (1 / 3) - (1 - 2 / (9 * freedom))) / math.sqrt(2 / (9 * freedom))
    return 1 - normal_cdf(z)


def risk_measures(a: int, b: int, c: int, d: int) -> dict[str, float]:
    """Relative risk and odds ratio with 95 % intervals; 0.5 is added to all cells if one is zero."""
    if a + b <= 0 or c + d <= 0:
        raise EngineError("DATA", "both groups need rows")
    corrected = 0 in (a, b, c, d)
    a, b, c, d = (v + 0.5 * corrected for v in (a, b, c, d))
    rr, odds = (a / (a + b)) / (c / (c + d)), a * d / (b * c)
    se_rr, se_or = math.sqrt(1 / a - 1 / (a + b) + 1 / c - 1 / (c + d)), math.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    around = lambda v, se: (v * math.exp(-Z95 * se), v * math.exp(Z95 * se))
    return {"rr": rr, "rr_lower": around(rr, se_rr)[0], "rr_upper": around(rr, se_rr)[1], "or": odds, "or_lower": around(odds, se_or)[0], "or_upper": around(odds, se_or)[1], "corrected": corrected}


def _risk_counts(df: DataFrame, exposure: str, event: str, exposed: str, happened: str):
    """Counts by two columns of exactly two labels each."""
    require(df, exposure, event)
    e, v = F.nullif(col(exposure).cast("string"), F.lit("")), F.nullif(col(event).cast("string"), F.lit(""))
    both = e.isNotNull() & v.isNotNull()
    r = df.agg(
        F.count_if(both & (e == exposed) & (v == happened)).alias("a"), F.count_if(both & (e == exposed) & (v != happened)).alias("b"), F.count_if(both & (e != exposed) & (v == happened)).alias("c"), F.count_if(both & (e != exposed) & (v != happened)).alias("d"),
        F.count_distinct(F.when(both, e)).alias("ne"), F.count_distinct(F.when(both, v)).alias("nv"), F.max(F.coalesce(e == exposed, F.lit(False))).alias("he"), F.max(F.coalesce(v == happened, F.lit(False))).alias("hv"),
    ).collect()[0]
    if r["ne"] != 2 or r["nv"] != 2 or not r["he"] or not r["hv"]:
        raise EngineError("DATA", "each column needs exactly two labels, the named ones among them")
    return r["a"], r["b"], r["c"], r["d"]


def risk(df: DataFrame, exposure: str, event: str, exposed: str, happened: str) -> DataFrame:
    """The counts, relative risk and odds ratio."""
    a, b, c, d = _risk_counts(df, exposure, event, exposed, happened)
    m = risk_measures(a, b, c, d)
    return _frame(df, "operacion string, eventos_expuestos long, no_eventos_expuestos long, eventos_control long, no_eventos_control long, riesgo_relativo double, odds_ratio double", ("riesgo", a, b, c, d, m["rr"], m["or"]))


def risk_intervals(df: DataFrame, exposure: str, event: str, exposed: str, happened: str) -> DataFrame:
    """Relative risk and odds ratio with their 95 % intervals, and whether 0.5 was added to the cells."""
    m = risk_measures(*_risk_counts(df, exposure, event, exposed, happened))
    return _frame(df, "rr double, rr_lower double, rr_upper double, odds double, odds_lower double, odds_upper double, corrected boolean", (m["rr"], m["rr_lower"], m["rr_upper"], m["or"], m["or_lower"], m["or_upper"], m["corrected"]))


def event_model(df: DataFrame, area: str, severity: str, post: str, source: str = "") -> DataFrame:
    """operacion, eventos (rows with all three), fuente."""
    require(df, area, severity, post)
    full = [F.coalesce(F.trim(col(c).cast("string")) != "", F.lit(False)) for c in (area, severity, post)]
    return df.agg(F.lit("modelo_sst").alias("operacion"), F.count_if(full[0] & full[1] & full[2]).alias("eventos"), F.lit(source).alias("fuente"))


class ThresholdForest:
    """Deterministic trees: at each depth a tree cuts one feature, (depth + tree) mod p, at the middle of its range in the node; leaves and trees vote. Small training sets, on the driver; prediction is an expression."""

    def __init__(self, trees: int = 5, depth: int = 1):
        self.trees, self.depth, self.roots = trees, depth, []

    def fit(self, rows: list[list[float]], labels: list[int]) -> ThresholdForest:
        if not rows:
            raise EngineError("DATA", "no rows")
        p = len(rows[0])

        def grow(members: list[int], tree: int, level: int):
            ones = sum(labels[i] for i in members)
            vote = int(2 * ones >= len(members)) if members else 0
            if level >= self.depth or not members or ones in (0, len(members)):
                return vote
            f = (level + tree) % p
            values = [rows[i][f] for i in members]
            cut = (min(values) + max(values)) / 2
            return f, cut, grow([i for i in members if rows[i][f] <= cut], tree, level + 1), grow([i for i in members if rows[i][f] > cut], tree, level + 1)

        self.roots = [grow(list(range(len(rows))), t, 0) for t in range(self.trees)]
        return self

    def fit_table(self, df: DataFrame, features: list[str], label: str) -> ThresholdForest:
        """The same trees from a table of any size: one aggregate per level for all nodes of all trees. label is 0 or 1; rows with a null are left out."""
        require(df, *features, label)
        rows = df.select(*(col(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)), col(label).cast("int").alias("y")).dropna()
        # A node: (feature, cut, low node, high node), or its vote; open nodes wait with the condition that leads to them.
        roots: list = [[None] for _ in range(self.trees)]
        waiting = [(root, t, F.lit(True)) for t, root in enumerate(roots)]
        for level in range(self.depth + 1):
            feature = lambda t, level=level: (level + t) % len(features)
            aggregates = []
            for k, (_, t, here) in enumerate(waiting):
                x = F.when(here, F.col(f"x{feature(t)}"))
                aggregates += [F.count_if(here).alias(f"n{k}"), F.count_if(here & (F.col("y") == 1)).alias(f"ones{k}"), F.min(x).alias(f"lo{k}"), F.max(x).alias(f"hi{k}")]
            got = rows.agg(*aggregates).collect()[0]
            if not level and not got["n0"]:
                raise EngineError("DATA", "no rows")
            then = []
            for k, (node, t, here) in enumerate(waiting):
                n, ones = got[f"n{k}"], got[f"ones{k}"]
                if level == self.depth or ones in (0, n):
                    node[:] = [int(2 * ones >= n) if n else 0]
                    continue
                cut, low, high = (got[f"lo{k}"] + got[f"hi{k}"]) / 2, [None], [None]
                node[:] = [feature(t), cut, low, high]
                under = F.col(f"x{feature(t)}") <= cut
                then += [(low, t, here & under), (high, t, here & ~under)]
            waiting = then
            if not waiting:
                break
        settled = lambda node: node[0] if len(node) == 1 else (node[0], node[1], settled(node[2]), settled(node[3]))
        self.roots = [settled(r) for r in roots]
        return self

    def predict(self, features: list[Column]) -> Column:
        def of(node) -> Column:
            if isinstance(node, int):
                return F.lit(node)
            f, cut, low, high = node
            return F.when(features[f] <= cut, of(low)).otherwise(of(high))

        votes = sum((of(r) for r in self.roots), F.lit(0))
        return (2 * votes >= len(self.roots)).cast("int")
