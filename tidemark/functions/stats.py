"""Dependence-aware statistics as distributed aggregates and replicate tables."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import staged, tidied
from . import shuffles, tails


def draw(seed: int, *parts: Column) -> Column:
    """A uniform integer below 2^32 from a digest, equal on every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("bigint")


def kaplan_meier(rows: DataFrame, group: str = "grp", time: str = "d", event: str = "ev", weight: str | None = None) -> DataFrame:
    """(grp, d, at_risk, deaths, s) at the distinct event times; ``weight`` counts a row several times."""
    n = F.lit(1) if weight is None else F.col(weight)
    per = rows.groupBy(group, time).agg(F.sum(n).alias("n"), F.sum(F.when(F.col(event), n).otherwise(0)).alias("deaths"))
    tail = Window.partitionBy(group).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("at_risk", F.sum("n").over(tail)).where("deaths > 0")
    head = Window.partitionBy(group).orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    return per.withColumn("s", F.product(1 - F.col("deaths") / F.col("at_risk")).over(head)).select(group, time, "at_risk", "deaths", "s")


def rmst(km: DataFrame, groups: DataFrame, tau: float | str, group: str = "grp", time: str = "d") -> DataFrame:
    """Area under the survival step function up to tau (a number, or a column of ``groups``), for each row of ``groups``."""
    w = Window.partitionBy(group).orderBy(time)
    end = F.col(tau) if isinstance(tau, str) else F.lit(float(tau))
    km = km.join(groups.select(group, tau), group) if isinstance(tau, str) else km
    steps = km.where(F.col(time) < end).withColumn("_next", F.coalesce(F.lead(time).over(w), end)).withColumn("_first", F.min(time).over(Window.partitionBy(group)))
    area = steps.groupBy(group).agg((F.max("_first") + F.sum(F.col("s") * (F.col("_next") - F.col(time)))).alias("_a"))
    return groups.join(area, group, "left").withColumn("rmst", F.coalesce(F.col("_a"), end)).drop("_a")


def tested(scores: DataFrame) -> DataFrame:
    """Adds chi2 of u with variance v, and its tail; null without variance."""
    out = scores.withColumn("chi2", F.when(F.col("v") > 0, F.col("u") * F.col("u") / F.col("v")))
    return out.withColumn("p", tails.chi_square_tail(F.col("chi2")))


def log_rank(rows: DataFrame, one: str, group: str = "grp", time: str = "d", event: str = "ev", by: tuple[str, ...] = (), lone_deaths: bool = False) -> DataFrame:
    """One row (of each key ``by``): U, V, chi2 and its tail p of the two-group log-rank test; ``one`` names the first group.
    ``lone_deaths``: a death of the last row at risk is observed but not expected, as the superseded form has it."""
    g = (F.col(group) == one).cast("int")
    per = rows.groupBy(*by, time).agg(F.count("*").alias("n_at"), F.sum(g).alias("n1_at"), F.count_if(F.col(event)).alias("dd"), F.sum(F.when(F.col(event), g).otherwise(0)).alias("d1"))
    w = (Window.partitionBy(*by) if by else Window).orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    t = per.withColumn("n", F.sum("n_at").over(w)).withColumn("n1", F.sum("n1_at").over(w)).where("dd > 0")
    v = F.when(F.col("n") > 1, F.col("dd") * (F.col("n1") / F.col("n")) * (1 - F.col("n1") / F.col("n")) * (F.col("n") - F.col("dd")) / (F.col("n") - 1)).otherwise(0.0)
    expected = F.col("dd") * F.col("n1") / F.col("n")
    expected = F.when(F.col("n") > 1, expected).otherwise(0.0) if lone_deaths else expected
    out = t.groupBy(*by).agg(F.sum(F.col("d1") - expected).alias("u"), F.sum(v).alias("v"))
    return tested(out)


def robust_log_rank(rows: DataFrame, one: str, cluster: str, group: str = "grp", time: str = "d", event: str = "ev", by: tuple[str, ...] = ()) -> DataFrame:
    """One row (of each key ``by``): U, its cluster-robust variance, chi2 and its tail p: scores of rows summed by cluster."""
    z = (F.col(group) == one).cast("double")
    per = rows.groupBy(*by, time).agg(F.count("*").alias("n_at"), F.sum(z).alias("n1_at"), F.count_if(F.col(event)).alias("dd"))
    w = Window.partitionBy(*by) if by else Window
    down = w.orderBy(F.desc(time)).rowsBetween(Window.unboundedPreceding, 0)
    up = w.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    t = per.withColumn("n", F.sum("n_at").over(down)).withColumn("zbar", F.sum("n1_at").over(down) / F.col("n"))
    t = t.withColumn("h", F.sum(F.col("dd") / F.col("n")).over(up)).withColumn("hz", F.sum(F.col("dd") / F.col("n") * F.col("zbar")).over(up)).select(*by, time, "zbar", "h", "hz")
    score = F.when(F.col(event), z - F.col("zbar")).otherwise(0.0) - (z * F.col("h") - F.col("hz"))
    per_cluster = rows.join(t, [*by, time]).groupBy(*by, cluster).agg(F.sum(score).alias("w"))
    return tested(per_cluster.groupBy(*by).agg(F.sum("w").alias("u"), F.sum(F.col("w") * F.col("w")).alias("v")))


def moments(rows: DataFrame, y: str, xs: list[str]) -> dict[str, float]:
    """All sums a regression on [1, xs] needs, from one aggregation: one row to the driver."""
    names = ["_1", *xs]
    r = rows.withColumn("_1", F.lit(1.0))
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"{a}*{b}") for i, a in enumerate(names) for b in names[i:]] + [F.sum(F.col(a) * F.col(y)).alias(f"{a}*y") for a in names]
    return r.agg(*cells).first().asDict()


def ols(rows: DataFrame, y: str, xs: list[str]) -> tuple[list[float], list[list[float]]]:
    """(coefficients, inverse of X'X) of y on [1, xs]; at most a handful of regressors."""
    import numpy as np

    m = moments(rows, y, xs)
    names = ["_1", *xs]
    a = np.array([[m.get(f"{p}*{q}", m.get(f"{q}*{p}")) for q in names] for p in names], dtype=float)
    inverse = np.linalg.inv(a)
    return (inverse @ np.array([m[f"{p}*y"] for p in names])).tolist(), inverse.tolist()


def cr1(rows: DataFrame, y: str, xs: list[str], cluster: str, k: int = 1) -> DataFrame:
    """One row: coefficient k, its cluster-robust standard error, clusters, effective clusters, rows."""
    beta, inverse = ols(rows, y, xs)
    names = ["_1", *xs]
    r = rows.withColumn("_1", F.lit(1.0))
    u = F.col(y) - sum((F.lit(b) * F.col(x) for b, x in zip(beta, names)), F.lit(0.0))
    w = sum((F.lit(c) * F.col(x) for c, x in zip(inverse[k], names)), F.lit(0.0))
    per = r.groupBy(cluster).agg(F.sum(w * u).alias("s"), F.sum(w).alias("w"), F.count("*").alias("n"))
    out = per.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("g"), F.sum("n").alias("n"), F.var_pop(F.col("w") * F.col("w")).alias("gv"), F.avg(F.col("w") * F.col("w")).alias("gm"))
    c = F.col("g") / (F.col("g") - 1) * (F.col("n") - 1) / (F.col("n") - len(names))
    return out.select(F.lit(beta[k]).alias("coef"), F.sqrt(c * F.col("ss")).alias("se"), "g", (F.col("g") / (1 + F.col("gv") / (F.col("gm") * F.col("gm")))).alias("g_eff"), "n")


def wild_bootstrap(spark: SparkSession, rows: DataFrame, y: str, xs: list[str], cluster: str, draws: int, seed: int = 7, nulls: tuple[float, ...] = (0.0,), k: int = 1) -> DataFrame:
    """(beta0, t0, p): restricted wild cluster bootstrap with six-point weights for each null value.

    Works on one row of sums a cluster, so rows never multiply by draws."""
    import numpy as np

    names = ["_1", *xs]
    r = rows.withColumn("_1", F.lit(1.0))
    cells = [F.sum(F.col(a) * F.col(b)).alias(f"a{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i] + [F.sum(F.col(a) * F.col(y)).alias(f"c{i}") for i, a in enumerate(names)]
    per = r.groupBy(F.col(cluster).cast("string").alias("g")).agg(*cells)
    m, kk = moments(rows, y, xs), len(names)
    a = np.array([[m.get(f"{p}*{q}", m.get(f"{q}*{p}")) for q in names] for p in names], dtype=float)
    c = np.array([m[f"{p}*y"] for p in names])
    inverse = np.linalg.inv(a)
    free = [i for i in range(kk) if i != k]
    cell = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}")
    sets = []
    for b0 in nulls:
        beta = np.zeros(kk)
        beta[k] = b0
        beta[free] = np.linalg.solve(a[np.ix_(free, free)], c[free] - a[free, k] * b0)
        full = inverse @ c
        s = [F.col(f"c{i}") - sum((cell(i, j) * float(beta[j]) for j in range(kk)), F.lit(0.0)) for i in range(kk)]
        s_full = [F.col(f"c{i}") - sum((cell(i, j) * float(full[j]) for j in range(kk)), F.lit(0.0)) for i in range(kk)]
        sets.append(per.select(F.lit(b0).alias("beta0"), "g", *[x.alias(f"s{i}") for i, x in enumerate(s)], sum((F.lit(float(inverse[k, i])) * x for i, x in enumerate(s_full)), F.lit(0.0)).alias("obs"), F.lit(float(full[k] - b0)).alias("diff"), *[cell(i, j).alias(f"a{i}_{j}") for i in range(kk) for j in range(i, kk)]))
    table = sets[0]
    for one in sets[1:]:
        table = table.union(one)
    six = F.array(*[F.lit(x) for x in (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))])
    dealt = table.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("v", F.element_at(six, (draw(seed, F.col("b"), F.col("g")) % 6 + 1).cast("int")))
    keys = ["beta0", "b"]
    shift = dealt.groupBy(*keys).agg(*[F.sum(F.col("v") * F.col(f"s{i}")).alias(f"t{i}") for i in range(kk)])
    for i in range(kk):
        shift = shift.withColumn(f"d{i}", sum((F.lit(float(inverse[i, j])) * F.col(f"t{j}") for j in range(kk)), F.lit(0.0)))
    joined = dealt.join(shift.select(*keys, *[f"d{i}" for i in range(kk)]), keys)
    score = sum((F.lit(float(inverse[k, i])) * (F.col("v") * F.col(f"s{i}") - sum((cell(i, j) * F.col(f"d{j}") for j in range(kk)), F.lit(0.0))) for i in range(kk)), F.lit(0.0))
    reps = joined.groupBy(*keys).agg((F.max(f"d{k}") / F.sqrt(F.sum(score * score))).alias("t_star"))
    observed = table.groupBy("beta0").agg((F.max("diff") / F.sqrt(F.sum(F.col("obs") * F.col("obs")))).alias("t0"))
    return reps.join(observed, "beta0").groupBy("beta0").agg(F.max("t0").alias("t0"), F.avg((F.abs("t_star") >= F.abs("t0")).cast("double")).alias("p"))


def wild_interval(spark: SparkSession, rows: DataFrame, y: str, xs: list[str], cluster: str, draws: int, seed: int = 7, alpha: float = 0.05, k: int = 1) -> DataFrame:
    """One row: coefficient, CR1 standard error, p at zero and the interval of the nulls that ``wild_bootstrap`` keeps.

    The scores of a cluster are linear in the null's distance from the estimate, so five sums a draw give t of every
    null: clusters meet draws once. Nulls stand around the estimate in half standard errors, the reach doubles until
    both sides are rejected, ten steps refine each crossing and a line gives the end. An end is null where no null
    within 1,024 errors is rejected."""
    import numpy as np

    e = cr1(rows, y, xs, cluster, k).first()
    est, se = e["coef"], e["se"]
    kind = "coef double, se double, p double, lo double, hi double"
    if se is None or not 0 < se < math.inf:
        return spark.createDataFrame([(est, se, None, None, None)], kind)
    names = ["_1", *xs]
    kk = len(names)
    m = moments(rows, y, xs)
    a = np.array([[m.get(f"{p}*{q}", m.get(f"{q}*{p}")) for q in names] for p in names], dtype=float)
    inverse = np.linalg.inv(a)
    full = inverse @ np.array([m[f"{p}*y"] for p in names])
    free = [i for i in range(kk) if i != k]
    along = np.zeros(kk)
    along[k], along[free] = 1.0, -np.linalg.solve(a[np.ix_(free, free)], a[free, k])
    r = rows.withColumn("_1", F.lit(1.0))
    per = r.groupBy(F.col(cluster).cast("string").alias("g")).agg(*[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"a{i}_{j}") for i in range(kk) for j in range(i, kk)], *[F.sum(F.col(n) * F.col(y)).alias(f"c{i}") for i, n in enumerate(names)])
    cell = lambda i, j: F.col(f"a{min(i, j)}_{max(i, j)}")
    dot = lambda v, cols: sum((F.lit(float(x)) * c for x, c in zip(v, cols)), F.lit(0.0))
    per = staged(per.select("*", *[(F.col(f"c{i}") - dot(full, [cell(i, j) for j in range(kk)])).alias(f"s{i}") for i in range(kk)], *[(-dot(along, [cell(i, j) for j in range(kk)])).alias(f"z{i}") for i in range(kk)]))
    spread = per.agg(F.sqrt(F.sum(dot(inverse[k], [F.col(f"s{i}") for i in range(kk)]) ** 2)).alias("x")).first()["x"]
    six = F.array(*[F.lit(x) for x in (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))])
    dealt = per.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("v", F.element_at(six, (draw(seed, F.col("b"), F.col("g")) % 6 + 1).cast("int")))
    shift = dealt.groupBy("b").agg(*[F.sum(F.col("v") * F.col(f"{x}{i}")).alias(f"t{x}{i}") for x in "sz" for i in range(kk)])
    shift = shift.select("b", *[dot(inverse[i], [F.col(f"t{x}{j}") for j in range(kk)]).alias(f"d{x}{i}") for x in "sz" for i in range(kk)])
    score = lambda x: dot(inverse[k], [F.col("v") * F.col(f"{x}{i}") - sum((cell(i, j) * F.col(f"d{x}{j}") for j in range(kk)), F.lit(0.0)) for i in range(kk)])
    scores = dealt.join(shift, "b").select("b", F.col(f"ds{k}").alias("d0"), F.col(f"dz{k}").alias("d1"), score("s").alias("p"), score("z").alias("q"))
    sums = staged(scores.groupBy("b").agg(F.max("d0").alias("d0"), F.max("d1").alias("d1"), F.sum(F.col("p") ** 2).alias("pp"), F.sum(F.col("p") * F.col("q")).alias("pq"), F.sum(F.col("q") ** 2).alias("qq")))
    p: dict[float, float] = {}

    def ask(nulls: list[float]) -> None:
        new = sorted(set(nulls) - set(p))
        t = lambda x: F.abs((F.col("d0") + x * F.col("d1")) / F.sqrt(F.col("pp") + 2 * x * F.col("pq") + x * x * F.col("qq")))
        if new:
            p.update(zip(new, sums.agg(*[F.avg((t(b - est) >= abs(b - est) / spread).cast("double")) for b in new]).first()))

    def crossing(side: int) -> tuple[float, float] | None:
        """The first rejected null from the estimate outwards, after its neighbour."""
        out = sorted((b for b in p if (b - est) * side >= 0), key=lambda b: abs(b - est))
        return next(((a, b) for a, b in zip(out, out[1:]) if p[b] <= alpha < p[a]), None)

    ask([est + se * j / 2 for j in range(-8, 9)])
    reach = 4
    while reach < 1024 and not (crossing(-1) and crossing(1)):
        ask([est + side * se * reach * j / 4 for side in (-1, 1) for j in range(5, 9) if not crossing(side)])
        reach *= 2
    ask([a + (b - a) * j / 10 for a, b in filter(None, (crossing(-1), crossing(1))) for j in range(1, 10)])
    ends = [c and c[0] + (p[c[0]] - alpha) / (p[c[0]] - p[c[1]]) * (c[1] - c[0]) for c in (crossing(-1), crossing(1))]
    ask([0.0])
    return spark.createDataFrame([(est, se, p[0.0], *ends)], kind)


def student(df: float):
    """(two-sided tail of t, upper quantile) of Student's t, by integrating cos^(df - 1) over the angle of t."""
    import numpy as np

    angle = np.linspace(0.0, math.pi / 2, 100001)
    y = np.cos(angle) ** (df - 1)
    area = np.concatenate([[0.0], np.cumsum((y[1:] + y[:-1]) / 2)])
    area /= area[-1]
    tail = lambda t: float(1 - np.interp(math.atan(abs(t) / math.sqrt(df)), angle, area))
    upper = lambda alpha: math.sqrt(df) * math.tan(float(np.interp(1 - alpha, area, angle)))
    return tail, upper


REPORT = "coef double, se_cr1 double, g bigint, df bigint, p_cr1 double, lo_cr1 double, hi_cr1 double, p_wcr double, lo_wcr double, hi_wcr double, g_eff double, n bigint"


def regression_report(spark: SparkSession, rows: DataFrame, y: str, xs: list[str], cluster: str, draws: int, seed: int = 7, k: int = 1) -> DataFrame:
    """One row about coefficient k: CR1 and wild-bootstrap p and 95 % interval, clusters, their effective number, rows.

    Rows with a null go. All but n is null where regressors are collinear, rows are too few or one cluster is left."""
    import numpy as np

    r = rows.select(y, *xs, cluster).na.drop()
    names = ["_1", *xs]
    seen = r.agg(F.count("*").alias("n"), F.countDistinct(cluster).alias("g")).first()
    full = seen["n"] > len(names) and seen["g"] > 1
    if full:
        m = moments(r, y, xs)
        full = np.linalg.matrix_rank(np.array([[m.get(f"{p}*{q}", m.get(f"{q}*{p}")) for q in names] for p in names], dtype=float)) == len(names)
    if not full:
        return spark.createDataFrame([(None,) * 11 + (seen["n"],)], REPORT)
    e, w = cr1(r, y, xs, cluster, k).first(), wild_interval(spark, r, y, xs, cluster, draws, seed, k=k).first()
    tail, upper = student(e["g"] - 1)
    reach = upper(0.05) * e["se"]
    p = tail(e["coef"] / e["se"]) if e["se"] else None
    return spark.createDataFrame([(e["coef"], e["se"], e["g"], e["g"] - 1, p, e["coef"] - reach, e["coef"] + reach, w["p"], w["lo"], w["hi"], e["g_eff"], e["n"])], REPORT)


def numbered(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, number): the distinct values of ``order`` numbered from 0 within their keys. Staged.

    Range partitions are ordered side by side; the sizes of a key's earlier partitions are added. No task holds a key."""
    spread = [*keys, order]
    place = staged(rows.select(*spread).distinct().repartitionByRange(*spread).sortWithinPartitions(*spread).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # a row a key and partition
    sizes = place.groupBy(*keys, part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    w = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    met = place.withColumn("_part", part).join(sizes.drop("_n"), [*keys, "_part"])
    return staged(met.select(*spread, (F.col("_before") + F.col("_at") - F.col("_first")).alias("number")))


def multiplicities(rows: DataFrame, keys: list[str], cluster: str, draws: int, seed: int = 11) -> DataFrame:
    """(keys, b, cluster, freq): clusters of every key drawn with replacement, as often as the key has them, in each draw."""
    names = numbered(rows, keys, cluster)
    sizes = names.groupBy(*keys).agg(F.count("*").alias("_g"))
    slots = sizes.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).repartition(*keys, "b").withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_g") - 1)))
    picked = slots.withColumn("number", draw(seed, F.col("b"), F.col("_slot")) % F.col("_g")).groupBy(*keys, "b", "number").agg(F.count("*").alias("freq"))
    return picked.join(names, [*keys, "number"]).select(*keys, "b", cluster, "freq")


def cluster_draws(spark: SparkSession, clusters: DataFrame, cluster: str, draws: int, seed: int = 11) -> DataFrame:
    """(b, cluster, freq): clusters drawn with replacement, as often as there are, in each of ``draws``."""
    return multiplicities(clusters.select(F.lit(0).alias("_all"), cluster), ["_all"], cluster, draws, seed).select("b", cluster, "freq")


def bucketed(rows: DataFrame, column: str, buckets: int = 1024) -> DataFrame:
    """``rows`` with ``_k``, the bucket of ``column``: ascending, about equal in rows and bounded by its values."""
    from pyspark.ml.feature import Bucketizer

    marks = rows.agg(F.percentile_approx(column, [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0] or []
    splits = [-math.inf, *sorted({x for x in marks if not math.isnan(x) and not math.isinf(x)}), math.inf]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    return Bucketizer(splits=splits, inputCol=column, outputCol="_k", handleInvalid="keep").transform(rows)


def quantile(rows: DataFrame, value: str, group: str, q: float, cluster: str | None = None, draws: DataFrame | None = None) -> DataFrame:
    """(b?, group, q): exact linear quantile of each group, and of each draw of (b, cluster, freq) if given.

    Bucket counts, summed by cluster before they meet the draws, name the one or two buckets that hold the
    quantile; only their values are ordered, so no task holds a group's values."""
    parts = [group] if draws is None else [cluster, group]
    keys = [group] if draws is None else ["b", group]
    dealt = staged(bucketed(rows.where(F.col(value).isNotNull()).select(*parts, F.col(value).cast("double").alias("_v")), "_v"))

    def counted(at: DataFrame, by: list[str]) -> DataFrame:
        n = at.groupBy(*parts, *by).agg(F.count("*").alias("_n"))
        return n if draws is None else n.join(draws, cluster).groupBy(*keys, *by).agg(F.sum(F.col("_n") * F.col("freq")).alias("_n"))

    pos = F.lit(q) * (F.col("_all") - 1)
    low, high = F.floor(pos), F.ceil(pos)
    holds = lambda rank: (F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank)
    w = Window.partitionBy(*keys).orderBy("_k").rowsBetween(Window.unboundedPreceding, 0)
    whole = counted(dealt, ["_k"]).withColumn("_upto", F.sum("_n").over(w)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    cut = staged(whole.where(holds(low) | holds(high)).select(*keys, "_k", (F.col("_upto") - F.col("_n")).alias("_before"), "_all"))
    edge = counted(dealt.join(cut.select(group, "_k").distinct(), [group, "_k"]), ["_k", "_v"]).join(cut, [*keys, "_k"])
    w = Window.partitionBy(*keys, "_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("_upto", F.col("_before") + F.sum("_n").over(w))
    ends = edge.groupBy(*keys).agg(F.max("_all").alias("_all"), F.max(F.when(holds(low), F.col("_v"))).alias("_a"), F.max(F.when(holds(high), F.col("_v"))).alias("_b"))
    return ends.select(*keys, F.when(low == high, F.col("_a")).otherwise((high - pos) * F.col("_a") + (pos - low) * F.col("_b")).alias("q"))


def median_difference(spark: SparkSession, rows: DataFrame, value: str, group: str, one: str, other: str, cluster: str, draws: int, seed: int = 11) -> DataFrame:
    """One row: difference of exact medians with cluster-bootstrap percentiles; null below three a group."""
    r = rows.where(F.col(value).isNotNull() & F.col(group).isin(one, other))
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("q")))
    d = (side(one) - side(other)).alias("d")
    e = r.agg(F.count_if(F.col(group) == one).alias("n1"), F.count_if(F.col(group) == other).alias("n2")).first().asDict()
    e["est"] = quantile(r, value, group, 0.5).agg(d).first()["d"]
    reps = quantile(r, value, group, 0.5, cluster, cluster_draws(spark, r, cluster, draws, seed)).groupBy("b").agg(d)
    ci = reps.agg(F.expr("percentile(d, array(0.025D, 0.975D))").alias("c"), F.count("d").alias("used"))
    ok = F.lit(e["n1"] >= 3 and e["n2"] >= 3)
    return ci.select(F.lit(e["n1"]).cast("bigint").alias("n1"), F.lit(e["n2"]).cast("bigint").alias("n2"), F.when(ok, F.lit(e["est"]).cast("double")).alias("est"), F.when(ok, F.element_at("c", 1)).alias("lo"), F.when(ok, F.element_at("c", 2)).alias("hi"), "used")


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with the average rank of a double column as ``name``; nulls go.

    Distinct values are counted, dealt to buckets that start at the rows before them, and joined back."""
    per = staged(bucketed(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("_v")).agg(F.count("*").alias("_n")), "_v"))
    # at most 1,025 rows in one task
    starts = per.groupBy("_k").agg(F.sum("_n").alias("_sum")).withColumn("_start", F.sum("_sum").over(Window.orderBy("_k")) - F.col("_sum"))
    w = Window.partitionBy("_k").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranks = per.join(starts.select("_k", "_start"), "_k").select("_v", (F.col("_start") + F.sum("_n").over(w) - (F.col("_n") - 1) / 2.0).alias(name))
    return rows.join(ranks, F.col(column) == F.col("_v")).drop("_v")


def relabelled(rows: DataFrame, n1: int, draws: int, seed: int) -> DataFrame:
    """``rows`` once a draw, with ``one``: whether the draw's shuffle gives the row one of ``n1`` labels.

    The labels go to the smallest digests of a draw. Counts of digest buckets name the bucket that holds the last
    of them, and only that bucket's rows are ordered: no task holds a whole draw."""
    dealt = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("_h", draw(seed, F.col("b"), F.col("id"))).withColumn("_k", F.shiftright("_h", 16))
    w = Window.partitionBy("b").orderBy("_k")
    counts = dealt.groupBy("b", "_k").agg(F.count("*").alias("_n")).withColumn("_upto", F.sum("_n").over(w))
    cut = counts.where((F.col("_upto") >= n1) & (F.col("_upto") - F.col("_n") < n1)).select("b", F.col("_k").alias("_cut"), (n1 - F.col("_upto") + F.col("_n")).alias("_rest"))
    j = dealt.join(cut, "b")
    sure = j.where("_k <> _cut").withColumn("one", F.col("_k") < F.col("_cut"))
    edge = j.where("_k = _cut").withColumn("one", F.row_number().over(Window.partitionBy("b").orderBy("_h", "id")) <= F.col("_rest"))
    return sure.unionByName(edge).drop("_h", "_k", "_cut", "_rest")


def _far(est: Column, spread: Column) -> Column:
    """Whether a draw ``d`` is at least as far out as the estimate; rounding does not break ties."""
    return F.abs("d") >= F.abs(est) - 1e-12 * F.greatest(F.abs(est), spread)


def permutation(spark: SparkSession, rows: DataFrame, value: str, flag: str, draws: int, seed: int = 3, stat: str = "avg") -> DataFrame:
    """One row: difference of means or medians between flagged rows and the rest, and its two-sided p;
    null below three rows a side. Means cost a digest a row and draw; medians multiply rows by draws."""
    r = rows.where(F.col(value).isNotNull()).select("id", F.col(value).alias("v"), F.col(flag).alias("one"))
    f = (lambda c: f"avg(case when {c} then v end)") if stat == "avg" else (lambda c: f"percentile(case when {c} then v end, 0.5D)")
    diff = F.expr(f"{f('one')} - {f('not one')}")
    e = r.agg(diff.alias("est"), F.count_if(F.col("one")).alias("n1"), F.count_if(~F.col("one")).alias("n2"), F.count("*").alias("n"), F.avg("v").cast("double").alias("mean"), F.stddev_pop("v").alias("sd")).first()
    if stat == "avg":
        centred = r.select("id", (F.col("v").cast("double") - F.lit(e["mean"])).alias("v"))
        rest = F.lit(centred.agg(F.sum("v")).first()[0]).cast("double")
        reps = shuffles.labelled_sums(centred, ["v"], e["n1"], e["n"], draws, seed).where(F.lit(e["n"] > 0))
        reps = reps.select("b", (F.col("v") / F.nullif(F.lit(float(e["n1"])), F.lit(0.0)) - (rest - F.col("v")) / F.nullif(F.lit(float(e["n"] - e["n1"])), F.lit(0.0))).alias("d"))
    else:
        reps = relabelled(r.drop("one"), e["n1"], draws, seed).groupBy("b").agg(diff.alias("d"))
    est, ok = F.lit(e["est"]).cast("double"), F.lit(e["n1"] >= 3 and e["n2"] >= 3)
    return reps.agg(F.when(ok, F.max(est)).alias("est"), F.when(ok, (F.count_if(_far(est, F.lit(e["sd"]))) + 1) / (F.count("*") + 1)).alias("p"))


def ols_permutation(rows: DataFrame, y: str, flag: str, control: str, draws: int, seed: int = 3) -> DataFrame:
    """One row: coefficient of a dummy beside one control, and its p under shuffles of the dummy.

    The control is partialled out of both sides; a draw costs a digest a row and two sums over its labelled rows."""
    r = rows.select("id", F.col(y).cast("double").alias("y"), F.col(control).cast("double").alias("c"), F.col(flag).alias("one")).na.drop()
    x = F.col("one").cast("double")
    cov = lambda a, b: F.covar_pop(a, b)
    c, v = F.col("c"), F.col("y")
    coef = lambda xv, xc, xx, cv, cc: (xv * cc - xc * cv) / F.nullif(xx * cc - xc * xc, F.lit(0.0))
    e = r.agg(coef(cov(x, v), cov(x, c), F.var_pop(x), cov(c, v), F.var_pop(c)).alias("est"), F.count_if(F.col("one")).alias("n1"), F.count("*").alias("n"), F.avg("y").alias("my"), F.avg("c").alias("mc"), F.var_pop("y").alias("yy"), F.var_pop("c").alias("cc"), cov(c, v).alias("cv")).first()
    centred = r.select("id", (v - F.lit(e["my"])).alias("y"), (c - F.lit(e["mc"])).alias("c"))
    left = centred.agg(F.sum("y").alias("y"), F.sum("c").alias("c")).first()
    n, share = max(e["n"], 1), e["n1"] / max(e["n"], 1)
    met = lambda name: (F.col(name) - share * F.lit(left[name]).cast("double")) / n
    number = lambda name: F.lit(e[name]).cast("double")
    reps = shuffles.labelled_sums(centred, ["y", "c"], e["n1"], e["n"], draws, seed).where(F.lit(e["n"] > 0))
    reps = reps.select("b", coef(met("y"), met("c"), F.lit(share * (1 - share)), number("cv"), number("cc")).alias("d"))
    est = F.lit(e["est"]).cast("double")
    return reps.agg(F.max(est).alias("est"), ((F.count_if(_far(est, F.sqrt(number("yy")))) + 1) / (F.count("*") + 1)).alias("p"))


def rmst_difference(spark: SparkSession, rows: DataFrame, one: str, other: str, cluster: str, tau: float, draws: int, seed: int = 11, group: str = "grp", time: str = "d", event: str = "ev") -> DataFrame:
    """One row: difference of restricted means with cluster-bootstrap percentiles.

    Rows become counts by cluster, group, time and outcome before they meet the draws."""
    r = rows.where(F.col(group).isin(one, other))
    per = r.groupBy(cluster, group, time, event).agg(F.count("*").alias("n"))
    again = per.join(cluster_draws(spark, r, cluster, draws, seed), cluster).withColumn("n", F.col("n") * F.col("freq"))
    both = per.withColumn("b", F.lit(0)).unionByName(again.drop("freq")).withColumn("_key", F.concat_ws(":", F.col("b").cast("string"), F.col(group)))
    means = rmst(kaplan_meier(both, "_key", time, event, "n"), both.select("_key", "b", group).distinct(), tau, "_key", time)
    side = lambda g: F.max(F.when(F.col(group) == g, F.col("rmst")))
    d = means.groupBy("b").agg((side(one) - side(other)).alias("d"))
    boot = F.when(F.col("b") > 0, F.col("d"))
    return d.agg(F.max(F.when(F.col("b") == 0, F.col("d"))).alias("est"), F.percentile(boot, F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select("est", F.element_at("q", 1).alias("lo"), F.element_at("q", 2).alias("hi"))


def stratified_log_rank(rows: DataFrame, one: str, size: str, group: str = "grp", time: str = "d", event: str = "ev") -> DataFrame:
    """(stratum, u, v, chi2, p): the log-rank test below or at the exact median size, and above it."""
    found = quantile(rows.withColumn("_all_rows", F.lit(0)), size, "_all_rows", 0.5).first()
    median = found["q"] if found else None
    out = None
    for name, kept in (("small", F.col(size) <= F.lit(median)), ("large", F.col(size) > F.lit(median))):
        part = log_rank(rows.where(kept), one, group, time, event).select(F.lit(name).alias("stratum"), "u", "v", "chi2", "p")
        out = part if out is None else out.unionByName(part)
    return out


def placed(rows: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, ``rows``, place): each row's place, from 1, in the digest order of draws 0 to ``draws``.

    Counts of digest buckets tell where each bucket starts; only buckets are ordered, never a whole draw."""
    dealt = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(draws)))).withColumn("_h", draw(seed, F.col("b"), F.col("id"))).withColumn("_k", F.shiftright("_h", 16))
    starts = dealt.groupBy("b", "_k").agg(F.count("*").alias("_n")).withColumn("_start", F.sum("_n").over(Window.partitionBy("b").orderBy("_k")) - F.col("_n")).drop("_n")
    order = F.row_number().over(Window.partitionBy("b", "_k").orderBy("_h", "id"))
    return dealt.join(starts, ["b", "_k"]).withColumn("place", F.col("_start") + order).drop("_h", "_k", "_start")


def shuffled(rows: DataFrame, column: str, draws: int, seed: int) -> DataFrame:
    """``rows`` of (id, ...) once for each draw ``b`` from 0, with ``column`` dealt anew by the draw; in draw 0 each row keeps
    its own. A row takes the value of the row that had its place in draw 0."""
    at = staged(placed(rows, draws, seed))
    own = at.where("b = 0").select("place", F.col(column).alias("_value"))
    return at.drop(column).join(own, "place").withColumnRenamed("_value", column).drop("place")


def _two_sided(reps: DataFrame, least: int) -> DataFrame:
    """One row (est, p, n) of (b, d, n): draw 0 is the estimate; est and p are null below ``least`` rows."""
    own = lambda c: F.max(F.when(F.col("b") == 0, F.col(c)))
    out = reps.agg(own("d").alias("est"), F.coalesce(own("n"), F.lit(0)).alias("n"), F.collect_list(F.when(F.col("b") > 0, F.col("d"))).alias("_d"))
    met = F.size(F.filter("_d", lambda x: F.abs(x) >= F.abs(F.col("est")) * (1 - 1e-12)))
    ok = (F.col("n") >= least) & F.col("est").isNotNull()
    return out.select(F.when(ok, F.col("est")).alias("est"), F.when(ok, (met + 1) / (F.size("_d") + 1)).alias("p"), "n")


def _dealt_products(r: DataFrame, x: str, others: list[str], draws: int, seed: int) -> tuple[dict, DataFrame]:
    """(moments of ``r``: n, means, var and cov of population by name; (b, others): covariance of x, dealt anew, with each).
    Only products with x change with the draw."""
    names = [x, *others]
    pairs = [(a, c) for i, a in enumerate(names) for c in names[i:]]
    e = r.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in names], *[F.covar_pop(a, c).alias(f"{a}*{c}") for a, c in pairs]).first().asDict()
    e |= {f"{c}*{a}": e[f"{a}*{c}"] for a, c in pairs}
    centred = r.select("id", *[(F.col(c) - F.lit(e[f"m_{c}"])).alias(c) for c in names])
    sums = shuffles.dealt_sums(centred, x, others, e["n"], draws, seed)
    return e, sums.select("b", *[(F.col(c) / max(e["n"], 1)).alias(c) for c in others])


def _number(e: dict, name: str) -> Column:
    return F.lit(e[name]).cast("double")


@tidied
def spearman_permutation(rows: DataFrame, x: str, y: str, draws: int, seed: int = 3) -> DataFrame:
    """One row: rank correlation of rows of (id, x, y), its two-sided permutation p and n; null below 15 rows."""
    pairs = rows.select("id", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop()
    ranks = staged(average_ranks(average_ranks(pairs, "x", "rx"), "y", "ry").select("id", "rx", "ry"))
    e, reps = _dealt_products(ranks, "ry", ["rx"], draws, seed)
    scale = F.nullif(F.sqrt(_number(e, "rx*rx") * _number(e, "ry*ry")), F.lit(0.0))
    return _two_sided(reps.select("b", (F.col("rx") / scale).alias("d"), F.lit(e["n"]).alias("n")), 15)


@tidied
def slope_permutation(rows: DataFrame, y: str, x: str, control: str, draws: int, seed: int = 3) -> DataFrame:
    """One row: slope of y on a continuous x beside one control, its two-sided p under shuffles of x, and n; null below 15
    rows. The control is partialled out of both sides, so each draw is two sums of products."""
    r = rows.select("id", F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x"), F.col(control).cast("double").alias("c")).na.drop()
    e, reps = _dealt_products(r, "x", ["y", "c"], draws, seed)
    xx, cc, cy = (_number(e, k) for k in ("x*x", "c*c", "c*y"))
    coef = (F.col("y") * cc - F.col("c") * cy) / F.nullif(xx * cc - F.col("c") * F.col("c"), F.lit(0.0))
    return _two_sided(reps.select("b", coef.alias("d"), F.lit(e["n"]).alias("n")), 15)


@tidied
def slopes_permutation(rows: DataFrame, y: str, x: str, controls: list[str], draws: int, seed: int = 3) -> DataFrame:
    """One row: slope of y on a continuous x beside any controls, its two-sided p under shuffles of x, and n; null below 15
    rows. Every draw is one group of ``linear.solved``: sweeps in columns, nothing is solved on the driver."""
    from . import linear

    xs = [x, *controls]
    plain = {name: f"_v{i}" for i, name in enumerate([*xs, y])}
    r = staged(rows.select("id", *[F.col(c).cast("double").alias(v) for c, v in plain.items()]).na.drop(subset=list(plain.values())))
    e, reps = _dealt_products(r, plain[x], [v for c, v in plain.items() if c != x], draws, seed)
    names = [None, *plain.values()]

    def total(a: str | None, c: str | None) -> Column:
        """Sum of products of two of [1, xs, y]."""
        mean = lambda v: F.lit(1.0) if v is None else _number(e, f"m_{v}")
        moved = plain[x] in (a, c) and a != c
        about = F.lit(0.0) if None in (a, c) else F.col(c if a == plain[x] else a) if moved else _number(e, f"{a}*{c}")
        return (about + mean(a) * mean(c)) * float(e["n"])

    cells = [total(a, names[j]).alias(linear.cell(i, j)) for i, a in enumerate(names) for j in range(i, len(names))]
    fits = linear.solved(reps.select("b", F.lit(e["n"]).alias("n"), *cells), len(xs))
    return _two_sided(fits.select("b", F.col("b1").alias("d"), "n"), 15)
