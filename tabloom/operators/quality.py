"""Feature quality: A15, A20-A28, M02, M03, M07.

All statistics come out in long form, one row per feature, from
aggregations over the stacked (feature, value, target) table or over the
value-count kernel; nothing is looped per column on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cols import col, finite
from ..functions import stats as S
from ..session import materialize
from .gram import correlations
from .kernels import cumulative_counts, long_form, quantile_edges, quantiles, value_counts

# The sentinel for missing numbers, the leak and the collinearity bounds.
SENTINEL = -999.0
LEAK_PEARSON = 0.9
LEAK_MI = 0.5
COLLINEAR = 0.85


def label_codes(df: DataFrame, features: list[str]) -> DataFrame:
    """P12 applied to the string/boolean features: sorted distinct value -> 0..k-1, NULL stays NULL.

    The dictionary holds distinct values only (string features reaching the
    statistics have bounded cardinality: P06 prunes near-unique ones).
    """
    types = dict(df.dtypes)
    base = df
    from .ordering import dense_codes
    for f in [f for f in features if types[f] in ("string", "boolean")]:
        dic = dense_codes(df.select(col(f).cast("string").alias("_lv")), "_lv")
        # dictionary size grows with the column's cardinality: the join strategy is left to AQE
        base = base.join(dic, col(f).cast("string") == F.col("_lv"), "left") \
            .withColumn(f, F.col("_code").cast("double")).drop("_lv", "_code")
    return base


def sentinel_of(df: DataFrame, f: str) -> float:
    """P11 fill value: -999 for numeric features, -1 for label-encoded ones."""
    return -1.0 if dict(df.dtypes)[f] in ("string", "boolean") else SENTINEL


def encoded(df: DataFrame, features: list[str], keep: list[str]) -> DataFrame:
    """P11 + P12: numeric NULL -> -999; strings label-encoded by sorted value, NULL -> -1."""
    fills = {f: sentinel_of(df, f) for f in features}
    coded = label_codes(df, features)
    return coded.select(*[col(k) for k in keep],
                        *[F.coalesce(col(f).cast("double"), F.lit(fills[f])).alias(f) for f in features])


def pearson_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(feature, pearson) on pairwise non-null rows; constant -> NULL."""
    lf = long_form(df, features, "double", [target])
    return lf.groupBy(F.col("column").alias("feature")).agg(
        S.pearson(F.col("value"), col(target)).alias("pearson"))


def rank_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Value counts with average rank per value (ties share the mean rank)."""
    return ranks_of(value_counts(df, features, target, "double").where(F.col("value").isNotNull()))


def ranks_of(vc: DataFrame) -> DataFrame:
    """Average ranks from (column, value, n).  The counts and the ranks are written once: the running total reads its
    input several times and the sums read the ranks twice."""
    cum = cumulative_counts(materialize(vc, "value-counts"))
    return materialize(cum.withColumn("avg_rank", F.col("cum_before") + (F.col("n") + 1) / 2.0), "ranks")


def spearman_auc_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """A21 + M02: Spearman rho and ROC AUC of each feature against a 0/1 target.

    With a binary target, rank(y) is affine in y, so rho = pearson(avg_rank(x), y)
    and everything reduces to sums over the value-count table (one row per
    distinct value), centred for numerical stability.
    """
    return spearman_auc_of(rank_table(df, features, target))


def spearman_auc_of(rt: DataFrame) -> DataFrame:
    """Spearman rho and ROC AUC from the rank table (column, n, sum_y, avg_rank)."""
    g = rt.groupBy(F.col("column").alias("feature")).agg(
        F.sum("n").alias("n_tot"), F.sum("sum_y").alias("n_pos"),
        F.sum(F.col("avg_rank") * F.col("sum_y")).alias("R_pos"))
    rt2 = rt.join(g, rt["column"] == g["feature"])
    m = (F.col("n_tot") + 1) / 2.0
    ybar = F.col("n_pos") / F.col("n_tot")
    sums = rt2.groupBy("feature", "n_tot", "n_pos", "R_pos").agg(
        F.sum((F.col("avg_rank") - m) * (F.col("sum_y") - F.col("n") * ybar)).alias("sxy"),
        F.sum(F.col("n") * (F.col("avg_rank") - m) * (F.col("avg_rank") - m)).alias("sxx"))
    syy = F.col("n_tot") * ybar * (1 - ybar)
    neg = F.col("n_tot") - F.col("n_pos")
    return sums.select(
        "feature",
        F.try_divide(F.col("sxy"), F.nullif(F.sqrt(F.col("sxx") * syy), F.lit(0.0))).alias("spearman"),
        F.try_divide(F.col("R_pos") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0,
                     F.nullif(F.col("n_pos") * neg, F.lit(0.0))).alias("auc"))


def mi_binned(df: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Plug-in mutual information (nats) between decile bins of each feature and the target.

    Edges are the exact train quantiles k/bins, found by narrowing (no value is counted that is not near one of
    them); bin = number of edges strictly below x.  Returns (feature, mutual_info), never negative.
    """
    df = materialize(df.select(col(target), *[col(f) for f in features]), "binned-input")  # read four times
    lf = long_form(df, features, "double", [target]).where(F.col("value").isNotNull())
    edges = quantile_edges(None, [k / bins for k in range(1, bins)], df, features)
    binned = (lf.join(F.broadcast(edges), "column")
              .select("column", col(target).alias("_y"),
                      F.size(F.filter("_edges", lambda e: e < F.col("value"))).alias("bin")))
    return mi_from_counts(binned.groupBy("column", "bin", "_y").agg(F.count(F.lit(1)).alias("n")),
                          "column", "bin", "_y").withColumnRenamed("column", "feature")


def mi_from_counts(counts: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """sum p(x,y) ln(p(x,y) / (p(x) p(y))) per group from (group, x, y, n)."""
    wx = Window.partitionBy(group, x)
    wy = Window.partitionBy(group, y)
    wg = Window.partitionBy(group)
    t = (counts.withColumn("nx", F.sum("n").over(wx)).withColumn("ny", F.sum("n").over(wy))
         .withColumn("n_all", F.sum("n").over(wg)))
    term = F.col("n") / F.col("n_all") * F.log(F.col("n") * F.col("n_all") / (F.col("nx") * F.col("ny")))
    return t.groupBy(group).agg(F.greatest(F.sum(term), F.lit(0.0)).alias("mutual_info"))


def corr_pairs(df: DataFrame, features: list[str]) -> DataFrame:
    """|pearson| for every feature pair i < j, (feature_i, feature_j, abs_corr), in one pass for any number of
    features; NULLs leave a row out of the pairs they are in."""
    return correlations(df, features).select("feature_i", "feature_j", F.abs("corr").alias("abs_corr"))


def max_corr_table(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, max_corr_with_others, high_collinearity); single feature -> 0."""
    pairs = corr_pairs(df, features)
    both = pairs.select(F.col("feature_i").alias("feature"), "abs_corr").unionByName(
        pairs.select(F.col("feature_j").alias("feature"), "abs_corr"))
    names = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    m = both.groupBy("feature").agg(F.max("abs_corr").alias("mc"))
    return (names.join(m, "feature", "left")
            .select("feature", F.coalesce(F.col("mc"), F.lit(0.0)).alias("max_corr_with_others"))
            .withColumn("high_collinearity", F.col("max_corr_with_others") > F.lit(COLLINEAR)))


def null_unique_table(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, null_pct, nunique) from the value-count kernel."""
    vc = value_counts(df, features)
    return vc.groupBy(F.col("column").alias("feature")).agg(
        (F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)) * 100.0 / F.sum("n")).alias("null_pct"),
        F.count("value").alias("nunique"))


def vc_stats(vc: DataFrame, bins: int = 10) -> DataFrame:
    """Pearson, Spearman, AUC and binned MI of every column against a 0/1 target, from
    (column, value, n, sum_y) alone.  The table holds one row per distinct value, so
    after the single aggregation that built it no statistic touches the rows again.
    """
    # one row per (feature, distinct value): small next to the rows, written once for four statistics
    cum = cumulative_counts(vc.select("column", "value", "n", "sum_y"))
    cum = materialize(cum.withColumn("avg_rank", F.col("cum_before") + (F.col("n") + 1) / 2.0), "ranks")
    tot = cum.groupBy("column").agg(F.sum("n").alias("n_tot"), F.sum("sum_y").alias("n_pos"),
                                    F.sum(F.col("n") * F.col("value")).alias("s_x"))
    j = cum.join(F.broadcast(tot), "column")
    mx = F.col("s_x") / F.col("n_tot")
    mr = (F.col("n_tot") + 1) / 2.0
    ybar = F.col("n_pos") / F.col("n_tot")
    dy = F.col("sum_y") - F.col("n") * ybar
    sums = j.groupBy("column", "n_tot", "n_pos").agg(
        F.sum((F.col("value") - mx) * dy).alias("sxy"),
        F.sum(F.col("n") * (F.col("value") - mx) * (F.col("value") - mx)).alias("sxx"),
        F.sum((F.col("avg_rank") - mr) * dy).alias("sry"),
        F.sum(F.col("n") * (F.col("avg_rank") - mr) * (F.col("avg_rank") - mr)).alias("srr"),
        F.sum(F.col("avg_rank") * F.col("sum_y")).alias("r_pos"))
    syy = F.col("n_tot") * ybar * (1 - ybar)
    neg = F.col("n_tot") - F.col("n_pos")
    corr = sums.select(
        F.col("column").alias("feature"),
        F.try_divide(F.col("sxy"), F.nullif(F.sqrt(F.col("sxx") * syy), F.lit(0.0))).alias("pearson"),
        F.try_divide(F.col("sry"), F.nullif(F.sqrt(F.col("srr") * syy), F.lit(0.0))).alias("spearman"),
        F.try_divide(F.col("r_pos") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0,
                     F.nullif(F.col("n_pos") * neg, F.lit(0.0))).alias("auc"))
    edges = quantile_edges(cum, [k / bins for k in range(1, bins)])
    binned = (cum.join(F.broadcast(edges), "column")
              .withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col("value"))))
              .groupBy("column", "bin").agg(F.sum("sum_y").alias("n1"), F.sum(F.col("n") - F.col("sum_y")).alias("n0")))
    # plug-in MI straight from (bin, n1, n0): the bin total is n1 + n0 and the class totals are
    # known per column, so one aggregation replaces the per-marginal windows
    nb = F.col("n1") + F.col("n0")
    big_n, pos = F.col("n_tot"), F.col("n_pos")

    def term(nc, ny):
        return F.when(nc > 0, nc / big_n * F.log(nc * big_n / (nb * ny))).otherwise(F.lit(0.0))
    mi = (binned.join(F.broadcast(tot.select("column", "n_tot", "n_pos")), "column")  # one row per column
          .groupBy(F.col("column").alias("feature"))
          .agg(F.greatest(F.sum(term(F.col("n1"), pos) + term(F.col("n0"), big_n - pos)), F.lit(0.0))
               .alias("mutual_info")))
    return corr.join(mi, "feature", "left")


def graded_stats(enc: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """The statistics of ``vc_stats`` for a target that is not 0/1: Pearson and Spearman on its numbers and
    average ranks, mutual information on its values as classes; an AUC is not defined (NULL)."""
    y = enc.groupBy(col(target).cast("double").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    ranks = cumulative_counts(y.withColumn("column", F.lit("y"))).select(
        F.col("value").alias("_yv"), (F.col("cum_before") + (F.col("n") + 1) / 2.0).alias("_ry"))
    lf = long_form(enc, features, "double", [target])
    byx = (lf.join(ranks, col(target).cast("double") == F.col("_yv"))
           .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum("_ry").alias("s"),
                                           F.sum(F.col("_ry") * F.col("_ry")).alias("ss")))
    x = cumulative_counts(byx.select("column", "value", "n", "s", "ss")).withColumn(
        "r", F.col("cum_before") + (F.col("n") + 1) / 2.0)
    t = x.groupBy("column").agg(
        F.sum("n").cast("double").alias("m"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias("rr"), F.sum("ss").alias("yy"),
        F.sum(F.col("r") * F.col("s")).alias("ry"))
    mid = F.col("m") * (F.col("m") + 1) / 2.0 * (F.col("m") + 1) / 2.0  # m times the squared mean rank
    spear = t.select(F.col("column").alias("feature"), F.try_divide(
        F.col("ry") - mid, F.nullif(F.sqrt((F.col("rr") - mid) * (F.col("yy") - mid)), F.lit(0.0))).alias("spearman"))
    return (pearson_table(enc, features, target).join(spear, "feature", "left")
            .withColumn("auc", F.lit(None).cast("double"))
            .join(mi_binned(enc, features, target, bins), "feature", "left"))


def feature_stats(train: DataFrame, features: list[str], target: str, bins: int = 10) -> DataFrame:
    """Pearson, spearman, mutual_info, auc, null_pct, nunique, max |corr| with others.

    The candidate matrix is persisted once; then two passes: one value-count
    aggregation (-> every per-feature statistic) and one wide pair-covariance
    aggregation (-> collinearity).  Nulls count in null_pct / nunique as NULL and
    take the sentinel (-999, or -1 for encoded strings) in every other statistic.  Without rows every feature has
    zero statistics and a NULL null_pct.
    """
    if not features:
        return train.sparkSession.createDataFrame(
            [], "feature string, pearson double, spearman double, mutual_info double, auc double, "
                "null_pct double, nunique long, max_corr_with_others double, high_collinearity boolean")
    # the candidate matrix is the expensive part (joins, fitted lookups): materialise it once in
    # the checkpoint folder; every statistic below then plans against a short lineage
    base = label_codes(train.where(col(target).isNotNull()).select(col(target), *[col(f) for f in features]),
                       features)
    base = materialize(base, "candidates")
    fills = {f: sentinel_of(train, f) for f in features}
    fill = F.create_map(*[x for f, v in fills.items() for x in (F.lit(f), F.lit(v))])
    # one aggregation: NULLs take the sentinel value but are counted apart, so null_pct and
    # nunique (values with at least one non-NULL row) come from the same table
    lf = long_form(base, features, "double", [target])
    vc = (lf.withColumn("_null", F.col("value").isNull().cast("long"))
          .withColumn("value", F.coalesce(F.col("value"), F.element_at(fill, F.col("column"))))
          .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.sum(col(target).cast("double")).alias("sum_y"),
                                          F.sum("_null").alias("n_null")))
    vc = materialize(vc, "value-counts")
    nu = vc.groupBy(F.col("column").alias("feature")).agg(
        (F.sum("n_null") * 100.0 / F.sum("n")).alias("null_pct"),
        F.count(F.when(F.col("n") > F.col("n_null"), F.lit(1))).alias("nunique"))
    enc = base.select(col(target), *[F.coalesce(col(f), F.lit(fills[f])).cast("double").alias(f) for f in features])
    classes = {r[0] for r in base.select(col(target).cast("double")).distinct().limit(3).collect()}
    binary = classes <= {0.0, 1.0}
    st = vc_stats(vc, bins) if binary else graded_stats(enc, features, target, bins)
    mc = max_corr_table(enc, features)
    # every feature has a row, also without rows to judge
    return (mc.join(nu, "feature", "left").join(st, "feature", "left")
            .select("feature",
                    F.coalesce("pearson", F.lit(0.0)).alias("pearson"),
                    F.coalesce("spearman", F.lit(0.0)).alias("spearman"),
                    F.coalesce("mutual_info", F.lit(0.0)).alias("mutual_info"),
                    # a target of more than two values has no AUC
                    (F.coalesce("auc", F.lit(0.5)) if binary else F.col("auc")).alias("auc"),
                    "null_pct", F.coalesce("nunique", F.lit(0)).alias("nunique"), "max_corr_with_others", "high_collinearity"))


# A28 ------------------------------------------------------------------------------------------
# Rubric bands (MI, |pearson|) and the score we assign inside each band.
STRONG_MI, STRONG_P = 0.05, 0.10
USEFUL_MI, USEFUL_P = 0.01, 0.05
SCORES = {"strong": 0.9, "useful": 0.65, "weak": 0.35, "junk": 0.15, "suspicious_leakage": 0.1}


def verdicts(stats: DataFrame) -> DataFrame:
    """Add verdict and score from the rubric bands (deterministic stand-in for the judge)."""
    ap = F.abs(F.col("pearson"))
    mi = F.col("mutual_info")
    leak = (ap > LEAK_PEARSON) | (mi > LEAK_MI)
    junk = (F.col("nunique") <= 1) | (F.col("null_pct") > 80) | F.col("high_collinearity")
    verdict = (F.when(leak, "suspicious_leakage").when(junk, "weak")
               .when((mi >= STRONG_MI) & (ap >= STRONG_P), "strong")
               .when((mi >= USEFUL_MI) | (ap >= USEFUL_P), "useful").otherwise("weak"))
    score = (F.when(leak, SCORES["suspicious_leakage"]).when(junk, SCORES["junk"])
             .when(verdict == "strong", SCORES["strong"]).when(verdict == "useful", SCORES["useful"])
             .otherwise(SCORES["weak"]))
    return stats.withColumn("verdict", verdict).withColumn("score", score)


def overall_score(scored: DataFrame) -> DataFrame:
    """One-row set score: mean non-leaky score - .10 per collinear pair - .05 per null>30 % - .30 if leak."""
    leak = F.col("verdict") == "suspicious_leakage"
    return scored.agg(
        F.avg(F.when(~leak, F.col("score"))).alias("base"),
        (F.sum(F.col("high_collinearity").cast("int")) / 2.0).alias("collinear_pairs"),
        F.sum((F.col("null_pct") > 30).cast("int")).alias("null_heavy"),
        F.max(leak.cast("int")).alias("has_leak"),
    ).select(F.least(F.lit(1.0), F.greatest(F.lit(0.0),
             F.coalesce("base", F.lit(0.0)) - 0.10 * F.floor("collinear_pairs") - 0.05 * F.col("null_heavy")
             - 0.30 * F.col("has_leak"))).alias("overall_score"))


def ranked(scored: DataFrame, k: int | None = 5) -> DataFrame:
    """T02 / ranking best -> worst: score, then mutual information, |pearson|, name."""
    w = Window.orderBy(F.desc("score"), F.desc("mutual_info"), F.desc(F.abs("pearson")), F.asc("feature"))
    out = scored.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= k) if k else out


def holdout_filter(matrix: DataFrame, features: list[str], target: str, fold: str, holdout: int,
                   min_holdout: float = 0.001, ratio: float = 0.2, min_full: float = 0.01) -> DataFrame:
    """Binned MI on all training rows vs on one hold-out fold.

    keep = not (holdout MI < 0.001 or (full MI > 0.01 and holdout MI < 0.2 full MI));
    when every feature would be dropped, all are kept.
    """
    # values that are no number count as missing, and missing is 0 here
    enc = matrix.select(col(target), col(fold), *[
        F.coalesce(finite(col(f).try_cast("double")), F.lit(0.0)).alias(f) for f in features])
    full = mi_binned(enc, features, target).withColumnRenamed("mutual_info", "mi_full")
    hold = mi_binned(enc.where(col(fold) == holdout), features, target).withColumnRenamed("mutual_info", "mi_holdout")
    d = full.join(hold, "feature")
    keep0 = ~((F.col("mi_holdout") < min_holdout)
              | ((F.col("mi_full") > min_full) & (F.col("mi_holdout") < ratio * F.col("mi_full"))))
    anyk = F.max(F.col("_k").cast("int")).over(Window.partitionBy())  # one row per feature
    return (d.withColumn("_k", keep0).withColumn("keep", F.when(anyk == 1, F.col("_k")).otherwise(F.lit(True)))
            .drop("_k"))


def compare_sets(stats: DataFrame, sets: dict) -> DataFrame:
    """Per candidate set: leak flag, summed MI and |pearson| of non-leaky features; rank:
    no leak first, then summed MI (to 1e-6), then summed |pearson|, ties to the earlier set."""
    spark = stats.sparkSession
    members = spark.createDataFrame([(int(k), f) for k, fs in sets.items() for f in fs], "set_id int, feature string")
    leak = (F.abs(F.col("pearson")) > LEAK_PEARSON) | (F.col("mutual_info") > LEAK_MI)
    agg = members.join(stats, "feature").groupBy("set_id").agg(
        F.max(leak.cast("int")).alias("has_leak"),
        F.sum(F.when(leak, F.lit(0.0)).otherwise(F.col("mutual_info"))).alias("sum_mi"),
        F.sum(F.when(leak, F.lit(0.0)).otherwise(F.abs(F.col("pearson")))).alias("sum_abs_pearson"))
    from ..functions.cols import r6
    agg = agg.withColumn("sum_mi", r6(F.col("sum_mi"))).withColumn("sum_abs_pearson", r6(F.col("sum_abs_pearson")))
    w = Window.orderBy("has_leak", F.desc("sum_mi"), F.desc("sum_abs_pearson"), "set_id")  # one row per set
    return agg.withColumn("rank", F.row_number().over(w).cast("long"))


def best_originals(train: DataFrame, numeric: list[str], categorical: list[str], target: str,
                   k_num: int = 10, k_cat: int = 5, max_card: int = 10) -> DataFrame:
    """Top numeric columns by |pearson| and top low-cardinality categoricals by target-rate spread."""
    nums = pearson_table(train, numeric, target).select(
        F.col("feature").alias("column"), F.lit("numeric").alias("kind"),
        F.abs(F.coalesce(F.col("pearson"), F.lit(0.0))).alias("score"))
    vc = value_counts(train, categorical, target).where(F.col("value").isNotNull())
    rate = F.col("sum_y") / F.col("n")
    cats = (vc.groupBy("column").agg((F.max(rate) - F.min(rate)).alias("score"), F.count(F.lit(1)).alias("_k"))
            .where(F.col("_k") <= max_card).select("column", F.lit("categorical").alias("kind"), "score"))
    w = Window.partitionBy("kind").orderBy(F.desc("score"), "column")  # one row per column
    r = nums.unionByName(cats).withColumn("rnk", F.row_number().over(w))
    return r.where(((F.col("kind") == "numeric") & (F.col("rnk") <= k_num))
                   | ((F.col("kind") == "categorical") & (F.col("rnk") <= k_cat)))
