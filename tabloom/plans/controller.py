"""Candidate generation and the selection controller."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import features as FE
from ..operators.kernels import moments, quantile_wide, value_counts

def auto_candidates(train: DataFrame, numeric: list[str], pair_columns: list[str] | None = None) -> list[FE.Fitted]:
    """log1p (when the train minimum is >= 0) and square of every numeric column,
    plus median-filled ratios a/b for pairs i < j of ``pair_columns`` (default: all)."""
    # every median and minimum in two small jobs, not one per feature
    med = {r["column"]: r["m"] for r in quantile_wide(train, numeric, {"m": 0.5}).collect()}
    mins = {r["column"]: r["min"] for r in moments(train, numeric).select("column", "min").collect()}
    fits: list[FE.Fitted] = []
    for c in numeric:
        if mins.get(c) is not None and mins[c] >= 0:
            fits.append(FE.log1p(f"fb_log1p_{c}", train, c, median=med.get(c), minimum=mins[c]))
        fits.append(FE.square(f"fb_sq_{c}", train, c, median=med.get(c)))
    head = numeric if pair_columns is None else pair_columns
    for i, a in enumerate(head):
        for b in head[i + 1:]:
            fits.append(FE.median_ratio(f"fb_{a}_div_{b}", train, a, b, medians=med))
    return fits


# M09 --------------------------------------------------------------------------------------------
def _pick_aux_columns(aux: DataFrame, key: str, lo: int, hi: int | None, numeric_only: bool) -> list[str]:
    """Columns of the right type with lo..hi distinct values, in file order (all of them)."""
    from pyspark.sql import functions as F
    from ..functions.cols import categorical_columns, numeric_columns
    kind = set(numeric_columns(aux) if numeric_only else categorical_columns(aux))
    cols = [c for c in aux.columns if c != key and c in kind]
    if not cols:
        return []
    vc = value_counts(aux, cols).where(F.col("value").isNotNull())
    nd = {r["column"]: r["k"] for r in vc.groupBy("column").agg(F.count(F.lit(1)).alias("k")).collect()}
    return [c for c in cols if nd.get(c, 0) >= lo and (hi is None or nd.get(c, 0) <= hi)]


def _ladder_fits(level: int, aux: dict, keys: dict, taken=()) -> list[FE.Fitted]:
    """Features of a fallback level: frequency encodings (1) or numeric lookups (2) of the auxiliary tables."""
    fits, names = [], set(taken)

    def named(stem):
        name, k = stem[:50], 1
        while name in names and name not in taken:  # two long names may share their first 50 characters
            k += 1
            name = f"{stem[:46]}_{k}"
        names.add(name)
        return name
    for table, df in aux.items():
        lk, ak = keys[table]
        if level == 1:
            fits += [FE.freq_encoding(named(f"fb_freq_{c}"), df, c, key=lk, aux_key=ak) for c in _pick_aux_columns(df, ak, 2, 50, False)]
        else:
            fits += [FE.numeric_map(named(f"fb_map_{c}"), df, ak, c, left_key=lk) for c in _pick_aux_columns(df, ak, 2, None, True)]
    return fits


def fallback_ladder(train: DataFrame, test: DataFrame, aux: dict, keys: dict, id_col: str, max_features: int = 5):
    """L1 frequency encodings (2 <= nunique <= 50) -> L2 numeric lookups (nunique >= 2) -> L3
    random normals; the first level whose outputs pass the M08 checks wins.

    ``keys``: aux name -> (left key in train/test, key in aux).  Returns (level, train_out, test_out, features).
    """
    from ..operators.validate import validate_outputs
    from ..sources.files import random_baseline
    from pyspark.sql import functions as F

    for level in (1, 2):
        fits = _ladder_fits(level, aux, keys)[:max_features]
        if not fits:
            continue
        tr, te, feats = FE.apply_all(train, fits), FE.apply_all(test, fits), [f.name for f in fits]
        # every check decides (the null report is information, not a check)
        checks = validate_outputs(train, test, tr, te, feats)
        if checks.where((F.col("check") != "feature_null_cells") & ~F.col("ok")).count() == 0:
            return level, tr, te, feats
    feats = [f"fb_rand_{i}" for i in range(1, 6)]
    return 3, random_baseline(train, id_col), random_baseline(test, id_col), feats


def top_up(train: DataFrame, test: DataFrame, features: list[str], aux: dict, keys: dict, max_features: int = 5):
    """M09, on save: keeps the first ``max_features`` of ``features`` and fills the free places with the fallback
    features of level 1 and then level 2 whose names are not taken.  A kept feature that the test side lacks is 0
    there.  Returns (train, test, features), the features last and in one order on both sides."""
    from pyspark.sql import functions as F
    from ..functions.cols import col
    keep = [f for f in features if f in train.columns][:max_features]
    te = test
    for f in keep:
        if f not in te.columns:
            te = te.withColumn(f, F.lit(0.0))
    fits: list[FE.Fitted] = []
    for level in (1, 2):
        if len(keep) + len(fits) < max_features:
            names = {*train.columns, *(f.name for f in fits)}
            fits += [f for f in _ladder_fits(level, aux, keys, names) if f.name not in names]
    fits = fits[: max_features - len(keep)]
    feats = keep + [f.name for f in fits]
    out = []
    for df in (train, te):
        full = FE.apply_all(df, fits)
        out.append(full.select(*[col(c) for c in df.columns if c not in feats], *[col(f) for f in feats]))
    return out[0], out[1], feats


class Ledger:
    """Judged candidates by round, kept as files: a controller that is started again goes on after the last round.

    A round is one folder that is written whole (or not at all); writing it again replaces it."""

    def __init__(self, spark, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def record(self, number: int, judged: DataFrame) -> DataFrame:
        judged.write.mode("overwrite").parquet(f"{self.path}/round={number}")
        return self.round(number)

    def round(self, number: int) -> DataFrame | None:
        """The round's judged candidates, None when it was not finished."""
        try:
            self.spark.read.text(f"{self.path}/round={number}/_SUCCESS").count()
        except Exception as e:  # noqa: BLE001 - not there: the round did not end
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        return self.spark.read.parquet(f"{self.path}/round={number}")

    def best(self, k: int = 5) -> list[str]:
        """The ``k`` best features of all recorded rounds, without leaky ones: what a save can fall back to."""
        from pyspark.sql import functions as F
        found = [r for r in (self.round(1), self.round(2)) if r is not None]
        if not found:
            return []
        every = found[0] if len(found) == 1 else found[0].unionByName(found[1]).dropDuplicates(["feature"])
        good = every.where(F.col("verdict") != "suspicious_leakage").orderBy(F.desc("score"), F.desc("mutual_info"), F.desc(F.abs("pearson")), "feature")
        return [r["feature"] for r in good.select("feature").limit(k).collect()]


# M12 --------------------------------------------------------------------------------------------
#: a first round whose set score (A28) reaches this needs no second one
ROUND_GATE = 0.75


def two_round(train: DataFrame, target: str, fold: str, holdout: int, round1: list, round2_pool: list,
              k: int = 5, gate: float = ROUND_GATE, ledger: Ledger | None = None):
    """Propose -> hold-out leak filter (A26) -> stats (A20) -> rubric (A28) -> the best ``k`` of the round.

    A second round runs only when the first set's overall score stays below ``gate``.  It has candidates of
    its own (``round2_pool`` without the names the first round judged weak or leaky) and a set of at most
    ``k`` of them; the two sets are compared (A27) and the winner is returned.

    ``ledger``: every judged candidate of a round (statistics, verdict, score) is recorded there when the round
    ends; a round that is already recorded is read instead of judged again.

    round1 / round2_pool are lists of fitted features (``FE.Fitted``).  Returns
    (winner set id, report DataFrame of the winning set).
    """
    from pyspark.sql import functions as F
    from ..operators import quality as Q
    from ..session import materialize, scratch_path

    if ledger is None:
        ledger = Ledger(train.sparkSession, scratch_path(train.sparkSession, "ledger"))

    def evaluate(number, fits):
        v = ledger.round(number)
        if v is None:
            v = ledger.record(number, judge(fits))
        best = materialize(Q.ranked(v, k), "round-set")  # at most k rows
        return v, best, [r["feature"] for r in best.select("feature").collect()]

    def judge(fits):
        m = materialize(FE.apply_all(train, fits), "round")
        hf = Q.holdout_filter(m, [f.name for f in fits], target, fold, holdout)
        kept = [r["feature"] for r in hf.where("keep").select("feature").collect()]  # one row per feature
        return Q.verdicts(Q.feature_stats(m, kept, target))

    judged, best1, set1 = evaluate(1, round1)
    score = Q.overall_score(best1).first()["overall_score"]
    if score >= gate:
        return 1, best1
    weak = {r["feature"] for r in judged.where(F.col("verdict").isin("weak", "suspicious_leakage")).collect()}
    pool = {f.name: f for f in round2_pool if f.name not in weak and f.name not in set1}
    if not pool:
        return 1, best1
    _, best2, set2 = evaluate(2, list(pool.values()))
    both = best1.unionByName(best2).dropDuplicates(["feature"])
    winner = Q.compare_sets(both, {1: set1, 2: set2}).where(F.col("rank") == 1).first()["set_id"]
    return winner, best1 if winner == 1 else best2
