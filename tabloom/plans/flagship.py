"""Flagship: build, measure and rank candidate features for the docs problem.

labels (train split) --left join--> documents; candidates: frequency and
count encodings of ``source``/``lang`` (fitted on the auxiliary table), target
encodings of ``lang``/``source`` (fitted on train), ``n_chars`` lookup with
median fill, and the original ``toxic`` column.  Each candidate is scored
(A20), judged by the rubric (A28) and the best five are returned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cols import r6
from ..operators import features as FE
from ..operators import joins as JN
from ..operators import quality as Q
from . import problems

REPORT_COLUMNS = ["rank", "feature", "pearson", "spearman", "mutual_info", "auc", "null_pct", "nunique",
                  "max_corr_with_others", "high_collinearity", "verdict", "score"]


def docs_candidates(p: problems.Problem) -> tuple[list[FE.Fitted], DataFrame]:
    """Attach the auxiliary columns once (dedup per key + one left join), then encode them.

    Returns the fitted candidates and the attached training frame they apply to.
    """
    docs = p.aux["documents"]
    y = p.roles.target
    attached = JN.lookup_join(p.train, docs, key="doc_id")
    fits = [
        FE.freq_encoding("fe_freq_source", docs, "source"),
        FE.freq_encoding("fe_freq_lang", docs, "lang"),
        FE.count_encoding("fe_cnt_source", docs, "source"),
        FE.target_encoding("fe_te_lang", attached, "lang", y),
        FE.target_encoding("fe_te_source", attached, "source", y),
        FE.fill_with_median("fe_n_chars", "n_chars", FE.lookup(docs, "doc_id", "n_chars"), "_v"),
    ]
    return fits, attached


def report(stats: DataFrame, k: int | None = 5) -> DataFrame:
    out = Q.ranked(Q.verdicts(stats), k)
    return out.select(
        F.col("rank").cast("long").alias("rank"), "feature",
        *[r6(F.col(c)).alias(c) for c in ("pearson", "spearman", "mutual_info", "auc", "null_pct",
                                          "max_corr_with_others")],
        F.col("nunique").cast("long").alias("nunique"), "high_collinearity", "verdict",
        r6(F.col("score")).alias("score")).select(*REPORT_COLUMNS)


def docs_feature_report(spark: SparkSession, sf_dir: str, k: int = 5) -> DataFrame:
    p = problems.docs(spark, sf_dir)
    fitted, attached = docs_candidates(p)
    train = FE.apply_all(attached, fitted)
    feats = [f.name for f in fitted] + ["toxic"]
    stats = Q.feature_stats(train, feats, p.roles.target)
    return report(stats, k)
