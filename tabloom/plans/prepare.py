"""Cleaning compositions: P19 prepare, P20 train/test processing, P22 candidate matrix assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.cols import col, datetime_columns, numeric_columns
from ..operators import clean as CL
from ..operators import distribution as DI
from ..operators import profile as PR
from ..operators import quality as Q
from ..operators.heavy import near_constant, near_unique
from ..session import materialize


def prepare_data(df: DataFrame, key: str | None = None, order_by=None, target: str | None = None,
                 const_threshold: float = 0.995, card_threshold: float = 0.95) -> tuple[DataFrame, dict]:
    """Type repair -> normalise -> dedup -> drop near-constant -> drop high-cardinality strings.

    The report holds the type plan, the number of duplicates, the dropped columns with their reason, and
    the profile bundle of the result: column profile, class balance (with a target), modality and
    normality of the numeric columns, trends of the datetime columns.  Its tables are not computed until
    they are read (``datetimes`` is a function to call)."""
    plan = CL.type_repair_plan(df)
    out = CL.normalize_categories(CL.apply_type_repair(df, plan))
    out, dropped = CL.drop_duplicates(out, key, order_by)
    # three more passes read the deduplicated table: write it once (shared checkpoint folder)
    out = materialize(out, "prepared")
    excl = [target] if target else []
    const = near_constant(out, [c for c in out.columns if c not in excl], const_threshold)
    out = out.select(*[col(c) for c in out.columns if c not in const])
    text = [f.name for f in out.schema.fields if f.dataType.simpleString() == "string" and f.name not in excl]
    card = near_unique(out, text, card_threshold)
    out = out.select(*[col(c) for c in out.columns if c not in card])
    reasons = out.sparkSession.createDataFrame(
        [(c, why, share) for why, found in (("constant", const), ("high_cardinality", card)) for c, share in found.items()],
        "column string, reason string, share double")
    report = {"type_plan": plan, "duplicates": dropped, "dropped": reasons}
    return out, report | profile_bundle(out, target)


def profile_bundle(df: DataFrame, target: str | None = None) -> dict:
    """Tables that describe a prepared frame, by name."""
    nums = [c for c in numeric_columns(df) if c != target]
    bundle = {"profile": PR.column_profile(df)}
    if target:
        bundle["class_balance"] = PR.class_balance(df, target)
    if nums:
        bundle["modality"] = DI.modality(df, nums)
        bundle["normality"] = DI.normality(df, nums)
    dates = datetime_columns(df)
    bundle["datetimes"] = lambda: PR.datetime_report(df, dates)  # a job per column: run when called
    return bundle


def process_pair(train: DataFrame, test: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """P20: types decided on train and applied to both, then train-fitted winsorising and imputation."""
    plan = CL.type_repair_plan(train.drop(target))
    tr, te = CL.apply_type_repair(train, plan), CL.apply_type_repair(test, plan)
    nums = [c for c in numeric_columns(tr) if c != target]
    cats = [f.name for f in tr.schema.fields if f.dataType.simpleString() == "string" and f.name != target]
    bounds = CL.winsor_bounds(tr, nums) if nums else {}
    tr, te = CL.winsorize(tr, bounds), CL.winsorize(te, bounds)
    fill = CL.impute_plan(tr, nums, cats)
    return CL.impute(tr, fill), CL.impute(te, fill)


def assemble_candidates(train: DataFrame, test: DataFrame, id_col: str, target: str, originals_num: list[str],
                        originals_cat: list[str], new_features: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Best original columns (T01) + new feature columns that do not clash, sanitised (P09),
    renamed to ASCII on both sides (P16) and aligned to train order (P17)."""
    best = Q.best_originals(train, originals_num, originals_cat, target)
    keep = [r["column"] for r in best.orderBy("kind", "rnk").collect()]  # <= 15 rows
    feats = keep + [f for f in new_features if f not in keep]
    nums = [f for f in feats if f in numeric_columns(train)]
    tr = CL.sanitize(train.select(id_col, target, *feats), nums)
    te = CL.sanitize(test.select(id_col, *[f for f in feats if f in test.columns]), nums)
    tr, te, mapping = CL.rename_pair(tr, te)
    names = [mapping[f] for f in feats]
    tr, te = CL.align(tr, te, names, keep=[mapping[id_col], mapping[target]])
    return tr, te, names
