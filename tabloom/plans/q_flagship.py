"""Flagship query and shared oracle fragments for feature-quality reports."""

from __future__ import annotations

from .flagship import docs_feature_report
from .problems import with_sql
from .registry import query

DECILES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"


def stats_sql(feat: str, id_col: str, target: str, features: list[str], k: int | None = 5) -> str:
    """DuckDB text computing the A20 + A28 report over CTE ``feat`` (all features DOUBLE, no NULLs)."""
    on = ", ".join(features)
    lim = f"WHERE rank <= {k}" if k else ""
    return f"""
long AS (UNPIVOT (SELECT {id_col}, {target}, {on} FROM {feat}) ON {on} INTO NAME feature VALUE value),
pear AS (SELECT feature, covar_samp(value, {target}) / nullif(stddev_samp(value) * stddev_samp({target}), 0) AS pearson
         FROM long GROUP BY feature),
rk AS (SELECT feature, value, {target} AS y,
              rank() OVER (PARTITION BY feature ORDER BY value)
              + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r FROM long),
sp AS (SELECT feature,
              covar_samp(r, y) / nullif(stddev_samp(r) * stddev_samp(y), 0) AS spearman,
              (sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2)
                / nullif(sum(y) * (count(*) - sum(y)), 0) AS auc
       FROM rk GROUP BY feature),
edges AS (SELECT feature, quantile_cont(value, {DECILES}) AS e FROM long GROUP BY feature),
binned AS (SELECT l.feature, l.{target} AS y, len(list_filter(e.e, lambda x: x < l.value)) AS bin
           FROM long l JOIN edges e USING (feature)),
cnt AS (SELECT feature, bin, y, count(*) AS n FROM binned GROUP BY feature, bin, y),
mi AS (SELECT feature, greatest(sum(n / nn * ln(n * nn / (nx * ny))), 0) AS mutual_info FROM (
         SELECT *, sum(n) OVER (PARTITION BY feature, bin) AS nx, sum(n) OVER (PARTITION BY feature, y) AS ny,
                sum(n) OVER (PARTITION BY feature) AS nn FROM cnt) GROUP BY feature),
nu AS (SELECT feature, 100.0 * count(*) FILTER (WHERE value IS NULL) / count(*) AS null_pct,
              count(DISTINCT value) AS nunique FROM long GROUP BY feature),
pairs AS (SELECT a.feature AS fi, b.feature AS fj,
                 abs(covar_samp(a.value, b.value) / nullif(stddev_samp(a.value) * stddev_samp(b.value), 0)) AS c
          FROM long a JOIN long b ON a.{id_col} = b.{id_col} AND a.feature < b.feature GROUP BY a.feature, b.feature),
mc AS (SELECT f.feature, coalesce(max(p.c), 0.0) AS max_corr_with_others
       FROM (SELECT DISTINCT feature FROM long) f
       LEFT JOIN (SELECT fi AS feature, c FROM pairs UNION ALL SELECT fj, c FROM pairs) p USING (feature)
       GROUP BY f.feature),
st AS (SELECT feature, coalesce(pearson, 0.0) AS pearson, coalesce(spearman, 0.0) AS spearman,
              coalesce(mutual_info, 0.0) AS mutual_info, coalesce(auc, 0.5) AS auc, CAST(null_pct AS DOUBLE) AS null_pct,
              nunique, max_corr_with_others, max_corr_with_others > 0.85 AS high_collinearity
       FROM pear JOIN sp USING (feature) JOIN mi USING (feature) JOIN nu USING (feature) JOIN mc USING (feature)),
sc AS (SELECT *,
         CASE WHEN abs(pearson) > 0.9 OR mutual_info > 0.5 THEN 'suspicious_leakage'
              WHEN nunique <= 1 OR null_pct > 80 OR high_collinearity THEN 'weak'
              WHEN mutual_info >= 0.05 AND abs(pearson) >= 0.10 THEN 'strong'
              WHEN mutual_info >= 0.01 OR abs(pearson) >= 0.05 THEN 'useful' ELSE 'weak' END AS verdict,
         CASE WHEN abs(pearson) > 0.9 OR mutual_info > 0.5 THEN 0.1::DOUBLE
              WHEN nunique <= 1 OR null_pct > 80 OR high_collinearity THEN 0.15::DOUBLE
              WHEN mutual_info >= 0.05 AND abs(pearson) >= 0.10 THEN 0.9::DOUBLE
              WHEN mutual_info >= 0.01 OR abs(pearson) >= 0.05 THEN 0.65::DOUBLE ELSE 0.35::DOUBLE END AS score
       FROM st),
ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, mutual_info DESC, abs(pearson) DESC, feature) AS rank
           FROM sc)
SELECT rank, feature, round(pearson, 6) + 0.0 AS pearson, round(spearman, 6) + 0.0 AS spearman,
       round(mutual_info, 6) + 0.0 AS mutual_info, round(auc, 6) + 0.0 AS auc, round(null_pct, 6) + 0.0 AS null_pct,
       nunique, round(max_corr_with_others, 6) + 0.0 AS max_corr_with_others, high_collinearity, verdict,
       round(score, 6) + 0.0 AS score
FROM ranked {lim}"""


DOCS_FEAT_SQL = """
aux_first AS (SELECT doc_id, min(source) AS source, min(lang) AS lang, min(n_chars) AS n_chars
              FROM docs_aux GROUP BY doc_id),
freq_source AS (SELECT source AS c, CAST(count(*) AS DOUBLE) / (SELECT count(source) FROM docs_aux) AS f
                FROM docs_aux WHERE source IS NOT NULL GROUP BY source),
freq_lang AS (SELECT lang AS c, CAST(count(*) AS DOUBLE) / (SELECT count(lang) FROM docs_aux) AS f
              FROM docs_aux WHERE lang IS NOT NULL GROUP BY lang),
cnt_source AS (SELECT source AS c, CAST(count(*) AS DOUBLE) AS f FROM docs_aux WHERE source IS NOT NULL GROUP BY source),
tr_cat AS (SELECT t.doc_id, t.quality, a.lang, a.source FROM docs_train t LEFT JOIN aux_first a USING (doc_id)),
te_lang AS (SELECT lang AS c, avg(quality) AS te FROM tr_cat GROUP BY lang),
te_source AS (SELECT source AS c, avg(quality) AS te FROM tr_cat GROUP BY source),
gm AS (SELECT avg(quality) AS g FROM docs_train),
med AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.5) AS m FROM aux_first),
feat AS (
  SELECT t.doc_id, t.quality,
         coalesce(fs.f, 0.0) AS fe_freq_source, coalesce(fl.f, 0.0) AS fe_freq_lang,
         coalesce(cs.f, 0.0) AS fe_cnt_source, coalesce(tl.te, gm.g) AS fe_te_lang,
         coalesce(ts.te, gm.g) AS fe_te_source, coalesce(CAST(a.n_chars AS DOUBLE), med.m) AS fe_n_chars,
         CAST(t.toxic AS DOUBLE) AS toxic
  FROM docs_train t LEFT JOIN aux_first a USING (doc_id)
  LEFT JOIN freq_source fs ON fs.c = a.source LEFT JOIN freq_lang fl ON fl.c = a.lang
  LEFT JOIN cnt_source cs ON cs.c = a.source LEFT JOIN te_lang tl ON tl.c = a.lang
  LEFT JOIN te_source ts ON ts.c = a.source CROSS JOIN gm CROSS JOIN med)"""

DOCS_FEATURES = ["fe_freq_source", "fe_freq_lang", "fe_cnt_source", "fe_te_lang", "fe_te_source",
                 "fe_n_chars", "toxic"]

FLAGSHIP_SQL = (with_sql("docs") + "," + DOCS_FEAT_SQL + ","
                + stats_sql("feat", "doc_id", "quality", DOCS_FEATURES, 5))


@query("flagship_docs_top5", FLAGSHIP_SQL)
def flagship(spark, sf):
    return docs_feature_report(spark, sf, 5)
