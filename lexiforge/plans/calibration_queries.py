"""Queries over scored rows: curves, choices, models."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.functions import text as X
from lexiforge.operators import calibration as K
from lexiforge.operators import models as M
from lexiforge.operators import selection as S
from lexiforge.operators.stored import saved
from lexiforge.plans.common import query, r6

FEATURES = ["punct_ratio", "digit_ratio", "upper_ratio", "words", "diversity"]

_SCORED = "SELECT d.doc_id, d.lang, l.quality AS y, (('0x' || substr(md5('p' || d.doc_id), 1, 4))::BIGINT + CASE WHEN l.quality = 1 THEN 30000 ELSE 0 END) / 95536.0::DOUBLE AS p FROM documents d JOIN labels l USING (doc_id)"


def _scored(t):
    n = F.conv(F.substring(F.md5(F.concat(F.lit("p"), F.col("doc_id").cast("string")).cast("binary")), 1, 4), 16, 10).cast("long")
    p = (n + F.when(F.col("quality") == 1, 30000).otherwise(0)) / F.lit(95536.0)
    return t("documents").join(t("labels"), "doc_id").select("doc_id", "lang", F.col("quality").alias("y"), p.alias("p"))


_CURVE = f"""c AS (SELECT lang, i, (i / 50.0::DOUBLE)::DOUBLE AS threshold, count(*) FILTER (WHERE p >= i / 50.0::DOUBLE) AS kept, count(*) FILTER (WHERE p >= i / 50.0::DOUBLE AND y = 1) AS coh_kept, count(*) AS total, sum(y)::BIGINT AS total_coh
  FROM ({_SCORED}), range(51) AS r(i) GROUP BY lang, i), m AS (SELECT *, CASE WHEN kept > 0 THEN coh_kept::DOUBLE / kept ELSE 0 END AS pr FROM c),
v AS (SELECT *, CASE WHEN kept > 0 THEN greatest(0, (pr + 3.8416 / (2 * kept) - 1.96 * sqrt(pr * (1 - pr) / kept + 3.8416 / (4.0 * kept * kept))) / (1 + 3.8416 / kept)) ELSE 0 END AS lcb FROM m)"""


@query("threshold_curve", f"WITH {_CURVE} SELECT lang, threshold, kept, coh_kept, total, total_coh, round(kept::DOUBLE / total, 6) AS coverage, round(pr, 6) AS precision, round(lcb, 6) AS precision_lcb, round(CASE WHEN total_coh > 0 THEN coh_kept::DOUBLE / total_coh ELSE 0 END, 6) AS recall, round(coh_kept::DOUBLE / total, 6) AS coherent_kept_rate FROM v")
def _(t, spark):
    done = K.curve(_scored(t), 51, ["lang"])
    return done.select(*[r6(F.col(c)).alias(c) if k == "double" and c != "threshold" else F.col(c) for c, k in done.dtypes])


@query("threshold_average", f"WITH {_CURVE} SELECT threshold, round(avg(pr), 6) AS precision_mean, round(coalesce(stddev_samp(pr), 0), 6) AS precision_std, round(avg(kept::DOUBLE / total), 6) AS coverage_mean FROM v GROUP BY threshold")
def _(t, spark):
    return K.averaged(K.curve(_scored(t), 51, ["lang"])).select("threshold", *[r6(F.col(c)).alias(c) for c in ("precision_mean", "precision_std", "coverage_mean")])


def _choice(measure, least, minimum):
    ok = f"{measure} >= {least}"
    return f"""WITH {_CURVE}, q AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY (kept >= {minimum}) DESC, ({ok}) DESC, CASE WHEN {ok} THEN coh_kept::DOUBLE ELSE {measure} END DESC, threshold) AS r FROM v)
SELECT lang, CASE WHEN kept >= {minimum} THEN threshold ELSE 1.0 END AS threshold, kept, CASE WHEN kept < {minimum} THEN 'none' WHEN {ok} THEN 'met' ELSE 'best' END AS fallback FROM q WHERE r = 1"""


@query("threshold_choice", _choice("lcb", 0.9, 1))
def _(t, spark):
    return K.chosen(K.curve(_scored(t), 51, ["lang"]), 0.9, True, ["lang"]).select("lang", "threshold", "kept", "fallback")


@query("threshold_fallback", _choice("pr", 1.01, 20))
def _(t, spark):
    return K.chosen(K.curve(_scored(t), 51, ["lang"]), 1.01, False, ["lang"], 20).select("lang", "threshold", "kept", "fallback")


@query("threshold_median", f"SELECT median(threshold) AS threshold FROM ({_choice('lcb', 0.9, 1)})")
def _(t, spark):
    return K.median_threshold(K.chosen(K.curve(_scored(t), 51, ["lang"]), 0.9, True, ["lang"]))


@query("standardise", "SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_samp(c_acctbal) OVER (), 6) AS c_acctbal FROM customer")
def _(t, spark):
    return K.standardised(t("customer").select("c_custkey", "c_acctbal"), ["c_acctbal"]).select("c_custkey", r6(F.col("c_acctbal")).alias("c_acctbal"))


@query("linear_rule", "SELECT doc_id, CASE WHEN -20.0 * length(regexp_replace(text, '[^!-/:-@\\[-`{-~]', '', 'g')) / greatest(length(text), 1) + 0.7 >= 0 THEN 1 ELSE -1 END AS label FROM documents")
def _(t, spark):
    # twenty times the share in one division: twenty times a rounded share lands beside 0.7 where it is just 0.7; a null text gives none
    marks = 20.0 * F.regexp_count("text", F.lit(r"[!-/:-@\[-`{-~]"))
    rows = t("documents").select("doc_id", (marks / F.greatest(F.length("text"), F.lit(1))).alias("marks_in_20"))
    return K.kept_by_rule(rows, {"marks_in_20": -1.0}, 0.7).select("doc_id", "label")


@query("raw_rule_fold", "WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS d FROM customer) SELECT c_custkey, CASE WHEN 1.5 * (c_acctbal - m) / d + 0.2 - ln(0.7 / 0.3) >= 0 THEN 1 ELSE -1 END AS label FROM customer, s")
def _(t, spark):
    stats = t("customer").agg(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("d")).first()  # a model's two numbers
    a, c = K.raw_rule({"c_acctbal": 1.5}, {"c_acctbal": stats["m"]}, {"c_acctbal": stats["d"]}, 0.2, 0.7)
    return K.kept_by_rule(t("customer"), a, c).select("c_custkey", "label")


def _features(t):
    shape, words = X.shape(F.col("text")), X.lexical(F.col("text"))
    return t("documents").join(t("labels"), "doc_id").select(
        "doc_id", F.col("quality").alias("y"), *[shape[c].alias(c) for c in FEATURES[:3]], F.log1p(words["sentence_length"]).alias("words"), words["lexical_diversity"].alias("diversity")
    )


def _validated(t):
    rows = S.folds(_features(t), "doc_id", 5)
    return rows, K.cross_validated(rows, "doc_id", FEATURES)


@query("logreg_cv")
def _(t, spark):
    return _validated(t)[1].select("doc_id", "fold", "y", r6(F.col("p")).alias("p"))


@query("logreg_weights")
def _(t, spark):
    done = K.weight_summary(_validated(t)[1], FEATURES)
    return done.select("feature", *[r6(F.col(c)).alias(c) for c in ("weight_mean", "weight_std", "weight_mean_abs", "sign_consistency")])


@query("perm_importance")
def _(t, spark):
    rows, scored = _validated(t)
    best = K.chosen(K.curve(scored, by=["fold"]), 0.9, True, ["fold"])
    return K.permutation_importance(rows, scored, best, "doc_id", FEATURES).select("feature", "metric", r6(F.col("delta_mean")).alias("delta_mean"), r6(F.col("delta_std")).alias("delta_std"))


@query("ablation")
def _(t, spark):
    rows = S.folds(_features(t), "doc_id", 5).persist()
    steps = K.ablation(rows, "doc_id", FEATURES, 0.9, fewest=3)
    rows.unpersist()
    return spark.createDataFrame([(s["step"], s["n_features"], s["removed"], s["coherent_kept_rate"], s["precision"], s["chosen_t"]) for s in steps], "step int, n_features int, removed string, coherent_kept_rate double, precision double, chosen_t double")


@query("forest_label")
def _(t, spark):
    rows = S.hashed_split(saved(_features(t)), "doc_id", 80)  # fitting reads its rows several times
    return M.fit_and_score(rows.where("train"), rows.where("not train"), FEATURES, "forest").select("doc_id", "y", r6(F.col("p")).alias("p"))


@query("margin_label")
def _(t, spark):
    rows = S.hashed_split(saved(_features(t)), "doc_id", 80)  # fitting reads its rows several times
    return M.fit_and_score(rows.where("train"), rows.where("not train"), FEATURES, "svm").select("doc_id", "y", r6(F.col("p")).alias("p"))
