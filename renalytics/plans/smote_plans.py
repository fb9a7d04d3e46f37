"""Oversampling plans (F11, F11a, F12) on the scaled training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import exprs as X
from ..operators import knn as KN
from ..operators import smote as SM
from ..operators import split as SP
from ..session import cut_lineage
from .base import rhu, with_ctes
from .fixture_models import LINEAR_CTES, scaled_split
from .registry import register

CONT = ["age", "hemoglobin"]
BINARY = ["gender", "diabetes", "hypertension", "foamy_urine", "extra_salt", "living_area"]
FEATS = CONT + BINARY
_F = ", ".join(FEATS)


def _train(spark, sf_dir):
    return (scaled_split(spark, sf_dir).where(F.col("split") == "train")
            .select("patient_id", *FEATS, "ckd_diagnosis"))


def _vectors(train, minority):
    mino = train.where(F.col("ckd_diagnosis") == minority)
    return mino.groupBy(*FEATS).agg(F.min("patient_id").alias("gid"), F.count(F.lit(1)).alias("mult"))


_D2 = " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATS)
_SMOTE_CTES = dict(LINEAR_CTES, **{
    "tr": f"SELECT patient_id, {_F}, ckd_diagnosis FROM scaled WHERE split = 'train'",
    "cc": "SELECT ckd_diagnosis AS lab, count(*) AS n FROM tr GROUP BY 1",
    "params": "SELECT mn.lab AS minority, mn.n AS m, (SELECT max(n) FROM cc WHERE lab <> mn.lab) AS nmaj, "
              "least(5, mn.n - 1) AS k FROM (SELECT * FROM cc ORDER BY n, lab LIMIT 1) mn",
    "mino": "SELECT tr.* FROM tr, params WHERE tr.ckd_diagnosis = params.minority",
    "vec": f"SELECT {_F}, min(patient_id) AS gid, count(*) AS mult FROM mino GROUP BY {_F}",
    "pairs": f"SELECT a.gid, b.gid AS nb_gid, b.mult AS h_mult, {rhu(_D2, 9)} AS d2 "
             "FROM vec a JOIN vec b ON a.gid <> b.gid "
             "UNION ALL SELECT gid, gid AS nb_gid, mult - 1 AS h_mult, 0e0 AS d2 FROM vec WHERE mult > 1",
    "rk": "SELECT *, sum(h_mult) OVER (PARTITION BY gid ORDER BY d2, nb_gid ROWS UNBOUNDED PRECEDING) - h_mult "
          "AS before FROM pairs",
    "knn": "SELECT gid, CAST(unnest(range(CAST(before AS BIGINT), CAST(least(before + h_mult, params.k) AS BIGINT))) "
           "AS INTEGER) AS j, nb_gid, d2 "
           "FROM rk, params WHERE before < params.k",
    "idx": f"SELECT m.patient_id, row_number() OVER (ORDER BY h, m.patient_id) - 1 AS idx, v.gid, "
           + ", ".join(f"m.{c}" for c in FEATS) +
           " FROM (SELECT *, ('0x' || substr(md5('42|smote|' || CAST(patient_id AS VARCHAR)), 1, 15))::BIGINT AS h "
           f"FROM mino) m JOIN vec v ON " + " AND ".join(f"m.{c} = v.{c}" for c in FEATS),
    "syn": "SELECT range AS synthetic_id FROM range((SELECT CAST(floor(0.6e0 * nmaj) AS BIGINT) - m FROM params))",
    "sh": "SELECT synthetic_id, "
          "(('0x' || substr(md5('42|smote|' || CAST(synthetic_id AS VARCHAR) || '|base'), 1, 15))::BIGINT) % params.m AS idx, "
          "CAST((('0x' || substr(md5('42|smote|' || CAST(synthetic_id AS VARCHAR) || '|nn'), 1, 15))::BIGINT) % params.k AS INTEGER) AS j, "
          "CAST(('0x' || substr(md5('42|smote|' || CAST(synthetic_id AS VARCHAR) || '|gap'), 1, 15))::BIGINT AS DOUBLE) "
          "/ 1152921504606846976e0 AS gap FROM syn, params",
    "synth": "SELECT sh.synthetic_id, " + ", ".join(
        f"{rhu(f'i.{c} + sh.gap * (v.{c} - i.{c})', 6)} AS {c}" for c in FEATS)
        + ", params.minority AS ckd_diagnosis FROM sh JOIN idx i ON sh.idx = i.idx "
          "JOIN knn ON knn.gid = i.gid AND knn.j = sh.j JOIN vec v ON v.gid = knn.nb_gid, params",
})


@register("f11a_minority_knn", with_ctes("SELECT gid, j, nb_gid, d2 FROM knn", "enc_split",
                                         extra=_SMOTE_CTES))
def f11a_minority_knn(spark, sf_dir):
    train = _train(spark, sf_dir)
    counts = SM.class_counts(train, "ckd_diagnosis")
    minority = min(counts, key=lambda c: (counts[c], c))
    return KN.knn_table(_vectors(train, minority), CONT, BINARY, 5)


@register("f11_smote_synthetic_rows", with_ctes("SELECT * FROM synth", "enc_split", extra=_SMOTE_CTES))
def f11_smote_synthetic_rows(spark, sf_dir):
    syn = SM.smote(_train(spark, sf_dir), CONT, BINARY, "ckd_diagnosis", "patient_id")
    return syn.select("synthetic_id", *[X.round_half_up(c, 6).alias(c) for c in FEATS], "ckd_diagnosis")


@register("f12_class_balance", with_ctes(
    "SELECT 'before' AS stage, ckd_diagnosis, CAST(count(*) AS BIGINT) AS n FROM tr GROUP BY 2 "
    "UNION ALL SELECT 'after', ckd_diagnosis, CAST(count(*) AS BIGINT) FROM "
    "(SELECT ckd_diagnosis FROM tr UNION ALL SELECT ckd_diagnosis FROM synth) u GROUP BY 2",
    "enc_split", extra=_SMOTE_CTES))
def f12_class_balance(spark, sf_dir):
    train = _train(spark, sf_dir)
    syn = SM.smote(train, CONT, BINARY, "ckd_diagnosis", "patient_id")
    after = SM.oversample(train.drop("patient_id"), syn, "ckd_diagnosis")
    return SM.class_balance(train, after, "ckd_diagnosis")


# M8 with oversampling inside the fold -----------------------------------------
def folded_train(spark, sf_dir):
    """Labelled training rows with their fold; ranked once, as classes, vectors and rows are read from them."""
    return cut_lineage(SP.kfold_assign(_train(spark, sf_dir).where(F.col("ckd_diagnosis").isNotNull())))


def _draw_sql(what: str) -> str:
    return ("('0x' || substr(md5('42|smote|' || CAST(p.for_fold AS VARCHAR) || '|' || CAST(s.i AS VARCHAR) || "
            f"'|{what}'), 1, 15))::BIGINT")


_IN_FOLD_CTES = dict(_SMOTE_CTES, **{
    "fo": "SELECT *, CAST((row_number() OVER (PARTITION BY ckd_diagnosis ORDER BY kh, patient_id) - 1) % 5 AS INTEGER) AS fold "
          "FROM (SELECT *, ('0x' || substr(md5('42|kfold|' || CAST(patient_id AS VARCHAR)), 1, 15))::BIGINT AS kh FROM tr "
          "WHERE ckd_diagnosis IS NOT NULL) t",
    "ff": "SELECT CAST(range AS INTEGER) AS for_fold FROM range(5)",
    "fparams": "SELECT f.for_fold, count(*) FILTER (WHERE ckd_diagnosis = minority) AS m, "
               "least(5, count(*) FILTER (WHERE ckd_diagnosis = minority) - 1) AS k, "
               "CAST(floor(0.6e0 * count(*) FILTER (WHERE ckd_diagnosis <> minority)) AS BIGINT) - "
               "count(*) FILTER (WHERE ckd_diagnosis = minority) AS n_syn "
               "FROM fo, ff f, params WHERE fo.fold <> f.for_fold GROUP BY f.for_fold",
    "fmino": "SELECT f.for_fold, fo.*, v.gid FROM ff f JOIN fo ON fo.fold <> f.for_fold JOIN vec v ON "
             + " AND ".join(f"fo.{c} = v.{c}" for c in FEATS) + " , params WHERE fo.ckd_diagnosis = params.minority",
    "fvec": "SELECT for_fold, gid, count(*) AS copies FROM fmino GROUP BY 1, 2",
    "fpairs": f"SELECT x.for_fold, x.gid, y.gid AS nb_gid, y.copies, {rhu(_D2, 9)} AS d2 FROM fvec x JOIN fvec y "
              "ON x.for_fold = y.for_fold AND x.gid <> y.gid JOIN vec a ON a.gid = x.gid JOIN vec b ON b.gid = y.gid "
              "UNION ALL SELECT for_fold, gid, gid, copies - 1, 0e0 FROM fvec WHERE copies > 1",
    "frk": "SELECT *, sum(copies) OVER (PARTITION BY for_fold, gid ORDER BY d2, nb_gid ROWS UNBOUNDED PRECEDING) - copies AS before "
           "FROM fpairs",
    "fknn": "SELECT r.for_fold, gid, CAST(unnest(range(CAST(before AS BIGINT), CAST(least(before + copies, p.k) AS BIGINT))) AS INTEGER) "
            "AS j, nb_gid, d2 FROM frk r JOIN fparams p ON p.for_fold = r.for_fold WHERE before < p.k",
    "fidx": "SELECT *, row_number() OVER (PARTITION BY for_fold ORDER BY sh, patient_id) - 1 AS idx FROM (SELECT *, "
            "('0x' || substr(md5('42|smote|' || CAST(patient_id AS VARCHAR)), 1, 15))::BIGINT AS sh FROM fmino) t",
    "fsyn": f"SELECT p.for_fold, s.i AS synthetic_id, {_draw_sql('base')} % p.m AS idx, CAST({_draw_sql('nn')} % p.k AS INTEGER) AS j, "
            f"CAST({_draw_sql('gap')} AS DOUBLE) / 1152921504606846976e0 AS gap "
            "FROM fparams p, (SELECT range AS i FROM range((SELECT max(n_syn) FROM fparams))) s WHERE s.i < p.n_syn",
})


@register("m8_knn_outside_folds", with_ctes("SELECT * FROM fknn", "enc_split", extra=_IN_FOLD_CTES))
def m8_knn_outside_folds(spark, sf_dir):
    """The five nearest minority neighbours outside each fold, all folds from one search."""
    train = folded_train(spark, sf_dir)
    counts = SM.class_counts(train, "ckd_diagnosis")
    mino = train.where(F.col("ckd_diagnosis") == min(counts, key=lambda c: (counts[c], c)))
    outside = [f"out_{f}" for f in range(5)]
    vectors = mino.groupBy(*FEATS).agg(F.min("patient_id").alias("gid"), *[
        F.count_if(F.col("fold") != f).alias(c) for f, c in enumerate(outside)])
    return KN.knn_outside_folds(vectors, CONT, BINARY, 5, outside)


@register("m8_smote_in_folds", with_ctes(
    "SELECT s.for_fold, s.synthetic_id, i.gid AS base_gid, n.nb_gid, "
    + ", ".join(f"{rhu(f'i.{c} + s.gap * (v.{c} - i.{c})', 6)} AS {c}" for c in FEATS) + ", i.ckd_diagnosis FROM fsyn s "
    "JOIN fidx i ON i.for_fold = s.for_fold AND i.idx = s.idx JOIN fknn n ON n.for_fold = s.for_fold AND n.gid = i.gid AND n.j = s.j "
    "JOIN vec v ON v.gid = n.nb_gid", "enc_split", extra=_IN_FOLD_CTES))
def m8_smote_in_folds(spark, sf_dir):
    """Synthetic rows for each fold, made of rows outside it."""
    syn = SM.smote_in_folds(folded_train(spark, sf_dir), CONT, BINARY, "ckd_diagnosis", "patient_id")
    return syn.select("for_fold", "synthetic_id", "base_gid", "nb_gid", *[X.round_half_up(c, 6).alias(c) for c in FEATS], "ckd_diagnosis")
