"""Registered queries: evaluation, images, fitting and scoring."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import vectors
from millrace.operators import boost, encode, evaluate, image, learn, pixels, sample
from millrace.operators.lookup import one_row
from millrace.plans.queries_ordered import SOFTMAX_SQL
from millrace.plans.queries_prep import CLASS_MEAN_LOGITS, SQL_PRED, WEIGHTS, big, r, sql_features, sql_uniform
from millrace.plans.registry import query
from millrace.sources.tables import regression_data


def predicted(t):
    return t.v_scored.select("row_id", big("y").alias("y"), big(vectors.argmax("logits")).alias("pred"))


# --- labels --------------------------------------------------------------------------


@query("i1_accuracy", SQL_PRED + " select round(avg(cast(y = pred as int)), 8) as accuracy from p")
def i1(t):
    return evaluate.accuracy(predicted(t), "y", "pred").select(r("accuracy", 8).alias("accuracy"))


SQL_GRID = SQL_PRED + """, k as (select distinct unnest([y, pred]) as c from p),
    g as (select a.c as label, b.c as pred, (select count(*) from p where p.y = a.c and p.pred = b.c) as n from k a, k b)"""


@query("i2_confusion", SQL_GRID + " select label, pred, n from g")
def i2(t):
    return evaluate.confusion(predicted(t), "y", "pred")


SQL_REPORT = SQL_GRID + """, s as (select k.c, (select sum(n) from g where label = k.c) as support, (select sum(n) from g where pred = k.c) as predicted,
      (select sum(n) from g where label = k.c and pred = k.c) as tp from k),
    m as (select c, support, case when predicted = 0 then 0.0::double else tp / predicted end as precision, case when support = 0 then 0.0::double else tp / support end as recall,
      case when support + predicted = 0 then 0.0::double else 2 * tp / (support + predicted) end as f1 from s),
    a as (select cast(c as varchar) as name, precision, recall, f1, support from m
      union all select 'accuracy', sum(recall * support) / sum(support), sum(recall * support) / sum(support), sum(recall * support) / sum(support), sum(support) from m
      union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from m
      union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) from m)"""


@query(
    "i3_report",
    SQL_REPORT + " select name, round(precision, 8) as precision, round(recall, 8) as recall, round(f1, 8) as f1, cast(support as bigint) as support from a",
)
def i3(t):
    out = evaluate.report(evaluate.observed(predicted(t), "y", "pred"))
    return out.select("name", *[r(c, 8).alias(c) for c in ("precision", "recall", "f1")], "support")


# --- curves --------------------------------------------------------------------------

SQL_BINARY = """with c as (select score, sum(y) as pos, sum(1 - y) as neg from v_binary group by score),
    k as (select score as threshold, pos, neg, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as np, sum(neg) over () as nn from c),
    roc as (select threshold, fp / nn as fpr, tp / np as tpr from k union all select 'infinity'::double, 0.0, 0.0)"""


def binary_counts(t):
    return evaluate.score_counts(t.v_binary, "y", "score")


@query("i4_roc_curve", SQL_BINARY + " select threshold, round(fpr, 8) as fpr, round(tpr, 8) as tpr from roc")
def i4(t):
    return evaluate.roc_curve(binary_counts(t)).select("threshold", r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


@query("i5_youden_threshold", SQL_BINARY + " select threshold, round(fpr, 8) as fpr, round(tpr, 8) as tpr from roc order by tpr - fpr desc, threshold desc limit 1")
def i5(t):
    best = evaluate.best_threshold(evaluate.roc_curve(binary_counts(t)))
    return best.select("threshold", r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


@query(
    "i5_relabel",
    SQL_BINARY + """, b as (select threshold from roc order by tpr - fpr desc, threshold desc limit 1)
    select row_id, cast(y as bigint) as y, cast(score > threshold as bigint) as pred from v_binary, b""",
)
def i5_relabel(t):
    best = evaluate.best_threshold(evaluate.roc_curve(binary_counts(t)))
    rows = evaluate.relabel(t.v_binary, "score", one_row(best)["threshold"])
    return rows.select("row_id", big("y").alias("y"), big("pred").alias("pred"))


@query("i6_auc", SQL_BINARY + " select round(sum(neg * (tp - pos + pos / 2)) / (max(np) * max(nn)), 8) as auc from k")
def i6(t):
    return evaluate.areas(binary_counts(t)).select(r("auc", 8).alias("auc"))


# Scores are rounded to 10 digits on both sides so that ties are the same ties.
SQL_LONG = SOFTMAX_SQL + """, l as (select i - 1 as class, cast(y = i - 1 as int) as y, round(probs[i], 10) as score from p, range(1, 11) t(i)),
    c as (select class, score, sum(y) as pos, sum(1 - y) as neg from l group by all),
    k as (select *, sum(pos) over w as tp, sum(neg) over w as fp, sum(pos) over (partition by class) as np, sum(neg) over (partition by class) as nn
      from c window w as (partition by class order by score desc)),
    cm as (select score, sum(pos) as pos, sum(neg) as neg from c group by score),
    km as (select *, sum(pos) over (order by score desc) as tp, sum(neg) over (order by score desc) as fp, sum(pos) over () as np, sum(neg) over () as nn from cm)"""
AUC = "sum(neg * (tp - pos + pos / 2)) / (max(np) * max(nn))"
AP = "sum(pos / np * tp / (tp + fp))"


def decisions(t, rows=None):
    probs = F.transform(vectors.softmax("logits"), lambda p: F.round(p, 10))
    return evaluate.one_vs_rest((t.v_scored if rows is None else rows).select("y", probs.alias("probs")), "y", "probs")


@query(
    "i6_auc_bounds",
    SQL_LONG + f""", b as (select class, floor(score * 100) as bin, sum(y) as pos, sum(1 - y) as neg from l group by all),
    w as (select *, sum(pos) over (partition by class order by bin desc) as tp, sum(pos) over (partition by class) as np, sum(neg) over (partition by class) as nn from b),
    ex as (select class, {AUC} as auc from k group by class),
    bounds as (select class, sum(neg * (tp - pos)) / (max(np) * max(nn)) as auc_low, sum(neg * tp) / (max(np) * max(nn)) as auc_high from w group by class)
    select class, round(auc_low, 8) as auc_low, round(auc_high, 8) as auc_high, round(auc, 8) as auc, auc between auc_low - 1e-12 and auc_high + 1e-12 as inside from bounds join ex using (class)""",
)
def i6_bounds(t):
    """Area per class from counts in a hundred bins, gathered from two parts of the table, and the exact area between the bounds."""
    parts = [evaluate.score_counts(decisions(t, t.v_scored.where(F.col("row_id") % 2 == k)), "y", "score", ["class"], bins=100) for k in (0, 1)]
    bounds = evaluate.area_bounds(evaluate.merged_counts(*parts, key=["class"]), ["class"])
    exact = evaluate.areas(evaluate.score_counts(decisions(t), "y", "score", ["class"]), ["class"]).drop("ap")
    inside = F.col("auc").between(F.col("auc_low") - 1e-12, F.col("auc_high") + 1e-12)
    return bounds.join(exact, "class").select("class", *[r(c, 8).alias(c) for c in ("auc_low", "auc_high", "auc")], inside.alias("inside"))


@query("i7_auc_macro", SQL_LONG + f", a as (select class, {AUC} as auc from k group by class) select round(avg(auc), 8) as auc from a")
def i7(t):
    return evaluate.areas(evaluate.score_counts(decisions(t), "y", "score", ["class"]), ["class"]).agg(r(F.avg("auc"), 8).alias("auc"))


@query("i8_auc_micro", SQL_LONG + f" select round({AUC}, 8) as auc from km")
def i8(t):
    return evaluate.areas(evaluate.score_counts(decisions(t), "y", "score")).select(r("auc", 8).alias("auc"))


@query(
    "i9_average_precision",
    SQL_LONG + f""", a as (select class, {AP} as ap from k group by class)
    select 'macro' as kind, round(avg(ap), 8) as ap from a union all select 'micro', round({AP}, 8) from km""",
)
def i9(t):
    counts = evaluate.score_counts(decisions(t), "y", "score", ["class"])
    macro = evaluate.areas(counts, ["class"]).agg(r(F.avg("ap"), 8).alias("ap")).select(F.lit("macro").alias("kind"), "ap")
    return macro.unionByName(evaluate.areas(evaluate.pooled(counts)).select(F.lit("micro").alias("kind"), r("ap", 8).alias("ap")))


@query(
    "i9_pr_curve",
    SQL_BINARY + """ select threshold, round(tp / (tp + fp), 8) as precision, round(tp / np, 8) as recall from k union all select null, 1.0, 0.0""",
)
def i9_curve(t):
    return evaluate.pr_curve(binary_counts(t)).select("threshold", r("precision", 8).alias("precision"), r("recall", 8).alias("recall"))


@query(
    "i10_class_roc",
    SQL_LONG + """ select class, score as threshold, round(fp / nn, 8) as fpr, round(tp / np, 8) as tpr from k
    union all select distinct class, 'infinity'::double, 0.0, 0.0 from k""",
)
def i10(t):
    curve = evaluate.roc_curve(evaluate.score_counts(decisions(t), "y", "score", ["class"]), ["class"])
    return curve.select("class", "threshold", r("fpr", 8).alias("fpr"), r("tpr", 8).alias("tpr"))


@query(
    "i10_class_pr",
    SQL_LONG + """ select class, score as threshold, round(tp / (tp + fp), 8) as precision, round(tp / np, 8) as recall from k
    union all select distinct class, null, 1.0, 0.0 from k""",
)
def i10_pr(t):
    curve = evaluate.pr_curve(evaluate.score_counts(decisions(t), "y", "score", ["class"]), ["class"])
    return curve.select("class", "threshold", r("precision", 8).alias("precision"), r("recall", 8).alias("recall"))


# --- regression metrics and losses ---------------------------------------------------


@query("i11_errors", "select round(avg((y - pred) ** 2) / 1e6, 4) as mse_millions, round(sqrt(avg((y - pred) ** 2)), 4) as rmse, round(avg(abs(y - pred)), 4) as mae from v_regress")
def i11(t):
    m = evaluate.regression_metrics(t.v_regress, "y", "pred")
    return m.select(r(F.col("mse") / F.lit(1e6), 4).alias("mse_millions"), r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"))


@query("i12_r2", "with m as (select avg(y) as mean from v_regress) select round(1 - sum((y - pred) ** 2) / sum((y - mean) ** 2), 6) as r2 from v_regress, m")
def i12(t):
    return evaluate.regression_metrics(t.v_regress, "y", "pred").select(r("r2").alias("r2"))


@query("i13_pearson", "select round(corr(y, pred), 8) as pearson from v_regress")
def i13(t):
    return evaluate.regression_metrics(t.v_regress, "y", "pred").select(r("pearson", 8).alias("pearson"))


SQL_CE = """with l as (select y, logits, list_max(logits) as top from v_scored),
    ce as (select y, top + ln(list_sum(list_transform(logits, lambda x: exp(x - top)))) - logits[y + 1] as ce from l)"""


@query(
    "i14_cross_entropy",
    SQL_CE + """, c as (select y, count(*) as n from ce group by y), w as (select y, (1 / n) / sum(1 / n) over () as weight from c)
    select round(avg(ce), 8) as ce, round(sum(ce * weight) / sum(weight), 8) as weighted_ce from ce join w using (y)""",
)
def i14(t):
    out = evaluate.weighted_cross_entropy(t.v_scored, "logits", "y", encode.class_weights(t.v_scored, "y"))
    return out.select(r("ce", 8).alias("ce"), r("weighted_ce", 8).alias("weighted_ce"))


@query("i15_focal_loss", SQL_CE + " select round(avg(0.8 * pow(1 - exp(-ce), 1.5) * ce), 8) as focal from ce")
def i15(t):
    ce = evaluate.cross_entropy("logits", "y")
    return t.v_scored.agg(r(F.avg(evaluate.focal(ce, 0.8, 1.5)), 8).alias("focal"))


SQL_SOFT = SOFTMAX_SQL + """, l as (select i - 1 as class, cast(y = i - 1 as int) as hit, probs[i] as prob from p, range(1, 11) t(i)),
    s as (select class, sum(prob * hit) as tp, sum(prob * (1 - hit)) as fp from l group by class)"""


@query("i16_soft_precision", SQL_SOFT + " select round(avg(1 - tp / (tp + fp + 1e-7)), 8) as loss from s")
def i16(t):
    return evaluate.combined_loss(t.v_scored, "logits", "y").select(r("soft_precision", 8).alias("loss"))


@query(
    "i17_combined_loss",
    SQL_SOFT + ", " + SQL_CE[len("with "):].replace("l as (", "lg as (").replace("from l)", "from lg)") + """
    select round(0.6 * (select avg(ce) from ce) + 0.2 * (select avg(1 - tp / (tp + fp + 1e-7)) from s) + 0.2 * (select avg(0.8 * pow(1 - exp(-ce), 1.5) * ce) from ce), 8) as total""",
)
def i17(t):
    return evaluate.combined_loss(t.v_scored, "logits", "y").select(r("total", 8).alias("total"))


@query(
    "i18_model_table",
    """with m as (select case when l_linenumber % 2 = 0 then 'test' else 'train' end as split, y, 'price' as model, pred as p from v_regress
      union all select case when l_linenumber % 2 = 0 then 'test' else 'train' end, y, 'discounted', pred * (1 - l_discount) from v_regress)
    select model, split, count(*) as n, round(sqrt(avg((y - p) ** 2)), 4) as rmse, round(avg(abs(y - p)), 4) as mae,
      round(1 - sum((y - p) ** 2) / (count(*) * var_pop(y)), 6) as r2, round(corr(y, p), 6) as pearson from m group by all""",
)
def i18(t):
    rows = t.v_regress.withColumns(
        {"split": F.when(F.col("l_linenumber") % 2 == 0, "test").otherwise("train"), "discounted": F.col("pred") * (1 - F.col("l_discount"))}
    )
    out = learn.model_table(rows, "y", {"price": "pred", "discounted": "discounted"}, "split")
    return out.select("model", "split", "n", r("rmse", 4).alias("rmse"), r("mae", 4).alias("mae"), r("r2").alias("r2"), r("pearson").alias("pearson"))


# --- images --------------------------------------------------------------------------


def long_pixels(df, column, digits: int = 6):
    rows = df.select("row_id", F.posexplode(column).alias("pos", "v"))
    return rows.select("row_id", big("pos").alias("pos"), r("v", digits).alias("v"))


def shots(t, *steps):
    return pixels.run(t.v_image, "px", "row_id", (8, 8, 1), steps)


@query("v1_normalise", "select row_id, i - 1 as pos, round((px[i] / 255 - 0.485) / 0.229, 6) + 0.0 as v from v_image, range(1, 65) t(i)")
def v1(t):
    return long_pixels(t.v_image, image.normalise("px", [0.485], [0.229]))


@query("v2_unnormalise", "select row_id, i - 1 as pos, round((px[i] / 255 - 0.5) / 0.5 * 0.5 + 0.5, 6) as v from v_image, range(1, 65) t(i)")
def v2(t):
    return long_pixels(t.v_image, image.unnormalise(image.normalise("px", [0.5], [0.5])))


def triples(t):
    """The 64 values and the first two again: 22 pixels of three values."""
    return t.v_image.select("row_id", F.concat("px", F.slice("px", 1, 2)).alias("px"))


@query(
    "v3_grayscale",
    """select row_id, i as pos, floor((px[(3 * i + 2) % 64 + 1] * 19595 + px[(3 * i + 1) % 64 + 1] * 38470 + px[3 * i % 64 + 1] * 7471 + 32768) / 65536) as v from v_image, range(0, 22) t(i)""",
)
def v3(t):
    return long_pixels(triples(t), image.grayscale("px"))


@query("v4_resize_nearest", "select row_id, i as pos, px[(2 * (i // 4) + 1) * 8 + 2 * (i % 4) + 1 + 1] as v from v_image, range(0, 16) t(i)")
def v4(t):
    return long_pixels(t.v_image, image.resize_nearest("px", 8, 8, 4, 4))


@query(
    "v4_resize_bilinear",
    """with w as (select o, i, greatest(0.0, 1 - abs(i + 0.5 - (o + 0.5) * 2) / 2) as w from range(0, 4) a(o), range(0, 8) b(i)),
    u as (select o, i, w / sum(w) over (partition by o) as w from w)
    select row_id, y.o * 4 + x.o as pos, round(sum(y.w * x.w * px[y.i * 8 + x.i + 1]), 6) as v from v_image, u y, u x where y.w > 0 and x.w > 0 group by row_id, y.o, x.o""",
)
def v4_bilinear(t):
    return long_pixels(shots(t, pixels.resize(4, 4)), "px")


@query("v5_centre_crop", "select row_id, i as pos, px[(i // 4 + 2) * 8 + i % 4 + 2 + 1] as v from v_image, range(0, 16) t(i)")
def v5(t):
    return long_pixels(t.v_image, image.centre_crop("px", 8, 8, 4, 4))


def sql_box(seed: int, scale: tuple, ratio: tuple, tall: str, wide: str, fits: str) -> str:
    """DuckDB form of the first fitting hashed box of an 8 x 8 image."""
    u = {n: sql_uniform(f"'{seed}:' || row_id || ':' || t || ':{n}'") for n in ("area", "aspect", "top", "left")}
    return f"""d as (select row_id, t, 64 * ({scale[0]} + {u['area']} * ({scale[1]} - {scale[0]})) as area,
        exp(ln({ratio[0]}::double) + {u['aspect']} * (ln({ratio[1]}::double) - ln({ratio[0]}::double))) as aspect, {u['top']} as ut, {u['left']} as ul from v_image, range(0, 10) r(t)),
      z as (select row_id, t, round_even({tall}, 0)::bigint as bh, round_even({wide}, 0)::bigint as bw, ut, ul from d),
      box as (select row_id, floor(ut * (8 - bh + 1))::bigint as top, floor(ul * (8 - bw + 1))::bigint as lft, bh, bw from z where {fits}
        qualify row_number() over (partition by row_id order by t) = 1)"""


SQL_CROP = sql_box(0, (0.6, 1.0), (0.75, 4 / 3), "sqrt(area / aspect)", "sqrt(area * aspect)", "bh between 1 and 8 and bw between 1 and 8")


@query(
    "v5_random_resized_crop",
    f"""with {SQL_CROP},
    b as (select row_id, px, coalesce(top, 0) as top, coalesce(lft, 0) as lft, coalesce(bh, 8) as bh, coalesce(bw, 8) as bw from v_image left join box using (row_id))
    select row_id, i as pos, px[(top + ((2 * (i // 4) + 1) * bh) // 8) * 8 + lft + ((2 * (i % 4) + 1) * bw) // 8 + 1] as v from b, range(0, 16) t(i)""",
)
def v5_random(t):
    return long_pixels(t.v_image, image.random_resized_crop("px", "row_id", 8, 8, 4, 4, scale=(0.6, 1.0)))


@query(
    "v6_random_flip",
    f"""select row_id, i as pos, case when {sql_uniform("'0:' || row_id || ':flip'")} < 0.5 then px[i - i % 8 + 7 - i % 8 + 1] else px[i + 1] end as v from v_image, range(0, 64) t(i)""",
)
def v6(t):
    return long_pixels(t.v_image, image.random_flip("px", "row_id", 8))


@query(
    "v7_brightness_contrast",
    f"""with f as (select row_id, px, 0.8 + {sql_uniform("'0:' || row_id || ':brightness'")} * 0.4 as b, 0.8 + {sql_uniform("'0:' || row_id || ':contrast'")} * 0.4 as c from v_image),
    g as (select row_id, c, list_transform(px, lambda x: least(255.0, greatest(0.0, x * b))) as px from f),
    m as (select row_id, c, px, floor(list_sum(px) / 64 + 0.5) as mean from g)
    select row_id, i as pos, round(least(255.0, greatest(0.0, mean + c * (px[i + 1] - mean))), 6) + 0.0 as v from m, range(0, 64) t(i)""",
)
def v7(t):
    steps = [
        lambda p: image.brightness(p, image.jitter_factor(0, "row_id", "brightness", 0.2)),
        lambda p: image.contrast(p, image.jitter_factor(0, "row_id", "contrast", 0.2)),
    ]
    return long_pixels(t.v_image, image.chain("px", steps))


SQL_TURNED = f"""with p as (select row_id, i, px[3 * i % 64 + 1] as b0, px[(3 * i + 1) % 64 + 1] as g0, px[(3 * i + 2) % 64 + 1] as r0,
      0.8 + {sql_uniform("'0:' || row_id || ':saturation'")} * 0.4 as f, (2 * {sql_uniform("'0:' || row_id || ':hue'")} - 1) * 0.1 as shift from v_image, range(0, 22) t(i)),
    y as (select *, floor((r0 * 19595 + g0 * 38470 + b0 * 7471 + 32768) / 65536) as y from p),
    c as (select row_id, i, shift, least(255.0, greatest(0.0, y + f * (r0 - y))) as r, least(255.0, greatest(0.0, y + f * (g0 - y))) as g, least(255.0, greatest(0.0, y + f * (b0 - y))) as b from y),
    m as (select *, greatest(r, g, b) as top, greatest(r, g, b) - least(r, g, b) as span from c),
    x as (select *, case when span = 0 then 0.0 when top = r then (((g - b) / span) % 6 + 6) % 6 when top = g then (b - r) / span + 2 else (r - g) / span + 4 end as sixth from m),
    h as (select *, ((sixth + 6 * shift) % 6 + 6) % 6 as h from x)
    select row_id, 3 * i + k.c as pos, round(top - span * greatest(0.0, least(1.0, (n + h) % 6, 4 - (n + h) % 6)), 6) + 0.0 as v from h, (values (0, 1), (1, 3), (2, 5)) k(c, n)"""


@query("v7_saturation_hue", SQL_TURNED)
def v7_colour(t):
    return long_pixels(pixels.run(triples(t), "px", "row_id", (1, 22, 3), [pixels.saturation(0.2), pixels.hue(0.1)]), "px")


@query("v8_quarter_turn", "select row_id, i as pos, px[(7 - i % 8) * 8 + i // 8 + 1] as v from v_image, range(0, 64) t(i)")
def v8(t):
    return long_pixels(shots(t, pixels.affine(90.0)), "px")


SQL_AFFINE = f"""with u as (select row_id, px, radians((2 * {sql_uniform("'0:' || row_id || ':turn'")} - 1) * 10) as a, radians((2 * {sql_uniform("'0:' || row_id || ':shear'")} - 1) * 10) as s,
      round_even((2 * {sql_uniform("'0:' || row_id || ':right'")} - 1) * 0.8, 0) as right_, round_even((2 * {sql_uniform("'0:' || row_id || ':down'")} - 1) * 0.8, 0) as down_,
      0.9 + {sql_uniform("'0:' || row_id || ':zoom'")} * 0.2 as z from v_image),
    b as (select *, (cos(a) - sin(a) * tan(s)) / z as xx, (cos(a) * tan(s) + sin(a)) / z as xy, -sin(a) / z as yx, cos(a) / z as yy from u),
    q as (select row_id, px, i, i % 8 - 3.5::double - right_ as dx, i // 8 - 3.5::double - down_ as dy, xx, xy, yx, yy from b, range(0, 64) t(i)),
    f as (select row_id, px, i, round_even(xx * dx + xy * dy + 3.5 + 1e-9, 0)::bigint as x, round_even(yx * dx + yy * dy + 3.5 + 1e-9, 0)::bigint as y from q)
    select row_id, i as pos, case when x between 0 and 7 and y between 0 and 7 then px[y * 8 + x + 1] else 0.0 end as v from f"""


@query("v8_random_affine", SQL_AFFINE)
def v8_random(t):
    return long_pixels(shots(t, pixels.random_affine(10, (0.1, 0.1), (0.9, 1.1), 10)), "px")


K = image.gaussian_kernel(3, 0.3)


@query(
    "v9_blur",
    "with e as (select row_id, i, px, i // 8 as y, i % 8 as x from v_image, range(0, 64) t(i)) select row_id, i as pos, round("
    + " + ".join(
        f"{K[dy + 1] * K[dx + 1]!r}::double * px[(7 - abs(7 - abs(y + {dy}))) * 8 + (7 - abs(7 - abs(x + {dx}))) + 1]" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    )
    + ", 6) as v from e",
)
def v9(t):
    return long_pixels(shots(t, pixels.blur()), "px")


SQL_ERASE = sql_box(0, (0.02, 0.33), (0.3, 3.3), "sqrt(area * aspect)", "sqrt(area / aspect)", "bh between 1 and 7 and bw between 1 and 7")


@query(
    "v10_random_erase",
    f"""with {SQL_ERASE}, b as (select v_image.row_id, px, top, lft, bh, bw, {sql_uniform("'0:' || v_image.row_id || ':erase'")} < 0.5 as hit from v_image left join box using (row_id))
    select row_id, i as pos, case when hit and i // 8 >= top and i // 8 < top + bh and i % 8 >= lft and i % 8 < lft + bw then 0.0 else px[i + 1] end as v from b, range(0, 64) t(i)""",
)
def v10(t):
    return long_pixels(t.v_image, image.random_erase("px", "row_id", 8, 8, p=0.5, scale=(0.02, 0.33)))


SQL_CHAIN = f"""with s as (select row_id, px, row_id % 2 = 0 as train, {sql_uniform("'0:' || row_id || ':flip'")} < 0.5 as flip from v_image),
    f as (select row_id, i as pos, px[(2 * (i // 4) + 1) * 8 + 2 * (case when train and flip then 3 - i % 4 else i % 4 end) + 1 + 1] as v from s, range(0, 16) t(i))
    select row_id, pos, round((v / 255 - 0.5) / 0.5, 6) + 0.0 as v from f"""


@query("v11_transform_chain", SQL_CHAIN)
def v11(t):
    rows = t.v_image.withColumn("split", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test"))
    smaller = lambda p: image.resize_nearest(p, 8, 8, 4, 4)
    scaled = lambda p: image.normalise(p, [0.5], [0.5])
    chains = {"train": [smaller, lambda p: image.random_flip(p, "row_id", 4), scaled], "test": [smaller, scaled]}
    return long_pixels(rows, image.by_split("px", "split", chains))


@query("v11_batch_chain", SQL_CHAIN)
def v11_batch(t):
    rows = t.v_image.withColumn("split", F.when(F.col("row_id") % 2 == 0, "train").otherwise("test"))
    scaled = pixels.normalise([0.5], [0.5])
    chains = {"train": [pixels.resize_nearest(4, 4), pixels.random_flip(), scaled], "test": [pixels.resize_nearest(4, 4), scaled]}
    return long_pixels(pixels.run(rows, "px", "row_id", (8, 8, 1), chains, split="split"), "px")


def sql_train_chain() -> str:
    """DuckDB form of the whole train chain, a list of 64 values after every step."""
    u = {n: sql_uniform(f"'0:' || row_id || ':{n}'") for n in ("brightness", "contrast", "turn", "shear", "right", "down", "zoom", "flip")}
    blurred = " + ".join(
        f"{K[dy + 1] * K[dx + 1]!r}::double * px[(7 - abs(7 - abs(i // 8 + {dy}))) * 8 + (7 - abs(7 - abs(i % 8 + {dx}))) + 1]" for dy in (-1, 0, 1) for dx in (-1, 0, 1)
    )
    return f"""with c as (select row_id, list_concat(list_concat(px, list_reverse(px)), px) as px from v_image),
    g as (select row_id, list_transform(range(0, 64), lambda i: floor((px[3 * i + 3] * 19595 + px[3 * i + 2] * 38470 + px[3 * i + 1] * 7471 + 32768) / 65536)) as px, 0.8 + {u["brightness"]} * 0.4 as f from c),
    b as (select row_id, list_transform(px, lambda x: least(255.0, greatest(0.0, x * f))) as px from g),
    m as (select row_id, px, floor(list_sum(px) / 64 + 0.5) as mean, 0.8 + {u["contrast"]} * 0.4 as f from b),
    k as (select row_id, list_transform(px, lambda x: least(255.0, greatest(0.0, mean + f * (x - mean)))) as px from m),
    s as (select row_id, list_transform(range(0, 64), lambda i: {blurred}) as px from k),
    a as (select row_id, px, radians((2 * {u["turn"]} - 1) * 10) as a, radians((2 * {u["shear"]} - 1) * 10) as s, 0.9 + {u["zoom"]} * 0.2 as z,
      round_even((2 * {u["right"]} - 1) * 0.8, 0) as right_, round_even((2 * {u["down"]} - 1) * 0.8, 0) as down_, {u["flip"]} < 0.5 as flip from s),
    t as (select *, (cos(a) - sin(a) * tan(s)) / z as xx, (cos(a) * tan(s) + sin(a)) / z as xy, -sin(a) / z as yx, cos(a) / z as yy from a),
    o as (select *, i - 3.5::double as cy from t, range(0, 8) r(i)),
    q as (select *, case when flip then 7 - j else j end - 3.5::double - right_ as dx, cy - down_ as dy from o, range(0, 8) r(j)),
    f as (select row_id, px, i * 8 + j as pos, round_even(xx * dx + xy * dy + 3.5 + 1e-9, 0)::bigint as x, round_even(yx * dx + yy * dy + 3.5 + 1e-9, 0)::bigint as y from q)
    select row_id, pos, round((case when x between 0 and 7 and y between 0 and 7 then px[y * 8 + x + 1] else 0.0 end / 255 - 0.485) / 0.229, 6) + 0.0 as v from f"""


@query("v11_train_chain", sql_train_chain())
def v11_train(t):
    """Grayscale, colour jitter (saturation and hue leave gray pixels alone), blur, random affine map, flip and normalising of colour images in one pass."""
    colour = t.v_image.select("row_id", F.concat("px", F.reverse("px"), "px").alias("px"))
    steps = [pixels.grayscale(), *pixels.colour_jitter(0.2, 0.2, 0.2, 0.2), pixels.blur(), pixels.random_affine(10, (0.1, 0.1), (0.9, 1.1), 10), pixels.random_flip(), pixels.normalise([0.485], [0.229])]
    return long_pixels(pixels.run(colour, "px", "row_id", (8, 8, 3), steps), "px")


@query("v12_vector_min_max", "select row_id, i as pos, round((px[i + 1] - list_min(px)) / (list_max(px) - list_min(px)), 6) as v from v_image, range(0, 64) t(i)")
def v12(t):
    return long_pixels(t.v_image, vectors.min_max("px"))


# --- fit and score -------------------------------------------------------------------


@query("m1_boosted_trees", "select unnest(range(1, 6)) as round, (select count(*) from v_regress) as n, true as not_worse")
def m1(t):
    """Error on the fitted rows after each round: no round makes it larger, the first none than the mean does."""
    rows = t.v_regress.select("l_quantity", "l_discount", "p_size", "p_retailprice", "y")
    model = learn.fit_boosted_trees(rows, ["l_quantity", "l_discount", "p_size", "p_retailprice"], "y", rounds=5, depth=4)
    assembler, trees = model.stages
    n, spread = rows.agg(F.count(F.lit(1)), F.var_pop("y")).first()
    errors = [spread, *trees.evaluateEachIteration(assembler.transform(rows), "squared")]
    out = [(i + 1, n, b <= a * (1 + 1e-9)) for i, (a, b) in enumerate(zip(errors, errors[1:], strict=False))]
    return t.spark.createDataFrame(out, "round bigint, n bigint, not_worse boolean")


BOOST_FEATURES = ["l_quantity", "l_discount", "p_size", "p_retailprice"]


def sql_boosting(rounds: int, depth: int, bins: int, rate: float, penalty: float) -> str:
    """Rows, per node sums, best splits and new nodes of every level, spelled out."""
    k = len(BOOST_FEATURES)
    out = f"""with d as (select [{", ".join("nullif(l_discount, 0)" if c == "l_discount" else c for c in BOOST_FEATURES)}]::double[] as x, y,
      case when ('0x' || substr(md5('7:' || l_orderkey), 1, 8))::bigint < 3435973837 then 'train' else 'test' end as split from v_regress),
    u as (select unnest(range(1, {k + 1})) as j, unnest(x) as v from d where split = 'train'),
    ed as (select j, list(distinct e order by e) as e from (select j, round(unnest(quantile_cont(v, [{", ".join(repr(i / bins) for i in range(1, bins))}])), 9) as e from u group by j) group by j),
    es as materialized (select list(e order by j) as e from ed),
    whole as materialized (select avg(y) as base, var_pop(y) * count(*) as scale from d where split = 'train'),
    r1_0 as materialized (select list_transform(range(1, {k + 1}), lambda j: case when x[j] is null then -1 else len(list_filter(e[j], lambda a: a < x[j])) end) as bins, y, split, base as margin, 1 as node, 0.0::double as w from d, es, whole),
    m0 as (select 0 as round, split, y, margin from r1_0)"""
    for t in range(1, rounds + 1):
        for level in range(depth):
            at = f"{t}_{level}"
            sums = ", ".join(f"sum({c}) over a as {c}_all, coalesce(sum({c}) filter (where b < 0) over a, 0) as {c}_missing, sum({c}) filter (where b >= 0) over (a order by b) as {c}_upto" for c in "gh")
            out += f""",
    h{at} as (select node, j, b, sum(margin - y) as g, count(*)::double as h from (select node, margin, y, unnest(range(1, {k + 1})) as j, unnest(bins) as b from r{at} where split = 'train' and node is not null) group by all),
    c{at} as (select node, j, b, m, g_all, h_all, g_upto + case when m then g_missing else 0 end as gl, h_upto + case when m then h_missing else 0 end as hl
      from (select node, j, b, {sums} from h{at} window a as (partition by node, j)), (select unnest([false, true]) as m) where b >= 0),
    g{at} as (select *, round((gl * gl / (hl + {penalty}) + (g_all - gl) * (g_all - gl) / (h_all - hl + {penalty}) - g_all * g_all / (h_all + {penalty})) / scale, 10) as gain from c{at}, whole where hl >= 1 and h_all - hl >= 1),
    b{at} as materialized (select * from g{at} where gain > 0 qualify row_number() over (partition by node order by gain desc, j, b, m) = 1),
    r{t}_{level + 1} as materialized (select bins, y, split, margin, case when b.j is null then null when goes then 2 * node else 2 * node + 1 end as node,
      case when b.j is null then w when goes then -gl / (hl + {penalty}) else -(g_all - gl) / (h_all - hl + {penalty}) end as w
      from (select r.*, b.j, b.gl, b.hl, b.g_all, b.h_all, case when bins[b.j] < 0 then b.m else bins[b.j] <= b.b end as goes from r{at} r left join b{at} b using (node)) b)"""
        out += f""",
    r{t + 1}_0 as materialized (select bins, y, split, margin + {rate} * w as margin, 1 as node, 0.0::double as w from r{t}_{depth}),
    m{t} as (select {t} as round, split, y, margin from r{t + 1}_0)"""
    every = " union all ".join(f"select * from m{t}" for t in range(rounds + 1))
    return out + f" select round, split, count(*) as n, round(sqrt(avg((y - margin) * (y - margin))), 4) as rmse from ({every}) group by all"


@query("m1_second_order_boosting", sql_boosting(3, 2, 8, 0.3, 1.0))
def m1_second_order(t):
    """Error after each round on the rows fitted and on rows held out by order; a discount of nothing is a missing one."""
    rows = t.v_regress.withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).select("l_orderkey", *BOOST_FEATURES, "y")
    rows = sample.hash_split(rows, "l_orderkey", {"train": 0.8, "test": 0.2}, seed=7)
    model = boost.fit_boosted(rows.filter("split = 'train'"), BOOST_FEATURES, "y", rounds=3, depth=2, bins=8, rate=0.3, penalty=1.0)
    return boost.errors_by_round(rows, model, "y", ["split"]).select("round", "split", "n", r("rmse", 4).alias("rmse"))


@query("m2_feed_forward_classifier", "select count(*) as n, count(distinct y) as classes, true as better_than_majority from v_scored")
def m2(t):
    """A fitted network must name at least as many rows right as always naming the largest class."""
    model = learn.fit_classifier(t.v_scored, "logits", "y", [16], 10, steps=50)
    rows = model.transform(t.v_scored.select(F.col("y").cast("double").alias("y"), learn.array_to_vector("logits").alias("features")))
    cells = evaluate.observed(rows, "y", "prediction").groupBy("label").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    return cells.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("classes"), (F.sum("right") >= F.max("n")).alias("better_than_majority"))


def generated(t, seed: int = 42, weights=WEIGHTS):
    df = regression_data(t.orders.select("o_orderkey"), "o_orderkey", [w / 10 for w in weights], seed=seed)
    return df.select(F.array(*[f"feature_{j}" for j in range(1, len(weights) + 1)]).alias("x"), "target")


def sql_descent(name: str, seed: int, weights, start: str, steps: int, rate: float) -> str:
    """The loss before each step of a linear model's descent, which follows from the moments of the data alone."""
    k = len(weights) + 1
    x = [f"feature_{j}" for j in range(1, k)] + ["1.0::double"]
    target = "0.1 * noise + " + " + ".join(f"({w / 10!r}) * feature_{j}" for j, w in enumerate(weights, 1))
    zeros, each = f"[{', '.join(['0.0::double'] * k)}]", f"range(1, {k + 1})"
    product = f"list_transform({each}, lambda j: list_sum(list_transform({each}, lambda i: a[j][i] * w[i])))"
    return f"""{name}_d as (select *, {target} as target from ({sql_features(seed)})),
    {name}_m as materialized (select count(*) as n, sum(target * target) as yy, [{", ".join(f"sum({v} * target)" for v in x)}] as b,
      [{", ".join("[" + ", ".join(f"sum({v} * {u})" for u in x) + "]" for v in x)}] as a from {name}_d),
    {name}_p as (select 0 as t, {start} as w, {zeros} as f, {zeros} as s
      union all select t + 1, list_transform({each}, lambda j: w[j] - {rate} * ((f2[j] / (1 - power(0.9::double, t + 1))) / (sqrt(s2[j] / (1 - power(0.999::double, t + 1))) + 1e-8) + 5e-4 * w[j])), f2, s2
      from (select t, w, list_transform({each}, lambda j: 0.9 * f[j] + 0.1 * g[j]) as f2, list_transform({each}, lambda j: 0.999 * s[j] + 0.001 * g[j] * g[j]) as s2
        from (select t, w, f, s, list_transform({each}, lambda j: 2 * (aw[j] - b[j]) / n) as g from (select *, {product} as aw from {name}_p, {name}_m where t < {steps})))),
    {name} as (select t::bigint as step, round((list_sum(list_transform({each}, lambda j: w[j] * (aw[j] - 2 * b[j]))) + yy) / n, 6) as loss from (select *, {product} as aw from {name}_p, {name}_m) where t < {steps})"""


ZEROS = "[" + ", ".join(["0.0::double"] * (len(WEIGHTS) + 1)) + "]"


def flat_start():
    return [(np.zeros((len(WEIGHTS), 1)), np.zeros(1))]


@query("m3_network_regression", "with recursive " + sql_descent("one", 42, WEIGHTS, ZEROS, 12, 0.03) + " select step, loss from one")
def m3(t):
    _, losses = learn.fit_mlp(generated(t), "x", "target", steps=12, rate=0.03, start=flat_start())
    return t.spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(losses)], "step bigint, loss double")


def sql_hidden(name: str, seed: int, weights, hidden, start: str, steps: int, rate: float) -> str:
    """The loss before each step of a network with ELU layers: forward and backward sums spelled out for every weight.

    The weights after t steps are the one row of ``{name}_p{t}``: a flat list, layer by layer, weights row by row, then biases."""
    sizes = [len(weights), *hidden, 1]
    target = "0.1 * noise + " + " + ".join(f"({w / 10!r}) * feature_{j}" for j, w in enumerate(weights, 1))
    places, at = [], 1
    for i, o in zip(sizes, sizes[1:], strict=False):
        places.append((at, at + i * o))
        at += i * o + o
    each, last = f"range(1, {at})", len(sizes) - 2
    weight = lambda l, i, j: f"w[{places[l][0] + i * sizes[l + 1] + j}]"  # noqa: E731, E741
    out = f"""{name}_d as materialized (select {", ".join(f"feature_{j} as h0_{j - 1}" for j in range(1, sizes[0] + 1))}, {target} as target from ({sql_features(seed)})),
    {name}_p0 as materialized (select {start} as w, list_transform({each}, lambda i: 0.0::double) as f, list_transform({each}, lambda i: 0.0::double) as s)"""
    for t in range(steps):
        inner = f"select * from {name}_d, {name}_p{t}"
        for l in range(last + 1):  # noqa: E741
            sums = ", ".join(f"w[{places[l][1] + j}] + " + " + ".join(f"h{l}_{i} * {weight(l, i, j)}" for i in range(sizes[l])) + f" as z{l}_{j}" for j in range(sizes[l + 1]))
            inner = f"select *, {sums} from ({inner})"
            if l < last:
                inner = f"select *, {', '.join(f'case when z{l}_{j} > 0 then z{l}_{j} else exp(least(z{l}_{j}, 0)) - 1 end as h{l + 1}_{j}' for j in range(sizes[l + 1]))} from ({inner})"
        inner = f"select *, 2 * (z{last}_0 - target) as b{last}_0 from ({inner})"
        for l in range(last, 0, -1):  # noqa: E741
            back = ", ".join(
                "(" + " + ".join(f"b{l}_{j} * {weight(l, i, j)}" for j in range(sizes[l + 1])) + f") * case when z{l - 1}_{i} > 0 then 1 else exp(least(z{l - 1}_{i}, 0)) end as b{l - 1}_{i}" for i in range(sizes[l])
            )
            inner = f"select *, {back} from ({inner})"
        sums = [x for l in range(last + 1) for x in [*[f"avg(h{l}_{i} * b{l}_{j})" for i in range(sizes[l]) for j in range(sizes[l + 1])], *[f"avg(b{l}_{j})" for j in range(sizes[l + 1])]]]  # noqa: E741
        out += f""",
    {name}_g{t} as materialized (select avg((z{last}_0 - target) * (z{last}_0 - target)) as loss, [{", ".join(sums)}] as g from ({inner})),
    {name}_p{t + 1} as materialized (select list_transform({each}, lambda i: w[i] - {rate} * ((f2[i] / {1 - 0.9 ** (t + 1)!r}::double) / (sqrt(s2[i] / {1 - 0.999 ** (t + 1)!r}::double) + 1e-8::double) + 5e-4::double * w[i])) as w, f2 as f, s2 as s
      from (select w, list_transform({each}, lambda i: 0.9::double * f[i] + 0.1::double * g[i]) as f2, list_transform({each}, lambda i: 0.999::double * s[i] + 0.001::double * g[i] * g[i]) as s2 from {name}_p{t}, {name}_g{t}))"""
    return out + f""",
    {name} as ({" union all ".join(f"select {t}::bigint as step, round(loss, 6) as loss from {name}_g{t}" for t in range(steps))})"""


def sql_start(hidden) -> str:
    flat = learn.flatten(learn.starting_weights([len(WEIGHTS), *hidden, 1]))
    return f"[{', '.join(map(repr, flat.tolist()))}]::double[]"


@query("m3_hidden_layers", "with " + sql_hidden("one", 42, WEIGHTS, (16, 8), sql_start((16, 8)), 12, 0.03) + " select step, loss from one")
def m3_hidden(t):
    _, losses = learn.fit_mlp(generated(t), "x", "target", hidden=(16, 8), steps=12, rate=0.03)
    return t.spark.createDataFrame([(i, round(x, 6)) for i, x in enumerate(losses)], "step bigint, loss double")


@query(
    "m4_batch_scoring",
    CLASS_MEAN_LOGITS + """, b as (select row_id, max(logit) as top from s group by row_id),
    e as (select s.row_id, class, logit, exp(logit - top) as e from s join b using (row_id))
    select row_id, class, round(logit, 6) + 0.0 as logit, round(e / sum(e) over (partition by row_id), 8) as p,
      first_value(class) over (partition by row_id order by logit desc, class) as pred from e""",
)
def m4(t):
    layers = learn.layers_of(learn.class_mean_table(t.embeddings, "embedding", "label"))
    scored = learn.classify(t.embeddings.select(F.col("vec_id").alias("row_id"), "embedding"), "embedding", layers)
    rows = scored.select("row_id", "pred", F.posexplode(F.arrays_zip("logits", "probs")).alias("class", "z"))
    return rows.select("row_id", big("class").alias("class"), r("z.logits").alias("logit"), r("z.probs", 8).alias("p"), big("pred").alias("pred"))


@query(
    "m5_l1_norm",
    """with w as (select label, i, avg(cast(embedding[i] as double)) as value from embeddings, range(1, 65) t(i) group by all)
    select round(sum(abs(value)) * 0.0001, 8) as l1 from w""",
)
def m5(t):
    return learn.l1_norm(learn.class_mean_table(t.embeddings, "embedding", "label"), 1e-4).select(r("l1", 8).alias("l1"))


@query(
    "m6_dropout",
    f"""select row_id, i as pos, case when {sql_uniform("'9:' || row_id || ':' || i")} > 0.2 then round(px[i + 1] / 0.8::double, 6) else 0.0 end as v from v_image, range(0, 64) t(i)""",
)
def m6(t):
    return long_pixels(t.v_image, vectors.dropout("px", 0.2, 9, "row_id"))


SECOND = [w + 2 for w in WEIGHTS]


@query(
    "m7_second_stage",
    "with recursive " + sql_descent("one", 42, WEIGHTS, ZEROS, 8, 0.03) + ", " + sql_descent("two", 43, SECOND, "(select w from one_p where t = 8)", 6, 0.01)
    + " select 'first' as stage, step, loss from one union all select 'second', step, loss from two",
)
def m7(t):
    first, one = learn.fit_mlp(generated(t), "x", "target", steps=8, rate=0.03, start=flat_start())
    _, two = learn.fit_mlp(generated(t, 43, SECOND), "x", "target", steps=6, rate=0.01, start=first)
    rows = [("first", i, round(x, 6)) for i, x in enumerate(one)] + [("second", i, round(x, 6)) for i, x in enumerate(two)]
    return t.spark.createDataFrame(rows, "stage string, step bigint, loss double")


@query(
    "m7_hidden_second_stage",
    "with " + sql_hidden("one", 42, WEIGHTS, (8,), sql_start((8,)), 8, 0.03) + ", " + sql_hidden("two", 43, SECOND, (8,), "(select w from one_p8)", 6, 0.01)
    + " select 'first' as stage, step, loss from one union all select 'second', step, loss from two",
)
def m7_hidden(t):
    first, one = learn.fit_mlp(generated(t), "x", "target", hidden=(8,), steps=8, rate=0.03)
    _, two = learn.fit_mlp(generated(t, 43, SECOND), "x", "target", steps=6, rate=0.01, start=first)
    rows = [("first", i, round(x, 6)) for i, x in enumerate(one)] + [("second", i, round(x, 6)) for i, x in enumerate(two)]
    return t.spark.createDataFrame(rows, "stage string, step bigint, loss double")
