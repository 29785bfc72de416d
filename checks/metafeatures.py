"""Dataset meta-features, on amputed lineitem and part."""

from pyspark.sql import functions as F

from checks.common import LABEL, LINE, LINE_SQL, SEED, WHOLE_LINE_SQL, lines, mcar_sql, query, u_sql, whole_lines
from checks.impute import KCOLS, PART3_SQL, part3
from gapweave.operators.ampute import ampute
from gapweave.operators.metafeatures import interpolate, meta_features

BASE, WHOLE_BASE = (f"t AS ({source}), a AS ({mcar_sql(LINE, 0.3, 't', [LABEL])})" for source in (LINE_SQL, WHOLE_LINE_SQL))
D = len(LINE)


def frame(spark, sf, read=lines):
    return ampute(read(spark, sf), LINE, 0.3, "MCAR", SEED)


def rounded(spark, values, digits=6):
    return spark.createDataFrame([tuple(round(v, digits) for v in values.values())], ", ".join(f"{n} double" for n in values))


def mf(spark, sf, *numbers, digits=6, read=lines):
    return rounded(spark, meta_features(frame(spark, sf, read), LINE, LABEL, [f"MF{i}" for i in numbers], seed=SEED), digits)


FLAT = "f AS (" + " UNION ALL ".join(f"SELECT {c} AS v FROM a" for c in LINE) + ")"


def _mean(items):
    return "(" + " + ".join(items) + f") / {len(items)}"


@query("meta_shape", f"""WITH {WHOLE_BASE}, {FLAT} SELECT round((count(*) - count(v)) / count(*)::DOUBLE, 6) AS "MF1",
  (SELECT count(DISTINCT {LABEL})::DOUBLE FROM a) AS "MF2", (SELECT count(*)::DOUBLE FROM a) AS "MF3",
  (SELECT round({D} / count(*)::DOUBLE, 6) FROM a) AS "MF4", {D}::DOUBLE AS "MF7", (SELECT round(count(*) / {D}::DOUBLE, 6) FROM a) AS "MF25" FROM f""")
def meta_shape(spark, sf):
    return mf(spark, sf, 1, 2, 3, 4, 7, 25, read=whole_lines)


@query("meta_location", f"""WITH {WHOLE_BASE}, {FLAT} SELECT round(stddev_pop(v), 6) AS "MF5", round(avg(coalesce(v, 0)), 6) AS "MF8",
  round(min(v), 6) AS "MF10", round(max(v), 6) AS "MF11", round(var_pop(v), 6) AS "MF12" FROM f""")
def meta_location(spark, sf):
    return mf(spark, sf, 5, 8, 10, 11, 12, read=whole_lines)


@query("meta_label", f"""WITH {BASE} SELECT round(stddev_samp({LABEL}), 3) AS "MF6", round(avg({LABEL}), 3) AS "MF9",
  round(var_pop({LABEL}), 1) AS "MF13" FROM a""")
def meta_label(spark, sf):
    values = meta_features(frame(spark, sf), LINE, LABEL, ["MF6", "MF9", "MF13"])
    digits = {"MF6": 3, "MF9": 3, "MF13": 1}
    return spark.createDataFrame([tuple(round(v, digits[k]) for k, v in values.items())], "MF6 double, MF9 double, MF13 double")


def _matrix(f, cols):
    return [[("1.0" if f == "corr" else f"{f}({a}, {a})") if a == b else f"{f}({a}, {b})" for b in cols] for a in cols]


def _abs_col(row):
    return _mean([f"abs({e})" for e in row])


_C = _matrix("corr", LINE)
_V = _matrix("covar_samp", LINE)


@query("meta_correlation", f"""WITH {WHOLE_BASE} SELECT round({_mean(['(' + _abs_col(r) + ')' for r in _C])}, 6) AS "MF14",
  round({_mean(['list_stddev_samp([' + ', '.join(f'abs({e})' for e in r) + '])' for r in _C])}, 6) AS "MF15",
  round({_mean([f'abs(corr({c}, {LABEL}))' for c in LINE])}, 6) AS "MF16",
  round(greatest({', '.join(f'corr({c}, {LABEL})' for c in LINE)}), 6) AS "MF17",
  round(least({', '.join(f'corr({c}, {LABEL})' for c in LINE)}), 6) AS "MF18",
  round({_mean(['(' + _abs_col(r) + ')' for r in _V])}, 6) AS "MF19" FROM a""")
def meta_correlation(spark, sf):
    return mf(spark, sf, 14, 15, 16, 17, 18, 19, read=whole_lines)


@query("meta_shape_moments", f"""WITH {WHOLE_BASE} SELECT round({_mean([f'kurtosis({c})' for c in LINE])}, 6) AS "MF26",
  round({_mean([f'skewness({c})' for c in LINE])}, 6) AS "MF27", round(skewness({LABEL}), 6) AS "MF28",
  round(kurtosis({LABEL}), 6) AS "MF29" FROM a""")
def meta_shape_moments(spark, sf):
    return mf(spark, sf, 26, 27, 28, 29, read=whole_lines)


@query("meta_quantiles", f"""WITH {BASE}, {FLAT} SELECT round(quantile_cont(coalesce(v, 0), 0.75), 6) AS "MF30",
  (SELECT round(quantile_cont({LABEL}, 0.75), 4) FROM a) AS "MF31", (SELECT round(quantile_cont({LABEL}, 0.25), 4) FROM a) AS "MF32",
  round(quantile_cont(coalesce(v, 0), 0.25), 6) AS "MF33" FROM f""")
def meta_quantiles(spark, sf):
    return mf(spark, sf, 30, 31, 32, 33, digits=4)


def residual_sql(features, label, source="z", keep=("row_id",)):
    """OLS residual by taking out one feature at a time; each step is a one-variable regression."""
    ctes, prev, left = [], source, [*features, label]
    for k, x in enumerate(features):
        rest = left[k + 1:]
        slopes = ", ".join(f"regr_slope({v}, {x}) AS s_{v}, avg({v}) AS m_{v}" for v in rest)
        ctes.append(f"g{k} AS (SELECT {slopes}, avg({x}) AS mx FROM {prev})")
        done = ", ".join(f"{v} - m_{v} - s_{v} * ({x} - mx) AS {v}" for v in rest)
        ctes.append(f"o{k} AS (SELECT {', '.join(keep)}, {done} FROM {prev}, g{k})")
        prev = f"o{k}"
    return ", ".join(ctes), prev


def zero_fill(features, label, source="a"):
    return f"z AS (SELECT row_id, {', '.join(f'coalesce({c}, 0) AS {c}' for c in features)}, {label} FROM {source})"


_RES, _LAST = residual_sql(LINE, LABEL)


@query("meta_linear_fit", f"""WITH {WHOLE_BASE}, {zero_fill(LINE, LABEL)}, {_RES}
  SELECT round(avg({LABEL} ** 2) / (SELECT (max({LABEL}) - min({LABEL})) ** 2 FROM z), 8) AS "MF20" FROM {_LAST}""")
def meta_linear_fit(spark, sf):
    return mf(spark, sf, 20, digits=8, read=whole_lines)


@query("meta_interpolated_fit", f"""WITH {WHOLE_BASE}, {zero_fill(LINE, LABEL)}, {_RES}, r AS (SELECT z.row_id, z.{LABEL} AS y, {', '.join('z.' + c for c in LINE)},
  {_LAST}.{LABEL} AS e FROM z JOIN {_LAST} USING (row_id)),
  w AS (SELECT *, {u_sql('between', '')} AS lam, lag(e) OVER o AS pe, {', '.join(f'lag({c}) OVER o AS p_{c}' for c in LINE)} FROM r WINDOW o AS (ORDER BY y, row_id))
  SELECT round(avg((lam * e + (1 - lam) * pe) ** 2), 0) AS "MF21",
  round(avg(sqrt({' + '.join(f'({c} - p_{c}) ** 2' for c in LINE)})), 6) AS "MF22" FROM w WHERE pe IS NOT NULL""")
def meta_interpolated_fit(spark, sf):
    v = meta_features(frame(spark, sf, whole_lines), LINE, LABEL, ["MF21", "MF22"], seed=SEED)
    return spark.createDataFrame([(float(round(v["MF21"])), round(v["MF22"], 6))], "MF21 double, MF22 double")


FEATS, Y = KCOLS[:2], KCOLS[2]


def part_frame(spark, sf):
    return ampute(part3(spark, sf), FEATS, 0.2, "MCAR", SEED)


def _nn_sql(points, cond):
    sq = " + ".join(f"(p.{c} - d.{c}) ** 2" for c in FEATS)
    return f"""nn AS (SELECT p.row_id, p.{Y} AS y, d.{Y} AS dy, row_number() OVER (PARTITION BY p.row_id ORDER BY {sq}, d.row_id) AS rn
      FROM {points} p, z d WHERE {cond})"""


PBASE = f"t AS ({PART3_SQL}), a AS ({mcar_sql(FEATS, 0.2, 't', [Y])}), {zero_fill(FEATS, Y)}"


@query("meta_nearest_label", f"""WITH {PBASE}, {_nn_sql('z', 'p.row_id <> d.row_id')} SELECT round(avg((y - dy) ** 2), 6) AS "MF23" FROM nn WHERE rn = 1""")
def meta_nearest(spark, sf):
    return rounded(spark, meta_features(part_frame(spark, sf), FEATS, Y, ["MF23"], seed=SEED))


_BETWEEN = f"""w AS (SELECT row_id, {u_sql('between', '')} AS lam, {', '.join(f'{c}, lag({c}) OVER o AS p_{c}' for c in [*FEATS, Y])} FROM z WINDOW o AS (ORDER BY {Y}, row_id)),
  q AS (SELECT row_id, {', '.join(f'lam * {c} + (1 - lam) * p_{c} AS {c}' for c in [*FEATS, Y])} FROM w WHERE p_{Y} IS NOT NULL)"""


@query("meta_nearest_interpolated", f"""WITH {PBASE}, {_BETWEEN}, {_nn_sql('q', 'true')} SELECT round(avg((y - dy) ** 2), 6) AS "MF24" FROM nn WHERE rn = 1""")
def meta_nearest_between(spark, sf):
    return rounded(spark, meta_features(part_frame(spark, sf), FEATS, Y, ["MF24"], seed=SEED))


@query("interpolated_points", f"""WITH {PBASE}, {_BETWEEN} SELECT row_id, {', '.join(f'round({c}, 6) AS {c}' for c in [*FEATS, Y])} FROM q""")
def interpolated_points(spark, sf):
    zero = part_frame(spark, sf).select("row_id", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in FEATS], Y)
    out = interpolate(zero, FEATS, Y, SEED)
    return out.select("row_id", *[F.round(c, 6).alias(c) for c in [*FEATS, Y]])


@query("meta_original_scale", f"""WITH {WHOLE_BASE}, {FLAT} SELECT round(avg(coalesce(v, 0)), 6) AS "origmf_MF8", round(stddev_pop(v), 6) AS "origmf_MF5" FROM f""")
def meta_original_scale(spark, sf):
    """Second pass on unscaled values: the mask found on the scaled frame, values from the original."""
    from gapweave.operators.ampute import transfer_mask
    from gapweave.operators.scale import fit_standard

    t = whole_lines(spark, sf)
    scaled = ampute(fit_standard(t, LINE).transform(t), LINE, 0.3, "MCAR", SEED)
    back = transfer_mask(scaled, t, LINE)
    return rounded(spark, meta_features(back, LINE, LABEL, ["MF8", "MF5"], prefix="origmf_"))
