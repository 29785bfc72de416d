"""Planting missing values."""

from pyspark.sql import functions as F

from checks.common import LABEL, LINE, LINE_SQL, ORDER_SQL, PART_SQL, SEED, WHOLE_LINE_SQL, customers, lines, mcar_sql, parts, query, u_sql, whole_lines
from gapweave.functions.rng import choose, draw_normal
from gapweave.functions.selection import order_statistics, quantiles_linear
from gapweave.operators import ampute as A

COLS = [*LINE, LABEL]


def _counts(df, mask):
    """Masked cells per column, and the sum of what was hidden."""
    flags = mask.flags(df)
    return flags.agg(*[e for c in mask.conditions for e in (
        F.count_if(F.col(f"{c}__mis")).alias(f"n_{c}"),
        F.round(F.sum(F.when(F.col(f"{c}__mis"), F.col(c))), 2).alias(f"hidden_{c}"))])


def _counts_sql(columns, source):
    return "SELECT " + ", ".join(f"count(*) FILTER (WHERE m_{c}) AS n_{c}, round(sum({c}) FILTER (WHERE m_{c}), 2) AS hidden_{c}"
                                 for c in columns) + f" FROM {source}"


def _logistic_sql(targets, weights, salt, p, extra="", source=LINE_SQL):
    """Newton steps as chained subqueries: the same calibration in SQL."""
    z, w = [], []
    for t in targets:
        score = " + ".join(f"{c} * ({v!r})" for c, v in weights[t].items())
        w.append(f"stddev_samp({score}) AS w_{t}")
        z.append(f"(({score}) / w_{t}) AS z_{t}")
    steps = ["b0 AS (SELECT " + ", ".join(f"ln({p} / (1 - {p})) AS b_{t}" for t in targets) + ")"]
    sig = "(1 / (1 + exp(-(z_{t} + b_{t}))))"
    for i in range(9):
        terms = ", ".join(
            f"b_{t} - (avg({sig.format(t=t)}) - {p}) / avg({sig.format(t=t)} * (1 - {sig.format(t=t)})) AS b_{t}" for t in targets)
        steps.append(f"b{i + 1} AS (SELECT {terms} FROM z, b{i} GROUP BY {', '.join(f'b_{t}' for t in targets)})")
    masks = ", ".join(f"({u_sql(salt, t)} < {sig.format(t=t)}) AS m_{t}" for t in targets)
    return f"""t AS ({source}), sd AS (SELECT {', '.join(w)} FROM t), z AS (SELECT t.*, {', '.join(z)} FROM t, sd),
 {', '.join(steps)}, m AS (SELECT z.*, {masks}{extra} FROM z, b9)"""


def _raw(targets, inputs, salt):
    return {t: {c: draw_normal(SEED, salt, f"{c}>{t}") for c in inputs} for t in targets}


@query("ampute_mcar", f"WITH t AS ({WHOLE_LINE_SQL}) {mcar_sql(COLS, 0.3, 't')}")
def ampute_mcar(spark, sf):
    return A.ampute(whole_lines(spark, sf), COLS, 0.3, "MCAR", SEED)


MAR_IN = choose(COLS, 2, SEED, "mar")
MAR_OUT = [c for c in COLS if c not in MAR_IN]


@query("ampute_mar", f"WITH {_logistic_sql(MAR_OUT, _raw(MAR_OUT, MAR_IN, 'mar'), 'mar', 0.3)} {_counts_sql(MAR_OUT, 'm')}")
def ampute_mar(spark, sf):
    t = lines(spark, sf)
    return _counts(t, A.plan_mask(t, COLS, 0.3, "MAR", SEED))


MNAR_IN = choose(COLS, 2, SEED, "mnar")
MNAR_OUT = [c for c in COLS if c not in MNAR_IN]
_EXTRA = "".join(f", ({u_sql('mnar-inputs', c)} < 0.3) AS m_{c}" for c in MNAR_IN)


@query("ampute_mnar_logistic",
       f"WITH {_logistic_sql(MNAR_OUT, _raw(MNAR_OUT, MNAR_IN, 'mnar'), 'mnar', 0.3, _EXTRA, WHOLE_LINE_SQL)} {_counts_sql(COLS, 'm')}")
def ampute_mnar_logistic(spark, sf):
    t = whole_lines(spark, sf)
    return _counts(t, A.plan_mask(t, COLS, 0.3, "MNAR", SEED))


@query("ampute_mnar_all_inputs",
       f"WITH {_logistic_sql(COLS, _raw(COLS, COLS, 'mnar'), 'mnar', 0.2, source=WHOLE_LINE_SQL)} {_counts_sql(COLS, 'm')}")
def ampute_mnar_all(spark, sf):
    t = whole_lines(spark, sf)
    return _counts(t, A.mnar_logistic(t, COLS, 0.2, SEED, exclude_inputs=False))


_SELF = {c: {c: draw_normal(SEED, "self", f"{c}>{c}")} for c in COLS}


@query("ampute_mnar_self", f"WITH {_logistic_sql(COLS, _SELF, 'self', 0.3, source=WHOLE_LINE_SQL)} {_counts_sql(COLS, 'm')}")
def ampute_mnar_self(spark, sf):
    t = whole_lines(spark, sf)
    return _counts(t, A.plan_mask(t, COLS, 0.3, "MNAR", SEED, opt="selfmasked"))


QCOLS = choose(COLS, 2, SEED, "quantile")


def _kth(c, k, t="t"):
    return f"(SELECT {c} FROM (SELECT {c}, row_number() OVER (ORDER BY {c}) AS rn FROM {t}) WHERE rn = (SELECT floor({k} * count(*)) FROM {t}))"


def _tail(c):
    return f"({u_sql('quantile', c)} < 0.6) AND ({c} <= {_kth(c, 0.3)} OR {c} >= {_kth(c, 0.7)})"


@query("ampute_mnar_quantile", f"""WITH t AS ({WHOLE_LINE_SQL}) SELECT row_id, {', '.join(
    f'CASE WHEN NOT ({_tail(c)}) THEN {c} END AS {c}' if c in QCOLS else c for c in COLS)} FROM t""")
def ampute_mnar_quantile(spark, sf):
    return A.ampute_preset(whole_lines(spark, sf), COLS, 0.6, "MNAR-QUANTILE", SEED)


@query("coefficient_scaling", f"""WITH t AS ({LINE_SQL}) SELECT {', '.join(
    'round(' + repr(w) + ' / stddev_samp(' + ' + '.join(f'{c2} * ({w2!r})' for c2, w2 in _raw(MAR_OUT, MAR_IN, 'mar')[t].items()) + f'), 9) AS w_{c}_{t}'
    for t in MAR_OUT for c, w in _raw(MAR_OUT, MAR_IN, 'mar')[t].items())} FROM t""")
def coefficient_scaling(spark, sf):
    t = lines(spark, sf)
    w = A.plan_mask(t, COLS, 0.3, "MAR", SEED).weights
    return t.agg(*[F.round(F.max(F.lit(v)), 9).alias(f"w_{c}_{g}") for g, ws in w.items() for c, v in ws.items()])


@query("intercept_calibration", f"SELECT 'rate' AS what, {', '.join(f'0.3 AS {c}' for c in MAR_OUT)} FROM (SELECT count(*) FROM lineitem)")
def intercept_calibration(spark, sf):
    """Mean masking probability under the fitted intercepts: must be the asked rate."""
    t = lines(spark, sf)
    probs = A.plan_mask(t, COLS, 0.3, "MAR", SEED).probabilities
    return t.agg(F.lit("rate").alias("what"), *[F.round(F.avg(q), 9).alias(c) for c, q in probs.items()])


@query("order_statistic", f"WITH t AS ({LINE_SQL}) SELECT {', '.join(f'{_kth(c, 0.3)} AS k_{c}' for c in COLS)}")
def order_statistic(spark, sf):
    t = lines(spark, sf)
    k = int(0.3 * t.count())
    at = order_statistics(t, {c: [k] for c in COLS})
    return spark.createDataFrame([tuple(at[(c, k)] for c in COLS)], ", ".join(f"k_{c} double" for c in COLS))


@query("ampute_numeric_carry_text", f"WITH t AS ({PART_SQL}) {mcar_sql(['p_size', 'p_retailprice'], 0.25, 't', ['p_brand', 'p_type'])}")
def ampute_numeric(spark, sf):
    return A.ampute_numeric(parts(spark, sf), ["p_size", "p_retailprice"], 25, "MCAR", SEED)


def _blank(c):
    return f"CASE WHEN row_number() OVER (ORDER BY {u_sql('blank', c)}, row_id) > round_even(0.2 * count(*) OVER (), 0) THEN {c} END AS {c}"


@query("blank_fraction", f"WITH t AS ({ORDER_SQL}) SELECT row_id, {_blank('c_acctbal')}, {_blank('o_totalprice')} FROM t")
def blank_fraction(spark, sf):
    t = customers(spark, sf).select("row_id", "c_acctbal", "o_totalprice")
    return A.blank_fraction(t, ["c_acctbal", "o_totalprice"], 0.2, SEED)


@query("missing_share", f"""WITH t AS ({WHOLE_LINE_SQL}), a AS ({mcar_sql(COLS, 0.3, 't')}) SELECT count(*) AS n_rows,
 {', '.join(f'count(*) - count({c}) AS missing_{c}' for c in COLS)},
 ({' + '.join(f'count(*) - count({c})' for c in COLS)}) / (count(*) * 4.0)::DOUBLE AS mf1, mf1 * 100 AS miss_perc FROM a""")
def missing_share(spark, sf):
    return A.missing_report(A.ampute(whole_lines(spark, sf), COLS, 0.3, "MCAR", SEED), COLS)


@query("transfer_mask", f"WITH t AS ({PART_SQL}) {mcar_sql(['p_size', 'p_retailprice'], 0.3, 't', ['p_brand', 'p_type'])}")
def transfer_mask(spark, sf):
    from gapweave.operators.scale import fit_standard

    t, cols = parts(spark, sf), ["p_size", "p_retailprice"]
    scaled = A.ampute(fit_standard(t, cols).transform(t), cols, 0.3, "MCAR", SEED)
    return A.transfer_mask(scaled, t, cols)


@query("interpolated_quantiles", f"""WITH t AS ({LINE_SQL}) SELECT {', '.join(
    f'round(quantile_cont({c}, {q}), 7) AS q{int(q * 100)}_{c}' for c in COLS for q in (0.25, 0.75))} FROM t""")
def interpolated_quantiles(spark, sf):
    at = quantiles_linear(lines(spark, sf), {c: [0.25, 0.75] for c in COLS})
    names = [f"q{int(q * 100)}_{c}" for c in COLS for q in (0.25, 0.75)]
    values = [round(at[(c, q)], 7) for c in COLS for q in (0.25, 0.75)]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} double" for n in names))
