"""Planting missing values: MCAR, MAR, MNAR (logistic, self-masked, quantile)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapweave.functions.numeric import linear, missing_count, sigmoid
from gapweave.functions.rng import choose, draw_normal, hash_uniform
from gapweave.functions.selection import lowest_by_hash, order_statistics
from gapweave.model import ROW_ID

P_OBS = 0.5
QUANTILE = 0.3
BRACKET = 50.0

# preset -> (mechanism, option); fixed values
PRESETS = {
    "MCAR": ("MCAR", "logistic"),
    "MAR": ("MAR", "logistic"),
    "MNAR": ("MNAR", "logistic"),
    "MCAR-ISIL": ("MCAR", "logistic"),
    "MCAR2": ("MCAR", "logistic"),
    "MNAR-QUANTILE": ("MNAR", "quantile"),
}


@dataclass
class Mask:
    """A condition per column saying which cells go missing, with the model behind it."""

    conditions: dict[str, Column]
    inputs: list[str] = field(default_factory=list)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)
    intercepts: dict[str, float] = field(default_factory=dict)
    probabilities: dict[str, Column] = field(default_factory=dict)

    def apply(self, df: DataFrame, keep_truth: list[str] | bool = False) -> DataFrame:
        """One projection over all columns; the rest of the frame is carried along.

        ``keep_truth`` names columns whose original (``c__true``) and mask
        (``c__mis``) stay beside them, so scoring later needs no join.
        """
        masks = {c: F.coalesce(m, F.lit(False)) for c, m in self.conditions.items()}
        out = {c: F.when(~m, F.col(c)) for c, m in masks.items()}
        for c in (list(self.conditions) if keep_truth is True else keep_truth or []):
            out[f"{c}__true"] = F.col(c)
            out[f"{c}__mis"] = masks.get(c, F.lit(False))
        return df.withColumns(out)

    def flags(self, df: DataFrame, suffix: str = "__mis") -> DataFrame:
        return df.withColumns({f"{c}{suffix}": F.coalesce(m, F.lit(False)) for c, m in self.conditions.items()})


def _below(seed: int, salt: str, column: str, row_id: str, p: float | Column) -> Column:
    p = p if isinstance(p, Column) else F.lit(float(p))
    return hash_uniform(seed, salt, column, row_id) < p


def mcar(columns: list[str], p: float, seed: int, row_id: str = ROW_ID) -> Mask:
    return Mask({c: _below(seed, "mcar", c, row_id, p) for c in columns})


def _score(weights: dict[str, float]) -> Column:
    """A weighted sum in which a missing input counts as zero: the row still has a probability, so
    the rate asked for is reached over all rows."""
    return linear([F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in weights], list(weights.values()))


def _scaled_weights(df: DataFrame, raw: dict[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """Divide each weight vector by the sample deviation of its score."""
    scores = {t: _score(w) for t, w in raw.items()}
    row = df.agg(*[F.stddev_samp(z).alias(f"z{i}") for i, z in enumerate(scores.values())]).first()
    out = {}
    for i, (t, w) in enumerate(raw.items()):
        if not row[f"z{i}"]:
            raise ValueError(f"score for {t!r} has no variance")
        out[t] = {c: v / row[f"z{i}"] for c, v in w.items()}
    return out


def calibrate(df: DataFrame, scores: dict[str, Column], p: float, tolerance: float = 1e-12) -> dict[str, float]:
    """Intercepts b with mean(sigmoid(score + b)) = p, all targets in each pass.

    Newton steps inside a shrinking bracket: a handful of scans, one exp per cell.
    """
    if not 0.0 < p < 1.0:
        raise ValueError("an intercept exists for 0 < p < 1 only")
    lo = {t: -BRACKET for t in scores}
    hi = {t: BRACKET for t in scores}
    b = {t: math.log(p / (1 - p)) for t in scores}
    for _ in range(60):
        probs = {t: sigmoid(z + F.lit(b[t])) for t, z in scores.items()}
        row = df.agg(*[e.alias(f"{n}{i}") for i, s in enumerate(probs.values())
                       for n, e in (("m", F.avg(s)), ("g", F.avg(s * (F.lit(1.0) - s))))]).first()
        done = True
        for i, t in enumerate(scores):
            f, slope = row[f"m{i}"] - p, row[f"g{i}"]
            if abs(f) <= tolerance:
                continue
            done = False
            if f > 0:
                hi[t] = b[t]
            else:
                lo[t] = b[t]
            step = b[t] - f / slope if slope > 0 else math.inf
            b[t] = step if lo[t] < step < hi[t] else (lo[t] + hi[t]) / 2
            if hi[t] - lo[t] < 1e-13:
                done = True
        if done:
            return b
    raise ArithmeticError(f"no intercept found for a rate of {p}: {b}")


def _logistic(df, raw, p, seed, salt, row_id) -> Mask:
    weights = _scaled_weights(df, raw)
    scores = {t: _score(w) for t, w in weights.items()}
    b = calibrate(df, scores, p)
    probs = {t: sigmoid(z + F.lit(b[t])) for t, z in scores.items()}
    return Mask({t: _below(seed, salt, t, row_id, q) for t, q in probs.items()}, [], weights, b, probs)


def _raw(targets: list[str], inputs: list[str], seed: int, salt: str) -> dict[str, dict[str, float]]:
    return {t: {c: draw_normal(seed, salt, f"{c}>{t}") for c in inputs} for t in targets}


def _constant(p: float) -> Column:
    return F.lit(p >= 1.0)


def mar(df: DataFrame, columns: list[str], p: float, seed: int, p_obs: float = P_OBS, row_id: str = ROW_ID) -> Mask:
    """Some columns stay complete and drive the gaps of all others."""
    inputs = choose(columns, max(int(p_obs * len(columns)), 1), seed, "mar")
    targets = [c for c in columns if c not in inputs]
    if not targets or p in (0.0, 1.0):
        return Mask({t: _constant(p) for t in targets}, inputs)
    mask = _logistic(df, _raw(targets, inputs, seed, "mar"), p, seed, "mar", row_id)
    mask.inputs = inputs
    return mask


def mnar_logistic(df: DataFrame, columns: list[str], p: float, seed: int, p_params: float = P_OBS,
                  exclude_inputs: bool = True, row_id: str = ROW_ID) -> Mask:
    """As MAR, but the inputs get gaps too: at random, or by the model itself."""
    inputs = choose(columns, max(int(p_params * len(columns)), 1), seed, "mnar") if exclude_inputs else list(columns)
    targets = [c for c in columns if c not in inputs] if exclude_inputs else list(columns)
    if not targets:
        mask = Mask({})
    elif p in (0.0, 1.0):
        mask = Mask({t: _constant(p) for t in targets})
    else:
        mask = _logistic(df, _raw(targets, inputs, seed, "mnar"), p, seed, "mnar", row_id)
    mask.inputs = inputs
    if exclude_inputs:
        mask.conditions |= {c: _below(seed, "mnar-inputs", c, row_id, p) for c in inputs}
    return mask


def mnar_self(df: DataFrame, columns: list[str], p: float, seed: int, row_id: str = ROW_ID) -> Mask:
    """Each column's gaps depend on its own value; calibrated per column."""
    if p in (0.0, 1.0):
        return Mask({c: _constant(p) for c in columns})
    raw = {c: {c: draw_normal(seed, "self", f"{c}>{c}")} for c in columns}
    return _logistic(df, raw, p, seed, "self", row_id)


def mnar_quantile(df: DataFrame, columns: list[str], p: float, seed: int, q: float = QUANTILE,
                  p_params: float = 1 - P_OBS, cut: str = "both", extra_mcar: bool = False,
                  row_id: str = ROW_ID) -> Mask:
    """Gaps fall on the tails of some columns, so the achieved rate is below p."""
    if cut not in ("both", "upper", "lower"):
        raise ValueError(f"unknown cut {cut!r}")
    chosen = choose(columns, max(int(p_params * len(columns)), 1), seed, "quantile")
    n = df.count()
    low, high = int(q * n), int((1 - q) * n)
    ranks = ([low] if cut != "upper" else []) + ([high] if cut != "lower" else [])
    at = order_statistics(df, {c: sorted(set(ranks)) for c in chosen})
    conditions = {}
    for c in chosen:
        tail = F.lit(False)
        if cut != "upper":
            tail = tail | (F.col(c) <= F.lit(at[(c, low)]))
        if cut != "lower":
            tail = tail | (F.col(c) >= F.lit(at[(c, high)]))
        conditions[c] = _below(seed, "quantile", c, row_id, p) & tail
    if extra_mcar:
        for c in columns:
            conditions[c] = conditions.get(c, F.lit(False)) | _below(seed, "quantile-extra", c, row_id, p)
    return Mask(conditions, chosen)


def plan_mask(df: DataFrame, columns: list[str], p: float, mecha: str = "MCAR", seed: int = 0, opt: str = "logistic",
              p_obs: float = P_OBS, q: float = QUANTILE, row_id: str = ROW_ID) -> Mask:
    """Dispatch on mechanism and option."""
    if not 0.0 <= p <= 1.0:
        raise ValueError("the missing share must lie between 0 and 1")
    if mecha == "MCAR":
        return mcar(columns, p, seed, row_id)
    if mecha == "MAR":
        return mar(df, columns, p, seed, p_obs, row_id)
    if mecha == "MNAR" and opt == "logistic":
        return mnar_logistic(df, columns, p, seed, p_obs, True, row_id)
    if mecha == "MNAR" and opt == "selfmasked":
        return mnar_self(df, columns, p, seed, row_id)
    if mecha == "MNAR" and opt == "quantile":
        return mnar_quantile(df, columns, p, seed, q, 1 - p_obs, row_id=row_id)
    raise ValueError(f"unknown mechanism {mecha!r} with option {opt!r}")


def ampute(df: DataFrame, columns: list[str], p: float, mecha: str = "MCAR", seed: int = 0,
           keep_truth: bool = False, **options) -> DataFrame:
    mask = plan_mask(df, columns, p, mecha, seed, **options)
    return mask.apply(df, columns if keep_truth else False)


def ampute_preset(df: DataFrame, columns: list[str], p: float, preset: str, seed: int, keep_truth: bool = False) -> DataFrame:
    """Named presets used by experiment plans."""
    if preset not in PRESETS:
        raise ValueError(f"unknown mechanism {preset!r}")
    mecha, opt = PRESETS[preset]
    return ampute(df, columns, p, mecha, seed, keep_truth, opt=opt)


def ampute_numeric(df: DataFrame, numeric: list[str], percent: float, mecha: str, seed: int) -> DataFrame:
    """Rate in percent, numeric columns only; text columns are carried along."""
    if not 0 <= percent <= 100:
        raise ValueError("the missing percentage must lie between 0 and 100")
    return ampute(df, numeric, percent / 100, mecha, seed)


def blank_fraction(df: DataFrame, columns: list[str], fraction: float, seed: int, row_id: str = ROW_ID) -> DataFrame:
    """In each column, blank an exact number of rows drawn without replacement."""
    n = df.count()
    k = round(fraction * n)
    draws = {c: hash_uniform(seed, "blank", c, row_id) for c in columns}
    picked = lowest_by_hash(df, draws, {c: k for c in columns}, row_id, n)
    return Mask(picked).apply(df)


def missing_share(df: DataFrame, columns: list[str]) -> Column:
    """Aggregate: share of missing cells over all columns."""
    return F.try_divide(F.sum(missing_count(columns)).cast("double"), (F.count("*") * F.lit(len(columns))).cast("double"))


def missing_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows, missing cells per column, missing share and percentage."""
    share = missing_share(df, columns)
    return df.agg(
        F.count("*").alias("n_rows"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns],
        share.alias("mf1"),
        (share * 100).alias("miss_perc"),
    )


def transfer_mask(masked: DataFrame, target: DataFrame, columns: list[str], row_id: str = ROW_ID) -> DataFrame:
    """Blank the cells of ``target`` that are missing in ``masked``."""
    m = masked.select(F.col(row_id), *[F.col(c).isNull().alias(f"__m_{c}") for c in columns])
    out = target.join(m, row_id)
    return out.withColumns({c: F.when(~F.col(f"__m_{c}"), F.col(c)) for c in columns}).drop(*[f"__m_{c}" for c in columns])
