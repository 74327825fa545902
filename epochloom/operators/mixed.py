"""Mixed-effects models from sufficient statistics.

y = X b + subject intercept + component within subject + noise, by maximum likelihood. All the
likelihood needs are counts, sums and cross-products per (subject, component): one aggregation over
any number of rows. What is solved per model is one row per (subject, component), in numpy.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _profile(theta1: float, theta2: float, n: np.ndarray, s: np.ndarray, ss: np.ndarray, subject: np.ndarray, n_subjects: int):
    """Log-likelihood at given variance ratios, with coefficients, noise variance and information.

    n and s are counts and sums per component, ss the cross-products of all rows."""
    d = 1 + n * theta2
    z = ss - (s * (theta2 / d)[:, None]).T @ s
    u = np.zeros((n_subjects, s.shape[1]))
    np.add.at(u, subject, s / d[:, None])
    w = np.bincount(subject, weights=n / d, minlength=n_subjects)
    z -= (u * (theta1 / (1 + theta1 * w))[:, None]).T @ u
    logdet = np.log(d).sum() + np.log1p(theta1 * w).sum()
    a, b, c = z[:-1, :-1], z[:-1, -1], z[-1, -1]
    beta = np.linalg.solve(a, b)
    total = n.sum()
    sigma2 = max(float(c - b @ beta), 1e-300) / total
    return -0.5 * (total * math.log(2 * math.pi * sigma2) + logdet + total), beta, sigma2, a


def _golden(f, low: float, high: float, rounds: int = 45) -> float:
    g = (math.sqrt(5) - 1) / 2
    a, b = high - g * (high - low), low + g * (high - low)
    fa, fb = f(a), f(b)
    for _ in range(rounds):
        if fa >= fb:
            high, b, fb = b, a, fa
            a = high - g * (high - low)
            fa = f(a)
        else:
            low, a, fa = a, b, fb
            b = low + g * (high - low)
            fb = f(b)
    return (low + high) / 2


def fit(n: np.ndarray, s: np.ndarray, ss: np.ndarray, subject: np.ndarray, nested: bool) -> dict:
    """Maximise over the two variance ratios, by turns on a logarithmic scale; 0 is tried as well."""
    codes, subject = np.unique(subject, return_inverse=True)
    ss = ss.sum(axis=0)
    theta = [1.0, 1.0 if nested else 0.0]
    at = lambda t: _profile(t[0], t[1], n, s, ss, subject, len(codes))
    best, converged = -math.inf, False
    for _ in range(100):
        for k in range(1 + nested):
            def along(x: float, k: int = k) -> float:
                trial = list(theta)
                trial[k] = math.exp(x)
                return at(trial)[0]

            x = _golden(along, -14.0, 8.0)
            zero = list(theta)
            zero[k] = 0.0
            theta[k] = 0.0 if at(zero)[0] >= along(x) else math.exp(x)
        now = at(theta)[0]
        if abs(now - best) < 1e-9 * (1 + abs(now)):
            converged = True
            break
        best = now
    ll, beta, sigma2, a = at(theta)
    return {"loglik": ll, "beta": beta, "se": np.sqrt(np.diag(sigma2 * np.linalg.inv(a))), "sigma2": sigma2, "theta": theta, "converged": converged, "n_subjects": len(codes)}


def fit_mixed_models(
    df: DataFrame, outcomes: list[str], fixed: dict[str, Column], subject: str = "subject", component: str | None = None, strata: tuple[str, ...] = ("stager",), least: int = 10,
) -> DataFrame:
    """One model per stratum and outcome, as a table of coefficients.

    (strata, outcome, term, estimate, se, z, p_value, ci_low, ci_high, n_used, n_subjects, loglik, aic,
    subject_variance, component_variance, noise_variance, status). ``fixed`` maps term names to numeric
    columns; an intercept is added. Rows with a missing outcome, term or subject are left out. status:
    'ok', 'not_converged', 'too_few_observations' or 'fit_failed'; a failure is a row with NULL figures.
    """
    terms = ["intercept", *fixed]
    p = len(terms)
    clean = lambda c: F.when(~F.isnan(c.cast("double")), c.cast("double"))
    rows = df.where(F.col(subject).isNotNull()).select(
        *strata, F.col(subject).cast("string").alias("_s"), (F.col(component).cast("string") if component else F.lit("")).alias("_c"), F.lit(1.0).alias("_x0"),
        *[clean(c).alias(f"_x{i + 1}") for i, c in enumerate(fixed.values())],
        F.explode(F.array(*[F.struct(F.lit(o).alias("outcome"), clean(F.col(o)).alias("y")) for o in outcomes])).alias("_o"),
    ).select("*", "_o.outcome", F.col("_o.y").alias(f"_x{p}")).drop("_o").na.drop(subset=[f"_x{i}" for i in range(p + 1)])
    sums = [F.sum(f"_x{i}").alias(f"_s{i}") for i in range(p + 1)] + [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_q{i}_{j}") for i in range(p + 1) for j in range(i, p + 1)]
    stats = rows.groupBy(*strata, "outcome", "_s", "_c").agg(F.count(F.lit(1)).cast("double").alias("_n"), *sums)

    def solve(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["_s", "_c"])
        n = g["_n"].to_numpy()
        s = g[[f"_s{i}" for i in range(p + 1)]].to_numpy()
        ss = np.empty((len(g), p + 1, p + 1))
        for i in range(p + 1):
            for j in range(i, p + 1):
                ss[:, i, j] = ss[:, j, i] = g[f"_q{i}_{j}"].to_numpy()
        total, status, r = int(n.sum()), "ok", None
        if total < least:
            status = "too_few_observations"
        else:
            try:
                r = fit(n, s, ss, g["_s"].to_numpy(), component is not None)
                if not np.isfinite(r["se"]).all():
                    r, status = None, "fit_failed"
                elif not r["converged"]:
                    status = "not_converged"
            except (np.linalg.LinAlgError, ValueError, FloatingPointError):
                status = "fit_failed"
        out = pd.DataFrame({"term": terms if r else [None]})
        for name, value in zip([*strata, "outcome"], key, strict=True):
            out[name] = value
        b, se = (r["beta"], r["se"]) if r else ([np.nan], [np.nan])
        out["estimate"], out["se"] = b, se
        out["z"] = out["estimate"] / out["se"]
        out["p_value"] = [math.erfc(abs(z) / math.sqrt(2)) if z == z else np.nan for z in out["z"]]
        out["ci_low"], out["ci_high"] = out["estimate"] - 1.959963984540054 * out["se"], out["estimate"] + 1.959963984540054 * out["se"]
        out["n_used"], out["n_subjects"] = total, r["n_subjects"] if r else g["_s"].nunique()
        out["loglik"] = r["loglik"] if r else np.nan
        out["aic"] = 2 * (p + 2 + (component is not None)) - 2 * r["loglik"] if r else np.nan
        out["subject_variance"] = r["theta"][0] * r["sigma2"] if r else np.nan
        out["component_variance"] = r["theta"][1] * r["sigma2"] if r else np.nan
        out["noise_variance"] = r["sigma2"] if r else np.nan
        out["status"] = status
        return out

    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in strata)
    schema = f"{kinds + ', ' if strata else ''}outcome string, term string, estimate double, se double, z double, p_value double, ci_low double, ci_high double, n_used long, n_subjects long, loglik double, aic double, subject_variance double, component_variance double, noise_variance double, status string"
    return stats.groupBy(*strata, "outcome").applyInPandas(solve, schema)


def spline_terms(name: str, x: Column, knots: list[float], degree: int = 3) -> dict[str, Column]:
    """Fixed effects of a smooth curve in x: its powers and one truncated power per knot.

    They span the splines of that degree with these knots; x is scaled by the largest knot to keep the
    cross-products in range.
    """
    scale = max(map(abs, knots), default=1.0) or 1.0
    z = x / scale
    powers = {f"{name}^{k}": F.pow(z, F.lit(float(k))) for k in range(1, degree + 1)}
    return powers | {f"{name}>{k:g}": F.pow(F.greatest(z - k / scale, F.lit(0.0)), F.lit(float(degree))) for k in knots}


def chi_square_tail(x: float, df: int) -> float:
    """Upper tail of the chi-square distribution, by the series or the continued fraction of the gamma function."""
    if x <= 0:
        return 1.0
    a, h = df / 2, x / 2
    front = math.exp(-h + a * math.log(h) - math.lgamma(a))
    if h < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= h / k
            total += term
        return max(0.0, 1 - front * total)
    b = h + 1 - a
    c, d = 1e300, 1 / b
    value = d
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def likelihood_ratio(small: DataFrame, large: DataFrame, keys: list[str], extra_terms: int) -> DataFrame:
    """(keys, statistic, p_value, delta_aic) comparing nested models fitted to the same rows."""
    one = lambda d, tag: d.groupBy(*keys).agg(F.first("loglik").alias(f"ll_{tag}"), F.first("aic").alias(f"aic_{tag}"))

    @F.pandas_udf("double")
    def tail(x: pd.Series) -> pd.Series:
        return x.map(lambda v: chi_square_tail(v, extra_terms) if v == v else np.nan)

    both = one(small, "small").join(one(large, "large"), keys)
    statistic = 2 * (F.col("ll_large") - F.col("ll_small"))
    return both.select(*keys, statistic.alias("statistic"), tail(statistic).alias("p_value"), (F.col("aic_large") - F.col("aic_small")).alias("delta_aic"))
