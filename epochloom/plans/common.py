"""Views on the given tables that several queries share, in Spark and in the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epochloom.functions.probability import PROBABILITIES, valid_probabilities
from epochloom.sources.tables import clean_table, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL it is checked against."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


PROBS = list(PROBABILITIES)
HYP_COLUMNS = ["recording_id", "subject", "session", "condition", "block_id", "epoch", "stager", "channel_set", "electrode", "experimental_label", "absolute_start", "absolute_end", *PROBS]
BANDS = [f"bp_rel_{b}" for b in ("delta", "theta", "alpha", "sigma", "beta", "gamma")]
FEATURES = [*BANDS, "specparam_exponent", "yasa_eeg_std"]
FEATURE_COLUMNS = ["recording_id", "subject", "session", "condition", "block_id", "epoch", "electrode", "el_10_20", "absolute_start", "absolute_end", "experimental_label", *FEATURES]


def hyp(spark: SparkSession, folder: str) -> DataFrame:
    """Hypnodensity rows with valid probabilities, each once however often it was delivered."""
    return table(spark, folder, "hypnodensities").where(valid_probabilities(PROBS)).select(*HYP_COLUMNS).distinct()


def feats(spark: SparkSession, folder: str) -> DataFrame:
    """Feature rows with NaN as NULL, each once."""
    return clean_table(spark, folder, "features").select(*FEATURE_COLUMNS).distinct()


def spectrum(spark: SparkSession, folder: str) -> DataFrame:
    return clean_table(spark, folder, "spectra").select("recording_id", "subject", "condition", "block_id", "epoch", "electrode", "frequency_hz", "power").distinct()


_SUM = " + ".join(PROBS)
_VALID = " AND ".join(f"{p} BETWEEN 0 AND 1" for p in PROBS) + f" AND abs({_SUM} - 1.0) <= 1e-5"


def nn(c: str) -> str:
    return f"CASE WHEN NOT isnan({c}) THEN {c} END"


H = f"h AS (SELECT DISTINCT {', '.join(HYP_COLUMNS)} FROM hypnodensities WHERE {_VALID})"
FT = f"f AS (SELECT DISTINCT {', '.join(c if c not in FEATURES and c not in ('absolute_start', 'absolute_end') else f'{nn(c)} AS {c}' for c in FEATURE_COLUMNS)} FROM features)"
SP = f"sp AS (SELECT DISTINCT recording_id, subject, condition, block_id, epoch, electrode, frequency_hz, {nn('power')} AS power FROM spectra)"


def each(template: str, names: list[str], sep: str = ", ") -> str:
    """The template with {c} replaced by every name."""
    return sep.join(template.replace("{c}", n) for n in names)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), digits) for c in columns})


def mean_of_millionths(column: str):
    """Mean of a column that carries six decimals, from whole millionths: the same in any row order."""
    return F.sum(F.round(F.col(column) * 1000000).cast("long")) / (F.count(column) * 1000000)


def mean_sql(column: str, condition: str = "") -> str:
    keep = f" FILTER ({condition})" if condition else ""
    return f"sum(CAST(round({column} * 1000000) AS BIGINT)){keep}::DOUBLE / nullif(count({column}){keep} * 1000000, 0)"
