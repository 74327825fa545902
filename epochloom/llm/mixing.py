"""Problem 8: mix sources to target weights, by capped water-filling over their token counts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.llm.bpe import VOCABULARY, count_tokens
from epochloom.session import cut

_BUCKETS = 4096
#: The table of targets is a configuration: more sources than this are refused.
MOST_SOURCES = 10_000


@dataclass(frozen=True)
class Share:
    """One source: its weight, its tokens and how often a document may be repeated."""

    source: str
    weight: float
    tokens: int
    repeats: int

    @property
    def cap(self) -> float:
        return float(self.tokens) * max(self.repeats, 0)


def default_total(shares: list[Share], shortfall: float) -> float:
    """The largest total at which sources that run out leave at most ``shortfall`` of the weight.

    Sources without tokens can't give anything at any total and don't count here.
    """
    live = [s for s in shares if s.cap > 0 and s.weight > 0]
    if not live:
        return 0.0
    lack = lambda total: sum(max(0.0, s.weight - s.cap / total) for s in live)
    most = sum(s.cap for s in live)
    low, high = 0.0, most
    if lack(most) <= shortfall:
        return most
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if lack(middle) <= shortfall else (low, middle)
    return low


def water_fill(shares: list[Share], total: float) -> dict[str, float]:
    """Tokens per source: its weight of the total, clamped at its cap, the excess going to the others
    in proportion to their weights until nothing is above its cap (or all are at it)."""
    given: dict[str, float] = {}
    free = [s for s in shares if s.weight > 0]
    left = total
    while free:
        weight = sum(s.weight for s in free)
        full = [s for s in free if left * s.weight / weight >= s.cap]
        if not full:
            given |= {s.source: left * s.weight / weight for s in free}
            break
        given |= {s.source: s.cap for s in full}
        left -= sum(s.cap for s in full)
        free = [s for s in free if s not in full]
    return given | {s.source: 0.0 for s in shares if s.source not in given}


def repetitions(planned: float, tokens: int) -> tuple[int, float]:
    """How many whole times a source of ``tokens`` goes into ``planned`` tokens, and the tokens still missing then."""
    if not tokens:
        return 0, 0.0
    # Just under k times, by rounding only, is k times.
    whole = int(planned / tokens + 1e-9)
    return whole, max(0.0, planned - whole * tokens)


def within_plan(chosen: DataFrame, report: DataFrame, docs: DataFrame) -> DataFrame:
    """What a mixture must keep, per source: (source, target_share, max_repeats, has_documents, within_repeats, near_plan).

    No document is used more than max_repeats times (a copy of a row counts with it), and a source's tokens
    are off its plan by no more than one bucket of its documents and one document, 2 / 4,096 of it or
    the longest document of the source.
    """
    used = chosen.groupBy("source").agg(F.max("repeats").alias("most"), F.max("n_tokens").alias("longest"))
    present = docs.groupBy("source").agg(F.lit(True).alias("has_documents"))
    both = report.join(used, "source", "left").join(present, "source", "left")
    off = F.abs(F.col("actual_tokens") - F.col("planned_tokens"))
    near = off <= F.greatest(F.col("available_tokens") * (2 / _BUCKETS), 8 * F.coalesce("longest", F.lit(0)))
    return both.select("source", "target_share", "max_repeats", F.coalesce("has_documents", F.lit(False)).alias("has_documents"), (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_plan"))


def mix_sources(
    docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, shortfall: float = 0.05, seed: int = 17, vocabulary: str = VOCABULARY,
) -> tuple[DataFrame, DataFrame]:
    """Choose documents so that every source has its share of all tokens.

    ``docs`` has doc_id, source, text; ``targets`` source, target_share, max_repeats. Returns the
    chosen documents (doc_id, source, n_tokens, repeats) and the report (source, target_share,
    max_repeats, available_tokens, planned_tokens, actual_tokens, n_documents, actual_share).

    A source that is to give r times its tokens uses every document floor(r) times and, by a seeded
    hash of doc_id, the missing fraction once more. Only per-bucket token sums (4,096 a source) are
    ordered, so a hot source is never sorted as a whole; the fraction is met to about one bucket.
    Documents of NULL or unlisted sources are left out; empty and NULL texts have no tokens and follow
    their source; a target without documents gives nothing and its weight goes to the others.
    Rows with one doc_id are drawn alike. Target rows with a NULL source or share are ignored.
    """
    # The targets are small by their nature; the bound is checked, not assumed.
    wanted = targets.where("source IS NOT NULL AND target_share IS NOT NULL").groupBy("source").agg(F.max("target_share").cast("double").alias("target_share"), F.coalesce(F.max("max_repeats"), F.lit(1)).cast("int").alias("max_repeats"))
    listed = wanted.limit(MOST_SOURCES + 1).collect()
    if len(listed) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the mixture")
    spark = docs.sparkSession
    names = spark.createDataFrame([(r["source"],) for r in listed], "source string")
    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(_BUCKETS)).cast("int")
    kept = docs.join(F.broadcast(names), "source", "left_semi")
    sized = cut(count_tokens(kept, ["doc_id", "source"], "text", vocabulary).withColumn("bucket", bucket))
    by_bucket = sized.groupBy("source", "bucket").agg(F.sum("n_tokens").alias("tokens"))
    totals = {r["source"]: r["tokens"] for r in by_bucket.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()}
    shares = [Share(r["source"], max(r["target_share"], 0.0), int(totals.get(r["source"]) or 0), r["max_repeats"]) for r in listed]
    total = default_total(shares, shortfall) if total_tokens is None else float(total_tokens)
    given = water_fill(shares, total)
    plan = spark.createDataFrame(
        [(s.source, s.weight, s.repeats, s.tokens, given[s.source], *repetitions(given[s.source], s.tokens)) for s in shares],
        "source string, target_share double, max_repeats int, available_tokens long, planned_tokens double, whole int, extra double",
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    drawn = (
        by_bucket.withColumn("upto", F.sum("tokens").over(before)).join(F.broadcast(plan), "source")
        .select("source", "bucket", F.least(F.col("whole") + F.when(F.col("upto") - F.col("tokens") / 2 < F.col("extra"), 1).otherwise(0), F.col("max_repeats")).alias("repeats"))
    )
    chosen = sized.join(drawn, ["source", "bucket"]).where("repeats > 0").select("doc_id", "source", "n_tokens", "repeats")
    sums = chosen.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"), F.count(F.lit(1)).alias("n_documents"))
    report = plan.drop("whole", "extra").join(sums, "source", "left").na.fill(0, ["actual_tokens", "n_documents"])
    everything = F.sum("actual_tokens").over(Window.partitionBy())
    return chosen, report.withColumn("actual_share", F.try_divide(F.col("actual_tokens").cast("double"), everything.cast("double")))
