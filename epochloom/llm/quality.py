"""Problem 9: text statistics per document, outlier scores from exact per-language ranks, and the
documents that aren't prose.

One pass counts in how many documents of its language each word occurs, one computes the statistics;
both work on whole Arrow batches of texts. Each statistic is ranked within its language by a
range-partitioned sort of its distinct values with partition offsets, and the tail probabilities of
all statistics add up to an outlier score. Only documents whose score reaches SUSPECT are read again
and judged line by line as list, table or junk; all others are prose.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from epochloom.session import cut

#: Which tail of a statistic is suspicious.
STATISTICS = {"end_share": "low", "open_lines": "high", "open_ratio": "high", "words_per_line": "low", "symbol_ratio": "high", "mean_word_length": "both", "readable_share": "low"}
#: Documents from this score on are judged line by line. Of 100,000 documents of which 16 % are lists, tables or
#: junk by the rules below, the scores of 22 % reach it, and those of all that the rules call so.
SUSPECT = 12.0
#: Tails of a language lean on those of all documents as if it had so many documents more.
PRIOR_DOCUMENTS = 100
#: Up to so many common words are broadcast; more are matched by a join.
MOST_BROADCAST_WORDS = 1_000_000
#: A last word of more letters isn't a word cut short.
LONGEST_WORD = 30

_IDEOGRAMS = r"\x{3041}-\x{30ff}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{e01}-\x{e4e}\x{20000}-\x{3134f}"
_BREAKS = r"\r\n?|[\x{b}\x{c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
_MARKS = r"[-*+•–—·▪◦‣○●►→]|\[[ xX✓✔]?\]|[☐☑☒✓✔]|\(?\d{1,4}[.)]|\(?\p{L}[.)]|\(?[ivxIVX]{1,5}[.)]|§\s?\d+|[①-⑳]"
_STOPS, _CLOSERS = ".!?…。！？．؟", "\"'»”’)\\]」』）"
_LINE, _SYMBOL, _DIGIT = r"(?m)^.*[^\s\p{Z}]", r"[^\p{L}\p{M}\p{N}\s\p{Z}]", r"\p{Nd}"
_ENDED = rf"(?m)[{_STOPS}](?:[ \t]?[{_CLOSERS}])*[\p{{So}}\p{{Sk}}\p{{Mn}}\p{{Zs}}\t]*$"

_IDEOGRAM = regex.compile(r"[ぁ-ヿ㐀-䶿一-鿿ก-๎\U00020000-\U0003134f]")
_TOKEN = regex.compile(rf"(?V1){_IDEOGRAM.pattern}|[\p{{L}}--{_IDEOGRAM.pattern}][[\p{{L}}\p{{M}}]--{_IDEOGRAM.pattern}]*")
_MARK = regex.compile(rf"^\s*(?:{_MARKS})\s+")
_END = regex.compile(rf"[{_STOPS}](?:\s?[{_CLOSERS}])*$")
_INNER_END = regex.compile(r"[.!?…]\s+\p{Lu}|[。！？].")
_TRAILING = regex.compile(r"(?r)[\p{So}\p{Sk}\p{Cf}\p{Mn}\s]+$")
_INVISIBLE = regex.compile(r"\p{Cf}+")
_NUMBER = regex.compile(r"^[-+~<>≈]?(?:0|0?[.,]\d+|0[.,:/]\d[\d.,:/]*|[1-9][\d.,:/]*)\s?%?$|^-$")
_SEPARATORS = [regex.compile(p) for p in (r"\|", "│", r"\t", ";", ",", r" {2,}")]
_PLAIN_SEPARATORS = 4  # from here on a separator also occurs in prose


def clean(texts: pa.Array) -> pa.Array:
    """Texts with NULL as empty, one kind of line end and no invisible characters."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    return pc.replace_substring_regex(pc.replace_substring_regex(texts, _BREAKS, "\n"), r"\p{Cf}+", "")


@dataclass
class Words:
    """The words of many texts one after the other: the text of each, its number among the distinct ones, and those."""

    row: np.ndarray
    code: np.ndarray
    distinct: pa.Array

    @property
    def lengths(self) -> np.ndarray:
        return pc.utf8_length(self.distinct).to_numpy(zero_copy_only=False)


def words_of(texts: pa.Array) -> Words:
    """Lower-case words of clean texts without accents, mark-up tags left out; ideograms one by one."""
    # Strayed accents are damage to a word, not another word. What is looked up loses the same marks.
    bare = pc.replace_substring_regex(pc.utf8_normalize(texts, "NFKD"), r"\p{M}+", "")
    hangul = pc.match_substring_regex(texts, r"[\x{ac00}-\x{d7a3}]")
    if pc.any(hangul).as_py():
        bare = pc.if_else(hangul, texts, bare)  # taken apart, a syllable would count as two or three letters
    plain = pc.replace_substring_regex(pc.utf8_lower(bare), r"</?[a-z][^<>\n]{0,80}>", " ")
    lists = pc.split_pattern_regex(pc.replace_substring_regex(plain, f"([{_IDEOGRAMS}])", r" \1 "), r"[^\p{L}\p{M}]+")
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    words = lists.values.dictionary_encode()
    code = words.indices.to_numpy()
    some = (pc.utf8_length(words.dictionary).to_numpy(zero_copy_only=False) > 0)[code] if len(code) else np.zeros(0, bool)
    return Words(row[some], code[some], words.dictionary)


def _distinct(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct numbers and how often each occurs."""
    numbers = np.sort(numbers)
    first = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1]))) if len(numbers) else np.zeros(0, int)
    return numbers[first], np.diff(np.append(first, len(numbers)))


def _slices(batch: pa.RecordBatch, most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n_docs, low, high) of each slice; word '' counts the texts that have words; low and high are the least and greatest text hash."""
    for batch in batches:
        for part in _slices(batch):
            w = words_of(clean(part.column("text")))
            k = len(w.distinct)
            langs = part.column("lang").dictionary_encode(null_encoding="encode")
            lang, hashes = langs.indices.to_numpy(), part.column("text_hash").to_numpy()
            whole = np.unique(w.row)
            can_be = (w.lengths > 1) | pc.match_substring_regex(w.distinct, f"[{_IDEOGRAMS}]").to_numpy(zero_copy_only=False)
            pairs, _ = _distinct((w.row * k + w.code)[can_be[w.code]])
            row, code = np.concatenate((pairs // max(k, 1), whole)), np.concatenate((pairs % max(k, 1), np.full(len(whole), k)))
            group = lang[row].astype(np.int64) * (k + 1) + code
            order = np.argsort(group, kind="stable")
            group, seen = group[order], hashes[row[order]]
            first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))) if len(group) else np.zeros(0, int)
            names = pa.concat_arrays([w.distinct, pa.array([""], w.distinct.type)]).take(pa.array(group[first] % (k + 1)))
            columns = [langs.dictionary.take(pa.array(group[first] // (k + 1))), names.cast(pa.string()), pa.array(np.diff(np.append(first, len(group)))), pa.array(np.minimum.reduceat(seen, first) if len(first) else seen), pa.array(np.maximum.reduceat(seen, first) if len(first) else seen)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "n_docs", "low", "high"])


def _texts(docs: DataFrame, doc_id: str, lang: str, text: str) -> DataFrame:
    t = F.col(text).cast("string")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.xxhash64(t).alias("text_hash"), t.alias("text"))


def common_words(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(word) that are common in at least one language.

    Common in a language of N documents with words are those in 1 + N / 10,000 + sqrt(N) / 32 of them or more:
    two of a hundred, nearly four of five thousand, one in nearly ten thousand of very many, by one rule at
    every size. Copies of one text alone make no word common.
    """
    counts = _texts(docs, text, lang, text).select("lang", "text_hash", "text").mapInArrow(_count_words, "lang string, word string, n_docs long, low long, high long")
    summed = cut(counts.groupBy("lang", "word").agg(F.sum("n_docs").alias("n_docs"), F.min("low").alias("low"), F.max("high").alias("high")))
    sizes = summed.where("word = ''").select(F.col("lang").alias("_lang"), F.col("n_docs").cast("double").alias("n"))
    met = summed.where("word <> '' AND low < high").join(sizes, F.col("lang").eqNullSafe(F.col("_lang")))
    return met.where(F.col("n_docs") >= 1 + F.col("n") / 10_000 + F.sqrt("n") / 32).select("word").distinct()


#: Statistics with their Spark types, in order.
_FIELDS = {
    "n_words": "long", "n_lines": "long", "n_dense": "long", "open_lines": "long", "mean_word_length": "double", "symbol_ratio": "double", "digit_ratio": "double",
    "end_share": "double", "open_ratio": "double", "words_per_line": "double", "common_share": "double", "readable_share": "double",
}
#: Counts that the shares of common words are made of.
_COUNTS = ("n_known", "known_letters", "cut_off", "dots")


def _count(texts: pa.Array, pattern: str) -> np.ndarray:
    return pc.count_substring_regex(texts, pattern).to_numpy(zero_copy_only=False).astype(np.int64)


def _plain_statistics(texts: pa.Array, words: Words) -> dict[str, np.ndarray]:
    """All statistics of clean texts that don't ask which words are common, and the trailing dots."""
    n = len(texts)
    length = lambda a: pc.utf8_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    dense, lines = length(pc.replace_substring_regex(texts, r"[\s\p{Z}]+", "")), _count(texts, _LINE)
    n_words = np.bincount(words.row, minlength=n)
    letters = np.bincount(words.row, weights=words.lengths[words.code], minlength=n)
    some, per_line = np.maximum(dense, 1), np.maximum(lines, 1)
    end, ended = pc.utf8_rtrim_whitespace(texts), _count(texts, _ENDED)
    return {
        "n_words": n_words, "n_lines": lines, "n_dense": dense, "open_lines": lines - ended, "mean_word_length": letters / np.maximum(n_words, 1), "symbol_ratio": _count(texts, _SYMBOL) / some, "digit_ratio": _count(texts, _DIGIT) / some,
        "end_share": ended / per_line, "open_ratio": (lines - ended) / (n_words + 1), "words_per_line": n_words / per_line,
        "dots": length(end) - length(pc.utf8_rtrim(end, ".…")),
    }


def _last(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The texts with words, and the position of the last word of each."""
    ends = np.cumsum(np.bincount(words.row, minlength=n)) - 1
    rows = np.unique(words.row)
    return rows, ends[rows]


def _shares(stats: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """``stats`` with the shares of common words in place of the counts they come from."""
    out = {k: v for k, v in stats.items() if k not in _COUNTS}
    out["common_share"] = stats["n_known"] / np.maximum(stats["n_words"], 1)
    # The last word may be cut short; if nobody knows it, it speaks neither for nor against the text, unless no word is so long.
    judged = stats["n_dense"] - np.where((stats["cut_off"] > 0) & (stats["cut_off"] <= LONGEST_WORD), stats["cut_off"] + stats["dots"], 0)
    out["readable_share"] = np.where(judged > 0, np.minimum(1.0, stats["known_letters"] / np.maximum(judged, 1)), 1.0)
    return out


def _batch(part: pa.RecordBatch, stats: dict[str, np.ndarray]) -> pa.RecordBatch:
    blank = pa.array(stats["n_dense"] == 0)
    null = lambda v: pc.if_else(blank, pa.scalar(None, v.type), v)
    columns = [null(pa.array(stats[k], pa.int64() if t == "long" else pa.float64())) for k, t in _FIELDS.items()]
    return pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "text_hash")), *columns], names=["doc_id", "lang", "text_hash", *_FIELDS])


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text", most_broadcast: int = MOST_BROADCAST_WORDS) -> DataFrame:
    """One row per document: (doc_id, lang, text_hash, statistics...), NULL statistics for NULL, empty and blank texts.

    Whole texts are measured. A word is known if it is common in any language, whatever the document's
    label. Repeated rows are measured each; NULL languages and ids are kept.
    """
    vocabulary = cut(common_words(docs, lang, text))
    rows = _texts(docs, doc_id, lang, text)
    head = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, lang string, text_hash long"
    schema = ", ".join([head, *[f"{k} {v}" for k, v in _FIELDS.items()]])
    if vocabulary.count() <= most_broadcast:
        shared = docs.sparkSession.sparkContext.broadcast([r["word"] for r in vocabulary.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            common = pa.array(shared.value, pa.large_string())
            for batch in batches:
                for part in _slices(batch):
                    texts = clean(part.column("text"))
                    words, n = words_of(texts), part.num_rows
                    known = pc.is_in(words.distinct, value_set=common).to_numpy(zero_copy_only=False)[words.code]
                    stats, lengths = _plain_statistics(texts, words), words.lengths[words.code]
                    stats["n_known"], stats["known_letters"] = np.bincount(words.row, weights=known, minlength=n), np.bincount(words.row, weights=known * lengths, minlength=n)
                    stats["cut_off"] = np.zeros(n, np.int64)
                    with_words, last = _last(words, n)
                    stats["cut_off"][with_words] = np.where(known[last], 0, lengths[last])
                    yield _batch(part, _shares(stats))

        return rows.mapInArrow(run, schema)

    # Too many words to broadcast: each document's distinct words meet them in a join; no text is shuffled.
    plain = [k for k in _FIELDS if k not in ("common_share", "readable_share")]
    found_ddl = "array<struct<word: string, n: long, letters: long, last: boolean>>"
    found_type = pa.list_(pa.struct([("word", pa.string()), ("n", pa.int64()), ("letters", pa.int64()), ("last", pa.bool_())]))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                texts = clean(part.column("text"))
                words, n = words_of(texts), part.num_rows
                stats, k = _plain_statistics(texts, words), len(words.distinct)
                pairs, times = _distinct(words.row * k + words.code)
                row, code = pairs // max(k, 1), pairs % max(k, 1)
                _, last = _last(words, n)
                is_last = np.isin(pairs, words.row[last] * k + words.code[last])
                structs = pa.StructArray.from_arrays([words.distinct.take(pa.array(code)).cast(pa.string()), pa.array(times, pa.int64()), pa.array(words.lengths[code], pa.int64()), pa.array(is_last)], fields=list(found_type.value_type))
                found = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), structs)
                columns = [pa.array(stats[c], pa.int64() if _FIELDS.get(c, "long") == "long" else pa.float64()) for c in [*plain, "dots"]]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "lang", "text_hash")), *columns, found], names=["doc_id", "lang", "text_hash", *plain, "dots", "found"])

    measured = rows.mapInArrow(split, ", ".join([head, *[f"{c} {_FIELDS.get(c, 'long')}" for c in [*plain, "dots"]], f"found {found_ddl}"])).withColumn("row", F.monotonically_increasing_id())
    every = measured.select("*", F.explode_outer("found").alias("w")).drop("found").join(vocabulary.select(F.col("word").alias("_known")), F.col("w.word") == F.col("_known"), "left")
    known, least = F.col("_known").isNotNull(), lambda c: F.coalesce(F.sum(c), F.lit(0))
    gathered = every.groupBy("row").agg(
        *[F.first(c).alias(c) for c in ["doc_id", "lang", "text_hash", *plain, "dots"]], least(F.when(known, F.col("w.n"))).alias("n_known"),
        least(F.when(known, F.col("w.n") * F.col("w.letters"))).alias("known_letters"), least(F.when(~known & F.col("w.last"), F.col("w.letters"))).alias("cut_off"),
    )
    judged = F.col("n_dense") - F.when(F.col("cut_off").between(1, LONGEST_WORD), F.col("cut_off") + F.col("dots")).otherwise(0)
    shares = {
        "common_share": F.col("n_known") / F.greatest("n_words", F.lit(1)),
        "readable_share": F.when(judged > 0, F.least(F.lit(1.0), F.col("known_letters") / F.greatest(judged, F.lit(1)))).otherwise(1.0),
    }
    blank = F.col("n_dense") == 0
    return gathered.select("doc_id", "lang", "text_hash", *[F.when(~blank, shares.get(k, F.col(k))).cast(t).alias(k) for k, t in _FIELDS.items()])


def counted_values(values: DataFrame) -> DataFrame:
    """(statistic, lang, value, n_equal, part): distinct values from (statistic, lang, value) rows, range-partitioned by statistic and value.

    Ties (a third of all rows may share a value) meet as one row per language. NULL languages are a language;
    NULL values aren't counted.
    """
    counted = values.where("value IS NOT NULL").groupBy("statistic", "lang", "value").agg(F.count(F.lit(1)).alias("n_equal"))
    # Written once: offsets and rows must come from the same partition bounds.
    return cut(counted.repartitionByRange("statistic", "value").withColumn("part", F.spark_partition_id()))


def exact_ranks(ordered: DataFrame) -> DataFrame:
    """(statistic, lang, value, n_below, n_equal, n_total, all_below, all_equal, all_total) of counted_values().

    Each range partition numbers its own rows, and the offset of a partition is the sum of those before
    it: within the language, and over all.
    """
    sums = ordered.groupBy("statistic", "lang", "part").agg(F.sum("n_equal").alias("n_part"))
    overall = sums.groupBy("statistic", "part").agg(F.sum("n_part").alias("all_part"))
    whole = Window.partitionBy("statistic")
    offsets = sums.select("statistic", "lang", "part", (F.sum("n_part").over(Window.partitionBy("statistic", "lang").orderBy("part")) - F.col("n_part")).alias("offset"), F.sum("n_part").over(Window.partitionBy("statistic", "lang")).alias("n_total"))
    all_offsets = overall.select("statistic", "part", (F.sum("all_part").over(whole.orderBy("part")) - F.col("all_part")).alias("all_offset"), F.sum("all_part").over(whole).alias("all_total"))
    inside = Window.partitionBy("statistic", "part")
    local = ordered.withColumns({
        "all_upto": F.sum("n_equal").over(inside.orderBy("value")), "all_equal": F.sum("n_equal").over(Window.partitionBy("statistic", "part", "value")),
        "upto": F.sum("n_equal").over(Window.partitionBy("statistic", "part", "lang").orderBy("value")),
    })
    o = offsets.join(all_offsets, ["statistic", "part"]).select(F.col("statistic").alias("_s"), F.col("lang").alias("_l"), F.col("part").alias("_p"), "offset", "n_total", "all_offset", "all_total")
    joined = local.join(o, (local["statistic"] == o["_s"]) & local["lang"].eqNullSafe(o["_l"]) & (local["part"] == o["_p"]))
    return joined.select(
        "statistic", "lang", "value", (F.col("offset") + F.col("upto") - F.col("n_equal")).alias("n_below"), "n_equal", "n_total",
        (F.col("all_offset") + F.col("all_upto") - F.col("all_equal")).alias("all_below"), "all_equal", "all_total",
    )


def _hot_values(ordered: DataFrame) -> DataFrame:
    """(_hs, _hl, _hv): values with at least a two-thousandth of the rows of their statistic."""
    totals = ordered.groupBy("statistic").agg(F.sum("n_equal").alias("n"))
    hot = ordered.join(F.broadcast(totals), "statistic").where(F.col("n_equal") * 2000 >= F.col("n"))
    return hot.select(F.col("statistic").alias("_hs"), F.col("lang").alias("_hl"), F.col("value").alias("_hv"))


def outlier_scores(stats: DataFrame, statistics: dict[str, str] = STATISTICS, prior: int = PRIOR_DOCUMENTS, salts: int = 8) -> DataFrame:
    """``stats`` with ``score``, the sum over the statistics of the squared negative log tail probability.

    Squares let one or two far tails count for more than many middling ones. A tail probability is the share of the language's documents at least as extreme in the statistic's
    suspicious direction ('both': twice the smaller tail); the share among all documents counts as
    ``prior`` further ones, so that a language of few documents has tails, too. A document without
    statistics scores 0.
    """
    keyed = cut(stats.withColumn("row", F.monotonically_increasing_id()))
    long = keyed.unpivot(["row", "lang"], list(statistics), "statistic", "value").where("value IS NOT NULL")
    counted = counted_values(long)
    ranks = exact_ranks(counted)
    shrunk = lambda own, every: (own + prior * every / F.col("all_total")) / (F.col("n_total") + prior)
    low = shrunk(F.col("n_below") + F.col("n_equal"), F.col("all_below") + F.col("all_equal"))
    high = shrunk(F.col("n_total") - F.col("n_below"), F.col("all_total") - F.col("all_below"))
    direction = reduce(lambda e, kv: e.when(F.col("statistic") == kv[0], F.lit(kv[1])), statistics.items(), F.when(F.lit(False), F.lit("")))
    tail = F.when(direction == "low", low).when(direction == "high", high).otherwise(F.least(F.lit(1.0), 2 * F.least(low, high)))
    # A value with at least a two-thousandth of its statistic's rows is hot: its rows meet it in ``salts`` tasks. A statistic has at
    # most 2,000 such values, so they are broadcast.
    counts = ranks.select(F.col("statistic").alias("_s"), F.col("lang").alias("_l"), F.col("value").alias("_v"), F.pow(F.log(tail), F.lit(2.0)).alias("part"), (F.col("n_equal") * 2000 >= F.col("all_total")).alias("hot"))
    lookup = counts.withColumn("_salt", F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).withColumn("_k", F.xxhash64("_s", "_l", "_v", "_salt"))
    hot = _hot_values(counted)
    salted = long.join(F.broadcast(hot), (long["statistic"] == hot["_hs"]) & long["lang"].eqNullSafe(hot["_hl"]) & (long["value"] == hot["_hv"]), "left")
    salted = salted.select("row", "statistic", "lang", "value", F.when(F.col("_hs").isNull(), 0).otherwise(F.pmod("row", F.lit(salts))).cast("int").alias("salt")).withColumn("k", F.xxhash64("statistic", "lang", "value", "salt"))
    # Partitioned and sorted by one number; what it stands for must agree, too.
    same = F.coalesce(F.col("statistic") == F.col("_s"), F.lit(False)) & F.coalesce(F.col("lang") == F.col("_l"), F.col("lang").isNull() & F.col("_l").isNull()) & F.coalesce(F.col("value") == F.col("_v"), F.lit(False))
    parts = salted.join(lookup, (F.col("k") == F.col("_k")) & same).select("row", "part")
    scores = parts.groupBy("row").agg(F.sum("part").alias("score"))
    return keyed.join(scores, "row", "left").drop("row").withColumn("score", F.coalesce("score", F.lit(0.0)))


def table_share(lines: list[str]) -> float:
    """The largest share of lines that are rows of cells set apart by the same means."""
    best = 0.0
    if len(lines) < 2:
        return best
    whole = "\n".join(lines)
    for k, separator in enumerate(_SEPARATORS):
        if not separator.search(whole):
            continue
        rows = []
        for line in lines:
            cells = [c.strip() for c in separator.split(line.strip() if k != 2 else line.strip(" "))]
            if k < 2:
                cells = cells[bool(cells and not cells[0]) : len(cells) - bool(len(cells) > 1 and not cells[-1])]
            rows.append(cells)
        counts = Counter(len(r) for r in rows if len(r) > 1)
        if not counts:
            continue
        # A margin may be an empty cell, so neighbouring counts are rows of the same table.
        common = counts.most_common(1)[0][0]
        same = [r for r in rows if len(r) > 1 and abs(len(r) - common) <= (k != _PLAIN_SEPARATORS)]
        numeric = sum(2 * sum(bool(_NUMBER.match(c)) for c in r) >= len(r) - 1 for r in same)
        short = sum(map(len, (c for r in same for c in r))) <= 30 * sum(map(len, same))
        if len(same) >= 2 and (2 * numeric >= len(same) or (k < _PLAIN_SEPARATORS and len(same) >= 3 and short)):
            best = max(best, len(same) / len(lines))
    return best


def item_share(lines: list[str]) -> float:
    """The share of lines that are separate items, not sentences; 0 below three items or among sentences."""
    bare = [_TRAILING.sub("", line) for line in lines]
    ended = [bool(_END.search(line)) for line in bare]
    items = marked = inner = 0
    for line, end in zip(bare, ended, strict=True):
        body, mark = _MARK.subn("", line)
        while (cut_more := _MARK.sub("", body)) != body:
            body = cut_more
        inner += bool(_INNER_END.search(body))
        if end or body.rstrip().endswith((":", "：")):
            continue
        n = len(_TOKEN.findall(body))
        if not n:
            continue
        wide = len(_IDEOGRAM.findall(body))
        brief = wide <= 30 and n - wide <= 12
        items += brief
        marked += bool(mark) and brief
    if marked * 2 >= items:
        items = marked  # a heading above marked items is none of them
    prose_like = marked * 2 <= items and (sum(ended) * 4 > len(lines) or inner * 10 > len(lines))
    return items / len(lines) if items >= 3 and not prose_like else 0.0


def kind_of(text: str, readable: float) -> str | None:
    """'table', 'junk' or 'list', or None for prose: most lines are rows of cells, most of the text is no
    readable word of any language (of a list of items: seven tenths), or most lines are items."""
    text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    lines = [line for line in text.splitlines() if line.strip()]
    if table_share(lines) > 0.5:
        return "table"
    listed = bool(lines) and item_share(lines) > 0.5
    if readable < (0.3 if listed else 0.5):
        return "junk"
    return "list" if listed else None


def judge(scored: DataFrame, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", suspect: float = SUSPECT) -> DataFrame:
    """Documents that aren't prose: (doc_id, kind), for scores of ``docs`` from document_statistics().

    Only documents whose score reaches ``suspect`` are read again. Equal rows come out once.
    """
    rows = _texts(docs, doc_id, text, text).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "text")
    suspects = scored.where(F.col("readable_share").isNotNull() & (F.col("score") >= suspect)).select("doc_id", "text_hash", "readable_share").distinct()
    both = suspects.join(rows, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash"))).select("doc_id", "text", "readable_share")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = [kind_of(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("readable_share").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(kinds, pa.string())], names=["doc_id", "kind"])

    return both.mapInArrow(run, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, kind string").where("kind IS NOT NULL").distinct()
