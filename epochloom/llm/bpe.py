"""Problem 7: byte-level BPE encoding of every document with a public vocabulary.

Texts are cut into words by the vocabulary's pattern; a short word keeps its part boundaries and the
rank of every adjacent pair in contiguous arrays, of which the least rank is merged again and again.
Long words, for which repeated scans would be quadratic, take a heap of the same ranks. Workers load
the vocabulary once per process, from a path that is a parameter.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed: the word pattern that belongs to the vocabulary, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
SHORT_WORD_BYTES = 96
_CACHED_WORDS = 200_000
_NEVER = 1 << 40


class Encoder:
    """Encodes texts with a rank file; a bounded cache keeps the ids of recent words."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines) if token}
        self.words = regex.compile(PATTERN)
        self.cache: dict[str, tuple[int, ...]] = {}

    def merge_short(self, word: bytes) -> list[int]:
        """Repeatedly scan the array of adjacent ranks for its minimum and delete that boundary."""
        ranks = self.ranks
        bounds = list(range(len(word) + 1))
        pair = [ranks.get(word[i : i + 2], _NEVER) for i in range(len(word) - 1)]
        while pair:
            least = min(pair)
            if least == _NEVER:
                break
            i = pair.index(least)
            del bounds[i + 1], pair[i]
            if i < len(pair):
                pair[i] = ranks.get(word[bounds[i] : bounds[i + 2]], _NEVER)
            if i:
                pair[i - 1] = ranks.get(word[bounds[i - 1] : bounds[i + 1]], _NEVER)
        return [ranks[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]

    def merge_long(self, word: bytes) -> list[int]:
        """The same merges (least rank, then leftmost) from a heap over linked parts."""
        ranks, n = self.ranks, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            middle = end[i]
            if middle < 0 or middle >= n or end[middle] != stop:
                continue  # one of its parts has grown or gone since
            end[i], end[middle] = stop, -1
            if stop < n:
                before[stop] = i
                if (r := ranks.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0 and (r := ranks.get(word[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[word[i : end[i]]])
            i = end[i]
        return out

    def word_ids(self, word: str) -> tuple[int, ...]:
        found = self.cache.get(word)
        if found is None:
            raw = word.encode()
            known = self.ranks.get(raw)
            found = (known,) if known is not None else tuple(self.merge_short(raw) if len(raw) <= SHORT_WORD_BYTES else self.merge_long(raw))
            if len(raw) <= SHORT_WORD_BYTES:
                if len(self.cache) >= _CACHED_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text without special tokens; none for an empty or NULL text."""
        ids: list[int] = []
        if text:
            for match in self.words.finditer(text):
                ids += self.word_ids(match[0])
        return ids


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _mapper(path: str, kind: pa.DataType, make: Callable[[Encoder, str | None], object]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            made = pa.array([make(enc, t.as_py()) for t in batch.column("text")], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "made"])

    return run


def encode_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, ids ARRAY<INT>) of every row, in one pass without a shuffle.

    Empty and NULL texts give an empty list. Texts that look like special tokens are ordinary text.
    Every row is encoded whole, rows with repeated or NULL ids too; other columns are not read.
    """
    rows = df.select(F.col(doc_id).alias("id"), F.col(text).cast("string").alias("text"))
    made = rows.mapInArrow(_mapper(vocabulary, pa.list_(pa.int32()), Encoder.encode), f"id {df.schema[doc_id].dataType.simpleString()}, made array<int>")
    return made.select(F.col("id").alias(doc_id), F.col("made").alias("ids"))


def count_tokens(df: DataFrame, carry: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``carry`` columns and ``n_tokens`` of every row's text; 0 for empty and NULL texts."""
    rows = df.select(*carry, F.col(text).cast("string").alias("text"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    made = rows.mapInArrow(_mapper(vocabulary, pa.int64(), lambda e, t: len(e.encode(t))), f"{kinds}, made long")
    return made.withColumnRenamed("made", "n_tokens")
