"""Token counts by heap-and-linked-list byte-pair merging.

A unit of text starts as a linked list of characters. The adjacent pair with the best rank (leftmost among equals) is
popped from a heap and merged until no pair is a piece; the count is the number of symbols left, characters outside the
vocabulary counting their UTF-8 bytes. No identifiers are made. Pieces hold word marks only at their front and never a
line end, so no merge crosses such a place: units between them are counted on their own and remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The vocabulary's mark for a space.
MARK = "▁"
#: Units that a worker remembers before it forgets all, and their largest length.
REMEMBERED, LONGEST = 400_000, 48
LIMIT = 4096


def read_vocabulary(path: str) -> dict[str, float]:
    """Piece -> negated score (smaller merges first) of a sentencepiece file; special and byte pieces left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): -model.get_score(i)
        for i in range(model.vocab_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
    }


def merged_count(unit: str, rank: dict[str, float]) -> int:
    """Symbols left when all merges are done."""
    n = len(unit)
    symbols: list[str] = list(unit)
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        found = rank.get(unit[i : i + 2])
        if found is not None:
            heap.append((found, i, 2))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, length = heapq.heappop(heap)
        j = after[i]
        if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != length:
            continue  # one of the two has been merged meanwhile
        symbols[i] += symbols[j]
        symbols[j] = ""
        merges += 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            found = rank.get(symbols[i] + symbols[k])
            if found is not None:
                heapq.heappush(heap, (found, i, length + len(symbols[k])))
        h = before[i]
        if h >= 0:
            found = rank.get(symbols[h] + symbols[i])
            if found is not None:
                heapq.heappush(heap, (found, h, len(symbols[h]) + length))
    spelled = sum(len(c.encode()) - 1 for c in symbols if len(c) == 1 and c not in rank)
    return n - merges + spelled


class Counter:
    """Counts texts, remembering the units it has seen."""

    def __init__(self, rank: dict[str, float]):
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in rank):
            raise ValueError("this vocabulary merges across words")
        self.rank, self.seen = rank, {}
        self.units = re.compile(f"\n+|{MARK}*[^{MARK}\n]+|{MARK}+")

    def unit(self, unit: str) -> int:
        count = merged_count(unit, self.rank)
        if len(unit) <= LONGEST:
            if len(self.seen) >= REMEMBERED:
                self.seen.clear()
            self.seen[unit] = count
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, seen = 0, self.seen
        for unit in self.units.findall(MARK + text.replace(" ", MARK)):
            known = seen.get(unit)
            total += self.unit(unit) if known is None else known
        return total


def token_counts(docs: DataFrame, path: str, text: str = "text", carry: list[str] | None = None, limit: int = LIMIT) -> DataFrame:
    """``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` for every row, beside the columns of ``carry`` (all by default).

    A null text counts as empty (0 tokens). Repeated rows are counted alike; columns with the added names are left out.
    Long texts hold one list of their longest unit at a time. The vocabulary (some 10,000s of pieces) is broadcast.
    """
    added = ("n_bytes", "n_tokens", "over_limit", "_text")
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    spark = docs.sparkSession
    ranks = spark.sparkContext.broadcast(read_vocabulary(path))
    source = docs.select(*rest, F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = Counter(ranks.value)
        for batch in texts:
            yield pd.Series([counter.count(t) for t in batch], dtype="int64")

    count = F.pandas_udf(counted, "long")
    out = source.select(*rest, F.octet_length("_text").cast("long").alias("n_bytes"), count("_text").alias("n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
