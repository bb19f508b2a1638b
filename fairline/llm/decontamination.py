"""Benchmark decontamination by the pigeonhole principle.

A test item of m characters may lie in a document with up to e = m * RATE edits. Cut into e + 1 pieces, at least one
piece then lies in it unchanged. All pieces of a block of items are looked for at once (Aho-Corasick); around each
place where one is found, Myers' bit-parallel distance tells whether the whole item is there within its budget.
Items and texts are compared lower-cased, as word characters with single spaces between words.

The benchmark is a stated query set. It is taken in blocks of bounded size, each broadcast and run over all rows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edits allowed per character of an item.
RATE = 0.08
#: Characters of items in one broadcast block, about.
BLOCK = 2_000_000
_WORD = re.compile(r"\w+")


def normalised(text: str | None) -> str:
    return " ".join(_WORD.findall((text or "").lower()))


def pieces(item: str, rate: float = RATE) -> list[tuple[int, str]]:
    """The item cut into error-budget-plus-one pieces of nearly equal length, with their offsets."""
    budget = int(len(item) * rate)
    count = budget + 1
    cuts = [len(item) * k // count for k in range(count + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str, budget: int) -> tuple[int, int] | None:
    """(distance, end) of the best place in ``text`` where ``item`` ends within ``budget`` edits; the first of equals."""
    m = len(item)
    peq: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        peq[c] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, distance, best = mask, 0, m, None
    for end, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        d0 = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(d0 | plus)
        down = plus & d0
        if up & high:
            distance += 1
        elif down & high:
            distance -= 1
        up = up << 1  # a match may begin anywhere
        plus = ((down << 1) | ~(d0 | up)) & mask
        minus = up & d0 & mask
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, end)
    return best


class Finder:
    """Finds the items of a block in texts."""

    def __init__(self, items: list[tuple], rate: float = RATE):
        self.items = {}
        self.budget = {}
        places: dict[str, list[tuple]] = defaultdict(list)
        for key, text in items:
            item = normalised(text)
            if not item:
                continue
            self.items[key], self.budget[key] = item, int(len(item) * rate)
            for offset, piece in pieces(item, rate):
                places[piece].append((key, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple]:
        """(item, distance, start of the searched window, end) of each item found; its best place, the first of equals."""
        if not self.items or not text:
            return []
        plain = normalised(text)
        wanted: dict = defaultdict(list)
        for last, (length, where) in self.automaton.iter(plain):
            for key, offset in where:
                start = last + 1 - length - offset
                wanted[key].append((start - self.budget[key], start + len(self.items[key]) + self.budget[key]))
        found = []
        for key, windows in wanted.items():
            best = None
            for low, high in self._merged(windows, len(plain)):
                hit = myers(self.items[key], plain[low:high], self.budget[key])
                if hit and (best is None or hit[0] < best[0]):
                    best = (hit[0], low, low + hit[1])
            if best:
                found.append((key, *best))
        return sorted(found)

    @staticmethod
    def _merged(windows: list[tuple[int, int]], length: int) -> Iterator[tuple[int, int]]:
        low, high = None, None
        for a, b in sorted(set(windows)):
            a, b = max(0, a), min(length, b)
            if low is None:
                low, high = a, b
            elif a <= high:
                high = max(high, b)
            else:
                yield low, high
                low, high = a, b
        if low is not None:
            yield low, high


def contaminations(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id",
    item_text: str = "text", rate: float = RATE, block: int = BLOCK,
) -> DataFrame:
    """``doc_id``, ``item_id``, ``distance`` and ``n_rows`` (equal rows of that id) for each item that a document holds.

    Null and empty texts or items match nothing; repeated rows give one row with their number. Items whose budget is 0
    must appear unchanged. Empty tables give an empty result. Other columns are ignored.
    """
    items = benchmark.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where(F.col("t").isNotNull()).distinct()
    chars = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = 1 + chars // block
    source = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind, key = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    out = None
    for b in range(blocks):
        own = [(r["k"], r["t"]) for r in items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect()]  # bounded by block
        sent = docs.sparkSession.sparkContext.broadcast(own)

        def search(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            finder = Finder(sent.value, rate)
            for batch in batches:
                rows = [(i, hit[0], hit[1]) for i, t in zip(batch["doc_id"], batch["text"]) for hit in finder.find(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "distance"]).astype({"distance": "int64"})

        part = source.mapInPandas(search, f"doc_id {kind}, item_id {key}, distance bigint")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"), F.count(F.lit(1)).alias("n_rows"))


def _holder(sent, rate: float):
    """Tells which texts hold an item of the block sent."""

    def holds(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = Finder(sent.value, rate)
        for batch in batches:
            yield pd.Series([bool(finder.find(t)) for t in batch], dtype=bool)

    return F.pandas_udf(holds, "boolean")


def rows_without_items(docs: DataFrame, benchmark: DataFrame, text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows whose text holds an item (decided row by row; null texts stay).

    Repeated rows go or stay together. Works without a shuffle: each block of items filters the rows that are left.
    """
    items = benchmark.select(F.col("text").alias("t")).where(F.col("t").isNotNull()).distinct()
    blocks = 1 + (items.agg(F.sum(F.length("t"))).first()[0] or 0) // block
    kept = docs
    for b in range(blocks):
        own = [(i, r["t"]) for i, r in enumerate(items.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == b).collect())]
        sent = docs.sparkSession.sparkContext.broadcast(own)
        kept = kept.where(~_holder(sent, rate)(F.coalesce(F.col(text), F.lit(""))))
    return kept
