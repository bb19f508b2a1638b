"""Substring removal by Rabin-Karp hashes of every window of fifty words.

A window goes if its word sequence also starts in a document with a smaller id. Windows choose an anchor first: of the
sixteen-word grams inside a window the one with the smallest hash. Equal windows choose equal grams, so a window whose
anchor occurs in one document only can't be repeated, and only the hashes of all other windows are sent. They are sorted
by (hash, id) over ranges, so the rows of one window that stands everywhere spread over many tasks; each task sees which
rows of a hash have a smaller id before them, and a hash that a range border cuts is settled by the few heads that the
ranges name. Removed windows merge into maximal intervals of words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.llm.text import WORD

#: Words of a window, and of the grams that anchors are chosen from.
LENGTH, GRAM = 50, 16
#: Window starts looked at together.
SEGMENT = 1 << 19
#: Word hashes that a worker remembers before it forgets all.
REMEMBERED = 500_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX, _HALF = np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
_PLACE = np.uint64((1 << 20) - 1)
_WORDS = re.compile(WORD)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class WordHashes:
    """Hashes of words, remembered, and Rabin-Karp hashes (modulo 2^64, then mixed) of all their runs of a length."""

    def __init__(self):
        self.seen: dict[str, int] = {}
        n = SEGMENT + LENGTH + 1
        self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def of(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(seen.__getitem__, words), dtype=np.uint64, count=len(words))

    def runs(self, words: np.ndarray, length: int) -> np.ndarray:
        """Hash of each run of ``length`` words; at most a segment's words at once."""
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.up[: len(words)], dtype=np.uint64, out=sums[1:])
        h = (sums[length:] - sums[:-length]) * self.down[: len(words) - length + 1]
        h ^= h >> _HALF
        h *= _MIX
        return h ^ (h >> _HALF)


def anchored(words: np.ndarray, hashes: WordHashes) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first start, window hashes, anchor hashes) of all windows of a text, a segment of starts at a time."""
    starts, span = len(words) - LENGTH + 1, LENGTH - GRAM + 1
    for base in range(0, max(0, starts), SEGMENT):
        n = min(SEGMENT, starts - base)
        part = words[base : base + n + LENGTH - 1]
        grams = hashes.runs(part, GRAM)
        low = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)  # ties: leftmost
        size = 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        low = np.minimum(low[:n], low[span - size : span - size + n])
        yield base, hashes.runs(part, LENGTH), grams[low & _PLACE]


def _sha(words: list[str]) -> str:
    return hashlib.sha256(" ".join(words).encode()).hexdigest()


def _read(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A row per row of ``docs``: number, id, words, hash of the whole; texts of a window or more with their anchors."""
    kind = docs.schema[doc_id].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes, number = WordHashes(), TaskContext.get().partitionId() << 36
        squeeze = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            rows = []
            for row_id, content in zip(batch["id"], batch["text"]):
                words = _WORDS.findall(content or "")
                plain = " ".join(words).encode()
                row = [number, row_id, len(words), hashlib.sha256(plain).hexdigest(), None, None]
                if len(words) >= LENGTH:
                    h = hashes.of(words)
                    row[4] = np.unique(np.concatenate([np.unique(a) for _, _, a in anchored(h, hashes)])).astype(np.int64)
                    row[5] = squeeze.compress(plain)
                rows.append(row)
                number += 1
            yield pd.DataFrame(rows, columns=["number", "id", "n_words", "whole", "anchors", "data"])

    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    return plain.mapInPandas(read, f"number long, id {kind}, n_words long, whole string, anchors array<bigint>, data binary")


def _shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (sorted by anchor) whose anchor another row has; a range's first and last row always count as such."""
    before = None  # the last row, not yet given: anchor, number, whether it is shared
    for batch in batches:
        anchor, number = batch["anchor"].to_numpy(), batch["number"].to_numpy()
        same = anchor[1:] == anchor[:-1]
        wanted = np.r_[before is None, same]
        wanted[:-1] |= same
        if before is not None:
            wanted[0] |= anchor[0] == before[0]
            if before[2] or anchor[0] == before[0]:
                yield pd.DataFrame({"anchor": [before[0]], "number": [before[1]]})
        yield pd.DataFrame({"anchor": anchor[:-1][wanted[:-1]], "number": number[:-1][wanted[:-1]]})
        before = (anchor[-1], number[-1], wanted[-1])
    if before is not None:
        yield pd.DataFrame({"anchor": [before[0]], "number": [before[1]]})


def _window_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of each live text a row with its words, and rows with hashes of consecutive windows whose anchors are shared."""
    hashes, unpack = WordHashes(), zstandard.ZstdDecompressor()
    for batch in batches:
        rows, held = [], 0
        for number, row_id, data, anchors in zip(batch["number"], batch["id"], batch["data"], batch["anchors"]):
            rows.append((number, row_id, data, 0, None))
            words = unpack.decompress(data).decode().split(" ")
            wanted = np.sort(np.asarray(anchors, dtype=np.int64).astype(np.uint64))
            for base, h, a in anchored(hashes.of(words), hashes):
                at = np.minimum(np.searchsorted(wanted, a), len(wanted) - 1)
                live = np.r_[False, wanted[at] == a, False]
                first, after = np.flatnonzero(live[1:] & ~live[:-1]), np.flatnonzero(~live[1:] & live[:-1])
                for i, j in zip(first.tolist(), after.tolist()):
                    rows.append((number, row_id, None, base + i, h[i:j].astype(np.int64)))
                    held += j - i
                    if held > 1_000_000:
                        yield pd.DataFrame(rows, columns=["number", "id", "data", "start", "hashes"])
                        rows, held = [], 0
        yield pd.DataFrame(rows, columns=["number", "id", "data", "start", "hashes"])


_JUDGED = ["kind", "hash", "id", "number", "at"]
#: Kinds of judged rows.
GONE, OPEN, HEAD = 0, 1, 2


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a range sorted by (hash, id): windows with a smaller id before them; open ones of its first hash; its last hash's head."""
    first = hash_now = least = None
    for batch in batches:
        h, ids = batch["hash"].to_numpy(), batch["id"].to_numpy()
        new = np.r_[h[0] != hash_now or first is None, h[1:] != h[:-1]]
        if first is None:
            first = h[0]
        group = np.cumsum(new)
        heads = ids[new]
        if not new[0]:
            heads = np.r_[np.array([least], dtype=ids.dtype), heads]
        smallest = heads[group - new[0]]
        gone = ids > smallest
        open_ = ~gone & (h == first)
        hash_now, least = h[-1], smallest[-1]
        wanted = gone | open_
        out = batch.loc[wanted].copy()
        out["kind"] = np.where(gone[wanted], GONE, OPEN)
        yield out[_JUDGED]
    if first is not None:
        yield pd.DataFrame({"kind": [HEAD], "hash": [hash_now], "id": [least], "number": [0], "at": [0]})


def intervals(starts: np.ndarray, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal intervals [first, after) of the words that windows at ``starts`` cover."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), (starts[np.r_[cut, len(starts) - 1]] + length).tolist()))


def _remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        out = []
        for number, data, starts in zip(batch["number"], batch["data"], batch["starts"]):
            words = unpack.decompress(data).decode().split(" ")
            kept, spans, at = [], intervals(np.asarray(starts)), 0
            for low, high in spans:
                kept += words[at:low]
                at = high
            kept += words[at:]
            out.append((number, [{"first": i, "after": j} for i, j in spans], len(words) - len(kept), _sha(kept)))
        yield pd.DataFrame(out, columns=["lead", "removed", "n_removed", "kept_sha256"])


def without_repeated_windows(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` and ``removed`` (intervals of words) of every row.

    Every word goes that a window of fifty words covers whose word sequence also starts in a row with a smaller id;
    windows are judged on the input. Null texts count as empty; texts under fifty words are kept whole. A null id is
    neither smaller nor larger than another: such rows keep everything and remove nothing. Rows that share an id don't
    remove each other's words. An empty table gives an empty result; other columns are ignored. Long texts are hashed
    in segments of half a million words. ``removed`` holds maximal intervals (first word, word after), in order.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = materialise(_read(docs, text, doc_id))
    long_ones = read.where(F.col("data").isNotNull() & F.col("id").isNotNull())
    # of equal word sequences the first row of the smallest id stands for all: copies with a larger id go whole
    copies = materialise(
        long_ones.groupBy("whole").agg(F.min(F.struct("id", "number")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    ranked = materialise(
        long_ones.select("number", "id", "whole").join(copies.select("whole", "first"), "whole", "left")
        .withColumn("copy", F.coalesce(F.col("id") > F.col("first.id"), F.lit(False)))
        .select("number", "copy", F.when(F.col("copy"), F.col("number")).otherwise(F.coalesce("first.number", "number")).alias("lead"))
    )
    leads = ranked.where("number = lead and not copy").select("number")
    anchors = materialise(
        long_ones.select("number", "anchors").join(leads, "number", "left_semi").select(F.explode("anchors").alias("anchor"), "number")
    )
    shared = anchors.repartitionByRange("anchor", "number").sortWithinPartitions("anchor").mapInPandas(_shared, "anchor long, number long")
    asked = shared.groupBy("number").agg(F.collect_list("anchor").alias("anchors"))
    live = materialise(
        long_ones.select("number", "id", "data").join(asked, "number")
        .mapInPandas(_window_rows, f"number long, id {kind}, data binary, start long, hashes array<bigint>")
    )
    hashed = live.where("data is null").select("number", "id", "start", F.posexplode("hashes").alias("k", "hash"))
    hashed = hashed.select("hash", "id", "number", (F.col("start") + F.col("k")).alias("at"))
    judged = materialise(
        hashed.repartitionByRange("hash", "id", "number").sortWithinPartitions("hash", "id")
        .mapInPandas(_judge, f"kind int, hash long, id {kind}, number long, at long")
    )
    # a head for each range: as many rows as ranges
    heads = judged.where(f"kind = {HEAD}").groupBy("hash").agg(F.min("id").alias("head"))
    still = judged.where(f"kind = {OPEN}").join(F.broadcast(heads), "hash").where("head < id")
    gone = judged.where(f"kind = {GONE}").select("number", "at").unionByName(still.select("number", "at"))
    starts = gone.groupBy("number").agg(F.collect_list("at").alias("starts"))
    cut = live.where(F.col("data").isNotNull()).select("number", "data").join(starts, "number").mapInPandas(
        _remove, "lead long, removed array<struct<first:bigint,after:bigint>>, n_removed long, kept_sha256 string"
    )
    out = read.select("number", "id", "n_words", "whole").join(ranked, "number", "left").join(cut, "lead", "left")
    word_count = F.col("n_words").cast("long")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("first"), word_count.alias("after")))
    nothing = F.array().cast("array<struct<first:bigint,after:bigint>>")
    return out.select(
        F.col("id").alias(doc_id), "n_words",
        F.when(F.col("copy"), word_count).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(_sha([]))).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
        F.when(F.col("copy"), everything).otherwise(F.coalesce("removed", nothing)).alias("removed"),
    )
