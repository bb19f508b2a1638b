"""Removal of repeated substrings: suffix ranks at growing offsets, with a sampled start.

Plain prefix doubling ranks every byte's suffix in each round. Here the first round ranks only positions that content
itself chooses: of the grams in a 200-byte string the one with the smallest hash, the string's anchor. Equal strings
have equal anchors at equal offsets, so nothing is missed, and strings that share an anchor at consecutive starts form
one block. Blocks whose anchor rank is unique leave. A block found whole elsewhere is settled (each distinct block is
then carried once, as evidence for others). The rest is ranked at the full offset: each 200-byte string of a block by
its own hash among the blocks of its anchor rank. Strings of anchor ranks with very many distinct blocks become rows of
their own and are counted by (rank, hash), so no task holds such a rank.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise

#: Bytes of a repeated string, and of the grams that anchors are chosen from.
LENGTH, GRAM = 200, 24
SPAN = LENGTH - GRAM + 1
#: Window starts looked at together.
SEGMENT = 1 << 20
#: Distinct blocks of an anchor rank above which its strings are counted as rows.
HOT = 20_000
#: Blocks that a task ranks together.
TOGETHER = 10_000

_RNG = np.random.default_rng(7)
_TABLE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Hasher:
    """Polynomial hashes, modulo 2^64 and then mixed, of all strings of a length."""

    def __init__(self):
        self.up, self.down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)

    def _reach(self, n: int) -> None:
        if n > len(self.up):
            self.up, self.down = _powers(_BASE, n), _powers(_INVERSE, n)

    def sums(self, b: np.ndarray) -> np.ndarray:
        self._reach(len(b) + 1)
        return np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_TABLE[b] * self.up[: len(b)], dtype=np.uint64)])

    def at(self, sums: np.ndarray, start: np.ndarray | slice, length: int) -> np.ndarray:
        """Hashes of the strings of ``length`` at the given starts."""
        if isinstance(start, slice):
            h = (sums[length:] - sums[:-length]) * self.down[: len(sums) - length]
        else:
            h = (sums[start + length] - sums[start]) * self.down[start]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        return h


def blocks(data: bytes, hasher: Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays (rank, anchor, first start, last start) of the blocks of a text, a segment at a time."""
    starts = len(data) - LENGTH + 1
    for base in range(0, max(0, starts), SEGMENT):
        n = min(SEGMENT, starts - base)
        b = np.frombuffer(data, dtype=np.uint8, count=n + LENGTH - 1, offset=base)
        h = hasher.at(hasher.sums(b), slice(None), GRAM)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while 2 * size <= SPAN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < SPAN:
            low = np.minimum(low[: n], low[SPAN - size : SPAN - size + n])
        anchor = (low[:n] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:], n] - 1
        yield h[anchor[first]].astype(np.int64), anchor[first] + base, first + base, last + base


def _texts_and_blocks(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """One pass over the texts: a row for each text (compressed) and one for each of its blocks."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher, number = Hasher(), TaskContext.get().partitionId() << 36
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            rows, found = [], []
            for row_id, content in zip(batch["id"], batch["text"]):
                data = (content or "").encode()
                rows.append((number, row_id, squeeze.compress(data)))
                for rank, anchor, first, last in blocks(data, hasher):
                    keys = [xxhash.xxh3_128_digest(data[i : j + LENGTH]) for i, j in zip(first.tolist(), last.tolist())]
                    key = np.frombuffer(b"".join(keys), dtype=np.int64).reshape(-1, 2)
                    found.append((np.full(len(rank), number), rank, key[:, 0], key[:, 1], anchor, first, last))
                    if sum(len(f[0]) for f in found) > 60_000:
                        yield _pass_rows(found)
                        found = []
                number += 1
            yield _filled(pd.DataFrame(rows, columns=["number", "id", "data"]))
            if found:
                yield _pass_rows(found)

    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return plain.mapInPandas(
        read, f"number long, id {kind}, data binary, rank long, k1 long, k2 long, anchor int, first int, last int"
    )


_COLUMNS = ["number", "id", "data", "rank", "k1", "k2", "anchor", "first", "last"]


def _filled(part: pd.DataFrame) -> pd.DataFrame:
    return part.reindex(columns=_COLUMNS).astype({c: "Int64" for c in _COLUMNS[3:]})


def _pass_rows(found: list[tuple]) -> pd.DataFrame:
    columns = [np.concatenate(c) for c in zip(*found)]
    part = pd.DataFrame(dict(zip(["number", *_COLUMNS[3:]], columns)))
    part["id"] = None
    part["data"] = None
    return part[_COLUMNS]


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes of the blocks wanted of each text."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        rows = []
        for data, wanted in zip(batch["data"], batch["wanted"]):
            data = unpack.decompress(data)
            rows += [(w["rank"], w["k1"], w["k2"], data[w["first"] : w["last"] + LENGTH]) for w in wanted]
        yield pd.DataFrame(rows, columns=["rank", "k1", "k2", "data"])


def _strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hashes of all strings of the blocks wanted of each text."""
    unpack, hasher = zstandard.ZstdDecompressor(), Hasher()

    def joined(parts: list[tuple]) -> pd.DataFrame:
        sizes = [len(h) for *_, h in parts]
        keys = {c: np.repeat(np.array([p[k] for p in parts], dtype=np.int64), sizes) for k, c in enumerate(("rank", "k1", "k2"))}
        at = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
        return pd.DataFrame({**keys, "at": at, "hash": np.concatenate([p[3] for p in parts])})

    for batch in batches:
        parts: list[tuple] = []
        for data, wanted in zip(batch["data"], batch["wanted"]):
            data = unpack.decompress(data)
            for w in wanted:
                b = np.frombuffer(data, dtype=np.uint8, count=w["last"] - w["first"] + LENGTH, offset=w["first"])
                parts.append((w["rank"], w["k1"], w["k2"], hasher.at(hasher.sums(b), slice(None), LENGTH).astype(np.int64)))
                if len(parts) >= 1000:
                    yield joined(parts)
                    parts = []
        if parts:
            yield joined(parts)


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of consecutive places of each block."""
    for batch in batches:
        rows = []
        for k1, k2, places in zip(batch["k1"], batch["k2"], batch["places"]):
            places = np.sort(np.asarray(places))
            gap = np.diff(places) > 1
            rows += [(k1, k2, low, high) for low, high in zip(places[np.r_[True, gap]], places[np.r_[gap, True]])]
        yield pd.DataFrame(rows, columns=["k1", "k2", "low", "high"])


def _ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of strings that stand more than once among the blocks of a rank; rows come ordered by rank."""
    hasher, held = Hasher(), None

    def settle(part: pd.DataFrame) -> pd.DataFrame:
        data = b"".join(part["data"])
        sizes = part["data"].map(len).to_numpy()
        begin = np.r_[0, np.cumsum(sizes)[:-1]]
        counts = sizes - LENGTH + 1
        row = np.repeat(np.arange(len(part)), counts)
        offset = np.arange(counts.sum()) - np.repeat(np.r_[0, np.cumsum(counts)[:-1]], counts)
        h = hasher.at(hasher.sums(np.frombuffer(data, dtype=np.uint8)), begin[row] + offset, LENGTH)
        rank = part["rank"].to_numpy()[row]
        order = np.lexsort((h, rank))
        same = (h[order][1:] == h[order][:-1]) & (rank[order][1:] == rank[order][:-1])
        twice = np.zeros(len(h), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.r_[True, row[1:] != row[:-1]]
        first = np.flatnonzero(twice & (edge | ~np.r_[False, twice[:-1]]))
        last = np.flatnonzero(twice & (np.r_[edge[1:], True] | ~np.r_[twice[1:], False]))
        at = row[first]
        return pd.DataFrame({
            "k1": part["k1"].to_numpy()[at], "k2": part["k2"].to_numpy()[at],
            "low": offset[first].astype(np.int32), "high": offset[last].astype(np.int32),
        })

    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        if len(held) >= TOGETHER:
            inside = (held["rank"] != held["rank"].iloc[-1]).to_numpy()
            if inside.any():
                yield settle(held[inside])
                held = held[~inside].reset_index(drop=True)
    if held is not None and len(held):
        yield settle(held)


def without_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = False) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256`` (and ``kept``, binary, on demand) of every row.

    Every byte goes that a string of 200 bytes covers which also starts elsewhere in the table, in the same text or in
    another; overlaps count. Null texts count as empty; texts under 200 bytes are kept whole; of repeated rows each
    loses what it shares with the others; an empty table gives an empty result; other columns are ignored.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    whole = materialise(_texts_and_blocks(docs, text, doc_id))
    rows = whole.where(F.col("rank").isNotNull()).select("rank", "k1", "k2", "number", "anchor", "first", "last")
    shared = rows.groupBy("rank").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    live = materialise(rows.join(shared.select("rank"), "rank", "left_semi"))
    place = F.struct("number", "anchor", "first", "last")
    distinct = materialise(live.groupBy("rank", "k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("place")))
    ranks = distinct.groupBy("rank").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1")
    # two strings of one block never equal each other: their anchors would be one place at different offsets
    wanted = distinct.join(ranks, "rank").select("place.*", "rank", "k1", "k2", (F.col("blocks") > HOT).alias("hot"))
    texts = whole.where(F.col("data").isNotNull()).select("number", "id", "data")
    block = F.struct("rank", "k1", "k2", "first", "last")

    def pieces(some: DataFrame) -> DataFrame:
        asked = some.groupBy("number").agg(F.collect_list(block).alias("wanted"))
        return texts.select("number", "data").join(asked, "number").select("data", "wanted")

    cut = pieces(wanted.where(~F.col("hot"))).mapInPandas(_cut, "rank long, k1 long, k2 long, data binary")
    run = "k1 long, k2 long, low int, high int"
    runs = materialise(cut.repartition("rank").sortWithinPartitions("rank").mapInPandas(_ranked, run))
    # written, so that without hot ranks the texts aren't shuffled again
    strings = materialise(
        pieces(materialise(wanted.where("hot"))).mapInPandas(_strings, "rank long, k1 long, k2 long, at int, hash long")
    )
    twice = strings.groupBy("rank", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("rank", "hash")
    held = strings.join(twice, ["rank", "hash"], "left_semi").groupBy("k1", "k2").agg(F.collect_list("at").alias("places"))
    runs = runs.unionByName(materialise(held.mapInPandas(_runs, run)))
    settled = distinct.where("n > 1").select("k1", "k2").distinct()
    whole_spans = live.join(settled, ["k1", "k2"], "left_semi").select(
        "number", F.col("first").alias("low"), (F.col("last") + LENGTH).alias("high")
    )
    part_spans = live.join(runs, ["k1", "k2"]).select(
        "number", (F.col("first") + F.col("low")).alias("low"), (F.col("first") + F.col("high") + LENGTH).alias("high")
    )
    spans = whole_spans.unionByName(part_spans).groupBy("number").agg(F.collect_list(F.struct("low", "high")).alias("spans"))

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = []
            for row_id, data, cuts in zip(batch["id"], batch["data"], batch["spans"]):
                data = unpack.decompress(data)
                kept, at, removed, n = [], 0, 0, 0
                merged = []
                for low, high in sorted((c["low"], c["high"]) for c in (cuts if cuts is not None else ())):
                    if merged and low <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], high)
                    else:
                        merged.append([low, high])
                for low, high in merged:
                    kept.append(data[at:low])
                    removed, n, at = removed + high - low, n + 1, high
                kept = b"".join([*kept, data[at:]])
                out.append((row_id, len(data), removed, n, hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            yield pd.DataFrame(out, columns=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    done = texts.join(spans, "number", "left").select("id", "data", "spans").mapInPandas(
        remove, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    ).withColumnRenamed("id", doc_id)
    return done if keep_text else done.drop("kept")
