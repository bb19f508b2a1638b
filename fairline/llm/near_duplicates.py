"""N-gram Jaccard join by MinHash banding.

Texts become sets of five-word shingles. Signatures are cut into bands whose number and rows follow from the recall
wanted at the threshold; texts that share a band are candidates. Candidates that hang together are compared on their
full sets: such a group is dealt into blocks, each pair of blocks is one task's work, and what leaves a task is the
number of links of each text and a spanning set of links, never all pairs of a group. Equal sets are one node with a
weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.llm.components import connected_components

SHINGLE = 5
THRESHOLD = 0.8
#: Probability that a pair just at the threshold shares a band.
RECALL = 0.9999
#: Rows of a band.
ROWS = 6
#: Texts in a block of candidates.
BLOCK = 512
_P = np.uint64((1 << 61) - 1)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS) -> int:
    """Bands of ``rows`` rows needed: 1 - (1 - threshold^rows)^bands >= recall."""
    return ceil(log(1 - recall) / log(1 - threshold**rows))


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of ``size`` lower-cased words; a shorter text is one run."""
    words = (text or "").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashed = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.fromiter((hashed[w] for w in words), dtype=np.uint64, count=len(words))
    runs = len(h) - size + 1
    if runs < 1:
        return np.array([xxhash.xxh3_64_intdigest(" ".join(words), seed=1)], dtype=np.uint64)
    out = np.zeros(runs, dtype=np.uint64)
    for k in range(size):
        out = (out ^ h[k : k + runs]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return np.unique(out)


class Bands:
    """Band hashes of a shingle set."""

    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.bands, self.rows = bands, rows
        self.times = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.plus = rng.integers(1, 1 << 62, bands * rows, dtype=np.uint64)

    def of(self, grams: np.ndarray) -> np.ndarray:
        low = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        for at in range(0, len(grams), 256):
            mixed = (grams[at : at + 256, None] + self.plus) * self.times
            mixed ^= mixed >> np.uint64(32)
            low = np.minimum(low, (mixed * np.uint64(0xD6E8FEB86659FD93)).min(axis=0))
        out = np.arange(self.bands, dtype=np.uint64)
        for k in range(self.rows):
            out = (out ^ low[k :: self.rows]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(31)
        return out.astype(np.int64)


def _signed(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """A row per row of ``docs``: its number, ``id``, ``set_id`` (hash of the shingle set), compressed text and band hashes."""
    bands = bands_for()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        minhash, number = Bands(bands, ROWS), TaskContext.get().partitionId() << 36
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            out = []
            for row_id, content in zip(batch["id"], batch["text"]):
                grams = shingles(content)
                if len(grams):
                    key = xxhash.xxh3_128_digest(grams.tobytes())
                    out.append((number, row_id, key, squeeze.compress(content.encode()), minhash.of(grams)))
                else:
                    out.append((number, row_id, None, None, None))
                number += 1
            yield pd.DataFrame(out, columns=["row", "id", "set_id", "data", "bands"])

    plain = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return plain.mapInPandas(sign, f"row long, id {kind}, set_id binary, data binary, bands array<bigint>")


def _compare(left: list[np.ndarray], right: list[np.ndarray] | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (left, right) with Jaccard similarity of at least ``threshold``; ``right`` None: within ``left``.

    Shared grams are found by sorting; each text's row of counts is filled from them, so memory is one row at a time.
    """
    other = left if right is None else right
    lengths = np.array([len(g) for g in other])
    owner = np.repeat(np.arange(len(other)), lengths)
    grams = np.concatenate(other)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    a, b = [], []
    for i, own in enumerate(left):
        low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        n = high - low
        at = np.repeat(low - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
        shared = np.bincount(owner[at], minlength=len(other))
        if right is None:
            shared[: i + 1] = 0
        hit = np.flatnonzero(shared >= threshold / (1 + threshold) * (len(own) + lengths) - 1e-9)
        hit = hit[shared[hit] / (len(own) + lengths[hit] - shared[hit]) >= threshold]
        a.append(np.full(len(hit), i))
        b.append(hit)
    return np.concatenate(a), np.concatenate(b)


def _links(work: pd.DataFrame) -> pd.DataFrame:
    """Links within one pair of blocks: per text the weight it is linked to, and links that span what hangs together."""
    ids, weight = work["node"].to_numpy(), work["weight"].to_numpy()
    unpack = zstandard.ZstdDecompressor()
    grams = [shingles(unpack.decompress(data).decode()) for data in work["data"]]
    side = work["side"].to_numpy()
    first = np.flatnonzero(side == 0)
    second = np.flatnonzero(side == 1)
    if work["same"].iloc[0]:
        a, b = _compare(grams, None, THRESHOLD)
    elif len(first) and len(second):
        a, b = _compare([grams[i] for i in first], [grams[i] for i in second], THRESHOLD)
        a, b = first[a], second[b]
    else:
        a = b = np.zeros(0, dtype=int)
    linked = np.bincount(a, weights=weight[b], minlength=len(ids)) + np.bincount(b, weights=weight[a], minlength=len(ids))
    root = list(range(len(ids)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    spanning = np.full(len(ids), -1, dtype=np.int64)
    for i, j in zip(a, b):
        p, q = find(i), find(j)
        if p != q:
            root[max(p, q)] = min(p, q)
            spanning[max(p, q)] = ids[min(p, q)]
    out = pd.DataFrame({"node": ids, "linked": linked.astype(np.int64), "other": spanning})
    return out[(out["linked"] > 0) | (out["other"] >= 0)]


def _groups(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` for the ends of star edges (``a`` a node, ``b`` a centre; at most one edge for each band).

    Nodes shrink to their smallest centres before anything is joined: a node's centres are a short list, and what they
    say is which centres belong together. A group of many near copies has few such pairs, each of them once.
    """
    listed = materialise(edges.groupBy("a").agg(F.min("b").alias("label"), F.collect_set("b").alias("centres")))
    pairs = listed.select("label", F.explode("centres").alias("centre"))
    centres = materialise(pairs.select("centre").distinct())
    # a centre that is a node of other stars too belongs with its own label
    own = listed.join(centres, F.col("a") == F.col("centre")).select(F.col("a").alias("label"), F.col("label").alias("centre"))
    between = connected_components(pairs.unionByName(own).distinct().select(F.col("label").alias("a"), F.col("centre").alias("b")))
    labelled = listed.select(F.col("a").alias("node"), "label").unionByName(centres.select(F.col("centre").alias("node"), F.col("centre").alias("label")))
    labelled = labelled.groupBy("node").agg(F.min("label").alias("label"))
    found = labelled.join(between.withColumnRenamed("node", "label"), "label", "left")
    return materialise(found.select("node", F.coalesce("component", "label").alias("component")))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``class_id`` (smallest id of its class) and ``n_links`` for every row.

    Rows are linked if their texts' shingle sets have a Jaccard similarity of at least 0.8; a class is what hangs
    together; ``n_links`` counts the other rows a row is linked to, copies included. Null texts and texts without words
    are linked to nothing and have the class of their own id. Rows that share an id are rows of their own; an empty
    table gives an empty result; other columns are ignored. Ids may be null (such a class has a null id if all are).
    """
    signed = materialise(_signed(docs, text, doc_id))
    having = signed.where(F.col("set_id").isNotNull())
    # a node is the first row of each set; it carries the bands on
    nodes = materialise(having.groupBy("set_id").agg(
        F.min("row").alias("node"), F.count(F.lit(1)).alias("weight"), F.min("id").alias("first_id"), F.min_by("bands", "row").alias("bands")
    ))
    banded = nodes.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("bucket"))
    # buckets with one set fall away; the others are stars, so a bucket gives as many edges as it has sets
    stars = banded.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("far")).where("centre <> far")
    edges = banded.join(stars.hint("merge"), "bucket").select(F.col("node").alias("a"), F.col("centre").alias("b")).where("a <> b")
    groups = _groups(edges)
    sized = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # blocks by hash; a pair of blocks is a unit of work
    members = (
        groups.join(sized, "component")
        .withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(nodes.select("node", "weight"), "node")
        .select("node", "component", "blocks", "block", "weight")
    )
    texts = having.select(F.col("row").alias("node"), "data")
    carried = texts.join(members.hint("merge"), "node")
    work = (
        carried.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("low", F.least("block", "with"))
        .withColumn("high", F.greatest("block", "with"))
        .withColumn("side", F.when(F.col("block") == F.col("low"), 0).otherwise(1))
        .withColumn("same", F.col("low") == F.col("high"))
        .select("component", "low", "high", "side", "same", "node", "weight", "data")
    )
    links = materialise(work.groupBy("component", "low", "high").applyInPandas(_links, "node long, linked long, other long"))
    classes = connected_components(links.where("other >= 0").select(F.col("node").alias("a"), F.col("other").alias("b")))
    linked = links.groupBy("node").agg(F.sum("linked").alias("linked"))
    named = (
        nodes.drop("bands").join(classes, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .join(linked, "node", "left")
    )
    smallest = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    named = named.join(smallest, "component").select("set_id", "class_id", (F.coalesce("linked", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    rows = signed.select("id", "set_id").join(named, "set_id", "left")
    return rows.select(
        F.col("id").alias(doc_id), F.when(F.col("set_id").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
