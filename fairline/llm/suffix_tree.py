"""Language-model scoring by a probabilistic suffix tree over bytes, and a word-count base score.

Texts are lower-cased (A-Z), their words joined by single spaces and closed by one end symbol. Training texts give
counts of 5-byte windows, from which contexts of one to four bytes follow. A context is a candidate if it makes up
``P_MIN`` of all positions, and is retained with its suffixes if the log-likelihood its own distribution gains over
its parent's exceeds a penalty per symbol it has. Distributions are smoothed towards the parent's. A position is
scored in the longest retained suffix of what precedes it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.llm.text import crc_of_id

DEPTH = 4
#: A context below this share of all positions isn't kept: at most DEPTH / P_MIN contexts reach the driver and the tasks.
P_MIN = 1 / 4000
#: Nats that a context must gain for each symbol seen after it, beyond half the logarithm of its count.
PENALTY = 2.0
END = 10
#: Words of one chunk of texts, whose words are counted together before the shuffle.
CHUNK_WORDS = 4_000_000
#: Symbols that are counted or scored at once; distinct windows held between merges; rows sent at once; texts taken at once.
SEGMENT, HELD, SENT, TAKEN = 1 << 18, 1_000_000, 20_000, 512
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_LOWER).split()


def _segments(texts: Iterator[str | None]) -> Iterator[tuple[list[int], bytes]]:
    """Texts as symbols, each after DEPTH end symbols, several to a segment; with the places where they begin."""
    starts, parts, size = [], [], 0
    for text in texts:
        symbols = b"\n" * DEPTH + b" ".join(tokens(text)) + b"\n"
        starts.append(size)
        parts.append(symbols)
        size += len(symbols)
        if size >= SEGMENT:
            yield starts, b"".join(parts)
            starts, parts, size = [], [], 0
    if starts:
        yield starts, b"".join(parts)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[list[list]]:
    """Columns of ``TAKEN`` rows as Python values; a whole batch of texts is never turned into them at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, TAKEN):
            yield [c.to_pylist() for c in batch.slice(i, TAKEN).columns]


def _positions(starts: list[int], length: int) -> np.ndarray:
    """Which places are symbols to predict (not the end symbols before a text)."""
    inside = np.ones(length, dtype=bool)
    for k in range(DEPTH):
        inside[np.asarray(starts) + k] = False
    return inside


def window_counts(texts: DataFrame) -> DataFrame:
    """``window`` (DEPTH context bytes and the next, packed) and ``n``, added up in each task before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            codes = np.concatenate([c for c, _ in held])
            order = np.argsort(codes, kind="stable")
            codes, n = codes[order], np.concatenate([x for _, x in held])[order]
            first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
            held.clear()
            return codes[first], np.add.reduceat(n, first)

        def sent(codes: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(codes), SENT):
                yield pa.RecordBatch.from_pydict({"window": codes[i : i + SENT], "n": n[i : i + SENT].astype(np.int64)})

        for starts, data in _segments(t for (part,) in _taken(batches) for t in part):
            b = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
            codes = b[DEPTH:].copy()
            for k in range(1, DEPTH + 1):
                codes += b[DEPTH - k : len(b) - k] << (8 * k)
            held.append(np.unique(codes[_positions(starts, len(b))[DEPTH:]], return_counts=True))
            if sum(len(c) for c, _ in held) > HELD:
                held.append(merged())
                if len(held[0][0]) > HELD // 2:
                    yield from sent(*held.pop())
        if held:
            yield from sent(*merged())

    return texts.mapInArrow(count, "window long, n long").groupBy("window").agg(F.sum("n").alias("n"))


def contexts(windows: DataFrame) -> DataFrame:
    """Retained and passed-through contexts: depth, context, total, gain, need and arrays of next symbols and counts."""
    windows = materialise(windows)
    total = windows.agg(F.sum("n")).first()[0] or 0
    deepest = windows.select((F.col("window").bitwiseAND(255)).alias("next"), F.shiftright("window", 8).alias("context"), "n")
    found = None
    for depth in range(DEPTH + 1):
        mask = (1 << (8 * depth)) - 1
        cut = deepest.groupBy(F.col("context").bitwiseAND(F.lit(mask)).alias("context"), "next").agg(F.sum("n").alias("n"))
        level = (
            cut.groupBy("context")
            .agg(F.sum("n").alias("total"), F.collect_list(F.struct("next", "n")).alias("following"))
            .where(F.col("total") >= max(1.0, P_MIN * total))
            .select(F.lit(depth).alias("depth"), "*")
        )
        found = level if found is None else found.unionByName(level)
    return found


class Tree:
    """Arrays of the tree: children by preceding byte and log10 probabilities by symbol."""

    def __init__(self, rows: list):
        by_depth: dict[tuple[int, int], np.ndarray] = {}
        for r in rows:
            n = np.zeros(256)
            for x in r["following"]:
                n[x["next"]] = x["n"]
            by_depth[(r["depth"], r["context"])] = n
        keep = set()
        for (depth, context), n in by_depth.items():
            if depth and self._gain(n, by_depth[(depth - 1, context & ((1 << (8 * depth - 8)) - 1))]) > 0:
                keep |= {(d, context & ((1 << (8 * d)) - 1)) for d in range(1, depth + 1)}
        names = [(0, 0), *sorted(keep)]
        index = {name: i for i, name in enumerate(names)}
        self.child = np.zeros(len(names) * 256, dtype=np.int32)
        probability = np.zeros((len(names), 256))
        for (depth, context), i in index.items():
            n = by_depth.get((depth, context), np.zeros(256))
            if depth == 0:
                probability[i] = (n + 0.5) / (n.sum() + 128)
                continue
            parent = index[(depth - 1, context & ((1 << (8 * depth - 8)) - 1))]
            self.child[parent * 256 + (context >> (8 * depth - 8))] = i
            weight = max(1, np.count_nonzero(n))
            probability[i] = (n + weight * probability[parent]) / (n.sum() + weight)
        self.log10 = np.log10(probability).astype(np.float32).ravel()

    @staticmethod
    def _gain(n: np.ndarray, parent: np.ndarray) -> float:
        seen = n > 0
        gain = float((n[seen] * np.log((n[seen] / n.sum()) / (parent[seen] / parent.sum()))).sum())
        return gain - np.count_nonzero(seen) * (PENALTY + 0.5 * math.log(n.sum()))

    def score(self, texts: list[str | None]) -> np.ndarray:
        """log10 probability of each text."""
        out = []
        for starts, data in _segments(iter(texts)):
            b = np.frombuffer(data, dtype=np.uint8)
            state = np.zeros(len(b), dtype=np.int64)
            alive = np.arange(DEPTH, len(b))
            node = np.zeros(len(alive), dtype=np.int64)
            for k in range(1, DEPTH + 1):
                node = self.child[node * 256 + b[alive - k]].astype(np.int64)
                deeper = node > 0
                alive, node = alive[deeper], node[deeper]
                state[alive] = node
            value = np.where(_positions(starts, len(b)), self.log10[state * 256 + b], np.float32(0)).astype(np.float64)
            out.append(np.add.reduceat(value, starts))
        return np.concatenate(out) if out else np.zeros(0)


#: Rows of the pass over all texts: one for each text (its distinct words as numbers within the chunk, increasing and by
#: difference, with their counts) and one for each distinct word of a chunk.
_PASS = {
    "chunk": "long", "place": "int", "id": "string", "held_out": "boolean", "n_tokens": "long", "score": "double", "numbers": "binary",
    "counts": "binary", "number": "int", "word": "binary", "trained": "long",
}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary()}


def score_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` for every row.

    A null text counts as empty: its only token is the end. Rows without an id are trained on. Repeated rows are scored
    alike; an empty table gives an empty result; other columns of ``docs`` are left out.

    Word counts never gather in one place: each chunk of texts sends a row per distinct word, the rows meet the word's
    corpus count in a join (its larger side can be split), and the counts return to the texts of their chunk.
    """
    spark = docs.sparkSession
    id_type = docs.schema[doc_id].dataType
    held = F.coalesce(crc_of_id(F.col(doc_id)) % 5 == 1, F.lit(False))
    plain = docs.select(F.col(doc_id).cast("string").alias("id"), held.alias("held_out"), F.col(text).alias("text"))
    rows = contexts(window_counts(plain.where(~F.col("held_out")).select("text"))).collect()  # at most 1 + DEPTH / P_MIN
    tree = spark.sparkContext.broadcast(Tree(rows))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, at = TaskContext.get().partitionId() << 24, 0, 0
        ids: dict[bytes, int] = {}
        trained: list[tuple[np.ndarray, np.ndarray]] = []

        def words() -> Iterator[pa.RecordBatch]:
            """The chunk's words, some at a time: as one frame they took more memory than all else."""
            total = np.zeros(len(ids), dtype=np.int64)
            for number, n in trained:
                total[number] += n
            word = iter(ids)
            for i in range(0, len(ids), SENT):
                j = min(i + SENT, len(ids))
                yield _filled(pd.DataFrame({"chunk": chunk, "number": np.arange(i, j), "word": list(islice(word, j - i)), "trained": total[i:j]}))

        for part in _taken(batches):
            scores = tree.value.score(part[2])
            texts = []
            for i, (row_id, is_held_out, content) in enumerate(zip(*part)):
                own = Counter(tokens(content))
                own[b""] = 1
                number = np.fromiter((ids.setdefault(w, len(ids)) for w in own), dtype=np.int32, count=len(own))
                n = np.fromiter(own.values(), dtype=np.int32, count=len(own))
                order = np.argsort(number)
                number, n = number[order], n[order]
                n_tokens = int(n.sum())
                texts.append((
                    chunk, at, row_id, is_held_out, n_tokens, scores[i], np.diff(number, prepend=np.int32(0)).tobytes(), n.tobytes()
                ))
                if not is_held_out:
                    trained.append((number, n))
                at, size = at + 1, size + n_tokens
                if size >= CHUNK_WORDS:
                    yield from words()
                    ids, trained = {}, []
                    chunk, size, at = chunk + 1, 0, 0
            yield _filled(pd.DataFrame(texts, columns=list(_PASS)[:8]))
        if ids:
            yield from words()

    whole = materialise(plain.mapInArrow(passed, ", ".join(f"{c} {t}" for c, t in _PASS.items())))
    word_rows = whole.where(F.col("word").isNotNull())
    counts = materialise(word_rows.groupBy("word").agg(F.sum("trained").alias("c")).where(F.col("c") > 0))
    sums = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_all, n_words = sums[0] or 0, sums[1]

    def added_up(words: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        c = np.zeros(len(words))
        c[words["number"].to_numpy()] = words["c"].to_numpy()
        value, known = np.log10((c + 0.5) / (n_all + 0.5 * (n_words + 1))), c > 0
        base, seen = [], []
        for number, n in zip(held["numbers"], held["counts"]):
            number, n = np.cumsum(np.frombuffer(number, dtype=np.int32)), np.frombuffer(n, dtype=np.int32)
            base.append(float((value[number] * n).sum()))
            seen.append(int(n[known[number]].sum()))
        return pd.DataFrame({
            "id": held["id"].astype(object), "held_out": held["held_out"], "n_tokens": held["n_tokens"], "score": held["score"],
            "n_known": seen, "base_score": base,
        })

    known = word_rows.select("chunk", "number", "word").join(counts, "word", "left").select("chunk", "number", F.coalesce("c", F.lit(0)).alias("c"))
    texts = whole.where(F.col("word").isNull()).select(F.col("chunk").alias("of"), "id", "held_out", "n_tokens", "score", "numbers", "counts")
    scored = known.groupBy("chunk").cogroup(texts.groupBy("of")).applyInPandas(
        added_up, "id string, held_out boolean, n_tokens long, score double, n_known long, base_score double"
    )
    return scored.select(
        F.col("id").cast(id_type).alias(doc_id), "held_out", "n_tokens", "n_known", F.lit(n_all).cast("long").alias("train_tokens"),
        "base_score", "score",
    )


def _filled(part: pd.DataFrame) -> pa.RecordBatch:
    """All columns of the pass, in order."""
    return pa.RecordBatch.from_pydict({
        name: pa.array(part[name], _ARROW[kind], from_pandas=True) if name in part else pa.nulls(len(part), _ARROW[kind]) for name, kind in _PASS.items()
    })
