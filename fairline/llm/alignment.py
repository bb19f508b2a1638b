"""Alignment of two tokenizers over the same bytes by galloping intersection of their token ends.

Texts are cut into units at spaces where both tokenizers start a token, and a unit is encoded and aligned once: both
token lists are turned into lists of byte offsets where tokens end. Every end of the shorter list is looked up in the
longer one by galloping: steps that double from the place of an end some way before it, then a binary search inside the
last step. Offsets where both end cut the lists into groups; differences of their ranks say which tokens share a group. Corpus-wide pair counts are taken a chunk of texts at a time: a chunk sends each of its id pairs
once, with the number of its texts that hold it, and gets back one table of counts for all its texts.
"""

from __future__ import annotations

import ctypes
import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise

#: UTF-8 bytes of texts taken together; a longer text is a chunk of its own.
CHUNK = 1 << 19
#: Texts turned into strings at once.
TAKEN = 256
#: Units that a worker remembers before it forgets those that one chunk alone held, and units encoded at once.
REMEMBERED, TOGETHER = 100_000, 2048
#: Units that are encoded as one run, split again at their ends; a unit of more characters is encoded alone.
RUN, LONG = 32, 256
#: Every so manieth end of the shorter list starts the gallop of those after it.
STRIDE = 64
#: Links of a group above which its ids are counted first.
LARGE = 1 << 12

# A space between two characters of which neither can be taken for white space or a mark by any Unicode version: both
# tokenizers start a token there whatever surrounds it.
_LOOSE = "\x00-\x20\x7f-\xa0 ᠎ -‏ -  -⁯▁　﻿"
_UNIT_EDGE = re.compile(f"(?<=[^{_LOOSE}]) (?=[^{_LOOSE}])")
#: Units that keep their edges when they are joined by single spaces.
_TIGHT = re.compile(f"[^{_LOOSE}](?:.*[^{_LOOSE}])?", re.DOTALL)


def byte_alphabet() -> dict[str, int]:
    """Characters that byte-level vocabularies write bytes with: printable ones stand for themselves, others from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class ByteTokens:
    """A byte-level tokenizer file, its strings of special tokens taken as plain text; a space is put before each text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        alphabet = byte_alphabet()
        spelled = {i: t for t, i in self.model.get_vocab(with_added_tokens=False).items()}
        self.bytes = [bytes(alphabet[c] for c in spelled[i]) if i in spelled else b"" for i in range(max(spelled) + 1)]

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast([" " + u for u in units], add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece file that adds the space itself; byte pieces are single bytes."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

        def spelled(i: int) -> bytes:
            piece = self.model.id_to_piece(i)
            return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode()

        self.bytes = [spelled(i) for i in range(self.model.vocab_size())]

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.model.encode(units, num_threads=1)


class Encoder:
    """Units between safe spaces, encoded and aligned once by both tokenizers and remembered."""

    def __init__(self, first: str, second: str):
        self.tokens = ByteTokens(first), PieceTokens(second)
        self.lengths = [np.array([len(t) for t in tokens.bytes], dtype=np.int64) for tokens in self.tokens]
        sizes = [len(tokens.bytes) for tokens in self.tokens]
        self.size, self.most = sizes[1], sizes[0] * sizes[1]
        plain = [str(i) for i in range(max(sizes))]
        self.spelled = [sign + t for sign in (";", ",", "|") for t in plain]
        self.shift = len(plain)
        self._forget()

    def _forget(self) -> None:
        self.place: dict[str, int] = {}
        self.flat = [np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int32)]
        self.begin = [np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)]
        self.same = np.zeros(0, dtype=bool)
        self.seen = np.zeros(0, dtype=np.int64)  # chunks that held the unit
        # of each unit: its groups and links, the groups written, its distinct linked id pairs and how often they are linked
        self.n_groups, self.n_links = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.written: list[str] = []
        self.pair_begin, self.pair, self.times = np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _renew(self) -> None:
        """Keep what several chunks held, the most frequent first, up to half of what may be remembered."""
        sizes = np.maximum(np.diff(self.pair_begin), np.maximum(*map(np.diff, self.begin)))
        kept = np.argsort(-self.seen, kind="stable")[: REMEMBERED // 2]
        kept = np.sort(kept[(self.seen[kept] > 1) & (np.cumsum(sizes[kept]) <= 4 * REMEMBERED)])
        units, written = [*self.place], self.written
        self.place = {units[i]: k for k, i in enumerate(kept.tolist())}
        self.written = [written[i] for i in kept.tolist()]
        for k, begin in enumerate(self.begin):
            many = np.diff(begin)[kept]
            self.flat[k], self.begin[k] = self.flat[k][_inside(begin[kept], many)], np.r_[0, np.cumsum(many)]
        many = np.diff(self.pair_begin)[kept]
        found = _inside(self.pair_begin[kept], many)
        self.pair, self.times, self.pair_begin = self.pair[found], self.times[found], np.r_[0, np.cumsum(many)]
        self.same, self.n_groups, self.n_links = self.same[kept], self.n_groups[kept], self.n_links[kept]
        self.seen = np.ones(len(kept), dtype=np.int64)

    def _alone(self, units: list[str]) -> Iterator[tuple[list[np.ndarray], list[np.ndarray], np.ndarray]]:
        """(ids, their numbers, whether both spell the unit) of units that are encoded one by one."""
        for i in range(0, len(units), TOGETHER):
            part = units[i : i + TOGETHER]
            encoded = [t.encode(part) for t in self.tokens]
            spelled = [[b"".join(map(t.bytes.__getitem__, ids)) for ids in e] for t, e in zip(self.tokens, encoded)]
            same = [a == b == (" " + u).encode() for u, a, b in zip(part, *spelled)]
            encoded = [[ids if s else [] for ids, s in zip(e, same)] for e in encoded]  # a text with other bytes has no tokens
            sizes = [np.fromiter(map(len, e), dtype=np.int64, count=len(e)) for e in encoded]
            yield [_flat(e, int(n.sum())) for e, n in zip(encoded, sizes)], sizes, np.array(same, dtype=bool)

    def _joined(self, units: list[str], apart: list[str]) -> Iterator[tuple[list[str], list[np.ndarray], list[np.ndarray]]]:
        """(units, ids, their numbers) of units that are encoded as runs of ``RUN``; units of runs with other bytes go ``apart``."""
        for i in range(0, len(units), TOGETHER):
            runs = [units[j : j + RUN] for j in range(i, min(i + TOGETHER, len(units)), RUN)]
            texts = [" ".join(run) for run in runs]
            encoded = [t.encode(texts) for t in self.tokens]
            spelled = [[b"".join(map(t.bytes.__getitem__, ids)) for ids in e] for t, e in zip(self.tokens, encoded)]
            good = [a == b == (" " + text).encode() for text, a, b in zip(texts, *spelled)]
            apart += chain.from_iterable(run for run, g in zip(runs, good) if not g)
            part = [*chain.from_iterable(run for run, g in zip(runs, good) if g)]
            if not part:
                continue
            until = np.cumsum(np.fromiter((len(u.encode()) + 1 for u in part), dtype=np.int64, count=len(part)))
            flat, sizes = [], []
            for e, lengths in zip(encoded, self.lengths):
                flat.append(_flat([ids for ids, g in zip(e, good) if g], sum(len(ids) for ids, g in zip(e, good) if g)))
                ends = np.cumsum(lengths[flat[-1]])
                at = np.searchsorted(ends, until)
                if not (ends[at] == until).all():  # a token that reaches over the end of a unit
                    break
                sizes.append(np.diff(at + 1, prepend=0))
            if len(sizes) == len(self.tokens):
                yield part, flat, sizes
            else:
                apart += part

    def _learn(self, units: list[str]) -> None:
        """Encode units, find the groups of each by one gallop for all, and remember what a text needs of them."""
        joinable, apart = [], []
        for u in units:
            (joinable if len(u) <= LONG and _TIGHT.fullmatch(u) else apart).append(u)
        learnt, flats, sizes, same = [], [], [], []
        for part, flat, many in self._joined(joinable, apart):
            learnt += part
            flats.append(flat)
            sizes.append(many)
            same.append(np.ones(len(part), dtype=bool))
        for flat, many, spelled in self._alone(apart):
            flats.append(flat)
            sizes.append(many)
            same.append(spelled)
        learnt += apart
        a, b = (np.concatenate(x) for x in zip(*flats))
        n_a, n_b = (np.concatenate(x) for x in zip(*sizes))
        # the units' tokens lie one after the other: every unit's end is a common end
        cut = a0, a1, b0, b1 = groups(np.cumsum(self.lengths[0][a]), np.cumsum(self.lengths[1][b]))
        owner = np.searchsorted(np.cumsum(n_a), a0, side="right")
        unit, pair, times = _codes(a.astype(np.int64), b.astype(np.int64), cut, owner, self.size, self.most)
        many = len(learnt)
        for k, (ids, n) in enumerate(((a, n_a), (b, n_b))):
            self.flat[k] = np.concatenate([self.flat[k], ids])
            self.begin[k] = np.concatenate([self.begin[k], self.begin[k][-1] + np.cumsum(n)])
        self.same = np.concatenate([self.same, *same])
        self.seen = np.concatenate([self.seen, np.zeros(many, dtype=np.int64)])
        self.n_groups = np.concatenate([self.n_groups, np.bincount(owner, minlength=many)])
        self.n_links = np.concatenate([self.n_links, _sums((a1 - a0) * (b1 - b0), owner, many)])
        self.pair_begin = np.concatenate([self.pair_begin, self.pair_begin[-1] + np.cumsum(np.bincount(unit, minlength=many))])
        self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        self.written += self._written(a, b, cut, n_a, n_b)
        self.place.update(zip(learnt, range(len(self.place), len(self.same))))

    def _written(self, a: np.ndarray, b: np.ndarray, cut: tuple[np.ndarray, ...], n_a: np.ndarray, n_b: np.ndarray) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each unit."""
        a0, a1, b0, b1 = cut
        out = np.empty(len(a) + len(b), dtype=np.int64)
        # an A token stands behind the B tokens of earlier groups, a B token behind the A tokens of its group too
        sign_a, sign_b = np.full(len(a), self.shift), np.full(len(b), self.shift)
        sign_a[a0], sign_b[b0] = 0, 2 * self.shift
        out[np.arange(len(a)) + np.repeat(b0, a1 - a0)] = a + sign_a
        out[np.arange(len(b)) + np.repeat(a1, b1 - b0)] = b + sign_b
        ends = np.cumsum(n_a + n_b)
        spelled = [*map(self.spelled.__getitem__, out.tolist())]
        return ["".join(spelled[i:j])[1:] for i, j in zip((ends - n_a - n_b).tolist(), ends.tolist())]

    def units(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place of each unit, its text); texts that are not spelled by both lists of tokens have none."""
        if len(self.place) > REMEMBERED or max(len(self.pair), *map(len, self.flat)) > 8 * REMEMBERED:
            self._renew()
        units = [_UNIT_EDGE.split(t) if t else [] for t in texts]
        if new := [u for u in dict.fromkeys(chain.from_iterable(units)) if u not in self.place]:
            self._learn(new)
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        at = np.fromiter(map(self.place.__getitem__, chain.from_iterable(units)), dtype=np.int64, count=int(sizes.sum()))
        held = np.zeros(len(self.same), dtype=bool)
        held[at] = True
        self.seen += held
        owner = np.repeat(np.arange(len(texts)), sizes)
        bad = np.bincount(owner[~self.same[at]], minlength=len(texts)) > 0
        return at[~bad[owner]], owner[~bad[owner]]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For both tokenizers (ids of all texts in a row, number of each text); no ids if bytes differ from a space and the text."""
        at, owner = self.units(texts)
        out = []
        for flat, begin in zip(self.flat, self.begin):
            many = begin[at + 1] - begin[at]
            out.append((flat[_inside(begin[at], many)].astype(np.int64), _sums(many, owner, len(texts))))
        return out


def _flat(ids: list[list[int]], many: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=many)


def _inside(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Places ``begin``, ``begin`` + 1, ... of every run of ``many``, one run after the other."""
    return np.arange(many.sum()) + np.repeat(begin - np.cumsum(many) + many, many)


@lru_cache(maxsize=1)
def encoder(first: str, second: str) -> Encoder:
    """One of a worker's process, so that its memory serves one task after the other."""
    return Encoder(first, second)


def _give_back() -> None:
    """Return freed memory to the system where the C library can; it otherwise keeps what lies between live objects."""
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Places in ``long`` of the first values not below those of ``short`` (both ascend); all gallops step side by side."""
    at = np.zeros(len(short), dtype=np.int64)
    if not len(short) or not len(long):
        return at
    # where the gallops start: the place of every STRIDE-th end
    low = np.repeat(np.searchsorted(long, short[::STRIDE]), STRIDE)[: len(short)] - 1
    step = np.ones(len(short), dtype=np.int64)
    live = np.arange(len(short))
    while len(live):  # exponential: double the step while it stays below the value
        reach = low[live] + step[live]
        inside = reach < len(long)
        on = np.zeros(len(live), dtype=bool)
        on[inside] = long[reach[inside]] < short[live[inside]]
        live = live[on]
        low[live] += step[live]
        step[live] *= 2
    high = np.minimum(low + step, len(long))
    live = np.flatnonzero(high - low > 1)
    while len(live):  # binary: long[low] < value <= long[high]
        middle = (low[live] + high[live]) // 2
        below = long[middle] < short[live]
        low[live[below]] = middle[below]
        high[live[~below]] = middle[~below]
        live = live[high[live] - low[live] > 1]
    at[:] = high
    return at


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into ``a`` and ``b`` of the ends that both have."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    hit = np.flatnonzero(at < len(long))
    hit = hit[long[at[hit]] == short[hit]]
    return (hit, at[hit]) if short is a else (at[hit], hit)


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first A, after A, first B, after B) of each group of two lists of token ends."""
    i, j = common_ends(a, b)
    return np.r_[0, i[:-1] + 1][: len(i)], i + 1, np.r_[0, j[:-1] + 1][: len(j)], j + 1


def _codes(a: np.ndarray, b: np.ndarray, cut: tuple[np.ndarray, ...], owner: np.ndarray, size: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of the distinct linked id pairs of each text; a pair is A's id times ``size`` plus B's, below ``most``."""
    a0, a1, b0, b1 = cut
    na, nb = a1 - a0, b1 - b0
    few = na * nb <= LARGE
    counts = (na * nb)[few]
    group = np.repeat(np.flatnonzero(few), counts)
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pair = a[a0[group] + inside // nb[group]] * size + b[b0[group] + inside % nb[group]]
    texts, pairs, times = [owner[group]], [pair], [np.ones(len(pair), dtype=np.int64)]
    for g in np.flatnonzero(~few):  # a large group: distinct ids with their numbers
        x, m = np.unique(a[a0[g] : a1[g]], return_counts=True)
        y, n = np.unique(b[b0[g] : b1[g]], return_counts=True)
        pairs.append((x[:, None] * size + y).ravel())
        times.append((m[:, None] * n).ravel())
        texts.append(np.full(len(pairs[-1]), owner[g]))
    text, pair, times = np.concatenate(texts), np.concatenate(pairs), np.concatenate(times)
    return _added(text * most + pair, times, most)


def _added(key: np.ndarray, times: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, pair, times) of distinct keys, a key being a text's number times ``most`` plus a pair."""
    if (times == 1).all():
        key, times = np.unique(key, return_counts=True)
    else:
        key, at = np.unique(key, return_inverse=True)
        times = _sums(times, at, len(key))
    return key // most, key % most, times


def _sums(values: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    out = np.zeros(many, dtype=np.int64)
    np.add.at(out, owner, values)
    return out


class Chunk:
    """Texts whose links are counted together, from the units that their encoder has aligned."""

    def __init__(self, encoder: Encoder, keep_groups: bool):
        self.encoder, self.keep_groups = encoder, keep_groups

    def row(self, ids: list, texts: list[str | None]) -> dict:
        known = self.encoder
        at, owner = known.units(texts)
        many = len(ids)
        n_a, n_b = (_sums(begin[at + 1] - begin[at], owner, many) for begin in known.begin)
        # a pair of a unit as often as the unit stands in the text
        links = known.pair_begin[at + 1] - known.pair_begin[at]
        found = _inside(known.pair_begin[at], links)
        text, pair, times = _added(np.repeat(owner, links) * known.most + known.pair[found], known.times[found], known.most)
        pairs, place, in_texts = np.unique(pair, return_inverse=True, return_counts=True)
        spelled = [*map(known.written.__getitem__, at.tolist())]
        ends = np.cumsum(np.bincount(owner, minlength=many)).tolist()
        written = [";".join(spelled[i:j]).encode() for i, j in zip([0, *ends], ends)]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        return {
            "ids": ids, "n_a": n_a.tolist(), "n_b": n_b.tolist(), "n_groups": _sums(known.n_groups[at], owner, many).tolist(),
            "n_links": _sums(known.n_links[at], owner, many).tolist(),
            "sha": [hashlib.sha256(w).hexdigest() if w else "" for w in written], "groups": [w.decode() for w in written] if self.keep_groups else None,
            "pairs": pairs, "in_texts": in_texts, "sizes": np.bincount(text, minlength=many).tolist(),
            "at": squeeze(place.astype(np.int32).tobytes()), "times": squeeze(times.tobytes()),
        }


#: Rows of chunks, but for their ids, which travel as text.
_CHUNK = {
    "chunk": "long", "ids": "array<string>", "n_a": "array<long>", "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>", "sha": "array<string>",
    "groups": "array<string>", "pairs": "array<long>", "in_texts": "array<long>", "sizes": "array<long>", "at": "binary", "times": "binary",
}
_SUMS = {"chunk": "long", "n_best": "array<long>", "count_sum": "array<long>"}
_ARROW = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}


def _ddl(columns: dict[str, str]) -> str:
    return ", ".join(f"{c} {t}" for c, t in columns.items())


def _encoded(docs: DataFrame, paths: tuple[str, str], text: str, doc_id: str, keep_groups: bool) -> DataFrame:
    kind = docs.schema[doc_id].dataType.simpleString()

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str | None, str | None]]:
        for batch in batches:
            for i in range(0, batch.num_rows, TAKEN):
                yield from zip(*[c.to_pylist() for c in batch.slice(i, TAKEN).columns])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, number = Chunk(encoder(*paths), keep_groups), TaskContext.get().partitionId() << 36
        ids, texts, held = [], [], 0

        def row() -> pa.RecordBatch:
            found = {"chunk": number, **chunks.row(ids, texts)}
            return pa.RecordBatch.from_arrays([pa.array([found[c]], _ARROW[t]) for c, t in _CHUNK.items()], names=[*_CHUNK])

        for row_id, content in taken(batches):
            if held and held + len(content or "") > CHUNK:
                yield row()
                ids, texts, held, number = [], [], 0, number + 1
                _give_back()
            ids.append(row_id)
            texts.append(content)
            held += len(content or "") + 64
        if ids:
            yield row()

    # ids travel as text, so that nulls and large numbers stay what they are
    plain = docs.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"))
    return plain.mapInArrow(read, _ddl(_CHUNK)).withColumn("ids", F.col("ids").cast(f"array<{kind}>"))


def _summed(chunk: pa.Table, found: pa.Table) -> pa.Table:
    """Sums over the links of each text of a chunk, with the counts that the chunk got back."""
    if encoder.cache_info().currsize:  # the worker has encoded texts before
        encoder.cache_clear()
        _give_back()
    unpack = zstandard.ZstdDecompressor().decompress
    sizes = np.array(chunk["sizes"][0].values, dtype=np.int64)
    at, times = (np.frombuffer(unpack(chunk[c][0].as_py()), dtype=t) for c, t in (("at", np.int32), ("times", np.int64)))
    order = np.argsort(found["pair"].to_numpy())  # by pair, as the chunk numbers its pairs
    n, best = found["n"].to_numpy()[order], found["best"].to_numpy()[order]
    owner = np.repeat(np.arange(len(sizes)), sizes)
    sums = [_sums(times * of[at], owner, len(sizes)) for of in (best, n)]
    return pa.table([chunk["chunk"], *[pa.array([x], pa.list_(pa.int64())) for x in sums]], names=[*_SUMS])


def align(docs: DataFrame, first: str, second: str, text: str = "text", doc_id: str = "doc_id", keep_groups: bool = False) -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` (and ``groups``) of every row.

    ``first`` is the path of a byte-level tokenizer file (A), ``second`` of a sentencepiece file (B). A links to B where
    their tokens share a group; the count of an id pair is the number of rows that link it; ``n_best`` counts the links
    whose pair has the highest count of its A id (ties included), ``count_sum`` adds up their counts. Rows whose text is
    null, empty or not spelled by both lists of tokens have zeros and ''. Repeated rows count each; null ids stay null;
    an empty table gives an empty result; other columns are ignored. A long text is a chunk of its own.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    chunks = materialise(_encoded(docs, (first, second), text, doc_id, keep_groups))
    pairs = chunks.select("chunk", F.explode(F.arrays_zip("pairs", "in_texts")).alias("p")).select("chunk", F.col("p.pairs").alias("pair"), F.col("p.in_texts").alias("n"))
    size = len(PieceTokens(second).bytes)
    counts = materialise(pairs.groupBy("pair").agg(F.sum("n").alias("n")))
    a_id = F.floor(F.col("pair") / size).cast("long")
    # one row for each id of A's vocabulary
    highest = counts.groupBy(a_id.alias("a")).agg(F.max("n").alias("most"))
    judged = counts.withColumn("a", a_id).join(F.broadcast(highest), "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))
    # the counts of one chunk at a time are held, whatever number of chunks a task gets
    found = pairs.select("chunk", "pair").join(judged, "pair").select(F.col("chunk").alias("of"), "pair", "n", "best").groupBy("of")
    summed = chunks.select("chunk", "sizes", "at", "times").groupBy("chunk").cogroup(found).applyInArrow(_summed, _ddl(_SUMS))
    columns = ["ids", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "sha", *(["groups"] if keep_groups else [])]
    rows = chunks.select("chunk", *[c for c in columns if c not in ("n_best", "count_sum")]).join(summed, "chunk")
    rows = rows.select(F.explode(F.arrays_zip(*columns)).alias("r")).select("r.*")
    return rows.withColumn("ids", F.col("ids").cast(kind)).withColumnsRenamed({"ids": doc_id, "sha": "groups_sha256"})
