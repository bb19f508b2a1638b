"""Repeated windows against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from fairline.llm import windows
from fairline.llm.windows import LENGTH, WordHashes, anchored, intervals, without_repeated_windows

PLAIN = "doc_id long, text string"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def by_table(rows):
    split = [(i, WORDS.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in split:
        for k in range(len(words) - LENGTH + 1 if i is not None else 0):
            key = tuple(words[k : k + LENGTH])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, words in split:
        gone = [False] * len(words)
        for k in range(len(words) - LENGTH + 1 if i is not None else 0):
            if least[tuple(words[k : k + LENGTH])] < i:
                gone[k : k + LENGTH] = [True] * LENGTH
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def result(docs):
    return Counter(tuple(r)[:4] for r in without_repeated_windows(docs).collect())


def texts():
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 4)))
    passage = [word() for _ in range(140)]
    rows = [(900, "a " * 300), (901, "a " * 49), (902, "a\t" * 50), (903, "b c " * 200), (-5, " ".join(passage[:60]))]
    for i in range(80):
        body = [word() for _ in range(rng.randint(0, 120))]
        at, a = rng.randint(0, len(body)), rng.randint(0, 80)
        rows.append((i, " ".join(body[:at] + passage[a : a + rng.randint(40, 140)] + body[at:])))
    for i in range(40):  # near copies
        words = rows[30][1].split()
        words[rng.randrange(len(words))] = "#"
        rows.append((rng.randint(-10, 200), "\n".join(words)))
    # exact copies, also under one id
    rows += [(i, rows[40][1]) for i in (35, 35, 300, 301, 301, None)]
    return rows


def test_windows_by_table(spark):
    rows = texts()
    docs = spark.createDataFrame(rows, PLAIN).repartition(7)
    assert result(docs) == by_table(rows)


def test_one_hash_over_many_ranges(spark):
    """A passage of every row: its windows spread over ranges; the heads settle what a border cuts."""
    rng = random.Random(3)
    passage = " ".join(f"p{i}" for i in range(55))
    rows = [(i // 2, f"x{rng.random()} {passage} y{rng.random()}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert result(spark.createDataFrame(rows, PLAIN)) == by_table(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_judge_over_batches(size):
    rows = pd.DataFrame({"hash": [1, 1, 1, 2, 3, 3, 3, 3, 4, 4], "id": [5, 5, 6, 1, 2, 2, 3, 4, 7, 7], "number": range(10), "at": range(10)})
    out = pd.concat(windows._judge(rows.iloc[i : i + size] for i in range(0, 10, size)))
    assert list(out[out["kind"] == windows.GONE]["number"]) == [2, 6, 7]
    assert list(out[out["kind"] == windows.OPEN]["number"]) == [0, 1]
    assert out[out["kind"] == windows.HEAD][["hash", "id"]].values.tolist() == [[4, 7]]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_shared_over_batches(size):
    rows = pd.DataFrame({"anchor": [1, 2, 2, 3, 4, 4, 4, 5, 6], "number": range(9)})
    out = pd.concat(windows._shared(rows.iloc[i : i + size] for i in range(0, 9, size)))
    assert sorted(out["number"]) == [0, 1, 2, 4, 5, 6, 8]


def test_segments_agree(monkeypatch):
    rng = np.random.default_rng(5)
    words = rng.integers(0, 40, 5000).astype("U")
    hashes = WordHashes()
    h = hashes.of(list(words))
    (_, whole, anchors), = anchored(h, hashes)
    monkeypatch.setattr(windows, "SEGMENT", 700)
    parts = list(anchored(h, hashes))
    assert len(parts) > 5 and (np.concatenate([p[1] for p in parts]) == whole).all()
    assert (np.concatenate([p[2] for p in parts]) == anchors).all()


def test_intervals_are_maximal():
    assert intervals(np.array([7, 3, 53, 200, 3])) == [(3, 103), (200, 250)]
    assert intervals(np.array([0, 51])) == [(0, 50), (51, 101)] and intervals(np.array([], dtype=int)) == []


def test_odd_rows(spark, odd, empty, some):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert result(odd) == by_table(rows)
    assert without_repeated_windows(empty).count() == 0
    rows = [(r["doc_id"], r["text"]) for r in some.collect()]
    assert result(some) == by_table(rows)


def test_long_text(spark):
    body = " ".join(f"w{i % 5000}" for i in range(300_000))
    rows = [(1, body), (2, "start " + body), (3, " ".join(f"z{i}" for i in range(100_000)))]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], [tuple(x) for x in r["removed"]]) for r in without_repeated_windows(spark.createDataFrame(rows, PLAIN)).collect()}
    assert got == {1: (300_000, 0, []), 2: (300_001, 300_000, [(1, 300_001)]), 3: (100_000, 0, [])}
