"""Decontamination, substrings, near duplicates, scoring and the pipeline against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fairline.llm import near_duplicates as near
from fairline.llm import substrings, suffix_tree
from fairline.llm.components import connected_components
from fairline.llm.decontamination import contaminations, myers, normalised, pieces, rows_without_items
from fairline.llm.near_duplicates import Bands, bands_for, near_duplicates, shingles
from fairline.llm.substrings import without_repeats
from fairline.llm.suffix_tree import Tree, contexts, score_texts, window_counts

PLAIN = "doc_id long, text string"


def distance_by_table(item, text, budget):
    column, best = list(range(len(item) + 1)), None
    for end, c in enumerate(text, 1):
        new = [0]
        for i, p in enumerate(item, 1):
            new.append(min(column[i] + 1, new[-1] + 1, column[i - 1] + (p != c)))
        column = new
        if column[-1] <= budget and (best is None or column[-1] < best[0]):
            best = (column[-1], end)
    return best


def test_bit_parallel_distance():
    rng = random.Random(2)
    for _ in range(2000):
        item = "".join(rng.choice("abc") for _ in range(rng.randint(1, 80)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 60)))
        budget = rng.randint(0, 20)
        assert myers(item, text, budget) == distance_by_table(item, text, budget)


def test_pieces_cover_the_item():
    for n in (1, 7, 12, 13, 200):
        cut = pieces("x" * n)
        assert len(cut) == int(n * 0.08) + 1 and "".join(p for _, p in cut) == "x" * n


@pytest.mark.parametrize("block", [2_000_000, 600])
def test_contaminations(spark, some, odd, empty, block):
    rng = random.Random(4)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()[:12]]
    benchmark = spark.createDataFrame([*items, (900, None), (901, ""), (902, "?!")], "item_id long, text string")
    rows = []
    for i, (_, text) in enumerate(items):
        changed = list(text)
        for _ in range(i):
            changed[rng.randrange(len(changed))] = "#" if i % 2 else "q"
        rows.append((i, "Before it, " + "".join(changed) + " and after."))
    docs = spark.createDataFrame(rows, PLAIN)
    for table in (docs, some.select("doc_id", "text")):
        want = set()
        for r in table.collect():
            plain = normalised(r["text"])
            for key, text in items:
                item = normalised(text)
                hit = distance_by_table(item, plain, int(len(item) * 0.08)) if len(plain) < 3000 or item[:20] in plain else None
                if hit:
                    want.add((r["doc_id"], key, hit[0]))
        got = {(r["doc_id"], r["item_id"], r["distance"]) for r in contaminations(table, benchmark, block=block).collect()}
        assert want <= got and len(got) < len(want) + 3
    held = {x[0] for x in got}
    left = [r["doc_id"] for r in rows_without_items(some, benchmark, block=block).collect()]
    assert Counter(left) == Counter(r["doc_id"] for r in some.collect() if r["doc_id"] not in held)
    assert contaminations(odd, benchmark).count() == 0 and contaminations(empty, benchmark).count() == 0
    assert rows_without_items(odd, benchmark.limit(0)).count() == odd.count()


def removed_by_table(texts, length=200):
    seen = Counter(b[i : i + length] for b in texts for i in range(len(b) - length + 1))
    out = []
    for b in texts:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(b, dtype=np.uint8)[~gone])
        out.append((len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def substring_texts():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 8)))
    passage = " ".join(word() for _ in range(80))
    texts = ["", "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 600, "xyz" * 150, passage[:199], passage[:200]]
    for _ in range(60):
        body = [word() for _ in range(rng.randint(0, 150))]
        at, a = rng.randint(0, len(body)), rng.randint(0, 300)
        part = passage[a : a + rng.randint(150, 330)]
        texts.append(" ".join(body[:at]) + part + " ".join(body[at:]))
    near_copy = texts[20]
    for _ in range(40):
        i = rng.randrange(len(near_copy))
        texts.append(near_copy[:i] + "#" + near_copy[i + 1 :])
    return texts + [texts[30]] * 3


@pytest.mark.parametrize("hot", [20_000, 3])
def test_repeated_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(substrings, "HOT", hot)
    texts = substring_texts()
    docs = spark.createDataFrame([(i % 40, t) for i, t in enumerate(texts)], PLAIN).repartition(5)
    got = without_repeats(docs).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed_by_table([t.encode() for t in texts])


def test_hot_ranks_are_counted_as_rows(spark, monkeypatch):
    """One passage with different surroundings: no task gets the bytes of a hot rank's blocks."""

    def nothing(batches):
        for batch in batches:
            assert not len(batch)
            yield batch[["k1", "k2"]].assign(low=0, high=0)

    monkeypatch.setattr(substrings, "HOT", 1)
    monkeypatch.setattr(substrings, "_ranked", nothing)
    rng = random.Random(12)
    letters = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage = letters(230)
    texts = [letters(250) + passage + letters(250) for _ in range(50)] + [letters(600)] * 2
    got = without_repeats(spark.createDataFrame(list(enumerate(texts)), PLAIN).repartition(4)).collect()
    assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == removed_by_table([t.encode() for t in texts])


def test_repeated_substrings_of_tables(some, odd, empty, monkeypatch):
    monkeypatch.setattr(substrings, "SEGMENT", 1000)
    for docs in (some, odd):
        got = without_repeats(docs, keep_text=True).collect()
        want = removed_by_table([(r["text"] or "").encode() for r in docs.collect()])
        assert Counter((r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want
        assert all(hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] for r in got)
    assert without_repeats(empty).count() == 0


def links_by_pairs(rows):
    def runs(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, root = [runs(t) for _, t in rows], list(range(len(rows)))
    links = [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            root[find(a)] = find(b)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[find(i)] = min(smallest.get(find(i), doc), doc)
    return Counter((doc, smallest[find(i)], links[i]) for i, (doc, _) in enumerate(rows))


def near_rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    texts = ["", None, " ", "one", "one", "one two three", "One  two three"]
    for length in (12, 60, 150):
        base = [word() for _ in range(length)]
        texts.append(" ".join(base))
        for k in range(25):
            copy = list(base)
            for _ in range(k // 5):
                copy[rng.randrange(length)] = word()
            texts.append(" ".join(copy))
        texts += [" ".join(base)] * 3
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [512, 7])
def test_near_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rows = near_rows()
    docs = spark.createDataFrame(rows, PLAIN).repartition(4)
    assert Counter(tuple(r) for r in near_duplicates(docs).collect()) == links_by_pairs(rows)


def test_near_duplicates_of_tables(some, odd, empty):
    assert Counter(tuple(r) for r in near_duplicates(some).collect()) == links_by_pairs([(r["doc_id"], r["text"]) for r in some.collect()])
    assert near_duplicates(odd).count() == odd.count()
    assert near_duplicates(empty).count() == 0


def test_recall_of_bands():
    assert bands_for(0.8, 0.9999, 6) == math.ceil(math.log(1e-4) / math.log(1 - 0.8**6))
    rng, minhash, found = random.Random(1), Bands(bands_for(), near.ROWS), 0
    for t in range(200):
        words = [f"w{rng.random()}" for _ in range(120)]
        copy = list(words)
        for at in range(10, 120, 60):
            copy[at] = "changed"
        a, b = shingles(" ".join(words)), shingles(" ".join(copy))
        assert len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b))
        found += bool((minhash.of(a) == minhash.of(b)).any())
    assert found >= 199


def test_components(spark):
    edges = [(f"n{i:04d}", f"n{i + 1:04d}") for i in range(60)] + [("x", "y"), ("y", "x"), ("z", "z"), ("y", "w")]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert found == {**{f"n{i:04d}": "n0000" for i in range(61)}, "x": "w", "y": "w", "w": "w"}


def test_scores(some, odd, empty):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    for docs in (some, odd):
        rows = [(r["doc_id"], re.findall(r"[^\x20\x09-\x0D]+", low(r["text"])) + [None]) for r in docs.collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows]
        count = Counter(w for (_, words), h in zip(rows, held) if not h for w in words)
        total, kinds = sum(count.values()), len(count)
        want = sorted(
            (i is not None, i or 0, h, len(words), sum(count[w] > 0 for w in words), total, round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in words), 4))
            for (i, words), h in zip(rows, held)
        )
        got = [r.asDict() for r in score_texts(docs).collect()]
        assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == want
        assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    assert score_texts(empty).count() == 0


def test_tree_is_a_distribution_and_prefers_its_language(spark):
    texts = spark.createDataFrame([("the cat sat on the mat and the rat ran " * 30,)] * 20, "text string")
    tree = Tree(contexts(window_counts(texts)).collect())
    assert np.allclose((10 ** tree.log10.reshape(-1, 256).astype(float)).sum(axis=1), 1, atol=1e-4)
    alike, other = tree.score(["the cat sat on the mat", "zqj xv wkk pzq bn vvq x"])
    assert alike > other
    # one text alone: the product of its symbols' probabilities, the longest retained suffix of each
    text = b"\n\n\n\nthe cat\n"
    value = 0.0
    for i in range(4, len(text)):
        node, state = 0, 0
        for k in range(1, 5):
            node = int(tree.child[node * 256 + text[i - k]])
            if not node:
                break
            state = node
        value += float(tree.log10[state * 256 + text[i]])
    assert tree.score(["The  cat"])[0] == pytest.approx(value, rel=1e-6)


def test_rows_without_text_stay(spark):
    """Only rows repeated in full go, also among those without text or id."""
    rows = [(None, None, "en", "a", 0), (None, None, "de", "a", 0), (None, None, "en", "b", 0), (None, "", "en", "a", 0),
            (7, None, "en", "a", 0), (7, None, "en", None, 0), (7, "", "en", "a", 0), (0, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows * 2, "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.one_of_each_group(spark, docs, "")
    assert Counter(tuple(r) for r in left.collect()) == Counter(rows)


def test_pipeline(spark, tmp_path):
    """Each stage on its predecessor's rows, against what the operators' own tests define."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd_one = spark.createDataFrame([(None, None, None, None, None), (9001, "", "en", "a", 0)], docs.schema)
    docs = docs.unionByName(odd_one)
    held, (quality, near_stage, clean, private, mixed) = docs, [f for _, f in corpus_pipeline.STAGES]
    kept = quality(spark, held, sf).collect()
    assert {r["doc_id"] for r in kept} <= {r["doc_id"] for r in docs.collect()} and len(kept) > 100
    kept = spark.createDataFrame(kept, docs.schema)
    classes = {k for _, k, _ in links_by_pairs([(r["doc_id"], r["text"]) for r in kept.collect()])}
    unique = near_stage(spark, kept, sf)
    assert sorted(r["doc_id"] for r in unique.collect()) == sorted(classes) and unique.columns == docs.columns
    free = clean(spark, unique, sf)
    found = {r["doc_id"] for r in contaminations(unique, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in free.collect()} == classes - found
    safe = private(spark, free, sf)
    assert safe.columns == docs.columns and safe.count() == free.count()
    assert safe.where(F.col("text").rlike("[a-z0-9]@[a-z0-9]+[.]")).count() == 0
    assert safe.where("n_chars <> length(text)").count() == 0
    taken = mixed(spark, safe, sf).collect()
    assert taken and all(1 <= r["copies"] <= 3 for r in taken)
    result = corpus_pipeline.run(spark, sf)
    assert result.count() > 0 and set(docs.columns) <= set(result.columns)


def test_windows_are_counted_and_sent_some_at_a_time(monkeypatch):
    rng = np.random.default_rng(9)
    made = ["".join(map(chr, rng.integers(97, 123, n))) for n in (0, 1, 90_000, 40_000, 30_000)] + [None]
    monkeypatch.setattr(suffix_tree, "HELD", 40_000)
    monkeypatch.setattr(suffix_tree, "SEGMENT", 1 << 14)
    sent = []

    class Texts:  # takes the task's function; before, all of a task's windows came as one frame
        def mapInArrow(self, function, schema):
            sent.extend(function(iter([pa.RecordBatch.from_pydict({"text": made})])))
            return self

        def groupBy(self, *columns):
            return self

        def agg(self, *columns):
            return self

    window_counts(Texts())
    got = Counter()
    for batch in sent:
        got.update(dict(zip(batch["window"].to_pylist(), batch["n"].to_pylist())))
    want = Counter()
    for text in made:
        symbols = b"\n" * 4 + (text or "").encode() + b"\n"
        want.update(int.from_bytes(symbols[i : i + 5], "big") for i in range(len(symbols) - 4))
    assert got == want and max(b.num_rows for b in sent) <= 20_000
