"""Tokenizer alignment against the libraries on whole texts and plain loops."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from fairline.llm import alignment
from fairline.llm.alignment import Encoder, align, byte_alphabet, common_ends, gallop, groups

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
PLAIN = "doc_id long, text string"


class Whole:
    """Both libraries on whole texts."""

    def __init__(self):
        self.a = Tokenizer.from_file(A_PATH)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
        self.alphabet = byte_alphabet()

    def tokens(self, text):
        """((id, bytes), ...) of both, or nothing."""
        if not text:
            return [], []
        a = self.a.encode(" " + text, add_special_tokens=False).ids
        a = [(i, bytes(self.alphabet[c] for c in self.a.id_to_token(i))) for i in a]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            b.append((i, bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode()
        return (a, b) if b"".join(t for _, t in a) == whole == b"".join(t for _, t in b) else ([], [])


@pytest.fixture(scope="module")
def whole():
    return Whole()


def by_loops(whole, rows):
    found, held = [], Counter()
    for key, text in rows:
        a, b = whole.tokens(text)
        out, i, j, x, y = [], 0, 0, 0, 0
        ends_a = {x := x + len(t) for _, t in a}
        ends_b = {y := y + len(t) for _, t in b}
        both, at_a, at_b = sorted(ends_a & ends_b), 0, 0
        for end in both:
            left, right = [], []
            while at_a < end:
                left.append(a[i][0])
                at_a, i = at_a + len(a[i][1]), i + 1
            while at_b < end:
                right.append(b[j][0])
                at_b, j = at_b + len(b[j][1]), j + 1
            out.append((left, right))
        pairs = Counter((p, q) for left, right in out for p in left for q in right)
        held.update(pairs.keys())
        found.append((key, len(a), len(b), out, pairs))
    most = defaultdict(int)
    for (p, _), n in held.items():
        most[p] = max(most[p], n)
    rows = []
    for key, n_a, n_b, out, pairs in found:
        written = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in out)
        rows.append((
            key, n_a, n_b, len(out), sum(pairs.values()), sum(n for p, n in pairs.items() if held[p] == most[p[0]]),
            sum(n * held[p] for p, n in pairs.items()), hashlib.sha256(written.encode()).hexdigest() if out else "", written,
        ))
    return Counter(rows)


def result(docs):
    return Counter(tuple(r) for r in align(docs, A_PATH, B_PATH, keep_groups=True).collect())


def odd_texts():
    rng = random.Random(11)
    signs = "ab c\n\t  é😀'<>|s ▁\x00\x85​﻿中文1234.,\r"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    return texts + [
        None, "", " ", "\n", "  two  spaces ", "<|endoftext|> <s> </s> <unk> <0x41>", "▁", "it's we'll", "x" * 3000, "naïve façade " * 50, "ﬁne ½ Å", "á é",
        " " * 500, "\n" * 500, "ab " * 2000, "1234567890" * 200, "ẞß ſ", "퟿", "한국어 텍스트", "𝔘𝔫𝔦𝔠𝔬𝔡𝔢 text", "x\x1cy z\x1f w", "a᠎b c᠎ d",
    ]


def test_gallop_finds_every_place():
    rng = np.random.default_rng(2)
    for _ in range(500):
        n, m = rng.integers(0, 300, 2)
        long = np.unique(rng.integers(0, rng.integers(1, 2000), n))
        short = np.unique(rng.integers(0, rng.integers(1, 2000), m))
        assert (gallop(short, long) == np.searchsorted(long, short)).all()
        i, j = common_ends(short, long)
        assert (short[i] == np.intersect1d(short, long)).all() and (long[j] == short[i]).all()


def test_groups_of_ends():
    a0, a1, b0, b1 = groups(np.array([2, 3, 7, 9]), np.array([1, 3, 4, 9]))
    assert (a0.tolist(), a1.tolist(), b0.tolist(), b1.tolist()) == ([0, 2], [2, 4], [0, 2], [2, 4])
    assert [len(x) for x in groups(np.zeros(0, dtype=int), np.zeros(0, dtype=int))] == [0, 0, 0, 0]


def test_units_give_the_ids_of_whole_texts(whole):
    encoder = Encoder(A_PATH, B_PATH)
    texts = odd_texts()
    for part in (texts, *([t] for t in texts)):
        (a, n_a), (b, n_b) = encoder.encode(part)
        want = [whole.tokens(t) for t in part]
        assert n_a.tolist() == [len(x) for x, _ in want] and n_b.tolist() == [len(y) for _, y in want]
        assert a.tolist() == [i for x, _ in want for i, _ in x] and b.tolist() == [i for _, y in want for i, _ in y]


ENCODER = Encoder(A_PATH, B_PATH)
WHOLE = Whole()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from(" \n\t ab'sé ")), max_size=60))
def test_any_text(text):
    (a, _), (b, _) = ENCODER.encode([text])
    x, y = WHOLE.tokens(text)
    assert (a.tolist(), b.tolist()) == ([i for i, _ in x], [i for i, _ in y])


@pytest.mark.parametrize("chunk,large", [(1 << 20, 1 << 12), (200, 1)])
def test_alignment_by_loops(spark, monkeypatch, whole, chunk, large):
    monkeypatch.setattr(alignment, "CHUNK", chunk)
    monkeypatch.setattr(alignment, "LARGE", large)
    rows = [(k if k % 7 else None, t) for k, t in enumerate(odd_texts())] + [(3, "ab c")] * 3
    assert result(spark.createDataFrame(rows, PLAIN).repartition(4)) == by_loops(whole, rows)


def test_tables(spark, whole, odd, empty, some):
    assert align(empty, A_PATH, B_PATH).count() == 0
    for table in (odd, some):
        rows = [(r["doc_id"], r["text"]) for r in table.collect()]
        assert result(table) == by_loops(whole, rows)


def test_a_long_text(spark, whole):
    rows = [(1, "".join(chr(97 + (k * k) % 26) for k in range(2_000_000))), (2, "word " * 400_000)]
    got = align(spark.createDataFrame(rows, PLAIN), A_PATH, B_PATH).collect()
    for r, (_, text) in zip(sorted(got), rows):
        a, b = whole.tokens(text)
        assert (r["n_a"], r["n_b"]) == (len(a), len(b))


def test_units_are_encoded_in_runs_and_aligned_once(whole, monkeypatch):
    encoder, given_texts, ends = Encoder(A_PATH, B_PATH), [], []
    for tokens in encoder.tokens:
        monkeypatch.setattr(tokens, "encode", lambda units, f=tokens.encode: given_texts.append(len(units)) or f(units))
    monkeypatch.setattr(alignment, "gallop", lambda short, long, f=alignment.gallop: ends.append(len(short)) or f(short, long))
    words = [f"word{k}x" for k in range(3200)]
    texts = [" ".join(words), " ".join(reversed(words)), "ﬁne ½ " + words[0], "  " + words[1] + " ", None]
    chunk = alignment.Chunk(encoder, True)
    first = chunk.row(list(range(5)), texts)
    assert sum(given_texts) <= 2 * (3200 // 32 + 20)  # before: 6400, a text for each unit
    once = sum(ends)
    assert chunk.row(list(range(5)), texts) | {"pairs": 0, "in_texts": 0} == first | {"pairs": 0, "in_texts": 0}
    assert sum(ends) == once  # known units aren't searched again
    want = [whole.tokens(t) for t in texts]
    assert (first["n_a"], first["n_b"]) == ([len(a) for a, _ in want], [len(b) for _, b in want])


def test_a_worker_forgets_what_one_chunk_alone_held(monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 300)
    worker = alignment.Chunk(Encoder(A_PATH, B_PATH), True)
    often = [f"often{k}" for k in range(40)]
    for k in range(12):
        texts = [" ".join([*often, *[f"once{k}x{j}" for j in range(80)]]), "  " + " ".join(often[k:]), None]
        got, want = worker.row([1, 2, 3], texts), alignment.Chunk(Encoder(A_PATH, B_PATH), True).row([1, 2, 3], texts)
        assert all(np.array_equal(got[c], want[c]) for c in ("pairs", "in_texts")) and got | {"pairs": 0, "in_texts": 0} == want | {"pairs": 0, "in_texts": 0}
        known = worker.encoder
        assert len(known.place) == len(known.same) == len(known.seen) == len(known.written) <= 300 + 121
        assert k < 1 or set(often) <= set(known.place)
    before = len(known.place)
    known._renew()  # before: all forgotten
    assert len(known.place) < before and set(often) <= set(known.place) and known.pair_begin[-1] == len(known.pair) == len(known.times)


def test_a_task_holds_the_counts_of_one_chunk(spark):
    rows = [(k, f"some words {k} and more") for k in range(50)]
    plan = align(spark.createDataFrame(rows, PLAIN), A_PATH, B_PATH)._jdf.queryExecution().executedPlan().toString()
    # before: lists of all counts of many chunks at once, in the JVM and as rows in Python
    assert "collect_list" not in plan and "InPandas" not in plan and "FlatMapCoGroupsInArrow" in plan
