"""Conversation repair against a plain walk over all states, turn by turn."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest

from fairline.llm import conversations
from fairline.llm.conversations import ENDS, cheapest, damaged, joined, repair_conversations, repaired_turns, ways_through
from fairline.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string, audit string, n int"
PATTERN = re.compile(r"(s?(ua)+)?")


def all_states(symbols, start=0, ends=ENDS):
    """Best (cost, audit) by taking every turn in order and keeping the best way to each state."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    spoken = {0: 2, 1: 2, 2: 3, 3: 2}

    def put(ways, state, way):
        ways[state] = min(ways.get(state, way), way)

    def with_inserts(ways):
        out = dict(ways)
        for state, (cost, audit) in ways.items():
            for _ in range(4):
                state, cost, audit = spoken[state], cost + 5, audit + "I"
                put(out, state, (cost, audit))
        return out

    ways = with_inserts({start: (0, "")})
    for symbol in symbols:
        new = {}
        for state, (cost, audit) in ways.items():
            put(new, state, (cost + 2, audit + "D"))
            if symbol != "x":
                more = 5 * symbol.isupper()
                put(new, spoken[state], (cost + 1 + more, audit + "R"))
                if (state, symbol.lower()) in step:
                    put(new, step[state, symbol.lower()], (cost + more, audit + "K"))
        ways = with_inserts(new)
    return min((ways[q] for q in ends if q in ways), default=None)


def test_every_short_row_of_symbols():
    for n in range(5):
        for symbols in map("".join, product("xsuaoSUAO", repeat=n)):
            assert cheapest(symbols) == all_states(symbols), symbols


def test_longer_rows_pieces_and_states():
    rng = random.Random(12)
    for _ in range(300):
        symbols = "".join(rng.choice("uauauaxsuaoUAO") for _ in range(rng.randint(0, 60)))
        assert cheapest(symbols) == all_states(symbols)
        cut = rng.randint(0, len(symbols))
        ways = joined(ways_through(symbols[:cut]), ways_through(symbols[cut:]))
        for p in range(4):
            for q in range(4):
                assert ways[4 * p + q] == all_states(symbols, p, (q,))
        assert min(ways[q] for q in ENDS if ways[q]) == cheapest(symbols)


def test_a_long_conversation_is_quick():
    rng = random.Random(1)
    symbols = "".join(rng.choice("uauauaxsuaoUAO") for _ in range(2000))
    begun = time.time()
    assert cheapest(symbols) == all_states(symbols) and time.time() - begun < 20


def brute(rows, convs):
    """Results of damaged rows (conv, turn, role, text) as the contract words them."""
    said = defaultdict(list)
    for conv, turn, role, text in rows:
        said[conv].append((turn, role, text))
    out = {}
    for conv in set(convs):
        turns = sorted(said[conv], key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), hashlib.md5(t[2].encode()).hexdigest()))
        seen, symbols, faults = set(), [], Counter()
        for _, role, text in turns:
            stripped = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            faults[fault] += 1
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        numbers = [t[0] for t in turns if t[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit = all_states("".join(symbols)) if turns else (0, "")
        left, state, rest = [], 0, iter(turns)
        for letter in audit:
            turn = None if letter == "I" else next(rest)
            if letter == "D":
                continue
            role = {0: "user", 1: "user", 2: "assistant", 3: "user"}[state] if letter in "RI" else turn[1]
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            left.append(role + ":" + ("" if turn is None else turn[2]))
        assert PATTERN.fullmatch("".join(t[0] for t in left))
        sha = hashlib.sha256("\n".join(left).encode()).hexdigest()
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha, left)
    return out


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def same(got, want):
    got = {r["conv_id"]: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in got}
    assert got == {c: w[:8] for c, w in want.items()}


def odd_turns():
    rng = random.Random(21)
    text = lambda: rng.choice(["Yes.", "No!", "Why?", "cut", "", " \t", "a b. ", "é…", "Yes.\n\n"])
    rows = [(1, None, None, None), (1, None, "user", "Hi."), (2, 5, "user", "Hi."), (None, 1, "user", "Hi."), (None, 2, "assistant", "Ho."), (3, 0, "", "x.")]
    rows += [(4, 3, "user", "Hi.")] * 5 + [(5, k, "assistant", "Same.") for k in range(9)]
    for conv in range(10, 90):
        for turn in range(rng.randint(1, 14)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, rng.choice([text(), text(), None])))
    for turn in range(150):
        rows.append((7, turn, ["user", "assistant"][turn % 2] if rng.random() < 0.9 else "tool", f"t{turn}." if rng.random() < 0.9 else "cut"))
    return rows


@pytest.mark.parametrize("piece,partitions", [(1024, 8), (8, 8), (16, 50)])
def test_conversations_by_brute_force(spark, monkeypatch, piece, partitions):
    monkeypatch.setattr(conversations, "PIECE", piece)
    rows = odd_turns()
    turns = spark.createDataFrame([(*r, "clash", 7) for r in rows], TURNS).repartition(3)
    hurt = brute_damage(rows)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(partitions == 8).lower())
    try:
        assert Counter(map(tuple, damaged(turns).collect())) == Counter(hurt)
        same(repair_conversations(turns).collect(), brute([(c, t, r or (" " if r is None else ""), " " if x is None else x) for c, t, r, x in rows], [r[0] for r in rows]))
        want = brute(hurt, [r[0] for r in rows])
        got = repair_conversations(damaged(turns), "conv", of=turns.select(turns["conv_id"].alias("conv"))).withColumnRenamed("conv", "conv_id")
        same(got.collect(), want)
        left = defaultdict(list)
        for r in sorted(repaired_turns(damaged(turns), "conv").collect(), key=lambda r: r["position"]):
            left[r["conv"]].append(r["role"] + ":" + r["text"])
        assert dict(left) == {c: w[8] for c, w in want.items() if w[8]}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_no_turns_and_the_given_table(spark):
    none = spark.createDataFrame([], TURNS)
    assert repair_conversations(none).count() == 0 and repaired_turns(none).count() == 0
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(QUERIES["op12_conversation_repair"](spark, folder).collect(), brute(brute_damage(rows), [r[0] for r in rows]))


def test_a_long_text(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a" * 2_000_000 + ".", "", 1), (1, 1, "assistant", "b" * 2_000_000, "", 1)], TURNS)
    row = repair_conversations(turns).first()
    assert (row["cost"], row["audit"], row["truncated"]) == (4, "DD", 1)
