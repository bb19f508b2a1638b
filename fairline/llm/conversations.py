"""Repair of conversations: cheapest edits to ``(s?(ua)+)?`` by bidirectional Dijkstra over the edit lattice.

A conversation becomes a row of symbols, one for each turn: its role's initial and whether it must go or is cut off. A
node of the lattice is (turns read, state of the pattern); edits are its edges. A forward and a reverse heap grow from
both ends until no cheaper or equally cheap crossing can come, and of the cheapest crossings the least audit is taken.

Turns are sorted over ranges by (conversation, turn), so a conversation of any length spreads over many tasks. A run of
turns that may go on elsewhere gives the cheapest way from each state to each other one; such pieces are joined in order.
The texts aren't part of this: only marks of them travel. The hash of a repaired conversation is defined over its text
from start to end, so its turns pass one task as a sorted stream, a batch at a time.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.llm.text import BLANKS

#: Costs of the edits; an undeleted cut-off turn costs more.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: States of the pattern: nothing yet, after a system turn, after a user's, after an assistant's.
STATES = 4
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The turn that an edit may set or insert in each state, and the state after it.
SPOKEN = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
ENDS = (0, 3)
FOLLOWS = {"su", "ua", "au"}
#: Symbols of a piece that is searched at once, and patterns that a worker remembers.
PIECE, REMEMBERED = 1024, 100_000
#: Symbols: a turn that must go; initials of other turns, in capitals if cut off.
GONE = "x"

Way = tuple[int, str]


def _ahead(symbol: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, letter, next state) of the edits that read a turn."""
    out = [(DELETE, "D", state)]
    if symbol != GONE:
        more = CUT if symbol.isupper() else 0
        if (after := STEP.get((state, symbol.lower()))) is not None:
            out.append((more, "K", after))
        out.append((REROLE + more, "R", SPOKEN[state][1]))
    return out


_SYMBOLS = "xsuaoSUAO"
_EDGES = {(c, q): _ahead(c, q) for c in _SYMBOLS for q in range(STATES)}
_BACK = {(c, r): [(cost, letter, q) for q in range(STATES) for cost, letter, to in _EDGES[c, q] if to == r] for c in _SYMBOLS for r in range(STATES)}
_INSERTED = {q: SPOKEN[q][1] for q in range(STATES)}
_UNINSERTED = {r: [q for q in range(STATES) if _INSERTED[q] == r] for r in range(STATES)}


def cheapest(symbols: str, start: int = 0, ends: tuple[int, ...] = ENDS) -> Way | None:
    """Least (cost, audit) of the ways from ``start`` before the first symbol to one of ``ends`` after the last.

    Entries pop by (cost, turns passed): an edge either costs something or passes a turn, so a popped node's audit is
    final on its side. Equal costs never have one audit begin another at the same node, so the least parts make the
    least whole.
    """
    n = len(symbols)
    ahead: dict[tuple[int, int], Way] = {(0, start): (0, "")}
    back: dict[tuple[int, int], Way] = {(n, q): (0, "") for q in ends}
    forward, reverse = [(0, 0, start)], [(0, 0, q) for q in ends]
    heapq.heapify(reverse)
    done_ahead, done_back = set(), set()
    best = None  # cost of the cheapest crossing so far

    def reach(labels: dict, others: dict, heap: list, node: tuple[int, int], way: Way, passed: int) -> None:
        nonlocal best
        old = labels.get(node)
        if old is None or way < old:
            labels[node] = way
            if old is None or way[0] < old[0]:
                heapq.heappush(heap, (way[0], passed, node[1]))
            met = others.get(node)
            if met is not None and (best is None or way[0] + met[0] < best):
                best = way[0] + met[0]

    if n == 0 and start in ends:
        best = 0
    while forward and reverse and (best is None or forward[0][0] + reverse[0][0] <= best):
        if forward[0][0] <= reverse[0][0]:
            cost, i, q = heapq.heappop(forward)
            if (i, q) in done_ahead:
                continue
            done_ahead.add((i, q))
            audit = ahead[i, q][1]
            if i < n:
                for more, letter, r in _EDGES[symbols[i], q]:
                    reach(ahead, back, forward, (i + 1, r), (cost + more, audit + letter), i + 1)
            reach(ahead, back, forward, (i, _INSERTED[q]), (cost + INSERT, audit + "I"), i)
        else:
            cost, passed, r = heapq.heappop(reverse)
            i = n - passed
            if (i, r) in done_back:
                continue
            done_back.add((i, r))
            audit = back[i, r][1]
            if i > 0:
                for more, letter, q in _BACK[symbols[i - 1], r]:
                    reach(back, ahead, reverse, (i - 1, q), (cost + more, letter + audit), passed + 1)
            for q in _UNINSERTED[r]:
                reach(back, ahead, reverse, (i, q), (cost + INSERT, "I" + audit), passed)
    if best is None:
        return None
    small, large = (ahead, back) if len(ahead) <= len(back) else (back, ahead)
    return best, min(ahead[v][1] + back[v][1] for v in small if v in large and ahead[v][0] + back[v][0] == best)


#: Ways from each state to each other one, by 4 * from + to.
Ways = list[Way | None]


def ways_through(symbols: str) -> Ways:
    return [cheapest(symbols, p, (q,)) for p in range(STATES) for q in range(STATES)]


def joined(first: Ways, second: Ways) -> Ways:
    """Ways through two pieces, one after the other."""
    out: Ways = []
    for p in range(STATES):
        for q in range(STATES):
            options = [(first[STATES * p + m], second[STATES * m + q]) for m in range(STATES)]
            costs = [a[0] + b[0] for a, b in options if a and b]
            least = min(costs, default=None)
            out.append(None if least is None else (least, min(a[1] + b[1] for a, b in options if a and b and a[0] + b[0] == least)))
    return out


def _last(column: Column) -> Column:
    """Last character that is no blank ('' if there is none)."""
    blanks = F.lit(" \t\n\x0b\x0c\r")
    return F.right(F.rtrim(column, blanks), F.lit(1))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text`` with known faults, chosen by crc32(``conv:turn``) % 20.

    0 drops a row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes it a user's. Nulls count as one
    space, in the key too; conversation and turn stay null.
    """
    def part(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(part(conv), F.lit(":"), part(turn)).cast("binary")) % 20
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), part(role).alias("role"), part(text).alias("text"), kind.alias("_kind"))
    rows = rows.where("_kind <> 0")
    hurt = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    said = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = rows.select("conv", "turn", said.alias("role"), hurt.alias("text"), times.alias("_times"))
    return out.withColumn("_time", F.explode("_times")).select("conv", "turn", "role", "text")


_MARKS = "blank long, duplicate long, truncated long, illegal long"
_PIECE_FIELDS = (
    f"conv {{kind}}, part int, open boolean, {_MARKS}, first_turn {{at}}, last_turn {{at}}, turns long, first_role string, last_role string, "
    "cost long, audit string, ways array<struct<cost:bigint,audit:string>>"
)


_TURN = ["conv", "turn", "role", "blank", "cut", "repeated", "n"]


class _Run:
    """What the sorted turns of one conversation add up to."""

    def __init__(self, conv):
        self.conv, self.symbols, self.counts = conv, [], dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.first_turn = self.last_turn = self.first_role = self.last_role = self.ways = None
        self.turns = 0

    def add(self, turn, role: str, blank: bool, cut: bool, repeated: bool, n: int) -> None:
        """``n`` equal turns; ``repeated`` if the same was said at an earlier turn."""
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        if self.first_role is None:
            self.first_role = initial
        elif self.last_role + initial not in FOLLOWS:
            self.counts["illegal"] += 1
        self.counts["illegal"] += n - 1
        self.last_role = initial
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if blank:
            self.counts["blank"] += n
        elif repeated:
            self.counts["duplicate"] += n
        else:
            self.counts["duplicate"] += n - 1
            self.counts["truncated"] += cut
            self.symbols.append(initial.upper() if cut else initial)
            n -= 1
        self.symbols.extend(GONE * n)
        while len(self.symbols) > PIECE:
            self._search(PIECE)

    def _search(self, n: int) -> None:
        ways = ways_through("".join(self.symbols[:n]))
        del self.symbols[:n]
        self.ways = ways if self.ways is None else joined(self.ways, ways)

    def row(self, part: int, open_: bool, remembered: dict[str, Way]) -> dict:
        way, ways = (None, None), None
        if open_ or self.ways is not None:
            self._search(len(self.symbols))
            ways = [None if w is None else {"cost": w[0], "audit": w[1]} for w in self.ways]
        else:
            symbols = "".join(self.symbols)
            way = remembered.get(symbols)
            if way is None:
                way = cheapest(symbols)
                if len(symbols) <= 32:
                    if len(remembered) >= REMEMBERED:
                        remembered.clear()
                    remembered[symbols] = way
        return {
            "conv": self.conv, "part": part, "open": open_ or ways is not None, **self.counts, "first_turn": self.first_turn, "last_turn": self.last_turn,
            "turns": self.turns, "first_role": self.first_role, "last_role": self.last_role, "cost": way[0], "audit": way[1], "ways": ways,
        }


def _pieces(schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Conversations of one sorted range: whole ones done, the first and the last open."""
        run, part, out, remembered = None, 0, [], {}
        first = True
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("part", *_TURN)]
            for part, conv, turn, role, blank, cut, repeated, n in zip(*columns):
                if run is None or conv != run.conv:
                    if run is not None:
                        out.append(run.row(part, first, remembered))
                        first = False
                        if len(out) >= 5000:
                            yield pa.RecordBatch.from_pylist(out, schema)
                            out = []
                    run = _Run(conv)
                run.add(turn, role, blank, cut, repeated, n)
        if run is not None:
            out.append(run.row(part, True, remembered))
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return read


def _composed(schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces sorted by (conversation, part), joined into conversations."""
        held = None

        def done(piece: dict) -> pa.RecordBatch:
            options = [piece["ways"][q] for q in ENDS if piece["ways"][q]]
            piece["cost"], piece["audit"] = min(options)
            return pa.RecordBatch.from_pylist([{**piece, "ways": None}], schema)

        for batch in batches:
            for piece in batch.to_pylist():
                piece["ways"] = [None if w is None else (w["cost"], w["audit"]) for w in piece["ways"]]
                if held is None or held["conv"] != piece["conv"]:
                    if held is not None:
                        yield done(held)
                    held = piece
                    continue
                held["ways"] = joined(held["ways"], piece["ways"])
                for c in ("blank", "duplicate", "truncated", "illegal", "turns"):
                    held[c] += piece[c]
                held["illegal"] += held["last_role"] + piece["first_role"] not in FOLLOWS
                if piece["first_turn"] is not None:
                    held["turns"] -= held["last_turn"] == piece["first_turn"]
                    held["first_turn"] = piece["first_turn"] if held["first_turn"] is None else held["first_turn"]
                    held["last_turn"] = piece["last_turn"]
                held["last_role"] = piece["last_role"]
        if held is not None:
            yield done(held)

    return read


def edited(audit: str, turns: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of the turns that an audit leaves, in order; deleted ones are left out."""
    state = 0
    for letter in audit:
        said = ("", "") if letter == "I" else next(turns)
        if letter == "D":
            continue
        if letter == "K":
            state = STEP[state, said[0][:1]]
        else:
            role, state = SPOKEN[state]
            said = role, said[1]
        yield letter, *said


_RESULT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]


class _Stream:
    """Rows of sorted conversations, each a head row and then its turns; a batch is in memory at a time."""

    def __init__(self, batches: Iterator[pa.RecordBatch]):
        self.rows = self._rows(batches)
        self.next = next(self.rows, None)

    @staticmethod
    def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "head", "role", "text")))

    def _turns(self) -> Iterator[tuple[str, str]]:
        while self.next is not None and self.next[1] is None:
            said, self.next = self.next[2:], next(self.rows, None)
            yield said

    def __iter__(self) -> Iterator[tuple[object, dict, Iterator]]:
        while self.next is not None:
            (conv, head, *_), self.next = self.next, next(self.rows, None)
            turns = self._turns()
            yield conv, head, edited(head["audit"], turns)
            for _ in turns:
                pass


def _digests(schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, head, left in _Stream(batches):
            digest, between = hashlib.sha256(), ""
            for _, role, text in left:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            out.append({"conv": conv, **head, "repaired_sha256": digest.hexdigest()})
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return read


def _turn_rows(schema: pa.Schema):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, _, left in _Stream(batches):
            for at, (letter, role, text) in enumerate(left):
                out.append({"conv": conv, "position": at, "role": role, "text": text, "edit": letter})
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return read


def _arrow(ddl: str) -> tuple[str, pa.Schema]:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return ddl, to_arrow_schema(StructType.fromDDL(ddl))


def _solved(turns: DataFrame, conv: str, turn: str, role: str, text: str, of: DataFrame | None) -> DataFrame:
    """Rows of sorted conversations: ``conv``, ``head`` (its faults and audit, on its first row only), ``role``, ``text``."""
    types = {f.name: f.dataType.simpleString() for f in turns.schema.fields}
    kind, at = types[conv], types[turn]
    space = F.lit(" ")
    said = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), space).alias("role"),
        F.coalesce(F.col(text).cast("string"), space).alias("text"),
    ).withColumn("digest", F.md5(F.col("text").cast("binary")))
    last = _last(F.col("text"))
    marks = said.select("conv", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"))
    # equal turns are one row with a count, so repeats shrink before they are shuffled
    counted = materialise(
        marks.groupBy("conv", "turn", "role", "digest").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.count(F.lit(1)).alias("n"))
    )
    again = materialise(
        counted.where(~F.col("blank")).groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("begun"), F.count(F.lit(1)).alias("turns"))
        .where("turns > 1").select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "begun")
    )
    same = counted["conv"].eqNullSafe(again["c"]) & (counted["role"] == again["r"]) & (counted["digest"] == again["d"])
    flagged = counted.join(again, same, "left").withColumn(
        "repeated", F.col("begun").isNotNull() & ~F.col("begun.turn").eqNullSafe(F.col("turn"))
    )
    order = ["conv", "turn", "role", "digest"]
    ranged = flagged.repartitionByRange(*order).sortWithinPartitions(*order)
    ddl, schema = _arrow(_PIECE_FIELDS.format(kind=kind, at=at))
    pieces = materialise(ranged.select(F.spark_partition_id().alias("part"), *_TURN).mapInArrow(_pieces(schema), ddl))
    # open pieces: two for each range, and one for a conversation of more than a piece
    open_ones = pieces.where("open").repartition("conv").sortWithinPartitions("conv", "part").mapInArrow(_composed(schema), ddl)
    solved = pieces.where("not open").unionByName(open_ones)
    gaps = F.coalesce(F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    solved = solved.select("conv", gaps, *_RESULT[1:])
    wanted = turns.select(F.col(conv).alias("c")) if of is None else of.select(F.col(conv).alias("c"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in _RESULT[:-1]]
    heads = wanted.distinct().join(solved, F.col("c").eqNullSafe(F.col("conv")), "left").select(
        F.col("c").alias("conv"), F.struct(*zero, F.coalesce("audit", F.lit("")).alias("audit")).alias("head")
    )
    rows = said.withColumn("head", F.lit(None)).unionByName(heads, allowMissingColumns=True)
    rows = rows.repartition("conv").sortWithinPartitions("conv", F.col("head").isNotNull().desc(), "turn", "role", "digest")
    return rows.select("conv", "head", "role", "text")


def repair_conversations(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", of: DataFrame | None = None
) -> DataFrame:
    """``conv``, ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` per conversation.

    Turns of a conversation come by ``turn`` (nulls first), then role, then md5 of the text; equal rows side by side.
    Null roles and texts count as one space. Each turn's first fault counts: blank (nothing but white space), duplicate
    (role and text said before), truncated (doesn't end in ``.!?``). The audit's letters are Keep, Rerole, Delete and
    Insert, of the cheapest edits the least in ASCII. Conversations of ``of`` (default: ``turns``) without turns have
    zeros and empty texts. A null id is a conversation of its own; other columns are ignored; no turns give no rows. An
    audit has a letter for each turn, so a conversation's number of turns is bounded by the size of a string (2^31).
    Long texts are only hashed.
    """
    kind = turns.schema[conv].dataType.simpleString()
    ddl, schema = _arrow(f"conv {kind}, gaps long, {_MARKS}, cost long, audit string, repaired_sha256 string")
    return _solved(turns, conv, turn, role, text, of).mapInArrow(_digests(schema), ddl).withColumnRenamed("conv", conv)


def repaired_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations: ``conv``, ``position`` (from 0), ``role``, ``text`` and the ``edit`` that gave the turn."""
    kind = turns.schema[conv].dataType.simpleString()
    ddl, schema = _arrow(f"conv {kind}, position long, role string, text string, edit string")
    return _solved(turns, conv, turn, role, text, None).mapInArrow(_turn_rows(schema), ddl).withColumnRenamed("conv", conv)
