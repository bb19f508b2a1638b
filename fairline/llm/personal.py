"""Personal data: fixed forms as seeds, then bootstrapped contextual extraction.

Addresses, card and phone numbers of fixed forms are found by pattern. They seed a graph of lexical patterns (the word
before an identifier) and instances (identifier-like tokens). Pattern and instance scores feed each other over a few
rounds: a pattern is worth the share of the documents using its word in which a scored instance follows (copies of a
text are one document), an instance is as likely as its patterns make it. Patterns of high worth then label tokens that no fixed form covers. Only
DataFrame expressions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.arrays import let
from fairline.functions.durable import materialise
from fairline.llm.text import BLANKS, words

KINDS = ("email", "ip", "card", "phone")
_LOCAL, _DOMAIN = "[A-Za-z0-9._%+-]", "[A-Za-z0-9-]"
_BYTE = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
# Loops that need no backtracking are possessive. A match can begin only where a run begins or the last match ended;
# saying so keeps long runs linear.
FORMS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_DOMAIN}++(?:\.{_DOMAIN}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain for a form to occur at all.
_HINT = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][ -]?[0-9]", "phone": "\\+[0-9]"}
#: Identifier-like tokens: words with a digit or @, joined over single spaces.
_TOKEN = rf"(?=[^{BLANKS}]*[0-9@])[^{BLANKS}]++"
TOKENS = rf"(?<![^{BLANKS}]){_TOKEN}(?:\x20{_TOKEN})*+"
#: Rounds of scoring, seeds a pattern needs, and the score from which it labels tokens.
ROUNDS, SUPPORT, CONFIDENT = 3, 3, 0.5
_SPANS = "array<struct<start:int,end:int,found:string>>"


def found_spans(text: Column, pattern: str, hint: str) -> Column:
    """Spans (start, end, found) of the leftmost non-overlapping matches, in code points."""

    def fold(pairs: Column) -> Column:
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
            lambda s, p: F.struct(
                (s["at"] + F.length(p["gap"]) + F.length(p["found"])).alias("at"),
                F.concat(s["out"], F.array(F.struct(
                    (s["at"] + F.length(p["gap"])).alias("start"),
                    (s["at"] + F.length(p["gap"]) + F.length(p["found"])).alias("end"), p["found"].alias("found"),
                ))).alias("out"),
            ),
            lambda s: s["out"],
        )

    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = let(hits, lambda m: F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(m)).alias("gap"), m.alias("found")))
    return F.when(text.rlike(hint), fold(pairs)).otherwise(F.array().cast(_SPANS))


def _digits(found: Column) -> Column:
    return F.regexp_replace(found, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit is right; digits are doubled at every second place from the end."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    total = F.aggregate(
        F.transform(each, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)), F.lit(0), lambda s, d: s + d
    )
    return total % 10 == 0


def _valid(kind: str, found: Column) -> Column:
    if kind == "ip":
        return found.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")
    if kind == "card":
        return let(_digits(found), lambda d: F.when((F.length(d) >= 13) & (F.length(d) <= 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(found)).between(9, 15)
    return F.lit(True)


def _form(text: Column, k: int) -> Column:
    """Valid matches of the k-th form as (kind, start, end)."""
    kind = KINDS[k]
    valid = F.filter(found_spans(text, FORMS[kind], _HINT[kind]), lambda x: _valid(kind, x["found"]))
    return F.transform(valid, lambda x: F.struct(F.lit(k).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))


def _context(text: Column) -> Column:
    """Identifier-like tokens without outer punctuation, each with the word before it in lower case (^ at the start)."""
    outer = F.lit("\"'()[]{}<>.,;:!?=")

    def word_before(gap: Column, before: Column) -> Column:
        last = F.element_at(F.split(F.rtrim(gap, F.lit(" \t\n\u000b\f\r")), f"[{BLANKS}]"), -1)
        return let(last, lambda w: F.lower(F.when(w != "", w).otherwise(F.coalesce(before, F.lit("^")))))

    spans = found_spans(text, TOKENS, "[0-9@]")

    def described(s: Column) -> Column:
        return F.transform(s, lambda x, i: F.struct(
            (x["start"] + F.length(x["found"]) - F.length(F.ltrim(x["found"], outer))).alias("start"),
            (x["end"] - F.length(x["found"]) + F.length(F.rtrim(x["found"], outer))).alias("end"),
            F.trim(x["found"], outer).alias("found"),
            word_before(
                F.substring(text, F.coalesce(F.get(s, i - 1)["end"], F.lit(0)) + 1, x["start"] - F.coalesce(F.get(s, i - 1)["end"], F.lit(0))),
                F.get(s, i - 1)["found"],
            ).alias("before"),
        ))

    return F.filter(let(spans, described), lambda x: x["found"] != "")


def _plausible(kind: Column, found: Column) -> Column:
    digits = F.length(_digits(found))
    return (
        F.when(kind == "email", found.rlike(".@."))
        .when(kind == "ip", found.rlike("^[0-9A-Fa-f]+([.:][0-9A-Fa-f]*){3,}$"))
        .when(kind == "card", digits.between(12, 19) & ~found.rlike("[A-Za-z]{3}"))
        .otherwise(digits.between(7, 15) & found.rlike("^[+0-9(][0-9 ().+-]*$"))
    )


def _scored(candidates: DataFrame, texts: DataFrame) -> DataFrame:
    """Patterns that may label tokens: ``before``, ``kind`` and ``worth``."""
    kind = F.explode(F.when(F.col("seed").isNotNull(), F.array("seed")).otherwise(F.array(*[F.lit(k) for k in KINDS])))
    pairs = candidates.groupBy("before", "found", "seed").agg(F.count(F.lit(1)).alias("n"))
    edges = materialise(
        pairs.withColumn("kind", kind)
        .where(F.col("seed").isNotNull() | _plausible(F.col("kind"), F.col("found")))
        .select("before", "found", "kind", F.col("seed").isNotNull().cast("double").alias("seeded"))
        .groupBy("before", "found", "kind").agg(F.max("seeded").alias("seeded"))
    )
    heads = materialise(edges.groupBy("before").agg(F.countDistinct("found").alias("n")).where(F.col("n") >= SUPPORT).select("before"))
    hashed = texts.select(F.md5("text").alias("doc"), "text")
    copied = materialise(hashed.groupBy("doc").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    used = hashed.select(
        "doc", F.explode(F.array_distinct(F.transform(words(F.col("text")), lambda w: F.lower(w)))).alias("before")
    ).join(heads, "before").join(copied, "doc", "left")
    # every copy of a text has its words, so a count of rows is a multiple of the copies
    by_copies = used.groupBy("before", F.coalesce("copies", F.lit(1)).alias("copies")).agg(F.count(F.lit(1)).alias("rows"))
    uses = materialise(by_copies.groupBy("before").agg(F.sum(F.expr("rows div copies")).alias("uses")))
    linked = materialise(edges.join(uses, "before"))
    # documents with the same instances after a word are counted together
    follows = (
        candidates.select("doc", "before", "found").join(uses.select("before"), "before", "left_semi")
        .groupBy("doc", "before").agg(F.sort_array(F.collect_set("found")).alias("founds"))
    )
    groups = materialise(
        follows.groupBy("before", "founds").agg(F.count(F.lit(1)).alias("docs"))
        .select("before", F.monotonically_increasing_id().alias("group"), "docs", F.explode("founds").alias("found"))
    )
    members = materialise(groups.join(edges.select("before", "found", "kind"), ["before", "found"]))
    score = linked.groupBy("found", "kind").agg(F.max("seeded").alias("score"))
    worth = None
    for _ in range(ROUNDS):
        support = linked.join(score.where(F.col("score") >= CONFIDENT), ["found", "kind"]).groupBy("before", "kind").agg(
            F.count(F.lit(1)).alias("support"), F.max("uses").alias("uses")
        )
        # a document is as sure as its likeliest instance
        each = members.join(score, ["found", "kind"]).groupBy("before", "kind", "group").agg(
            F.max("score").alias("score"), F.max("docs").alias("docs")
        )
        mass = each.groupBy("before", "kind").agg(F.sum(F.col("score") * F.col("docs")).alias("mass")).join(support, ["before", "kind"])
        worth = materialise(
            mass.where(F.col("support") >= SUPPORT)
            .select("before", "kind", F.least(F.lit(1.0), F.col("mass") / F.col("uses")).alias("worth"))
        )
        unlikely = F.exp(F.sum(F.log(F.greatest(F.lit(1e-6), 1 - F.col("worth")))))
        score = materialise(
            linked.join(worth, ["before", "kind"], "left")
            .groupBy("found", "kind")
            .agg(F.greatest(F.max("seeded"), F.coalesce(1 - unlikely, F.lit(0.0))).alias("score"))
        )
    return worth.where(F.col("worth") >= CONFIDENT)


def personal_data(docs: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``base`` and ``spans``: arrays of (rank of kind, start, end), beside the columns of ``carry`` (all by default).

    ``base`` holds the fixed forms, ``spans`` these and the discovered ones, ordered by kind, then start. Null and empty
    texts have none. Repeated rows get the same spans; an empty table gives an empty result; columns named like added
    ones are left out. A text's own spans are one row's work; seeds, patterns and instances are joined as tables.
    """
    added = ("base", "spans", "_row", "_doc", "_more", "_tokens", "_text")
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    whole = F.coalesce(F.col(text), F.lit(""))
    forms = [_form(whole, k) for k in range(len(KINDS))]
    written = materialise(
        docs.select(*rest, F.concat(*forms).alias("base"), _context(whole).alias("_tokens"), F.md5(whole).alias("_doc"),
                    F.monotonically_increasing_id().alias("_row"))
    )

    def kind_of(t: Column) -> Column:
        over = F.filter("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))
        return F.get(F.array(*[F.lit(k) for k in KINDS]), F.get(over, F.lit(0))["kind"])

    tokens = written.where(F.size("_tokens") > 0).select(
        "_row", F.col("_doc").alias("doc"),
        F.explode(F.transform("_tokens", lambda t: F.struct(
            t["start"].alias("start"), t["end"].alias("end"), t["found"].alias("found"), t["before"].alias("before"), kind_of(t).alias("seed")
        ))).alias("t"),
    ).select("_row", "doc", "t.*")
    tokens = materialise(tokens)
    patterns = _scored(tokens, docs.select(whole.alias("text")))
    fresh = tokens.where(F.col("seed").isNull()).join(patterns, "before").where(_plausible(F.col("kind"), F.col("found")))
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    # one kind for a token: the worthiest, then the first listed
    best = fresh.groupBy("_row", "start", "end").agg(F.min(F.struct((-F.col("worth")).alias("w"), place.alias("kind")))["kind"].alias("kind"))
    more = best.groupBy("_row").agg(F.collect_list(F.struct("kind", "start", "end")).alias("_more"))
    joined = written.drop("_tokens", "_doc").join(more, "_row", "left")
    every = F.array_sort(F.concat("base", F.coalesce("_more", F.array().cast("array<struct<kind:int,start:int,end:int>>"))))
    return joined.select(*rest, "base", every.alias("spans"))


def count_of(spans: Column, k: int) -> Column:
    """Spans of the k-th kind."""
    return F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long")


def written_spans(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span (overlapping ones as one) replaced by its first kind in angle brackets."""
    names = F.array(*[F.lit(f"<{k}>") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda a, s: F.struct(
            F.greatest(a["at"], s["end"]).alias("at"),
            F.when(s["start"] < a["at"], a["out"]).otherwise(F.concat(a["out"], F.array(
                F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.element_at(names, s["kind"] + 1)))).alias("out"),
        ),
        lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))),
    )
