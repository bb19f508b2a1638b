"""Quality rules: robust multivariate outliers per language and source.

Every document becomes a short vector of transformed text statistics. For each (language, source), each language and
the whole table, a minimum-covariance-determinant estimate is found by concentration steps from a median start; a
document is kept if its Mahalanobis distance under the finest estimate with enough rows is below a chi-square limit.
Everything is a DataFrame expression. Vectors are rounded to integers, so sums don't depend on row order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairline.functions.arrays import let
from fairline.functions.durable import materialise
from fairline.llm.text import BLANKS, words

SYMBOLS = "[#*$%&|<>]"
#: Statistics are rounded to 1/SCALE.
SCALE = 1024
#: Share of rows that an estimate rests on.
SUPPORT = 0.75
#: Makes the covariance of the central 75 % of a 4-variate normal consistent: 0.75 / P(chi2_6 <= q), q the 75 % point of chi2_4.
CONSISTENCY = 1.4864
STEPS = 3
#: Upper 1e-5 point of chi-square with 4 degrees of freedom.
LIMIT = 28.47
#: Levels with fewer rows leave the verdict to the next coarser one; the coarsest is used whatever its size.
LEAST_ROWS = 60
DIMENSIONS = ("length", "symbols", "repeats", "lines")
#: Standard deviations below which a dimension isn't resolved (same order as DIMENSIONS); they keep the matrix regular.
#: Most texts hold no symbols at all, so theirs decides: a lone share above about 0.053 rejects (tables have 0.09 to 0.12).
FLOORS = (0.05, 0.01, 0.08, 0.08)


def _repeated_words(w: Column) -> Column:
    """Words that lie in a 3-word window found more than once (compared by 64-bit hash)."""
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, n - 2), F.slice(w, 2, n - 2), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    grams = F.when(n > 2, F.zip_with(pairs, F.slice(w, 3, n - 2), lambda p, c: F.xxhash64(p["a"], p["b"], c))).otherwise(
        F.array().cast("array<bigint>")
    )

    def covered(ordered: Column) -> Column:
        twice = F.filter(
            ordered,
            lambda e, k: (F.get(ordered, k - 1)["h"] == e["h"]) | F.coalesce(F.get(ordered, k + 1)["h"] == e["h"], F.lit(False)),
        )
        starts = F.sort_array(F.transform(twice, lambda e: e["i"]))
        return F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).alias("n")),
            lambda s, i: F.struct(i.alias("last"), (s["n"] + F.least(F.lit(3), i - s["last"])).alias("n")),
            lambda s: s["n"],
        )

    def slow(g: Column) -> Column:
        keyed = F.transform(g, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return let(F.sort_array(keyed), covered)

    return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(slow(g)))


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words (all long); a null text has zeros."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(f"[^{BLANKS}]"))
    counted = docs.withColumn(
        "_s",
        let(
            words(F.col(text)),
            lambda w: F.struct(
                F.size(w).alias("n_words"),
                F.length(F.array_join(w, "")).alias("word_chars"),
                _repeated_words(w).alias("n_repeat_words"),
            ),
        ),
    ).withColumn(
        "_l", let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    )
    return counted.select(
        *docs.columns,
        F.col("_s.n_words").cast("long").alias("n_words"),
        F.col("_s.word_chars").cast("long").alias("word_chars"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.col("_l.n").cast("long").alias("n_lines"),
        F.col("_l.dup").cast("long").alias("n_dup_lines"),
        F.col("_s.n_repeat_words").cast("long").alias("n_repeat_words"),
    )


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < 50) | (100 * n_repeat_words > 50 * n_words)


def _vector() -> list[Column]:
    """The transformed statistics as integers: log mean word length and three shares."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    values = (
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n),
        F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
        F.col("n_repeat_words") / n,
        F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    )
    return [F.floor(v * SCALE + 0.5).cast("long").alias(f"x{i}") for i, v in enumerate(values)]


def _key(*columns: str) -> Column:
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.concat_ws("\u0001", F.lit(str(len(columns))), *parts)


P = range(len(DIMENSIONS))


def _moments(rows: DataFrame) -> DataFrame:
    """Mean and covariance by level key from exact integer sums."""
    n = F.count(F.lit(1))
    sums = [F.sum(f"x{i}").alias(f"s{i}") for i in P]
    products = [F.sum(F.col(f"x{i}") * F.col(f"x{j}")).alias(f"s{i}{j}") for i in P for j in P if j <= i]
    t = rows.groupBy("level").agg(n.alias("n"), *sums, *products)
    return t.select("level", *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in P], *[
        (
            (F.col(f"s{i}{j}") / F.col("n") - (F.col(f"s{i}") / F.col("n")) * (F.col(f"s{j}") / F.col("n"))) * CONSISTENCY
            + F.lit((FLOORS[i] * SCALE) ** 2 if i == j else 0.0)
        ).alias(f"c{i}{j}")
        for i in P for j in P if j <= i
    ])


def _factor(t: DataFrame) -> DataFrame:
    """Cholesky factor ``l{i}{j}`` of ``c{i}{j}``, column by column."""
    for j in P:
        for i in P:
            if i < j:
                continue
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            t = t.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    return t.select("level", *[f"m{i}" for i in P], *[f"l{i}{j}" for i in P for j in P if j <= i])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: list[Column] = []
    for i in P:
        rest = F.col(f"x{i}") - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * z[k]
        z.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in z[1:]), z[0] * z[0])


def _bins(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """Rows with the class of their distance (1/32 steps of its logarithm): a quantile then has few distinct values."""
    return rows.join(estimate, "level").select("level", *[f"x{i}" for i in P], F.floor(F.log(1 + _distance()) * 32).alias("bin"))


def mcd_estimates(rows: DataFrame) -> DataFrame:
    """Level key -> mean and Cholesky factor of the central rows, from ``level`` and ``x0`` ... of all rows.

    ``rows`` is read several times and should be a written table. Medians and quantiles are exact: their values are
    small integers, so a partial aggregate holds a bounded map. The few rows per level are written after each step.
    """
    middle = materialise(rows.groupBy("level").agg(*[F.median(f"x{i}").alias(f"m{i}") for i in P]))
    spread = (
        rows.join(middle, "level")
        .groupBy("level")
        .agg(*[F.median(F.abs(F.col(f"x{i}") - F.col(f"m{i}"))).alias(f"d{i}") for i in P])
    )
    start = middle.join(spread, "level").select("level", *[f"m{i}" for i in P], *[
        (F.sqrt((F.col(f"d{i}") * 1.4826) ** 2 + (FLOORS[i] * SCALE) ** 2) if i == j else F.lit(0.0)).alias(f"l{i}{j}")
        for i in P for j in P if j <= i
    ])
    estimate = materialise(start)
    for _ in range(STEPS):
        binned = _bins(rows, estimate)
        cuts = materialise(binned.groupBy("level").agg(F.percentile("bin", SUPPORT).alias("cut")))
        central = binned.join(cuts, "level").where(F.col("bin") <= F.col("cut"))
        estimate = materialise(_factor(_moments(central)))
    return estimate


#: Columns that quality_rules adds, and names it uses meanwhile.
ADDED = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "distance", "kept")
_OWN = ("_s", "_l", "_k0", "_k1", "_k2", "_e", "_e0", "_e1", "_e2", "x0", "x1", "x2", "x3")


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", carry: list[str] | None = None
) -> DataFrame:
    """Statistics, ``base_failed``, ``distance`` (squared; null if base_failed) and ``kept`` for every row.

    ``carry`` names the columns of ``docs`` to return with them (all by default); those whose names clash with added or
    internal ones are left out. A null or empty text has no words and fails. Null languages and sources form levels of
    their own. Repeated rows are judged alike, and an empty table gives an empty result.
    """
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in ADDED + _OWN]
    needed = list(dict.fromkeys([*rest, text, lang, source]))
    stats = text_statistics(docs.select(*needed), text)
    stats = stats.withColumn("base_failed", base_failed(F.col("n_words"), F.col("n_repeat_words")))
    written = materialise(
        stats.select(*rest, *ADDED[:7], _key(lang, source).alias("_k2"), _key(lang).alias("_k1"), _key().alias("_k0"), *_vector())
    )
    judged = written.where(~F.col("base_failed"))
    rows = judged.select(F.explode(F.array("_k2", "_k1", "_k0")).alias("level"), *[f"x{i}" for i in P])
    sizes = rows.groupBy("level").agg(F.count(F.lit(1)).alias("rows"))
    estimate = materialise(mcd_estimates(rows).join(sizes, "level"))
    out = written
    for k in ("2", "1", "0"):
        held = estimate if k == "0" else estimate.where(F.col("rows") >= LEAST_ROWS)
        side = held.select(F.col("level").alias(f"_k{k}"), F.struct(*[c for c in estimate.columns if c != "level"]).alias(f"_e{k}"))
        out = out.join(side, f"_k{k}", "left")
    chosen = out.withColumn("_e", F.coalesce("_e2", "_e1", "_e0")).select(*rest, *ADDED[:7], *[f"x{i}" for i in P], "_e.*")
    distance = F.when(~F.col("base_failed"), _distance())
    return chosen.select(
        *rest, *ADDED[:7], distance.alias("distance"), F.coalesce(~F.col("base_failed") & (distance <= LIMIT), F.lit(False)).alias("kept")
    )
