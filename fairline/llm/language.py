"""Language identification in two steps: the family first, then one-versus-one linear machines within it.

Texts become hashed counts of letter trigrams, square-rooted and scaled to length one. A linear machine per family pair
picks the family; within it every pair of languages has its own machine, and the language with most votes wins. All
machines are Spark's linear support vector machines, fitted on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import regex
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairline.functions.durable import materialise
from fairline.llm.text import crc_of_id

#: Languages by family (codes of ISO 639-1); a language named nowhere is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is", "af"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "pl", "cs", "sk", "uk", "bg", "sr", "hr", "sl"),
}
#: Labelled rows of a language that the machines are fitted on, about; the rest only get predictions.
SAMPLE = 1500
BUCKETS = 1 << 12
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_SPACED = np.array([b if (97 <= b <= 122 or b >= 128) else 32 for b in range(256)], dtype=np.uint32)


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def features(text: str | None) -> np.ndarray:
    """Trigrams of the whole text's bytes, all but letters read as blanks; the length of the vector is 1 or 0."""
    b = _SPACED[np.frombuffer(("  " + (text or "").lower() + "  ").encode(), dtype=np.uint8)]
    code = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    code = code[(b[1:-1] != 32) | (b[:-2] != 32)]
    bucket = (code * np.uint32(2654435761)) >> np.uint32(32 - BUCKETS.bit_length() + 1)
    v = np.sqrt(np.bincount(bucket, minlength=BUCKETS).astype(np.float64))
    norm = np.sqrt((v * v).sum())
    return v / norm if norm else v


def families(languages: list[str], known: dict[str, tuple[str, ...]]) -> dict[str, list[str]]:
    named = {lang: family for family, members in known.items() for lang in members}
    out: dict[str, list[str]] = {}
    for lang in sorted(languages):
        out.setdefault(named.get(lang, f"={lang}"), []).append(lang)
    return dict(sorted(out.items()))


class Machines:
    """Pairwise linear machines among the members of one group."""

    def __init__(self, names: list[str]):
        self.names, self.pairs, self.weights, self.offsets = names, list(combinations(range(len(names)), 2)), [], []

    def fit(self, rows: DataFrame, label: str) -> Machines:
        """``rows`` has ``x`` and the column ``label`` with the members' names."""
        for i, j in self.pairs:
            pair = rows.where(F.col(label).isin(self.names[i], self.names[j]))
            model = LinearSVC(featuresCol="x", labelCol="y", maxIter=25, regParam=1e-4, standardization=False).fit(
                pair.select("x", (F.col(label) == self.names[i]).cast("double").alias("y"))
            )
            self.weights.append(model.coefficients.toArray())
            self.offsets.append(model.intercept)
        return self

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of ``x`` the member with most votes (then the larger margins) and how sure it is, 0 to 1."""
        if not self.pairs:
            return np.zeros(len(x), dtype=int), np.ones(len(x))
        margin = x @ np.array(self.weights).T + np.array(self.offsets)
        sure = 1 / (1 + np.exp(-np.clip(2 * margin, -50, 50)))
        votes = np.zeros((len(x), len(self.names)))
        support = np.zeros_like(votes)
        for k, (i, j) in enumerate(self.pairs):
            votes[:, i] += margin[:, k] >= 0
            votes[:, j] += margin[:, k] < 0
            support[:, i] += sure[:, k]
            support[:, j] += 1 - sure[:, k]
        best = np.argmax(votes + support / (4 * len(self.names)), axis=1)
        return best, support[np.arange(len(x)), best] / (len(self.names) - 1)


class Model:
    """Family machines, and machines within each family."""

    def __init__(self, rows: DataFrame, languages: list[str], known: dict[str, tuple[str, ...]]):
        self.families = families(languages, known)
        names = list(self.families)
        family_of = F.create_map(*[F.lit(v) for f, members in self.families.items() for m in members for v in (m, f)])
        rows = rows.withColumn("family", family_of[F.col("lang")])
        self.top = Machines(names).fit(rows, "family")
        self.within = [Machines(self.families[f]).fit(rows, "lang") for f in names]

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        family, sure = self.top.predict(x)
        lang, score = np.empty(len(x), dtype=object), np.zeros(len(x))
        for k, machines in enumerate(self.within):
            at = np.flatnonzero(family == k)
            if len(at):
                best, own = machines.predict(x[at])
                lang[at] = np.array(machines.names, dtype=object)[best]
                score[at] = sure[at] * own
        return lang, score


def labelled_sample(docs: DataFrame, text: str, lang: str, doc_id: str, sample: int) -> tuple[DataFrame, list[str]]:
    """About ``sample`` distinct texts per language, the first by a hash, written with their vectors; and the languages.

    Every language has at least its first text.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.md5(F.col(text)).alias("h")
    )
    # sizes in distinct texts, and the first hash, by language: a handful of rows
    hashes = rows.select("lang", "h").distinct()
    counts = {
        r["lang"]: (r["n"], r["first"]) for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("first")).collect()
    }
    if not counts:
        return rows.select("lang"), []
    share = F.create_map(*[F.lit(v) for name, (n, _) in counts.items() for v in (name, min(1.0, sample / n))])
    first = F.create_map(*[F.lit(v) for name, (_, h) in counts.items() for v in (name, h)])
    place = F.conv(F.substring("h", 1, 12), 16, 10).cast("double") / float(16**12)

    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        return texts.map(features)

    drawn = (place <= share[F.col("lang")]) | (F.col("h") == first[F.col("lang")])
    chosen = rows.where(drawn).dropDuplicates(["lang", "h"])
    return materialise(chosen.select("lang", vector("text").alias("v"))), sorted(counts)


def held_out(doc_id):
    return F.coalesce(crc_of_id(doc_id) % 4 == 2, F.lit(False))


def language_id(
    docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", sample: int = SAMPLE,
    known: dict[str, tuple[str, ...]] = FAMILIES, carry: list[str] | None = None,
) -> DataFrame:
    """``held_out``, ``lang_pred`` and ``score`` (0 to 1) beside the columns of ``carry`` (all by default).

    Null texts and texts without a letter get ``und`` with score 0, as do all if no row is labelled. With one learned
    language every other text gets it with score 1. Rows without an id may be learned from. Repeated rows get the same
    prediction; columns with the added names are left out.
    """
    added = ("held_out", "lang_pred", "score", "_text", "_p")
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    rows, languages = labelled_sample(docs, text, lang, doc_id, sample)
    model = Model(rows.select("lang", array_to_vector("v").alias("x")).cache(), languages, known) if languages else None
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def predicted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        fitted = sent.value
        for batch in batches:
            out = pd.DataFrame({"lang": UNKNOWN, "score": 0.0}, index=range(len(batch)))
            at = [i for i, t in enumerate(batch) if has_letter(t)] if fitted else []
            for k in range(0, len(at), 512):
                part = at[k : k + 512]
                found, score = fitted.predict(np.stack([features(batch.iloc[i]) for i in part]))
                out.loc[part, "lang"] = found
                out.loc[part, "score"] = score
            yield out

    return docs.select(*rest, held_out(F.col(doc_id)).alias("held_out"), predicted(F.col(text)).alias("_p")).select(
        *rest, "held_out", F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score")
    )
