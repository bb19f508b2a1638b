"""Quality rules, mixing, token counts, language identification, licences and personal data against plain Python."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fairline.llm.language import labelled_sample, language_id
from fairline.llm.licenses import TEMPLATES, Index, license_scan, phrase_places, words_of
from fairline.llm.mixing import mix
from fairline.llm.personal import KINDS, personal_data, redacted, written_spans
from fairline.llm.quality import quality_rules
from fairline.llm.token_counts import Counter as TokenCounter, merged_count, read_vocabulary, token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def statistics(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    repeated = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(repeated))


def test_quality_statistics(some, odd):
    for docs in (some, odd):
        rows = quality_rules(docs).collect()
        texts = Counter(statistics(r["text"]) for r in docs.collect())
        assert Counter((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows) == texts
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 50 or 2 * r["n_repeat_words"] > r["n_words"])
            assert not (r["base_failed"] and r["kept"])


def test_quality_random_repeats(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 30))) + "\n" * rng.randint(0, 2) + "a b" for _ in range(300)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality_rules(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == statistics(r["text"])


def test_quality_rejects_outliers_and_keeps_the_rest(spark):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4000)]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(60, 400))), "en", f"s{i % 3}") for i in range(900)]
    junk = [(10_000 + i, " ".join(rng.choice(vocabulary) + "$$$&&&" for _ in range(200)), "en", f"s{i % 3}") for i in range(30)]
    docs = spark.createDataFrame(rows + junk, "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality_rules(docs).collect()}
    assert all(kept[r[0]] for r in rows) and not any(kept[r[0]] for r in junk)


def test_quality_of_labelled_tables(spark):
    """Tables and symbol junk (labelled 0) that pass the base rules go, documents labelled 1 stay."""
    sf = "/root/testdata/sf0.01"
    judged = quality_rules(spark.read.parquet(f"{sf}/documents.parquet"), carry=["doc_id"]).where("not base_failed")
    rows = judged.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").select("quality", "n_symbols", "word_chars", "kept").collect()
    bad = [r["n_symbols"] / r["word_chars"] for r in rows if r["quality"] == 0]
    assert min(bad) < 0.13 and max(bad) > 0.3 and not any(r["kept"] for r in rows if r["quality"] == 0)
    good = [r["kept"] for r in rows if r["quality"] == 1]
    assert len(good) > 300 and all(good)


def test_quality_is_repeatable_and_takes_an_empty_table(some, empty):
    first = sorted((r["doc_id"], r["kept"], r["distance"] or 0) for r in quality_rules(some).collect())
    second = sorted((r["doc_id"], r["kept"], r["distance"] or 0) for r in quality_rules(some.repartition(7)).collect())
    assert [x[:2] for x in first] == [x[:2] for x in second]
    assert max(abs(a[2] - b[2]) for a, b in zip(first, second)) < 1e-9
    assert quality_rules(empty).count() == 0


def targets_by_resharing(sizes):
    """Shares by weight; what is above three times a source's size goes to the others, again and again."""
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    capped, left = {}, sum(sizes.values())
    while True:
        rest = [s for s in order if s not in capped]
        total = sum(weight[s] for s in rest)
        share = {s: left * weight[s] / total for s in rest} if rest else {}
        over = [s for s in rest if share[s] > 3 * sizes[s] + 1e-9]
        if not over:
            return {**capped, **share}
        for s in over:
            capped[s] = 3 * sizes[s]
            left -= 3 * sizes[s]


@pytest.mark.parametrize("skewed", [False, True])
def test_mixing(spark, some, skewed):
    docs = some.withColumn("source", F.when(F.col("doc_id") % 50 == 0, "tiny").when(F.col("doc_id") % 3 == 0, None).otherwise("big")) if skewed else some
    rows = mix(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    want, taken, largest = targets_by_resharing(sizes), Counter(), defaultdict(int)
    assert len(rows) == docs.count()
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["taken"] % max(1, r["size"]) == 0 and 0 <= r["taken"] <= 3 * r["size"]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-9)
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s, target in want.items():
        assert abs(taken[s] - target) <= largest[s] / 2
    again = mix(docs.repartition(5)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again)


def test_mixing_odd_rows(odd, empty):
    rows = mix(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["taken"] == 0 for r in rows if r["size"] == 0)
    assert all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mix(empty).count() == 0


@pytest.fixture(scope="module")
def vocabulary_path():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


def test_token_counts_equal_the_library(spark, some, odd, empty, vocabulary_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
    for docs in (some, odd):
        got = Counter((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in token_counts(docs, vocabulary_path).collect())
        texts = [r["text"] or "" for r in docs.collect()]
        counts = [len(x) for x in library.encode(texts, num_threads=1)]
        assert got == Counter((len(t.encode()), n, n > 4096) for t, n in zip(texts, counts))
    assert token_counts(empty, vocabulary_path).count() == 0


def test_token_counts_on_random_strings(vocabulary_path):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path)
    counter, rng = TokenCounter(read_vocabulary(vocabulary_path)), random.Random(11)
    texts = ["".join(rng.choice(["a", "b", " ", "  ", "\n", "\t", "é", "▁", "<s>", "😀", "the", "ing", "\u0000"]) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    assert [counter.count(t) for t in texts] == [len(x) for x in library.encode(texts, num_threads=1)]


def test_merging_takes_the_lowest_rank_first():
    assert merged_count("abcd", {"bc": 0, "ab": 1, "a": 9, "b": 9, "c": 9, "d": 9}) == 3  # a bc d
    assert merged_count("aaa", {"aa": 0, "a": 9}) == 2  # the leftmost pair wins
    assert merged_count("é", {}) == 2


def test_language_held_out(some, odd, empty):
    rows = language_id(some).collect()
    held = [r for r in rows if r["held_out"]]
    assert held and sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    for r in language_id(odd).collect():
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] in ("en", "de", "fr")
    assert language_id(empty).count() == 0


def test_language_sample_takes_distinct_texts(spark):
    """Copies don't fill the sample, and a language of few texts in many rows is learned."""
    texts = [("en", f"english words number {chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(200)]
    rows = texts + [("en", texts[i][1]) for i in range(20) for _ in range(50)] + [("de", "zwei kurze Worte")] * 400
    docs = spark.createDataFrame([(None, lang, t) for lang, t in rows], "doc_id long, lang string, text string")
    sample, languages = labelled_sample(docs, "text", "lang", "doc_id", 40)
    n = Counter(r["lang"] for r in sample.select("lang").collect())
    assert languages == ["de", "en"] and n["de"] == 1 and 15 <= n["en"] <= 70
    few, _ = labelled_sample(docs, "text", "lang", "doc_id", 1)
    assert {r["lang"] for r in few.collect()} == {"de", "en"}


def test_language_without_labels(some):
    assert {r["lang_pred"] for r in language_id(some.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_licences(spark, some, odd, empty):
    for docs in (some, odd):
        for r in license_scan(docs, carry=["text"]).collect():
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
            places = sorted(
                (i, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
                for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()
            )
            assert (r["n_words"], r["n_base"]) == (len(words), len(places))
            assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
            assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
            assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
    assert license_scan(empty).count() == 0


def test_licence_templates(spark):
    texts = [
        "Some code.\nLicensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the Software), to deal in the Software without restriction", "permission slips are free of charge",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in license_scan(docs).collect()}
    assert labels == {0: "apache-2.0", 1: "mit", 2: ""}
    assert phrase_places(words_of("CC BY cc by")) == [(0, "cc-by"), (2, "cc-by")]


def test_several_licences_of_a_file(spark):
    """Notices whose words are common are found beside the rare words of others."""
    apache, permission = (notice for label, k in (("apache-2.0", 1), ("mit", 2)) for notice, _ in [TEMPLATES[label][k]])
    bsd, isc = TEMPLATES["bsd"][0][0], TEMPLATES["isc"][0][0]
    prose = "the redistribution of a binary for a fee or charge by obtaining source forms with modification and restriction met "
    files = {
        0: (f"{bsd}. Released under the MIT License", "bsd,mit"),
        1: (f"{bsd}. {isc}. Licensed under CC BY-NC 4.0. This work is licensed under the GNU General Public License version 3. {apache}",
            "apache-2.0,bsd,cc-by,cc-by-nc,gpl,gpl-3.0,isc"),
        2: (prose * 20 + "Released under the MIT License", "mit"),
    }
    differing = apache.split()
    for k in (9, 11, 12, 13, 15):  # rare ones, within the fifth that may differ
        differing[k] = "other"
    files[4] = (" ".join(differing) + " " + apache.split(" ", 9)[9], "apache-2.0")
    common = [(100 + i, f"Released under the MIT License. {permission}. {apache}") for i in range(30)]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in files.items()), *common], "doc_id long, text string")
    labels = {r["doc_id"]: r["labels"] for r in license_scan(docs).collect()}
    for i in (0, 1, 2, 4):
        assert labels[i] == files[i][1]


def test_licence_index_misses_no_place():
    """Against every place of every template."""
    rng = random.Random(17)
    notices = [(label, words_of(n), k) for label, ns in TEMPLATES.items() for n, k in ns]
    pool = sorted({w for _, n, _ in notices for w in n})
    weight = {w: rng.random() for w in pool}
    index = Index(TEMPLATES, weight)
    for _ in range(300):
        words = []
        for _ in range(rng.randint(1, 4)):
            part = list(rng.choice(notices)[1])
            for _ in range(rng.randint(0, len(part) // 4)):
                part[rng.randrange(len(part))] = rng.choice(pool)
            words += part[rng.randint(0, 3) :] + rng.choices(pool, k=rng.randint(0, 30))
        want = {}
        for label, notice, key in notices:
            for start in range(-len(notice) + 1, len(words)):
                there = [""] * -start + words[max(0, start) : max(0, start + len(notice))]
                share = sum(a == b for a, b in zip(notice, there)) / len(notice)
                around = " " + " ".join(words[max(0, start - 3) : max(0, start) + len(notice) + 3]) + " "
                if share >= 0.8 and f" {' '.join(words_of(key))} " in around:
                    want[label] = max(share, want.get(label, 0.0))
        assert index.matches(words) == want


FORMS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(text):
    def luhn(d):
        return sum((x if i % 2 == 0 else 2 * x - 9 * (x > 4)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0

    def valid(kind, found):
        d = re.sub("[^0-9]", "", found)
        return {
            "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in found.split(".")),
            "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15,
        }[kind]()

    return ",".join(f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(FORMS[k], text or "") if valid(k, m[0]))


def test_personal_data_forms(spark, some, odd, empty):
    rng = random.Random(13)
    parts = ["a@b.cc", "_x@d.e", "@", ".", "1.2.3.4", "999.1.1.1", "+1 (555) 123-4567", "4111 1111 1111 1111", "4111-1111-1111-1112", " ", "é", "😀", "12", "+", "-", "x", "\n"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(800)] + ["9" * 30_000, "a" * 30_000, "a.b@" * 5000, "1." * 9000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for table in (docs, some, odd):
        for r in personal_data(table, carry=["text"]).withColumn("base", written_spans(F.col("base"))).withColumn("spans", written_spans(F.col("spans"))).collect():
            assert r["base"] == base_spans(r["text"])
            assert set(filter(None, r["base"].split(","))) <= set(r["spans"].split(","))
    assert personal_data(empty).count() == 0


def test_personal_data_learns_contexts(spark):
    rows = [(i, f"hello there Tel: +1 555 123 45{i:02d} thanks") for i in range(20)] + [(100, "hello Tel: 555 987 6543, thanks"), (101, "there were 555 987 6543 thanks")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in personal_data(docs).withColumn("s", written_spans(F.col("spans"))).collect()}
    assert found[100] == "phone:11:23" and found[101] == ""
    shown = personal_data(docs).select("doc_id", redacted(F.col("text"), F.col("spans")).alias("t")).where("doc_id = 100").first()["t"]
    assert shown == "hello Tel: <phone>, thanks"



def test_personal_data_of_copies(spark):
    """A pattern's worth changes neither by copies, with or without an identifier, nor by one that many documents share."""
    rows = [(i, f"hello there Tel: +1 555 123 45{i:02d} thanks") for i in range(20)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)] + [(2000 + i, "call the Tel: of the office") for i in range(300)]
    rows += [(3000 + i, f"page {'abcdefghij'[i % 10]} {'klmnopqrst'[i // 10]} support: help@firm.example end") for i in range(60)]
    rows += [(4000 + i, f"support: user{i}@firm.example") for i in range(3)]
    new = [(100, "hello Tel: 555 987 6543, thanks"), (101, "there were 555 987 6543 thanks"), (102, "ask support: ann@intranet now")]
    docs = spark.createDataFrame(rows + new, "doc_id long, text string")
    found = {r["doc_id"]: r["s"] for r in personal_data(docs).withColumn("s", written_spans(F.col("spans"))).collect()}
    assert (found[100], found[101], found[102]) == ("phone:11:23", "", "email:13:25")
