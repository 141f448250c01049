"""Language ID and the n-gram quality model."""

import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from panelspark.llm import langid, quality_lm, queries
from panelspark.llm.common import table


def test_histogram_counts_every_subword():
    def mix(x):
        x = x * 0x9E3779B1 & 0xFFFFFFFF
        return x ^ (x >> 15)

    def plain(text):
        out = np.zeros(langid.BUCKETS)
        word = []
        for c in text + " ":
            if c.isalpha():
                word.append(ord(c.lower()))
            elif word:
                marked = [0, *word, 0]
                for n in (2, 3, 4):
                    for i in range(len(marked) - n + 1):
                        h = mix(marked[i])
                        for s in marked[i + 1 : i + n]:
                            h = mix(h ^ s)
                        out[h & (langid.BUCKETS - 1)] += 1
                word = []
        return out

    texts = ["That it.", "", "123 --", "Ä ß, été!\n a b  c", "日本 語", "ab cd " * 100_000]
    for text, got in zip(texts, langid.histograms(texts), strict=True):
        assert (plain(text) == got).all()


def test_held_out_accuracy(spark, sf):
    out = queries.op1_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    right, n = out.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 20 and right > 0.97
    assert out.where("score < 0 or score > 1 or score is null").count() == 0


def test_language_edge_cases(odd, empty):
    model = langid.fit(odd)
    rows = {(r.doc_id, r.lang_pred, r.accepted) for r in langid.predict(odd, model).collect()}
    assert {(1, "und", False), (2, "und", False), (5, "und", False)} <= rows
    assert langid.fit(empty) is None and langid.keep_accepted(empty, None).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, None).collect()} == {"und"}
    assert langid.keep_accepted(odd, model).schema == odd.schema


def test_probabilities_sum_to_one(odd):
    model = quality_lm.fit(odd.select("text"), 3)
    sums = np.exp(model.logs.astype(float)).reshape(-1, quality_lm.SYMBOLS).sum(1)
    assert np.allclose(sums, 1, atol=1e-4)


def test_kneser_ney_against_plain_counts(spark):
    text = "abracadabra abracadabra banana bandana. " * 3
    model = quality_lm.fit(spark.createDataFrame([(text,)], "text string"), 2)
    symbols = [quality_lm.BEGIN] + [int(quality_lm._classes()[ord(c)]) for c in text]
    pairs = Counter(zip(symbols, symbols[1:], strict=False))

    def discounts(counts):
        n = Counter(counts.values())
        if not (n[1] and n[2] and n[3]):
            return 0.5, 0.5, 0.5
        y = n[1] / (n[1] + 2 * n[2])
        found = (1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3])
        return tuple(min(max(d, 0.05), k + 0.9) for k, d in enumerate(found))

    before = Counter(b for _, b in pairs)
    d1, d2 = discounts(before), discounts(pairs)
    left = sum(d1[min(c, 3) - 1] for c in before.values()) / sum(before.values())

    def unigram(w):
        c = before[w]
        return (max(0, c - d1[min(c, 3) - 1]) if c else 0) / sum(before.values()) + left / 32

    def bigram(a, w):
        seen = {b: c for (x, b), c in pairs.items() if x == a}
        if not seen:
            return unigram(w)
        rest = sum(d2[min(c, 3) - 1] for c in seen.values()) / sum(seen.values())
        c = seen.get(w, 0)
        return (c - d2[min(c, 3) - 1] if c else 0) / sum(seen.values()) + rest * unigram(w)

    for a in (0, 1, 13, 28, 5):
        for w in range(32):
            assert math.isclose(math.exp(model.logs[a * 32 + w]), bigram(a, w), rel_tol=1e-4), (a, w)


def test_quality_keeps_trusted(spark, sf, odd, empty):
    out = queries.op3_quality_lm(spark, sf)
    labels = table(spark, sf, "labels")
    good = out.join(quality_lm.trusted_ids(labels), "doc_id").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    bad = out.join(labels.where("quality = 0"), "doc_id").agg(F.avg(F.col("kept").cast("double"))).first()[0]
    assert good > 0.95 and bad < 0.5
    assert out.count() == table(spark, sf, "documents").count()
    rows = {r.doc_id: r for r in quality_lm.classify(odd, labels).collect()}
    assert rows[1].kept is False and rows[2].perplexity is None and rows[3].n_chars > 0
    assert quality_lm.classify(empty, labels).count() == 0
    assert {r.kept for r in quality_lm.classify(odd, labels.where("1 = 0")).collect()} == {False}


def test_every_labelled_language_is_learned(spark):
    """Many rows under one id, copies of one row, and more languages than rows of some: none vanishes from the sample."""
    english = [(3, f"this is the text number {i} of the many that the old man and the others read here", "en") for i in range(3000)]
    french = [(10 + i, f"voici le texte numéro {i} que les autres lisent dans la maison avec le chat", "fr") for i in range(40)]
    german = [(9000, "dies ist ein einziger Satz, der sehr oft in der Tabelle steht und nicht verloren geht", "de")] * 2000
    rare = [(20_000 + 4 * i, f"{chr(0x4E00 + 300 * i)}{chr(0x4E10 + 300 * i)}{chr(0x4E20 + 300 * i)} " * 5, f"x{i:03d}") for i in range(40)]
    docs = spark.createDataFrame(english + french + german + rare, "doc_id long, text string, lang string").repartition(4)
    learnable = {r.lang for r in docs.where(~langid.held_out(F.col("doc_id"))).select("lang").distinct().collect()}
    assert {"en", "fr", "de"} <= learnable and len(learnable) > 25
    model = langid.fit(docs)
    assert set(model.langs) == learnable
    wanted = spark.createDataFrame([(1, english[1][1]), (2, french[1][1])], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in langid.predict(wanted, model).collect()} == {1: "en", 2: "fr"}


def plain_perplexity(trusted, text, order):
    """Perplexity under interpolated modified Kneser-Ney over single characters, from plain counts."""
    tables = {order: Counter()}
    for t in trusted:
        line = ("^",) * (order - 1) + tuple(t)
        tables[order].update(line[i : i + order] for i in range(len(t)))
    for n in range(order - 1, 0, -1):
        tables[n] = Counter(g[1:] for g in tables[n + 1])
    cuts, contexts = {}, {}
    for n, table in tables.items():
        times = Counter(table.values())
        cuts[n] = (0.5, 0.5, 0.5)
        if times[1] and times[2] and times[3]:
            y = times[1] / (times[1] + 2 * times[2])
            found = (1 - 2 * y * times[2] / times[1], 2 - 3 * y * times[3] / times[2], 3 - 4 * y * times[4] / times[3])
            cuts[n] = tuple(min(max(d, 0.05), k + 0.9) for k, d in enumerate(found))
        contexts[n] = {}
        for g, c in table.items():
            total, lost = contexts[n].get(g[:-1], (0, 0))
            contexts[n][g[:-1]] = (total + c, lost + cuts[n][min(c, 3) - 1])

    def p(g):
        if not g:
            return 1 / 0x110000
        if g[:-1] not in contexts[len(g)]:
            return p(g[1:])
        total, lost = contexts[len(g)][g[:-1]]
        c = tables[len(g)][g]
        return (c - cuts[len(g)][min(c, 3) - 1] if c else 0) / total + lost / total * p(g[1:])

    line = ("^",) * (order - 1) + tuple(text)
    return math.exp(-sum(math.log(p(line[i : i + order])) for i in range(len(text))) / len(text))


def test_characters_are_told_apart(spark, monkeypatch):
    """Perplexities of whole texts of any script against plain counts; letters in another order score worse in every script."""
    monkeypatch.setattr(quality_lm, "PART", 300)
    monkeypatch.setattr(quality_lm, "CHUNK", 700)
    sound = ["тихая река течет мимо старого дома и сада " * 9, "the old man reads his paper near the river " * 9, "静かな川が古い家のそばを流れている。" * 9, "😀 a\0b\U0010ffff " * 9]
    rows = [(i, t, "x") for i, t in enumerate(sound)]
    rows += [(10 + i, "".join(sorted(t)), "x") for i, t in enumerate(sound)]
    rows += [(20, None, "x"), (21, "", None), (22, "Ωmega", None), (23, "ж" * 2000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(len(sound))], "doc_id long, quality int, toxic int")
    found = {r.doc_id: r for r in quality_lm.classify(docs, labels).collect()}
    assert len(found) == len(rows)
    for i, text, _ in rows:
        assert found[i].n_chars == len(text or "")
        if text:
            assert math.isclose(found[i].perplexity, plain_perplexity(sound, text, quality_lm.ORDER), rel_tol=1e-5), i
        else:
            assert found[i].perplexity is None and not found[i].kept
    for i in range(3):
        assert found[i].kept and found[10 + i].perplexity > 2 * found[i].perplexity and not found[10 + i].kept
