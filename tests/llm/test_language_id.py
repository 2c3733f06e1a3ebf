import random

import numpy as np
from pyspark.sql import functions as F

from tests.llm.util import docs
from wardstat.llm.language_id import (PROFILE_GRAMS, UNKNOWN, Profiles, gram_counts, identify,
                                      learn_profiles, top_grams)


def brute_top(text):
    from collections import Counter
    kept = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
    while "  " in kept:
        kept = kept.replace("  ", " ")
    n = Counter(c for c in kept if c != " ")
    n.update(kept[k:k + 2] for k in range(len(kept) - 1))
    n.update(kept[k:k + 3] for k in range(len(kept) - 2) if kept[k + 1] != " ")
    return [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))][:PROFILE_GRAMS]


def decode(code):
    out = ""
    while code:
        out = chr(code & 0x1FFFFF) + out
        code >>= 21
    return out


def test_grams_equal_brute_force():
    for text in ("Hello, world!", "a", "É 123 été", "x  y\n z" * 50, "日本語 text"):
        assert [decode(int(c)) for c in top_grams(text)] == brute_top(text)
    assert len(gram_counts("123 !?")[0]) == 0


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    p = learn_profiles(d.where(~held))
    got = identify(d.where(held), p).join(d.select("doc_id", "lang"), "doc_id")
    right = got.where("lang = lang_pred").count()
    assert right >= 0.99 * got.count()
    assert got.where("score < 0 or score > 1").count() == 0


def test_texts_without_letters_and_empty_tables(spark):
    d = docs(spark, [(1, None), (2, ""), (3, "12 !!"), (4, "the cat", "en"), (4, "the cat", "en"),
                     (None, "le chat", "fr"), (5, "zzz", None), (6, "word " * 50_000, "en")],
             extra=True)
    p = learn_profiles(d)
    got = {(r["doc_id"], r["lang_pred"]) for r in identify(d, p).collect()}
    assert {(1, UNKNOWN), (2, UNKNOWN), (3, UNKNOWN), (4, "en"), (None, "fr"), (6, "en")} <= got
    assert identify(d, p).count() == 8
    none = learn_profiles(d.where("false"))
    assert none.langs == [] and none.predict("the") == (UNKNOWN, 0.0)
    assert identify(d.where("false"), p).count() == 0


def test_ties_go_to_the_first_language():
    assert Profiles({"b": [97], "a": [97]}).predict("a")[0] == "a"


def brute_predict(profiles, text):
    """Nearest profile (a dict of ranked grams) by the sum of the differences in rank."""
    top = brute_top(text)
    away = {lang: sum(abs(k - ranked.index(g)) if g in ranked else PROFILE_GRAMS
                      for k, g in enumerate(top)) for lang, ranked in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (len(top) * PROFILE_GRAMS)


def test_profiles_and_distances_equal_brute_force(spark):
    from collections import Counter
    rng = random.Random(8)
    texts = {"en": "the cat and the dog sat on a mat near this old house".split(),
             "fr": "le chat et la souris dans une maison près de l'été".split(),
             "xx": "zug über dem wasser 12 straße ganz oben".split()}
    rows = [(k, " ".join(rng.choices(texts[lang], k=rng.randrange(1, 30))), lang)
            for k, lang in enumerate(list(texts) * 15)]
    rows += [(100 + k, rows[0][1], rows[0][2]) for k in range(40)]      # copies count once
    d = docs(spark, rows)
    p = learn_profiles(d.repartition(3))
    learned = {}
    for lang in texts:
        n = Counter()
        for text in {t for _, t, x in rows if x == lang}:
            kept = "".join(c.lower()[0] if c.isalpha() else " " for c in f" {text} ")
            while "  " in kept:
                kept = kept.replace("  ", " ")
            n.update(c for c in kept if c != " ")
            n.update(kept[k:k + 2] for k in range(len(kept) - 1))
            n.update(kept[k:k + 3] for k in range(len(kept) - 2) if kept[k + 1] != " ")
        learned[lang] = [g for g, _ in sorted(n.items(), key=lambda x: (-x[1], len(x[0]), x[0]))
                         ][:PROFILE_GRAMS]
        k = p.langs.index(lang)
        own = np.flatnonzero(p.ranks[:, k] >= 0)
        ranked = own[np.argsort(p.ranks[own, k])]
        assert [decode(int(p.codes[x])) for x in ranked] == learned[lang]
    for _, text, _ in rows[:45]:
        lang, score = p.predict(text)
        assert (lang, round(score, 12)) == (lambda x: (x[0], round(x[1], 12)))(
            brute_predict(learned, text))
    assert p.predict("zzz qqq")[0] == brute_predict(learned, "zzz qqq")[0]


def test_stage_keeps_texts_with_letters_where_nothing_is_labelled(spark):
    import corpus_pipeline
    d = docs(spark, [(1, "ab"), (2, "12"), (3, None), (4, "é")], extra=True)
    kept = corpus_pipeline.language_id(spark, d, None)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {1, 4}
    labelled = docs(spark, [(1, "the cat", "en"), (2, "12", "en"), (3, "the hat", "en")], extra=True)
    kept = corpus_pipeline.language_id(spark, labelled.withColumn("found", F.lit(1)), None)
    assert kept.columns == [*d.columns, "found"] and {r["doc_id"] for r in kept.collect()} == {1, 3}
