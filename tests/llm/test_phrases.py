"""Phrase mining against counting by hand."""

import collections
import random
import re

import numpy as np
import pytest

from tabwright.llm import phrases

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def by_hand(rows, top, least, cover):
    f, n = collections.Counter(), collections.Counter()
    for r in rows:
        lang = "und" if r["lang"] is None else r["lang"]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update((lang, *w[i : i + k]) for i in range(len(w) - k + 1))
    own = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    gone = {(p[0], *part) for p, a in own.items() if len(p) == 4 for part in (p[1:3], p[2:4]) if 100 * a >= cover * f[(p[0], *part)]}
    scored = collections.defaultdict(list)
    for p, a in own.items():
        if p not in gone:
            lang, w = p[0], p[1:]
            cuts = [(1000000 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w))]
            score, k = min(cuts)
            scored[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    out = []
    for lang, found in scored.items():
        for i, (score, a, phrase, left, right) in enumerate(sorted(found)[:top]):
            out.append((lang, i + 1, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def awkward(spark):
    random.seed(4)
    words = ["The", "the", "über", "alpha", "BETA", "beta", "x", "日本", "new", "york", "times", "-", "a\x00b"]
    marks = [" ", "  ", "\t", ", ", ". ", "\n", "\x0b", " ", " "]
    rows = [(i, "".join(random.choice(words) + random.choice(marks) for _ in range(60)), random.choice(["en", "de", None]), "x", 7) for i in range(80)]
    rows += [(i, "new york times stays new york times", "en", "x", 7) for i in range(200, 212)]
    rows += [(i, "only here twelve, times", "fr", "x", 7) for i in range(300, 312)]
    rows += [(None, None, "en", "x", 7), (5, "", "", "x", 7), (5, " . , ", None, "x", 7), (6, "the the the " * 4000, "en", "x", 7), (6, "rare words", "rare", "x", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, phrase string, n int")


@pytest.mark.parametrize("sample,bits,top", [(4, None, 2000), (1000, 20, 5), (1, 18, 3)])
def test_phrases_equal_counting_by_hand(spark, sample, bits, top):
    docs = awkward(spark).repartition(5)
    got = phrases.collocations(docs, top=top, least=3, cover=50, sample=sample, bits=bits)
    assert got.columns == COLUMNS
    assert sorted(map(tuple, got.collect())) == by_hand(docs.collect(), top, 3, 50)


def test_a_sample_that_misses_everything_takes_more_passes(spark):
    docs = awkward(spark).selectExpr("text", "lang", "doc_id AS __id")
    whole, passes = phrases.frequent_phrases(docs, 3, 1, 18)
    missed, more = phrases.frequent_phrases(docs, 3, 10**9, 18)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert more > passes >= 1 and rows(whole) == rows(missed)
    assert missed.count() == missed.select("lang", "phrase").distinct().count()


def test_shared_bits_only_widen_the_border(spark):
    docs = awkward(spark)
    got = phrases.collocations(docs, least=3, bits=18, sample=4).collect()
    phrases_of = lambda rows: sorted(map(tuple, rows))
    tight = phrases.collocations(docs, least=3, bits=15, sample=4).collect()
    assert phrases_of(got) == phrases_of(tight)


def test_bits_are_bounded():
    assert phrases.bits_for(0) == 16 and phrases.bits_for(10**6) == 23 and phrases.bits_for(10**12) == 28


def test_scores_beyond_64_bits(spark):
    rows = [("en", 0, "", 10**12), ("en", 1, "a", 4 * 10**11), ("en", 1, "b", 3 * 10**11), ("en", 2, "a b", 2 * 10**11)]
    counts = spark.createDataFrame(rows, "lang string, k byte, phrase string, f long")
    (r,) = phrases.best_phrases(counts).collect()
    assert tuple(r) == ("en", 1, "a b", 2 * 10**11, 4 * 10**11, 3 * 10**11, 10**12, 10**6 * 4 * 10**22 // (12 * 10**22))


def test_no_phrases(spark, nothing):
    assert phrases.collocations(nothing).count() == 0
    assert phrases.collocations(awkward(spark).filter("lang = 'rare'")).count() == 0


def test_words_of_pieces():
    import pyarrow as pa

    words, text, piece = phrases.words_of(pa.array(["A b,c", None, "d", "e  F\tg!h", ""]))
    assert words.to_pylist() == list("abcdefgh")
    assert text.tolist() == [0, 0, 0, 2, 3, 3, 3, 3]
    assert (np.diff(piece) == 0).tolist() == [True, False, False, False, True, True, False]
