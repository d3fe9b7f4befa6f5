import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from strataleaf.llm import quality_divergence as Q


def histogram(text, lang, common=Q.COMMON):
    """One text's counts, plainly."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    found = Counter(re.findall(r"[a-z\u0080-\U0010ffff]+", low))
    kinds = Counter(0 if "a" <= c <= "z" else 1 if "A" <= c <= "Z" else 2 if "0" <= c <= "9" else 3 if c in " \t\r\n" else 4 if c in Q.MARKS else 5 if c < "\x80" else 6 for c in text)
    words = [found[w] for w in common.get(lang, [])]
    words += [0] * (Q._WIDTH - 1 - len(words))
    return np.array([kinds[k] for k in range(Q._KINDS)] + [*words, found.total() - sum(words)])


def test_histogram_counts():
    texts = ["The the, of\n4 \u00c9!*", "", "the", "of", "m\u00e1s o", "x" * 30 + " nicht", "le", "der", "\U0001f600", "the-the", "THE"]
    langs = ["en", "en", "en", "en", "es", "de", "fr", None, "de", "en", "en"]
    data = [t.encode() for t in texts]
    got = Q.histograms(b"".join(data), np.append(0, np.cumsum([len(d) for d in data])), langs, Q.Lexicon(Q.COMMON))
    for g, t, k in zip(got, texts, langs, strict=True):
        assert g.tolist() == histogram(t, k).tolist(), t
    with pytest.raises(ValueError):
        Q.Lexicon({"en": ["ninebytes"]})


def test_reference_of_good_texts(spark):
    good = "the river was wide and the boat that it held was of old wood and for the most part dry when he stood on it "
    junk = "#$ 123 ;; @@ 99 == && 17 ~~ | zz 42 " * 12
    # most of the language is junk, so by its own reference junk passes; by that of good texts it doesn't
    docs = spark.createDataFrame([(i, junk, "en") for i in range(9)] + [(9, good, "en"), (10, good, "xx")], "doc_id long, text string, lang string")
    reference = Q.references(docs.where("doc_id = 9"))
    assert {r.doc_id for r in Q.kept(docs).collect()} >= set(range(9))
    assert {r.doc_id for r in Q.kept(docs, reference).collect()} == {9, 10}
    assert {r.doc_id for r in Q.decisions(docs, reference).collect()} == {9, 10}


def test_edge_cases(hard, nothing, clashing):
    kept = Q.kept(hard)
    assert kept.columns == hard.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 4 not in ids and 5 not in ids and 6 not in ids  # no word
    assert ids.count(2) == 2 and None in ids and 9 in ids
    assert Q.kept(nothing).count() == 0 and Q.decisions(nothing).count() == 0
    assert sorted(map(str, (r.doc_id for r in Q.kept(clashing).collect()))) == sorted(map(str, ids))
    assert Q.decisions(clashing).columns == ["doc_id", "lang", "n_words", "class_js", "word_js"]


def test_oracle_on_hard_rows(hard):
    c = duckdb.connect()
    documents = hard.toArrow()  # noqa: F841
    c.execute("create table d as select * from documents")
    c.execute("create or replace view documents as select * from d")
    want = sorted(str((*r[:3], f"{r[3]:.4f}", f"{r[4]:.4f}")) for r in c.sql(Q.SQL).fetchall())
    got = sorted(str((r.doc_id, r.lang, r.n_words, f"{r.class_js:.4f}", f"{r.word_js:.4f}")) for r in Q.decisions(hard).collect())
    assert want == got


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_labels(spark, sf):
    """Documents labelled good stay; most that are labelled bad go."""
    kept = {r.doc_id for r in Q.decisions(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [r.doc_id in kept for r in labels if r.quality == 1]
    bad = [r.doc_id not in kept for r in labels if r.quality == 0]
    assert sum(good) / len(good) > 0.99
    assert sum(bad) / len(bad) > 0.6
