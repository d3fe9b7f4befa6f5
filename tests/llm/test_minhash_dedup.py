from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex

from strataleaf.llm import minhash_dedup as M


def brute(rows, threshold=M.THRESHOLD):
    """Groups by exact weighted Jaccard over all pairs, and the pairs."""
    words = {k: regex.findall(r"[\p{L}\p{N}]+", (t or "").lower()) for k, t in rows if k is not None}
    sets = {k: Counter(tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))) for k, w in words.items() if w}
    places = defaultdict(list)
    for k, c in sets.items():
        for s, n in c.items():
            places[s].append((k, n))
    overlap = Counter()
    for found in places.values():
        for (a, x), (b, y) in combinations(found, 2):
            overlap[a, b] += min(x, y)
    size = {k: c.total() for k, c in sets.items()}
    return [p for p, o in overlap.items() if o >= threshold * (size[p[0]] + size[p[1]] - o)]


def groups(pairs):
    root = {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {x: find(x) for p in pairs for x in p if find(x) != x}


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    off = []
    for _ in range(30):
        keys = rng.integers(0, 2**48, 50).astype(np.uint64)
        a, b = rng.integers(0, 12, 50), rng.integers(0, 12, 50)
        doc = np.concatenate([np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)])
        s = M.signatures(doc, np.concatenate([keys[a > 0], keys[b > 0]]), np.concatenate([a[a > 0], b[b > 0]]), 2, 1024)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.03


def test_signature_does_not_depend_on_company():
    rng = np.random.default_rng(1)
    flat, offsets = rng.integers(0, 40, 300).astype(np.uint64), np.array([0, 1, 2, 5, 100, 100, 300])
    whole = M.signatures(*M.multisets(flat, offsets), 6)
    for i in range(6):
        part = flat[offsets[i] : offsets[i + 1]]
        assert (M.signatures(*M.multisets(part, np.array([0, len(part)])), 1)[0] == whole[i]).all()
    assert np.isinf(whole[4]).all()


def test_multisets_count():
    doc, _, count = M.multisets(np.array([5, 5, 5, 5, 9], np.uint64), np.array([0, 4, 5]))
    assert doc.tolist() == [0, 1] and count.tolist() == [2, 1]


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pairs = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    got = {r.doc_id: r.duplicate_of for r in M.near_duplicates(docs).collect()}
    place = lambda x: got.get(x, x)
    assert np.mean([place(a) == place(b) for a, b in pairs]) >= 0.98
    want = groups(pairs)
    assert set(got) <= set(want)  # nothing clean is removed
    assert M.deduplicated(docs).count() == docs.count() - len(got)


def test_large_group_and_chain(spark):
    rng = np.random.default_rng(2)
    base = [f"w{x}" for x in rng.integers(0, 10**6, 120)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.integers(0, 120, 5):
            w[j] = f"e{rng.integers(0, 10**6)}"
        rows.append((1000 + i, " ".join(w)))
    # a chain: each link resembles the next, its ends have nothing in common
    words = [f"c{x}" for x in range(400)]
    rows += [(5000 + k, " ".join(words[k * 20 : k * 20 + 100])) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.duplicate_of for r in M.near_duplicates(docs).collect()}
    assert sum(got.get(1000 + i) == 1000 for i in range(1, 300)) >= 297
    assert all(got.get(5000 + k) == 5000 for k in range(1, 12))


def test_edge_cases(hard, nothing, clashing):
    kept = M.deduplicated(hard)
    assert kept.columns == hard.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    # of the two rows with a null id, the one with a text resembles that of 1
    assert ids == sorted([1, 4, 5, 6, None, 7, 9, 10, 11], key=str)
    pairs = {(r.doc_id, r.duplicate_of) for r in M.near_duplicates(hard).collect()}
    assert pairs == {(2, 1), (3, 1), (8, 7)}
    assert M.near_duplicates(nothing).count() == 0 and M.deduplicated(nothing).count() == 0
    assert sorted((r.doc_id for r in M.deduplicated(clashing).collect()), key=str) == ids


def test_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "a b c d e"), (1, "v w x y z"), (1, None), (2, "v w x y z"), (2, "v w x y z"), (3, "k l m n o"), (3, "k l m n o")], "doc_id long, text string")
    assert [(r.doc_id, r.duplicate_of) for r in M.near_duplicates(docs).collect()] == [(2, 1)]
    # rows of one id with other texts are documents of their own; of equal rows one stays
    assert sorted((r.doc_id, str(r.text)) for r in M.deduplicated(docs).collect()) == [(1, "None"), (1, "a b c d e"), (1, "v w x y z"), (3, "k l m n o")]


def test_ids_that_are_strings_and_texts_without_words(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "\U0001f600 \U0001f601"), ("d", "\U0001f600 \U0001f601"), ("e", "?!"), ("f", "?!"), ("g", "!?"), (None, "?!"), ("h", " \n"), ("i", " \n"), ("i", " \n")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    assert sorted(map(tuple, M.near_duplicates(docs).collect())) == [("b", "a"), ("d", "c"), ("f", "e")]
    assert sorted(r.doc_id for r in M.deduplicated(docs).collect()) == ["a", "c", "e", "g", "h", "i", "i"]


def test_word_hashes_against_words():
    texts = ["the cat", "", "cat", "cat the", " . ", "x.y", "\u00e9t\u00e9 cat", "  ", "tail", "of", "?"]
    data = [t.encode() for t in texts]
    hashes, at = M.word_hashes(b"".join(data), np.append(0, np.cumsum([len(d) for d in data])))
    got = [hashes[at[i] : at[i + 1]].tolist() for i in range(len(texts))]
    words = [regex.findall(r"[\p{L}\p{N}]+", t) or ([t] if t.strip() else []) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in words]
    name = {}
    for g, w in zip(got, words, strict=True):
        for h, x in zip(g, w, strict=True):
            assert name.setdefault(x, h) == h
    assert len(set(name.values())) == len(name)


def test_every_occurrence_is_an_element():
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["w " * 200_002 + "x y"])], ["id", "text"])
    elements = next(M._elements(iter([batch]))).column("elements")[0].as_py()
    assert len(elements) == len(set(elements)) == 200_002


def test_one_shingle_repeated_very_often(spark):
    long = "word " * 200_000
    docs = spark.createDataFrame([(1, long + "here it ends"), (2, long + "another last line"), (3, "word " * 70_000 + "short")], "doc_id long, text string")
    assert [tuple(r) for r in M.near_duplicates(docs).collect()] == [(2, 1)]
