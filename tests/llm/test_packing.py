from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from strataleaf.llm import packing as P


def brute(counts, context):
    """Best-fit decreasing, piece by piece: the gaps that are left."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [(g, i) for i, g in enumerate(gaps) if g >= length]
            if fits:
                gaps[min(fits)[1]] -= length
            else:
                gaps.append(context - length)
    return sorted(gaps)


def lay_out(slots):
    bins = {}
    for length, lo, hi, first, per, offset in slots:
        for rank in range(lo, hi):
            at = offset + (rank - lo) % per * length
            bins.setdefault(first + (rank - lo) // per, []).append((at, at + length))
    return bins


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 12), max_size=10), st.integers(40, 64))
def test_plan_equals_piecewise_best_fit(counts, context):
    slots = P.plan(counts, context)
    for length, n in counts.items():
        assert sorted(r for s in slots if s[0] == length for r in range(s[1], s[2])) == list(range(n))
    bins = lay_out(slots)
    assert sorted(bins) == list(range(len(bins)))
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(context - max(e for _, e in s) for s in bins.values()) == brute(counts, context)


def test_plan_depends_on_context_alone():
    counts = {i: 10**9 + i for i in range(1, P.CONTEXT + 1)}
    assert len(P.plan(counts)) < 5 * P.CONTEXT


def check(docs, packed, context):
    words = Counter()
    for r in docs.select("doc_id", "text").collect():
        words[r.doc_id] += len((r.text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - Counter((r.text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "))[""]
    got, bins = Counter(), {}
    for r in packed.collect():
        got[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append((r.slot_offset, r.slot_offset + r.n_tokens))
    assert +got == +words
    for spans in bins.values():
        spans.sort()
        assert spans[0][0] == 0 and spans[-1][1] <= context
        assert all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert sorted(bins) == list(range(len(bins)))
    return bins


def test_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = P.packed(docs)
    bins = check(docs, packed, P.CONTEXT)
    counts = Counter(r.n_tokens for r in packed.collect())
    assert len(bins) == len(brute(counts, P.CONTEXT))


def test_edge_cases(hard, nothing, clashing):
    check(hard, P.packed(hard, 100), 100)
    assert P.packed(nothing).count() == 0
    assert P.packed(clashing, 100).columns == ["bin_id", "slot_offset", "doc_id", "piece", "start_token", "n_tokens"]
    assert P.packed(clashing, 100).count() == P.packed(hard, 100).count()


def test_ids_that_are_strings(spark):
    docs = spark.createDataFrame([(k, "w " * n) for k, n in (("a", 150), ("b", 30), (None, 20), ("b", 30))], "doc_id string, text string")
    check(docs, P.packed(docs, 100), 100)
