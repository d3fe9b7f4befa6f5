"""The pipeline's stages, each held against a plain version on its own input."""

from collections import Counter

import corpus_pipeline as P
import duckdb
import numpy as np

from strataleaf.llm import mixing, packing, secret_scan
from strataleaf.llm import quality_divergence as Q
from strataleaf.llm.common import written
from tests.conftest import SF
from tests.llm.test_minhash_dedup import brute, groups
from tests.llm.test_quality_divergence import histogram


def js(p, q):
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(all="ignore"):
        return np.sqrt(max(0, (np.nansum(np.where(p > 0, p * np.log2(p / m), 0)) + np.nansum(np.where(q > 0, q * np.log2(q / m), 0))) / 2))


def passing(rows):
    hist = [histogram(r.text or "", r.lang) for r in rows]
    total = {}
    for r, h in zip(rows, hist, strict=True):
        total[r.lang] = total.get(r.lang, 0) + h
    limit = lambda base, bins, n: base + Q.NOISE * np.sqrt((bins - 1) / (8 * np.log(2) * max(n, 1)))
    k, out = Q._KINDS, []
    for r, h in zip(rows, hist, strict=True):
        n, ref = h[k:].sum(), total[r.lang]
        far = js(h[:k], ref[:k]) > limit(Q.CLASS_LIMIT, k, h[:k].sum()) or js(h[k:], ref[k:]) > limit(Q.WORD_LIMIT, Q._WIDTH, n)
        if n and (n < Q.MIN_WORDS or not far):
            out.append(r.doc_id)
    return sorted(out)


def test_stages_against_plain_versions(spark):
    stages = dict(P.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "secrets", "mix", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    good = written(stages["quality_rules"](spark, docs, SF), "t")
    assert good.columns == columns and sorted(r.doc_id for r in good.collect()) == passing(docs.collect())
    unique = written(stages["near_dedup"](spark, good, SF), "t")
    gone = groups(brute([(r.doc_id, r.text) for r in good.collect()]))
    assert unique.columns == columns
    left = {r.doc_id for r in unique.collect()}
    assert left >= {r.doc_id for r in good.collect()} - set(gone) and len(left & set(gone)) <= 0.02 * len(gone)
    clean = written(stages["secrets"](spark, unique, SF), "t")
    assert clean.columns == columns
    assert {r.doc_id: r.text for r in clean.collect()} == {r.doc_id: secret_scan.redacted_text(r.text) for r in unique.collect()}
    chosen = written(stages["mix"](spark, clean, SF), "t")
    assert chosen.columns == columns
    documents = clean.toArrow()  # noqa: F841
    want = Counter(r[0] for r in duckdb.connect().execute(mixing.SQL).fetchall())
    assert Counter(r.doc_id for r in chosen.collect()) == want
    slots = stages["pack"](spark, chosen, SF).collect()
    size = Counter()
    for r in chosen.collect():
        size[r.doc_id] += len([w for w in r.text.replace("\t", " ").replace("\r", " ").replace("\n", " ").split(" ") if w])
    got = Counter()
    for r in slots:
        got[r.doc_id] += r.n_tokens
    assert got == +size and max(r.slot_offset + r.n_tokens for r in slots) <= packing.CONTEXT


def test_hard_rows_and_empty_tables(spark, hard, nothing, clashing):
    for docs in (hard, nothing, clashing):
        table = docs
        for name, stage in P.STAGES[:-1]:
            table = written(stage(spark, table, SF), name)
            assert table.columns == docs.columns
        slots = P.STAGES[-1][1](spark, table, SF)
        assert (slots.count() > 0) == (docs is not nothing)
