import duckdb

from strataleaf.llm import mixing as M


def water_fill(budget, children):
    """Shares by weight; what a child can't take goes round again among the others. children: name: (weight, capacity)."""
    got, open_ = dict.fromkeys(children, 0.0), set(children)
    while open_ and budget > 1e-9:
        total = sum(children[c][0] for c in open_)
        full = {c for c in open_ if children[c][1] - got[c] <= budget * children[c][0] / total + 1e-9}
        if not full:
            for c in open_:
                got[c] += budget * children[c][0] / total
            return got
        for c in full:
            budget -= children[c][1] - got[c]
            got[c] = children[c][1]
        open_ -= full
    return got


def test_budgets_by_water_filling(spark):
    leaves = [("web", "en", "src0", 1000), ("web", "en", "a", 10), ("web", "fr", "b", 5), ("forum", "en", "c", 3), ("reference", "de", "d", 400), ("reference", "es", "e", 1), ("reference", "de", "f", 77)]
    frame = spark.createDataFrame(leaves, "_sl_domain string, _sl_lang string, _sl_source string, tokens long")
    for share in (0.1, 0.8, 2.0, 10.0):
        got = {(r._sl_domain, r._sl_lang, r._sl_source): r._sl_budget for r in M.leaf_budgets(frame, share).collect()}
        cap = {x[:3]: x[3] * M.MAX_EPOCHS for x in leaves}
        under = lambda *p: sum(v for k, v in cap.items() if k[: len(p)] == p)
        want = {}
        domains = water_fill(sum(x[3] for x in leaves) * share, {d: (M.DOMAIN_WEIGHTS[d], under(d)) for d in {x[0] for x in leaves}})
        for d, b in domains.items():
            for lang, b2 in water_fill(b, {x: (M.LANG_WEIGHTS[x], under(d, x)) for x in {y[1] for y in leaves if y[0] == d}}).items():
                want |= {(d, lang, s): v for s, v in water_fill(b2, {s: (M.SOURCE_WEIGHTS.get(s, 1.0), under(d, lang, s)) for s in {y[2] for y in leaves if y[:2] == (d, lang)}}).items()}
        assert all(abs(got[k] - want[k]) <= 1 for k in want), (share, got, want)


def test_oracle_on_hard_rows(hard):
    documents = hard.dropDuplicates(["doc_id"]).toArrow()  # noqa: F841
    c = duckdb.connect()
    c.execute("create table d as select * from documents")
    c.execute("create or replace view documents as select * from d")
    want = sorted(map(str, c.sql(M.SQL).fetchall()))
    got = sorted(str((r.doc_id, r.domain, r.lang, r.source, r.epoch, r.n_tokens)) for r in M.selection(hard.dropDuplicates(["doc_id"])).collect())
    assert want == got


def test_edge_cases(hard, nothing, clashing):
    out = M.mixed(hard)
    assert out.columns == hard.columns
    rows = out.collect()
    assert all(r.text and r.text.strip() for r in rows)
    n = M.selection(hard).count()
    assert len(rows) == n and M.mixed(clashing).count() == n and M.mixed(clashing).columns == clashing.columns
    assert M.mixed(nothing).count() == 0 and M.selection(nothing).count() == 0


def test_mixed_rows_are_those_selected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert sorted(r.doc_id for r in M.mixed(docs).collect()) == sorted(r.doc_id for r in M.selection(docs).collect())


def test_other_targets(spark):
    rows = [(f"d{i}", "one two three four", lang, source) for i in range(30) for lang, source in (("en", "code/a"), ("en", "books/b"), ("it", "books/b"))]
    docs = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    from pyspark.sql import functions as F

    targets = M.Targets(domain_weights={"code": 3, "books": 1}, lang_weights={"it": 0}, budget=1 / 3, max_epochs=1, seed=5, domain=lambda s: F.substring_index(s, "/", 1))
    got = M.selection(docs, targets).collect()
    n = {d: sum(r.n_tokens for r in got if r.domain == d) for d in ("code", "books")}
    assert n == {"code": 88, "books": 28} and all(r.lang == "en" and r.epoch == 0 for r in got)
    assert M.mixed(docs, targets).count() == len(got)
    other = {r.doc_id for r in M.selection(docs, M.Targets(domain_weights=targets.domain_weights, lang_weights={"it": 0}, budget=1 / 3, max_epochs=1, seed=6, domain=targets.domain)).collect()}
    assert other != {r.doc_id for r in got}
