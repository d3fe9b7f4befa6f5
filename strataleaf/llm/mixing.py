"""Mixing sources to target weights, by hierarchical budgets over domain, language and source.

Every node of the tree has a weight among its siblings and, from below, a capacity: the tokens of
its leaves times MAX_EPOCHS. The root's budget is handed down by weight; a child takes no more
than its capacity, and what it can't take goes to its siblings by weight, so a shortage reaches
an ancestor's siblings only when everything below that ancestor is exhausted (its own capacity).
A leaf's budget buys whole epochs of the leaf and then a prefix, by tokens, of one more epoch in
that epoch's own seeded order.

An epoch's order is that of md5(seed:epoch:doc_id). To find a prefix without sorting a leaf in
one place, tokens are summed over the 4,096 leading hash values of a leaf; every document before
the boundary value is in, every one after it is out, and only those at the boundary are ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.common import n_words, n_words_sql, small, written

#: Shares among siblings; what isn't named has weight 1.
DOMAIN_WEIGHTS = {"web": 0.5, "reference": 0.3, "forum": 0.2}
LANG_WEIGHTS = {"en": 0.4, "fr": 0.2, "de": 0.2, "es": 0.2}
SOURCE_WEIGHTS = {"src0": 2.0}
#: The domain of a source is that of its number modulo 3.
DOMAINS = ("web", "reference", "forum")
MAX_EPOCHS = 4
SEED = 17
#: The budget as a share of all tokens.
BUDGET = 0.8

_LEAF = ["_sl_domain", "_sl_lang", "_sl_source"]


def domain_of(source: Column) -> Column:
    """The domain of a source: by its trailing number; 'web' if it has none or is null."""
    n = F.coalesce(F.regexp_extract(source, "([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), n % len(DOMAINS) + 1)


@dataclass(frozen=True)
class Targets:
    """What a mixture should be: weights among siblings (what isn't named has weight 1, and what has none isn't taken), the share of
    all tokens to take, the most epochs of a leaf, the seed of their orders, and the domain of a source."""

    domain_weights: Mapping[str, float] = field(default_factory=lambda: DOMAIN_WEIGHTS)
    lang_weights: Mapping[str, float] = field(default_factory=lambda: LANG_WEIGHTS)
    source_weights: Mapping[str, float] = field(default_factory=lambda: SOURCE_WEIGHTS)
    budget: float = BUDGET
    max_epochs: int = MAX_EPOCHS
    seed: int = SEED
    domain: Callable[[Column], Column] = domain_of


TARGETS = Targets()


def _weight(weights: Mapping[str, float], name: Column) -> Column:
    out = F.lit(1.0)
    for k, v in weights.items():
        out = F.when(name == k, F.lit(float(v))).otherwise(out)
    return out


def _fill(nodes: DataFrame, parents: list[str]) -> DataFrame:
    """Water-filling: nodes (parents..., w, cap, budget of the parent) with what each gets.

    Sorted by cap / w, the children that are exhausted form a prefix: child i is, if cap_i / w_i times the
    weight from i on is at most what the children before it leave.
    """
    nodes = nodes.where("w > 0")
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("cap") / F.col("w"), "name").rowsBetween(Window.unboundedPreceding, -1)
    out = nodes.withColumns({"cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(order), F.lit(0.0)), "w_all": F.sum("w").over(group)})
    out = out.withColumn("full", F.col("cap") / F.col("w") * (F.col("w_all") - F.col("w_before")) <= F.col("budget") - F.col("cap_before") + 1e-6)
    sums = {"cap_full": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(group), "w_rest": F.sum(F.when(~F.col("full"), F.col("w")).otherwise(0.0)).over(group)}
    return out.withColumns(sums).withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise((F.col("budget") - F.col("cap_full")) * F.col("w") / F.col("w_rest")))


def leaf_budgets(leaves: DataFrame, budget: float | None = None, targets: Targets = TARGETS) -> DataFrame:
    """leaves (domain, lang, source, tokens) with whole tokens to take: _sl_budget. One row per leaf, so small by nature."""
    d, l, s = _LEAF
    budget = targets.budget if budget is None else budget
    at = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * float(targets.max_epochs))
    top = at.groupBy(d).agg(F.sum("cap").alias("cap"), F.sum("tokens").alias("tokens"))
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    top = _fill(top.select(d, F.col(d).alias("name"), "cap", _weight(targets.domain_weights, F.col(d)).alias("w"), (whole * budget).alias("budget")), [])
    mid = at.groupBy(d, l).agg(F.sum("cap").alias("cap")).join(top.select(d, F.col("got").alias("budget")), d)
    mid = _fill(mid.select(d, l, F.col(l).alias("name"), "cap", _weight(targets.lang_weights, F.col(l)).alias("w"), "budget"), [d])
    low = at.join(mid.select(d, l, F.col("got").alias("budget")), [d, l])
    low = _fill(low.select(d, l, s, F.col(s).alias("name"), "tokens", "cap", _weight(targets.source_weights, F.col(s)).alias("w"), "budget"), [d, l])
    return low.select(d, l, s, "tokens", F.floor(F.col("got") + 1e-6).cast("long").alias("_sl_budget"))


def _named(docs: DataFrame, targets: Targets) -> DataFrame:
    """docs with the leaf; null languages and sources are named ''."""
    named = docs.withColumns({"_sl_lang": F.coalesce("lang", F.lit("")), "_sl_source": F.coalesce("source", F.lit(""))})
    return named.withColumn("_sl_domain", targets.domain(F.col("_sl_source")))


def _key(epoch: Column, targets: Targets) -> Column:
    return F.md5(F.concat(F.lit(f"{targets.seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def _measured(docs: DataFrame, targets: Targets) -> DataFrame:
    """(doc_id, leaf, tokens, tie) of the rows with tokens: the one pass that reads whole texts."""
    sized = _named(docs.select("doc_id", "text", "lang", "source"), targets).select("doc_id", *_LEAF, n_words(F.col("text")).alias("_sl_tokens"), F.xxhash64("text").alias("_sl_tie"))
    return written(sized.where("_sl_tokens > 0"), "measured")


def _plan(narrow: DataFrame, targets: Targets) -> DataFrame:
    """Per leaf: whole epochs, and the leading hash value at which the last epoch's prefix ends, with the tokens left for it."""
    plan = leaf_budgets(written(narrow.groupBy(*_LEAF).agg(F.sum("_sl_tokens").alias("tokens")), "leaves"), None, targets)
    plan = written(plan.withColumns({"_sl_whole": F.floor(F.col("_sl_budget") / F.col("tokens")).cast("int"), "_sl_rest": F.col("_sl_budget") % F.col("tokens")}), "budgets")
    at = narrow.join(small(plan, 256), _LEAF).select(*_LEAF, "_sl_rest", _key(F.col("_sl_whole"), targets).substr(1, 3).alias("_sl_head"), "_sl_tokens")
    sums = at.groupBy(*_LEAF, "_sl_rest", "_sl_head").agg(F.sum("_sl_tokens").alias("n"))
    to_here = F.sum("n").over(Window.partitionBy(*_LEAF).orderBy("_sl_head"))
    edge = sums.withColumn("to", to_here).where("to > _sl_rest").groupBy(*_LEAF).agg(F.min("_sl_head").alias("_sl_edge"), F.min_by(F.col("_sl_rest") - F.col("to") + F.col("n"), "_sl_head").alias("_sl_left"))
    return small(written(plan.select(*_LEAF, "_sl_whole").join(edge, _LEAF, "left"), "plan"), 256)


def _selected(rows: DataFrame, plan: DataFrame, tokens: Column, columns: list[str], targets: Targets) -> DataFrame:
    """`columns` of rows (doc_id, leaf, _sl_tie, ...), all of them with tokens, once per epoch that takes them, and _sl_epoch."""
    rows = rows.join(plan, _LEAF).withColumn("_sl_key", _key(F.col("_sl_whole"), targets))
    head = F.col("_sl_key").substr(1, 3)
    sure = F.col("_sl_whole") + F.when(F.coalesce(head < F.col("_sl_edge"), F.lit(False)), 1).otherwise(0)
    many = rows.withColumn("_sl_n", sure).where("_sl_n > 0").withColumn("_sl_epoch", F.explode(F.sequence(F.lit(0), F.col("_sl_n") - 1)))
    close = rows.where(head == F.col("_sl_edge")).withColumn("_sl_tokens", tokens)
    order = Window.partitionBy(*_LEAF).orderBy("_sl_key", "_sl_tie", "_sl_tokens").rowsBetween(Window.unboundedPreceding, 0)
    close = close.withColumn("_sl_sum", F.sum("_sl_tokens").over(order)).where("_sl_sum <= _sl_left").withColumn("_sl_epoch", F.col("_sl_whole"))
    return many.select(*columns, "_sl_epoch").unionAll(close.select(*columns, "_sl_epoch"))


def mixed(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """The rows of docs that the budgets choose, repeated once per epoch, with the columns of docs.

    A row without tokens (null or blank text) costs nothing and adds nothing: it isn't chosen. A
    null language or source is the leaf ''; a null id orders like an empty one; ties of the order
    (repeated ids) go by the text's hash. An empty table gives an empty table.
    """
    plan = _plan(_measured(docs, targets), targets)
    inked = _named(docs.where(F.col("text").rlike("[^ \\t\\r\\n]")), targets).withColumn("_sl_tie", F.xxhash64("text"))
    return _selected(inked, plan, n_words(F.col("text")), docs.columns, targets).select(*docs.columns)


def selection(docs: DataFrame, targets: Targets = TARGETS) -> DataFrame:
    """(doc_id, domain, lang, source, epoch, n_tokens): one row per document and epoch that takes it."""
    d, l, s = _LEAF
    narrow = _measured(docs, targets)
    out = _selected(narrow, _plan(narrow, targets), F.col("_sl_tokens"), ["doc_id", *_LEAF, "_sl_tokens"], targets)
    return out.select("doc_id", F.col(d).alias("domain"), F.col(l).alias("lang"), F.col(s).alias("source"), F.col("_sl_epoch").alias("epoch"), F.col("_sl_tokens").alias("n_tokens"))


def _case(weights: dict[str, float], name: str) -> str:
    return f"CASE {name} {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in weights.items())} ELSE 1.0 END::DOUBLE"


def _fill_sql(nodes: str, parents: str) -> str:
    return f"""SELECT *, CASE WHEN is_full THEN cap ELSE (budget - cap_full) * w / w_rest END AS got FROM (
      SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER (PARTITION BY {parents}) AS cap_full, sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (PARTITION BY {parents}) AS w_rest FROM (
        SELECT *, cap / w * (w_all - w_before) <= budget - cap_before + 1e-6 AS is_full FROM (
          SELECT *, sum(w) OVER (PARTITION BY {parents}) AS w_all,
            coalesce(sum(cap) OVER (PARTITION BY {parents} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
            coalesce(sum(w) OVER (PARTITION BY {parents} ORDER BY cap / w, name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
          FROM ({nodes}))))"""


_KEY_SQL = f"md5('{SEED}:' || CAST(e AS VARCHAR) || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))"
#: The same in DuckDB's SQL, each leaf sorted as a whole.
SQL = f"""
WITH m AS (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {n_words_sql("text")} AS n FROM documents),
t AS (SELECT *, coalesce([{", ".join(f"'{x}'" for x in DOMAINS)}][TRY_CAST(regexp_extract(source, '([0-9]{{1,9}})$', 1) AS INTEGER) % {len(DOMAINS)} + 1], '{DOMAINS[0]}') AS domain FROM m WHERE n > 0),
leaf AS (SELECT domain, lang, source, sum(n)::BIGINT AS tokens, sum(n)::DOUBLE * {MAX_EPOCHS} AS cap FROM t GROUP BY ALL),
top AS ({_fill_sql(f"SELECT domain, domain AS name, sum(cap) AS cap, {_case(DOMAIN_WEIGHTS, 'domain')} AS w, sum(sum(tokens)) OVER () * {BUDGET} AS budget FROM leaf GROUP BY domain", "1")}),
mid AS ({_fill_sql(f"SELECT l.domain, l.lang, l.lang AS name, sum(l.cap) AS cap, {_case(LANG_WEIGHTS, 'l.lang')} AS w, any_value(top.got) AS budget FROM leaf l JOIN top USING (domain) GROUP BY l.domain, l.lang", "domain")}),
low AS ({_fill_sql(f"SELECT l.domain, l.lang, l.source, l.source AS name, l.tokens, l.cap, {_case(SOURCE_WEIGHTS, 'l.source')} AS w, mid.got AS budget FROM leaf l JOIN mid USING (domain, lang)", "domain, lang")}),
plan AS (SELECT domain, lang, source, tokens, CAST(floor(got + 1e-6) AS BIGINT) AS b FROM low),
copies AS (SELECT t.*, e, b - e * tokens AS room FROM t JOIN plan USING (domain, lang, source), (SELECT unnest(range(0, {MAX_EPOCHS} + 1)) AS e) WHERE b > e * tokens),
ordered AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang, source, e ORDER BY {_KEY_SQL} ROWS UNBOUNDED PRECEDING) AS so_far FROM copies)
SELECT doc_id, domain, lang, source, CAST(e AS INTEGER) AS epoch, n AS n_tokens FROM ordered WHERE so_far <= room
"""
