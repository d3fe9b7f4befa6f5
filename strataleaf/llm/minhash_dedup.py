"""Near-duplicate removal by BagMinHash signatures, banding and exact multiset overlap.

A document is the multiset of its three-word shingles. Its signature follows BagMinHash (Ertl,
KDD 2018): every shingle owns Poisson processes over its weight axis, cut into dyadic levels
(0,1], (1,2], (2,4], (4,8] and so on; a point carries a time, a slot and a position on the axis,
and counts only below the shingle's weight in the document. A slot holds the earliest point's
time, so two documents agree in a slot with the probability of their weighted Jaccard similarity,
without bias, whatever the weights. Points are drawn in order of time and only up to a horizon
that falls with the document's weight, so the work for a signature hardly depends on length.

Signatures are cut into bands; documents that share a band are candidates. A bucket of n proposes
n-1 pairs (each with its smallest id), which are verified by exact overlap of the multisets;
then, in the buckets that still hold several groups, all pairs across groups. So large buckets of
true copies stay linear, and no candidate is dropped.

What is asked of a bucket or a node is its least and greatest member: an aggregate with partial
results before the shuffle, joined back. So a hot text, band or node never has to meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.common import chunks, in_small_batches, small, spent, written

BANDS, ROWS = 32, 4
SLOTS = BANDS * ROWS
THRESHOLD = 0.5
SHINGLE = 3
#: Bytes of text that are worked on at a time.
PART = 1 << 20

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_HASH_BITS = np.uint64(48)
_HASH_MASK = np.uint64((1 << 48) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def plain(text: Column) -> Column:
    """A text in small letters, in which every character is an ASCII one or a letter or digit; one without letters and digits as it is."""
    return F.when(text.rlike(r"[\p{L}\p{N}]"), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\x00-\x7f]+", " ")).otherwise(text)


#: Words are runs of ASCII letters and digits and of all characters beyond ASCII, after plain().
_WORD = bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))  # what a byte counts in a word's hash
_BASE = 0x5851F42D4C957F2D
_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(2)
def _table(base: int, bits: int) -> np.ndarray:
    out = np.ones(1 << bits, np.uint64)
    for k in range(bits):  # the first 2**k powers, times the next one
        out[1 << k : 2 << k] = out[: 1 << k] * np.uint64(pow(base, 1 << k, 1 << 64))
    return out


def _powers(base: int, n: int) -> np.ndarray:
    return _table(base, max(20, n.bit_length()))[:n]


def word_hashes(data: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all texts, offsets of each text's words); the texts are data[offsets[i]:offsets[i + 1]], as plain() makes them.

    A word's hash is a polynomial over its bytes, taken as a difference of running sums. A text that
    has no word but isn't blank is one word of its own.
    """
    n = len(offsets) - 1
    flat = np.frombuffer(data.translate(_WORD), np.uint8)
    inside = flat != 32
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    inner = np.unique(offsets[1:-1])
    inner = inner[(inner > 0) & (inner < len(flat))]
    split = inner[inside[inner] & inside[inner - 1]] if len(inner) else inner  # a text ends in a word, and the next one begins with one
    if len(split):
        start, end = np.sort(np.concatenate((start, split))), np.sort(np.concatenate((end, split)))
    at = np.searchsorted(start, offsets)
    wordless = np.flatnonzero((np.diff(at) == 0) & (np.diff(offsets) > 0))
    if len(wordless):
        whole = [(offsets[i], offsets[i + 1]) for i in wordless if data[offsets[i] : offsets[i + 1]].strip()]
        if whole:
            more = np.array(whole, np.int64)
            order = np.argsort(np.concatenate((start, more[:, 0])), kind="stable")
            start, end = np.concatenate((start, more[:, 0]))[order], np.concatenate((end, more[:, 1]))[order]
            at = np.searchsorted(start, offsets)
    raw = np.frombuffer(data, np.uint8)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _powers(_BASE, len(raw)), out=sums[1:])
    own = (sums[end] - sums[start]) * _powers(_INVERSE, len(raw) + 1)[start]
    return mix(own + (end - start).astype(np.uint64) * _GOLD), at


def sequence_hashes(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's sequence of words."""
    place = np.arange(len(values)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = []
    for salt in (1, 2):
        each = mix(values ^ mix(place.astype(np.uint64) * np.uint64(2) + np.uint64(salt << 60)))
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(each, out=sums[1:])
        out.append(mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out[0], out[1]


def multisets(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of documents given as word hashes: (document, shingle, count), sorted by both. At most 65,536 documents."""
    v = np.append(values.astype(np.uint64), np.zeros(SHINGLE, np.uint64))
    start, end = offsets[:-1], offsets[1:]
    n = np.where(end > start, np.maximum(end - start - (SHINGLE - 1), 1), 0)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start, n)
    last = end[doc]
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        h = mix(h * np.uint64(0x100000001B3) + np.where(at + k < last, v[at + k], np.uint64(0)))
    key = np.sort((doc.astype(np.uint64) << _HASH_BITS) | (h & _HASH_MASK))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    count = np.diff(np.append(first, len(key)))
    return (key[first] >> _HASH_BITS).astype(np.int64), key[first] & _HASH_MASK, count


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """n x slots arrival times; a document without shingles has infinity throughout. slots: a power of two, at most 2048."""
    weight = np.bincount(doc, weights=count, minlength=n)
    out = np.full((n, slots), np.inf)
    todo, reach = weight > 0, np.log(slots) + 3.0
    while todo.any():
        mine = todo[doc]
        horizon = np.where(todo, reach / np.maximum(weight, 1), 0)
        _points(doc[mine], shingle[mine], count[mine], horizon, out, slots)
        todo &= np.isinf(out).any(axis=1)  # a slot that is still empty: draw that document's points further
        reach *= 2
    return out


def _points(doc, shingle, count, horizon, out, slots) -> None:
    """Enter every point up to its document's horizon."""
    flat, low = out.reshape(-1), np.uint64(slots - 1)
    level, base, width = 0, 0, 1  # level: the part (base, base + width] of the weight axis
    while len(doc):
        seed = mix(shingle + np.uint64(level << 48))
        t, k, rate = np.zeros(len(doc)), 0, float(slots * width)
        d, w, until = doc, count, horizon[doc]
        while len(d):
            u = mix(seed + np.uint64(k * int(_GOLD) & (2**64 - 1)))
            t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
            on = t <= until
            if not on.all():
                d, w, seed, t, u, until = d[on], w[on], seed[on], t[on], u[on], until[on]
            where = d * slots + (u & low).astype(np.int64)
            if width == 1:
                np.minimum.at(flat, where, t)
            else:  # the point's unit on the axis must lie below the weight
                inside = base + (mix(u) % np.uint64(width)).astype(np.int64) < w
                np.minimum.at(flat, where[inside], t[inside])
            k += 1
        base, level = base + width, level + 1
        width = max(1, base)
        more = count > base
        doc, shingle, count = doc[more], shingle[more], count[more]


def band_keys(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    bits = np.ascontiguousarray(signature).view(np.uint64).reshape(len(signature), bands, signature.shape[1] // bands)
    h = np.broadcast_to(np.arange(bands, dtype=np.uint64), bits.shape[:2])
    for k in range(bits.shape[2]):
        h = mix(h * np.uint64(0x100000001B3) + bits[:, :, k])
    return h.view(np.int64)


def _list_array(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values, pa.int64()))


def _parts(batches: Iterator[pa.RecordBatch]):
    """(ids, word hashes, offsets) of the rows of (id, text) that have words, in parts of bounded size but for a single long text."""
    for batch in batches:
        text = batch.column("text").cast(pa.large_string())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        data = text.buffers()[2]
        for a, b in chunks(offsets, PART, 1 << 16):
            own = offsets[a : b + 1]
            values, at = word_hashes(data[int(own[0]) : int(own[-1])].to_pybytes() if data else b"", own - own[0])
            has = np.diff(at) > 0
            yield batch.column("id").slice(a, b - a).filter(pa.array(has)), values, np.append(at[:-1][has], at[-1])


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for ids, values, offsets in _parts(batches):
        doc, shingle, count = multisets(values, offsets)
        keys = band_keys(signatures(doc, shingle, count, len(ids)))
        h1, h2 = sequence_hashes(values, offsets)
        yield pa.RecordBatch.from_arrays([ids, pa.array(h1), pa.array(h2), _list_array(keys.reshape(-1), np.full(len(ids), BANDS))], ["id", "h1", "h2", "bands"])


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A multiset as a set: the i-th of equal shingles is an element of its own."""
    for ids, values, offsets in _parts(batches):
        doc, shingle, count = multisets(values, offsets)
        nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        element = mix(np.repeat(mix(shingle), count) + nth.astype(np.uint64))
        sizes = np.bincount(doc, weights=count, minlength=len(ids)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([ids, pa.array(sizes), _list_array(element.view(np.int64), sizes)], ["id", "n", "elements"])


def _mapped(docs: DataFrame, f, rest: str) -> DataFrame:
    """f over docs (id, text); what it returns has id, of docs' own type, and `rest`."""
    kind = docs.schema["id"].dataType.simpleString()
    return in_small_batches(docs).select("id", plain(F.col("text")).alias("text")).mapInArrow(f, f"id {kind}, {rest}")


def _components(edges: DataFrame) -> DataFrame:
    """(id, root): connected components of (a, b), by alternating large-star and small-star; roots themselves included."""

    def least(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("a").agg(F.min("b").alias("m")), "a")

    edges, before = written(edges.select("a", "b").distinct(), "edges"), None
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # large-star: every larger neighbour goes to the least of the neighbourhood
        large = least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # small-star: every smaller neighbour, and the node itself
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
        each = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("e")
        after = written(least(down).select(each).select("e.a", "e.b").where("a <> b").distinct(), "edges", F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")))
        spent(edges)
        edges, now = after, after._sl_seen
        if now == before:
            break
        before = now
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
    return roots.union(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct()).groupBy("id").agg(F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): each document that repeats another, and the least id of its group, which stays.

    A group is a connected component of pairs whose multiset Jaccard similarity reaches threshold.
    Ids may be of any type that has an order. Rows with a null id, or a null or blank text, belong to no
    group. Rows with one id are one document, whatever their texts: they link what any of them resembles.
    Texts shorter than a shingle count as one shingle. Of texts without letters or digits the runs of symbols
    beyond ASCII count as words; if they have none, only exact copies belong together. An empty table gives an empty result. Other columns are ignored.
    """
    keyed = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    return _groups(keyed, threshold).where("id <> root").select(F.col("id").alias("doc_id"), F.col("root").alias("duplicate_of"))


def _groups(docs: DataFrame, threshold: float) -> DataFrame:
    """(id, root) of the documents (id, text) that belong to a group."""
    signed = written(_mapped(docs, _sign, "h1 long, h2 long, bands array<long>"), "signatures")
    # equal word sequences first: one representative each
    same = signed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = small(written(same, "same"), 96)
    copies = signed.select("id", "h1", "h2").join(same, ["h1", "h2"]).where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = signed.join(same, ["h1", "h2"], "left").where("rep IS NULL OR id = rep").select("id", "bands")
    banded = reps.select(F.explode("bands").alias("key"), "id")
    buckets = banded.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least <> most").select("key", "least")
    members = written(banded.join(small(written(buckets, "buckets"), 128), "key"), "members")
    ids = written(members.select("id").distinct(), "candidates")
    elements = written(_mapped(docs.join(small(ids, 96), "id", "left_semi"), _elements, "n long, elements array<long>"), "elements")
    first = _verified(members.where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")), elements, threshold)
    root = written(_components(first), "roots")
    # buckets that still hold several groups: every pair across groups
    grouped = members.join(small(root, 128), "id", "left").select("key", "id", "least", F.coalesce("root", "id").alias("g"))
    several = grouped.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low <> high").select("key")
    several = written(several, "several")
    stars = root.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")).union(copies)
    if several.isEmpty():
        return _components(stars)
    mixed = written(grouped.join(small(several, 32), "key", "left_semi"), "mixed")
    x, y = mixed.alias("x"), mixed.alias("y")
    # pairs with the bucket's least id were verified before
    across = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.id") > F.col("y.id")) & (F.col("x.g") != F.col("y.g")) & (F.col("y.id") != F.col("y.least")))
    second = _verified(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")), elements, threshold)
    return _components(stars.union(second))


def _verified(pairs: DataFrame, elements: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose multisets overlap enough. Sizes alone rule out many before the elements are sent.

    The elements of a travel with each of its pairs, those of b once; where the pairs fit a broadcast, those of a
    aren't moved to meet them.
    """
    sizes = elements.select("id", "n")
    pairs = pairs.distinct().join(sizes.select(F.col("id").alias("a"), F.col("n").alias("na")), "a").join(sizes.select(F.col("id").alias("b"), F.col("n").alias("nb")), "b")
    pairs = written(pairs.where(F.least("na", "nb") >= threshold * F.greatest("na", "nb")), "pairs")
    left = elements.select(F.col("id").alias("a"), F.col("elements").alias("ea")).join(small(pairs, 128), "a")
    asked = written(pairs.select("b").distinct(), "asked")
    right = elements.select(F.col("id").alias("b"), F.col("elements").alias("eb")).join(small(asked, 96), "b", "left_semi")
    both = F.size(F.array_intersect("ea", "eb"))
    return left.join(right, "b").where(both >= threshold * (F.col("na") + F.col("nb") - both)).select("a", "b")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near duplicates: of each group the row with the least id stays, a null id being the greatest.

    A row is known by its id and its text: rows that share an id but not the text are documents of their
    own, and of rows that share both one stays. Rows with a null or blank text all stay. Columns and their
    order are those of docs.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"))
    groups = _groups(docs.select(key.alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL"), threshold)
    gone = written(groups.where("id <> root").select(F.col("id").alias("_sl_gone")), "removed")
    marked = docs.withColumn("_sl_key", key)
    kept = marked.join(small(gone, 96), F.col("_sl_key") == F.col("_sl_gone"), "left_anti")
    inked = F.col(text_col).rlike(r"\S")
    repeated = written(docs.where(inked).select(key.alias("_sl_id")).groupBy("_sl_id").count().where("count > 1").select("_sl_id"), "repeated")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    twice = kept.join(small(repeated, 96), F.col("_sl_key") == F.col("_sl_id"), "left")
    one = twice.where("_sl_id IS NOT NULL").withColumn("_sl_n", F.row_number().over(Window.partitionBy("_sl_id").orderBy("_sl_id"))).where("_sl_n = 1")
    return twice.where("_sl_id IS NULL").select(*docs.columns).union(one.select(*docs.columns))
