"""Quality rules by distribution divergence.

A document's histograms of character classes and of its language's common words are compared
with those of all documents of the language, by Jensen-Shannon distance (base 2, 0 to 1).
A document is rejected if a distance exceeds its limit, or if it has no word at all. A histogram
of few observations strays from its reference by chance, by about sqrt((bins - 1) / (8 n ln 2));
each limit grows by NOISE times that, and below MIN_WORDS words nothing is judged: a short text
is no evidence of a strange distribution.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from strataleaf.llm.common import chunks, in_small_batches, small, written

#: Classes of characters: ASCII small letters, capitals, digits, blank space, these sentence marks, other ASCII; all else.
MARKS = ".,;:!?'\"()-"
COMMON = {
    "en": "the of and to in is that it for was on with as be at by this from are an a not or have you".split(),
    "fr": "le la les de des du et un une en que qui dans pour pas sur au est avec par il elle ce se aux".split(),
    "de": "der die das und in den von zu mit sich des auf ist im dem nicht ein eine als auch es an er so".split(),
    "es": "el la los las de del y en que un una por con no para es al lo se su como más o le a".split(),
}
MIN_WORDS = 10
CLASS_LIMIT, WORD_LIMIT, NOISE = 0.2, 0.05, 1.5

#: Bytes of text that are worked on at a time.
PART = 2 << 20
_KINDS, _WIDTH = 7, 26  # bins: the classes; then the common words and all other words

_CLASS = bytearray([6]) * 256
for _c in range(128):
    _ch = chr(_c)
    _CLASS[_c] = 0 if "a" <= _ch <= "z" else 1 if "A" <= _ch <= "Z" else 2 if "0" <= _ch <= "9" else 3 if _ch in " \t\r\n" else 4 if _ch in MARKS else 5
_CLASS[0x80:0xC0] = bytes([7]) * 64  # the second and later bytes of a character
#: Words are runs of ASCII letters and of all characters beyond ASCII; only ASCII capitals are lowered.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Lexicon:
    """Common words by language, looked up by their first eight bytes read as one number; longer words aren't supported."""

    def __init__(self, common: dict[str, list[str]]) -> None:
        each = {k: [w.encode() for w in v] for k, v in common.items()}
        if any(not 0 < len(w) <= 8 or len(v) >= _WIDTH for v in each.values() for w in v):
            raise ValueError(f"common words have 1 to 8 bytes, and a language at most {_WIDTH - 1} of them")
        self.langs = {k: i + 1 for i, k in enumerate(each)}  # 0: a language without a list
        words = sorted({int.from_bytes(w, "little") for v in each.values() for w in v})
        place = {w: i + 1 for i, w in enumerate(words)}
        #: by language and word: the word's bin; the last bin is that of all other words
        self.bins = np.full((len(each) + 1, len(words) + 1), _WIDTH - 1, np.int64)
        for k, v in each.items():
            for i, w in enumerate(v):
                self.bins[self.langs[k], place[int.from_bytes(w, "little")]] = i
        #: a hash table without collisions: slot -> word and its number, 0 where empty
        keys, self.bits, self.magic = np.array(words, np.uint64), 12, np.uint64(0x9E3779B97F4A7C15)
        while len({int(x) for x in (keys * self.magic) >> np.uint64(64 - self.bits)}) < len(keys):
            self.magic = self.magic * np.uint64(0xD1342543DE82EF95) + np.uint64(2)
            self.bits += self.bits < 20
        self.keys, self.numbers = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        at = (keys * self.magic) >> np.uint64(64 - self.bits)
        self.keys[at], self.numbers[at] = keys, np.arange(1, len(keys) + 1)

    def number(self, key: np.ndarray) -> np.ndarray:
        at = (key * self.magic) >> np.uint64(64 - self.bits)
        return np.where(self.keys[at] == key, self.numbers[at], 0)


_LOW = np.array([(1 << 8 * n) - 1 for n in range(8)] + [2**64 - 1], np.uint64)  # the first n bytes of eight


def histograms(data: bytes, offsets: np.ndarray, langs: list[str | None], lexicon: Lexicon) -> np.ndarray:
    """Rows x bins of the texts data[offsets[i]:offsets[i + 1]]: counts of the classes, then of the language's common words and, last, other words."""
    n = len(offsets) - 1
    out = np.zeros((n, _KINDS + _WIDTH), np.int64)
    kinds = np.frombuffer(data.translate(_CLASS), np.uint8)
    for i in range(n):
        out[i, :_KINDS] = np.bincount(kinds[offsets[i] : offsets[i + 1]], minlength=8)[:_KINDS]
    flat = np.frombuffer(data.translate(_WORD) + b" " * 8, np.uint8)
    edge = np.diff((flat != 32).view(np.int8), prepend=np.int8(0))
    inner = offsets[1:-1]
    split = inner[(inner > 0) & (flat[inner] != 32) & (flat[np.maximum(inner - 1, 0)] != 32)] if len(data) else inner[:0]  # a text ends in a word, and the next one begins with one
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    if len(split):
        split = np.unique(split)
        start, end = np.sort(np.concatenate((start, split))), np.sort(np.concatenate((end, split)))
    row = np.searchsorted(offsets, start, "right") - 1 if len(start) else start
    length = end - start
    fits = length <= 8
    window = np.lib.stride_tricks.as_strided(flat, (max(len(flat) - 7, 0), 8), (1, 1))
    key = np.ascontiguousarray(window[start[fits]]).view("<u8").reshape(-1) & _LOW[length[fits]]
    lang = np.array([lexicon.langs.get(k, 0) for k in langs], np.int64)
    at = row[fits]
    bins = lexicon.bins[lang[at], lexicon.number(key)]
    words = np.bincount(at * _WIDTH + bins, minlength=n * _WIDTH).reshape(n, _WIDTH)
    words[:, -1] += np.bincount(row[~fits], minlength=n)
    out[:, _KINDS:] = words
    return out


def _parts(text: pa.Array, langs: pa.Array, lexicon: Lexicon):
    """(from, to, histograms) of a column, in parts of bounded size but for a single long text. Nulls count as empty."""
    text = text.cast(pa.large_string())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data, names = text.buffers()[2], langs.to_pylist()
    for a, b in chunks(offsets, PART):
        own = offsets[a : b + 1]
        yield a, b, histograms(data[int(own[0]) : int(own[-1])].to_pybytes() if data else b"", own - own[0], names[a:b], lexicon)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    flat = np.concatenate(rows) if rows else np.zeros((0, _KINDS + _WIDTH), np.int64)
    return pa.FixedSizeListArray.from_arrays(pa.array(flat.reshape(-1)), _KINDS + _WIDTH).cast(pa.list_(pa.int64()))


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of each row of counts p from that of q; 0 if either is all zero."""
    np_, nq = p.sum(1, keepdims=True), q.sum(1, keepdims=True)
    x, y = p / np.maximum(np_, 1), q / np.maximum(nq, 1)
    m = np.maximum((x + y) / 2, 1e-300)
    with np.errstate(divide="ignore", invalid="ignore"):
        total = (np.where(x > 0, x * np.log2(x / m), 0.0) + np.where(y > 0, y * np.log2(y / m), 0.0)).sum(1)
    return np.where((np_ == 0) | (nq == 0), 0.0, np.sqrt(np.maximum(total / 2, 0.0))[:, None])[:, 0]


def _limit(base: float, bins: int, n: np.ndarray) -> np.ndarray:
    return base + NOISE * np.sqrt((bins - 1) / (8 * np.log(2) * np.maximum(n, 1)))


def judged(own: np.ndarray, all_: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, distance of classes, distance of words, whether the document passes) of rows of histograms and their references."""
    chars, n = own[:, :_KINDS].sum(1), own[:, _KINDS:].sum(1)
    kinds, words = js_distance(own[:, :_KINDS], all_[:, :_KINDS]), js_distance(own[:, _KINDS:], all_[:, _KINDS:])
    far = (kinds > _limit(CLASS_LIMIT, _KINDS, chars)) | (words > _limit(WORD_LIMIT, _WIDTH, n))
    return n, kinds, words, (n > 0) & ((n < MIN_WORDS) | ~far)


def _matrix(lists: pa.Array, n: int) -> np.ndarray:
    """Lists of all bins as rows; a null list is a reference of nothing."""
    lists = pc.fill_null(lists, pa.scalar([0] * (_KINDS + _WIDTH), lists.type))
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _udf_histogram(lexicon: Lexicon):
    @F.arrow_udf(ArrayType(LongType()))
    def histogram(text: pa.Array, lang: pa.Array) -> pa.Array:
        return _lists([h for _, _, h in _parts(text, lang, lexicon)])

    return histogram


def _udf_passes(lexicon: Lexicon):
    @F.arrow_udf(BooleanType())
    def passes(text: pa.Array, lang: pa.Array, reference: pa.Array) -> pa.Array:
        all_ = _matrix(reference, len(text))
        ok = [judged(h, all_[a:b])[3] for a, b, h in _parts(text, lang, lexicon)]
        return pa.array(np.concatenate(ok) if ok else np.zeros(0, bool))

    return passes


_JUDGED = StructType([StructField("n_words", LongType()), StructField("class_js", DoubleType()), StructField("word_js", DoubleType()), StructField("ok", BooleanType())])


@F.arrow_udf(_JUDGED)
def _judge(own: pa.Array, reference: pa.Array) -> pa.Array:
    n, kinds, words, ok = judged(_matrix(own, len(own)), _matrix(reference, len(own)))
    return pa.StructArray.from_arrays([pa.array(n), pa.array(kinds), pa.array(words), pa.array(ok)], _JUDGED.names)


def _by_language(h: DataFrame) -> DataFrame:
    """(_sl_ref, _sl_all) of (lang, h): null is a language of its own, ''."""
    sums = [F.sum(F.col("h")[i]) for i in range(_KINDS + _WIDTH)]
    return written(h.groupBy(F.coalesce("lang", F.lit("")).alias("_sl_ref")).agg(F.array(*sums).alias("_sl_all")), "references")


def references(docs: DataFrame, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """(lang, histogram): the summed histogram of each language, over all documents given; null counts as ''.

    Summed up inside Python per batch, so that what leaves it is a few rows.
    """
    lexicon = Lexicon(common)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array([x or "" for x in batch.column("lang").to_pylist()], object)
            for a, b, h in _parts(batch.column("text"), batch.column("lang"), lexicon):
                for k in dict.fromkeys(names[a:b]):
                    sums[k] = sums.get(k, 0) + h[names[a:b] == k].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), _lists([np.stack(list(sums.values()))] if sums else [])], ["lang", "h"])

    partial = in_small_batches(docs).select("text", "lang").mapInArrow(add_up, "lang string, h array<long>")
    return _by_language(partial).select(F.col("_sl_ref").alias("lang"), F.col("_sl_all").alias("histogram"))


def _with_reference(docs: DataFrame, reference: DataFrame) -> DataFrame:
    """docs with _sl_all, that of their language, or null."""
    ref = small(reference.select(F.col("lang").alias("_sl_ref"), F.col("histogram").alias("_sl_all")), 8 * (_KINDS + _WIDTH) + 64)
    return docs.join(ref, F.coalesce("lang", F.lit("")) == F.col("_sl_ref"), "left")


def kept(docs: DataFrame, reference: DataFrame | None = None, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """The rows of docs that pass, with the columns of docs.

    reference: (lang, histogram), as references() makes it, of texts that are known to be good; a
    language that it lacks isn't judged but for having words. Without one it is that of docs
    themselves, good and bad: then what most of a language's text is like passes.

    A null, empty or wordless text is rejected. A null language is a language of its own; one
    without a list of common words is judged by its character classes alone. Repeated rows are
    judged each, and alike. An empty table gives an empty table.

    Texts are read twice, to sum up the references and to judge, and aren't moved.
    """
    reference = references(docs, common) if reference is None else reference
    passes = _udf_passes(Lexicon(common))
    return _with_reference(docs, reference).where(passes(F.col("text"), F.col("lang"), F.col("_sl_all"))).select(*docs.columns)


def decisions(docs: DataFrame, reference: DataFrame | None = None, common: dict[str, list[str]] = COMMON) -> DataFrame:
    """(doc_id, lang, n_words, class_js, word_js) of the documents that pass; distances to 4 places. Judged as kept() does.

    Texts are read once, into a table of histograms, which serves the references and the distances.
    """
    histogram = _udf_histogram(Lexicon(common))
    own = written(in_small_batches(docs).select("doc_id", "lang", histogram(F.col("text"), F.col("lang")).alias("h")), "histograms")
    if reference is None:
        reference = _by_language(own.select("lang", "h")).select(F.col("_sl_ref").alias("lang"), F.col("_sl_all").alias("histogram"))
    found = _with_reference(own, reference).select("doc_id", "lang", _judge(F.col("h"), F.col("_sl_all")).alias("j"))
    # ok is asked after the struct has been made once
    each = found.select("doc_id", "lang", F.explode(F.array("j")).alias("j")).where("j.ok")
    return each.select("doc_id", "lang", "j.n_words", F.round("j.class_js", 4).alias("class_js"), F.round("j.word_js", 4).alias("word_js"))


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_COUNTS = ", ".join(f"len(text) - len(regexp_replace(text, '[{c}]', '', 'g'))" for c in ("a-z", "A-Z", "0-9", r" \t\r\n", r".,;:!?''\"()\-"))
#: The same in DuckDB's SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, lang, coalesce(lang, '') AS l, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-`{{-\x7f]+'), lambda x: x <> '') AS ws,
    [{_COUNTS}, len(regexp_replace(text, '[a-zA-Z0-9 \t\r\n.,;:!?''\"()\-]|[^\x00-\x7f]', '', 'g')), len(regexp_replace(text, '[\x00-\x7f]', '', 'g'))] AS kinds,
    CASE l {" ".join(f"WHEN '{k}' THEN {_sql_list(v)}" for k, v in COMMON.items())} ELSE CAST([] AS VARCHAR[]) END AS common
  FROM d),
h AS (SELECT doc_id, lang, l, len(ws) AS n, kinds,
    list_transform(range(1, {_WIDTH}), lambda i: CASE WHEN i <= len(common) THEN len(list_filter(ws, lambda x: x = common[i])) ELSE 0 END) AS c FROM w),
g AS (SELECT *, list_append(c, n - CAST(list_sum(c) AS BIGINT)) AS words FROM h),
r AS (SELECT l AS rl, [{", ".join(f"sum(kinds[{i}])" for i in range(1, _KINDS + 1))}] AS rk, [{", ".join(f"sum(words[{i}])" for i in range(1, _WIDTH + 1))}] AS rw FROM g GROUP BY l),
p AS (SELECT g.*, list_sum(kinds) AS nk,
    list_transform(kinds, lambda x: x / greatest(list_sum(kinds), 1)) AS pk, list_transform(rk, lambda x: x / greatest(list_sum(rk), 1)) AS qk,
    list_transform(words, lambda x: x / greatest(list_sum(words), 1)) AS pw, list_transform(rw, lambda x: x / greatest(list_sum(rw), 1)) AS qw FROM g JOIN r ON l = rl),
js AS (SELECT doc_id, lang, n, nk,
    CASE WHEN nk = 0 THEN 0 ELSE sqrt(greatest(0, list_sum(list_transform(range(1, {_KINDS + 1}), lambda i:
      CASE WHEN pk[i] > 0 THEN pk[i] * log2(pk[i] / ((pk[i] + qk[i]) / 2)) ELSE 0 END + CASE WHEN qk[i] > 0 THEN qk[i] * log2(qk[i] / ((pk[i] + qk[i]) / 2)) ELSE 0 END)) / 2)) END AS cj,
    CASE WHEN n = 0 THEN 0 ELSE sqrt(greatest(0, list_sum(list_transform(range(1, {_WIDTH + 1}), lambda i:
      CASE WHEN pw[i] > 0 THEN pw[i] * log2(pw[i] / ((pw[i] + qw[i]) / 2)) ELSE 0 END + CASE WHEN qw[i] > 0 THEN qw[i] * log2(qw[i] / ((pw[i] + qw[i]) / 2)) ELSE 0 END)) / 2)) END AS wj FROM p)
SELECT doc_id, lang, CAST(n AS BIGINT) AS n_words, round(cj, 4) AS class_js, round(wj, 4) AS word_js FROM js
WHERE n > 0 AND (n < {MIN_WORDS} OR (cj <= {CLASS_LIMIT} + {NOISE} * sqrt({_KINDS - 1} / (8 * ln(2) * greatest(nk, 1))) AND wj <= {WORD_LIMIT} + {NOISE} * sqrt({_WIDTH - 1} / (8 * ln(2) * greatest(n, 1)))))
"""
