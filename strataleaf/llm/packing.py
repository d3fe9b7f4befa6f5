"""Best-fit packing planned on the histogram of lengths.

Texts longer than CONTEXT tokens are cut into pieces of CONTEXT and a remainder, so nothing is
lost. A planner sees only how many pieces have each length (at most CONTEXT numbers, whatever the
corpus) and runs best-fit decreasing on counts: bins that look alike are one range of bin numbers
with one gap, and a length is placed into whole ranges at a time. The plan is a list of slot
ranges: the pieces of length L with rank in [lo, hi) go to bins from `bin` on, `per` to a bin.
Each piece then takes its slot by joining on its length and its rank within the length.

Ranks need no global sort and no single task per length: pieces are counted per length and
residue of the id's hash, the counts are summed up in order, and only inside a residue are rows numbered.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataleaf.llm.common import BROADCAST_BYTES, n_words, written

CONTEXT = 2048
#: Residues of the id's hash by which a length's pieces are numbered.
RESIDUES = 1024


def plan(counts: dict[int, int], context: int = CONTEXT) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing on counts: (length, lo, hi, bin, per, offset) for every range of slots.

    Equal to placing piece by piece, longest first, each into the open bin with the least gap that
    holds it (of equal gaps, any): such a bin is filled with as many of the length as it holds
    before another is touched.
    """
    out: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first bin, number of bins)

    def add(gap: int, first: int, n: int) -> None:
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))

    bins = 0
    for length in sorted((k for k, n in counts.items() if k > 0 and n > 0), reverse=True):
        left, at = counts[length], 0
        for gap in sorted(g for g in gaps if g >= length):
            ranges = gaps.pop(gap)
            while ranges and left:
                first, n = ranges.pop()
                per = gap // length
                fill = min(n, left // per)
                offset = context - gap
                if fill:
                    out.append((length, at, at + fill * per, first, per, offset))
                    add(gap - per * length, first, fill)
                    at, left = at + fill * per, left - fill * per
                rest = n - fill
                if rest and left and left < per:  # the last bin of this length is filled in part
                    out.append((length, at, at + left, first + fill, per, offset))
                    add(gap - left * length, first + fill, 1)
                    at, left, fill, rest = at + left, 0, fill + 1, rest - 1
                if rest:
                    ranges.append((first + fill, rest))
            for first, n in ranges:
                add(gap, first, n)
            if not left:
                break
        if left:
            per = context // length
            new = -(-left // per)
            out.append((length, at, at + left, bins, per, 0))
            add(context - per * length, bins, left // per)
            add(context - left % per * length, bins + left // per, 1 if left % per else 0)
            bins += new
    return out


def packed(docs: DataFrame, context: int = CONTEXT) -> DataFrame:
    """(bin_id, slot_offset, doc_id, piece, start_token, n_tokens): the slot of each piece of each row of docs.

    A row with null or blank text has no tokens and no slot. Ids may be of any type that has an order, and a null id is an id like others; repeated
    rows are packed each. An empty table gives an empty table. Other columns are ignored.
    """
    sized = docs.select("doc_id", n_words(F.col("text")).alias("n")).where("n > 0")
    last = F.floor((F.col("n") - 1) / context)
    cut = sized.select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    cut = cut.select("doc_id", F.col("piece").cast("int").alias("piece"), (F.col("piece") * context).alias("start_token"), F.least(F.lit(context), F.col("n") - F.col("piece") * context).cast("int").alias("n_tokens"))
    pieces = written(cut.withColumn("residue", F.pmod(F.xxhash64("doc_id"), F.lit(RESIDUES)).cast("int")), "pieces")
    by = pieces.groupBy("n_tokens", "residue").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("n_tokens").orderBy("residue").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by = written(by.withColumn("before", before), "counts")
    # at most `context` rows, whatever the corpus
    counts = {r.n_tokens: r.n for r in by.groupBy("n_tokens").agg(F.sum("count").alias("n")).collect()}
    slots = plan(counts, context)
    frame = pd.DataFrame(slots, columns=["n_tokens", "lo", "hi", "bin", "per", "offset"]).astype({"n_tokens": "int32", "per": "int32", "offset": "int32"} | dict.fromkeys(("lo", "hi", "bin"), "int64"))
    ranges = docs.sparkSession.createDataFrame(frame, "n_tokens int, lo long, hi long, bin long, per int, offset int")
    within = Window.partitionBy("n_tokens", "residue").orderBy("doc_id", "piece")
    # counts are partitioned as the windows are, so this join moves no piece and broadcasts nothing that grows
    starts = by.drop("count")
    ranked = pieces.withColumn("nth", F.row_number().over(within) - 1).join(starts, ["n_tokens", "residue"]).withColumn("rank", F.col("nth") + F.col("before"))
    # the plan's rows depend on `context` alone
    placed = ranked.join(F.broadcast(ranges) if len(slots) * 48 <= BROADCAST_BYTES else ranges, "n_tokens").where("rank >= lo AND rank < hi")
    k = F.col("rank") - F.col("lo")
    return placed.select(
        (F.col("bin") + F.floor(k / F.col("per"))).alias("bin_id"),
        (F.col("offset") + k % F.col("per") * F.col("n_tokens")).cast("int").alias("slot_offset"),
        "doc_id",
        "piece",
        "start_token",
        "n_tokens",
    )
