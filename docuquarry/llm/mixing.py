"""Mixing sources to target weights by fitting each source's budget as a subset sum over lengths."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm.ranking import buckets_for, with_rank
from docuquarry.llm.runtime import materialize

#: Words that the dynamic programme settles at first, and at most where sums stay away from the budget.
DP_WORDS, MOST_WORDS = 60_000, 1_000_000
#: Sources are ordered and weighed on the driver, a row each; more are refused.
MAX_SOURCES = 200_000


def water_fill(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Targets in proportion to weights of share times all sizes; none over most times its size, the excess reshared."""
    total = share * sum(sizes)
    out, free = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    while free:
        w = sum(weights[i] for i in free)
        left = total - sum(out)
        over = [i for i in free if left * weights[i] / w > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = most * sizes[i]
        free = [i for i in free if i not in over]
        if abs(total - sum(out)) < 1e-9:
            break
    return out


def nearest_sum(lengths: list[int], counts: list[int], goal: int) -> tuple[int, list[int]]:
    """(sum, how many of each length): the sum nearest to goal (of two as near, the smaller one) that at most counts of each length give.

    A bounded-knapsack programme over reachable sums, bits of an integer, with counts split in powers of
    two. For each sum the part that first reached it is kept, from which the counts are read back.
    """
    top = goal + max([x for x, c in zip(lengths, counts, strict=True) if c], default=0)
    full, bits, by, parts = (1 << (top + 1)) - 1, 1, np.full(top + 1, -1, np.int32), []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        spare, n = counts[i], 1
        while lengths[i] and spare and not bits >> goal & 1:
            n = min(n, spare, top // lengths[i])
            if not n:
                break
            fresh = bits << n * lengths[i] & full & ~bits
            by[np.flatnonzero(np.unpackbits(np.frombuffer(fresh.to_bytes(top // 8 + 1, "little"), np.uint8), bitorder="little"))] = len(parts)
            parts.append((i, n))
            bits, spare, n = bits | fresh, spare - n, 2 * n
    below = (bits & ((1 << (goal + 1)) - 1)).bit_length() - 1
    above = bits >> (goal + 1)
    best = goal + (above & -above).bit_length() if above and (above & -above).bit_length() < goal - below else below
    take, left = [0] * len(lengths), best
    while left:
        i, n = parts[by[left]]
        take[i] += n
        left -= n * lengths[i]
    return best, take


def fit(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many documents of each length sum as near to budget as can be, none above its count.

    Each length first gives its proportional share. Documents of DP_WORDS words are given back, the
    shortest first, and nearest_sum settles them together with what remains. Where that misses the
    budget by more than the lengths' common divisor makes necessary, more are given back, up to
    MOST_WORDS; the sum is the best possible whenever it hits or all of the share was given back.
    """
    whole = sum(x * c for x, c in zip(lengths, counts, strict=True))
    budget = max(budget, 0)
    if budget >= whole:
        return list(counts)
    share = [c * budget // whole for c in counts]
    divisor = math.gcd(*lengths)
    least, window, best = min(budget % divisor, -budget % divisor), DP_WORDS, None
    while True:
        take = list(share)
        left = budget - sum(x * t for x, t in zip(lengths, take, strict=True))
        for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
            back = min(take[i], max(0, window - left) // lengths[i]) if lengths[i] else 0
            take[i], left = take[i] - back, left + back * lengths[i]
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if lengths[i] and take[i] < counts[i] and left - lengths[i] >= window:  # shares were rounded down
                take[i], left = take[i] + 1, left - lengths[i]
        got, extra = nearest_sum(lengths, [c - t for c, t in zip(counts, take, strict=True)], left)
        if best is None or abs(left - got) < best[0]:
            best = abs(left - got), [t + e for t, e in zip(take, extra, strict=True)]
        if best[0] <= least or not any(t for t, x in zip(take, lengths, strict=True) if x) or window >= MOST_WORDS:
            return best[1]
        window *= 4


def mix_sources(docs: DataFrame, weights: list[float], share: float = 1.5, most: float = 2.0, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row: doc_id, source, size, source_size, target, copies, taken.

    size: white-space words of the text (null and empty: 0). Sources by code point, null last, get
    weights in turn, repeating. A source's target is split in whole passes over it and a rest; the rest
    is fitted over its exact lengths by fit(), one task a source on (length, count) rows only, and the
    documents of each length are the first by md5 of seed and id. A row is taken at most ceil(most)
    times. Equal inputs give equal results; null ids count as empty; repeated rows are interchangeable
    and each have a row; an empty table gives an empty result; other columns are ignored. row is a hash
    of the text, for callers that join back. Texts are read once.
    """
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.cast("long").alias("size"), F.xxhash64(F.col(text_col)).alias("row"))
    rows = materialize(sized, "sizes").withColumns({
        "_source": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        "_h": F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary")),
    })
    histogram = materialize(rows.groupBy("_source", "size").agg(F.count("*").alias("n")), "lengths")
    per_source = histogram.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")), F.sum("n"))
    totals = [tuple(r) for r in per_source.limit(MAX_SOURCES + 1).collect()]
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r[0] == "", r[0].encode("utf-8")))
    targets = water_fill([t[1] for t in totals], [weights[i % len(weights)] for i in range(len(totals))], share, most)
    spark = docs.sparkSession
    plan = spark.createDataFrame([(s, int(size), float(t), int(n)) for (s, size, n), t in zip(totals, targets, strict=True)], "_source string, source_size long, target double, source_rows long")

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        size, target = int(pdf.source_size[0]), float(pdf.target[0])
        passes = int(target // size) if size else 0
        extra = fit(pdf["size"].tolist(), pdf.n.tolist(), round(target - passes * size))
        return pdf.assign(passes=passes, extra=extra)[["_source", "size", "source_size", "target", "passes", "extra"]]

    fitted = histogram.join(plan, "_source").groupBy("_source").applyInPandas(settle, "_source string, size long, source_size long, target double, passes int, extra long")
    nb = buckets_for(sum(t[2] for t in totals))
    rows = rows.withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0 * nb))
    ranked = with_rank(rows, ["_source", "size"], "_b", ["_h", "doc_id", "row"], "_r")
    copies = F.col("passes") + (F.col("_r") < F.col("extra")).cast("int")
    return ranked.join(fitted, ["_source", "size"]).select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row")
