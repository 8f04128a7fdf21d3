"""Best-fit packing of documents into bins (training sequences) with conflicts.

A document longer than a bin fills whole bins by itself; what remains of it is placed best-fit, longest first. Open
bins stand in a list ordered by what they have left. A search begins at the first bin that the piece fits into and goes
on to the next larger one until it finds one that has neither the piece's source nor its cluster of duplicates: the
tightest compatible bin. Bins carry both as bitmaps. Without such a bin a new one is opened.

Documents are dealt to blocks by a hash of id, length, source and cluster, and where rows repeat all four, of the copy's
number; each block is packed by itself. So no task holds more than about BLOCK documents, a hot source, id or cluster is
spread over all blocks, and bins are the same however often a task is run. The number of blocks is a power of two, the
least that keeps them within BLOCK on average: it, and so the bins of old documents, changes only when documents double.
Text stays where it is read: only id, length, source and cluster are shuffled, repeated rows as a count.

Results: a row per piece: doc_id, piece (from 0), piece_start, piece_tokens, n_tokens, bin_id, bin_tokens (all of that bin).
Length is the number of words of the text. Null or blank text makes one piece of 0 tokens, placed like any other;
null sources and null ids are values like any other; repeated rows are packed each; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE

CAPACITY = 2048
BLOCK = 4096
SCHEMA = "doc_id long, piece int, piece_start long, piece_tokens long, n_tokens long, bin_id long, bin_tokens long"


def best_fit(pieces: Iterable[tuple[int, int, int]], capacity: int) -> list[int]:
    """pieces: (tokens, source bit, cluster bit), in the order to place them. Returns each one's bin. A bit of -1 conflicts
    with nothing."""
    left: list[tuple[int, int]] = []  # (tokens left, bin), ascending
    sources: list[int] = []
    clusters: list[int] = []
    out = []
    for tokens, source, cluster in pieces:
        s, c = (1 << source if source >= 0 else 0), (1 << cluster if cluster >= 0 else 0)
        at = bisect_left(left, (tokens, -1))
        while at < len(left) and (sources[left[at][1]] & s or clusters[left[at][1]] & c):
            at += 1
        if at < len(left):
            room, b = left.pop(at)
        else:
            room, b = capacity, len(sources)
            sources.append(0)
            clusters.append(0)
        sources[b] |= s
        clusters[b] |= c
        insort(left, (room - tokens, b))
        out.append(b)
    return out


def _bits(values: pd.Series) -> np.ndarray:
    """A dense number for each value that occurs more than once, -1 for the others: they can't conflict."""
    codes = pd.factorize(values, use_na_sentinel=False)[0]
    often = np.bincount(codes)[codes] > 1
    return np.where(often, pd.factorize(np.where(often, codes, -1))[0], -1)


def pack_block(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """pdf: block, doc_id, n_tokens, source, cluster of one block."""
    pdf = pdf.sort_values(["doc_id", "n_tokens", "cluster", "source"], kind="stable", na_position="last").reset_index(drop=True)
    n = pdf["n_tokens"].to_numpy(np.int64)
    full, rest = n // capacity, n % capacity
    source, cluster = _bits(pdf["source"]), _bits(pdf["cluster"])
    order = np.lexsort((np.arange(len(n)), -rest))
    order = order[(rest[order] > 0) | (full[order] == 0)]
    bins = np.full(len(n), -1, np.int64)
    bins[order] = best_fit(zip(rest[order].tolist(), source[order].tolist(), cluster[order].tolist()), capacity)
    opened = bins.max(initial=-1) + 1
    used = np.bincount(bins[order], weights=rest[order], minlength=opened).astype(np.int64)
    row = np.repeat(np.arange(len(n)), full)  # the full bins
    nth = np.arange(len(row)) - np.repeat(np.cumsum(full) - full, full)
    base = int(pdf["block"].iloc[0]) << 40
    parts = [
        pd.DataFrame({"row": row, "piece": nth, "piece_tokens": capacity, "bin_id": base + opened + np.arange(len(row)), "bin_tokens": capacity}),
        pd.DataFrame({"row": order, "piece": full[order], "piece_tokens": rest[order], "bin_id": base + bins[order], "bin_tokens": used[bins[order]]}),
    ]
    out = pd.concat(parts, ignore_index=True)
    out["doc_id"] = pdf["doc_id"].to_numpy()[out["row"]]
    out["n_tokens"] = n[out["row"]]
    out["piece_start"] = out["piece"] * capacity
    return out[["doc_id", "piece", "piece_start", "piece_tokens", "n_tokens", "bin_id", "bin_tokens"]]


def word_count(text: Column) -> Column:
    """Words between spaces, counted as the places where one begins."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def text_cluster(text: Column) -> Column:
    """Equal for texts that differ in case and spacing only."""
    return F.xxhash64(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")))


def pack(docs: DataFrame, capacity: int = CAPACITY, block: int = BLOCK, n_tokens: Column | None = None, cluster: Column | None = None) -> DataFrame:
    """docs: doc_id, text, source. n_tokens and cluster may be given as columns over docs."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (word_count(F.col("text")) if n_tokens is None else n_tokens).cast("long").alias("n_tokens"),
        F.xxhash64(F.coalesce(F.col("source"), F.lit("\0"))).alias("source"),
        (text_cluster(F.col("text")) if cluster is None else cluster).cast("long").alias("cluster"),
    )
    blocks = 1 << max(0, -(-docs.count() // block) - 1).bit_length()
    copies = rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))
    every = copies.select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    dealt = every.withColumn("block", F.pmod(F.xxhash64(*every.columns), F.lit(blocks))).drop("copy")
    return dealt.groupBy("block").applyInPandas(lambda pdf: pack_block(pdf, capacity), SCHEMA)
