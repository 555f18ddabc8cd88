"""Best-fit packing of documents into sequences of ``CAPACITY`` words, under conflicts.

A document longer than a sequence is cut into full sequences and a rest; rests and short documents are packed. A bin carries its
residual, a bitmap of the sources in it and one of the duplicate clusters: it takes no two documents of a
cluster and at most ``SOURCES`` different sources.  Pieces go in from the largest down; the search begins at the
bins whose residual is the piece's size and goes on to the next larger residual until a bin is compatible, so each
piece lands in the tightest compatible bin, or in a new one.

Documents are dealt to packers by hash, about ``PACKER_WORDS`` words each, so that neither memory nor time of a packer grows
with the input, and copies of one text are spread over all packers.

Null and wordless texts take no room: they are returned in no bin (bin null).  Null sources are one source.  Rows
repeated are separate pieces of one cluster, so never share a bin; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftlines.llm import common, dedup

CAPACITY = 2048
SOURCES = 8
#: Words that one packer deals with, on average.
PACKER_WORDS = 500_000


def best_fit(sizes: list[int], sources: list[int], clusters: list[int], capacity: int = CAPACITY,
             most_sources: int = SOURCES) -> tuple[list[int], list[int]]:
    """Bin and offset of each piece; sources and clusters are small numbers, sizes rise to ``capacity`` at most.

    Copies of one size come one after another; what was too tight or in conflict for one is so
    for the next, so the search goes on where it stopped.
    """
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], sources[i], i))
    at_residual: list[list[int]] = [[] for _ in range(capacity + 1)]
    filled = 0  # bit r: some bin has residual r
    residual: list[int] = []
    source_bits: list[int] = []
    cluster_bits: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    last: tuple[int, int, int] | None = None
    begin, skip = 0, 0
    for i in order:
        size, source, cluster = sizes[i], 1 << sources[i], 1 << clusters[i]
        if (size, sources[i], clusters[i]) != last:
            last, begin, skip = (size, sources[i], clusters[i]), size, 0
        chosen = -1
        rest = filled >> begin
        while rest:
            here = begin + (rest & -rest).bit_length() - 1
            row = at_residual[here]
            for k in range(skip if here == begin else 0, len(row)):
                b = row[k]
                if not cluster_bits[b] & cluster and (source_bits[b] | source).bit_count() <= most_sources:
                    chosen = b
                    break
            if chosen >= 0:
                begin, skip = here, k
                del row[k]
                if not row:
                    filled ^= 1 << here
                break
            rest = filled >> (here + 1)
            begin, skip = here + 1, 0
        if chosen < 0:
            chosen = len(residual)
            residual.append(capacity)
            source_bits.append(0)
            cluster_bits.append(0)
            begin, skip = capacity + 1, 0  # no bin takes the next copy either
        bins[i], offsets[i] = chosen, capacity - residual[chosen]
        residual[chosen] -= size
        source_bits[chosen] |= source
        cluster_bits[chosen] |= cluster
        left = residual[chosen]
        if left:
            at_residual[left].append(chosen)
            filled |= 1 << left
    return bins, offsets


def _packer(capacity: int, most_sources: int):
    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["piece_size", "cluster", "doc_id", "piece"], kind="stable", na_position="last")
        sources, clusters = pd.factorize(rows["source"], use_na_sentinel=False)[0], pd.factorize(rows["cluster"])[0]
        bins, offsets = best_fit(rows["piece_size"].tolist(), sources.tolist(), clusters.tolist(), capacity, most_sources)
        return pd.DataFrame({
            "doc_id": rows["doc_id"], "source": rows["source"], "cluster": rows["cluster"], "piece": rows["piece"],
            "piece_size": rows["piece_size"], "packer": np.int32(key[0]), "bin": np.array(bins, np.int64),
            "bin_offset": np.array(offsets, np.int32)})

    return pack


def cluster_of(text: Column) -> Column:
    """Copies (equal but for white space and the case of A-Z) are one cluster."""
    lower = F.translate(dedup.normal_text(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(lower)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         capacity: int = CAPACITY, most_sources: int = SOURCES, packer_words: int = PACKER_WORDS) -> DataFrame:
    """(doc_id, source, cluster, piece, piece_size, packer, bin, bin_offset), one row per piece.

    ``bin`` counts within its packer; a full sequence of a long document has a bin of its own.
    """
    rows = common.table(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        cluster_of(F.col(text_col)).alias("cluster"), common.words(F.col(text_col)).alias("size"),
        F.xxhash64(*docs.columns).alias("content")))
    packers = int((rows.agg(F.sum("size")).first()[0] or 0) // packer_words) + 1
    dealt = rows.withColumn("packer", F.pmod(F.xxhash64("doc_id", "content"), F.lit(packers)).cast("int"))
    last = F.floor((F.col("size") - 1) / capacity).cast("int")
    pieces = dealt.where("size > 0").select(
        "doc_id", "source", "cluster", F.explode(F.sequence(F.lit(0), last)).alias("piece"), "size", "packer").select(
        "doc_id", "source", "cluster", "piece", "packer",
        F.least(F.lit(capacity), F.col("size") - F.col("piece").cast("long") * capacity).cast("int").alias("piece_size"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = pieces.groupBy("packer").applyInPandas(
        _packer(capacity, most_sources),
        f"doc_id {kind}, source string, cluster long, piece int, piece_size int, packer int, bin long, bin_offset int")
    empty = dealt.where("size = 0").select(
        "doc_id", "source", "cluster", F.lit(0), F.lit(0), "packer", F.lit(None).cast("long"), F.lit(None).cast("int"))
    return packed.union(empty)
