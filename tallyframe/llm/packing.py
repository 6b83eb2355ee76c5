"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents and gaps are kept sorted by size and matched in bulk: a superstep takes all documents of
the next size, sweeps to their successor among the gaps (the smallest that holds them), matches the
two by rank, and puts the gaps back at their new size. As sizes are whole numbers up to the
sequence length, the sorted order is held as runs of equal sizes, at most one per length, whatever
the number of documents. Ranks within a size come from counts per task, so no sort, window or task
ever holds all documents of a size.
"""

import zlib
from collections import defaultdict

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm.shared import map_rows
from tallyframe.llm.tokens import byte_encoder
from tallyframe.session import materialise

PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"
)


def tokenise(
    documents: DataFrame, ranks_path: str, pattern: str, capacity: int, end_id: int,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut from the end into full pieces.

    ``place`` counts the pieces of the same length in the task ``part``.
    """

    def make():
        encode = byte_encoder(ranks_path, pattern, special)
        end = int(end_id).to_bytes(4, "little")
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)

        def work(batch):
            out = {name.split()[0]: [] for name in PIECES.split(", ")}
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                start, length = 0, total % capacity or capacity
                piece = 0
                while start < total:
                    row = (
                        doc_id, piece, start, length,
                        zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length],
                    )
                    for values, value in zip(out.values(), row):
                        values.append(value)
                    seen[length] += 1
                    start, length, piece = start + length, capacity, piece + 1
            return out

        return work

    return map_rows(documents.select("doc_id", F.col("text").cast("string")), PIECES, make)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Supersteps of best fit over runs of equal sizes, largest documents first.

    Returns runs (length, first rank, count, first sequence, offset): the documents of that length
    from that rank on go, one each, into consecutive sequences at the same offset. The number of
    runs depends on the capacity, not on the counts.
    """
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            gap = next((g for g in range(length, capacity + 1) if gaps[g]), None)
            if gap is None:
                gap = capacity
                fresh = max(left // (capacity // length), 1)
                gaps[gap].append((opened, fresh))
                opened += fresh
            first, held = gaps[gap].pop()
            # a gap that was taken is the smallest that still holds one, so it is filled up first
            deep = min(gap // length, left)
            taken = min(held, left // deep)
            if taken < held:
                gaps[gap].append((first + taken, held - taken))
            if gap > deep * length:
                gaps[gap - deep * length].append((first, taken))
            for level in range(deep):
                runs.append((length, rank, taken, first, capacity - gap + level * length))
                rank += taken
            left -= deep * taken
    return runs


def pack(
    documents: DataFrame,
    ranks_path: str,
    pattern: str,
    capacity: int = 1024,
    end_id: int = 2,
    special: dict[str, int] | None = None,
) -> DataFrame:
    """Pack every document into sequences of at most ``capacity`` ids; one row per piece.

    ``special`` are the strings the tokenizer turns into ids of their own inside texts.

    Only documents longer than a sequence are cut; their first piece holds what is over full ones.
    Null and empty texts are the end id alone. Repeated rows are packed once each. An empty table
    gives no rows; a null doc_id is carried as it is.
    """
    pieces = materialise(tokenise(documents, ranks_path, pattern, capacity, end_id, special))
    per_task = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = (
        Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    )
    bases = per_task.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    # At most one row per length leaves the executors.
    sizes = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()
    runs = np.array(
        sorted(best_fit({r.length: r.n for r in sizes}, capacity)), np.int64
    ).reshape(-1, 5)

    def make():
        key = (runs[:, 0] << 44) + runs[:, 1]

        def work(batch):
            rows = {name: batch[name].to_numpy() for name in ("length", "rank")}
            at = np.searchsorted(key, (rows["length"] << 44) + rows["rank"], "right") - 1
            out = {name: batch[name] for name in batch.schema.names}
            out["sequence_id"] = runs[at, 3] + rows["rank"] - runs[at, 1]
            out["offset"] = runs[at, 4]
            return out

        return work

    ranked = pieces.join(bases, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.col("place")).alias("rank"),
    )
    return map_rows(
        ranked,
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, "
        "sequence_id bigint, offset bigint",
        make,
    )
