"""Hierarchical multi-length packing of tokenised documents.

1. Tasks tokenise whole documents and cut them into full windows of 1024 ids and a remainder.
   Each piece gets its checksum there and then; ids themselves are never written or moved.
   A piece is numbered among the pieces of its length in its task.
2. Remainders are routed by length to tiers of 128, 256, 512 and 1024. Only the histogram of
   lengths (1024 numbers, whatever the data) is planned: windows of the longest tier take one
   long piece each and fill their gap with the largest pieces of shorter tiers that fit;
   shorter tiers keep what fills them exactly; what is left shares windows of 1024, padded.
   A pattern of lengths is planned once with its number of copies.
3. A piece's rank within its length is its number in the task plus the pieces of that length
   in earlier tasks; rank ranges map to (sequence, offset) by the plan.
4. The sequences of a size are dealt to steps of about ``STEP_TOKENS`` ids in turn, so the
   steps of a size differ by one sequence at most.

Defined cases: null and empty texts are a single end-of-document id; repeated rows are packed
each; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlib.llm.tokens import encoder_of, shared_tokenizer
from martlib.storage import write_through

WINDOW = 1024
TIERS = (1024, 512, 256, 128)
STEP_TOKENS = 1024 * 256

_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"
)


def _cutter(shared):
    def cut(batches):
        encoder, seen = encoder_of(shared), np.zeros(WINDOW + 1, np.int64)
        part = TaskContext.get().partitionId()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = encoder.document(text)
                total = len(ids)
                for start in range(0, total, WINDOW):
                    piece = ids[start : start + WINDOW]
                    n = len(piece)
                    out.append((doc, start, n, zlib.crc32(piece), total, part, int(seen[n])))
                    seen[n] += 1
            columns = list(zip(*out)) if out else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "part", "nth"],
            )

    return cut


def plan(histogram: dict[int, int]) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, longest first; number of such sequences), from counts by length."""
    left = {n: c for n, c in histogram.items() if c and n < WINDOW}
    lengths = sorted(left)
    made = [([WINDOW], histogram[WINDOW])] if histogram.get(WINDOW) else []

    def filled(seed: int, size: int) -> list[int]:
        pattern, gap, taken = [seed], size - seed, Counter([seed])
        at = bisect_right(lengths, gap)
        while gap and at:
            n = lengths[at - 1]
            if left[n] > taken[n]:
                pattern.append(n)
                taken[n] += 1
                gap -= n
                at = min(at, bisect_right(lengths, gap))
            else:
                at -= 1
        return pattern

    def take(pattern: list[int]) -> None:
        used = Counter(pattern)
        copies = min(left[n] // t for n, t in used.items())
        for n, t in used.items():
            left[n] -= copies * t
            if not left[n]:
                lengths.remove(n)
        made.append((pattern, copies))

    def tier(low: int, high: int, size: int, exact: bool) -> None:
        for seed in [n for n in reversed(lengths) if low < n <= high]:
            while left[seed]:
                pattern = filled(seed, size)
                if exact and sum(pattern) < size:
                    break
                take(pattern)

    tier(WINDOW // 2, WINDOW, WINDOW, exact=False)
    for size in TIERS[1:]:
        tier(0 if size == TIERS[-1] else size // 2, size, size, exact=True)
    tier(0, WINDOW, WINDOW, exact=False)
    return made


def _padded(total: int) -> int:
    return total if total & (total - 1) == 0 else WINDOW


def layout(histogram: dict[int, int]) -> dict[int, tuple]:
    """For each length: arrays of first rank, pieces per sequence, first sequence, first step,
    number of steps, number in its size, size; and the offsets of each pattern's pieces."""
    patterns = plan(histogram)
    sizes = [_padded(sum(lengths)) for lengths, _ in patterns]
    per_size = Counter()
    for (_, copies), size in zip(patterns, sizes):
        per_size[size] += copies
    steps, step_base, base = {}, {}, 0
    for size in sorted(per_size, reverse=True):
        steps[size] = -(-per_size[size] * size // STEP_TOKENS)
        step_base[size], base = base, base + steps[size]
    rows: dict[int, list] = {}
    rank, number, sequence = Counter(), Counter(), 0
    for (lengths, copies), size in zip(patterns, sizes):
        offsets: dict[int, list[int]] = {}
        at = 0
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, places in offsets.items():
            rows.setdefault(n, []).append(
                (rank[n], len(places), sequence, step_base[size], steps[size], number[size], size, places)
            )
            rank[n] += copies * len(places)
        sequence += copies
        number[size] += copies
    return {n: ([np.array(c, np.int64) for c in list(zip(*r))[:7]], [x[7] for x in r]) for n, r in rows.items()}


def _placer(shared):
    def place(batches):
        known = shared.value
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            out = np.zeros((4, len(rank)), np.int64)
            for n in np.unique(length).tolist():
                own = np.flatnonzero(length == n)
                (first, each, sequence, step, steps, number, size), places = known[n]
                row = np.searchsorted(first, rank[own], side="right") - 1
                copy, slot = np.divmod(rank[own] - first[row], each[row])
                out[0, own] = sequence[row] + copy
                out[1, own] = [places[r][s] for r, s in zip(row.tolist(), slot.tolist())]
                out[2, own] = step[row] + (number[row] + copy) % steps[row]
                out[3, own] = size[row]
            columns = {c: batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")}
            for i, name in enumerate(("sequence_id", "offset", "step", "sequence_size")):
                columns[name] = pa.array(out[i])
            yield pa.RecordBatch.from_pydict(columns)

    return place


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    the step it is dealt to and the size its sequence is padded to."""
    spark = docs.sparkSession
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = write_through(whole.mapInArrow(_cutter(shared_tokenizer(spark, tokenizer)), _PIECES), "pieces")
    counted = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("earlier", F.coalesce(F.sum("n").over(before), F.lit(0)))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}
    shared = spark.sparkContext.broadcast(layout(histogram))
    ranked = pieces.join(counted.drop("n"), ["part", "length"]).withColumn("rank", F.col("nth") + F.col("earlier"))
    return ranked.mapInArrow(
        _placer(shared),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
        "sequence_id long, offset long, step long, sequence_size long",
    )


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
