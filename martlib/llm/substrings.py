"""Substring dedup on a compacted de Bruijn graph of token k-mers.

A word is removed when a window of ``WINDOW`` consecutive words covers it whose sequence also
starts elsewhere, in the same document or another. Windows are judged on the input.

1. *Nodes.* Every window has an anchor: its least hashed run of ``NODE`` words. Equal windows
   have equal anchors at equal places, so a window can only repeat if its anchor does. About
   one word in twelve starts an anchor; those are the nodes of the graph, and the stretch
   from one anchor of a document to its next is an edge. A node's occurrences are counted
   with the least and greatest edge into and out of it, in one combining aggregate.
2. *Compaction.* Joined back to the documents, a repeated node with one edge out, followed by
   a repeated node with one edge in, makes a nonbranching step. A run of such steps is a
   compacted path: each occurrence of any node of it runs along all of it, so the path as a
   whole stands in at least two places and its words go without looking at single windows.
3. *Verification.* Windows with a repeated anchor that reach beyond their path are looked up one
   by one: their hash and that of their anchor are counted, and the source coordinates of
   those found at two places or more come back to their documents.

Copies of a text share its key, so what is known of it exists once however often it occurs.

Defined cases: null and empty texts have no words and lose none; texts of fewer than
``WINDOW`` words lose none; repeated rows repeat each other's windows; extra columns are
ignored; empty tables give empty results.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlib.llm import words as W
from martlib.storage import write_through

WINDOW = 35
NODE = 12

# The edge of a document's first node in, and of its last node out.
_NONE = 0


def _key() -> list:
    """128 bits that stand for a text."""
    return [F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), F.col("text")).alias("k2")]


def anchors_of(nodes: np.ndarray, starts: np.ndarray, span: int) -> np.ndarray:
    """For each window start, the place of the least of ``span`` node hashes, leftmost first."""
    best, place, size = nodes, np.arange(len(nodes)), 1

    def merged(best, place, shift):
        later = best[shift:] < best[:-shift]
        return np.where(later, best[shift:], best[:-shift]), np.where(later, place[shift:], place[:-shift])

    while size * 2 <= span:
        best, place = merged(best, place, size)
        size *= 2
    if span > size:
        best, place = merged(best, place, span - size)
    return place[starts]


def _edges(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, node: int) -> np.ndarray:
    """Hash of all words from anchor a to the end of anchor b, at most three node lengths on."""
    middle = np.minimum(a + node, b)
    h = W.joined(W.joined(nodes[a], nodes[middle]), W.joined(nodes[b], (b - a).astype(np.uint64)))
    far = b - a > 2 * node
    if far.any():  # the runs at a, after it and at b leave out words right before b
        h[far] = W.joined(h[far], nodes[b[far] - node])
    return np.where(h == _NONE, np.uint64(1), h)


def _noder(window: int, node: int):
    """Rows (k1, k2, pos, node, came, goes) for each anchor of each text."""

    def emit(batches):
        cache = W.WordHashes()
        for batch in batches:
            k1, k2 = batch.column("k1").to_numpy(), batch.column("k2").to_numpy()
            for first, held in W.blocks(map(W.space_words, W.texts_of(batch.column("text")))):
                at = W.starts_of(held)
                nodes = W.window_hashes(cache.of(W.flat(held)), node)
                starts = np.concatenate(
                    [np.arange(s, e - window + 1) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
                )
                if not len(starts):
                    continue
                place = np.unique(anchors_of(nodes, starts, window - node + 1))
                owner = np.searchsorted(at, place, side="right") - 1
                came = np.zeros(len(place), np.uint64)
                goes = np.zeros(len(place), np.uint64)
                same = np.flatnonzero(owner[1:] == owner[:-1])
                edge = _edges(nodes, place[same], place[same + 1], node)
                goes[same], came[same + 1] = edge, edge
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k1[first + owner]), pa.array(k2[first + owner]),
                     pa.array((place - at[owner]).astype(np.int32)), pa.array(nodes[place].view(np.int64)),
                     pa.array(came.view(np.int64)), pa.array(goes.view(np.int64))],
                    ["k1", "k2", "pos", "node", "came", "goes"],
                )

    return emit


def _lists(column: pa.ListArray, *fields: str) -> tuple:
    """Where each row's list of structs starts, and the fields of all lists end to end."""
    values = column.values
    return column.offsets.to_numpy(), *(values.field(f).to_numpy(zero_copy_only=False) for f in fields)


def _windower(window: int, node: int):
    """For each text with repeated nodes: spans known to repeat, and windows to look up."""

    def emit(batches):
        cache = W.WordHashes()
        for batch in batches:
            rows = []
            k1s, k2s = batch.column("k1").to_pylist(), batch.column("k2").to_pylist()
            at, pos, ins, outs = _lists(batch.column("known"), "pos", "one_in", "one_out")
            for i, text in enumerate(W.texts_of(batch.column("text"))):
                own_rows = slice(at[i], at[i + 1])
                h = cache.of(W.space_words(text))
                nodes = W.window_hashes(h, node)
                of_window = anchors_of(nodes, np.arange(len(h) - window + 1), window - node + 1)
                place = np.unique(of_window)
                flags = np.zeros((3, len(place)), bool)
                own = np.searchsorted(place, pos[own_rows])
                flags[0, own] = True
                flags[1, own] = ins[own_rows]
                flags[2, own] = outs[own_rows]
                again, one_in, one_out = flags
                step = again[:-1] & again[1:] & one_out[:-1] & one_in[1:]
                head = np.concatenate([[True], ~step])
                path = np.cumsum(head) - 1
                low = place[head]
                high = place[np.concatenate([~step, [True]])] + node
                index = np.searchsorted(place, of_window)
                starts = np.arange(len(of_window))
                inside = (starts >= low[path[index]]) & (starts + window <= high[path[index]])
                open_ = np.flatnonzero(again[index] & ~inside)
                long = again[head] & (high - low >= window)
                rows.append(
                    (k1s[i], k2s[i], np.stack([low[long], high[long]], 1).astype(np.int32).ravel(), open_.astype(np.int32),
                     W.window_hashes(h, window)[open_].view(np.int64), nodes[of_window[open_]].view(np.int64))
                )
            columns = list(zip(*rows)) if rows else [[]] * 6
            ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, [pa.int64(), pa.int64(), ints, ints, longs, longs])],
                ["k1", "k2", "spans", "places", "hashes", "nodes"],
            )

    return emit


def _finisher():
    def finish(batches):
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            counts, gone, spans_out, kept_text = [], [], [], []
            at, start, stop = _lists(batch.column("spans"), "start", "stop")
            for i, text in enumerate(texts):
                words = W.space_words(text)
                counts.append(len(words))
                cover = np.zeros(len(words) + 1, np.int32)
                np.add.at(cover, start[at[i] : at[i + 1]], 1)
                np.subtract.at(cover, stop[at[i] : at[i + 1]], 1)
                covered = np.cumsum(cover[:-1]) > 0
                edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])))
                gone.append(int(covered.sum()))
                spans_out.append(edges.astype(np.int32))
                if gone[-1]:
                    words = [w for w, c in zip(words, covered.tolist()) if not c]
                kept_text.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()),
                 pa.array(spans_out, pa.list_(pa.int32())),
                 pa.array([hashlib.sha256(t).hexdigest() for t in kept_text]), pa.array(kept_text, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "n_removed", "removed", "kept_sha256", "kept_text"],
            )

    return finish


def repeated_spans(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """(k1, k2, spans): for each text with repeated windows, word ranges [start, stop)."""
    if not node < window <= 3 * node:
        raise ValueError("a window must be longer than a node and at most three nodes long")
    keyed = docs.select(*_key(), "text").where("text IS NOT NULL")
    rows = keyed.mapInArrow(_noder(window, node), "k1 long, k2 long, pos int, node long, came long, goes long")
    graph = (
        rows.groupBy("node")
        .agg(
            F.count("*").alias("n"),
            *(f(c).alias(f"{c}_{f.__name__}") for c in ("came", "goes") for f in (F.min, F.max)),
        )
        .where("n > 1")
        .select(
            "node",
            ((F.col("came_min") == F.col("came_max")) & (F.col("came_min") != _NONE)).alias("one_in"),
            ((F.col("goes_min") == F.col("goes_max")) & (F.col("goes_min") != _NONE)).alias("one_out"),
        )
    )
    known = (
        rows.select("k1", "k2", "pos", "node")
        .join(graph, "node")
        .select("k1", "k2", "pos", "one_in", "one_out")
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("pos", "one_in", "one_out")).alias("known"))
    )
    found = write_through(
        keyed.join(known, ["k1", "k2"]).mapInArrow(
            _windower(window, node),
            "k1 long, k2 long, spans array<int>, places array<int>, hashes array<long>, nodes array<long>",
        ),
        "substring-windows",
    )
    windows = found.select("k1", "k2", F.explode(F.arrays_zip("places", "hashes", "nodes")).alias("w")).select(
        "k1", "k2", F.col("w.places").alias("start"), F.col("w.hashes").alias("hash"), F.col("w.nodes").alias("node")
    )
    again = windows.groupBy("hash", "node").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    single = windows.join(again, ["hash", "node"]).select(
        "k1", "k2", "start", (F.col("start") + window).alias("stop")
    )
    paths = found.where("size(spans) > 0").select(
        "k1",
        "k2",
        "spans",
        F.explode(F.sequence(F.lit(0), F.size("spans") - 2, F.lit(2))).alias("i"),
    )
    paths = paths.select("k1", "k2", F.get("spans", "i").alias("start"), F.get("spans", F.col("i") + 1).alias("stop"))
    return (
        single.unionByName(paths)
        .distinct()
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    )


def remove_repeats(docs: DataFrame, window: int = WINDOW, node: int = NODE) -> DataFrame:
    """doc_id, n_words, n_removed, removed (ranges of word places, flat), kept_sha256, kept_text."""
    spans = repeated_spans(docs, window, node)
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(), "text")
    return whole.join(spans, ["k1", "k2"], "left").mapInArrow(
        _finisher(),
        "doc_id long, n_words long, n_removed long, removed array<int>, kept_sha256 string, kept_text string",
    )


def op9_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_sha256")
