"""Benchmark decontamination: a broadcast set of benchmark n-grams, scanned over token windows.

Both sides are lower-cased (A-Z) and cut into words of ASCII letters, digits and characters
beyond ASCII. A window is ``n`` consecutive words of an item; an item of fewer words, but not
none, is one window by itself. Every window of a document is hashed and looked up; a hit is
verified against the words themselves, so a hash collision never counts.

The broadcast set is bounded: items are dealt into blocks of about ``BLOCK_BYTES`` of text
(one item larger than that is a block by itself), and the documents are scanned once per
block, each scan adding to the hits found before. There is no shuffle of documents at all. A
Python worker keeps the arrays of one block and uses them for all its tasks.

Defined cases: null and empty texts have no words, no hits and are not contaminated; null
items and items without words have no windows; an item whose id is null can hit words but is
not counted; repeated items count once per id; repeated documents get a row each; empty
tables give empty results, and an empty benchmark hits nothing. Columns of the input named
like an output column are replaced, all others are kept.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from martlib.llm import words as W
from martlib.storage import write_through

WINDOW = 13
# Text of benchmark items broadcast at once. A word takes two bytes at least, so a block has at
# most 8 million windows; at six bytes a word it has 2.8 million.
BLOCK_BYTES = 16 * 1024 * 1024
# A document is contaminated when at least one word in this many is hit.
SHARE = 20

# Most bits of the table that sorts out windows no item can have.
_FILTER_BITS = 22


def _squeezed(text: bytes) -> tuple[bytes, np.ndarray]:
    """(normalised words, each followed by one blank; where each word starts, and the end)."""
    raw = np.frombuffer(text.translate(W.ALNUM) + b" ", np.uint8)
    kept = raw != 32
    kept[1:] |= kept[:-1].copy()  # the blank after each word
    kept = raw[kept]
    return kept.tobytes(), np.concatenate([[0], np.flatnonzero(kept == 32) + 1])


def _hashes_of(text: bytes, at: np.ndarray) -> np.ndarray:
    """Hashes of the words, few of which are Python objects at a time."""
    cache, out = W.WordHashes(), np.empty(len(at) - 1, np.uint64)
    for i in range(0, len(out), W.BLOCK_WORDS):
        part = at[i : i + W.BLOCK_WORDS + 1].tolist()
        out[i : i + len(part) - 1] = cache.of([text[s : e - 1] for s, e in zip(part, part[1:])])
    return out


class _Windows:
    """Windows of one length: sorted hashes, the word each starts at, and bits of the hashes."""

    def __init__(self, hashes: np.ndarray, places: np.ndarray):
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.places = hashes[order], places[order]
        self.shift = np.uint64(64 - min(_FILTER_BITS, len(hashes).bit_length() + 4))
        self.maybe = np.zeros(1 << (64 - int(self.shift)), bool)
        self.maybe[self.of(self.hashes)] = True

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> self.shift).astype(np.int64)

    def find(self, hashes: np.ndarray):
        """(places among ``hashes``, first and last of the windows with that hash)."""
        at = np.flatnonzero(self.maybe[self.of(hashes)])
        low = np.searchsorted(self.hashes, hashes[at], side="left")
        high = np.searchsorted(self.hashes, hashes[at], side="right")
        known = low < high
        return at[known], low[known], high[known]


class Items:
    """Windows of a block of items by their length and hash, as arrays.

    A window takes 12 bytes, up to 32 in the bits, and a word 4 beside its text: no words or
    windows are kept as Python objects.
    """

    def __init__(self, rows: list[tuple[str | None, bytes]], n: int):
        text, starts, self.names, first, total = bytearray(), [], [], [], 0
        made: dict[int, list] = defaultdict(list)
        for item, source in rows:
            words, at = _squeezed(source)
            count = len(at) - 1
            if not count:
                continue
            k = min(n, count)
            hashes = W.window_hashes(_hashes_of(words, at), k)
            made[k].append((hashes, np.arange(total, total + len(hashes), dtype=np.uint32)))
            starts.append((at[:-1] + len(text)).astype(np.uint32))
            first.append(total)
            self.names.append(item)
            text += words
            total += count
        self.text = bytes(text)
        self.starts = np.concatenate([*starts, np.array([len(text)], np.uint32)])
        self.first = np.array(first, np.int64)
        self.windows = {}
        for k in list(made):
            hashes, places = zip(*made.pop(k))
            self.windows[k] = _Windows(np.concatenate(hashes), np.concatenate(places))

    def _same(self, k: int, places: np.ndarray, have: bytes) -> np.ndarray:
        """Which of the item windows at ``places`` are these words."""
        begin, end = self.starts[places].tolist(), self.starts[places + k].tolist()
        return np.array([self.text[s : e - 1] == have for s, e in zip(begin, end)], bool)

    def scan(self, words: list[list[bytes]], cache: W.WordHashes):
        """(hit places, ids of items) for each text of a block."""
        at = W.starts_of(words)
        flat = W.flat(words)
        hashes = cache.of(flat)
        hit = np.zeros(len(flat) + 1, np.int32)
        found: dict[int, set] = defaultdict(set)
        for k, table in self.windows.items():
            places, low, high = table.find(W.window_hashes(hashes, k))
            owner = np.searchsorted(at, places, side="right") - 1
            inside = places + k <= at[owner + 1]
            for p, o, i, j in zip(*(x[inside].tolist() for x in (places, owner, low, high))):
                starts = table.places[i:j].astype(np.int64)
                starts = starts[self._same(k, starts, b" ".join(flat[p : p + k]))]
                if len(starts):
                    hit[p] += 1
                    hit[p + k] -= 1
                    of = np.unique(np.searchsorted(self.first, starts, side="right") - 1)
                    found[o].update(self.names[x] for x in of.tolist() if self.names[x] is not None)
        places = np.flatnonzero(np.cumsum(hit[:-1]) > 0)
        owner = np.searchsorted(at, places, side="right") - 1
        edges = np.searchsorted(owner, np.arange(len(words) + 1))
        return [
            (places[edges[i] : edges[i + 1]] - at[i], found.get(i, ())) for i in range(len(words))
        ]


def _item_blocks(items: DataFrame, n: int):
    """Broadcasts, each with at most BLOCK_BYTES of item texts.

    A running total in item order deals the items to blocks. Benchmarks are small; the
    window sees ids and lengths only, and one block at a time is brought to the driver.
    """
    rows = items.select(
        F.col("item_id").cast("string").alias("item"),
        F.col("text"),
        F.xxhash64("item_id", "text").alias("h"),
        F.octet_length("text").cast("long").alias("bytes"),
    ).where("bytes > 0")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    parts = 1 + total // BLOCK_BYTES
    if parts > 1:
        sized = rows.withColumn("part", F.pmod("h", F.lit(parts)))
        order = Window.partitionBy("part").orderBy("h", "item")
        sized = sized.withColumn("part2", F.floor(F.sum("bytes").over(order) / BLOCK_BYTES))
        sized = write_through(sized, "benchmark-blocks")
        cuts = sized.select("part", "part2").distinct().collect()
        blocks = [sized.where((F.col("part") == a) & (F.col("part2") == b)) for a, b in cuts]
    else:
        blocks = [rows]
    for block in blocks:
        held = [(r[0], bytes(r[1])) for r in block.select("item", F.encode("text", "UTF-8")).collect()]
        yield items.sparkSession.sparkContext.broadcast((held, n))


def decontaminate(docs: DataFrame, items: DataFrame, n: int = WINDOW, remove: bool = False) -> DataFrame:
    """Documents with n_words, hits (places of hit words), items (ids that hit, as text).

    With ``remove`` the column clean_text holds the document's words without those hit,
    joined by blanks; it is the text itself where nothing is hit.
    """
    added = ["n_words", "hits", "items"] + (["clean_text"] if remove else [])
    out = docs.drop(*[c for c in docs.columns if c.lower() in added])
    kept = out.schema
    schema = _ddl(out, "n_words long, hits array<int>, items array<string>")
    out = out.selectExpr("*", "0L as n_words", "cast(array() as array<int>) as hits", "cast(array() as array<string>) as items")
    for number, shared in enumerate(_item_blocks(items, n)):
        if number:
            out = write_through(out, "decontaminate")
        out = out.mapInArrow(_scanner(shared), schema)
    if remove:
        out = out.mapInArrow(_remover(), _ddl(out.select(*kept.names), "n_words long, hits array<int>, items array<string>, clean_text string"))
    return out


def _ddl(df: DataFrame, extra: str):
    from pyspark.sql.types import StructType

    return StructType(df.schema.fields + StructType.fromDDL(extra).fields)


_held: list = [None, None]


def _items_of(block) -> Items:
    """The arrays of a broadcast block, made once in a worker; only the last block is kept."""
    if _held[0] is not block:
        _held[:] = [None, None]
        _held[:] = [block, Items(*block)]
    return _held[1]


def _scanner(shared):
    def scan(batches):
        known, cache = _items_of(shared.value), W.WordHashes()
        for batch in batches:
            texts = W.texts_of(batch.column("text"))
            counts, hits, items = [], [], []
            for _, held in W.blocks(map(W.alnum_words, texts)):
                for words, (places, ids) in zip(held, known.scan(held, cache)):
                    counts.append(len(words))
                    hits.append(places)
                    items.append(ids)
            old_hits, old_items = batch.column("hits").to_pylist(), batch.column("items").to_pylist()
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["n_words"] = pa.array(counts, pa.int64())
            columns["hits"] = pa.array(
                [np.union1d(a, b).astype(np.int32) if a else b for a, b in zip(old_hits, hits)], pa.list_(pa.int32())
            )
            columns["items"] = pa.array(
                [sorted({*a, *b}) for a, b in zip(old_items, items)], pa.list_(pa.string())
            )
            yield pa.RecordBatch.from_pydict(columns)

    return scan


def _remover():
    def remove(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            made = []
            for text, hits in zip(texts, batch.column("hits").to_pylist()):
                if hits:
                    gone = set(hits)
                    words = [w for i, w in enumerate(W.alnum_words(text.encode())) if i not in gone]
                    text = b" ".join(words).decode()
                made.append(text)
            columns = {name: batch.column(name) for name in batch.schema.names}
            columns["clean_text"] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return remove


def verdicts(hits: DataFrame) -> DataFrame:
    """n_hit and contaminated from what decontaminate() returns."""
    n_hit = F.size("hits").cast("long")
    return hits.withColumns(
        {"n_hit": n_hit, "contaminated": (n_hit > 0) & (n_hit * SHARE >= F.col("n_words"))}
    )


def op6_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = verdicts(decontaminate(docs, items))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
