"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

**Sketch.** ``COORDINATES`` bins are filled in rounds. In each of the first COORDINATES rounds
every shingle is thrown into one hashed bin with a hashed value, and a bin keeps the least
value of the first round that reached it; the COORDINATES rounds after those throw all
shingles into one fixed bin each, so every coordinate fills for any non-empty set. Filling
stops as soon as all bins are full: about t log t throws for small sets, one or two rounds for
large ones. Coordinates agree with probability J (Jaccard), and their number of agreements
is concentrated as that of independent ones.

**Banding.** ``BANDS`` bands of ``ROWS`` coordinates. A pair at the threshold 0.8 shares no
band with probability (1 - 0.8^7)^48, about 1 in 80,000; more similar pairs far less often.

**Verification.** Documents with the same shingle set form a class first (128-bit set
fingerprint), so copies meet once. In each bucket the members are compared with the bucket's
center, the member that meets most others; connected components of the confirmed links leave most buckets with one
component. Where several are left, members of different components are compared, but only
those that share one of their rarest shingles, as all similar sets must (prefix filter). So a bucket of n near copies costs about n comparisons, not n^2, and no link
between components is lost. Every link is confirmed on the full shingle sets of the whole texts.

Defined cases: null and empty texts (and those without words) have an empty set, are linked
with nothing and are their own component. Rows that repeat a doc_id with the same words
count as copies; a null doc_id has a null component_id, is linked with nothing and is kept.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from martlib.llm import words as W
from martlib.llm.components import components
from martlib.storage import write_through

COORDINATES = 336
BANDS = 48
ROWS = 7
THRESHOLD_PCT = 80
# Slots in which shingles are counted to tell rare from frequent (2 MB, whatever the data).
SLOT_BITS = 18

_SIG = (
    "doc_id long, n_shingles long, c1 long, c2 long, bands array<long>"
)


def shingle_hashes(words: list[bytes], hashes: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of k-word shingles; fewer words are one shingle."""
    if not len(hashes):
        return hashes
    return np.unique(W.window_hashes(hashes, min(k, len(hashes))))


def sketch(shingles: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """Fast similarity sketch of a non-empty set of 64-bit hashes."""
    full = np.iinfo(np.uint64).max
    bins = np.full(t, full, np.uint64)
    low = np.uint64(0xFFFFFFFF)
    shift = np.uint64(32)
    for r in range(2 * t):
        # Bin from the high half of a fresh hash, value from its low half; the round number
        # stands above the value, so an earlier round always wins.
        h = W.mix(shingles + np.uint64((r + 1) * 0x9E3779B97F4A7C15 % 2**64))
        value = (h & low) | (np.uint64(r) << shift)
        if r < t:
            place = (((h >> shift) * np.uint64(t)) >> shift).astype(np.int64)
            np.minimum.at(bins, place, value)
        else:
            bins[r - t] = min(bins[r - t], value.min())
        if bins.max() != full:
            return bins
    return bins


def band_keys(bins: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    parts = bins[: bands * rows].reshape(bands, rows)
    key = W.mix(np.arange(1, bands + 1, dtype=np.uint64))
    for j in range(rows):
        key = W.joined(key, W.mix(parts[:, j]))
    return key.view(np.int64)


def _signer(k: int):
    def sign(batches):
        cache = W.WordHashes()
        for batch in batches:
            ids = batch.column("doc_id")
            texts = W.texts_of(batch.column("text"))
            sizes, one, two, bands = [], [], [], []
            for text in texts:
                words = W.space_words(text, lower=True)
                shingles = shingle_hashes(words, cache.of(words), k)
                sizes.append(len(shingles))
                if len(shingles):
                    digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
                    one.append((digest >> 64) - 2**63)
                    two.append((digest & (2**64 - 1)) - 2**63)
                    bands.append(band_keys(sketch(shingles)))
                else:
                    one.append(0)
                    two.append(0)
                    bands.append(None)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(sizes, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()),
                 pa.array(bands, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "c1", "c2", "bands"],
            )

    return sign


def _verifier(k: int):
    def verify(batches):
        cache = W.WordHashes()
        last: dict[str, tuple] = {}

        def shingles_of(side: str, text: bytes) -> np.ndarray:
            if side not in last or last[side][0] != text:
                words = W.space_words(text, lower=True)
                last[side] = (text, shingle_hashes(words, cache.of(words), k))
            return last[side][1]

        for batch in batches:
            keep = []
            for a, b in zip(W.texts_of(batch.column("text_a")), W.texts_of(batch.column("text_b"))):
                one, two = shingles_of("a", a), shingles_of("b", b)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= THRESHOLD_PCT * (len(one) + len(two) - common) and common > 0)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(mask)

    return verify


def _links(pairs: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets are similar enough, as a written table."""
    a = texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a"), F.col("n").alias("n_a"))
    b = texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b"), F.col("n").alias("n_b"))
    # Sets whose sizes differ too much cannot be similar: no text of such a pair is moved.
    fits = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * THRESHOLD_PCT
    sizes = pairs.join(a.select("a", "n_a"), "a").join(b.select("b", "n_b"), "b").where(fits)
    both = sizes.select("a", "b").distinct().join(a.drop("n_a"), "a").join(b.drop("n_b"), "b")
    return write_through(both.mapInArrow(_verifier(k), "a long, b long"), "neardup-links")


def _slots(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _counter(k: int):
    """Rows (slot, n): how many shingles of these texts fall into each slot."""

    def count(batches):
        cache, total = W.WordHashes(), np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for text in W.texts_of(batch.column("text")):
                words = W.space_words(text, lower=True)
                np.add.at(total, _slots(shingle_hashes(words, cache.of(words), k)), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["slot", "n"])

    return count


def _prefixer(k: int, shared):
    """Rows (key, rep, comp, n, v): the rarest shingles of a set, one of which any set that is
    similar enough must have among its own rarest; v counts the shingles from this one on."""

    def prefix(batches):
        cache, frequency = W.WordHashes(), shared.value
        for batch in batches:
            reps, comps = batch.column("rep").to_numpy(), batch.column("comp").to_numpy()
            for i, text in enumerate(W.texts_of(batch.column("text"))):
                words = W.space_words(text, lower=True)
                shingles = shingle_hashes(words, cache.of(words), k)
                n = len(shingles)
                first = shingles[np.lexsort((shingles, frequency[_slots(shingles)]))][: n + (-n * THRESHOLD_PCT) // 100 + 1]
                size = len(first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(first.view(np.int64)), pa.array(np.full(size, reps[i])), pa.array(np.full(size, comps[i])),
                     pa.array(np.full(size, n)), pa.array(n - np.arange(size))],
                    ["key", "rep", "comp", "n", "v"],
                )

    return prefix


def _across(placed: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """Pairs (a, b) of different components that could be similar.

    All shingles stand in one order, rare ones first; the order is by the counts of hashed
    slots, whose number is fixed. Similar sets share one of their rarest fifth, and at its
    place each still has as many shingles as both must have in common. Sizes for which that
    fails are ruled out per shingle before any member is paired.
    """
    spark = placed.sparkSession
    known = write_through(
        placed.select("rep", "comp").distinct().join(texts.select("rep", "text"), "rep"), "neardup-apart-texts"
    )
    table = known.mapInArrow(_counter(k), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(1 << SLOT_BITS, np.int64)
    frequency[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    shared = spark.sparkContext.broadcast(frequency)
    members = write_through(
        known.mapInArrow(_prefixer(k, shared), "key long, rep long, comp long, n long, v long"), "neardup-members"
    )
    enough = lambda v, n, m: F.col(v) * (100 + THRESHOLD_PCT) >= (F.col(n) + F.col(m)) * THRESHOLD_PCT
    sizes = members.groupBy("key", F.col("n").alias("m")).agg(
        F.max("v").alias("w"), F.min("comp").alias("low"), F.max("comp").alias("high")
    )
    left = (
        members.select("key", F.col("rep").alias("x"), F.col("comp").alias("cx"), "n", "v")
        .join(sizes, "key")
        .where(enough("v", "n", "m") & enough("w", "n", "m") & ((F.col("low") != F.col("cx")) | (F.col("high") != F.col("cx"))))
        .select("key", "x", "cx", "n", "m")
    )
    right = members.select("key", F.col("rep").alias("y"), F.col("comp").alias("cy"), F.col("n").alias("m"), F.col("v").alias("w"))
    return (
        left.join(right, ["key", "m"])
        .where((F.col("cx") < F.col("cy")) & enough("w", "n", "m"))
        .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        .distinct()
    )


def near_duplicates(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = write_through(whole.mapInArrow(_signer(k), _SIG), "neardup-sketches")
    nodes = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = nodes.groupBy("c1", "c2", "n_shingles").agg(F.min("doc_id").alias("rep"))
    classes = write_through(classes, "neardup-classes")

    # Buckets: representatives only, and only buckets in which two of them meet.
    member = (
        nodes.join(
            classes.withColumnRenamed("rep", "doc_id"), ["c1", "c2", "n_shingles", "doc_id"], "left_semi"
        ).select(F.col("doc_id").alias("rep"), F.explode("bands").alias("key"))
    )
    meeting = member.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    met = write_through(member.join(meeting, "key"), "neardup-buckets")
    # The center of a bucket is the member that meets most others in all its buckets.
    degree = met.groupBy("rep").agg(F.sum("size").alias("degree"))
    ranked = met.join(degree, "rep").select("key", "rep", F.struct(-F.col("degree"), F.col("rep").alias("r")).alias("rank"))
    centers = ranked.groupBy("key").agg(F.min("rank").alias("best")).select("key", F.col("best.r").alias("center"))
    buckets = write_through(met.select("key", "rep").join(centers, "key"), "neardup-centers")
    ids = buckets.select("rep").distinct()
    texts = write_through(
        whole.withColumnRenamed("doc_id", "rep")
        .join(ids, "rep", "left_semi")
        .join(classes.select("rep", F.col("n_shingles").alias("n")), "rep")
        .select("rep", "n", "text"),
        "neardup-texts",
    )

    # First each member against its bucket's center, then across what is left apart.
    stars = (
        buckets.where("rep <> center")
        .select(F.least("center", "rep").alias("a"), F.greatest("center", "rep").alias("b"))
        .distinct()
    )
    links = _links(stars, texts, k)
    joined = components(links, "a", "b")
    placed = buckets.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "key", "rep", F.coalesce("component", "rep").alias("comp")
    )
    apart = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    placed = write_through(placed.join(apart.select("key"), "key"), "neardup-apart")
    cross = _across(placed, texts, k).join(stars, ["a", "b"], "left_anti")
    links = links.unionByName(_links(cross, texts, k))
    joined = components(links, "a", "b")

    of_class = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").select(
        "c1", "c2", "n_shingles", F.coalesce("component", "rep").alias("class_component")
    )
    linked = (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull()
    return (
        signed.select("doc_id", "n_shingles", "c1", "c2")
        .join(of_class, ["c1", "c2", "n_shingles"], "left")
        .withColumn("component_id", F.when(linked, F.col("class_component")).otherwise(F.col("doc_id")))
        .select(
            "doc_id",
            "n_shingles",
            "component_id",
            F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"),
        )
    )


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4)
