"""Document fingerprints by winnowing: a few positioned k-gram hashes per text.

A text is cut into tokens, runs of non-blank characters of at most ``TOKEN_CHARS`` (longer runs
are cut from their start). The hashes of all ``GRAM`` consecutive tokens roll over the text; in each
window of ``WINDOW`` grams the least hash is picked, the rightmost of equal ones. So any run of
``GRAM + WINDOW - 1`` tokens that two texts share gives them a common pick, and no shared run
shorter than ``GRAM`` tokens counts. A pick is one long: a 32-bit hash above 31 bits that fall as
the position grows, so the least long of a window is its least, rightmost hash.

Only DataFrame functions, inside the row: gram hashes and window minima come from doublings of
whole arrays (pairs, fours, eights), so the work per token does not depend on the sizes.

Likeness of two texts is the Jaccard similarity of their picked hashes.

Defined cases: null text is empty; a text without tokens has no picks and the empty fingerprint;
with fewer tokens than a gram the whole sequence is one gram, with fewer grams than a window all
grams are one window; two texts without picks are alike (1), one with and one without are not (0);
repeated rows are rows of their own; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from martlib.operators.ids import number_rows
from martlib.storage import write_through

TOKEN_CHARS = 16
GRAM = 5
WINDOW = 8

_POSITION_BITS = 31
_LAST = (1 << _POSITION_BITS) - 1


def _shifted(array: str, by: int, pair) -> Column:
    """``pair`` of each element and the one ``by`` places on; empty when there is none."""
    n = F.greatest(F.size(array) - by, F.lit(0))
    return F.zip_with(F.slice(array, 1, n), F.slice(array, by + 1, n), pair)


def _doublings(df: DataFrame, array: str, length: int, pair) -> DataFrame:
    """Replaces ``array`` by ``pair`` over every ``length`` consecutive elements."""
    others = [c for c in df.columns if c != array]
    df = df.select(*others, F.col(array).alias("_1"))
    done, power = "_1", 1
    while power * 2 <= length:
        df = df.select("*", _shifted(done, power, pair).alias(f"_{power * 2}"))
        power *= 2
        done = f"_{power}"
    covered = power
    # What is left of the length, by the powers made on the way.
    while covered < length:
        part = 1 << ((length - covered).bit_length() - 1)
        n = F.greatest(F.size(done) - part, F.lit(0))
        df = df.select("*", F.zip_with(F.slice(done, 1, n), F.slice(f"_{part}", covered + 1, n), pair).alias("_more"))
        df = df.select(*[c for c in df.columns if c not in ("_more", "_done")], F.col("_more").alias("_done"))
        done, covered = "_done", covered + part
    return df.select(*others, F.col(done).alias(array))


def with_picks(df: DataFrame, text: str, picks: str, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """Adds the picks of a text column as an array of longs in text order."""
    kept = df.columns
    tokens = F.regexp_extract_all(text, F.lit(f"[^\\x20\\x09-\\x0D]{{1,{TOKEN_CHARS}}}"), F.lit(0))
    df = df.select(*kept, F.transform(F.coalesce(tokens, F.array().cast("array<string>")), lambda t: F.xxhash64(t)).alias("_h"))
    df = df.select(*kept, "_h", F.when((F.size("_h") > 0) & (F.size("_h") < gram), F.array(F.xxhash64("_h"))).alias("_short"))
    df = _doublings(df, "_h", gram, lambda a, b: F.xxhash64(a, b))
    grams = F.coalesce("_short", "_h")
    df = df.select(*kept, grams.alias("_h"))
    packed = F.transform(
        "_h", lambda h, i: F.shiftleft(F.shiftright(h, 32), _POSITION_BITS).bitwiseOR((F.lit(_LAST) - i).cast("long"))
    )
    df = df.select(*kept, packed.alias("_p"))
    few = (F.size("_p") > 0) & (F.size("_p") < window)
    df = df.select(*kept, "_p", F.when(few, F.array(F.array_min("_p"))).alias("_short"))
    df = _doublings(df, "_p", window, lambda a, b: F.least(a, b))
    return df.select(*kept, F.array_distinct(F.coalesce("_short", "_p")).alias(picks))


def hashes(picks: Column) -> Column:
    """Distinct 32-bit hashes of picks."""
    return F.array_distinct(F.transform(picks, lambda p: F.shiftright(p, _POSITION_BITS).cast("int")))


def positions(picks: Column) -> Column:
    """Numbers of the first tokens of picked grams, from 0."""
    return F.transform(picks, lambda p: (F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))).cast("int"))


def fingerprint(picks: Column) -> Column:
    """Picks as text: hash in hexadecimal and position, in text order."""

    def shown(p: Column) -> Column:
        unsigned = F.shiftright(p, _POSITION_BITS).bitwiseAND(F.lit((1 << 32) - 1))
        return F.concat(F.lower(F.hex(unsigned)), F.lit("@"), (F.lit(_LAST) - p.bitwiseAND(F.lit(_LAST))).cast("string"))

    return F.array_join(F.transform(picks, shown), " ")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two arrays of distinct hashes; 1 when both are empty."""
    both = F.size(F.array_intersect(left, right)).cast("double")
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, hashes and positions of every document."""
    made = with_picks(docs.select("doc_id", "text"), "text", "picks")
    p = F.col("picks")
    return made.select("doc_id", fingerprint(p).alias("fingerprint"), hashes(p).alias("hashes"), positions(p).alias("positions"))


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and one key for both; rows equal in both are copies of one document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("-"))
    key = F.unhex(F.sha2(F.concat(name, F.lit(":"), text), 256))
    return docs.select(key.alias("key"), "doc_id", text.alias("text"))


def _links(docs: DataFrame) -> DataFrame:
    """Per document: its place's predecessor in falling order of doc_id, and a third of that one's length.

    Nulls are last, documents of one id fall by their key; the first follows the last.
    """
    lengths = _keyed(docs).select("key", "doc_id", F.length("text").alias("n"))
    items = lengths.groupBy("key").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"))
    placed, count, _ = number_rows(write_through(items, "neighbours"), ["doc_id", "key"], "place")
    placed = write_through(placed, "neighbour-places")
    # Places rise with doc_id, so the one before in falling order is one place up.
    up = F.when(F.col("place") == count, F.lit(1).cast("long")).otherwise(F.col("place") + 1)
    before = placed.select(F.col("place").alias("above"), F.col("key").alias("before"), F.floor(F.col("n") / 3).cast("int").alias("take"))
    return placed.select("key", up.alias("above")).join(before, "above").select("key", "before", "take")


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edit, which ends with the start of the next document.

    Rows with the same id and text collapse to one before texts move. Whole texts are shuffled once;
    the other movement is a third of a text and its picked hashes, from each document to the one before.
    """
    whole = _keyed(docs).groupBy("key").agg(
        F.first(F.struct("doc_id", "text")).alias("doc"), F.count("*").alias("copies")
    )
    # The count is read here as well, so that both readings of ``whole`` are one shuffle.
    given = whole.where("copies > 0").join(_links(docs), "key")
    given = given.select("before", F.col("doc.text").alias("text"), "take")
    given = with_picks(given, "text", "picks").select(
        F.col("before").alias("key"), F.substring("text", F.lit(1), F.col("take")).alias("head"), hashes(F.col("picks")).alias("next")
    )
    rows = whole.join(given, "key").select("doc.doc_id", "doc.text", "copies", "head", "next")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    third = F.floor(F.col("n_chars") / 3).cast("int")
    # Of copies, each but the last is followed by another copy.
    real = F.struct("head", "next", F.lit(1).cast("long").alias("times"))
    own = F.struct(
        F.substring("text", F.lit(1), third).alias("head"),
        F.lit(None).cast("array<int>").alias("next"),
        (F.col("copies") - 1).alias("times"),
    )
    rows = rows.select(
        "doc_id", "text", "n_chars", F.explode(F.when(F.col("copies") == 1, F.array(real)).otherwise(F.array(real, own))).alias("ahead")
    )
    start = F.substring("text", F.lit(1), (F.col("n_chars") - third).cast("int"))
    rows = rows.select("doc_id", "text", "n_chars", "ahead.*", F.concat(start, "head").alias("edited")).drop("head")
    rows = with_picks(rows, "text", "picks").drop("text")
    rows = with_picks(rows, "edited", "edited_picks")
    rows = rows.select("*", hashes(F.col("picks")).alias("own"), hashes(F.col("edited_picks")).alias("changed"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("picks")).alias("fingerprint"),
        fingerprint(F.col("edited_picks")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("next", "own")).alias("near_next"),
        F.explode(F.sequence(F.lit(1).cast("long"), "times")).alias("copy"),
    ).drop("copy")


def op13_document_fingerprints(spark, sf_dir: str) -> DataFrame:
    return compare_with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
