"""Language of a document by mixture inference over character n-grams.

Learning: the letters of every training text, in lower case with runs of anything else as one
blank, are cut into byte trigrams, hashed to slots and counted per language in one
combining aggregate. The table of languages by slots is the same for any number of rows; it is
broadcast, so more than ``MAX_LANGUAGES`` language tags are an error rather than a coarser table.

Inference: a text is a bag of trigrams drawn from a mixture of languages. Expectation
maximisation finds the proportions; then languages are left out one by one, smallest
proportion first, as long as the penalised log-likelihood (``PENALTY`` log n per language)
does not fall. The prediction is the language with the largest proportion, its proportion the
score.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0, as is every
text if nothing was learned; null languages are not learned from; documents with a null id
are held out; repeated rows count each; extra columns are ignored; empty tables give empty
results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 16
MAX_LANGUAGES = 512
PENALTY = 2.0
SMOOTHING = 0.5
FOLDS = 5
UNKNOWN = "und"

# Languages a task counts at once before it hands its counts on: a bound on memory.
_HELD_LANGUAGES = 64
_ROUNDS, _CHANGE = 40, 1e-3
_PLAIN = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def slots_of(text: str, bits: int) -> np.ndarray:
    """Slot of each byte trigram of a text's letters."""
    raw = b" " + b" ".join(text.lower().encode().translate(_PLAIN).split()) + b" "
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint16)
    h = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return (h >> np.uint32(32 - bits)).astype(np.uint16)


def _counter(bits: int):
    def count(batches):
        held: dict[str, np.ndarray] = {}

        def given():
            for lang, total in held.items():
                used = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(used)), pa.array(used), pa.array(total[used])], ["lang", "slot", "n"]
                )

        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if lang not in held:
                    if len(held) == _HELD_LANGUAGES:
                        yield from given()
                        held.clear()
                    held[lang] = np.zeros(1 << bits, np.int64)
                held[lang] += np.bincount(slots_of(text, bits), minlength=1 << bits)
        yield from given()

    return count


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


class Model:
    """Trigram likelihoods by language."""

    def __init__(self, languages: list[str], bits: int, counts: np.ndarray):
        self.languages, self.bits = languages, bits
        totals = counts.sum(axis=0, keepdims=True) + SMOOTHING * counts.shape[0]
        self.likelihood = ((counts + SMOOTHING) / totals).astype(np.float32)


def learn(docs: DataFrame) -> Model:
    """Model from doc_id, text and lang of documents that are not held out."""
    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out()).select("lang", "text")
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} language tags to learn")
    counts = np.zeros((1 << BITS, len(languages)), np.int64)
    if languages:
        table = rows.mapInArrow(_counter(BITS), "lang string, slot long, n long")
        table = table.groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
        place = {lang: i for i, lang in enumerate(languages)}
        column = np.array([place[x] for x in table.column("lang").to_pylist()], np.int64)
        counts[table.column("slot").to_numpy(), column] = table.column("n").to_numpy()
    return Model(languages, BITS, counts)


def _fit(p: np.ndarray, n: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, float]:
    """Proportions and log-likelihood by expectation maximisation."""
    total = n.sum()
    for _ in range(_ROUNDS):
        each = p * share
        mixed = each.sum(axis=1)
        new = (n / mixed) @ each / total
        done = np.abs(new - share).max() < _CHANGE
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def mixture(likelihood: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(languages, proportions), largest first, chosen by penalised likelihood."""
    kinds, n = np.unique(slots, return_counts=True)
    p, n = likelihood[kinds].astype(np.float64), n.astype(np.float64)
    price = PENALTY * np.log(n.sum() + 1)
    chosen = np.arange(p.shape[1])
    share, value = _fit(p, n, np.full(len(chosen), 1 / len(chosen)))
    while len(chosen) > 1:
        rest = np.delete(np.arange(len(chosen)), share.argmin())
        start = share[rest] + 1e-9
        fewer, less = _fit(p[:, rest], n, start / start.sum())
        if less + price < value:
            break
        p, chosen, share, value = p[:, rest], chosen[rest], fewer, less
    order = np.argsort(-share, kind="stable")
    return chosen[order], share[order]


def _predictor(shared):
    def predict(batches):
        languages, bits, likelihood = shared.value
        for batch in batches:
            names, scores, sets, shares = [], [], [], []
            for text in batch.column("text").to_pylist():
                slots = slots_of(text, bits) if languages and has_letter(text) else ()
                if len(slots):
                    who, share = mixture(likelihood, slots)
                    sets.append([languages[i] for i in who.tolist()])
                    shares.append(share)
                    names.append(sets[-1][0])
                    scores.append(min(1.0, float(share[0])))
                else:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    sets.append([])
                    shares.append([])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                ["doc_id", "held_out", "lang_pred", "score", "languages", "shares"],
            )

    return predict


def predict_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and the languages found with their shares."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.bits, model.likelihood))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(
        _predictor(shared),
        "doc_id long, held_out boolean, lang_pred string, score double, languages array<string>, shares array<double>",
    )


def op8_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict_languages(docs, learn(docs))
