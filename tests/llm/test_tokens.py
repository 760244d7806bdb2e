import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from martlib.llm import counts, packing
from martlib.llm.tokens import Encoder, default_tokenizer

TEXTS = [
    "Plain words, one after another.",
    " leading blank",
    "two  blanks and   three\n\n  lines \n end  ",
    "a \nb\t c  d",
    "it's <|endoftext|> here\n <|endoftext|>",
    "",
    None,
    "éàü 漢字 🙂 x",
    "word " * 3000,
    "same text",
    "same text",
    "Été ñandú straße, Ωmega. ДОМ! ab½ x² ʰª naïve|| don't. l'eau; \0 nul",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_tokenizer())


@pytest.fixture(scope="module")
def encoder():
    return Encoder(open(default_tokenizer(), encoding="utf-8").read())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab'sé1! \n\t  漢")), max_size=30))
def test_chunks_give_the_ids_of_the_whole_text(tokenizer, encoder, text):
    assert encoder.document(text).tolist() == ids_of(tokenizer, text)


def test_fixed_texts(tokenizer, encoder):
    for text in TEXTS:
        assert encoder.document(text).tolist() == ids_of(tokenizer, text)


def check_packing(rows, docs, tokenizer):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == {d for d, _ in docs}
    for doc, text in docs:
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(pieces[doc], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids))
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part)
            at += r.length
        assert at == len(ids)
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= 1024
        assert own[0].sequence_size == (at if at & (at - 1) == 0 else 1024)
        assert len({r.step for r in own}) == 1
        padded += own[0].sequence_size - at
    return padded


def test_packing_keeps_every_id(spark, docs_of, tokenizer):
    docs = list(enumerate(TEXTS))
    rows = packing.pack(docs_of(docs)).collect()
    check_packing(rows, docs, tokenizer)


def test_packing_pads_little(spark, docs_of, tokenizer):
    docs = [(i, "word " * (i * 37 % 1500)) for i in range(400)]
    rows = packing.pack(docs_of(docs).repartition(5)).collect()
    padded = check_packing(rows, docs, tokenizer)
    assert padded < 0.02 * sum(r.length for r in rows)


def test_packing_steps_are_even(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "STEP_TOKENS", 4096)
    rows = packing.pack(docs_of(["word " * (i * 53 % 1300) for i in range(200)])).collect()
    sizes, steps = {}, defaultdict(set)
    for r in rows:
        sizes[r.sequence_id] = (r.step, r.sequence_size)
    for sequence, (step, size) in sizes.items():
        steps[size, step].add(sequence)
    for size in {s for s, _ in steps}:
        counts_ = [len(v) for (s, _), v in steps.items() if s == size]
        assert max(counts_) - min(counts_) <= 1


def test_packing_empty_table(docs_of):
    assert packing.pack(docs_of([])).collect() == []


@given(st.dictionaries(st.integers(1, 1024), st.integers(1, 50), max_size=40))
@settings(max_examples=60, deadline=None)
def test_plan_uses_every_piece_once(histogram):
    used = defaultdict(int)
    for lengths, copies in packing.plan(histogram):
        assert sum(lengths) <= 1024 and copies > 0
        for n in lengths:
            used[n] += copies
    assert used == histogram


def flat_counts(runs, separator):
    """(ordinal, start, length, ended) of one file by a plain loop."""
    out, start = [], 0
    for at, token in enumerate(runs):
        if token == separator:
            out.append((len(out), start, at - start, True))
            start = at + 1
    if start < len(runs):
        out.append((len(out), start, len(runs) - start, False))
    return out


@pytest.mark.parametrize("span", [1024, 2])
def test_separator_scan_against_a_loop(spark, monkeypatch, span):
    monkeypatch.setattr(counts, "SPAN", span)
    rng = np.random.default_rng(5)
    files = {
        1: rng.integers(0, 4, 57), 2: np.array([9] * 20), 3: np.array([0, 0, 0]), 4: np.array([], int),
        5: np.array([1, 0]),
    }
    rows = []
    for file, ids in files.items():
        for block, at in enumerate(range(0, max(1, len(ids)), 4)):
            rows.append((file, block, bytearray(np.asarray(ids[at : at + 4], "<u2").tobytes()), "x"))
    rows.append((6, 0, None, "x"))
    blocks = spark.createDataFrame(rows, "file long, block long, payload binary, ended string")
    got = counts.count_tokens(blocks, separator=0).collect()
    want = {(f, *row) for f, ids in files.items() for row in flat_counts(ids.tolist(), 0)}
    assert {(r.file, r.ordinal, r.start, r.n_tokens, r.ended) for r in got} == want
    assert len(got) == len(want)


def test_token_counts_of_documents(spark, docs_of, tokenizer, monkeypatch):
    monkeypatch.setattr(counts, "BLOCK_IDS", 64)
    tokenizer.encode_special_tokens = True
    docs = list(enumerate(TEXTS))
    blocks, order = counts.write_flat(docs_of(docs).repartition(3))
    got = order.join(counts.count_tokens(blocks), ["file", "ordinal"]).collect()
    want = {d: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in docs}
    tokenizer.encode_special_tokens = False
    assert {r.doc_id: r.n_tokens for r in got} == want


def test_flat_files_from_disk(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(counts, "BLOCK_IDS", 3)
    ids = [5, 6, 0, 7, 0, 0, 8, 9, 9, 9, 9, 0]
    (tmp_path / "a.bin").write_bytes(np.array(ids, "<u2").tobytes())
    got = counts.count_tokens(counts.read_flat(spark, str(tmp_path)), separator=0).collect()
    assert {(r.ordinal, r.start, r.n_tokens, r.ended) for r in got} == set(flat_counts(ids, 0))


def test_token_counts_empty(spark, docs_of):
    blocks, order = counts.write_flat(docs_of([]))
    assert counts.count_tokens(blocks).collect() == [] and order.collect() == []
