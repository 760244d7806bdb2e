import numpy as np
import pytest

from martlib.llm import counts
from tests.llm.test_tokens import flat_counts


def test_files_are_read_in_ranges_without_whole_contents(spark, tmp_path, monkeypatch):
    """Spark's limit on a file's content stands for the 2 GB of one value."""
    monkeypatch.setattr(counts, "BLOCK_IDS", 3)
    monkeypatch.setattr(counts, "RANGE_BLOCKS", 2)
    rng = np.random.default_rng(3)
    files = {"a b%20.bin": rng.integers(0, 4, 41), "c.bin": rng.integers(0, 4, 12), "empty.bin": np.array([], int)}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "8")
    try:
        blocks = counts.read_flat(spark, str(tmp_path))
        assert blocks.rdd.getNumPartitions() == 7 + 2
        got = counts.count_tokens(blocks, separator=0).collect()
    finally:
        spark.conf.unset("spark.sql.sources.binaryFile.maxLength")
    by_file = {}
    for r in got:
        by_file.setdefault(r.file, set()).add((r.ordinal, r.start, r.n_tokens, r.ended))
    want = [set(flat_counts(ids.tolist(), 0)) for ids in files.values() if len(ids)]
    assert sorted(map(sorted, by_file.values())) == sorted(map(sorted, want))


def test_files_that_only_spark_can_open(spark, tmp_path, monkeypatch):
    """Large ones as fixed-length records, small ones by content, with the same result."""
    monkeypatch.setattr(counts, "BLOCK_IDS", 30)
    rng = np.random.default_rng(5)
    sizes = {"even.bin": 1200, "prime.bin": 1009, "small.bin": 41, "empty.bin": 0, "four.bin": 4}
    files = {name: rng.integers(0, 6, n) for name, n in sizes.items()}
    for name, ids in files.items():
        (tmp_path / name).write_bytes(ids.astype("<u2").tobytes())

    def refused(path):
        raise OSError("no reader")

    want = sorted(sorted(flat_counts(ids.tolist(), 0)) for ids in files.values() if len(ids))
    monkeypatch.setattr(counts, "_file_system", refused)
    for whole in (100, 0, 1 << 20):
        monkeypatch.setattr(counts, "WHOLE_BYTES", whole)
        by_file = {}
        for r in counts.count_tokens(counts.read_flat(spark, str(tmp_path)), separator=0).collect():
            by_file.setdefault(r.file, set()).add((r.ordinal, r.start, r.n_tokens, r.ended))
        assert sorted(map(sorted, by_file.values())) == want
    assert [counts.record_bytes(n * 2, 60, 2) for n in (1200, 1009, 7, 900)] == [60, 2, 14, 60]


class _Ids:
    def __init__(self, ids):
        self.ids = ids

    def document(self, text, end):
        return np.array([*self.ids, end], "<u4")


@pytest.mark.parametrize(
    "ids, width, message", [([7, 70_000], 2, "fit"), ([7, counts.SEPARATOR, 8], 4, "separator"), ([7, 70_000], 4, None)]
)
def test_ids_that_cannot_be_stored_are_errors(monkeypatch, ids, width, message):
    import pyarrow as pa

    monkeypatch.setattr(counts, "encoder_of", lambda shared, literal: _Ids(ids))
    monkeypatch.setattr(counts.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": ["x"]})
    made = counts._writer(None, width)([batch])
    if message:
        with pytest.raises(ValueError, match=message):
            list(made)
    else:
        payload = [x for b in made for x in b.column("payload").to_pylist() if x]
        assert np.frombuffer(payload[0], "<u4").tolist() == [7, 70_000, counts.SEPARATOR]
