import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from martlib.llm import manifest as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, n_chars):
    parts = []
    for v in (row[0], row[3], row[2], n_chars, row[1]):
        parts.append("-" if v is None else f"{len(str(v).encode())}:{v}")
    return h("".join(parts))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        last = out[-1]
        out.append([h("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return out


def way(levels, i):
    for level in levels[:-1]:
        j = i ^ 1
        yield (j < i, level[j] if j < len(level) else None)
        i //= 2


def by_hand(rows):
    """The contract's rows by plain loops over everything."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[4]), row))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = levels_of([x[2] for x in groups[g]])
    top = levels_of([trees[g][-1][0] for g in order])
    root, out = top[-1][0], []
    for t, g in enumerate(order):
        for i, (_, _, leaf, row) in enumerate(groups[g]):
            steps = [*way(trees[g], i), *way(top, t)]
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            n = row[4] + 1 if changed and row[4] is not None else row[4]
            at = leaf_of(row, n)
            for left, digest in steps:
                at = h(at) if digest is None else h(digest + at if left else at + digest)
            proof = h("".join(d for _, d in steps if d is not None))
            out.append((row[0], leaf, trees[g][-1][0], root, proof, at, at == root))
    return sorted(out, key=str)


def proofs(spark, rows, **sizes):
    docs = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).select(M.LEAF_COLUMNS)
    leaves = docs.select("doc_id", "lang", M.digest_of(*[F.col(c) for c in M.LEAF_COLUMNS]).alias("leaf"))
    return M.merkle_proofs(leaves, "lang", "doc_id", **sizes)


def random_rows(n, seed=1):
    r = random.Random(seed)
    rows = [(i, f"täxt {i}", r.choice(["en", "en", "de", "", None, "fr"]), "s", i) for i in range(n)]
    rows += [(5, "täxt 5", "en", "s", 5)] * 3 + [(5, "other", "en", None, None), (None, None, None, None, None)]
    rows += [(None, "", "only", "", 0)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("n, part_rows, bits", [(0, 8, 2), (40, 8, 2), (300, 32, 3), (300, 7, 1), (60, 65_536, 12)])
def test_proofs_equal_plain_trees(spark, n, part_rows, bits):
    rows = random_rows(n)
    want = [(w[0], w[1], w[2], w[3], w[4]) for w in by_hand(rows)]
    made = proofs(spark, rows, part_rows=part_rows, bits=bits)
    got = made.select("doc_id", "leaf", "subroot", "root", M.proof_digest(F.col("siblings")))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    roots = made.select(M.folded(F.col("leaf"), F.col("siblings")).alias("again"), "root").distinct().collect()
    assert len(roots) == 1 and roots[0].again == roots[0].root


def test_query_with_tampering_and_extra_columns(spark, tmp_path):
    rows = random_rows(120)
    spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == by_hand(rows)
    bad = [r for r in got if not r[-1]]
    assert bad and all(zlib.crc32(str(r[0]).encode()) % 7 == 0 for r in bad)


@pytest.mark.parametrize("rows", [[], [(1, "a", "en", "s", 1)], [(1, "a", "en", "s", 1), (2, "b", "de", "s", 1)]])
def test_few_rows(spark, tmp_path, rows):
    spark.createDataFrame([(*r, "") for r in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in M.op11_merkle_manifest(spark, str(tmp_path)).collect()), key=str)
    assert got == (by_hand(rows) if rows else [])


def test_many_groups(spark):
    rows = [(i, "t", f"l{i:03d}", "s", 1) for i in range(90)]
    got = proofs(spark, rows, part_rows=16, bits=2).select("doc_id", "root", M.proof_digest(F.col("siblings")))
    want = [(w[0], w[3], w[4]) for w in by_hand(rows)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_partition_asks_for_the_fewest_nodes():
    """Nothing that is known or can be derived is asked for, and all proofs can be made."""
    r = random.Random(3)
    for leaves in (1, 2, 5, 16, 37):
        levels = levels_of([h(str(i)) for i in range(leaves)])
        for _ in range(20):
            known = set(r.sample(range(leaves), r.randint(1, leaves)))
            asked = list(M.missing(known, 0, leaves))
            fetched = {(level, i): levels[level][i] for level, i in asked}
            made = M.derive({i: levels[0][i] for i in known}, leaves, fetched)
            assert made[-1][0] == levels[-1][0]
            for i in known:
                assert list(M.siblings(made, i, leaves)) == list(way(levels, i))
            for gone in asked:
                less = {k: v for k, v in fetched.items() if k != gone}
                with pytest.raises(KeyError):
                    some = M.derive({i: levels[0][i] for i in known}, leaves, less)
                    for i in known:
                        list(M.siblings(some, i, leaves))


def test_long_texts(spark):
    rows = [(1, "x" * 3_000_000, "en", "s", 3_000_000), (2, "é" * 500_000, "en", "s", 1)]
    got = proofs(spark, rows).select("doc_id", "leaf", "root").collect()
    assert {(r.doc_id, r.leaf, r.root) for r in got} == {(w[0], w[1], w[3]) for w in by_hand(rows)}
