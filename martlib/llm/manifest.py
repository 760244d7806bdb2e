"""Merkle manifest of a dataset with a proof for every row, made by octopus multiproofs.

Leaves are SHA-256 digests of the rows. Per group (language) they stand in order and every two
consecutive nodes become one until a single node, the group's root, remains; the groups' roots
in order give the dataset's root the same way. A node is named by (tree, level, index); tree is
the group's number, ``TOP`` the tree of groups. A node that is last and alone is hashed alone.

Leaves are numbered without a global window (:func:`number_rows`) and cut into aligned runs of
``2 ** RUN_BITS`` leaves, whose heights the trees climb a run of nodes at a time: the first round hashes
runs of leaves, the next runs of their roots, and so on, so three rounds reach 10^10 leaves. For the
proofs, leaf partitions are consecutive whole runs of about ``PART_ROWS`` leaves. A partition
lists the coordinates of all siblings on the way from its leaves to the root that its own leaves
cannot derive (the minimal union), fetches just these nodes by one join, derives all shared
interior nodes itself and expands one proof per leaf. No task holds more than one partition or
run; only counts reach the driver. Texts are read once and never shuffled.

Defined cases: null values are hashed as ``-``; a null group is first and distinct from an empty
string; null order values stand first; rows with the same order value stand by their digest, and
equal rows are leaves of their own; a single leaf is its group's root, a single group's root the
dataset's; an empty table has no rows and no root; columns that are not hashed are ignored.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from martlib.operators.ids import mark_ties, number_rows
from martlib.storage import write_through

# Leaves (or nodes) per run, as a power of two, and leaves per partition of the proofs.
RUN_BITS = 12
PART_ROWS = 65_536
TOP = -1

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]

_NODE = "tree long, level int, idx long, digest string"
_STEP = pa.struct([("left", pa.bool_()), ("digest", pa.string())])
_STEPS = "array<struct<left:boolean,digest:string>>"


def digest_of(*values: Column) -> Column:
    """SHA-256 of values, each as its UTF-8 byte count, a colon and itself; ``-`` for null."""

    def framed(value: Column) -> Column:
        text = value.cast("string")
        size = F.octet_length(text).cast("string")
        return F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*[framed(v) for v in values]), 256)


def node(*children: str) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def width(leaves: int, level: int) -> int:
    """Nodes of a level over so many leaves."""
    return -(-leaves >> level)


def _height(leaves: int) -> int:
    return max(0, (leaves - 1).bit_length())


def climb(digests: list[str], level: int, leaves: int, bits: int):
    """Levels above a run of nodes, up to ``bits`` of them or to the root."""
    for up in range(level + 1, min(level + bits, _height(leaves)) + 1):
        digests = [node(*digests[i : i + 2]) for i in range(0, len(digests), 2)]
        yield up, digests


def _climb_run(level: int, bits: int, only_last: bool):
    def run(key, table):
        table = table.sort_by("idx")
        tree, leaves, at = (table.column(c)[0].as_py() for c in ("tree", "leaves", "idx"))
        levels = list(climb(table.column("digest").to_pylist(), level, leaves, bits))
        rows = []
        for up, digests in levels[-1:] if only_last else levels:
            rows += [(tree, up, (at >> (up - level)) + i, d) for i, d in enumerate(digests)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["tree", "level", "idx", "digest"])

    return run


def tree_nodes(leaves: DataFrame, only_runs: bool, bits: int = RUN_BITS) -> DataFrame:
    """Nodes (tree, level, idx, digest) above (tree, idx, digest, leaves), written.

    ``only_runs`` leaves out the leaves and what lies inside their runs.
    """
    most = leaves.agg(F.max("leaves")).first()[0] or 0
    parts, level = [], 0
    sizes = leaves.groupBy("tree").agg(F.max("leaves").alias("leaves"))
    current = leaves.select("tree", "idx", "digest", "leaves")
    lone = leaves.where("leaves = 1") if only_runs else leaves
    parts.append(lone.select("tree", F.lit(0).alias("level"), "idx", "digest"))
    while width(most, level) > 1:
        runs = current.groupBy("tree", F.shiftright("idx", bits).alias("run"))
        made = runs.applyInArrow(_climb_run(level, bits, only_runs and level == 0), _NODE)
        made = write_through(made, "merkle-nodes")
        parts.append(made)
        level += bits
        current = made.where(F.col("level") == level).join(sizes, "tree").where(F.col("leaves") > 1 << level)
        current = current.select("tree", "idx", "digest", "leaves")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def missing(known: set[int], level: int, leaves: int):
    """Octopus: (level, idx) of the fewest nodes that lead from known ones to the root."""
    while width(leaves, level) > 1:
        last = width(leaves, level)
        for i in sorted({k ^ 1 for k in known} - known):
            if i < last:
                yield level, i
        known = {k >> 1 for k in known}
        level += 1


_COORDINATES = "part long, tree long, level int, idx long"


def _wanted(groups: int, bits: int):
    def run(key, table):
        part, runs = key[0].as_py(), {}
        for tree, run_, leaves in zip(*(table.column(c).to_pylist() for c in ("tree", "run", "leaves"))):
            runs.setdefault((tree, leaves), set()).add(run_)
        rows = []
        for (tree, leaves), known in runs.items():
            if leaves > 1 << bits:
                rows += [(part, tree, level, i) for level, i in missing(known, bits, leaves)]
        rows += [(part, TOP, level, i) for level, i in missing({t for t, _ in runs}, 0, groups)]
        columns = list(zip(*rows)) or [(), (), (), ()]
        types = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        return pa.table([pa.array(c, t) for c, t in zip(columns, types)], ["part", "tree", "level", "idx"])

    return run


def derive(known: dict[int, str], leaves: int, fetched: dict[tuple[int, int], str]) -> list[dict[int, str]]:
    """All levels from the leaves to the root, from a partition's leaves and fetched nodes."""
    by_level: dict[int, dict[int, str]] = {}
    for (level, i), digest in fetched.items():
        by_level.setdefault(level, {})[i] = digest
    levels = [known]
    for level in range(_height(leaves)):
        here = levels[level]
        here.update(by_level.get(level, {}))
        last = width(leaves, level)
        above = {}
        for i in sorted({k >> 1 for k in here}):
            left, right = here.get(2 * i), here.get(2 * i + 1)
            if left is not None and (right is not None or 2 * i + 1 >= last):
                above[i] = node(left, right) if right is not None else node(left)
        levels.append(above)
    return levels


def siblings(levels: list[dict[int, str]], index: int, leaves: int):
    """(whether it stands left, digest or None when there is none) from leaf to root."""
    for level in range(len(levels) - 1):
        other = index ^ 1
        yield other < index, levels[level][other] if other < width(leaves, level) else None
        index >>= 1


def _expand(groups: int, schema: pa.Schema):
    def run(key, rows, nodes):
        fetched: dict[int, dict] = {}
        for tree, level, i, digest in zip(*(nodes.column(c).to_pylist() for c in ("tree", "level", "idx", "digest"))):
            fetched.setdefault(tree, {})[level, i] = digest
        own: dict[tuple[int, int], dict[int, str]] = {}
        places = list(zip(*(rows.column(c).to_pylist() for c in ("tree", "leaves", "idx", "leaf"))))
        for tree, leaves, i, leaf in places:
            own.setdefault((tree, leaves), {})[i] = leaf
        trees = {t: derive(known, n, fetched.get(t, {})) for (t, n), known in own.items()}
        top = derive({t: levels[-1][0] for t, levels in trees.items()}, groups, fetched.get(TOP, {}))
        root = top[-1][0]
        above = {t: list(siblings(top, t, groups)) for t in trees}
        left, digests, offsets = [], [], [0]
        for tree, leaves, i, _ in places:
            for side, digest in [*siblings(trees[tree], i, leaves), *above[tree]]:
                left.append(side)
                digests.append(digest)
            offsets.append(len(digests))
        steps = pa.StructArray.from_arrays([pa.array(left, pa.bool_()), pa.array(digests, pa.string())], fields=list(_STEP))
        made = {
            "subroot": pa.array([trees[t][-1][0] for t, *_ in places], pa.string()),
            "root": pa.array([root] * len(places), pa.string()),
            "siblings": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), steps),
        }
        return pa.table([made[f.name] if f.name in made else rows.column(f.name) for f in schema], schema.names)

    return run


def merkle_proofs(
    leaves: DataFrame, group: str, order: str, part_rows: int = PART_ROWS, bits: int = RUN_BITS
) -> DataFrame:
    """Adds subroot, root and siblings to a table of (group, order, leaf, anything to carry along).

    ``siblings`` goes from the leaf to the root: whether the other node stands left, and its
    digest, null where a node is hashed alone.
    """
    spark = leaves.sparkSession
    kept = leaves.columns
    stored = write_through(leaves, "merkle-leaves")
    parts = max(1, math.ceil(stored.count() / part_rows))
    numbered, _, _ = number_rows(mark_ties(stored), [group, order, "leaf"], "place", partitions=parts)
    numbered = write_through(numbered, "merkle-order")

    trees = numbered.groupBy(group).agg((F.min("place") - 1).alias("start"), F.count("*").alias("leaves"))
    trees, groups, _ = number_rows(trees, ["start"], "tree", start=-1, partitions=1)
    trees = write_through(trees.withColumnRenamed(group, "of"), "merkle-groups")
    groups += 1
    rows = numbered.join(trees, F.col(group).eqNullSafe(F.col("of"))).select(
        *kept, "tree", "leaves", (F.col("place") - 1 - F.col("start")).alias("idx"), "start"
    )
    # A run belongs to the partition in which it starts.
    start = F.col("start") + F.shiftleft(F.shiftright("idx", bits), bits)
    rows = rows.withColumn("part", F.floor(start / part_rows)).drop("start")

    nodes = tree_nodes(rows.select("tree", "idx", F.col("leaf").alias("digest"), "leaves"), True, bits)
    roots = nodes.join(trees.select("tree", "leaves"), "tree").where("idx = 0")
    is_root = F.col("level") == F.length(F.conv(F.col("leaves").cast("string"), 10, 2)) - F.when(
        F.expr("leaves & (leaves - 1)") == 0, 1
    ).otherwise(0)
    subroots = roots.where(is_root).select(
        F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), "digest", F.lit(groups).cast("long").alias("leaves")
    )
    top = tree_nodes(write_through(subroots, "merkle-subroots"), False, bits)

    runs = rows.select("part", "tree", F.shiftright("idx", bits).alias("run"), "leaves").distinct()
    wanted = runs.groupBy("part").applyInArrow(_wanted(groups, bits), _COORDINATES)
    fetched = wanted.join(nodes.unionByName(top), ["tree", "level", "idx"])

    fields = [rows.schema[c] for c in kept]
    schema = T.StructType([*fields, *T.StructType.fromDDL(f"subroot string, root string, siblings {_STEPS}").fields])
    from pyspark.sql.pandas.types import to_arrow_schema

    expand = _expand(groups, to_arrow_schema(schema))
    return rows.groupBy("part").cogroup(fetched.groupBy("part")).applyInArrow(expand, schema)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(
        steps,
        leaf,
        lambda a, s: F.sha2(
            F.when(s["digest"].isNull(), a)
            .when(s["left"], F.concat(s["digest"], a))
            .otherwise(F.concat(a, s["digest"])),
            256,
        ),
    )


def proof_digest(steps: Column) -> Column:
    found = F.transform(F.filter(steps, lambda s: s["digest"].isNotNull()), lambda s: s["digest"])
    return F.sha2(F.array_join(found, ""), 256)


def op11_merkle_manifest(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(LEAF_COLUMNS)
    changed = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    n_chars = F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    tampered = [n_chars if c == "n_chars" else F.col(c) for c in LEAF_COLUMNS]
    leaves = docs.select(
        "doc_id",
        "lang",
        digest_of(*[F.col(c) for c in LEAF_COLUMNS]).alias("leaf"),
        digest_of(*tampered).alias("presented"),
    )
    proofs = merkle_proofs(leaves, "lang", "doc_id")
    again = folded(F.col("presented"), F.col("siblings"))
    return proofs.select(
        "doc_id", "leaf", "subroot", "root", proof_digest(F.col("siblings")).alias("proof_sha256"), again.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
