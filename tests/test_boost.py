"""Batched boosting against a plain loop, across blocks, and its stored trees against DuckDB."""

from datetime import timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from martlib.operators import boost as B
from martlib.operators import model as M
from martlib.operators import panel as P
from martlib.storage import write_through

from test_panel import SCHEMA, START, series

PARAMS = [
    M.GbtParams(trees=6, depth=3, rate=0.3, bins=16),
    M.GbtParams(trees=4, depth=2, rate=0.5, row_share=0.6, column_share=0.5, l1=2.0, l2=3.0, bins=16),
    M.GbtParams(trees=3, depth=4, row_share=1.0, column_share=1.0, l1=0.0, l2=0.0, min_rows=9, bins=16),
]


@pytest.fixture(scope="module")
def train(spark):
    rows = series("ASIA", "Retail", 56, 10) + series("USA", "Shopify", 56, 40)
    rows += series("EUROPE", "Retail", 40, 70) + series("USA", "Retail", 53, 5)
    made = P.engineer_features(spark.createDataFrame(rows, SCHEMA))
    return write_through(made, "boost-train")


def plain(frame, keys, layout, p):
    """Trees as nested tuples, with every split tried row by row."""
    x = {c: frame[c].to_numpy(float) for c in P.BASE_FEATURES}
    tries = [(n, P.BASE_FEATURES[n], e, x[P.BASE_FEATURES[n]] >= e) for n in range(len(x)) for e in layout.edges[n]]
    feature = len(x)
    for c, names in zip(P.SERIES, layout.names):
        for name in names[1:]:
            tries.append((feature, f"{c}_{name}", name, (frame[c] == name).to_numpy()))
            feature += 1
    y, score, trees = frame[P.TARGET].to_numpy(), np.full(len(frame), layout.mean), []

    def soft(g):
        return np.sign(g) * max(abs(g) - p.l1, 0)

    for number in range(p.trees):
        used = B.drawn_rows(keys, p.seed, number, p.row_share)
        allowed = B.drawn_features(feature, p.seed, number, p.column_share)
        g = y - score

        def build(inside, depth):
            rows = inside & used
            total, count = g[rows].sum(), rows.sum()
            base, best = soft(total) ** 2 / (count + p.l2), None
            for f, name, limit, right in tries if depth < p.depth else []:
                a, b = rows & ~right, rows & right
                if not allowed[f] or min(a.sum(), b.sum()) < p.min_rows:
                    continue
                gain = sum(soft(g[s].sum()) ** 2 / (s.sum() + p.l2) for s in (a, b)) - base
                if gain > B.LEAST_GAIN and (best is None or gain > best[0] * (1 + B.TIE)):
                    best = gain, name, limit, right
            if best is None:
                value = p.rate * soft(total) / (count + p.l2)
                score[inside] += value
                return value
            gain, name, limit, right = best
            return name, limit, gain, build(inside & ~right, depth + 1), build(inside & right, depth + 1)

        trees.append(build(np.ones(len(y), bool), 0))
    return trees, score


def nested(model, tree):
    """A stored tree in the shape of the plain one."""
    nodes = {n[1]: n for n in model.nodes if n[0] == tree}

    def at(i):
        _, _, feature, _, is_category, threshold, category, gain, _, value = nodes[i]
        if feature is None:
            return value
        return feature, category if is_category else threshold, gain, at(2 * i + 1), at(2 * i + 2)

    return at(0)


def same(a, b):
    if isinstance(a, tuple) and isinstance(b, tuple):
        return a[:2] == b[:2] and a[2] == pytest.approx(b[2], rel=1e-6) and same(a[3], b[3]) and same(a[4], b[4])
    return a == pytest.approx(b, rel=1e-6, abs=1e-9)


@pytest.mark.parametrize("p", PARAMS)
def test_equals_a_plain_loop(train, p):
    frame = train.withColumn("key", B._key(M.TABLE)).toPandas()
    layout = B.layout_of(train, M.TABLE, B.Fold(), p.bins)
    trees, score = plain(frame, frame.key.to_numpy(np.int64).view(np.uint64), layout, p)
    fitted = M.fit_gbt(train, p)
    assert fitted.trees == p.trees
    for i, tree in enumerate(trees):
        assert same(nested(fitted, i), tree), i
    got = M.predict_raw(fitted, train).orderBy(P.DATE, *P.SERIES).toPandas()[M.RAW_PREDICTION]
    order = frame.sort_values([P.DATE, *P.SERIES]).index
    assert got.to_numpy() == pytest.approx(score[order], rel=1e-9)


def test_level_by_level_over_many_blocks_equals_one_block(train):
    """Models of different depths together, rows in many blocks, scores renewed on the way."""
    last = B.Fold(START + timedelta(weeks=45), START + timedelta(weeks=49))
    sets = [M.GbtParams(trees=10, depth=1, bins=16), M.GbtParams(trees=9, depth=2, rate=0.2, bins=16)]
    jobs = [(f, p) for f in (B.Fold(START + timedelta(weeks=35), START + timedelta(weeks=44)), last) for p in sets]
    one = B.boost(train, M.TABLE, jobs, 16, [2, 9, 10])
    many = B.boost(train, M.TABLE, jobs, 16, [2, 9, 10], block_rows=30)
    assert one[2].keys() == many[2].keys() and len(one[2]) == 10
    for key, error in one[2].items():
        assert many[2][key] == pytest.approx(error, rel=1e-9)
    for a, b in zip(one[0], many[0]):
        for x, y in zip(a, b, strict=True):
            assert (x.column == y.column).all() and (x.bin == y.bin).all()
            assert x.value == pytest.approx(y.value, rel=1e-9)


def test_duckdb_walks_the_stored_trees_and_sums_their_gains(spark, train, tmp_path):
    fitted = M.fit_gbt(train, PARAMS[0])
    M.save_model(spark, fitted, str(tmp_path / "model"))
    levels = {"region": ["ASIA", "EUROPE", "USA"], "platform": ["Retail", "Shopify"]}
    wide, columns = P.encode_dummies(train, levels)
    assert columns == M.feature_columns(fitted)
    M.predict_raw(fitted, wide).write.parquet(str(tmp_path / "rows"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW nodes AS SELECT * FROM '{tmp_path}/model/nodes/*.parquet'")
    db.execute(f"CREATE TABLE rows AS SELECT *, row_number() OVER () AS id FROM '{tmp_path}/rows/*.parquet'")
    values = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in columns)
    gaps = db.sql(f"""
        WITH RECURSIVE x AS (UNPIVOT (SELECT id, {values} FROM rows) ON COLUMNS(* EXCLUDE id) INTO NAME feature VALUE v),
        walk AS (
            SELECT id, tree, 0 AS node FROM rows, (SELECT DISTINCT tree FROM nodes)
            UNION ALL
            SELECT w.id, w.tree, 2 * w.node + CASE WHEN x.v < CASE WHEN n.is_category THEN 0.5 ELSE n.threshold END THEN 1 ELSE 2 END
            FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node JOIN x ON x.id = w.id AND x.feature = n.feature
        ), sums AS (SELECT id, sum(value) AS s FROM walk JOIN nodes USING (tree, node) WHERE value IS NOT NULL GROUP BY id)
        SELECT count(*), max(abs(s + {fitted.intercept!r} - raw_prediction)) FROM sums JOIN rows USING (id)
    """).fetchall()[0]
    assert gaps[0] == train.count() and gaps[1] < 1e-9
    stored = dict(db.sql("SELECT feature, avg(gain) FROM nodes WHERE feature IS NOT NULL GROUP BY 1").fetchall())
    ours = {r.feature: r.gain for r in M.feature_importance(fitted, spark, 9).collect()}
    assert ours == pytest.approx(stored, abs=1e-8)


def test_odd_inputs(spark, train):
    with pytest.raises(ValueError):
        M.fit_gbt(train.limit(0), PARAMS[0])
    constant = train.withColumn(P.TARGET, F.lit(3.0))
    assert {r.y_pred for r in M.predict(M.fit_gbt(constant, PARAMS[0]), train).collect()} == {3.0}
    assert B.boost(train, M.TABLE, [], 16)[0] == []
