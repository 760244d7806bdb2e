from martlib.operators import model as M
from martlib.plans.catalogue import QUERIES


def test_registered_search_covers_the_full_grid(spark):
    """All 108 combinations on five folds, fitted and scored."""
    rows = QUERIES["gbt_grid_scores"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 108 and {r.folds for r in rows} == {5}
    for name, values in M.GRID.items():
        assert {r[name] for r in rows} == set(values)
    errors = {tuple(r[k] for k in ("trees", "depth", "rate", "row_share", "column_share")): r.mean_mae for r in rows}
    assert len(set(errors.values())) > 100 and all(0 < e < 10 for e in errors.values())
