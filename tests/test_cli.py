import sys
from datetime import timedelta

from martlib import __main__ as cli
from martlib.operators import model as M
from martlib.operators.star import read_star

from conftest import monday


def run(monkeypatch, *arguments):
    monkeypatch.setattr(sys, "argv", ["martlib", *arguments])
    cli.main()


def test_build_train_and_forecast(spark, tmp_path, monkeypatch):
    dump = tmp_path / "dump.sql"
    start = monday(2020, 1, 6)
    lines = []
    for i in range(40):
        d = start + timedelta(weeks=i)
        for region, platform, level in [("asia", "Retail", 50), ("usa", "Shopify", 9)]:
            sales = (level + i % 5) * 1_000_000
            date = f"{d.day}/{d.month}/{d:%y}"
            lines.append(f"('{date}', '{region}', '{platform}', 'C1', 'New', '{1000 + i}', '{sales}'),")
    dump.write_text("\n".join(lines))
    star, model, out = (str(tmp_path / name) for name in ["star", "model", "out"])

    run(monkeypatch, "build-star", "--csv", str(tmp_path / "c"), "--dump", str(dump), "--star", star)
    assert read_star(spark, star).fact.count() == 80

    small = {"trees": [2], "depth": [2], "rate": [0.1], "row_share": [0.8], "column_share": [0.8]}
    for name, values in small.items():
        monkeypatch.setitem(M.GRID, name, values)
    run(monkeypatch, "train", "--star", star, "--model", model, "--split-date", "2020-08-24")
    run(monkeypatch, "forecast", "--star", star, "--model", model, "--weeks", "4", "--out", out)
    rows = spark.read.parquet(out).collect()
    assert len(rows) == 2 * 4 and all(r.forecast > 0 for r in rows)
