from conftest import FIXTURES, read_fixture
from pricebench.operators.evaluate import operating_points, printed_sweep, sweep
from pricebench.sources.tabular import read_labelled_pairs


def test_published_grid(spark):
    pairs = read_labelled_pairs(spark, str(FIXTURES / "labelled_pairs.csv"))
    assert pairs.count() == 138
    got = [[float(v) for v in row] for row in printed_sweep(sweep(pairs)).collect()]
    want = [[float(v) for v in row.values()] for row in read_fixture("sweep_grid.csv")]
    assert got == want


def test_operating_points(spark):
    cells = sweep(read_labelled_pairs(spark, str(FIXTURES / "labelled_pairs.csv")))
    rows = operating_points(cells).collect()
    assert [(r.point, r.token_weight, r.threshold) for r in rows] == [("best f1", 0.4, 0.7)]
    assert round(rows[0].f1, 4) == 0.9412
