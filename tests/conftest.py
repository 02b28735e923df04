import csv
import os
import pathlib
import sys

import pytest

ROOT = pathlib.Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
FIXTURES = ROOT / "tests" / "fixtures"

from pricebench.model import RAW_LINE  # noqa: E402
from pricebench.operators.enrich import enrich_lines  # noqa: E402
from pricebench.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(os.environ.get("TEST_CPUS", "8"), **{"spark.sql.shuffle.partitions": "4", "spark.sql.codegen.wholeStage": "false", "spark.sql.codegen.factoryMode": "NO_CODEGEN"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def read_fixture(name):
    with open(FIXTURES / name, newline="", encoding="utf8") as f:
        return list(csv.DictReader(f))


def raw_frame(spark, rows):
    """Raw lines from dicts; ``seq`` is the position unless given."""
    full = []
    for i, row in enumerate(rows):
        r = {f.name: None for f in RAW_LINE.fields} | dict(row)
        r["seq"] = r["seq"] if r["seq"] is not None else i
        for c in ("qty", "unit_cost", "total_cost"):
            r[c] = None if r[c] in (None, "") else float(r[c])
        full.append(tuple(r[f.name] for f in RAW_LINE.fields))
    return spark.createDataFrame(full, RAW_LINE)


def demo_rows():
    rows = read_fixture("demo_lines.csv")
    for r in rows:
        r["seq"] = int(r["seq"])
    return rows


@pytest.fixture(scope="session")
def demo(spark):
    df = enrich_lines(raw_frame(spark, demo_rows())).cache()
    df.count()
    return df
