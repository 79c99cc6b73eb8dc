import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from cellweave.session import local_session  # noqa: E402
from cellweave.tables import PORTION_SCHEMA, Layout  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("2", shuffle_partitions=2)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(params=["whole", "chunked"])
def layout(request):
    """Both ways to run: tables known to be small, and tables cut into chunks of four rows."""
    return Layout(chunked=request.param == "chunked", bits=2)


@pytest.fixture(scope="session")
def portions(spark):
    """Build the portions of one table (or several, by name) from lists of rows."""

    def build(tables):
        named = tables if isinstance(tables, dict) else {"t": tables}
        rows = [
            (name, part_ix, part_ix + 1, row_ix, cells)
            for name, parts in named.items()
            for part_ix, part in enumerate(parts)
            for row_ix, cells in enumerate(part)
        ]
        return spark.createDataFrame(rows, PORTION_SCHEMA)

    return build


@pytest.fixture(scope="session")
def rows_of():
    """The rows of a result in order, per table."""

    def collect(df, name="t"):
        return [r.cells for r in df.filter(df.table_id == name).orderBy("row_ix").collect()]

    return collect
