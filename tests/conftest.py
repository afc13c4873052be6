import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("TZ", "UTC")


@pytest.fixture(scope="session")
def spark():
    from millrace.session import get_session

    s = get_session("tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        "spark.sql.maxMetadataStringLength": "2000", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "7",
    })
    s.sparkContext.setLogLevel("OFF")
    return s


def rows(df, *cols):
    """Sorted tuples of a result."""
    out = df.select(*cols) if cols else df
    return sorted((tuple(r) for r in out.collect()), key=lambda r: tuple((x is not None, str(type(x)), x) if not isinstance(x, (list, dict)) else (True, "", str(x)) for x in r))
