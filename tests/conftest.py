import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sigframe.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(8, memory="8g", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def signal(spark, values, signal_id=1, channel=0):
    rows = [(signal_id, channel, i, None if x is None else float(x)) for i, x in enumerate(values)]
    return spark.createDataFrame(rows, "signal_id long, channel int, n long, x double")


def column(df, name="x", order="n"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]
