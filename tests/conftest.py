import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF0001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from candleframe.session import local_session

    s = local_session("*", 8)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def bars(spark):
    from candleframe.operators.bars import fixture_bars
    from candleframe.sources.tables import events_as_ticks

    return fixture_bars(events_as_ticks(spark, SF0001), "1 hour").cache()
