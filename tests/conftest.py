import faulthandler
import signal
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
#: Seconds after which a test fails, and after which the run ends with all stacks if the test can't be interrupted.
SLOW, STUCK = 300, 600


@pytest.hookimpl(wrapper=True)
def pytest_runtest_protocol(item):
    def late(*_):
        raise TimeoutError(f"{item.nodeid} took more than {SLOW} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.alarm(SLOW)
    faulthandler.dump_traceback_later(STUCK, exit=True)
    try:
        return (yield)
    finally:
        signal.alarm(0)
        signal.signal(signal.SIGALRM, before)
        faulthandler.cancel_dump_traceback_later()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tallyspark.session import local_session, prepare

    session = local_session(4, 4, **{"spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    yield prepare(session)
    session.stop()
