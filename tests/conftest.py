import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from docloom.session import session

    made = session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="docloom-tests-"), "spark.ui.showConsoleProgress": "false"})
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()
