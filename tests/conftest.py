import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

# Small tables are compiled far longer than they run, so tests interpret their plans; CODEGEN=1 compiles them as in production.
COMPILED = os.environ.get("CODEGEN") == "1"
OPTIONS = {
    "spark.driver.memory": "3g", "spark.cleaner.referenceTracking.cleanCheckpoints": "true", "spark.sql.codegen.wholeStage": str(COMPILED).lower(), "spark.sql.codegen.factoryMode": "FALLBACK" if COMPILED else "NO_CODEGEN",
    "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.ui.showConsoleProgress": "false",
}


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[4]").config(map=OPTIONS).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(autouse=True)
def _no_cache(request):
    yield
    if "spark" in request.fixturenames:
        request.getfixturevalue("spark").catalog.clearCache()
