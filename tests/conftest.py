import os
import sys
import tempfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

from tellsign.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tellsign-test-")


@pytest.fixture
def messages(spark):
    def make(*rows):
        data = [(i, u, t) for i, (u, t) in enumerate(rows)]
        return spark.createDataFrame(data, "msg_id long, user string, text string")

    return make


@pytest.fixture
def scored(spark):
    """One row on each side of every band and priority edge, named by its score: s95 scores 0.95 and so on."""
    from tellsign.fixed import FEATURES
    from tellsign.functions.scoring import with_risk_band

    rows = [(i, f"s{n}", f"s{n} asks for item {i}", n / 100, FEATURES[i], n / 200, n / 300, n / 400)
            for i, n in enumerate((95, 85, 72, 55, 30, 12))]
    return with_risk_band(spark.createDataFrame(
        rows, "msg_id long, user string, text string, risk_score double, top_risk_driver string, "
              "urgency_score double, trust_score double, fear_score double"))


@pytest.fixture
def scaled_results(spark):
    """n rows with scores 0.1 + 0.8 * i / (n - 1)."""
    def make(n):
        from tellsign.functions.scoring import with_risk_band

        rows = [(i, f"user{i % 5}", f"message {i}", 0.1 + 0.8 * i / (n - 1), "urgency_score")
                for i in range(n)]
        return with_risk_band(spark.createDataFrame(
            rows, "msg_id long, user string, text string, risk_score double, top_risk_driver string"))

    return make
