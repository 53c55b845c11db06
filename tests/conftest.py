import pytest

from stepfold.plans.session import configure
from tests.oracle import duck, session


@pytest.fixture(scope="session")
def spark():
    return configure(session())


@pytest.fixture(scope="session")
def con():
    return duck("0.001")


@pytest.fixture
def hot(spark):
    """Every group of more than four rows counts as too large for one task."""
    spark.conf.set("stepfold.hotRows", "4")
    yield
    spark.conf.unset("stepfold.hotRows")
