import pytest

LAYOUT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")


@pytest.fixture(autouse=True)
def same_layout(request):
    """Sessions leave a test with the file layout they entered it with."""
    yield
    if "spark" in request.fixturenames:
        for k in LAYOUT:
            request.getfixturevalue("spark").conf.unset(k)
