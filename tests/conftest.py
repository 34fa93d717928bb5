import pytest

from tools.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(cores=4)
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoint")))
    return session


@pytest.fixture(params=["one bucket", "many buckets"])
def buckets(request, spark):
    """Run a test with the default limits and with limits that force the large-data paths."""
    small = {"rowsPerBucket": 7, "copiesPerChunk": 3, "aggregateCells": 2, "literalCells": 1, "blockSide": 2, "blockCells": 2}
    if request.param == "many buckets":
        for name, value in small.items():
            spark.conf.set(f"spark.tabframe.{name}", str(value))
    yield request.param
    for name in small:
        spark.conf.unset(f"spark.tabframe.{name}")
