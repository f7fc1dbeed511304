import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = (
        SparkSession.builder.master("local[8]")
        .appName("quillrank-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def no_job_outlives_its_test():
    """A test that is stopped leaves no Spark job behind to slow the next one."""
    yield
    if (session := SparkSession.getActiveSession()) is not None:
        session.sparkContext.cancelAllJobs()


@pytest.fixture()
def folder(tmp_path):
    """A path maker: ``folder("name")``."""
    return lambda name: "file:" + str(tmp_path / name)
