import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

FILE_TEXT = "repo_id string, path string, language string, file_size int, text string, scan_error string"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if session.sparkContext.getCheckpointDir() is None:
        session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield session


@pytest.fixture(scope="session")
def file_text(spark):
    def make(files):
        """``(repo_id, path, language, text)`` rows; a text of None is a file that could not be read."""
        rows = [(repo, path, language, len(text or ""), text, None if text is not None else "Cannot read file")
                for repo, path, language, text in files]
        return spark.createDataFrame(rows, FILE_TEXT)

    return make
