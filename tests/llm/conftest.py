import tempfile

import pytest


@pytest.fixture(scope="session", autouse=True)
def checkpoint_folder(spark):
    """A folder of this run; a cluster names its own."""
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.conf.set("spark.checkpoint.dir", tempfile.mkdtemp(prefix="llm-test-"))
