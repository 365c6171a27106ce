"""Tables in the shared folder."""

import os
from urllib.parse import urlparse

from quillspan.plans import lineage


def test_stored_tables_can_be_forgotten(spark):
    df = lineage.stored(spark.range(5), "t")
    assert df.count() == 5
    path = urlparse(lineage._written[-1]).path
    assert os.path.isdir(path)
    assert lineage.forget(spark) >= 1 and not os.path.exists(path)


def test_checkpoint_is_reliable(spark):
    df = lineage.checkpoint(spark.range(3))
    assert df.count() == 3
    assert spark.sparkContext.getCheckpointDir() is not None
