import pathlib
import sys

import pytest

HERE = pathlib.Path(__file__).resolve().parent
sys.path[:0] = [str(HERE.parent), str(HERE)]

from helpers import DATA  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings feature_rows fixtures fixture_renames hunks manifest_entries targets splits eval_items lang_labels".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from vocalith.session import local_session

    s = local_session(4, 4, "6g")
    s.sparkContext.setLogLevel("OFF")
    if s.sparkContext.getCheckpointDir() is None:
        s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c
