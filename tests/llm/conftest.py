import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

DATA = "/root/testdata/sf0.001"
USED = "feature_rows fixtures fixture_renames hunks manifest_entries targets splits eval_items documents lang_labels".split()
# names that operators use inside, as further columns of every table
CLASH = "n id k v s x cls node component source split score grp item place block slot part key value root a b h toks side label kind field vec cosine segs stated n_tokens container lang_1".split()


def widened(t: pa.Table) -> pa.Table:
    """The table with a row of nulls, its first rows again, and columns of clashing names."""
    nulls = pa.table({f.name: pa.nulls(1, f.type) for f in t.schema}, schema=pa.schema([pa.field(f.name, f.type) for f in t.schema]))
    t = pa.concat_tables([t.cast(nulls.schema), nulls, t.slice(0, 3).cast(nulls.schema)])
    for c in CLASH:
        if c not in t.column_names:
            t = t.append_column(c, pa.array([c] * len(t)))
    return t


@pytest.fixture(scope="session")
def empty_dir(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for t in USED:
        pq.write_table(pq.read_table(f"{DATA}/{t}.parquet").slice(0, 0), d / f"{t}.parquet")
    return str(d)


@pytest.fixture(scope="session")
def wide_dir(tmp_path_factory):
    """Tables with null rows, repeated rows and extra columns. Tables without an id keep their rows, as a repeated document is a
    document; only nulls and columns are added to documents."""
    d = tmp_path_factory.mktemp("wide")
    for t in USED:
        x = widened(pq.read_table(f"{DATA}/{t}.parquet"))
        pq.write_table(x, d / f"{t}.parquet")
    return str(d)


@pytest.fixture
def copy_dir(tmp_path):
    """A copy of the tables to be changed by a test."""
    for t in USED:
        shutil.copy(f"{DATA}/{t}.parquet", tmp_path / f"{t}.parquet")
    return tmp_path
