import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# Workers need the package too, wherever pytest was started.
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")])

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from lutrin.session import local_session

    s = local_session(4, partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    """The smallest of the given tables."""
    d = DATA / "sf0.001"
    if not d.exists():
        pytest.skip("the given tables aren't here")
    return str(d)


@pytest.fixture(scope="session")
def same(spark):
    """Runs a query in Spark and its SQL in DuckDB over the same folder, and compares rows."""
    import duckdb

    def plain(v):
        if isinstance(v, float):
            return round(v, 5)
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return v

    def check(name: str, query, sql: str, folder: str) -> None:
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        done = con.execute(sql)
        names = [d[0] for d in done.description]
        want = sorted((tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in done.fetchall()), key=repr)
        df = query(spark, folder)
        assert sorted(df.columns) == sorted(names), name
        got = sorted((tuple(plain(r[c]) for c in sorted(names)) for r in df.collect()), key=repr)
        assert got == want, name

    return check
