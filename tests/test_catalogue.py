import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from compare import canonical, connect, duck

from discweave.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_agrees_with_sql(spark, db, name):
    got = canonical(catalogue.QUERIES[name](spark, SF).toArrow())
    want = canonical(duck(db, catalogue.ORACLES[name]))
    assert got[0] == want[0]
    assert got[1] == want[1]


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["o_custkey", "entry_id", "start_time", "end_time", "playback_order"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_grid_crop_keeps_signs_and_missing_cells(spark, tmp_path):
    """Bit for bit: what rounds to zero from below is -0.0, and cells that a grid lacks are null."""
    odd = [-3e-7, -0.0, 3e-7, -5e-7, float("nan"), None]
    whole = [0.25] * 10 + odd[:3] + [-0.1015625] * 5 + odd[3:] + [float("-inf")] * 43
    table = pa.table({"vec_id": pa.array(range(6), pa.int64()), "embedding": pa.array([whole, whole[:20], whole[:11], whole[:3], [], None], pa.list_(pa.float32()))})
    pq.write_table(table, tmp_path / "embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS FROM '{tmp_path}/embeddings.parquet'")
    spelled = lambda found: {r["vec_id"]: repr(r["cells"]) for r in found.to_pylist()}
    want = spelled(duck(db, catalogue.ORACLES["grid_crop"]))
    assert want[0].startswith("[-0.0, -0.0, 0.0, ") and want[5] == repr([None] * 6)
    assert spelled(catalogue.QUERIES["grid_crop"](spark, str(tmp_path)).toArrow()) == want
