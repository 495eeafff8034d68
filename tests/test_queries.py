"""Every registered query that has SQL against that SQL; the others run and give rows."""

import os

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from lattica.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    out = duckdb.connect()
    for t in os.listdir(SF):
        out.execute(f"create view {t.split('.')[0]} as select * from read_parquet('{SF}/{t}')")
    return out


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert got or name in ("hsv_channels",)
    if name in catalog.oracle_sql():
        want = con.execute(f"select {', '.join(columns)} from ({catalog.oracle_sql()[name]})").fetchall()
        assert len(got) == len(want) and sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["kmeans_assign_step", "kmeans_inertia"])
def test_embeddings_near_thousandths(spark, tmp_path, name):
    """Every thousandth and its neighbours in single precision, where products of single and of double precision are cut to other integers."""
    thousandths = np.arange(-999, 1000, dtype=np.float32) / np.float32(1000)
    values = np.stack([np.nextafter(thousandths, np.float32(side)) if side else thousandths for side in (-2, 0, 2)], axis=1)
    pq.write_table(pa.table({"vec_id": pa.array(range(len(values)), pa.int64()), "embedding": pa.array(values.tolist(), pa.list_(pa.float32())),
                             "label": pa.array([k % 10 for k in range(len(values))], pa.int32())}), tmp_path / "embeddings.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["kmeans_assign_step", "kmeans_inertia"])
@pytest.mark.parametrize("odd", ["labels", "vectors", "values", "ids", "repeated", "none"])
def test_odd_embeddings(spark, tmp_path, name, odd):
    """Null labels, vectors, values and ids, repeated rows, and an empty table."""
    rng = np.random.default_rng(4)
    ids, labels, values = list(range(60)), [k % 5 for k in range(60)], rng.uniform(-1, 1, (60, 4)).astype(np.float32).tolist()
    for k in range(0, 60, 7):
        if odd == "labels":
            labels[k] = None
        elif odd == "vectors":
            values[k] = None
        elif odd == "values":
            values[k][k % 4] = None
        elif odd == "ids":
            ids[k] = None
        elif odd == "repeated":
            ids[k + 1:k + 3], labels[k + 1:k + 3], values[k + 1:k + 3] = [ids[k]] * 2, [labels[k]] * 2, [values[k]] * 2
    if odd == "vectors":
        values = [None if label == 3 else v for v, label in zip(values, labels)]
    rows = slice(0, 0 if odd == "none" else 60)
    pq.write_table(pa.table({"vec_id": pa.array(ids[rows], pa.int64()), "embedding": pa.array(values[rows], pa.list_(pa.float32())),
                             "label": pa.array(labels[rows], pa.int32())}), tmp_path / "embeddings.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet')")
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("kind", [pa.int64(), pa.int32()])
@pytest.mark.parametrize("name", ["line_density", "close_gray", "enhance_lines", "new_line_pixels"])
def test_odd_images(spark, tmp_path, name, kind):
    """Keys of 32 bits, null, negative, repeated and distant ones."""
    pq.write_table(pa.table({"p_partkey": pa.array([3, None, -1, 0, 2_000_011, None, -1_000_003, *([3, -1] if name != "close_gray" else [])], kind)}), tmp_path / "part.parquet")
    df = entry.queries()[name](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view part as select * from read_parquet('{tmp_path}/part.parquet')")
    want = con.execute(f"select {', '.join(df.columns)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
