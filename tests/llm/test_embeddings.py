import duckdb
import numpy as np
import pytest

from stockloom.llm import embeddings as E

SCHEMA = "vec_id long, embedding array<float>, label int, node string, copies string, bucket string"


def slow(rows):
    """(n_links, component) per row from all pairs."""
    units = []
    for name, v, *_ in rows:
        ok = name is not None and v and all(x is not None and np.isfinite(np.float32(x)) for x in v) and any(x != 0 for x in v)
        units.append(np.array(v, dtype=np.float32).astype(float) if ok else None)
    units = [None if u is None else u / np.linalg.norm(u) for u in units]
    n = len(rows)
    linked = [
        [
            i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= 0.9
            for j in range(n)
        ]
        for i in range(n)
    ]
    low = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in range(n):
                if linked[i][j] and low[j] < low[i]:
                    low[i], changed = low[j], True
    return [(sum(linked[i]), low[i]) for i in range(n)]


def clusters(seed=0, n=150):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, 32))
    rows = []
    for k in range(n):
        v = centres[k % 6] + rng.standard_normal(32) * rng.choice([0.05, 0.3, 1.5])
        rows.append((k, [float(x) for x in v.astype(np.float32)], 1, "x", "x", "x"))
    rows += [(200 + k, rows[k % 4][1], 2, "x", "x", "x") for k in range(12)]
    return rows


@pytest.mark.parametrize("block,bucket", [(2048, 128), (5, 128), (2048, 4)])
def test_links_and_components(llm, block, bucket):
    rows = clusters()
    found = {
        r.vec_id: (r.n_links, r.component_id, r.kept)
        for r in E.near_vectors(llm.createDataFrame(rows, SCHEMA), block=block, bucket=bucket, recall=0.999999).collect()
    }
    wanted = {row[0]: (links, low, low == row[0]) for row, (links, low) in zip(rows, slow(rows))}
    assert found == wanted


@pytest.mark.parametrize("recall,block,bucket", [(1.0, 40, 4), (0.9999999, 60, 8)])
def test_exact_mode_and_small_tables_inside_blocks(llm, recall, block, bucket):
    rows = clusters(3, 200)
    df = llm.createDataFrame(rows, SCHEMA)
    found = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(df, recall=recall, block=block, bucket=bucket).collect()}
    assert found == {row[0]: result for row, result in zip(rows, slow(rows))}


def test_small_tables_inside_a_pair_of_blocks():
    """Every pair across the blocks is counted once, in whichever small table it meets first."""
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((40, 16))
    units = E._unit_rows(centres[rng.integers(0, 40, 600)] + 0.15 * rng.standard_normal((600, 16)))
    far = np.arange(600) >= 350
    counted = np.zeros(600, dtype=int)
    none, once = np.zeros((600, 0), dtype=np.int64), np.ones(600, dtype=np.int64)
    for rows, links, _ in E.local_links(units, once, none, far, 0.9, 0.999999, 16, 5):
        counted[rows] += links
    close = units @ units.T >= 0.9
    assert (counted == np.where(far, close[:, ~far].sum(axis=1), close[:, far].sum(axis=1))).all()
    assert counted.sum() > 1000


def test_odd_rows(llm):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]),
        (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (10, [-1.0, -0.0]), (11, [-1.0, 0.0]),
        (12, [1e30, 1e-30]), (13, [1e-30, 0.0]),
    ]
    rows = [(*row, 1, "x", "x", "x") for row in rows]
    found = E.near_vectors(llm.createDataFrame(rows, SCHEMA)).collect()
    assert len(found) == len(rows)
    by_id = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in found}
    assert by_id[1] == (4, 1, True) and by_id[2] == (4, 1, False) and by_id[13] == (4, 1, False)
    assert by_id[10] == (1, 10, True) and by_id[11] == (1, 10, False)
    assert all(by_id[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9))
    assert by_id[None] == (0, None, True)
    assert E.near_vectors(llm.createDataFrame([], SCHEMA)).count() == 0


def test_plan_reaches_the_recall():
    for n in (2, 1000, 10**6, 10**10):
        signs, tables = E.table_plan(n, 0.9, 0.998, 128)
        agree = 1 - np.arccos(0.9) / np.pi
        assert 1 - (1 - agree**signs) ** tables >= 0.998


def test_sql(llm, tmp_path):
    from stockloom.catalog.registry import Query
    from stockloom.llm.queries import QUERIES, SQL
    from tools.check import compare

    df = llm.createDataFrame([r[:3] for r in clusters(5)], "vec_id long, embedding array<float>, label int")
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    name = "op3_embedding_near_duplicates"
    query = Query(name, lambda t: QUERIES[name](t.spark, t.directory), SQL[name])
    status, detail, _ = compare(query, llm, con, str(tmp_path))
    assert status == "ok", detail
