import numpy as np

from stringloom.llm import embedding_dedup as e


def brute(rows):
    """vec_id -> (distinct other ids linked with any of its vectors, least id reachable)."""
    units = e.unit([r[1] for r in rows])
    n = len(rows)
    links = {r[0]: set() for r in rows}
    for i in range(n):
        for j in range(n):
            if rows[i][0] != rows[j][0] and None not in (rows[i][0], rows[j][0]) and rows[i][2] is not None and rows[i][2] == rows[j][2] and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= e.COSINE:
                links[rows[i][0]].add(rows[j][0])
    comp = {i: i for i in links}
    while True:
        new = {i: i if i is None else min([comp[i], *(comp[j] for j in links[i])]) for i in links}
        if new == comp:
            return {i: (len(links[i]), comp[i]) for i in links}
        comp = new


def some(seed, n=400, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(25, dim))
    rows = [(i, (centres[i % 25] + rng.normal(size=dim) * (0.05 + 0.1 * (i % 3))).tolist(), i % 2) for i in range(n)]
    rows += [(n + i, rows[i][1], rows[i][2]) for i in range(20)]  # copies
    rows += [(900, None, 1), (901, [], 1), (902, [0.0] * dim, 1), (903, [None] + [1.0] * (dim - 1), 1), (904, [float("nan")] * dim, 1), (905, [float("inf")] * dim, 1), (906, rows[0][1], None)]
    rows += [(907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [1e300] * dim, 1), (910, [1e-200] * dim, 1)]
    return rows


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(e, "LEAF", 24)
    monkeypatch.setattr(e, "BLOCK", 16)
    rows = some(3)
    df = spark.createDataFrame([(a, b, c, 1.0) for a, b, c in rows], "vec_id long, embedding array<double>, label int, rep double")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_vectors(df).collect()}
    want = brute(rows)
    assert len(got) == len(rows) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(g[0] for g in got.values()) >= 0.9 * sum(w[0] for w in want.values())
    assert sum(got[i] == want[i] for i in want) >= 0.95 * len(want)
    assert got[908] == (1, 907) and got[910] == (1, 909) and got[900] == (0, 900)


def test_leaves_are_split_again(spark, monkeypatch):
    monkeypatch.setattr(e, "SAMPLE", 60)
    monkeypatch.setattr(e, "LEAF", 16)
    monkeypatch.setattr(e, "REFIT", 40)
    monkeypatch.setattr(e, "REFIT_SAMPLE", 40)
    rows = some(5)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    classes = df.where("vec_id < 400").select(e.F.col("vec_id").alias("cid"), e.F.col("embedding")).toPandas()
    made = spark.createDataFrame([(int(c), bytearray(np.array(x).tobytes())) for c, x in zip(classes["cid"], e.unit(classes["embedding"].tolist()))], "cid long, v binary")
    leaves = e._leaves(made, 2, 3)
    assert {r["cid"] for r in leaves.select("cid").distinct().collect()} == set(range(400))
    sizes = sorted(r["count"] for r in leaves.groupBy("leaf").count().collect())
    assert sizes[-1] < 400 and sizes[len(sizes) // 2] <= 80
    got = {r["vec_id"]: r["n_links"] for r in e.near_vectors(df).collect()}
    want = brute(rows)
    assert all(got[i] <= want[i][0] for i in want) and sum(got.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_one_id_on_several_vectors(spark):
    near = lambda v, t: [v[0] + t, *v[1:]]
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, x, 0), (1, y, 0), (2, near(x, 0.0) + [], 0), (3, near(y, 0.05), 0), (4, near(y, 0.06), 0), (5, z, 0), (5, near(y, 0.02), 0), (6, z, 0), (6, x, 1), (7, near(x, 2.0), 0), (1, x, 0), (5, None, 0), (None, x, 0)]
    want = brute(rows)
    for order in (1, -1):
        df = spark.createDataFrame(rows[::order], "vec_id long, embedding array<double>, label int")
        got = e.near_vectors(df).collect()
        assert len(got) == len(rows)
        for r in got:
            if r["vec_id"] is None:
                assert (r["n_links"], r["component_id"], r["kept"]) == (0, None, True)
            elif r["vec_id"] != 5:  # id 5 also has a row without a vector
                assert (r["n_links"], r["component_id"]) == want[r["vec_id"]], r
        assert {(r["n_links"], r["component_id"]) for r in got if r["vec_id"] == 5} <= {want[5], (0, 5), (want[5][0], 5)}


def test_counts_once_a_pair_and_gives_a_forest():
    rng = np.random.default_rng(2)
    linked = rng.random((30, 40)) < 0.05
    forest = e._spans(linked)
    assert all(linked[r, c] for r, c in forest)

    def groups(edges):
        comp = list(range(70))
        for _ in range(70):
            for r, c in edges:
                comp[r] = comp[30 + c] = min(comp[r], comp[30 + c])
        return comp

    assert groups(list(zip(*np.nonzero(linked)))) == groups(forest) and len(forest) == 70 - len(set(groups(forest)))


def test_repeated_rows_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, [1.0, 0.0], 0)], "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in e.near_vectors(df).collect() if r["vec_id"])
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    assert e.near_vectors(df.limit(0)).count() == 0


def test_recall_of_the_query(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    want = brute([(r["vec_id"], r["embedding"], r["label"]) for r in table])
    got = {r["vec_id"]: r["n_links"] for r in e.op7_embedding_dedup(spark, sf).collect()}
    assert all(got[i] <= want[i][0] for i in got)
    assert sum(got.values()) >= 0.9 * sum(w[0] for w in want.values())


def test_disk_is_a_few_times_the_vectors(spark):
    """a row was written once for each leaf of each tree, with its vector."""
    import os

    from stringloom.llm import common

    n, dim = 12_000, 64
    x = np.random.default_rng(4).normal(size=(n, dim)).astype(np.float32)
    df = spark.createDataFrame([(i, v, i % 2) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<float>, label int")
    top = common.shared_dir(spark).removeprefix("file://")
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(top) for f in names)
    before = size()
    assert e.near_vectors(df).count() == n
    assert size() - before < 3 * 4 * dim * n


def test_cells_beyond_a_task_are_blocks(spark, monkeypatch):
    """A group too dense to part, larger than a cell: every pair of its blocks is compared, each link counted once."""
    monkeypatch.setattr(e, "REFIT", 50)
    rng = np.random.default_rng(6)
    centre = rng.normal(size=12)
    rows = [(i, (centre + rng.normal(size=12) * 0.12).tolist(), 0) for i in range(300)] + [(300 + i, rng.normal(size=12).tolist(), 0) for i in range(100)]
    rows += [(7, rows[9][1], 0), (350, rows[20][1], 0)]  # ids on several vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in e.near_vectors(df).collect()}
    want = brute(rows)
    assert all(got[i][0] <= want[i][0] for i in want) and 0 < sum(w[0] for w in want.values()) < 300 * 299
    assert sum(g[0] for g in got.values()) >= 0.98 * sum(w[0] for w in want.values())
    assert sum(got[i][1] == want[i][1] for i in want) >= 0.98 * len(want)
