import numpy as np
import pytest
from tenure.llm import cosine_cells
from tenure.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, least=0.9):
    """(id, links, component) by all pairs; rows are nodes, ids only name them."""
    usable = [
        i for i, (k, v) in enumerate(rows) if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    ]
    root, links = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for n, i in enumerate(usable):
        for j in usable[n + 1 :]:
            x, y = np.array(rows[i][1]), np.array(rows[j][1])
            if len(x) != len(y):
                continue
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= least:
                links[i] += 1
                links[j] += 1
                root[find(j)] = find(i)
    low = {}
    for i, (k, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), 2**63), 2**63 if k is None else k)
    out = [(k, links[i], None if k is None else low[find(i)], k is None or k == low[find(i)]) for i, (k, _) in enumerate(rows)]
    return sorted(out, key=str)


def around(rng, centre, cosine):
    noise = rng.normal(size=len(centre))
    noise -= noise @ centre * centre
    return cosine * centre + np.sqrt(1 - cosine**2) * noise / np.linalg.norm(noise)


def planted(rng, size=24):
    """Groups around centres (tight, wide, chains), exact copies, scaled copies and background."""
    vectors = [rng.normal(size=size) for _ in range(120)]
    for cosines in ([0.999] * 40, [0.97] * 30, [0.93] * 25, [0.901, 0.899] * 5):
        centre = rng.normal(size=size)
        centre /= np.linalg.norm(centre)
        vectors += [centre, *(around(rng, centre, c) for c in cosines)]
    chain = vectors[0] / np.linalg.norm(vectors[0])
    for _ in range(6):
        chain = around(rng, chain, 0.95)
        vectors.append(chain)
    vectors += [vectors[5], vectors[5], 3.0 * vectors[6], -vectors[7]]
    rng.shuffle(vectors)
    return [(int(i), [float(x) for x in v]) for i, v in enumerate(vectors, 10)]


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("cell_rows, block_rows", [(4096, 8192), (40, 16)])
def test_equals_all_pairs(frame, monkeypatch, cell_rows, block_rows):
    monkeypatch.setattr(cosine_cells, "CELL_ROWS", cell_rows)
    monkeypatch.setattr(cosine_cells, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(cosine_cells, "CHUNK_ROWS", 7)
    rows = planted(np.random.default_rng(cell_rows))
    assert result(cosine_cells.link_vectors(frame(SCHEMA, rows))) == brute(rows)


def test_recall_beside_borders(frame, monkeypatch):
    """Partners at exactly the least cosine and just above, in random directions, many cells."""
    monkeypatch.setattr(cosine_cells, "CELL_ROWS", 50)
    rng = np.random.default_rng(5)
    rows = []
    for i in range(600):
        x = rng.normal(size=64)
        x /= np.linalg.norm(x)
        rows += [(2 * i, x.tolist()), (2 * i + 1, around(rng, x, 0.9 + 1e-9 if i % 2 else 0.93).tolist())]
    found = cosine_cells.link_vectors(frame(SCHEMA, rows))
    true = {r[0] for r in brute(rows) if r[1]}
    linked = {r["vec_id"] for r in found.where("n_links > 0").collect()}
    assert linked <= true
    assert len(linked) >= 0.98 * len(true)


def test_defined_edges(frame):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [1.0, inf]), (6, [1.0, None]), (7, [1.0]), (8, [2.0]),
        (None, [1.0, 1.0]), (9, [1.0, 1.0]), (9, [1.0, 1.0]), (11, [1.0, -1.0]), (11, [1.0, 1.01]), (12, [1e200, 1e200]), (13, [-0.0, 1.0]), (14, [0.0, 1.0]),
    ]
    assert result(cosine_cells.link_vectors(frame(SCHEMA, rows))) == brute(rows)
    assert cosine_cells.link_vectors(frame(SCHEMA, [])).count() == 0
    assert result(cosine_cells.link_vectors(frame(SCHEMA, [(1, None)]))) == [(1, 0, 1, True)]


def test_float_vectors_and_clashing_names(frame):
    rows = [(i, [float(np.float32(x)) for x in v], "a", 5) for i, v in planted(np.random.default_rng(3), 8)]
    df = frame("vec_id long, embedding array<float>, n_links string, digest int", rows)
    judged = cosine_cells.link_vectors(df)
    assert result(judged) == brute([r[:2] for r in rows])
    kept = cosine_cells.drop_near_vectors(df)
    assert kept.columns == df.columns
    assert {r["vec_id"] for r in kept.collect()} == {r[0] for r in brute([r[:2] for r in rows]) if r[3]}


def test_hot_core_is_not_multiplied(frame, monkeypatch):
    """A third of all rows around one vector: its pairs come from sums, and a hub has a star of links."""
    rng = np.random.default_rng(8)
    centre = rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    rows = [(i, around(rng, centre, 0.9999).tolist() if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(900)]
    seen = []
    real = cosine_cells.components
    monkeypatch.setattr(cosine_cells, "components", lambda links: seen.append(links.count()) or real(links))
    got = {r[0]: r for r in cosine_cells.link_vectors(frame(SCHEMA, rows)).collect()}
    assert all(got[i][1] >= 299 and got[i][2] == 0 for i in range(0, 900, 3))
    assert seen[0] < 900


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert result(QUERIES["op11_cosine_cells"](spark, sf)) == brute(rows)
