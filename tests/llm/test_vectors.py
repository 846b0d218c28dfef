import numpy as np
import pytest

from tessera.llm import pigeonhole
from tessera.llm.common import local_forest
from tessera.llm.permutation_index import PivotFiles, search
from tessera.llm.pigeonhole import near_duplicates

HUNDREDTH = lambda i: i % 100 == 0
SCHEMA = "vec_id long, embedding array<float>, label int, node long, cell string"


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, 0, "") for i, v, l in rows], SCHEMA).repartition(3)


def odd_rows():
    return [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] + [1.0] * 15, 1), (903, [None] + [1.0] * 15, 1), (904, [float("inf")] * 16, 2), (905, [1.0, 2.0], 1), (906, [], 1), (None, [1.0] * 16, 1)]


def sample(seed, n=400):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, 16))
    for i in range(n // 2, n):  # near copies at angles around the threshold
        x[i] = unit(x[rng.integers(0, n // 8)]) + rng.standard_normal(16) * rng.choice([0, 0.02, 0.05, 0.07])
    return [(int(i), [float(np.float32(c)) for c in v], [0, 1, 1, None][i % 4]) for i, v in enumerate(x)] + odd_rows()


def usable(rows, dim=16):
    ok = [(i, np.array(v, dtype=np.float32).astype(float), l) for i, v, l in rows if i is not None and v and None not in v and len(v) == dim]
    return [r for r in ok if np.isfinite(r[1]).all() and r[1].any()]


@pytest.mark.parametrize(("seed", "chunk"), [(1, 8192), (2, 40), (3, 5)])
def test_pigeonhole_against_brute_force(spark, monkeypatch, seed, chunk):
    monkeypatch.setattr(pigeonhole, "CHUNK", chunk)
    rows = sample(seed)
    rows += [(7, rows[7][1], rows[7][2])]
    ok = [r for r in usable(rows) if r[2] is not None]
    x = np.stack([r[1] for r in ok])
    near = unit(x) @ unit(x).T >= 0.98
    label = np.array([r[2] for r in ok])
    near &= label[:, None] == label[None, :]
    np.fill_diagonal(near, False)
    root = dict(local_forest([(ok[i][0], ok[j][0]) for i, j in np.argwhere(near) if ok[i][0] != ok[j][0]]))
    links = {}
    for r, n in zip(ok, near.sum(axis=1)):
        links[r[0]] = int(n)
    want = sorted(((i, links.get(i, 0) if i is not None else 0, root.get(i, i), i is not None and root.get(i, i) == i) for i, _, _ in rows), key=str)
    got = sorted((tuple(r) for r in near_duplicates(frame(spark, rows)).collect()), key=str)
    assert got == want
    assert sum(links.values()) > 100


def test_repeated_ids_with_other_vectors_are_vectors_of_their_own(spark):
    rows = [(5, [1.0, 0.0], 1), (5, [0.0, 1.0], 1), (6, [1.0, 0.01], 1), (7, [0.01, 1.0], 1), (5, [1.0, 0.0], 2)]
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (6, 1, 5, False), (7, 1, 5, False)]


def test_only_full_cells_are_copied(spark, monkeypatch):
    """Of a label far larger than a chunk only full cells are cut or dealt out: copies of a row do not grow with the label."""
    rng = np.random.default_rng(2)

    def sent(n, chunk):
        monkeypatch.setattr(pigeonhole, "CHUNK", chunk)
        x = rng.standard_normal((n, 64))
        nodes = spark.createDataFrame([("1", i.to_bytes(4, "big"), 1, v.astype("<f4").tobytes()) for i, v in enumerate(x)], "label string, node binary, copies long, raw binary")
        return pigeonhole.tiles(nodes, pigeonhole.Rotation(64, 0.98), "<f4", 64).count() / n

    assert sent(1000, 1000) < 19 and sent(2000, 1000) < 19
    # 10,000 to a chunk of 50 is 200 chunks, of which each row would go to all in each of its 18 cells; cutting copies it
    # to 2.25 cells on average in each of three steps, and REFINE chunks at most
    assert sent(10000, 50) < 18 * 2.25**3 * 2 < 18 * 200 / 5


def test_footrule():
    rng = np.random.default_rng(3)
    prefixes = np.stack([rng.permutation(12)[:5] for _ in range(50)])
    files = PivotFiles(prefixes, 12)
    place = np.full((50, 12), 5)
    np.put_along_axis(place, prefixes, np.tile(np.arange(5), (50, 1)), axis=1)
    for q in range(10):
        assert (files.footrule(prefixes[q]) == np.abs(place - place[q]).sum(axis=1)).all()


def brute_search(rows, k, dim=16):
    ok = usable(rows, dim)
    out = []
    for q, v, _ in ok:
        if q % 100 == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), i) for i, w, _ in ok if i != q)[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(near, 1)]
    return sorted(out)


def test_search_exact_when_all_are_reranked(spark):
    rows = sample(5)
    got = sorted(tuple(r) for r in search(frame(spark, rows), 10, HUNDREDTH, rerank=1.0).collect())
    want = brute_search(rows, 10)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-14)


def test_repeated_query_ids_are_asked_once(spark):
    """Of vectors with one id the one of least bytes asks, in every shard; the others are no candidates of it either."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).astype(np.float32)
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)] + [(100, [float(c) for c in -x[100]], 0)]
    least = min(x[100].astype("<f4").tobytes(), (-x[100]).astype("<f4").tobytes())
    found = [tuple(r) for r in search(frame(spark, rows), 5, HUNDREDTH, rerank=1.0).where("query_id = 100").orderBy("rank").collect()]
    want = sorted((float(np.sqrt(((x[i].astype(float) - np.frombuffer(least, "<f4")) ** 2).sum())), i) for i in range(3000) if i != 100)[:5]
    assert [f[2] for f in found] == [i for _, i in want] and [f[1] for f in found] == [1, 2, 3, 4, 5]


def test_recall_of_the_registered_query(spark):
    from tessera.llm.queries import op6_permutation_index

    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    want = {(q, i) for q, _, i, _ in brute_search([(r.vec_id, list(r.embedding), 0) for r in rows if r.embedding is not None], 10, 64)}
    got = {(r.query_id, r.vec_id) for r in op6_permutation_index(spark, "/root/testdata/sf0.01").collect()}
    assert len(got & want) / len(want) >= 0.95


def test_search_recall(spark):
    rng = np.random.default_rng(8)
    rows = [(int(i), [float(np.float32(c)) for c in v], 0) for i, v in enumerate(unit(rng.standard_normal((6000, 16))))]
    got = {tuple(r)[::2] for r in search(frame(spark, rows), 10, HUNDREDTH).select("query_id", "rank", "vec_id").collect()}
    want = {w[::2][:2] for w in brute_search(rows, 10)}
    assert len(got & want) / len(want) >= 0.9
    assert search(frame(spark, []), 10, HUNDREDTH).count() == 0
    assert search(frame(spark, odd_rows()), 10, HUNDREDTH).count() == 0
    assert search(frame(spark, rows[:3]), 10, HUNDREDTH).count() == 2
