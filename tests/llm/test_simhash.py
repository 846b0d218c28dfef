import random
import re

import numpy as np
import pytest
import xxhash

from tessera.llm import simhash
from tessera.llm.common import connected_components, local_forest
from tessera.llm.simhash import RADIUS, fingerprint, near_duplicates


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def test_fingerprint(monkeypatch):
    texts = [None, "", " \t", "One", "one TWO", "Ünder A\tb\nc\x0bd\x0ce É é", "a b c " * 50, "x\x1cy \x85z w"]
    assert [fingerprint(x) for x in texts] == [slow_fingerprint(x) for x in texts]
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [fingerprint(x) for x in texts] == [slow_fingerprint(x) for x in texts]


def close_fingerprints(rng, n=60):
    found = set()
    for _ in range(n):
        x = rng.getrandbits(64)
        found.add(x)
        for _ in range(rng.randint(0, 12)):
            y = x
            for i in rng.sample(range(64), rng.randint(1, 4)):
                y ^= 1 << i
            found.add(y)
            if rng.random() < 0.3:
                x = y
    return sorted(found)


@pytest.mark.parametrize("bits", [0, 1, 3, 6])
def test_shards_find_every_component(bits):
    fps = close_fingerprints(random.Random(bits))
    true = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= RADIUS]
    masks = [0] + [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i)]
    found = []
    for shard in range(1 << bits):
        own = [x for x in fps if ((x >> (64 - bits)) ^ shard) in masks]
        found += simhash.shard_pairs(np.array(own, dtype=np.uint64), shard, bits).tolist()
    assert all((x ^ y).bit_count() <= RADIUS for x, y in found)
    assert dict(local_forest(true)) == dict(local_forest([tuple(p) for p in found]))


def test_full_shards_are_halved(monkeypatch):
    monkeypatch.setattr(simhash, "FULL", 8)
    rng = random.Random(3)
    lead = rng.getrandbits(64)
    fps = sorted({(lead & ~((1 << 30) - 1)) | x & ((1 << 30) - 1) for x in close_fingerprints(rng)} | set(close_fingerprints(rng, 10)))
    found = [pairs.tolist() for pairs in simhash.shard_links(np.array(fps, dtype=np.uint64), 0, 0)]
    assert len(found) > 1
    true = [(x, y) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= RADIUS]
    assert dict(local_forest(true)) == dict(local_forest([tuple(p) for part in found for p in part]))


def test_a_shard_of_far_fingerprints_links_nothing():
    far = np.array([0b11 << 60 | x for x in (1, 2, 4)], dtype=np.uint64)  # two of the four leading bits away from shard 0
    assert len(simhash.shard_pairs(far, 0, 4)) == 0


def test_components(spark):
    rng = random.Random(1)
    pairs = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(500, 560)] + [(7, 7), (None, 3)]
    true = dict(local_forest([p for p in pairs if None not in p and p[0] != p[1]]))
    ends = {x for p in pairs if None not in p and p[0] != p[1] for x in p}
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: true.get(x, x) for x in ends}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 8)
    rng = random.Random(4)
    base = [" ".join(rng.choice("alpha Beta gamma delta epsilon zeta eta theta".split()) + str(rng.randint(0, 99)) for _ in range(150)) for _ in range(12)]
    rows = [(100 - i, t) for i, t in enumerate(base)]
    for i in range(60):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "new" + str(rng.randint(0, 9))
        rows.append((200 + i, " ".join(words)))
    rows += [(300, None), (5, ""), (301, "  "), (None, base[0]), (90, base[10]), (90, base[10])]
    fps = [fingerprint(t) for _, t in rows]
    links = [(x, y) for x in set(fps) for y in set(fps) if x > y and (x ^ y).bit_count() <= RADIUS]
    root = dict(local_forest(links))
    least = {}
    for (d, _), f in zip(rows, fps):
        if d is not None:
            least[root.get(f, f)] = min(d, least.get(root.get(f, f), d))
    want = sorted(((d, f"{f:016x}", least[root.get(f, f)]) for (d, _), f in zip(rows, fps)), key=str)
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, fp int, component_id string")
    assert sorted((tuple(r) for r in near_duplicates(df).collect()), key=str) == want
    assert len(links) > 5
    assert near_duplicates(df.limit(0)).count() == 0
