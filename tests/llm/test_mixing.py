import random
import re

from tessera.llm.mixing import BITS, CLOSE, LEVELS, mix, mixed, targets

SCHEMA = "doc_id long, text string, source string, place int, size string"


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    """Raise a common level until the total is reached, in small steps of the exact rule: share, cap, share again."""
    names = sorted(x for x in sizes if x is not None) + ([None] if None in sizes else [])
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    low, high = 0.0, 10.0 * total + 1
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * weight[x], 2 * sizes[x]) for x in names) < total else (low, mid)
    return {x: min(high * weight[x], 2 * sizes[x]) for x in names}


def rows(seed, n=900):
    rng = random.Random(seed)
    pick = lambda: rng.choice(["a", "a", "a", "b", "c", "d", None, "Z", "é"])
    out = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 60))), pick()) for i in range(n)]
    return out + [(n, None, "a"), (None, "x y", "b"), (n + 1, "", "only-empty"), (n + 2, " \t\n\x0b", "b"), (n + 3, "k", "tiny")]


def frame(spark, data):
    return spark.createDataFrame([(*r, 1, "s") for r in data], SCHEMA)


def test_targets(spark):
    for seed in range(5):
        rng = random.Random(seed)
        sizes = {x: rng.randint(0, 1000) for x in [*"abcdefg"[: rng.randint(1, 7)], None]}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
        got, want = {r.source: r.target for r in targets(df, (3, 1, 2), 1.5, 2.0).collect()}, brute_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-6 * (1 + want[x]) for x in sizes)


def brute_copies(own, target):
    """Copies of a source's documents (place, size), its documents walked in the order of their hashes."""
    whole = sum(n for _, n in own)
    base = min(int(target // whole), 2) if whole else 0
    left, since, taken = target - base * whole, 0, set()
    rest = left
    while rest > (target * CLOSE if taken or since else 0):
        fit = sorted((p % (1 << 64) >> (64 - BITS * LEVELS), p, n) for p, n in own if n <= rest and p % (1 << 64) >> (64 - BITS * LEVELS) >= since)
        if not sum(n for _, _, n in fit):
            break
        budget, since = rest, 1 << BITS * LEVELS
        for top, p, n in fit:
            if n > rest:
                since = top + 1
                break
            taken.add(p)
            rest -= n
        assert rest <= budget
    near = min(((abs(n - rest), p) for p, n in own if p not in taken and abs(n - rest) < rest), default=None)
    return {p: base + (p in taken or near is not None and p == near[1]) for p, _ in own}


def test_taken_set_against_brute_force(spark):
    """With long documents among short ones, so that some stand in the way at a threshold; and one very long text."""
    rng = random.Random(4)
    data = [(i, " ".join(["w"] * rng.choice([1, 3, 10, 10, 10, 400, 5000])), rng.choice("abc")) for i in range(400)]
    data += [(i, t, s) for i, t, s in rows(5, 200) if i is None or i < 0] + [(900, "word " * 300_000, "d"), (901, "x y", "d")]
    got = mix(frame(spark, data).repartition(5)).collect()
    for s in "abcd":
        own = [r for r in got if r.source == s]
        want = brute_copies([(r.place, r["size"]) for r in own], own[0].target)
        assert {r.place: r.copies for r in own} == want
        if s != "d":
            assert abs(sum(r.taken for r in own) - own[0].target) <= 0.01 * own[0].target


def test_many_sources(spark):
    data = [(i, "a b c", f"host{i % 700}") for i in range(1400)]
    got = mix(frame(spark, data).repartition(7)).collect()
    want = brute_targets({f"host{i}": 6 for i in range(700)})
    assert all(abs(r.target - want[r.source]) < 1e-6 for r in got) and len(got) == 1400


def test_mix(spark):
    data = rows(1)
    got = mix(frame(spark, data).repartition(5)).collect()
    assert sorted((r.doc_id, r.source, r["size"]) for r in got if r.doc_id is not None and r.source) == sorted((d, s, size(t)) for d, t, s in data if d is not None and s)
    sizes = {}
    for _, t, s in data:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = brute_targets(sizes)
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert all(r.source_size == sizes[s] and abs(r.target - want[s]) < 1e-6 * (1 + want[s]) for r in own)
        taken = sum(r.taken for r in own)
        assert abs(taken - want[s]) <= max(2, 0.01 * want[s]), (s, taken, want[s])
    assert all(r.taken == r.copies * r["size"] <= 2 * r["size"] for r in got)
    again = mix(frame(spark, data[::-1]).repartition(2)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    copies = mixed(frame(spark, data)).collect()
    assert len(copies) == sum(r.copies for r in got) and copies[0].asDict().keys() == {"doc_id", "text", "source", "place", "size"}


def test_cases(spark):
    assert mix(frame(spark, [])).count() == 0
    assert [r.taken for r in mix(frame(spark, [(1, None, None)])).collect()] == [0]
    same = [(1, "a b c", "x")] * 6
    assert len({r.taken for r in mix(frame(spark, same)).collect()}) == 1
