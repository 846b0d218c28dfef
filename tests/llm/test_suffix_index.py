import hashlib
import random
import zlib

import numpy as np
import pytest

from tessera.llm import suffix_index
from tessera.llm.common import scratch_path
from tessera.llm.suffix_index import LENGTH, Family, Matches, SuffixIndex, Suffixes, remove_repeats, text_suffixes

SCHEMA = "doc_id long, text string, source string, sum string"


def digest(text):
    raw = hashlib.md5(text.encode()).digest()
    return int.from_bytes(raw[:8], "little"), int.from_bytes(raw[8:], "little")


def brute(rows):
    """By position in order: a byte goes if a string of LENGTH bytes over it was seen at a smaller position."""
    last = (2**63 - 1) if not any(isinstance(d, str) for d, _ in rows) else "\U0010ffff"
    own = lambda d: d if d is not None else last
    texts = sorted({(own(d), t or "") for d, t in rows}, key=lambda x: (x[0], digest(x[1])))
    seen, out = set(), {}
    for d, t in texts:
        raw = t.encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - LENGTH + 1):
            s = raw[i : i + LENGTH]
            if s in seen:
                gone[i : i + LENGTH] = b"\1" * LENGTH
            seen.add(s)
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d, t] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return sorted(((d, *out[own(d), t or ""]) for d, t in rows), key=str)


def got(spark, rows, schema=SCHEMA, **more):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], schema).repartition(3)
    return sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in remove_repeats(df, **more).drop("kept_text").collect()), key=str)


def corpus(seed, n=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 9)))
    shared = ["".join(word() for _ in range(k)) for k in (8, 14, 20, 40, 90)]
    line = "x" * 30 + shared[0][:40]
    rows = []
    for i in range(n):
        parts = [rng.choice([lambda: rng.choice(shared), lambda: "".join(word() for _ in range(30)), lambda: rng.choice(shared)[rng.randint(0, 30) :], lambda: line])() for _ in range(rng.randint(1, 6))]
        rows.append((i, "".join(parts)))
    return rows + [(n + i, rows[i][1]) for i in range(5)]


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 3), (3, 5)])
def test_against_brute_force(spark, seed, batches):
    rows = corpus(seed)
    assert got(spark, rows, batches=batches) == brute(rows)


@pytest.mark.parametrize("wide,flood", [(2, 1 << 10), (1 << 15, 2), (1, 1)])
def test_anchors_that_are_dealt_out_again(spark, monkeypatch, wide, flood):
    """By a second anchor, and then by strings; also those that only a later batch makes wide."""
    monkeypatch.setattr(suffix_index, "WIDE", wide)
    monkeypatch.setattr(suffix_index, "FLOOD", flood)
    rows = corpus(4)
    assert got(spark, rows, batches=3) == brute(rows)


def test_an_anchor_with_very_many_contexts(monkeypatch):
    """One gram in 100,000 contexts leaves its shard, a task holds no more of it than WIDE allows, and nothing is lost."""
    monkeypatch.setattr(suffix_index, "WIDE", 1 << 12)
    rng = np.random.default_rng(1)
    n = 100_000
    m = rng.integers(97, 123, (n, suffix_index.WIDTH), dtype=np.uint8)
    m[:, suffix_index.BACK : suffix_index.BACK + suffix_index.K] = 120
    m[n // 2 :] = m[: n - n // 2]
    e = np.zeros(n, dtype=suffix_index.ENTRY)
    e["doc"], e["count"], e["offset"] = np.arange(n), suffix_index.SPAN, suffix_index.BACK
    family, leaving = Family(most=1 << 12), 0
    for at in range(0, n, 10_000):
        family.add(Suffixes(e, m).take(np.arange(at, at + 10_000)))
        leaving += sum(map(len, family.leaving))
        family.leaving.clear()
        assert sum(map(len, family.levels)) <= 1 << 13
    assert leaving == n
    found = Matches(Suffixes(e, m))
    assert sorted(found.whole.tolist()) == list(range(n // 2, n)) and not len(found.entry)


def test_cases(spark):
    rows = [(1, None), (None, "abc" * 60), (2, ""), (3, "short"), (4, "ab" * 200), (5, "q" * 99), (6, "q" * 100), (7, "q" * 101), (8, "ab" * 200), (8, "ab" * 200), (8, "other" * 30), (None, None)]
    rows += [(9, "\0" * 150), (10, "a" + "\0" * 120), (11, "\0" * 130 + "b")]
    assert got(spark, rows) == brute(rows)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_null_and_repeated_ids_with_checksums_alike(spark):
    """Two texts of one id whose crc32 agree: the four bytes that make it so are computed."""
    rng = random.Random(9)
    word = lambda n: "".join(chr(rng.randint(97, 122)) for _ in range(n))
    tail, heads = word(300), {}
    while True:
        head = word(6)
        sum_ = zlib.crc32((head + tail).encode()) & 0xFFFFF  # alike in 20 bits is soon found, and told apart by more
        if sum_ in heads:
            break
        heads[sum_] = head
    a, b = heads[sum_] + tail, head + tail
    rows = [(None, a), (None, b), (5, word(50)), (7, "1" + tail), (7, "2" + tail), (7, "2" + tail)]
    assert got(spark, rows) == brute(rows)
    out = {(r[0], r[4] == hashlib.sha256((t or "").encode()).hexdigest()) for r in got(spark, rows[:2]) for t in (a, b)}
    assert len(out) >= 1 and sum(r[2] for r in got(spark, rows[:2])) == 300


def test_keys_of_other_types(spark):
    rows = [("b", "z" * 20 + "hello world " * 20), ("a", "hello world " * 20), (None, "hello world " * 20), ("c", None)]
    assert got(spark, rows, "doc_id string, text string, source string, sum string") == brute(rows)


def test_long_texts_across_blocks(spark):
    rng = random.Random(5)
    long = "".join(chr(rng.randint(97, 122)) for _ in range(1_300_000))
    rows = [(1, long), (2, "zz" + long[520_000:1_100_000] + "yy"), (3, long[:150])]
    assert got(spark, rows) == brute(rows)


def entries(texts, first=0):
    return Suffixes.joined([s for s, _ in text_suffixes((first + i, b"", t.encode()) for i, t in enumerate(texts))])


def test_family_levels_at_least_double():
    family = Family()
    texts = [t for _, t in corpus(7, 64)]
    for i in range(0, 64, 4):
        family.add(entries(texts[i : i + 4], i))
        sizes = [len(x) for x in family.levels]
        assert all(a > b for a, b in zip(sizes, sizes[1:]))
        for level in family.levels:  # in the order of their bytes
            rows = [bytes(r) for r in level.m[:, suffix_index.BACK :]]
            assert rows == sorted(rows)


def test_levels_are_kept_and_met_by_later_batches(spark, monkeypatch):
    """An index opened again holds new texts against the stored levels, and keeps no more files than it names."""
    rows = corpus(8)
    folder = scratch_path(spark, "index")
    spans: dict = {}
    for i in range(4):
        index = SuffixIndex(spark, folder, 3) if i == 0 else SuffixIndex.open(spark, folder)
        part = [(d, b"", t) for d, t in rows if d % 4 == i]
        for r in index.add(spark.createDataFrame(part, "doc long, sum binary, text string")).collect():
            spans.setdefault(r.doc, []).append(np.frombuffer(bytes(r.spans), "<u4").reshape(-1, 2).astype(np.int64))
    named = {bytes(r.payload).decode() for r in index.manifest.where("kind = 0").collect()}
    store, path = suffix_index.file_system(folder)
    from pyarrow import fs

    assert named == {x.base_name for x in store.get_file_info(fs.FileSelector(f"{path}/levels"))}
    for d, _, n_removed, n_spans, *_ in brute(rows):
        pairs = np.concatenate(spans.get(d, [np.empty((0, 2), np.int64)]))
        start, end = suffix_index.merged_spans(pairs[:, 0], pairs[:, 1])
        assert (n_removed, n_spans) == (int((end - start).sum()), len(start))
    index.close()
