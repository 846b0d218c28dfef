"""SimHash near-duplicates by meeting in the middle: fingerprints meet at variants within half the radius."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batch, connected_components, discard, local_forest, map_arrow, parts, pieces, saved

BITS, RADIUS = 64, 3
WORDS_PER_SHINGLE, SEED = 3, 42
#: Bytes of a text that are split into words at a time.
BLOCK = 1 << 20
#: Fingerprints that a shard is home to, about; the number of leading bits that name a shard follows from it.
SHARD = 1024
MOST_SHARD_BITS = 24
#: Fingerprints of a shard whose variants are made at once.
FULL = 1 << 16


def blocks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw``, in lists of about BLOCK bytes cut at white space."""
    at = 0
    while at < len(raw):
        to = at + BLOCK
        while to < len(raw) and raw[to] not in b" \t\n\v\f\r":
            to += 1
        yield raw[at:to].split()
        at = to


def fingerprint(text: str | None) -> int:
    """A bit is set if it is set in over half the XXH64 of the word shingles, repeats included."""
    import xxhash

    digest = xxhash.xxh64_digest
    ones, n, tail = np.zeros(BITS, dtype=np.int64), 0, []
    for words in blocks((text or "").encode().lower()):
        words = tail + words
        tail = words[-(WORDS_PER_SHINGLE - 1) :]
        shingles = [*map(b" ".join, zip(words, words[1:], words[2:]))]
        if shingles:
            hashes = b"".join([digest(x, SEED) for x in shingles])
            ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
            n += len(shingles)
    if not n and tail:
        ones, n = np.unpackbits(np.frombuffer(digest(b" ".join(tail), SEED), np.uint8)).astype(np.int64), 1
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(key, fp[, carry]): the fingerprint of each row's whole text as a signed long; a null text has no words, so zero."""
    keep = [key, *([carry] if carry else [])]

    def run(batches):
        for part in pieces(batches, text):
            fps = np.array([fingerprint(x) for x in part.column(text).to_pylist()], dtype=np.uint64)
            yield arrow_batch([*((c, part.schema.field(c).type) for c in keep), ("fp", pa.int64())], [*(part.column(c) for c in keep), pa.array(fps.view(np.int64))])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(docs.select(*keep, text), run, f"{kinds}, fp long")


# Two fingerprints x, y at 1 to 3 differing bits share a variant z with d(x, z) + d(y, z) = d(x, y). It is enough to look
# at these meeting points, of which every such pair has one:
#   1 or 3 bits: one of the two, say y, has odd parity. x meets at itself with one bit flipped. y meets at itself (1 bit),
#     or with two bits flipped (3 bits); of any three bits two lie in the same half of the word, so flips of two bits in
#     one half are enough.
#   2 bits: both have the same parity, and meet at one flipped bit of either.
# So a fingerprint of even parity emits its 64 variants at one bit, and one of odd parity itself, those 64, and the 992
# at two bits of one half: 560 on average, where all within two bits are 2,081.
# At an odd z, every two of (even x at one bit, y = z) and (y at two bits) are within the radius if one of the two is at
# most one bit away; so all link to such a member, the anchor. At an even z all are odd y at one bit, and link. Links
# made this way number less than the variants, however many fingerprints meet, and leave no pair's component apart.


def variants_within(own: np.ndarray, fixed: int, flips: int, free: np.ndarray, half: int | None) -> np.ndarray:
    """Each of ``own`` with ``fixed`` flipped and every set of ``flips`` bits of ``free`` besides; rows by fingerprint.

    ``half``: 0 or 1 if a bit of that half is flipped in ``fixed`` and the other must be of the same half.
    """
    start = own[:, None] ^ np.uint64(fixed)
    if flips == 0:
        return start
    one = free if half is None else free[(free >= BITS // 2) == bool(half)]
    if flips == 1:
        masks = np.uint64(1) << one.astype(np.uint64)
    else:
        i, j = np.triu_indices(len(free), 1)
        same = (free[i] >= BITS // 2) == (free[j] >= BITS // 2)
        masks = (np.uint64(1) << free[i][same].astype(np.uint64)) | (np.uint64(1) << free[j][same].astype(np.uint64))
    return start ^ masks[None, :]


def parity(x: np.ndarray) -> np.ndarray:
    return (np.bitwise_count(x) & 1).astype(bool)


def shard_pairs(fps: np.ndarray, shard: int, bits: int) -> np.ndarray:
    """Links (n x 2) found at the variants whose leading ``bits`` are ``shard``, among fingerprints that reach it."""
    if len(fps) < 2:
        return np.empty((0, 2), dtype=np.uint64)
    top = fps >> np.uint64(BITS - bits) if bits else np.zeros_like(fps)
    away = top ^ np.uint64(shard)
    odd = parity(fps)
    free = np.arange(BITS - bits)
    near: list[tuple[np.ndarray, np.ndarray]] = []
    far: list[tuple] = []
    for d in np.unique(away):
        fixed, k = int(d) << (BITS - bits), int(d).bit_count()
        of = away == d
        if k == 0:
            near.append((fps[of & odd], fps[of & odd][:, None]))
        if k <= 1:  # one flipped bit, of either parity
            near.append((fps[of], variants_within(fps[of], fixed, 1 - k, free, None)))
        where = [BITS - bits + b for b in range(bits) if int(d) >> b & 1]
        if k == 2 and (where[0] >= BITS // 2) != (where[1] >= BITS // 2):
            continue
        own = fps[of & odd]
        far.append((own, fixed, 2 - k, int(where[0] >= BITS // 2) if k == 1 else None))
    if not near:  # all are two bits away, and no two of them meet here within the radius
        return np.empty((0, 2), dtype=np.uint64)
    z = np.concatenate([v.ravel() for _, v in near])
    who = np.concatenate([np.repeat(f, v.shape[1]) for f, v in near])
    order = np.lexsort((who, z))
    z, who = z[order], who[order]
    first = np.ones(len(z), dtype=bool)
    first[1:] = z[1:] != z[:-1]
    start = np.flatnonzero(first)
    anchor = who[start][np.cumsum(first) - 1]
    found = [np.stack([anchor, who], axis=1)[~first]]
    anchors, their = z[start], who[start]
    filled = np.zeros(1 << 20, dtype=bool)  # most variants meet nobody
    filled[_slot(anchors)] = True
    for own, fixed, flips, half in far:
        for at in range(0, len(own), 2048):
            some = own[at : at + 2048]
            variants = variants_within(some, fixed, flips, free, half)
            flat = variants.ravel()
            maybe = np.flatnonzero(filled[_slot(flat)])
            k = np.searchsorted(anchors, flat[maybe])
            hit = np.flatnonzero((k < len(anchors)) & (anchors[np.minimum(k, len(anchors) - 1)] == flat[maybe]))
            found.append(np.stack([their[k[hit]], some[maybe[hit] // variants.shape[1]]], axis=1))
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    apart = np.bitwise_count(pairs[:, 0] ^ pairs[:, 1])
    return pairs[(apart > 0) & (apart <= RADIUS)]


def shard_links(fps: np.ndarray, shard: int, bits: int):
    """:func:`shard_pairs` of a shard in parts: one of more than FULL fingerprints, as where many texts are alike, is
    halved by its next leading bit until its parts fit, so that memory goes with FULL and not with the fullest shard."""
    if len(fps) <= FULL or bits >= BITS // 2:
        yield shard_pairs(fps, shard, bits)
        return
    top = fps >> np.uint64(BITS - bits - 1)
    for half in (2 * shard, 2 * shard + 1):
        yield from shard_links(fps[np.bitwise_count(top ^ np.uint64(half)) <= 2], half, bits + 1)


def _slot(z: np.ndarray) -> np.ndarray:
    return ((z * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)


def link_fingerprints(distinct: DataFrame, fp: str = "fp") -> DataFrame:
    """(a, b): links whose components are those of all pairs of distinct fingerprints at RADIUS or fewer differing bits.

    Fingerprints are dealt out by the leading bits of their variants, so that a shard holds all that meet in it: one goes
    to its own shard and to those at one or two flipped leading bits. There the variants are made, met and verified.
    """
    spark = distinct.sparkSession
    total = distinct.count()
    bits = 0
    while bits < MOST_SHARD_BITS and total >> bits > SHARD:
        bits += 1
    masks = [0] + [1 << i for i in range(bits)] + [1 << i | 1 << j for i in range(bits) for j in range(i)]
    own = distinct.select(F.col(fp).cast("long").alias("fp"))
    top = F.shiftrightunsigned(own.fp, BITS - bits) if bits else F.lit(0).cast("long")
    dealt = own.select("fp", F.explode(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), lambda m: m.bitwiseXOR(top))).alias("shard"))

    def run(batches):
        held: list[np.ndarray] = []
        shard = None

        def flush():
            for pairs in shard_links(np.unique(np.concatenate(held)), shard, bits) if held else ():
                if not len(pairs):
                    continue
                edges = np.array(local_forest(pairs.view(np.int64).tolist()), dtype=np.int64)
                yield arrow_batch([("a", pa.int64()), ("b", pa.int64())], [pa.array(edges[:, 0]), pa.array(edges[:, 1])])

        for batch in batches:
            fps, shards = batch.column("fp").to_numpy().view(np.uint64), batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(shards)) + 1
            for part, s in zip(np.split(fps, cuts), shards[np.concatenate([[0], cuts])] if len(shards) else [], strict=False):
                if s != shard:
                    yield from flush()
                    held, shard = [], int(s)
                held.append(part)
        yield from flush()

    n = parts(spark, min(1 << bits, 4 * parts(spark)))
    return map_arrow(dealt.repartition(n, "shard").sortWithinPartitions("shard"), run, "a long, b long")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay if one document of each component does: the one of the smallest key, of equal keys
    the one whose text has the least hash. Rows alike in key and text are one document."""
    hashed = docs.withColumn("__hash", F.xxhash64(text))
    found = near_duplicates(hashed.select(key, text, "__hash"), key, text, carry="__hash")
    least = F.min(F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("k"), F.col("__hash").alias("h"))).alias("s")
    stay = saved(found.groupBy("component").agg(least).select("s.k", "s.h"), "stay")
    rows = hashed.join(stay, hashed[key].eqNullSafe(stay.k) & (hashed["__hash"] == stay.h), "left_semi")
    return rows.dropDuplicates([key, "__hash"]).drop("__hash")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", carry: str | None = None) -> DataFrame:
    """(key, fingerprint, component_id[, component, carry]) for each row of ``docs``.

    Fingerprints link at RADIUS or fewer differing bits, and a component is all that links reach; its id is the smallest
    key in it. Rows of the same fingerprint are one node, whatever their number, and the null, empty and wordless texts
    are all of fingerprint zero, which links as any other. Null keys name no component: theirs is the smallest other
    key, or null. Repeated rows come out as often as they come in; no rows give none; other columns are left. ``component`` is the component's least fingerprint.
    """
    own = saved(fingerprints(docs, key, text, carry), "fingerprints")
    nodes = saved(own.groupBy("fp").agg(F.min(key).alias("least")), "nodes")
    edges = saved(link_fingerprints(nodes), "links")
    member = connected_components(edges)
    joined = saved(nodes.join(member, nodes.fp == member.node).select("fp", "least", "component"), "members")
    least = joined.groupBy("component").agg(F.min("least").alias("component_least"))
    named = joined.join(least, "component").select("fp", F.col("component_least").alias("other"), "component")
    names = saved(nodes.join(named, "fp", "left").select("fp", F.coalesce("other", "least").alias("component_id"), F.coalesce("component", "fp").alias("component")), "names")
    discard(nodes, edges, joined)
    return own.join(names, "fp").select(key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", *(["component", carry] if carry else []))
