"""Removal of long repeats by a logarithmic family of sparse suffix arrays, kept in shared storage.

A suffix array of every byte would take several times the corpus, so only suffixes at *anchors* are kept. Every string of
LENGTH bytes has an anchor: of its K-byte grams the one of least hash, the leftmost of equals. A run is a stretch of start
positions whose strings have the same anchor; equal strings have equal anchors at equal places, so it is enough to hold
runs of one gram against each other. A suffix stands for a run: it is the run's bytes, aligned at the anchor, ordered by
the bytes from the anchor on. The bytes before it are ordered backwards beside it, so that for every string of a run its
equals are one class of the forward order (common prefix) and one of the backward order (common suffix). All comparing is
of bytes; hashes only choose anchors and deal them out.

Suffixes are dealt to shards by anchor. A shard's family holds suffix arrays (levels) whose sizes at least double from one
to the next. A new batch is ordered, merge-scanned against every level for strings that both hold, and becomes a level;
levels not larger than it are merged into it on the way. Levels are files in the shared folder, listed by a manifest, and
the next batch of documents meets them there. Anchors with more different runs than WIDE leave their shard and are dealt
out again by a second anchor, and should that be as common, string by string.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batch, delete_folder, discard, file_system, hadoop_path, map_arrow, parts, pieces, saved, scratch_path, written

LENGTH, K = 100, 20
SPAN = LENGTH - K + 1
#: Bytes before an anchor that a string may have, and bytes of a suffix in all.
BACK, WIDTH = LENGTH - K, 2 * LENGTH - K
#: Bytes that are cut into runs at a time; positions in them take 20 bits of a sort key.
BLOCK = (1 << 20) - 2 * LENGTH
#: Suffixes that a map task orders before it sends them on; suffixes of a shard, about; suffixes of a shard's batch.
HELD, SHARD, BATCH = 1 << 18, 1 << 17, 1 << 17
#: Different runs of an anchor that a level may hold, and that a map task sends to one shard.
WIDE, FLOOD = 1 << 15, 1 << 10
#: How often an anchor may be dealt out again: by a second anchor, then by whole strings, which no longer differ.
DEPTHS = 3
#: Document ids with several texts are found by so many hash slots; their texts are told apart by a 128-bit digest.
SLOTS = 1 << 20

_rng = np.random.default_rng(20)
_letters = _rng.integers(1, 2**64, 256, dtype=np.uint64)
_base = np.uint64(0x9E3779B97F4A7C15)
_back = np.uint64(pow(int(_base), -1, 1 << 64))
_tables: dict[str, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    if not _tables:
        _tables["up"], _tables["down"] = _powers(_base, BLOCK + 2 * LENGTH), _powers(_back, BLOCK + 2 * LENGTH)
    return _tables["up"], _tables["down"]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of each stretch of ``size`` bytes, the same wherever it stands."""
    up, down = _power_tables()
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_letters[data] * up[: len(data)], out=sums[1:])
    n = max(0, len(data) - size + 1)
    return mixed((sums[size : size + n] - sums[:n]) * down[:n])


def cut_runs(data: np.ndarray, owner: np.ndarray, avoid: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Runs of ``data``, where ``owner`` is the text of each byte: start, number of strings, place and hash of the anchor.
    Strings across two texts are left out. ``avoid`` names, by owner, a gram that is an anchor only where there is no other."""
    none = np.empty(0, dtype=np.int64)
    if len(data) < LENGTH:
        return none, none, none, none.astype(np.uint64)
    hashes = gram_hashes(data, K)
    if avoid is not None:
        hashes[hashes == avoid[owner[: len(hashes)]]] = np.uint64(2**64 - 1)
    low = np.uint64((1 << 20) - 1)
    best = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while 2 * reach <= SPAN:
        best = np.minimum(best[:-reach], best[reach:])
        reach *= 2
    if reach < SPAN:
        best = np.minimum(best[: len(best) - (SPAN - reach)], best[SPAN - reach :])
    anchor = (best & low).astype(np.int64)
    at = np.flatnonzero(owner[: len(data) - LENGTH + 1] == owner[LENGTH - 1 :])
    if not len(at):
        return none, none, none, none.astype(np.uint64)
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(anchor[at]) != 0)
    first = np.flatnonzero(new)
    start, count = at[first], np.diff(np.append(first, len(at)))
    return start, count, anchor[start], hashes[anchor[start]]


# --- suffixes: a record of where each is, and a row of bytes around its anchor ---------------------------------------

#: doc and the halves of its text's digest name a text; ``offset`` is the anchor's distance from the run's start.
ENTRY = np.dtype([("doc", "<i8"), ("h1", "<u8"), ("h2", "<u8"), ("start", "<u4"), ("count", "u1"), ("offset", "u1")])


class Suffixes:
    """Records and, for each, WIDTH bytes around the anchor; bytes outside the run are zero."""

    def __init__(self, e: np.ndarray | None = None, m: np.ndarray | None = None, name: str = ""):
        self.name = name  # of the file that holds them, if one does
        self.e = np.empty(0, dtype=ENTRY) if e is None else e
        self.m = np.empty((0, WIDTH), dtype=np.uint8) if m is None else m

    def __len__(self) -> int:
        return len(self.e)

    def take(self, at: np.ndarray) -> Suffixes:
        return Suffixes(self.e[at], self.m[at])

    @staticmethod
    def joined(some: list[Suffixes]) -> Suffixes:
        return Suffixes(np.concatenate([s.e for s in some]), np.concatenate([s.m for s in some])) if some else Suffixes()

    def grams(self) -> np.ndarray:
        """Hashes of the anchors' grams."""
        up, _ = _power_tables()
        return mixed((_letters[self.m[:, BACK : BACK + K]] * up[:K]).sum(axis=1, dtype=np.uint64))


def inside(e: np.ndarray) -> np.ndarray:
    """Which bytes of the rows are the run's."""
    at, offset = np.arange(WIDTH), e["offset"].astype(np.int64)[:, None]
    return (at >= BACK - offset) & (at < BACK - offset + e["count"].astype(np.int64)[:, None] + LENGTH - 1)


def around(data: np.ndarray, anchor: np.ndarray, e: np.ndarray) -> np.ndarray:
    """The rows of runs of ``data`` whose anchors are at ``anchor``."""
    padded = np.concatenate([np.zeros(BACK, dtype=np.uint8), data, np.zeros(WIDTH, dtype=np.uint8)])
    rows = np.lib.stride_tricks.sliding_window_view(padded, WIDTH)[anchor]
    return np.multiply(rows, inside(e), out=rows) if rows.flags.writeable else rows * inside(e)


def packed(s: Suffixes) -> bytes:
    """Column by column and then the runs' bytes, compressed."""
    import zstandard

    columns = [np.ascontiguousarray(s.e[n]).tobytes() for n in ENTRY.names]
    return len(s).to_bytes(4, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join([*columns, s.m[inside(s.e)].tobytes()]))


def unpacked(raw: bytes) -> Suffixes:
    import zstandard

    n, at = int.from_bytes(raw[:4], "little"), 0
    raw = zstandard.ZstdDecompressor().decompress(raw[4:])
    e = np.empty(n, dtype=ENTRY)
    for name in ENTRY.names:
        step = ENTRY[name].itemsize * n
        e[name] = np.frombuffer(raw[at : at + step], dtype=ENTRY[name])
        at += step
    m = np.zeros((n, WIDTH), dtype=np.uint8)
    m[inside(e)] = np.frombuffer(raw[at:], dtype=np.uint8)
    return Suffixes(e, m)


# --- order and matches ------------------------------------------------------------------------------------------------


def words_of(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian words, so that words compare as the bytes do."""
    wide = -(-rows.shape[1] // 8) * 8
    padded = np.zeros((len(rows), wide), dtype=np.uint8)
    padded[:, : rows.shape[1]] = rows
    return padded.view(">u8").astype(np.uint64)


def content_order(words: np.ndarray) -> np.ndarray:
    """The order of rows by their words; a word is looked at only among rows that agree in all before it. The first sort
    merges stretches that are in order already."""
    order = np.argsort(words[:, 0], kind="stable")
    same = words[order[1:], 0] == words[order[:-1], 0]
    for w in range(1, words.shape[1]):
        if not same.any():
            break
        tied = np.zeros(len(order), dtype=bool)
        tied[1:] |= same
        tied[:-1] |= same
        at = np.flatnonzero(tied)
        group = np.cumsum(np.concatenate([[True], ~same]))[at]
        column = words[order[at], w]
        by = np.lexsort((column, group))
        order[at], column = order[at][by], column[by]
        same = np.zeros(len(order) - 1, dtype=bool)
        same[at[1:] - 1] = (column[1:] == column[:-1]) & (group[1:] == group[:-1])
    return order


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading bytes each pair of rows has in common."""
    out = np.empty(len(a), dtype=np.int64)
    for at in range(0, len(a), 1 << 15):
        differ = a[at : at + (1 << 15)] != b[at : at + (1 << 15)]
        out[at : at + (1 << 15)] = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return out


def thinned(common: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """What each kept row of an order has in common with the kept one before it: the least of what lies between."""
    at = np.flatnonzero(keep)
    return np.minimum.reduceat(common[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1])) if len(at) else common[:0]


def _place(e: np.ndarray) -> np.ndarray:
    """The rank of each record by position: text by text in the order of documents."""
    rank = np.empty(len(e), dtype=np.int64)
    rank[np.lexsort((e["start"], e["h2"], e["h1"], e["doc"]))] = np.arange(len(e))
    return rank


def same_position(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a["doc"] == b["doc"]) & (a["h1"] == b["h1"]) & (a["h2"] == b["h2"]) & (a["start"] == b["start"])


class Matches:
    """What a set of suffixes has in common. ``order``: those to keep, by content; ``gram``: their group of equal anchors.
    ``whole``: runs that an earlier one repeats byte for byte. ``entry`` and ``start``: single strings that also start
    earlier. With ``new``, only what a new suffix has part in."""

    def __init__(self, s: Suffixes, new: np.ndarray | None = None, strings: bool = True):
        e, m = s.e, s.m
        self.whole = self.entry = self.start = np.empty(0, dtype=np.int64)
        forward = words_of(m[:, BACK:])
        order = content_order(forward)
        common = np.zeros(len(e), dtype=np.int64)
        near = np.flatnonzero((forward[order[1:], 0] == forward[order[:-1], 0]) & (forward[order[1:], 1] == forward[order[:-1], 1])) + 1
        common[near] = agreement(m[order[near - 1], BACK:], m[order[near], BACK:])
        gram = np.cumsum(common < K) - 1
        self.order, self.gram = order, gram
        size = np.bincount(gram)
        shared = size[gram] > 1
        if new is not None:
            fresh = np.bincount(gram, weights=new[order]).astype(np.int64)
            shared &= ((fresh > 0) & (fresh < size))[gram]
        at = np.flatnonzero(shared)
        if not len(at):
            return
        ids, common, group = order[at], common[at], gram[at]
        e, back = e[ids], np.ascontiguousarray(m[ids, :BACK][:, ::-1])
        new = None if new is None else new[ids]
        # from here on a suffix is its number in the forward order; ``behind`` is the backward order within each gram
        behind = content_order(np.concatenate([group.astype(np.uint64)[:, None], words_of(back)], axis=1))
        before = np.full(len(e), -1, dtype=np.int64)
        near = np.flatnonzero(group[behind[1:]] == group[behind[:-1]]) + 1
        before[near] = agreement(back[behind[near - 1]], back[behind[near]])
        place = _place(e)

        gone = self._whole_runs(e, common, behind, before, place, new, ids)
        keep = np.ones(len(order), dtype=bool)
        keep[at[gone]] = False
        self.order, self.gram = order[keep], gram[keep]
        if strings:
            self._strings(e, common, behind, before, place, new, ids, gone)

    def _whole_runs(self, e, common, behind, before, place, new, ids):
        code = np.empty(len(e), dtype=np.uint64)
        code[behind] = np.cumsum(before < BACK).astype(np.uint64)
        code = np.cumsum(common < LENGTH).astype(np.uint64) << np.uint64(40) | code << np.uint64(16) | e["offset"].astype(np.uint64) << np.uint64(8) | e["count"].astype(np.uint64)
        by = np.lexsort((place, code))
        same = np.concatenate([[False], code[by[1:]] == code[by[:-1]]])
        head = by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]
        gone = np.zeros(len(e), dtype=bool)
        gone[by[same]] = True
        self.whole = ids[by[same & ~same_position(e[head], e[by])]]
        return gone

    def _strings(self, e, common, behind, before, place, new, ids, gone):
        """A string with b bytes before its anchor is told by its class of LENGTH - b bytes on and of b bytes back."""
        ahead = np.arange(len(e))
        offset, count = e["offset"].astype(np.int64), e["count"].astype(np.int64)
        keep = ~gone
        for _ in range(2):  # without what is gone; then without what has no string in common with a neighbour
            common, before = thinned(common, keep[ahead]), thinned(before, keep[behind])
            ahead, behind = ahead[keep[ahead]], behind[keep[behind]]
            on, off = np.full(len(e), -1), np.full(len(e), -1)
            on[ahead], off[behind] = np.maximum(common, np.append(common[1:], 0)), np.maximum(before, np.append(before[1:], -1))
            least, most = np.maximum(offset - count + 1, LENGTH - on), np.minimum(offset, off)
            keep = (least <= most) & (on >= K)
        if len(ahead) < 2 or not keep.any():
            return
        in_place = ahead[np.argsort(place[ahead], kind="stable")]
        least_, most_ = least[in_place], most[in_place]
        class_on, class_off = np.empty(len(e), dtype=np.int64), np.empty(len(e), dtype=np.int64)
        entries, starts = [], []
        for b in range(int(least_.min()), int(most_.max()) + 1):
            some = in_place[(least_ <= b) & (b <= most_)]
            if len(some) < 2:
                continue
            class_on[ahead], class_off[behind] = np.cumsum(common < LENGTH - b), np.cumsum(before < b)
            code = class_on[some] << 32 | class_off[some]
            by = np.argsort(code, kind="stable")
            same = np.concatenate([[False], code[by[1:]] == code[by[:-1]]])
            if not same.any():
                continue
            if new is not None:
                head = some[by[np.maximum.accumulate(np.where(same, 0, np.arange(len(by))))]]
                same &= new[some[by]] | new[head]
            later = some[by[same]]
            entries.append(ids[later])
            starts.append(e["start"][later] + (offset[later] - b))
        if entries:
            self.entry, self.start = np.concatenate(entries), np.concatenate(starts)

    def spans(self, s: Suffixes) -> np.ndarray:
        """The bytes that both kinds of repeats cover, as records of text, start and end."""
        out = np.empty(len(self.whole) + len(self.entry), dtype=SPANNED)
        for part, ids, start, size in (
            (out[: len(self.whole)], self.whole, s.e["start"][self.whole], s.e["count"][self.whole].astype(np.int64) + LENGTH - 1),
            (out[len(self.whole) :], self.entry, self.start, LENGTH),
        ):
            for name in ("doc", "h1", "h2"):
                part[name] = s.e[name][ids]
            part["start"], part["end"] = start, start + size
        return out


SPANNED = np.dtype([("doc", "<i8"), ("h1", "<u8"), ("h2", "<u8"), ("start", "<i8"), ("end", "<i8")])


class Family:
    """The suffix arrays of a shard, largest first; each at least twice as long as the next when left in peace."""

    def __init__(self, levels: list[Suffixes] | None = None, wide: set[int] | None = None, most: int = WIDE):
        self.levels, self.wide, self.most = levels or [], wide or set(), most
        self.spans: list[np.ndarray] = []
        self.leaving: list[Suffixes] = []

    def add(self, batch: Suffixes) -> None:
        """Order ``batch``, scan it against every level, merge levels not larger than it, and keep the result."""
        batch = self._without_wide(batch)
        if not len(batch):
            return
        own = Matches(batch)
        self.spans.append(own.spans(batch))
        carried, new = batch.take(own.order), np.ones(len(own.order), dtype=bool)
        stay: list[Suffixes] = []
        for level in reversed(self.levels):
            both = Suffixes.joined([level, carried])
            fresh = np.concatenate([np.zeros(len(level), dtype=bool), new])
            found = Matches(both, fresh)
            self.spans.append(found.spans(both))
            if len(level) <= len(carried):
                carried, new = both.take(found.order), fresh[found.order]
                size = np.bincount(found.gram)
                self.wide.update(carried.take(np.flatnonzero((size > self.most)[found.gram])).grams().tolist())
            else:
                kept = np.sort(found.order[found.order >= len(level)]) - len(level)
                carried, new = carried.take(kept), new[kept]
                stay.append(level)
        self.levels = [*reversed(stay), *([carried] if len(carried) else [])]
        if len(own.gram):
            size = np.bincount(own.gram)
            self.wide.update(batch.take(own.order[(size > self.most)[own.gram]]).grams().tolist())
        self.drop_wide()

    def drop_wide(self) -> None:
        """Take the suffixes of anchors that have become wide out of all levels."""
        if self.wide:
            self.levels = [x for x in map(self._without_wide, self.levels) if len(x)]
            self.levels.sort(key=len, reverse=True)

    def _without_wide(self, s: Suffixes) -> Suffixes:
        if not self.wide or not len(s):
            return s
        wide = np.isin(s.grams(), np.fromiter(self.wide, dtype=np.uint64))
        if wide.any():
            self.leaving.append(s.take(np.flatnonzero(wide)))
            return s.take(np.flatnonzero(~wide))
        return s


def _groups(*keys: np.ndarray) -> Iterator[tuple[int, int]]:
    n = len(keys[0])
    if n:
        new = np.zeros(n, dtype=bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        cuts = [0, *np.flatnonzero(new).tolist(), n]
        yield from zip(cuts, cuts[1:])


def merged_spans(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of spans, as maximal ones."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.ones(len(start), dtype=bool)
    new[1:] = start[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return start[first], reach[np.append(first[1:], len(start)) - 1]


# --- rows between tasks -----------------------------------------------------------------------------------------------

#: Kinds of rows, in the order in which a shard reads them: stored levels, anchors that are dealt out again, suffixes. The
#: others only pass: spans found, and suffixes to be dealt out again.
LEVEL, MARK, SUFFIXES, SPANS, AGAIN = 0, 1, 2, 3, 4
SENT = "shard long, kind int, doc long, sum binary, payload binary"
SENT_ARROW = [("shard", pa.int64()), ("kind", pa.int32()), ("doc", pa.int64()), ("sum", pa.binary()), ("payload", pa.binary())]


def span_rows(spans: np.ndarray, shards: int) -> Iterator[tuple]:
    """A row for each text: its spans, merged, as pairs of unsigned 32-bit integers."""
    spans = spans[np.lexsort((spans["h2"], spans["h1"], spans["doc"]))]
    for a, b in _groups(spans["doc"], spans["h1"], spans["h2"]):
        starts, ends = merged_spans(spans["start"][a:b], spans["end"][a:b])
        h1, h2 = int(spans["h1"][a]), int(spans["h2"][a])
        name = h1.to_bytes(8, "little") + h2.to_bytes(8, "little") if h1 or h2 else b""
        yield int(spans["doc"][a]) % shards, SPANS, int(spans["doc"][a]), name, np.stack([starts, ends], axis=1).astype("<u4").tobytes()


def suffix_rows(s: Suffixes, key: np.ndarray, first: int, shards: int) -> Iterator[tuple]:
    """A row of suffixes, still in order, for each shard."""
    shard = (key % np.uint64(shards)).astype(np.int64) + first
    by = np.argsort(shard, kind="stable")
    for a, b in _groups(shard[by]):
        yield int(shard[by[a]]), SUFFIXES, None, None, packed(s.take(by[a:b]))


def _in_batches(rows, most: int = 4 << 20):
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[4] or b"") + 32
        if size >= most:
            yield arrow_batch(SENT_ARROW, [list(x) for x in zip(*held)])
            held, size = [], 0
    if held:
        yield arrow_batch(SENT_ARROW, [list(x) for x in zip(*held)])


def text_blocks(texts: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """Bytes, the owner of each, and (doc, digest, offset) by owner; long texts come in blocks that overlap by a string."""
    data: list[bytes] = []
    held, names = 0, []

    def out():
        sizes = [len(x) for x in data]
        return np.frombuffer(b"".join(data), dtype=np.uint8), np.repeat(np.arange(len(sizes), dtype=np.int32), sizes), names

    for doc, digest, raw in texts:
        for at in range(0, max(1, len(raw) - LENGTH + 1), BLOCK // 2):
            part = raw[at : at + BLOCK // 2 + LENGTH - 1]
            if held + len(part) > BLOCK:
                yield out()
                data, held, names = [], 0, []
            data.append(part)
            names.append((doc, digest, at))
            held += len(part)
    if data:
        yield out()


def _texts(batches) -> Iterator[tuple[int, bytes, bytes]]:
    for part in pieces(batches, "text"):
        yield from zip(part.column("doc").to_pylist(), part.column("sum").to_pylist(), (x.encode() for x in part.column("text").to_pylist()), strict=True)


def text_suffixes(texts: Iterator[tuple[int, bytes, bytes]]) -> Iterator[tuple[Suffixes, np.ndarray]]:
    """Suffixes of texts, a block at a time, and their anchors."""
    for data, owner, names in text_blocks(texts):
        start, count, anchor, gram = cut_runs(data, owner)
        own = owner[start]
        begins = np.searchsorted(owner, np.arange(len(names)))
        halves = np.frombuffer(b"".join(x[1] or bytes(16) for x in names), dtype="<u8").reshape(-1, 2)
        e = np.empty(len(start), dtype=ENTRY)
        e["doc"], e["h1"], e["h2"] = np.array([x[0] for x in names], dtype=np.int64)[own], halves[own, 0], halves[own, 1]
        e["start"] = start - begins[own] + np.array([x[2] for x in names], dtype=np.int64)[own]
        e["count"], e["offset"] = count, anchor - start
        yield Suffixes(e, around(data, anchor, e)), gram


def send_suffixes(batches, shards: int):
    """The suffix array of each HELD suffixes of a task, by shard. Runs that repeat another of them byte for byte stay; only
    their spans are sent. Anchors with a flood of runs are marked, and theirs go to any shard, to be passed on."""

    def flush(held):
        s, key = Suffixes.joined([x for x, _ in held]), np.concatenate([k for _, k in held])
        found = Matches(s, strings=False)
        yield from span_rows(found.spans(s), shards)
        s, key = s.take(found.order), key[found.order]
        flood = (np.bincount(found.gram) > FLOOD)[found.gram] if len(s) else np.empty(0, dtype=bool)
        if flood.any():
            for at in np.array_split(np.flatnonzero(flood), -(-int(flood.sum()) // FLOOD)):
                yield int(s.e["doc"][at[0]]) % shards, AGAIN, None, None, packed(s.take(at))
            marks = np.unique(key[flood])
            for mark in marks:
                yield int(mark % np.uint64(shards)), MARK, None, None, mark.tobytes()
            s, key = s.take(np.flatnonzero(~flood)), key[~flood]
        yield from suffix_rows(s, key, 0, shards)

    held, n = [], 0
    for s, gram in text_suffixes(_texts(batches)):
        held.append((s, gram))
        n += len(s)
        if n >= HELD:
            yield from _in_batches(flush(held))
            held, n = [], 0
    if n:
        yield from _in_batches(flush(held))


def second_runs(s: Suffixes) -> tuple[Suffixes, np.ndarray]:
    """The runs of ``s`` cut again, each by the anchor it has besides its first; with keys of both."""
    out, keys = [], []
    for at in range(0, len(s), 4096):
        some = s.take(np.arange(at, min(len(s), at + 4096)))
        grams, mask = some.grams(), inside(some.e)
        data, owner = some.m[mask], np.repeat(np.arange(len(some), dtype=np.int32), mask.sum(axis=1))
        start, count, anchor, gram = cut_runs(data, owner, grams)
        own = owner[start]
        e = some.e[own]
        e["start"] += (start - np.searchsorted(owner, np.arange(len(some)))[own]).astype(np.uint32)
        e["count"], e["offset"] = count, anchor - start
        out.append(Suffixes(e, around(data, anchor, e)))
        keys.append(mixed(grams[own] + mixed(gram)))
    return Suffixes.joined(out), np.concatenate(keys) if keys else np.empty(0, dtype=np.uint64)


def single_strings(s: Suffixes) -> tuple[Suffixes, np.ndarray]:
    """Every string of ``s`` as a run of its own, with a key of its bytes."""
    count = s.e["count"].astype(np.int64)
    of = np.repeat(np.arange(len(s)), count)
    step = np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    e = s.e[of]
    e["start"] += step.astype(np.uint32)
    e["offset"] -= step.astype(np.uint8)
    e["count"] = 1
    m = s.m[of]
    m *= inside(e)
    up, _ = _power_tables()
    at = BACK - e["offset"].astype(np.int64)
    keys = np.zeros(len(e), dtype=np.uint64)
    for i in range(LENGTH):
        keys += _letters[m[np.arange(len(e)), at + i]] * up[i]
    return Suffixes(e, m), mixed(keys)


def send_again(batches, depth: int, shards: int):
    """Suffixes of common anchors by their second anchor, or by their strings; repeats among a row's are settled here."""
    for batch in batches:
        for raw in batch.column("payload").to_pylist():
            s = unpacked(raw)
            for at in range(0, len(s), FLOOD):
                again, key = (second_runs if depth == 1 else single_strings)(s.take(np.arange(at, min(len(s), at + FLOOD))))
                found = Matches(again, strings=False)
                yield from _in_batches(span_rows(found.spans(again), shards))
                yield from _in_batches(suffix_rows(again.take(found.order), key[found.order], depth * shards, shards))


def scan_shards(batches, folder: str, shards: int, last: bool):
    """Each shard's new suffixes through its family, batch by batch: spans, suffixes to deal out again, and the levels the
    family ends with. Levels that changed are written to ``folder``; a shard with nothing new reads none."""
    now, family, held = None, Family(), []
    stored: list[str] = []

    def settle():
        if stored:
            family.levels += [read_level(folder, name) for name in stored]
            family.levels.sort(key=len, reverse=True)
            stored.clear()
            family.drop_wide()
        if held:
            family.add(Suffixes.joined(held))
            held.clear()
        for spans in family.spans:
            yield from span_rows(spans, shards)
        for s in family.leaving:
            for at in range(0, len(s), FLOOD):
                yield now, AGAIN, None, None, packed(s.take(np.arange(at, min(len(s), at + FLOOD))))
        family.spans.clear()
        family.leaving.clear()

    def finish():
        if held or family.wide:
            yield from settle()
        for name in stored:
            yield now, LEVEL, None, None, name.encode()
        for level in family.levels:
            yield now, LEVEL, None, None, (level.name or write_level(folder, level)).encode()
        for mark in family.wide:
            yield now, MARK, None, None, int(mark).to_bytes(8, "little")

    for batch in batches:
        for shard, kind, doc, digest, payload in zip(*(batch.column(n).to_pylist() for n, _ in SENT_ARROW), strict=True):
            if shard != now:
                if now is not None:
                    yield from _in_batches(finish())
                now, family, stored = shard, Family(most=1 << 62 if last else WIDE), []
            if kind in (SPANS, AGAIN):
                yield from _in_batches([(shard, kind, doc, digest, payload)])
            elif kind == LEVEL:
                stored.append(payload.decode())
            elif kind == MARK:
                family.wide.add(int.from_bytes(payload, "little"))
            else:
                held.append(unpacked(payload))
                if sum(map(len, held)) >= BATCH:
                    yield from _in_batches(settle())
    if now is not None:
        yield from _in_batches(finish())


def write_level(folder: str, s: Suffixes) -> str:
    """A level as a file of a new name, so that a task that runs again spoils nothing."""
    store, path = file_system(folder)
    store.create_dir(path, recursive=True)
    name = f"{uuid.uuid4().hex}.level"
    with store.open_output_stream(f"{path}/{name}", compression=None) as out:
        for at in range(0, len(s), HELD):
            block = packed(s.take(np.arange(at, min(len(s), at + HELD))))
            out.write(len(block).to_bytes(8, "little") + block)
    return name


def read_level(folder: str, name: str) -> Suffixes:
    store, path = file_system(folder)
    blocks = []
    with store.open_input_file(f"{path}/{name}") as file:
        while head := file.read(8):
            blocks.append(unpacked(file.read(int.from_bytes(head, "little"))))
    whole = Suffixes.joined(blocks)
    whole.name = name
    return whole


# --- the index ----------------------------------------------------------------------------------------------------------


class SuffixIndex:
    """Families of suffix arrays in a shared folder. :meth:`add` holds a batch of texts against all that came before.

    The manifest is a table of the shards' levels and marked anchors; each batch writes a new one and then drops the files
    that it no longer names. ``shards`` is settled when the index is made, for the bytes expected in all.
    """

    def __init__(self, spark: SparkSession, folder: str, shards: int):
        self.spark, self.folder, self.shards, self.batches = spark, folder, shards, 0
        self.manifest: DataFrame | None = None

    @staticmethod
    def open(spark: SparkSession, folder: str) -> SuffixIndex:
        """The index in ``folder`` as its last whole batch left it."""
        store, where = hadoop_path(spark, f"{folder}/manifest-*/_SUCCESS")
        path = max(str(x.getPath().getParent().toString()) for x in store.globStatus(where))
        batches, shards = map(int, path.rsplit("manifest-", 1)[1].split("-"))
        index = SuffixIndex(spark, folder, shards)
        index.batches, index.manifest = batches, spark.read.schema(SENT).parquet(path)
        index.manifest.scratch = path
        return index

    @staticmethod
    def shards_for(n_bytes: int, spark: SparkSession) -> int:
        return max(1, 2 * parts(spark), n_bytes // (SHARD * (SPAN + 1) // 2))

    def add(self, texts: DataFrame) -> DataFrame:
        """(doc, sum, spans) of the bytes of ``texts`` (doc, sum, text) and of earlier batches that also start earlier, as
        far as this batch shows. Spans may be spread over several rows of a text and overlap."""
        shards, folder = self.shards, f"{self.folder}/levels"
        rows = map_arrow(texts.select("doc", "sum", "text"), lambda b: send_suffixes(b, shards), SENT)
        found, known = [], []
        for depth in range(DEPTHS):
            stored = None
            if self.manifest is not None:
                stored = self.manifest.where((F.col("shard") >= depth * shards) & (F.col("shard") < (depth + 1) * shards))
                rows = rows.unionByName(stored)
            n = max(1, min(shards, 4 * parts(self.spark)))
            dealt = rows.repartition(n, "shard").sortWithinPartitions("shard", "kind")
            done = saved(map_arrow(dealt, lambda b, last=depth == DEPTHS - 1: scan_shards(b, folder, shards, last), SENT), "suffixes")
            found.append(done)
            known.append(done.where(F.col("kind") <= MARK))
            again = done.where(F.col("kind") == AGAIN)
            if depth == DEPTHS - 1:
                break
            if again.limit(1).count():
                rows = map_arrow(again.select("payload"), lambda b, d=depth + 1: send_again(b, d, shards), SENT)
            else:  # nothing is dealt out again: deeper levels stay as they are
                if self.manifest is not None:
                    known.append(self.manifest.where(F.col("shard") >= (depth + 1) * shards))
                break
        spans = None
        for done in found:
            some = done.where(F.col("kind") == SPANS).select("doc", "sum", F.col("payload").alias("spans"))
            spans = some if spans is None else spans.unionByName(some)
        spans = saved(spans, "spans")
        manifest = known[0]
        for some in known[1:]:
            manifest = manifest.unionByName(some)
        self.batches += 1
        old, self.manifest = self.manifest, written(manifest, f"{self.folder}/manifest-{self.batches:08d}-{self.shards}")
        if old is not None:
            self._drop(old)
            discard(old)
        discard(*found)
        return spans

    def _drop(self, old: DataFrame) -> None:
        """Delete level files that only ``old`` names."""
        gone = old.where(F.col("kind") == LEVEL).select("payload").join(self.manifest.where(F.col("kind") == LEVEL).select("payload"), "payload", "left_anti")
        folder = f"{self.folder}/levels"

        def run(batches):
            store, path = file_system(folder)
            for batch in batches:
                for name in batch.column("payload").to_pylist():
                    if store.get_file_info(f"{path}/{name.decode()}").is_file:
                        store.delete_file(f"{path}/{name.decode()}")
                yield arrow_batch([("n", pa.int64())], [[batch.num_rows]])

        map_arrow(gone, run, "n long").agg(F.sum("n")).first()

    def close(self) -> None:
        """Delete all that the index keeps."""
        delete_folder(self.spark, self.folder)


# --- the operator -------------------------------------------------------------------------------------------------------


def named_texts(docs: DataFrame, key: str, text: str, at: dict[str, str]) -> DataFrame:
    """``docs`` with doc, the place of its key in order, and sum: empty, or where a key has several texts the text's
    128-bit digest. Keys are found by SLOTS hash slots, so the list of slots is bounded; a slot too many only costs space."""
    kind = docs.schema[key].dataType.typeName()
    rows = docs.select(*(F.col(c).alias(n) for c, n in at.items()), F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if kind in ("byte", "short", "integer", "long"):
        rows = rows.withColumn("doc", F.coalesce(F.col("key").cast("long"), F.lit(2**63 - 1))).drop("key")
    else:  # numbers in the order of the keys; only the keys are sorted
        order = saved(rows.select("key").where("key is not null").distinct().orderBy("key").withColumn("doc", F.monotonically_increasing_id()), "order")
        rows = rows.join(order, "key", "left").withColumn("doc", F.coalesce("doc", F.lit(2**63 - 1))).drop("key")
    slot = F.pmod(F.xxhash64("doc"), F.lit(SLOTS))
    digest = F.unhex(F.md5("text"))
    several = rows.select("doc", digest.alias("h")).groupBy("doc").agg(F.min("h").alias("a"), F.max("h").alias("z")).where("a <> z").select(slot.alias("slot")).distinct()
    slots = saved(several, "slots")
    marked = rows.withColumn("slot", slot).join(F.broadcast(slots.withColumn("several", F.lit(True))), "slot", "left")
    return marked.withColumn("sum", F.when(F.col("several"), digest).otherwise(F.lit(b""))).drop("slot", "several")


def repeat_spans(texts: DataFrame, batches: int) -> DataFrame:
    """(doc, sum, spans) of the bytes to remove from ``texts`` (doc, sum, text), which the index takes in so many batches."""
    spark = texts.sparkSession
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    index = SuffixIndex(spark, scratch_path(spark, "suffix-index"), SuffixIndex.shards_for(total, spark))
    turn = F.pmod(F.xxhash64("doc", "sum"), F.lit(batches))
    spans = [index.add(texts.where(turn == i)) for i in range(batches)]
    index.close()
    out = spans[0]
    for some in spans[1:]:
        out = out.unionByName(some)
    return out


def remove_repeats(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), key: str = "doc_id", text: str = "text", with_bytes: bool = True, batches: int = 3) -> DataFrame:
    """``keep`` with n_bytes, n_removed, n_spans, kept_sha256[, kept, kept_text]: the text's bytes without those that a string of
    LENGTH bytes covers which also starts earlier.

    Earlier is: in a text of smaller key, or in the same text further left. A null text counts as empty, a null key as
    the largest. Keys may be of any type with an order. Rows of one key and different texts are told apart, and ordered,
    by a 128-bit digest of the text; rows alike in both are one text, so neither repeats the other. Texts under LENGTH bytes, and no rows, come out
    as they are. ``kept`` is the bytes that are left, which may lack part of a character, and ``kept_text`` the whole
    characters of it. The texts go through the index in ``batches`` batches, in any order; the result is the same.
    """
    at = {c: f"keep_{i}" for i, c in enumerate(keep)}
    rows = named_texts(docs, key, text, at)
    spans = repeat_spans(rows.select("doc", "sum", "text"), batches).groupBy("doc", "sum").agg(F.collect_set("spans").alias("spans"))
    joined = rows.join(spans, ["doc", "sum"], "left").select(*at.values(), "text", "spans")

    def run(batches_):
        for part in pieces(batches_, "text"):
            out: list[tuple] = []
            for x, lists in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                raw = x.encode()
                pairs = np.frombuffer(b"".join(lists or []), "<u4").reshape(-1, 2).astype(np.int64)
                start, end = merged_spans(pairs[:, 0], pairs[:, 1])
                cuts = [0, *np.stack([start, end], axis=1).ravel().tolist(), len(raw)]
                kept = b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
                row = (len(raw), len(raw) - len(kept), len(start), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, kept.decode(errors="ignore")) if with_bytes else row)
            more = [("kept", pa.binary()), ("kept_text", pa.string())] if with_bytes else []
            fields = [*((c, part.schema.field(n).type) for c, n in at.items()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *more]
            yield arrow_batch(fields, [*(part.column(n) for n in at.values()), *map(list, zip(*out))])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(joined, run, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary, kept_text string" * with_bytes)
