"""Byte-level BPE: the tiktoken library over a local rank file, and decoding back to raw bytes."""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import arrow_batch, map_arrow, pieces

#: Texts of more characters are encoded in pieces, cut where the pattern is sure to start a new match.
LONG_CHARS = 1 << 16
#: Runs of white space from here on are matches that we make ourselves, as the library's matcher fails on very long ones.
LONG_SPACE = 1 << 13

#: The white space of Unicode, which is what the pattern's ``\s`` takes.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, numbers and symbols that are so in every version of Unicode: Latin, Cyrillic, kana, Han, Hangul; ASCII digits;
#: ASCII and East Asian punctuation.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0400-\u0481\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
DIGITS = "0-9"
SYMBOLS = r"!-/:-@\[-`{-~\u3001-\u3003\u3008-\u3011\uff01-\uff0f\uff1a-\uff20"

_start = re.compile(
    f"(?<=[^{SPACE}])(?=[{SPACE}])|(?<=[{LETTERS}{DIGITS}])(?=[{SYMBOLS}])|(?<=[{LETTERS}])(?=[{DIGITS}])|(?<=[{DIGITS}])(?=[{LETTERS}])"
)
_spaces = re.compile(f"[{SPACE}]{{{LONG_SPACE},}}")


@functools.lru_cache(maxsize=4)
def encoder(ranks: str, pattern: str):
    """The tiktoken encoding of a rank file; kept for the life of a Python worker."""
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=table, special_tokens={})


def safe_pieces(text: str, most: int | None = None) -> Iterator[str]:
    """``text`` in pieces of about ``most`` characters whose matches, one after another, are those of the whole.

    A match of a GPT-2 style pattern is a run of white space, or a run of letters, of numbers or of symbols that may have
    one space before it, or a contraction. So one always begins at white space after anything else, at a symbol after a
    letter or number, and between letters and numbers; and none to the left can tell, as only white space looks ahead.
    What has no such place is one match, and stays whole.
    """
    most = LONG_CHARS if most is None else most
    at, n = 0, len(text)
    while n - at > most:
        found = _start.search(text, at + most)
        if not found or found.start() >= n:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def stretches(text: str) -> Iterator[tuple[str, bool]]:
    """Pieces of ``text`` to match one by one, and long runs of white space, which are matches as they are (True). A run
    before other text leaves its last character to what follows, as the pattern does."""
    at = 0
    for run in _spaces.finditer(text):
        if run.start() > at:
            yield from ((x, False) for x in safe_pieces(text[at : run.start()]))
        at = run.end() - (run.end() < len(text))
        yield text[run.start() : at], True
    if at < len(text):
        yield from ((x, False) for x in safe_pieces(text[at:]))


def encode(text: str, ranks: str, pattern: str) -> list[int]:
    """Ids of ``text`` as ``encode_ordinary`` gives them."""
    own = encoder(ranks, pattern)
    if len(text) <= LONG_CHARS:
        return own.encode_ordinary(text)
    return [i for piece, one in stretches(text) for i in (own._encode_single_piece(piece) if one else own.encode_ordinary(piece))]


def decode(ids: list[int], ranks: str, pattern: str) -> bytes:
    """The bytes that ``ids`` stand for; they may end inside a character."""
    return encoder(ranks, pattern).decode_bytes(ids)


def encode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) for each row of ``docs``, in one pass without a shuffle.

    A null text counts as empty: no ids, and the digests of no bytes. Rows are independent of each other, so repeated rows
    and keys, null keys and other columns make no difference. ``ids_sha256`` is over the ids as little-endian
    unsigned 32-bit integers. Texts of any length and make come out whole: megabytes without a space, or of nothing else,
    too. ``ids`` holds them as an array and ``decoded`` the bytes they decode to.
    """
    kind = docs.schema[key].dataType.simpleString()
    more = [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] if with_ids else []
    fields = [("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), *more]

    def run(batches):
        for part in pieces(batches, text):
            rows: list[tuple] = []
            for x in part.column(text).to_pylist():
                ids = encode(x or "", ranks, pattern)
                raw = decode(ids, ranks, pattern)
                rows.append((len(ids), hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(raw).hexdigest(), *([ids, raw] if with_ids else [])))
            yield arrow_batch([(key, part.schema.field(key).type), *fields], [part.column(key), *map(list, zip(*rows))])

    schema = f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded binary" * with_ids
    return map_arrow(docs.select(key, text), run, schema)


def decode_documents(docs: DataFrame, ranks: str, pattern: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, decoded) for each row; null ids decode to no bytes, an id out of range fails the task."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for part in batches:
            raw = [decode(x or [], ranks, pattern) for x in part.column(ids).to_pylist()]
            yield arrow_batch([(key, part.schema.field(key).type), ("decoded", pa.binary())], [part.column(key), raw])

    return map_arrow(docs.select(key, ids), run, f"`{key}` {kind}, decoded binary")
