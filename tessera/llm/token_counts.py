"""Token counts by a map-side lookup in two tiers: a broadcast table of frequent words, then a cache in each worker."""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batch, map_arrow, pieces

#: Words of the broadcast table at most, and the longest of them; they bound it to TABLE_WORDS * TABLE_BYTES = 4 MB.
TABLE_WORDS, TABLE_BYTES = 1 << 16, 64
#: Words a worker remembers besides the table, and the longest of them, which bound it to 100 MB; when full it starts anew.
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Characters of a text that are split at a time, cut before a space.
BLOCK = 1 << 18

#: The white space and the pattern for pre-tokens of the vocabulary, below U+0180.
SPACE = r"[\t-\r \x85\xa0]"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Below U+0180, where lower-casing stays below U+0250, NFC has nothing to compose and classes are settled, Python's faster
#: matcher agrees with the library: with its letters, and its numbers. All else the library splits itself.
_simple = re.compile("[\x00-ſ]*")
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
_simple_words = re.compile(WORDS.replace(r"\s", SPACE[1:-1]).replace(r"\p{L}", _LETTERS).replace(r"\p{N}", _NUMBERS))
#: Stands before words that the library has written in the byte-level alphabet already; plain words are below U+0250.
MAPPED = "\u2581"


class Counts(dict):
    """Number of tokens by word. A word that isn't there is encoded by the library and kept."""

    def __init__(self, tokenizer, table: dict[str, int]):
        super().__init__(table)
        self.tokenizer, self.fixed, self.table, self.misses = tokenizer, len(table), table, 0

    def __missing__(self, word: str) -> int:
        self.misses += 1
        if len(word) > CACHE_CHARS:
            return word_length(word, self.tokenizer)
        if len(self) - self.fixed >= CACHE_WORDS:
            self.clear()
            self.update(self.table)
        n = self[word] = word_length(word, self.tokenizer)
        return n


def _byte_characters() -> dict[int, int]:
    """The byte-level alphabet by its public rule: printable Latin-1 bytes stand for themselves, the others follow 255."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in own)
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


_alphabet = _byte_characters()


def word_length(word: str, tokenizer) -> int:
    """Tokens of one pre-token: the library's model on the word in the byte-level alphabet."""
    if word.startswith(MAPPED):
        return len(tokenizer.model.tokenize(word[1:]))
    plain = word.isascii() and word.isprintable() and " " not in word
    return len(tokenizer.model.tokenize(word if plain else word.encode().decode("latin-1").translate(_alphabet)))


@functools.lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def special_strings(path: str):
    """A pattern for the added tokens, which the library takes out of a text before all else; None without any."""
    added = sorted((t.content for t in tokenizer(path).get_added_tokens_decoder().values()), key=len, reverse=True)
    return re.compile("|".join(map(re.escape, added))) if added else None


def blocks(text: str) -> Iterator[str]:
    """``text`` in blocks of about BLOCK characters, cut before a space, which no word and no composed character crosses."""
    at = 0
    while len(text) - at > BLOCK:
        to = text.find(" ", at + BLOCK)
        if to < 0:
            break
        yield text[at:to]
        at = to
    yield text[at:]


def split(text: str, path: str) -> tuple[list[str], int]:
    """The words of ``text`` as the library pre-tokenizes them, and how many special strings it holds."""
    found, special = special_strings(path), 0
    parts = [text]
    if found and "<|" in text:
        parts = found.split(text)
        special = len(parts) - 1
    words: list[str] = []
    for part in (x for y in parts for x in blocks(y)):
        if _simple.fullmatch(part):
            words += _simple_words.findall(part.lower())
        else:
            own = tokenizer(path)
            mapped = own.pre_tokenizer.pre_tokenize_str(own.normalizer.normalize_str(part))
            words += [w if w.isascii() else MAPPED + w for w, _ in mapped]
    return words, special


def frequent_words(docs: DataFrame, path: str, text: str = "text") -> list[str]:
    """The most frequent words of all texts, TABLE_WORDS at most.

    Each task counts all its words, forgets the rarest when they grow too many, and sends its TABLE_WORDS most frequent;
    their sums are ranked, ties by word. The table holds what the counts would be anyway: it speeds them and can't change one.
    """

    def run(batches):
        seen: Counter = Counter()
        for part in pieces(batches, text):
            for x in part.column(text).to_pylist():
                seen.update(split(x or "", path)[0])
                if len(seen) > 4 * TABLE_WORDS:
                    seen = Counter({w: n for w, n in seen.most_common(TABLE_WORDS) if len(w) <= TABLE_BYTES // 4})
        top = [(w, n) for w, n in seen.most_common(TABLE_WORDS) if n > 1 and len(w) <= TABLE_BYTES // 4]
        yield arrow_batch([("word", pa.string()), ("n", pa.int64())], [[w for w, _ in top], [n for _, n in top]])

    ranked = map_arrow(docs.select(text), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in ranked.orderBy(F.desc("n"), "word").limit(TABLE_WORDS).select("word").collect()]


def pack(words: list[str], path: str) -> tuple[bytes, bytes]:
    """The table as two compact strings: the words, and their numbers of tokens as 16-bit integers."""
    own = tokenizer(path)
    return "\n".join(words).encode(), np.array([word_length(w, own) for w in words], dtype="<u2").tobytes()


@functools.lru_cache(maxsize=1)
def counts(path: str, words: bytes, lengths: bytes) -> Counts:
    """The table unpacked, with the cache behind it; kept for the life of a worker."""
    names = words.decode().split("\n") if words else []
    return Counts(tokenizer(path), dict(zip(names, np.frombuffer(lengths, dtype="<u2").tolist(), strict=True)))


def count_tokens(docs: DataFrame, path: str, over: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for each row of ``docs``. One pass over the texts makes the table, a second
    counts; neither shuffles a text or its words.

    The counts are the library's own for the whole text, without begin, end or added tokens; special strings inside a
    text count as the library's default has it, one token each. A null text counts as empty: 0 bytes, 0 tokens, not
    over the limit. A text of any length, even of one word, counts whole. Rows are independent, so repeated rows and keys, null keys and other columns make no difference.
    """
    kind = docs.schema[key].dataType.simpleString()
    packed = docs.sparkSession.sparkContext.broadcast(pack(frequent_words(docs, path, text), path))

    def run(batches):
        lookup = counts(path, *packed.value)
        for part in pieces(batches, text):
            sizes, tokens = [], []
            for x in part.column(text).to_pylist():
                words, special = split(x or "", path)
                sizes.append(len((x or "").encode()))
                tokens.append(special + sum(map(lookup.__getitem__, words)))
            yield arrow_batch(
                [(key, part.schema.field(key).type), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())],
                [part.column(key), sizes, tokens, [n > over for n in tokens]],
            )

    return map_arrow(docs.select(key, text), run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
