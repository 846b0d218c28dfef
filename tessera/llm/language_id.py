"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import arrow_batch, map_arrow, pieces

#: Documents of a language that a model is fitted on, about: those whose hash falls under the share that gives so many.
SAMPLE_PER_LANGUAGE = 1500
#: Tasks that gather the sample's counts.
FIT_TASKS = 8
#: Labels that a model may tell apart, the most frequent ones; they bound its matrices.
MOST_LANGUAGES = 256
BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
#: Bytes of a text that are scored at a time.
BLOCK = 1 << 20
#: Below this difference between the best two languages' shares a prediction is marked as ambiguous.
AMBIGUOUS = 0.2
UNKNOWN = "und"

_letter = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return _letter.search(text) is not None


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """An n x b matrix of +1 and -1.

    Up to seven classes: the exhaustive code, 2 ** (n - 1) - 1 bits. More: the one of 64 random codes of
    ceil(10 log2 n) bits whose closest rows are farthest apart.
    """
    if n < 3:
        return np.array([[1], [-1]][:n])
    if n <= 7:
        bits = np.arange(1, 2 ** (n - 1))
        return np.vstack([np.ones(len(bits), int), *(np.where(bits >> i & 1, -1, 1) for i in range(n - 1))])
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(64):
        code = rng.choice([-1, 1], size=(n, int(np.ceil(10 * np.log2(n)))))
        code = code[:, np.abs(code.sum(axis=0)) < n]
        gaps = (code.shape[1] - code @ code.T) // 2 + np.eye(n, dtype=int) * 10**6
        if gaps.min() > far:
            best, far = code, gaps.min()
    return best


def grams(raw: bytes) -> list[np.ndarray]:
    """Buckets of the byte n-grams of ``raw``, an array for each order; A-Z count as a-z."""
    b = np.frombuffer(raw.lower(), dtype=np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), dtype=np.uint32)
    for i in range(max(ORDERS)):
        if len(b) <= i:
            break
        h = (h[: len(b) - i] * np.uint32(0x01000193) + b[i:] + np.uint32(1)) if i else b + np.uint32(1)
        if i + 1 in ORDERS:
            mixed = (h + np.uint32(i)) * np.uint32(0x9E3779B1)
            out.append((mixed >> np.uint32(16)).astype(np.int32))
    return out


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # buckets x bits
    trust: np.ndarray  # languages x bits; each row sums to one

    def margins(self, raw: bytes) -> np.ndarray:
        """The bit classifiers' mean log odds over the n-grams of the whole text, squashed to -1 to 1."""
        total, n = np.zeros(self.code.shape[1]), 0
        for at in range(0, len(raw), BLOCK):  # blocks overlap by what an n-gram needs
            block = raw[at : at + BLOCK + max(ORDERS) - 1]
            for order, ids in zip(ORDERS, grams(block)):
                ids = ids[: max(0, min(BLOCK, len(raw) - at - order + 1))]
                total += np.bincount(ids, minlength=BUCKETS) @ self.weights if len(ids) > BUCKETS else self.weights[ids].sum(axis=0)
                n += len(ids)
        return np.tanh(4 * total / max(n, 1))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, its share in 0 to 1, and whether the next one comes close."""
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0, True
        loss = (np.exp(-self.code * self.margins(text.encode())) * self.trust).sum(axis=1)
        share = np.exp(-8 * (loss - loss.min()))
        share /= share.sum()
        order = np.argsort(-share, kind="stable")
        close = len(order) > 1 and share[order[0]] - share[order[1]] < AMBIGUOUS
        return self.languages[order[0]], float(share[order[0]]), bool(close)


def weights_of(totals: np.ndarray, code: np.ndarray) -> np.ndarray:
    """Each bit's log odds of a bucket (buckets x bits): the mean of smoothed rates of the languages with the bit against
    that of those without; zero where all are on one side."""
    rates = (totals + 0.5) / (totals + 0.5).sum(axis=1, keepdims=True)

    def side(chosen: np.ndarray) -> np.ndarray:
        return np.log((rates[chosen] if chosen.any() else rates).mean(axis=0))

    return np.stack([side(bit > 0) - side(bit < 0) for bit in code.T], axis=1).astype(np.float32)


def fold(text: str) -> int:
    """Which half of the sample a text is of."""
    return zlib.crc32(text.encode()) & 1


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model of the labels of ``docs``; rows without a label, and texts without a letter, teach nothing, nor do labels
    beyond the MOST_LANGUAGES most frequent (of equals, the smaller).

    Each bit of the code has a classifier of its own: the log odds of a hashed n-gram between the languages with the
    bit and those without, from the sample's smoothed frequencies, each language weighing alike. All of the sample gives
    the odds, so that a language of a single document is learned too. How far a bit is to be trusted in a language, which
    is what it weighs in that language's loss, is measured by cross-fitting: each half of the sample is judged by the odds
    of the other half.
    """
    rows = docs.select(text, label).where(F.col(label).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in rows.groupBy(label).count().orderBy(F.desc("count"), label).limit(MOST_LANGUAGES).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1)), np.zeros((BUCKETS, 1), np.float32), np.zeros((0, 1)))
    number = {x: k for k, x in enumerate(languages)}
    share = F.coalesce(*(F.when(F.col(label) == x, F.lit(min(1.0, SAMPLE_PER_LANGUAGE / n))) for x, n in sizes.items() if n > SAMPLE_PER_LANGUAGE), F.lit(1.0))
    place = F.pmod(F.xxhash64(text, F.lit(5)), F.lit(1 << 20)) / float(1 << 20)
    sample = rows.where(place < share).select(F.col(text).alias("text"), F.col(label).alias("lang")).repartition(FIT_TASKS)

    def gather(batches):
        seen: dict = {}
        for part in pieces(batches, "text"):
            for x, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                if lang in number and has_letter(x):
                    own = seen.setdefault((number[lang], fold(x)), np.zeros(BUCKETS, dtype=np.uint32))
                    for ids in grams(x.encode()):
                        own += np.bincount(ids, minlength=BUCKETS).astype(np.uint32)
        yield arrow_batch([("k", pa.int32()), ("half", pa.int32()), ("counts", pa.binary())], [[k for k, _ in seen], [h for _, h in seen], [x.tobytes() for x in seen.values()]])

    totals = np.zeros((2, len(languages), BUCKETS))
    for r in map_arrow(sample, gather, "k int, half int, counts binary").toLocalIterator():
        totals[r.half, r.k] += np.frombuffer(r.counts, dtype=np.uint32)
    code = codewords(len(languages))
    model = Model(languages, code, weights_of(totals.sum(axis=0), code), np.ones(code.shape) / code.shape[1])
    halves = docs.sparkSession.sparkContext.broadcast([Model(languages, code, weights_of(x, code), model.trust) for x in totals])

    def judge(batches):
        right, seen = np.zeros(code.shape), np.zeros(len(languages))
        for part in pieces(batches, "text"):
            for x, lang in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                if lang in number and has_letter(x):
                    k = number[lang]
                    right[k] += np.sign(halves.value[1 - fold(x)].margins(x.encode())) == code[k]
                    seen[k] += 1
        yield arrow_batch([("k", pa.int32()), ("seen", pa.float64()), ("right", pa.list_(pa.float64()))], [list(range(len(languages))), seen.tolist(), right.tolist()])

    right, seen = np.ones(code.shape), np.full(len(languages), 2.0)
    for r in map_arrow(sample, judge, "k int, seen double, right array<double>").toLocalIterator():
        right[r.k] += np.array(r.right)
        seen[r.k] += r.seen
    trust = right / seen[:, None]
    return Model(languages, code, model.weights, trust / trust.sum(axis=1, keepdims=True))


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """``keep`` with lang_pred, score and ambiguous, from whole texts, in one pass without a shuffle.

    Texts that are null or have no letter get ``und``, score 0 and ambiguous; so do all with a model that has learned
    no language. Rows are independent, so repeated rows and keys and null keys make no difference.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    read = text if text in keep else "__text"
    chosen = docs if read == text else docs.withColumn(read, F.col(text))
    chosen = chosen.select(*dict.fromkeys([*keep, read]))

    def run(batches):
        for part in pieces(batches, read):
            said = [sent.value.predict(x) for x in part.column(read).to_pylist()]
            yield arrow_batch(
                [*((k, part.schema.field(k).type) for k in keep), ("lang_pred", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())],
                [*(part.column(k) for k in keep), *map(list, zip(*said))],
            )

    kinds = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return map_arrow(chosen, run, f"{kinds}, lang_pred string, score double, ambiguous boolean")
