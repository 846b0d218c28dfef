import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, language_id, token_counts
from tessera.llm.queries import BYTE_RANKS, WORD_VOCABULARY

RANKS, WORDS = P.path(BYTE_RANKS), P.path(WORD_VOCABULARY)
ODD = ["a", "B", "É", "é", "İ", "Σ", "ς", " ", "\x85", "\xa0", "　", "\x1c", "1", "²", "½", "Ⅷ", "'s", "'LL", "<|endoftext|>", "<|startoftext|>", "漢", "!", "́", "ß", "\n", "​", "ǅ", "ŉ", "K", "🙂", "\x00", "ा", "न", "_", "٣", "ﬁ", "가", "가"]
TEXTS = [None, "", " ", "Hello <|endoftext|> world", "x" * 3000, "é " * 500, "a\n\n b", *("".join(random.Random(i).choices(ODD, k=i % 40)) for i in range(300))]
SCHEMA = "doc_id long, text string, n_tokens string, score int"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ODD), max_size=30).map("".join) | st.text(max_size=30))
def test_token_counts_are_the_librarys(text):
    own = token_counts.tokenizer(WORDS)
    words, special = token_counts.split(text, WORDS)
    assert special + sum(token_counts.word_length(w, own) for w in words) == len(own.encode(text, add_special_tokens=False).ids)


def test_token_counts(spark):
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, TEXTS), WORDS, 20).collect()}
    own = token_counts.tokenizer(WORDS)
    for i, t in enumerate(TEXTS):
        n = len(own.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 20)
    assert token_counts.count_tokens(frame(spark, []), WORDS, 20).count() == 0


def test_cache_begins_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 3)
    lookup = token_counts.Counts(token_counts.tokenizer(WORDS), {"the": 1})
    assert [lookup[w] for w in ["the", "aa", "bb", "cc", "dd", "the"]] and len(lookup) <= 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*ODD, "word ", " word", " 12 ab", "  x"]), max_size=60).map("".join), st.integers(1, 9))
def test_pieces_encode_as_the_whole(text, most):
    own = bpe.encoder(RANKS, P.PATTERN)
    parts = list(bpe.safe_pieces(text, most))
    assert "".join(parts) == text
    assert [i for p in parts for i in own.encode_ordinary(p)] == own.encode_ordinary(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*ODD, "    ", "\t\t\t", "\n\n\n\n", "\u2003\u2003\u2003", "\x1c\x1c\x1c"]), max_size=40).map("".join))
def test_long_white_space_is_matched_apart(text):
    own = bpe.encoder(RANKS, P.PATTERN)
    was, bpe._spaces = bpe._spaces, __import__("re").compile(f"[{bpe.SPACE}]{{3,}}")
    try:
        parts = list(bpe.stretches(text))
    finally:
        bpe._spaces = was
    assert "".join(x for x, _ in parts) == text
    assert [i for x, one in parts for i in (own._encode_single_piece(x) if one else own.encode_ordinary(x))] == own.encode_ordinary(text)


@pytest.mark.parametrize("text", [" " * 2_000_000, "a" + " " * 1_000_000 + "b" + "\n" * 1_000_000, "!" * 2_000_000, "word\n" * 400_000, "漢字，" * 700_000, "a" * 2_000_000, "1a" * 1_000_000])
def test_very_long_texts(text):
    ids = bpe.encode(text, RANKS, P.PATTERN)
    assert bpe.decode(ids, RANKS, P.PATTERN) == text.encode()
    if text.count(" ") < 900_000 and text.count("\n") < 900_000:
        assert ids == bpe.encoder(RANKS, P.PATTERN).encode_ordinary(text)
    own = token_counts.tokenizer(WORDS)
    words, _ = token_counts.split(text, WORDS)
    assert sum(token_counts.word_length(w, own) for w in words) == len(own.encode(text, add_special_tokens=False).ids)


def test_words_of_all_planes_are_the_librarys():
    """Every assigned and unassigned character, beside letters, numbers, apostrophes and white space."""
    own = token_counts.tokenizer(WORDS)
    for at in range(0, 0x110000, 64):
        if 0xD800 <= at < 0xE000:
            continue
        c = [chr(at + i) for i in range(64)]
        texts = ["".join(f"a{x}'s 1{x}b'{x}'T " for x in c)] if at >= 0x250 else [f"a{x}'s 1{x}b'{x}'T " for x in c]
        for text in texts:
            words, special = token_counts.split(text, WORDS)
            assert special + sum(token_counts.word_length(w, own) for w in words) == len(own.encode(text, add_special_tokens=False).ids), hex(at)


def test_cache_is_bounded_in_bytes():
    lookup = token_counts.Counts(token_counts.tokenizer(WORDS), {})
    assert lookup["x" * 1000] > 1 and not len(lookup)


def test_bpe(spark, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_CHARS", 64)
    own = bpe.encoder(RANKS, P.PATTERN)
    df = bpe.encode_documents(frame(spark, TEXTS), RANKS, P.PATTERN)
    for r in df.collect():
        text = TEXTS[r.doc_id] or ""
        ids = own.encode_ordinary(text)
        assert list(r.ids) == ids and r.n_tokens == len(ids) and bytes(r.decoded) == text.encode()
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert {r.doc_id: bytes(r.decoded) for r in bpe.decode_documents(df, RANKS, P.PATTERN).collect()} == {i: (t or "").encode() for i, t in enumerate(TEXTS)}
    assert bpe.encode_documents(frame(spark, []), RANKS, P.PATTERN).count() == 0


SYLLABLES = {"en": "the and of ing tion er in an re".split(), "fr": "le la et é eau aux oi des une".split(), "de": "der die und sch ung ich ein ü z".split(), "pl": "sz cz ie nie rz ó w na do".split()}


def languages(seed, n=600):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice([*SYLLABLES])
        out.append((i, " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_language_id_on_held_out_texts(spark):
    train = spark.createDataFrame([*languages(1), (9000, None, "en"), (9001, "123", "de"), (9002, "the and", None)], "doc_id long, text string, lang string")
    model = language_id.fit(train)
    assert model.languages == sorted(SYLLABLES) and model.code.shape == (4, 7)
    test = languages(2)
    asked = [(i, t, "x", 1) for i, t, _ in test] + [(5000, None, "", 0), (5001, "12 !?", "", 0), (5002, "", "", 0), (None, "the and of", "", 0)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(asked, "doc_id long, text string, lang_pred string, score int"), model).collect()}
    assert sum(got[i].lang_pred == lang for i, _, lang in test) / len(test) > 0.97
    assert all(got[i].lang_pred == "und" and got[i].ambiguous for i in (5000, 5001, 5002)) and got[None].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in got.values())
    mixed = model.predict(" ".join(["the and ing of tion", "le eau et aux une des"] * 5))
    assert mixed[1] < model.predict("the and of ing tion er in an re")[1]


def test_language_id_cases(spark):
    none = language_id.fit(spark.createDataFrame([], "text string, lang string"))
    assert none.predict("word") == ("und", 0.0, True)
    one = language_id.fit(spark.createDataFrame([("some words", "en")], "text string, lang string"))
    assert one.predict("word")[0] == "en"


def plain_grams(text):
    """Buckets of a text's byte n-grams, one at a time."""
    raw, out = text.encode().lower(), []
    for order in language_id.ORDERS:
        for i in range(len(raw) - order + 1):
            h = 0
            for j, b in enumerate(raw[i : i + order]):
                h = (h * 0x01000193 + b + 1 if j else b + 1) % (1 << 32)
            out.append((h + order - 1) * 0x9E3779B1 % (1 << 32) >> 16)
    return out


def test_model_against_brute_force(spark):
    """Counts, odds, trust and decoding as by plain loops over n-grams, bits and codewords."""
    import math
    import zlib

    train = [(t, lang) for _, t, lang in languages(3, 40)]
    model = language_id.fit(spark.createDataFrame(train, "text string, lang string"))
    names, code = sorted({x for _, x in train}), model.code.tolist()

    def odds(texts):
        rates = []
        for lang in names:
            counts = [0.5] * language_id.BUCKETS
            for t, own in texts:
                if own == lang:
                    for g in plain_grams(t):
                        counts[g] += 1
            whole = sum(counts)
            rates.append([c / whole for c in counts])
        bits = []
        for b in range(len(code[0])):
            plus, minus = ([rates[k] for k in range(len(names)) if code[k][b] == side] for side in (1, -1))
            bits.append([math.log(sum(p) / len(plus)) - math.log(sum(m) / len(minus)) for p, m in zip(zip(*plus), zip(*minus))])
        return bits

    def margins(bits, text):
        ids = plain_grams(text)
        return [math.tanh(4 * sum(bit[g] for g in ids) / len(ids)) for bit in bits]

    whole, halves = odds(train), [odds([x for x in train if zlib.crc32(x[0].encode()) & 1 == h]) for h in (0, 1)]
    trust = []
    for k, lang in enumerate(names):
        own = [margins(halves[1 - (zlib.crc32(t.encode()) & 1)], t) for t, x in train if x == lang]
        right = [(1 + sum((m[b] > 0) == (code[k][b] > 0) for m in own)) / (2 + len(own)) for b in range(len(code[0]))]
        trust.append([r / sum(right) for r in right])
    assert np.allclose(model.trust, trust)
    for _, text, _ in languages(4, 30):
        m = margins(whole, text)
        loss = [sum(t * math.exp(-c * x) for t, c, x in zip(trust[k], code[k], m)) for k in range(len(names))]
        share = [math.exp(-8 * (x - min(loss))) for x in loss]
        said, score, _ = model.predict(text)
        assert said == names[loss.index(min(loss))] and abs(score - max(share) / sum(share)) < 1e-4


@pytest.mark.parametrize("few", [1, 2, 5])
def test_small_classes_are_learned(spark, few):
    """A language of one document is learned from it, whichever half of the sample that is of."""
    rng = random.Random(few)
    text = lambda lang, n: " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))
    train = [(text(lang, 40), lang) for lang in ("en", "de") for _ in range(60)]
    for odd in range(2):
        small: list = []
        while len(small) < few:
            x = text("fr", 40)
            if language_id.fold(x) == odd:
                small.append((x, "fr"))
        model = language_id.fit(spark.createDataFrame(train + small, "text string, lang string"))
        assert all(model.predict(x)[0] == "fr" for x, _ in small)
        assert sum(model.predict(text("fr", 40))[0] == "fr" for _ in range(20)) >= 18


def test_labels_beyond_the_most_teach_nothing(spark, monkeypatch):
    monkeypatch.setattr(language_id, "MOST_LANGUAGES", 2)
    model = language_id.fit(spark.createDataFrame([("aa bb", "x"), ("aa bb", "x"), ("cc", "y"), ("dd", "z")], "text string, lang string"))
    assert model.languages == ["x", "y"]


@pytest.mark.parametrize("n", [3, 5, 7, 9, 30])
def test_codewords_are_far_apart(n):
    code = language_id.codewords(n)
    gaps = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
    assert min(gaps) >= min(2, code.shape[1] // 2) and (np.abs(code.sum(axis=0)) < n).all()


def test_blocks_score_as_the_whole(monkeypatch):
    model = language_id.Model(["a", "b"], np.array([[1], [-1]]), np.random.default_rng(1).standard_normal((language_id.BUCKETS, 1)).astype(np.float32), np.ones((2, 1)))
    raw = random.Random(3).randbytes(1000)
    whole = model.margins(raw)
    monkeypatch.setattr(language_id, "BLOCK", 37)
    assert np.allclose(whole, model.margins(raw), atol=1e-5)
