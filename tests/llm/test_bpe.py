import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from llm_support import edge, edge_rows, empty  # noqa: E402
from spanloom.llm.bpe import TextEncoder, TokenDecoder, Vocabulary, WordEncoder, decode_documents, encode_documents, sufficient_lookahead  # noqa: E402

PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["a", "b", "the", "'", "'s", "'re", "'R", "E", " ", "\n", "é", "é", "́", "Σ", "İ", "1", "½", "한", "ᄀ", "ᅡ", "ᆨ", "!", "<", "|>", "🙂", "‍"]
ALPHABET += ["<|endoftext|>", "<|startoftext|>", "aaaa", "ing", "ͅ", "ſ", "K", "\u0085", "᠎", "​", "\x1c", "࢏", "Ɤ", "\U00010d50", "\U00016ea0"]


@pytest.fixture(scope="module")
def vocabulary():
    return Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ids(encoder, text):
    return np.frombuffer(b"".join(encoder.encode(text)), "<u4").tolist()


def test_lookahead_of_small_merge_lists():
    length = {i: 1 for i in range(4)} | {10: 2, 11: 2, 12: 3}
    assert sufficient_lookahead([], length) == 0
    assert sufficient_lookahead([(0, 1, 10)], length) == 1
    # (1,2) first, then (0,1): whether 0 meets 1 depends on the symbol behind 1
    assert sufficient_lookahead([(1, 2, 10), (0, 1, 11)], length) == 2
    # (0, 12): 12 must be read whole, and what follows its parts decides too
    assert sufficient_lookahead([(1, 2, 10), (10, 3, 12), (0, 12, 13)], length | {13: 4}) == 3
    with pytest.raises(ValueError):
        sufficient_lookahead([(10, 1, 12), (0, 1, 10)], length)


def test_boundaries_are_final_within_the_lookahead(vocabulary):
    rng = random.Random(1)
    for _ in range(60):
        word = "".join(rng.choice(["a", "e", "s", "t", "in", "th", "er", "haha", "lol", "aaaa"][: rng.randint(2, 10)]) for _ in range(rng.randint(700, 1500)))
        cut = rng.randint(680, len(word))
        early = WordEncoder(vocabulary, chunk=1)
        seen = early.feed(word[:cut].encode())
        whole = WordEncoder(vocabulary, chunk=10_000)
        every = whole.feed(word.encode()) + whole.finish()
        assert every[: len(seen)] == seen


def test_streams_of_any_chunk_equal_the_library(vocabulary, library):
    rng = random.Random(3)
    for _ in range(1500):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60)))
        want = library.encode(text, add_special_tokens=False).ids
        for chunk in (1, 3, 17, 1 << 16):
            assert ids(TextEncoder(vocabulary, chunk), text) == want, (text, chunk)


def test_words_longer_than_every_buffer(vocabulary, library):
    rng = random.Random(4)
    for _ in range(40):
        word = "".join(rng.choice("aestinrhlo"[: rng.randint(2, 10)]) for _ in range(rng.randint(500, 4000)))
        want = library.encode(word, add_special_tokens=False).ids
        for chunk in (100, 1 << 16):
            assert ids(TextEncoder(vocabulary, chunk), word) == want
        encoder, got = WordEncoder(vocabulary, chunk=64), []
        for i in range(0, len(word), 37):
            got += encoder.feed(word[i : i + 37].encode())
            assert len(encoder.open) <= encoder.most + encoder.chunk
        assert got + encoder.finish() == want


def test_decoding_carries_characters_over_chunks(vocabulary, library):
    text = "Crème brûlée 🙂 한국어 — déjà vu <|endoftext|> ok"
    packed = b"".join(TextEncoder(vocabulary).encode(text))
    want = library.decode(np.frombuffer(packed, "<u4").tolist(), skip_special_tokens=False)
    for chunk in (1, 2, 5, 1000):
        assert TokenDecoder(vocabulary).decode(packed, chunk) == want
        plain = TokenDecoder(vocabulary, spaced=False).decode(packed, chunk)
        assert plain.split() == ["crème", "brûlée", "🙂", "한국어", "—", "déjà", "vu", "<|endoftext|>ok"]


def test_tables_with_odd_rows(spark, library):
    encoded = encode_documents(edge(spark, clash=True), PATH)
    assert encoded.columns == ["doc_id", "n_tokens", "ids"]
    rows = decode_documents(encoded.selectExpr("*", "ids as packed", "'x' as decoded"), PATH).collect()
    assert len(rows) == len(edge_rows())
    texts = {}
    for doc_id, text, *_ in edge_rows():
        texts.setdefault(doc_id, []).append(text or "")
    for row in rows:
        own = [library.encode(t, add_special_tokens=False).ids for t in texts[row.doc_id]]
        got = np.frombuffer(row.packed, "<u4").tolist()
        assert got in own and row.n_tokens == len(got)
        assert row.decoded == library.decode(got, skip_special_tokens=False)
    assert encode_documents(empty(spark), PATH).count() == 0


def test_string_identifiers_and_null_ids(spark):
    df = spark.createDataFrame([("x", "One two"), (None, None)], "name string, body string")
    encoded = encode_documents(df, PATH, id_column="name", text="body")
    rows = {r.name: r.decoded for r in decode_documents(encoded, PATH).collect()}
    assert rows == {"x": "one</w> two</w>", None: ""}
    assert decode_documents(spark.createDataFrame([(None,)], "ids binary"), PATH).first().decoded == ""
