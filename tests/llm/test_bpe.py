import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer as Library

from paperloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.load_vocabulary(PATH))


def texts():
    rng = random.Random(3)
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "ß", "œ", "1", "²", "!", "$", "<|endoftext|>", "՘", "\U0001f600", "the", "ing", "'s", "'re",
             " ", "\x1c", "　", "日本", "\U00010940", "aaaaaaaa", "\x85", "​", "AB"]
    yield from ("", " ", "a" * 3000, "ab" * 2000, " " * 900 + "x", "etaoin" * 1500, "<|endoftext|>")
    for _ in range(4000):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))
    for _ in range(3000):
        yield "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), rng.randrange(0x3000, 0xD7FF)])) for _ in range(rng.randint(0, 30)))


def test_same_ids_and_text_as_the_library(codec, library):
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        got = codec.encode(t)
        assert got.tolist() == ids, t[:60]
        assert codec.decode(got.astype("int64")) == library.decode(ids, skip_special_tokens=False) == t


def test_random_merges_match_a_replay(codec):
    """The walk against merging step by step, on random bytes."""
    rng = random.Random(5)
    for _ in range(300):
        piece = bytes(rng.choice(b"aeinrst ") for _ in range(rng.randint(1, 14)))
        parts = [codec.ids[bytes([b])] for b in piece]
        while True:
            ranked = [(codec.pairs[a * codec.size + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a * codec.size + b in codec.pairs]
            if not ranked:
                break
            _, i = min(ranked)
            parts[i:i + 2] = [codec.ids[codec.tokens[parts[i]] + codec.tokens[parts[i + 1]]]]
        assert codec.encode_piece(piece.decode()) == parts


def test_linear_in_one_long_piece(codec):
    assert codec.decode(codec.encode("ab" * 100_000).astype("int64")) == "ab" * 100_000


def test_frame_edges(spark, library):
    rows = [(1, None, "x", 5), (2, "", "x", None), (3, "Of the the the " * 4000, "y", 1), (3, "twice", None, 2), (3, "twice", None, 2), (None, "a<|endoftext|>b", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, token_ids string, n_tokens int")
    t = bpe.Tokenizer(spark, PATH)
    out = bpe.decode_ids(bpe.encode_texts(df, t), t).collect()
    assert len(out) == 6
    for r in out:
        assert list(r.token_ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == (r.text or "")
    digests = bpe.round_trip_digests(df, t)
    assert digests.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and digests.count() == 6
    assert bpe.round_trip_digests(df.limit(0), t).count() == 0
