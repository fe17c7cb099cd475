import random
from collections import Counter
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from segmenta.llm import bpe

PATH = public_tokenizers.path(bpe.VOCABULARY)
PIECES = ["a", "'", "'s", "'ll", "'v", " ", "  ", "\n", "\r\n", "\xa0", "é", "ß", "1", "٣", "²", "!", "?!", "<|endoftext|>", "<|end", "🙂", "\x1c", "\x85", " the", "ing", "日本", "ñ", "-", "e", "l", "r", "\0", "İ"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts(n, seed=1):
    rng = random.Random(seed)
    for k in range(n):
        text = "".join(rng.choice(PIECES) for _ in range(rng.randrange(60)))
        if k % 25 == 0:
            text = rng.choice(["aab", " ", "!?", "é", "the", "\n"]) * rng.randrange(100, 1500) + text + "".join(rng.choice("abc") for _ in range(900)) + text
        yield text


def test_encoding_and_streaming_equal_the_library(library, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK", 400)
    machine = bpe.Encoder(PATH, bits=8)
    for text in texts(400):
        want = library.encode(text, add_special_tokens=False).ids
        assert list(machine.encode([text]))[0].tolist() == want
        assert [i for c in machine.stream([text[k : k + 37] for k in range(0, len(text), 37)]) for i in c.tolist()] == want
        assert "".join(bpe.decode(machine.vocab, np.array(want, np.int32), 3)) == library.decode(want, skip_special_tokens=False)


def test_batches_equal_single_texts():
    machine, every = bpe.Encoder(PATH), list(texts(200, 2))
    assert [x.tolist() for x in machine.encode(every)] == [list(machine.encode([t]))[0].tolist() for t in every]


def test_the_lookahead_suffices():
    vocab, rng = bpe.vocabulary(PATH), random.Random(3)
    words = [t for t in vocab.tokens if t.isalpha() and len(t) > 1]
    for k in range(40):
        piece = b"".join(rng.choice(words) for _ in range(200)) if k % 2 else bytes(rng.choice(b"aeinst") for _ in range(1500))
        full = vocab.merge_one(piece)
        machine = bpe.Transducer(vocab)
        got = [i for at in range(0, len(piece), 11) for i in machine.feed(piece[at : at + 11])]
        assert len(machine.held) <= machine.window + 11
        assert got + machine.finish() == full


def test_broken_bytes_decode_like_the_library(library):
    ids = [i for i in range(256) if len(bpe.vocabulary(PATH).tokens[i]) == 1]
    rng = random.Random(4)
    for _ in range(200):
        some = [rng.choice(ids) for _ in range(12)]
        assert "".join(bpe.decode(bpe.vocabulary(PATH), np.array(some), 2)) == library.decode(some, skip_special_tokens=False)


def test_query_rows(docs, rows, empty, library):
    got = Counter(tuple(r) for r in bpe.round_trip(docs, PATH).collect())
    want = Counter()
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want[doc_id, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256((text or "").encode()).hexdigest()] += 1
    assert got == want
    assert bpe.round_trip(empty, PATH).count() == 0
