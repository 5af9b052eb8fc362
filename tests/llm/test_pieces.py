"""The token encoder's remembered pieces: equal hashes, many slices, forgetting."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm import _words, token_files


def texts_of(seed, count=400):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 5)))
    return ["", "a", *("".join(r.choice([" ", " ", " ", "\n", ", ", "-", " 12", "  ", "<|endoftext|>"] if r.random() < 0.9 else ["  "]) + word() for _ in range(r.randint(0, 60))) for _ in range(count))]


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    ids, counts = encoder.encode(np.concatenate(([0], np.cumsum([len(x) for x in raw]))), np.frombuffer(b"".join(raw), dtype=np.uint8))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


@pytest.fixture(scope="module")
def path():
    return token_files.tokenizer_path()


@pytest.fixture(scope="module")
def truth(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    return lambda texts: [[*t.encode(x, add_special_tokens=False).ids, token_files.END_ID] for x in texts]


@pytest.mark.parametrize("hashes", [1, 7, 300])
def test_pieces_of_one_hash_are_told_apart(monkeypatch, path, truth, hashes):
    spans = _words.spans
    monkeypatch.setattr(_words, "spans", lambda *a: spans(*a) % np.uint64(hashes))
    encoder = token_files.Encoder(path, True)
    for seed in (1, 2):
        texts = texts_of(seed)
        assert encoded(encoder, texts) == truth(texts)


def test_what_is_forgotten_is_learned_again(monkeypatch, path, truth):
    monkeypatch.setattr(token_files, "REMEMBERED", 300)
    encoder = token_files.Encoder(path, True)
    held = []
    for seed in range(8):
        texts = texts_of(seed, 60)
        assert encoded(encoder, texts) == truth(texts)
        held.append(encoder.known.n)
    assert max(held) > 300 and held[-1] < sum(held) / 2
    # nothing was met twice
    alone = token_files.Encoder(path, True)
    encoded(alone, texts_of(9))
    alone.known.forget_rare(150)
    assert alone.known.n == 0 and encoded(alone, texts_of(9)) == truth(texts_of(9))


def test_table_finds_all_it_was_given():
    known, r = token_files._Known(), np.random.default_rng(3)
    hashes = np.unique(np.concatenate([r.integers(0, 2**63, 30_000), np.arange(5000) << 20])).astype(np.uint64)
    for part in np.array_split(hashes, 9):
        known.add(part, [str(x).encode() for x in part.tolist()], [[int(x) % 97] * (int(x) % 3) for x in part.tolist()])
    numbers = known.find(hashes)
    assert numbers.tolist() == list(range(len(hashes))) and (known.find(hashes + np.uint64(1 << 63)) == -1).all()
    assert known.bytes[known.byte_at[7] : known.byte_at[8]].tobytes() == str(hashes[7]).encode()
    known.uses[np.arange(0, len(hashes), 2)] = 5
    known.forget_rare(100)
    assert known.n == 100 and (known.find(hashes) >= 0).sum() == 100
