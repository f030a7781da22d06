import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from edgeloom.llm import bpe, tokens

from .test_llm import corpus, table

WORD, BYTE = (tokens.public_path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["<|endoftext|>x<|startoftext|>Hi<|endoftext|", "Σίσυφος ΟΔΟΣ", "İstanbul ß ẞ", "café café", "\x1cx\x85y z᠎q", "it's we'LL don'T '''s", "１２３ ½ Ⅷ", "👩‍👧 🇩🇪", "a\x00b", "abc_def __x__", " lead", "trail ", "ab" * 32, "x" * 63, "x" * 65, "don't" * 300, "q" * 5000, "é" * 40, "abc" * 30]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_ids_and_texts_are_those_of_the_library(path):
    own, lib, rng = bpe.RankCodec(path, capacity=60), Tokenizer.from_file(path), random.Random(0)
    texts = [t for _, t in corpus()] + ODD + ["".join(rng.choices("aAbéÉ ' \t\n.,;-_09<|>sStT́σΣßİ中­", k=rng.randint(1, 50))) for _ in range(200)]
    got = own.encode_batch(texts)
    for t, x in zip(texts, got, strict=True):
        want = lib.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(x, "<u4").tolist() == own.encode(t) == want, t
        for skip in (False, True):
            assert own.decode(want, skip) == lib.decode(want, skip_special_tokens=skip)
        if path == BYTE:
            assert own.decode(want) == (t or "")
    assert own.decode([5, own.pad + 9, 7]) == own.decode([5, 7])


def naive(own, word):
    """Merge the least and leftmost pair until none is left."""
    ids, starts = [int(own.inner[b]) for b in word[:-1]] + [int(own.last[word[-1]])], list(range(len(word)))
    while found := min(((own.pair_table[p], k) for k, p in enumerate(zip(ids, ids[1:])) if p in own.pair_table), default=None):
        rank, k = found
        ids[k : k + 2], starts[k : k + 2] = [int(own.made[rank])], [starts[k]]
    return ids, starts


def test_merges_and_boundaries_match_a_plain_version():
    own, rng = bpe.RankCodec(WORD), random.Random(1)
    words = [bytes(rng.choices(b"abetnrs", k=rng.randint(1, 140))) for _ in range(300)] + [b"a" * 64, b"a" * 65, b"the", b"\xff", b"\x00\x00"]
    for w, ids, starts in zip(words, own.merge(words), own.merge(words, spans=True), strict=True):
        assert (np.frombuffer(ids, "<u4").tolist(), np.frombuffer(starts, "<u4").tolist()) == naive(own, w)


def test_tables_of_texts(spark):
    texts = corpus() + [(900 + k, t) for k, t in enumerate(ODD)]
    lib = Tokenizer.from_file(WORD)
    docs = table(spark, texts)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for k, t in texts:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((k is None, k or 0, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))))
    got = bpe.digests(docs, WORD)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((r.doc_id is None, r.doc_id or 0, *r[1:]) for r in got.collect()) == sorted(want)
    back = bpe.decode(bpe.encode(docs, BYTE), BYTE)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(k), t or "") for k, t in texts)
    assert bpe.digests(table(spark, []), WORD).count() == 0
