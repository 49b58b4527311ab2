"""Ids are remembered by chunk and decoded by column, with the result of word by word."""

import hashlib

import numpy as np

from tallyhouse.llm import bpe, lexicon, queries


class _Unread(dict):
    def __getitem__(self, key):
        raise AssertionError("a token was spelled by itself")


def test_chunks_are_encoded_and_decoded_as_word_by_word(tmp_path):
    model = bpe.Model(queries.TOKENIZER)
    special = next(iter(model.special))
    texts = ["", "  ", "The the THE thE", f"a{special}b {special}", "don't 123 Éa ΑΣ naïve… 中文 \x1c x", "zqxjkv zqxjkv-zqxjkv", ""]
    split = [bpe.split_chunks(t) for t in texts]
    known = sorted({w.encode() for cs in split for c in cs for w in model.words(c) if isinstance(w, str)})[::2]
    path = str(tmp_path / "lexicon.bin")
    lexicon.save(lexicon.compile_words(known, model.merge_all(known)), path)
    want = [[i for c in cs for w in model.words(c) for i in ([w] if isinstance(w, int) else model.merge(w.encode()))] for cs in split]
    spelled = [" ".join(model.tokens[i] for i in ids) for ids in want]

    model.tokens = _Unread(model.tokens)
    coder = bpe.Encoder(model, lexicon.Lexicon(path))
    for again in range(3):  # known, of the older generation, and known once more
        coder.learn({c for cs in split for c in cs})
        raw = [b"".join(coder.ids[c] for c in cs) for cs in split]
        assert [np.frombuffer(r, np.uint32).tolist() for r in raw] == want
        if not again:
            coder.older, coder.ids = coder.ids, {}
    decoded = model.decode(np.frombuffer(b"".join(raw), np.uint32), np.array([len(r) // 4 for r in raw]))
    assert decoded.to_pylist() == spelled
    digests = [hashlib.sha256(t.encode()).hexdigest() for t in spelled]
    assert bpe._digests(decoded) == digests
    assert bpe._digests(decoded.slice(2, 3)) == digests[2:5]
    assert bpe._digests(model.decode(np.zeros(0, np.uint32), np.zeros(2, np.int64))) == [hashlib.sha256(b"").hexdigest()] * 2
