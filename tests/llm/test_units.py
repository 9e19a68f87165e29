"""Coders look at distinct units and words once, and texts cut by Arrow are encoded as the libraries encode them whole (FINDINGS_r03, F1, F4, F5)."""

import random

import pyarrow as pa
import pytest

from framewright.llm import bpe, packing, sstable, units

public_tokenizers = pytest.importorskip("public_tokenizers")
A, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def odd_texts(seed):
    rng = random.Random(seed)
    signs = [" ", " ", "  ", "\n", "a", "word", "Été", ".", ",;", "!?", "ab.\nAb", "x\n\ny", "\t", "\x1c", "\x85", "\xa0", "é", "日本", "²", "̇", "'s", "12", "<|endoftext|>", "word.\nOther,"]
    return [None, "", " ", "  ", "\n", " a", "a "] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 14))) for _ in range(3000)]


def test_words_are_encoded_once_whatever_marks_stand_behind():
    """a word with marks or a line's end is put together from parts that are known."""
    m = units.Memory(units.ByteLevel(open(A, encoding="utf-8").read()))
    m.learn(["several", "words", "line"])
    seen, ids = [], m.coder.ids
    m.coder.ids = lambda texts: seen.extend(texts) or ids(texts)
    m.learn(["several,", "words.", "words!?", "line.\nwords,", "several"])
    assert not any("several" in x or "line" in x for x in seen) and sum("words" in x for x in seen) == 1
    whole = m.coder.tokenizer
    for k in ("several,", "words.", "words!?", "line.\nwords,"):
        assert m.found[k] == b"".join(i.to_bytes(4, "little") for i in whole.encode(" " + k, add_special_tokens=False).ids)


def test_documents_to_pack_are_encoded_as_the_whole():
    """heads, nulls, white space of all kinds."""
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(A), odd_texts(31)
    own.encode_special_tokens = True
    coder = packing.DocumentCoder(open(A, encoding="utf-8").read())
    for _ in range(2):  # met and remembered
        for t, ids in zip(texts, coder.encode(pa.array(texts), 1)):
            assert ids.tolist() == own.encode(t or "", add_special_tokens=False).ids + [1], repr(t)


def test_words_of_shards_are_cut_as_the_library_cuts():
    """distinct words of a group of documents are looked up once; sliced arrays and nulls are read as they are."""
    from tokenizers import Tokenizer

    own, texts = Tokenizer.from_file(WORDS), odd_texts(32)
    own.encode_special_tokens = True
    coder = sstable.WordCoder(open(WORDS, encoding="utf-8").read())
    coder.tokenizer.encode_special_tokens = True
    for t, ids in zip(texts[5:], coder.packed(pa.array(texts).slice(5)).to_pylist()):
        assert ids == b"".join(i.to_bytes(4, "little") for i in own.encode(t or "", add_special_tokens=False).ids), repr(t)
    looked = []
    parts, coder.parts = coder.parts, lambda w: looked.append(w) or parts(w)
    coder.packed(pa.array(["fresh fresh fresher", "fresh fresher"]))
    assert sorted(looked) == ["fresh", "fresher"]


def test_the_pattern_is_looked_for_in_distinct_units():
    """matches are those of the whole texts."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coder, texts = bpe.Coder(list(ranks), list(ranks.values()), public_tokenizers.PATTERN), odd_texts(33)
    got = coder.packed(pa.array(texts))
    coder.learn({w for t in texts for w in coder.find(t or "")})
    assert got.to_pylist() == [b"".join(coder.words[w] for w in coder.find(t or "")) for t in texts]
    assert coder.decode(got).to_pylist() == [(t or "").encode() for t in texts]
    looked = []
    find, coder.find = coder.find, lambda t: looked.append(t) or find(t)
    coder.packed(pa.array(["one fresh fresh", "one fresh"]))
    assert sorted(looked) == [" fresh", "one"]
