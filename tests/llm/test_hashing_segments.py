"""Hashes, words and token ids against plain Python."""

import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import hashing, segments
from tidemark.llm.byte_bpe import ByteBpe
from tidemark.llm.unigram import DoubleArray, Unigram


def array(text):
    return np.frombuffer(text.encode(), np.uint8)


@given(st.text(st.sampled_from("ab \n\té,"), max_size=40))
def test_words(text):
    words = text.encode().split()
    hashes = hashing.word_hashes(array(text))
    assert len(hashes) == len(words)
    for i, a in enumerate(words):
        assert [a == b for b in words] == (hashes[i] == hashes).tolist()


def test_long_text_in_blocks(monkeypatch):
    rng = random.Random(1)
    text = " ".join("x" * rng.randint(1, 30) + str(rng.randint(0, 99)) for _ in range(2000))
    whole = hashing.word_hashes(array(text))
    monkeypatch.setattr(hashing, "BLOCK", 100)
    assert (hashing.word_hashes(array(text)) == whole).all()


@given(st.lists(st.integers(0, 3), max_size=12))
def test_shingles(words):
    hashes = hashing.mix(np.array(words, np.uint64) + np.uint64(5))
    expected = {tuple(words[i : i + 4]) for i in range(len(words) - 3)} if len(words) >= 4 else {tuple(words)} - {()}
    assert len(hashing.shingles(hashes, 4)) == len(expected)


@pytest.fixture(scope="module")
def bpe():
    return ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))


ALPHABET = ["a", "s", "t", "'", " ", "  ", "\n", "\t", "é", "ß", "1", "²", "!", "..", "'s", "'re", "'ll", "'LL", "日本", "😀", "<|endoftext|>", "ع", "\r\n", "​", "\x85"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), max_size=5))
def test_byte_bpe_equals_the_library(bpe, texts):
    got = [x.tolist() for x in bpe(iter([array(t) for t in texts]))]
    assert got == [bpe.library.encode(t, add_special_tokens=False).ids for t in texts]


def test_byte_bpe_long_text_and_forgetting(bpe, monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))) for _ in range(3000))
    expected = bpe.library.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(segments, "BLOCK", 500)
    monkeypatch.setattr(bpe.coder, "remembered", 50)
    assert next(bpe(iter([array(text)]))).tolist() == expected


def brute(pieces, scores, byte_ids, unknown, text):
    """The best path over all ways to cut ``text``; ties to the piece that starts first."""
    table = {p.replace("▁", " "): i for i, p in enumerate(pieces) if p and i not in byte_ids.values() and i != unknown}
    low = min(scores[i] for i in table.values()) - 10
    best = [(0.0, [])] + [None] * len(text)
    for i in range(len(text)):
        if best[i] is None:
            continue
        for j in range(i + 1, len(text) + 1):
            part = text[i:j]
            if part in table:
                way = (best[i][0] + scores[table[part]], best[i][1] + [table[part]])
            elif j == i + 1:
                way = (best[i][0] + low, best[i][1] + [byte_ids[b] for b in part.encode()])
            else:
                continue
            if best[j] is None or way[0] > best[j][0]:
                best[j] = way
    return best[-1][1]


@pytest.fixture(scope="module")
def small():
    pieces = ["<unk>", *(f"<0x{b:02X}>" for b in range(256)), "▁", "▁▁", "a", "b", "ab", "▁ab", "aba", "é", "ba", "▁b"]
    rng = random.Random(4)
    scores = [0.0] * 257 + [-float(rng.randint(1, 6)) for _ in pieces[257:]]
    byte_ids = {b: b + 1 for b in range(256)}
    return pieces, scores, byte_ids, Unigram(pieces, scores, byte_ids, 0, set())


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab é▁日\n"), max_size=14))
def test_unigram_is_the_best_path(small, text):
    pieces, scores, byte_ids, model = small
    marked = " " + text.replace("▁", " ") if text else ""
    expected = brute(pieces, scores, byte_ids, 0, marked)
    got = next(model.encode(iter([array(text)])))
    assert got.tolist() == expected == model.viterbi(marked.encode())
    assert model.decode(got) == text.replace("▁", " ")


def test_unigram_on_a_public_vocabulary():
    """No worse than the library's own unigram search over the same pieces, and equal where no two ways are near."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = Unigram.load(path)
    raw = open(path, "rb").read()
    at = raw.rindex(b"\x18\x02", 0, raw.rindex(b"identity"))
    head = raw.rindex(b"\x12\x06tok_v0\x18\x02")
    assert head <= at
    library = sentencepiece.SentencePieceProcessor(model_proto=raw[:head] + raw[head:].replace(b"\x12\x06tok_v0\x18\x02", b"\x12\x06tok_v0\x18\x01", 1))
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choice(["ing", "er", "qu", "é", "日", "x", "ion"]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 3))) for _ in range(300)]
    score = lambda ids: sum(model.scores[i] for i in ids)
    for text, ids in zip(texts, model.encode(iter([array(t) for t in texts]))):
        assert score(ids) >= score(library.encode(text))
        assert model.decode(ids) == text


def test_double_array_finds_its_keys_only():
    keys = {bytes(k, "ascii"): i for i, k in enumerate(["a", "ab", "abc", "b", "bcd", "zz"])}
    trie = DoubleArray.build(keys)

    def find(word):
        state = 0
        for c in word:
            to = int(trie.base[state]) + c
            if to >= len(trie.check) or trie.check[to] != state:
                return -1
            state = to
        return int(trie.value[state])

    assert all(find(k) == v for k, v in keys.items())
    assert [find(w) for w in (b"bc", b"z", b"abcd", b"c", b"")] == [-1] * 5


def test_encode_decode_rows(docs):
    """Null, empty and repeated rows, columns of clashing names, a word of many thousand bytes, an empty table."""
    import public_tokenizers

    from tidemark.llm.unigram import encode_decode

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = [None, "", " ", "plain words", "x" * 3000, "\u65e5\u672c\u8a9e" * 400, "emoji \U0001f600 and \x00 bytes", "a  b\n\tc "]
    rows = encode_decode(docs([*texts, (3, "plain words"), (None, "plain words")]).withColumnRenamed("score", "n_ids"), path).collect()
    assert len(rows) == len(texts) + 2 and all(r.round_trip for r in rows)
    by_id = {i: [r for r in rows if r.doc_id == i] for i in [*range(len(texts)), None]}
    assert [(r.n_ids, r.ids_crc32) for i in (0, 1) for r in by_id[i]] == [(0, 0), (0, 0)]
    assert len(by_id[3]) == 2 and len({(r.n_ids, r.ids_crc32) for r in by_id[3] + by_id[None]}) == 1
    assert by_id[6][0].n_byte_ids > 0 and by_id[3][0].n_byte_ids == 0
    model = Unigram.load(path)
    for i, t in enumerate(texts[3:], 3):
        ids = next(model.encode(iter([np.frombuffer(t.encode(), np.uint8)])))
        assert by_id[i][0].n_ids == len(ids) and model.decode(ids) == t
    assert encode_decode(docs([]).limit(0), path).count() == 0
