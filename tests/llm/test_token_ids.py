"""Operator 11: the coder, the encoder by words, and files written and read, against plain Python."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import token_files
from ledgerlens.llm.simple8b import BLOCK, COUNTS, pack, unpack
from ledgerlens.llm.word_ids import WordEncoder

PATH = public_tokenizers.path("word_bpe_49k.json")


def plain_words(ids):
    """Greedy Simple-8b of one block, id by id: the number of ids in each word."""
    from ledgerlens.llm.simple8b import BITS

    out, at = [], 0
    while at < len(ids):
        if ids[at] >= 1 << 60:
            out.append(1)
        else:
            out.append(next(int(n) for n, bits in zip(COUNTS[1:], BITS[1:], strict=True) if all(x < 1 << int(bits) for x in ids[at : at + int(n)])))
        at += out[-1]
    return out


def cases():
    r = random.Random(4)
    odd = [0, 1, 2**60 - 1, 2**60, 2**64 - 1, 2**53 + 1, 2**20 - 1, 2**20]
    yield from ([], [0], [2**64 - 1], [0] * 1000, [1] * BLOCK, [5] * (BLOCK + 1))
    for n in (3, BLOCK - 1, BLOCK, 3 * BLOCK + 7):
        yield [r.choice(odd) for _ in range(n)]
        yield [r.getrandbits(r.randint(1, 64)) for _ in range(n)]
        yield [r.randint(0, 49_407) for _ in range(n)]
        yield [0 if r.random() < 0.97 else r.randint(0, 9) for _ in range(n)]


def test_words_come_back_and_are_as_full_as_greedy():
    for ids in cases():
        packed = pack(np.array(ids, np.uint64))
        assert unpack(packed, len(ids)).tolist() == ids
        blocks = [ids[i : i + BLOCK] for i in range(0, len(ids), BLOCK)]
        assert packed.block_words.tolist() == [len(plain_words(b)) for b in blocks]
        assert packed.block_escapes.tolist() == [sum(x >= 1 << 60 for x in b) for b in blocks]


def test_encoding_by_words_is_encoding_of_whole_texts():
    r = random.Random(2)
    bits = ["The", " ", "  ", "\n", "\t", "don't", "'S", "ÉCOLE", "é", "é", "ΑΣ", "Σ", "İ", "ß", "ẞ", "<|endoftext|>", "<|endo", "12", "½", "!?", "_", "日本", "\0", "\x1c", "\x85", " ", "😀", "́", "</w>", "ª", "µ", "x" * 40, "ﬁ", "'ll've", " "]
    texts = ["", " "] + ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(1500)] + ["".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x600)))]
    whole = Tokenizer.from_file(PATH)
    for memo in (500_000, 3):
        encoder = WordEncoder(PATH, memo)
        assert encoder.by_word
        for i in range(0, len(texts), 100):
            got = [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts[i : i + 100])]
            assert got == [whole.encode(t, add_special_tokens=False).ids for t in texts[i : i + 100]]


def test_other_files_are_encoded_text_by_text():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = WordEncoder(path)
    assert not encoder.by_word
    assert np.frombuffer(encoder.encode(["a  b\n c"])[0], "<u4").tolist() == Tokenizer.from_file(path).encode("a  b\n c", add_special_tokens=False).ids


@pytest.mark.parametrize("segment_ids", [4_000_000, 500])
def test_files_hold_all_ids_in_order(docs, rows, tmp_path, segment_ids):
    whole = Tokenizer.from_file(PATH)
    want = sorted(((i, [*whole.encode(t or "", add_special_tokens=False).ids, 1]) for i, t, *_ in rows), key=lambda x: (x[0] is None, x[0]))
    got = token_files.token_files(docs, PATH, str(tmp_path), segment_ids=segment_ids, with_ids=True).collect()
    assert sorted(map(repr, ((r.doc_id, list(r.ids)) for r in got))) == sorted(map(repr, want))
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert [r.start for r in got] == [sum(len(x.ids) for x in got[:k]) for k in range(len(got))]
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    assert len(list(tmp_path.glob("*.s8b"))) > (5 if segment_ids == 500 else 0)


def test_any_stretch_is_decoded_from_its_blocks():
    segment, r = token_files._Segment(), random.Random(1)
    ids = [[r.randint(0, 2**32 - 1) for _ in range(n)] for n in (0, 1, 700, 255, 3)]
    for k, x in enumerate(ids):
        segment.add(None if k == 1 else f"é{k}", np.array(x, "<u4").tobytes())
    back, flat = token_files.Segment(segment.data(3, 4)), sum(ids, [])
    assert (back.shard, back.number, back.n, back.names) == (3, 4, len(flat), ["é0", None, "é2", "é3", "é4"])
    for a, b in ((0, 0), (0, 1), (255, 257), (256, 512), (700, len(flat)), (0, len(flat))):
        assert back.ids(a, b).tolist() == flat[a:b]
    with pytest.raises(ValueError, match="segment"):
        token_files.Segment(segment.data(3, 4)[:-1])


def test_empty_table_and_text_ids(spark, empty, tmp_path):
    assert token_files.token_files(empty, PATH, str(tmp_path)).count() == 0
    df = spark.createDataFrame([("b", None), ("a", "hello"), (None, "x")], "doc_id string, text string")
    got = [tuple(r) for r in token_files.token_files(df, PATH).select("doc_id", "start", "n_tokens").orderBy("start").collect()]
    assert [(i, n) for i, _, n in got] == [("a", 2), ("b", 1), (None, 2)] and [s for _, s, _ in got] == [0, 2, 3]
