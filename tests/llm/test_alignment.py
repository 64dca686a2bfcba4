"""Operator 12 against plain Python over whole texts."""

import hashlib
import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from ledgerlens.llm import alignment
from ledgerlens.llm.word_ids import byte_letters

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Ids and bytes of both tokenizations of a whole text, or None where they aren't space + text."""
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    byte_of = {c: x for x, c in byte_letters().items()}

    def piece_bytes(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    def tokens(text):
        if not text:
            return None
        e = a.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(byte_of[c] for c in t)) for i, t in zip(e.ids, e.tokens, strict=True)]
        two = [(i, piece_bytes(i)) for i in b.encode(text)]
        want = (" " + text).encode()
        return (one, two) if b"".join(x for _, x in one) == b"".join(x for _, x in two) == want else None

    return tokens


def aligned(found):
    """groups as text, links, of a pair of tokenizations."""
    one, two = found
    ends = [list(accumulate(len(x) for _, x in side)) for side in found]
    common = sorted(set(ends[0]) & set(ends[1]))
    groups, links, at = [], [], [0, 0]
    for end in common:
        sides = []
        for k, side in enumerate((one, two)):
            first = at[k]
            while ends[k][at[k]] < end:
                at[k] += 1
            at[k] += 1
            sides.append([i for i, _ in side[first : at[k]]])
        groups.append(",".join(map(str, sides[0])) + "|" + ",".join(map(str, sides[1])))
        links.append((sides[0][-1], sides[1][-1]))
    return ";".join(groups), links


def want_rows(rows, plain):
    found = [plain(t) for _, t in rows]
    each = [aligned(f) if f else ("", []) for f in found]
    counts = Counter(x for _, links in each for x in links)
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(n, most.get(b, 0))
    for (i, _), f, (text, links) in zip(rows, found, each, strict=True):
        n = [len(f[0]), len(f[1]), text.count(";") + 1] if f else [0, 0, 0]
        yield (i, *n, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if f else "")


BITS = ["the", " ", "  ", "\n", "\n\n", "\t", "don't", "'s", "École", "é", "ß", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "12", "3.5", "½", "!?", "(", "_", "日本", "\0", "\x1c", "\x85", " ", "　", "😀", "́", "ª", "x" * 30, "»,", "”.", "…]", " ", "Internationalization", "\r\n"]


def test_tokens_are_those_of_whole_texts(plain):
    r = random.Random(5)
    texts = ["".join(r.choice(BITS) for _ in range(r.randint(1, 25))) for _ in range(1200)] + [" ", "  ", "\n", "a ", " a", "▁", "a ▁b ", "x▁ y", "".join(map(chr, range(1, 0x250))), " ".join(map(chr, range(1, 0x600))), "a\n\nb c\n\n", "word " * 2000, "", None]
    for memo in (400_000, 3):
        aligner = alignment.Aligner(A, B, memo)
        assert aligner.cuts
        for at in range(0, len(texts), 100):
            for text, got in zip(texts[at : at + 100], aligner.tokens(texts[at : at + 100]), strict=True):
                want = plain(text)
                assert (got is None) == (want is None), text
                if want:
                    assert [x.tolist() for x in got] == [[i for i, _ in side] for side in want], text
                    n, shown, links = aligner.aligned(*got)
                    groups, pairs = aligned(want)
                    assert (n, shown.decode()) == (groups.count(";") + 1, groups)
                    assert [divmod(x, aligner.n_b) for x in links.tolist()] == pairs


def test_runs_of_any_length_and_shift():
    r = random.Random(9)
    for _ in range(400):
        end = r.randint(1, 400)
        cuts = [sorted({*r.sample(range(1, end + 1), r.randint(0, end)), end}) for _ in range(2)]
        if r.random() < 0.6:  # long stretches alike
            a, b = sorted(r.sample(range(end + 1), 2)) if end > 1 else (0, 1)
            cuts[1] = sorted({x for x in cuts[1] if not a <= x <= b} | {x for x in cuts[0] if a <= x <= b} | {end})
        x, y = alignment.matched_ends(*(np.array(c) for c in cuts))
        common = sorted(set(cuts[0]) & set(cuts[1]))
        assert [cuts[0][i] for i in x] == common and [cuts[1][j] for j in y] == common


def test_alignment_of_documents(spark, docs, rows, empty, plain, equal, monkeypatch):
    want = list(want_rows([(i, t) for i, t, *_ in rows], plain))
    equal(alignment.cross_alignment(docs, A, B).collect(), want)
    monkeypatch.setattr(alignment, "broadcast_if_small", lambda d: d)
    equal(alignment.cross_alignment(docs.repartition(2), A, B).collect(), want)
    assert alignment.cross_alignment(empty, A, B).count() == 0


def test_groups_where_wanted(spark, plain):
    df = spark.createDataFrame([(1, "Internationalization of words"), (2, "▁"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r.groups for r in alignment.alignments(df, A, B, with_groups=True).collect()}
    assert got == {"1": aligned(plain("Internationalization of words"))[0], "2": "", "3": ""}
