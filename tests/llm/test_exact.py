"""Operators 5, 7 and 10 against plain Python."""

import hashlib
import re

from ledgerlens.llm import exact_dedup, mixing, token_counts


def test_exact_dedup(docs, rows, empty, equal):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t, *_ in rows:
        groups.setdefault(norm(t), []).append(i)

    def want(i, t):
        ids = groups[norm(t)]
        keep = min((x for x in ids if x is not None), default=None)
        return i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()

    for block in (4096, 7):
        got = exact_dedup.exact_dedup(docs, block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        equal(got, [want(i, t) for i, t, *_ in rows])
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_blocks_with_one_fingerprint_keep_their_names(spark, monkeypatch, equal):
    """Where all fingerprints clash, contents alone tell blocks apart."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
    df = spark.createDataFrame([(1, "aaabbb"), (2, "aaaccc"), (3, "aaabbb"), (4, "bbb"), (5, None)], "doc_id long, text string")
    got = exact_dedup.exact_dedup(df, 3).select("doc_id", "keep_id").collect()
    equal(got, [(1, 1), (2, 2), (3, 1), (4, 4), (5, 5)])


def test_clashes_beside_null_and_large_ids(spark, monkeypatch, equal):
    """Null and repeated ids on the path of clashing fingerprints, and more repeated prints than may be broadcast."""
    from pyspark.sql import functions as F

    big = 2**60 + 1
    rows = [(None, "aaabbb"), (None, "aaaccc"), (big, "aaabbb"), (big + 2, "aaaccc"), (7, "x"), (7, "y"), (big + 4, "aaabbb")]
    want = [(None, big, 3), (None, big + 2, 2), (big, big, 3), (big + 2, big + 2, 2), (7, 7, 1), (7, 7, 1), (big + 4, big, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for clash, shuffled in ((False, False), (False, True), (True, False), (True, True)):
        with monkeypatch.context() as m:
            if clash:
                m.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(1).cast("long"))
            if shuffled:
                m.setattr(exact_dedup, "broadcast_if_small", lambda d: d)
            equal(exact_dedup.exact_dedup(df, 3).select("doc_id", "keep_id", "group_size").collect(), want)


def test_mixing(docs, rows, empty):
    got = mixing.mix(docs, block_words=4).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((repr(r.doc_id), r.size) for r in got) == sorted((repr(i), count(t)) for i, t, *_ in rows)
    sizes, targets, taken = {}, {}, {}
    of = {}
    for i, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + count(t)
        of.setdefault((i, count(t)), []).append(s)
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    open_, left = set(order), sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not full:
            break
        targets |= {s: 3 * sizes[s] for s in full}
        left -= sum(3 * sizes[s] for s in full)
        open_ -= full
    targets |= {s: weight[s] * level for s in open_}
    for r in got:
        assert r.taken <= 3 * r.size
        assert any(abs(r.target - targets[s]) < 1e-6 * max(1, targets[s]) and r.source_size == sizes[s] for s in of[(r.doc_id, r.size)])
        taken[r.target] = taken.get(r.target, 0) + r.taken
    for target, n in taken.items():
        assert abs(n - target) <= 4 * 20, (target, n)
    again = mixing.mix(docs.repartition(5), block_words=4).collect()
    assert sorted(map(repr, again)) == sorted(map(repr, got))
    assert mixing.mix(empty).count() == 0


def test_van_der_corput(spark):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(64).select(mixing._point(F.col("id"))).collect()]
    assert got == [int(format(i, "052b")[::-1], 2) for i in range(64)]


def test_token_counts(docs, rows, empty, equal):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole = Tokenizer.from_file(path)
    n = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), n(t), n(t) > 512) for i, t, *_ in rows]
    for chunk, overlap in ((32_768, 512), (300, 8)):
        equal(token_counts.token_counts(docs, path, chunk_chars=chunk, overlap_chars=overlap).collect(), want)
    assert token_counts.token_counts(empty, path).count() == 0


def test_splicing_of_odd_texts():
    import random

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    whole, r = Tokenizer.from_file(path), random.Random(3)
    bits = [" ", "  ", "\n", "a", "Don't", "'s", " ", "　", "é", "<|endoftext|>", "<|endo", "123", "!?", "\t", "日本", "\0", "\x1c", " x", "😀", "'ll"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(0, 60))) for _ in range(400)] + ["a" * 3000, " " * 2000, "ab " * 1000]
    want = [len(e.ids) for e in whole.encode_batch(texts, add_special_tokens=False)]
    for chunk, overlap in ((32_768, 512), (40, 4), (10, 2)):
        assert token_counts.Counter(path, chunk, overlap).counts(texts) == want
