"""Operators 3, 4, 6, 9 and the pipeline against plain Python."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import decontamination, ngram_join, toxicity, warc_store
from ledgerlens.llm.common import without
from ledgerlens.llm.components import components


def shingles(text, k=4):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def component_of(rows, percent=85, k=4):
    sets = [shingles(t, k) for _, t, *_ in rows]
    group = list(range(len(rows)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    ids = {}
    for i, (d, *_) in enumerate(rows):
        if d is not None:
            ids[top(i)] = min(ids.get(top(i), d), d)
    return [(d, len(sets[i]), ids.get(top(i)) if sets[i] else d) for i, (d, *_) in enumerate(rows)]


def test_ngram_join(docs, rows, empty, equal):
    equal(ngram_join.near_duplicates(docs).select("doc_id", "n_shingles", "component_id").collect(), component_of(rows))
    assert ngram_join.near_duplicates(empty).count() == 0


def test_chains_and_borderline_pairs(spark, equal):
    """Families of edits around the threshold, so that links chain and some just fail."""
    r, rows = random.Random(9), []
    for family in range(12):
        n = r.choice([4, 5, 9, 14, 40, 150, 400])
        words = [f"f{family}w{i}" for i in range(n)]
        for _ in range(8):
            rows.append((len(rows), " ".join(words)))
            for _ in range(max(1, n // 60)):
                words[r.randrange(n)] = f"x{r.random()}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    equal(ngram_join.near_duplicates(df).select("doc_id", "n_shingles", "component_id").collect(), component_of(rows))


def test_pieces_never_miss_a_link():
    import numpy as np

    r, bands = np.random.default_rng(1), ngram_join.Bands()
    for _ in range(300):
        n = int(r.integers(2, 800))
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        d = ngram_join.most_different(len(a), len(a))
        drop = int(r.integers(0, d + 1))
        b = np.unique(np.concatenate([a[drop // 2 :], r.integers(0, 2**63, drop - drop // 2).astype(np.uint64)]))
        same = len(np.intersect1d(a, b))
        if len(a) and len(b) and 100 * same >= 85 * (len(a) + len(b) - same) and not np.array_equal(a, b):
            assert len(np.intersect1d(ngram_join.keys_of(a, bands), ngram_join.keys_of(b, bands)))
            assert ngram_join.hamming(ngram_join.sketch_of(a), ngram_join.sketch_of(b)) <= len(a) + len(b) - 2 * same


def test_crowded_keys_lose_no_link(spark, equal):
    """Many texts around the threshold that share keys, with every key over the bound dealt again."""
    from tests.llm.conftest import passage

    r, common, rows = random.Random(3), passage(1, 60), []
    for i in range(150):
        own = passage(500 + i // 3, 30).split()
        own[r.randrange(30)] = f"z{i}"
        rows.append((i, f"{common} {' '.join(own)}" if i % 5 else f"{common} {passage(900 + i, 4)}"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (2, 8, 4096):
        got = ngram_join.near_duplicates(df, hot=hot).select("doc_id", "n_shingles", "component_id").collect()
        equal(got, component_of(rows))


def test_sets_of_every_size_share_a_key_with_any_set_they_link(spark):
    """Random sets just over the threshold, sizes 1 to 3,000, at both of the limits in use."""
    import numpy as np

    g = np.random.default_rng(5)
    for shingle_percent in (85, 80):
        bands = ngram_join.Bands(shingle_percent)
        for n in [*range(1, 60), *range(60, 3000, 97)]:
            for _ in range(4):
                a = np.unique(g.integers(0, 2**63, n).astype(np.uint64))
                m = int(g.integers(n, n * 100 // shingle_percent + 1))
                same = -(-shingle_percent * (n + m) // (100 + shingle_percent))
                if same > min(n, m):
                    continue
                b = np.unique(np.concatenate([g.permutation(a)[:same], g.integers(0, 2**63, m - same).astype(np.uint64)]))
                if 100 * same >= shingle_percent * (len(a) + len(b) - same) and not np.array_equal(a, b):
                    for deal in (0, 1):
                        assert len(np.intersect1d(ngram_join.keys_of(a, bands, deal), ngram_join.keys_of(b, bands, deal))), (n, m, same)


def test_word_hashes_follow_the_words():
    """Equal words have equal hashes and others don't, in slices of any size and in very long words."""
    from ledgerlens.llm import words
    from tests.llm.conftest import passage

    text = "a b  aa ab ba A " + "é😀 \x00 x\x00 \x00x " + "x" * 70_000 + " " + "x" * 70_001 + " " + passage(3, 20_000) + "\n" + "y" * 65 + " " + "y" * 66
    for split, hashed in ((lambda t: t.encode().lower().split(), words.spaced_hashes), (words.words_of, words.word_hashes)):
        plain, h = split(text), hashed(text).tolist()
        assert len(plain) == len(h)
        assert len(set(plain)) == len(set(h)) == len(set(zip(plain, h, strict=True)))
    for t in ("", " ", "\n\t", "x" * 70_000, " " * 70_000, "a" + " " * 70_000 + "b", "p" * 65_535 + " q", "p" * 65_536 + " q"):
        assert len(words.spaced_hashes(t)) == len(t.split())


def test_components(spark, equal):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 100), (7, 7), (300, 301), (302, 301)]
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    equal(got, [(i, 0) for i in range(41)] + [(100, 100), (200, 100), (300, 300), (301, 300), (302, 300)])


def coverage(item, doc, k=5):
    """Greedy string tiling, the plain way."""
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    p, t = word(item), word(doc)
    mp, mt, total = [False] * len(p), [False] * len(t), 0
    while True:
        best, found = k - 1, []
        for i in range(len(p)):
            for j in range(len(t)):
                n = 0
                while i + n < len(p) and j + n < len(t) and p[i + n] == t[j + n] and not mp[i + n] and not mt[j + n]:
                    n += 1
                if n > best:
                    best, found = n, [(i, j)]
                elif n == best and n >= k:
                    found.append((i, j))
        if not found:
            return total / max(1, len(p))
        for i, j in found:
            if not any(mp[i : i + best]) and not any(mt[j : j + best]):
                mp[i : i + best] = [True] * best
                mt[j : j + best] = [True] * best
                total += best


def test_tiling(spark, empty):
    from tests.llm.conftest import passage

    items = [(1, passage(1, 40)), (2, passage(2, 24)), (3, "too short"), (4, None), (5, passage(1, 40))]
    a = items[0][1].split()
    texts = [
        passage(50, 100) + " " + items[0][1] + " " + passage(51, 50),
        " ".join(a[20:] + ["cut"] + a[:20]),
        " ".join(a[:10] + ["x"] + a[10:14] + ["y"] + a[14:21]),
        items[1][1].upper().replace(" ", ", "),
        passage(60, 200),
        None,
        "",
        " ".join(a[:6] * 5),
    ]
    docs = [*enumerate(texts), (0, texts[0]), (None, items[1][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("seeds", F.lit(1)).withColumn("coverage", F.lit(1))
    got = decontamination.contaminated(df, spark.createDataFrame(items, "item_id long, text string"))
    want = {(d, i): coverage(item, t) for d, t in docs for i, item in items}
    assert {(r.doc_id, r.item_id): round(r.coverage, 9) for r in got.collect()} == {k: round(c, 9) for k, c in want.items() if c >= 0.5}
    assert decontamination.contaminated(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert decontamination.contaminated(df, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_tiles_equal_plain_tiling():
    import numpy as np

    from ledgerlens.llm.words import word_hashes

    r = random.Random(12)
    for n in range(600):
        few = r.choice([2, 3, 8])
        item = [f"w{r.randrange(few)}" for _ in range(r.randint(5, 30))]
        doc = [f"w{r.randrange(few)}" for _ in range(r.randint(0, 20))]
        for _ in range(r.randint(0, 4)):
            i, j = r.randrange(len(item)), r.randint(0, len(doc))
            doc[j:j] = item[i : i + r.randint(1, 12)]
        item, doc = " ".join(item), " ".join(doc)
        tiles = decontamination.greedy_tiles(word_hashes(item), word_hashes(doc))
        assert sum(k for _, _, k in tiles) / len(item.split()) == coverage(item, doc), (item, doc)
        for s, d, k in tiles:
            assert item.split()[s : s + k] == doc.split()[d : d + k]
    one = np.full(20_000, 7, np.uint64)
    began = time.time()
    assert decontamination.greedy_tiles(one[:60], one) == [(0, 0, 60)]
    decontamination.greedy_tiles(np.concatenate([one[:40], word_hashes("a b c d e f")]), np.concatenate([one[:4000], word_hashes("a b c d e")] * 5))
    assert time.time() - began < 2


def test_tiling_keeps_ids_and_pairs_of_common_phrases(spark):
    """Ids over 2**53 beside null ids; a phrase that stands in every item; a very long text."""
    from tests.llm.conftest import passage

    big, phrase = 2**60 + 1, "answer the following question with one single word"
    items = [(big + i, f"{phrase} {passage(200 + i, 18)}") for i in range(30)] + [(None, passage(300, 20)), (5, f"{phrase} please")]
    docs = [(big, items[3][1]), (None, f"so {items[30][1]} x"), (big + 2, f"{passage(1, 40_000)} {items[4][1]} {passage(2, 10)}"), (None, phrase), (big + 4, f"{phrase} {passage(9, 30)}"), (None, None)]
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    short = [(d, t) for d, t in docs if t is None or len(t) < 5000]
    want = {(d, i) for d, t in short for i, item in items if coverage(item, t) >= 0.5} | {(big + 2, items[4][0]), (big + 2, 5)}
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want and len(want) >= 5


def test_items_of_few_words_match_as_a_whole(spark):
    """Items of 1 to 4 words against a plain search, beside longer ones, repeats, nulls and items without words."""
    from tests.llm.conftest import passage

    r, words = random.Random(3), ["ab", "cd", "ef", "gh", "ij"]
    items = [(i, " ".join(r.choice(words) for _ in range(1 + i % 4))) for i in range(40)] + [(40, passage(5, 30)), (41, None), (42, " ,. "), (None, "Never Said"), (43, "ab ab ab ab ab")]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 12)))) for i in range(60)] + [(60, f"x {items[40][1]} y"), (61, None), (62, passage(6, 20_000) + " IJ,\n gh"), (63, "ab " * 3000)]
    got = {(x.doc_id, x.item_id): x.coverage for x in decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9]+", (t or "").lower())) + " "
    want = {(d, i) for d, t in docs for i, x in items if plain(x).strip() and plain(x) in plain(t)}
    assert set(got) == want and set(got.values()) == {1.0} and len(want) > 100


def test_toxicity(spark, docs, empty):
    import zlib

    from tests.llm.conftest import TOXIC, passage

    r, rows, labels = random.Random(4), [], []
    for i in range(600):
        bad = i % 4 == 0
        words = passage(1000 + i, 40).split()
        if bad:
            words[r.randrange(40)] = r.choice(TOXIC)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (None, "you idiot clown"), (0, rows[0][1])]
    labels += [(5000, 1, 1), (None, 1, 1), (3, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    got = toxicity.toxicity(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x.held_out and x.doc_id < 600]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in got)
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.7) for x in got)
    truth = dict((i, t) for i, _, t in labels[:600])
    assert sum(x.predicted for x in held if truth[x.doc_id]) >= 0.9 * sum(truth[x.doc_id] for x in held)
    assert sum(x.predicted for x in held if not truth[x.doc_id]) <= 0.02 * len(held)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {x.score for x in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(empty, none).count() == 0


def plain_ftrl(rows, epochs=5, alpha=2.0, beta=1.0, l1=12.0, l2=1.0):
    """FTRL-proximal over named features, one coordinate at a time."""
    import math

    z, n, weight = {}, {}, lambda z, n, l1, l2: 0.0 if abs(z) <= l1 else -(z - math.copysign(l1, z)) / ((beta + math.sqrt(n)) / alpha + l2)
    for _ in range(epochs):
        for names, label in rows:
            w = {f: weight(z.get(f, 0.0), n.get(f, 0.0), *((0.0, 0.0) if f == "bias" else (l1, l2))) for f in [*names, "bias"]}
            g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - label
            for f in w:
                before = n.get(f, 0.0)
                z[f] = z.get(f, 0.0) + g - (math.sqrt(before + g * g) - math.sqrt(before)) / alpha * w[f]
                n[f] = before + g * g
    return {f: weight(z[f], n[f], *((0.0, 0.0) if f == "bias" else (l1, l2))) for f in z}


def named(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {(1, x) for x in w} | {(2, x, y) for x, y in zip(w, w[1:], strict=False)} | {(3, x, y) for x, y in zip(w, w[2:], strict=False)}


def test_scores_equal_plain_ftrl(spark):
    """Scores of every text, held-out, empty, null, long and repeated ones too, against named features."""
    import math
    import zlib

    r, vocabulary = random.Random(21), [f"w{i}" for i in range(40)]
    rows, labels = [], []
    for i in range(300):
        bad = i % 3 == 0
        words = r.choices(vocabulary, k=r.randint(3, 15)) + (["vile", "scum"] if bad else [])
        rows.append((2**60 + i, " ".join(words).title()))
        labels.append((2**60 + i, int(bad)))
    rows += [(None, "vile scum w1"), (1, None), (2, ""), (3, "w1 " * 20_000 + "vile"), (2**60 + 4, "w2 w3")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    toxic = spark.createDataFrame([*labels, (None, 1)], "doc_id long, toxic int")
    learnt = [(i, t) for i, t in labels if zlib.crc32(str(i).encode()) % 3 != 1]
    known = spark.createDataFrame([(i,) for i, _ in learnt], "doc_id long").select("doc_id", F.xxhash64("doc_id").alias("place")).collect()
    hashed = {x.text: x.h for x in docs.where("text is not null").select("text", F.xxhash64("text").alias("h")).collect()}
    texts = {}
    for i, t in rows:
        if i is not None and t is not None and (i not in texts or hashed[t] < hashed[texts[i]]):
            texts[i] = t
    of = dict(learnt)
    order = [x.doc_id for x in sorted(known, key=lambda x: x.place)]
    w = plain_ftrl([(sorted(named(texts[i])), of[i]) for i in order])
    want = lambda t: 1 / (1 + math.exp(-max(-35, min(35, sum(w.get(f, 0.0) for f in named(t)) + w["bias"]))))
    got = toxicity.toxicity(docs, toxic).collect()
    assert len(got) == len(rows)
    key = lambda x: (repr(x[0]), round(x[1], 9))
    plain = sorted(((i, want(t)) for i, t in rows), key=key)
    for a, b in zip(sorted(((x.doc_id, x.score) for x in got), key=key), plain, strict=True):
        assert a[0] == b[0] and abs(a[1] - b[1]) < 1e-6, (a, b)
    few = toxicity.train(docs, toxic, max_features=200)
    assert len(few[0]) < len(toxicity.train(docs, toxic)[0])


def test_warc(spark, tmp_path, equal):
    import base64
    import hashlib

    pages = [(3, "http://a", "<p>one</p>"), (1, "http://b", "<p>one</p>"), (2, None, None), (4, "http://d", ""), (5, "http://e", "é😀" * 50_000), (None, "http://f", "<p>one</p>"), (None, "http://g", "alone"), (6, "u", "x\r\n\r\ny"), (6, "u", "x\r\n\r\ny")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("same", F.lit(1)).repartition(3)
    firsts = {}
    for i, _, h in pages:
        firsts.setdefault(h or "", []).append(i)
    want = []
    for i, _, h in pages:
        first = min((x for x in firsts[h or ""] if x is not None), default=None)
        b = (h or "").encode()
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first))
    equal(warc_store.warc_round_trip(df, f"file://{tmp_path}/w").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect(), want)
    files = sorted((tmp_path / "w").glob("*.warc.zst"))
    assert files and not [p for p in (tmp_path / "w").iterdir() if p not in files]
    with files[0].open("rb") as f:
        assert all(r.startswith(b"WARC/1.1\r\n") for r in warc_store.frames(f, 7))
    assert warc_store.warc_round_trip(df.limit(0)).count() == 0


def test_warc_of_any_urls_and_ids(spark, tmp_path, equal):
    """Line breaks, header look-alikes, percent signs and separators in urls and ids; large ids beside
    null ones; ids that read None."""
    urls = ["http://a/\r\n\r\nx", "http://b/\r\nWARC-Type: revisit", "http://c/%0D%0A 100%", "\u2028\x85\x00: y", "", None, "http://é/😀"]
    big = 2**60 + 1
    for kind, ids in (("long", [big, None, big + 2, 7, 7, None, big + 4]), ("string", ["None", None, "a: b", "x\r\nContent-Length: 0", "%41", "", "é\n"])):
        pages = [(i, u, f"<p>{n % 3}</p>") for n, (i, u) in enumerate(zip(ids, urls, strict=True))]
        df = spark.createDataFrame(pages, f"page_id {kind}, url string, html string").repartition(2)
        back = warc_store.read_archives(warc_store.write_archives(df, f"file://{tmp_path}/{kind}")).collect()
        equal([(r.page_id, r.url) for r in back], [(None if i is None else str(i), u or "") for i, u, _ in pages])
        firsts = {}
        for i, _, h in pages:
            firsts.setdefault(h, []).append(i)
        want = [(i, "response" if (f := min((x for x in firsts[h] if x is not None), default=None)) is None or i == f else "revisit", None if f is None or i == f else f) for i, _, h in pages]
        equal(warc_store.warc_round_trip(df).select("page_id", "record_type", "refers_to").collect(), want)
        for path in sorted((tmp_path / kind).glob("*.warc.zst")):
            with path.open("rb") as f:
                heads = [r.partition(b"\r\n\r\n")[0].decode("utf-8", "surrogatepass") for r in warc_store.frames(f)]
            assert all(("WARC-Refers-To: <urn:uuid:" in h) == ("WARC-Type: revisit" in h) for h in heads)


def test_dictionary_of_large_records_only(spark, monkeypatch):
    """Records beyond the sample's bound are sampled by their beginnings, and the sample is bounded."""
    monkeypatch.setattr(warc_store, "SAMPLE_RECORD_CHARS", 500)
    monkeypatch.setattr(warc_store, "SAMPLE_RECORDS", 20)
    pages = [(i, "u", f"<html><body class='page'>{i * 7919} " + f"<p>line {i}</p>" * 100) for i in range(300)] + [(1000, "u", "<html>again" * 99)] * 300
    sample = warc_store.sampled(spark.createDataFrame(pages, "page_id long, url string, html string"))
    assert 5 <= len(sample) <= 20 and all(len(b) <= 500 for b in sample)
    assert warc_store.build_dictionary(sample)


def test_pipeline_keeps_what_each_stage_should(spark, data):
    """Every stage by itself, on what the stage before it kept, against plain Python."""
    import corpus_pipeline as P

    read = lambda name: spark.read.parquet(f"{data}/{name}.parquet")
    docs = read("documents")
    columns = docs.columns
    ids = lambda d: {r.doc_id for r in d.select("doc_id").collect()}
    verdict = {r.doc_id: r.predicted for r in toxicity.toxicity(docs, read("labels")).collect()}
    kept = P.drop_toxic(spark, docs, data).cache()
    assert kept.columns == columns and ids(kept) == {i for i, p in verdict.items() if not p}
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    once = {}
    for i, t in sorted(rows):
        once.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    unique = P.drop_copies(spark, kept, data).cache()
    assert unique.columns == columns and ids(unique) == set(once.values())
    rows = [(i, t) for i, t in rows if i in set(once.values())]
    near = P.drop_near_copies(spark, unique, data).cache()
    assert near.columns == columns and ids(near) == {i for i, _, c in component_of(rows, 80, 5) if i == c}
    items = [r.text for r in read("benchmark").collect()]
    grams = lambda t: {tuple(w[i : i + 5]) for w in [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())] for i in range(len(w) - 4)}
    seeds = [grams(t) for t in items]
    clean = P.drop_contaminated(spark, near, data).cache()
    bad = {r.doc_id for r in near.collect() for item, g in zip(items, seeds, strict=True) if g & grams(r.text) and coverage(item, r.text) >= 0.5}
    assert clean.columns == columns and ids(clean) == ids(near) - bad
    mixed = P.mix_sources(spark, clean, data).collect()
    source = {r.doc_id: r.source for r in clean.collect()}
    assert {r.doc_id for r in mixed} == set(source)
    size, taken, target = {}, {}, {}
    for r in mixed:
        s = source[r.doc_id]
        assert 0 <= r.taken <= 3 * r.size
        size[s], taken[s], target[s] = size.get(s, 0) + r.size, taken.get(s, 0) + r.taken, r.target
    assert abs(sum(target.values()) - sum(size.values())) < 1
    assert all(abs(taken[s] - target[s]) <= max(0.05 * target[s], 200) for s in size), (taken, target)


def test_without_matches_nulls(spark):
    d = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c")], "doc_id long, text string")
    gone = spark.createDataFrame([(None,), (2,), (2,)], "doc_id long")
    assert [r.text for r in without(d, gone).collect()] == ["a"]


def test_pipeline_drops_near_copies_of_five_words_and_80_percent(spark):
    import corpus_pipeline as P
    from tests.llm.conftest import passage

    words = passage(80, 240).split()
    a, b = " ".join(words), " ".join("zz" + w if i in (40, 90, 140, 190, 220) else w for i, w in enumerate(words))
    jaccard = lambda k: len(shingles(a, k) & shingles(b, k)) / len(shingles(a, k) | shingles(b, k))
    assert jaccard(4) < 0.85 and jaccard(5) >= 0.8
    docs = spark.createDataFrame([(1, a), (2, b), (3, passage(81, 240))], "doc_id long, text string")
    assert {r.doc_id for r in P.drop_near_copies(spark, docs, None).collect()} == {1, 3}


def test_pipeline_drops_single_rows_of_null_and_repeated_ids(spark, tmp_path):
    """Each stage drops rows and not ids, and keeps one row of each group."""
    import corpus_pipeline as P
    from tests.llm.conftest import passage

    t = [passage(90 + i, 120) for i in range(8)]
    near = "other " + t[1]
    rows = [(1, t[0]), (None, t[0]), (None, t[2]), (None, None), (7, t[3]), (7, t[4]), (6, t[4]), (8, t[5]), (8, t[5]), (None, t[6]), (None, t[6])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pairs = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    want = sorted([(1, t[0]), (None, t[2]), (None, None), (7, t[3]), (6, t[4]), (8, t[5]), (None, t[6])], key=repr)
    assert pairs(P.drop_copies(spark, docs, None)) == want
    assert pairs(P.drop_near_copies(spark, docs.where("text is not null"), None)) == [x for x in want if x[1] is not None]
    close = [(None, near), (2, t[1]), (None, t[2]), (5, t[3]), (5, near)]
    assert pairs(P.drop_near_copies(spark, spark.createDataFrame(close, docs.schema), None)) == sorted([(2, t[1]), (None, t[2]), (5, t[3])], key=repr)
    spark.createDataFrame([(1, t[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    leaks = [(None, t[0]), (None, t[7]), (3, t[1]), (3, "so " + t[7]), (4, t[2])]
    assert pairs(P.drop_contaminated(spark, spark.createDataFrame(leaks, docs.schema), str(tmp_path))) == sorted([(None, t[0]), (3, t[1]), (4, t[2])], key=repr)


@pytest.mark.parametrize("percent", [30, 50, 60, 70, 85])
def test_links_at_any_percent(spark, percent):
    """Pairs of sets just at and just under the limit, of sizes far apart and alike."""
    r, rows, want = random.Random(percent), [], {}
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(9))
    for k in range(120):
        n = r.randint(1, 60)
        a = [word() for _ in range(n)]
        if k % 2:  # one holds the other: shared / larger
            b = a + [word() for _ in range(n * 100 // percent - n)]
        else:
            b = a[r.randint(0, n) :] + [word() for _ in range(r.randint(0, n))]
        rows += [(2 * k, " ".join(a)), (2 * k + 1, " ".join(b))]
        linked = bool(b) and 100 * len(set(a) & set(b)) >= percent * len(set(a) | set(b))
        want |= {2 * k: 2 * k, 2 * k + 1: 2 * k if linked else 2 * k + 1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(df, shingle=1, percent=percent).collect()}
    assert got == want


def test_percents_that_mean_nothing_are_refused():
    for percent in (0, -1, 101):
        with pytest.raises(ValueError, match="percent"):
            ngram_join.Bands(percent)
