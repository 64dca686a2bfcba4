"""Alignment of two tokenizers' tokens over the same bytes, by diagonal run skipping.

Both tokenizations of a text end at the same byte, so their arrays of token ends are two ascending
lists to be matched. At the current shift between their indices, tokens that match one to one form a
run: probes of doubling length compare both arrays until they differ, and halving finds the run's end.
Where the arrays differ, the one that is behind moves on until both end at the same byte again; that
irregular group closes there and its length gives the new shift.

Neither tokenizer joins a space with what stands before it, if that isn't white space itself: the
byte-level pattern starts a piece there, and no piece of the other's vocabulary holds a space after
another character. Nor do they join letters with ASCII signs beside them, but for the apostrophe. So
texts are cut there, each distinct part is encoded once per worker (bounded memos), and a text's tokens
are its parts' tokens. Files for which that isn't proven are encoded text by text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import broadcast_if_small, materialize, needed, text_or_empty
from ledgerlens.llm.token_counts import Counter
from ledgerlens.llm.word_ids import byte_letters
from ledgerlens.sources.tables import table

MEMO_PIECES = 400_000
SLICE_TEXTS = 256
STRETCH = 200
#: Tokens that are compared one by one before probes double.
STEPS = 8
SPACE_SIGN = "▁"

_SECOND = np.uint32(1 << 31)
_SIGNS = frozenset("\n !\"#$%&'()*+,-./0123456789:;<=>?@[\\]^_`{|}~")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: A space and characters that may be cut between letters and signs. Not the apostrophe, which takes letters with it.
_PLAIN = re.compile(rf" [!-&(-~\n{_LETTERS}]*")
_PART = re.compile(rf" ?[{_LETTERS}]+| ?[^{_LETTERS} ]+| ")
_RUN = re.compile(rf" ?[{_LETTERS}]+")
_MIXED = re.compile(rf"[{_LETTERS}][\n!-@[-`{{-~]|[\n!-@[-`{{-~][{_LETTERS}]")


class ByteTokens:
    """A byte-level file of the tokenizers library: ids of texts, and each id's bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True
        pre = spec["pre_tokenizer"] or {}
        #: Whether the pattern is the one that cuts before a space and between letters and other characters.
        self.cuts = spec["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"] and all(t["special"] for t in spec["added_tokens"])
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = byte_letters()
        byte_of = {c: b for b, c in self.letters.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes[i] = bytes(map(byte_of.__getitem__, token)) if all(c in byte_of for c in token) else token.encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def ids_of_runs(self, runs: list[str]) -> list[bytes]:
        """Ids of letters with or without a space before them, which the pattern never cuts: by the model
        alone, many in one call; byte lengths tell where each run's tokens end."""
        data = [r.encode() for r in runs]
        out = []
        for i in range(0, len(runs), STRETCH):
            shown = [f"\u0120{r[1:]}" if r[0] == " " and r.isascii() else r if r.isascii() else "".join(map(self.letters.__getitem__, d)) for r, d in zip(runs[i : i + STRETCH], data[i : i + STRETCH], strict=True)]
            ids = np.array(self.model.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids, np.uint32)
            ends = (4 * np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(d) for d in data[i : i + STRETCH]])) + 4).tolist()
            flat = ids.astype("<u4").tobytes()
            out += [flat[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
        return out


class PieceTokens:
    """A sentencepiece model that puts a space before each text: ids of texts that start with that space
    (it isn't put there again), and each id's bytes."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        normal, trained = spec.normalizer_spec, spec.trainer_spec
        if not normal.add_dummy_prefix or normal.remove_extra_whitespaces:
            raise ValueError("not a model that puts a space before a text and keeps all others")
        normal.add_dummy_prefix = False
        self.model = sentencepiece.SentencePieceProcessor(model_proto=spec.SerializeToString())
        pieces = [p.piece for p in spec.pieces if p.type == p.NORMAL]
        inside = any(SPACE_SIGN in p.lstrip(SPACE_SIGN) or _MIXED.search(p) for p in pieces)
        #: Whether no piece holds a space after another character, nor a letter beside an ASCII sign.
        self.cuts = not inside and not normal.precompiled_charsmap and normal.escape_whitespaces and trained.model_type == trained.BPE and all(p.type != p.USER_DEFINED for p in spec.pieces)
        self.bytes = [bytes([int(p.piece[3:5], 16)]) if p.type == p.BYTE else p.piece.replace(SPACE_SIGN, " ").encode() for p in spec.pieces]
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1) if texts else []


def matched_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into a and into b of the ends that both have. Both ascend strictly and end alike."""
    ends_a, ends_b = a.tolist(), b.tolist()
    bytes_a, bytes_b = a.tobytes(), b.tobytes()
    same = lambda i, j, k, n: bytes_a[8 * (i + k) : 8 * (i + n)] == bytes_b[8 * (j + k) : 8 * (j + n)]
    n_a, n_b, i, j = len(ends_a), len(ends_b), 0, 0
    first_a, first_b, lengths = [], [], []
    while i < n_a:
        x, y = ends_a[i], ends_b[j]
        while x != y:  # an irregular group: the one behind moves on
            if x < y:
                i += 1
                x = ends_a[i]
            else:
                j += 1
                y = ends_b[j]
        run, most = 1, min(n_a - i, n_b - j)
        near = min(most, STEPS)
        while run < near and ends_a[i + run] == ends_b[j + run]:
            run += 1
        if run == STEPS:
            while run < most:
                probe = min(2 * run, most)
                if same(i, j, run, probe):
                    run = probe
                    continue
                while probe - run > 1:  # they differ before probe and are the same before run
                    middle = (run + probe) // 2
                    if same(i, j, run, middle):
                        run = middle
                    else:
                        probe = middle
                break
        first_a.append(i)
        first_b.append(j)
        lengths.append(run)
        i += run
        j += run
    n = np.array(lengths, np.int64)
    along = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(np.array(first_a, np.int64), n) + along, np.repeat(np.array(first_b, np.int64), n) + along


class Aligner:
    """Alignments of texts by two files. Groups are written as ``a1,a2|b1;a3|b2,b3``.

    The memos hold, for a piece of text, the ids of both tokenizers one after the other, those of the
    second with ``_SECOND`` set."""

    def __init__(self, path_a: str, path_b: str, memo: int = MEMO_PIECES):
        self.a, self.b = ByteTokens(path_a), PieceTokens(path_b)
        self.n_a, self.n_b = len(self.a.bytes), len(self.b.bytes)
        self.cuts, self.most = self.a.cuts and self.b.cuts, memo
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.odd: set[str] = set()
        shown = [str(i).encode() for i in range(max(self.n_a, self.n_b))]
        self.shown = [x + end for x in shown[: self.n_a] for end in (b",", b"|")] + [x + end for x in shown[: self.n_b] for end in (b",", b";")]

    def _joined(self, side, ids) -> bytes:
        return b"".join([side.bytes[i] for i in ids])

    def _encoded(self, parts: list[str]) -> list[bytes]:
        """Both sides' ids of parts. A part whose bytes aren't those of its second tokens is noted as odd
        (a byte-level file without a normalizer keeps every byte)."""
        runs = [p for p in parts if p[-1] not in _SIGNS and _RUN.fullmatch(p)]
        known = set(runs)
        rest = [p for p in parts if p not in known]
        of_a = dict(zip(runs, self.a.ids_of_runs(runs), strict=True)) | {p: np.array(x, "<u4").tobytes() for p, x in zip(rest, self.a.ids(rest), strict=True)}
        ids = self.b.ids(parts)
        flat = (np.fromiter(chain.from_iterable(ids), "<u4") | _SECOND).tobytes()
        ends = [0, *accumulate(map(len, ids))]
        out = []
        for i, p in enumerate(parts):
            if self._joined(self.b, ids[i]) != p.encode("utf-8", "surrogatepass"):
                self.odd.add(p)
            out.append(of_a[p] + flat[4 * ends[i] : 4 * ends[i + 1]])
        return out

    def _learn(self, fresh: list[str]) -> None:
        if len(self.parts) > self.most:
            self.parts = {}
        cut = [_PART.findall(w) if _PLAIN.fullmatch(w) and "\n\n" not in w else [w] for w in fresh]
        unknown = list({p for ps in cut for p in ps} - self.parts.keys())
        self.parts.update(zip(unknown, self._encoded(unknown), strict=True))
        of = self.parts
        self.words.update(zip(fresh, [of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps]) for ps in cut], strict=True))
        if self.odd:
            self.odd.update(w for w, ps in zip(fresh, cut, strict=True) if not self.odd.isdisjoint(ps))

    def _whole(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        a, b = self.a.ids([text])[0], self.b.ids([text])[0]
        data = text.encode("utf-8", "surrogatepass")
        return (np.array(a, np.int64), np.array(b, np.int64)) if self._joined(self.a, a) == self._joined(self.b, b) == data else None

    def tokens(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids by both tokenizers of space + text, or None for texts that have no tokens."""
        spaced = [f" {t}" if t else None for t in texts]
        cut = [Counter._pieces(t) if t and self.cuts and SPACE_SIGN not in t else None for t in spaced]
        if len(self.words) > self.most:
            self.words, self.odd = {}, {p for p in self.odd if p in self.parts}
        if fresh := list({w for ws in cut if ws for w in ws} - self.words.keys()):
            self._learn(fresh)
        of = self.words.__getitem__
        for text, ws in zip(spaced, cut, strict=True):
            if text is None:
                yield None
            elif ws is None or self.odd and not self.odd.isdisjoint(ws):
                yield self._whole(text)
            else:
                both = np.frombuffer(b"".join(map(of, ws)), "<u4")
                second = both >= _SECOND
                yield both[~second].astype(np.int64), (both[second] ^ _SECOND).astype(np.int64)

    def aligned(self, a: np.ndarray, b: np.ndarray) -> tuple[int, bytes, np.ndarray]:
        """The number of groups, the groups as text, and the links as ``id_a * n_b + id_b``."""
        at_a, at_b = matched_ends(np.cumsum(self.a.lengths[a]), np.cumsum(self.b.lengths[b]))
        last_a, last_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        last_a[at_a], last_b[at_b] = 1, 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + np.concatenate([[0], at_b + 1])[group_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + (at_a + 1)[group_b]] = 2 * (self.n_a + b) + last_b
        text = b"".join(map(self.shown.__getitem__, codes.tolist()))
        return len(at_a), text[:-1], a[at_a] * self.n_b + b[at_b]


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def _aligner(path_a: str, path_b: str) -> Aligner:
    if (path_a, path_b) not in _ALIGNERS:
        _ALIGNERS[path_a, path_b] = Aligner(path_a, path_b)
    return _ALIGNERS[path_a, path_b]


def alignments(docs: DataFrame, path_a: str, path_b: str, with_groups: bool = False) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, its distinct links
    (``id_a * size of vocabulary B + id_b``) with how often it has each, and the groups where wanted."""
    fields = [("doc_id", pa.string()), *[(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()), ("links", pa.list_(pa.int64())), ("times", pa.list_(pa.int32())), *[("groups", pa.string())] * with_groups]

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        aligner = _aligner(path_a, path_b)
        for batch in batches:
            for at in range(0, len(batch), SLICE_TEXTS):
                part, rows = batch.slice(at, SLICE_TEXTS), []
                for doc_id, found in zip(part.column("doc_id").to_pylist(), aligner.tokens(part.column("text").to_pylist()), strict=True):
                    if found is None:
                        rows.append((doc_id, 0, 0, 0, 0, "", [], [], *[""] * with_groups))
                        continue
                    n, text, links = aligner.aligned(*found)
                    own, times = np.unique(links, return_counts=True)
                    rows.append((doc_id, len(found[0]), len(found[1]), n, len(links), hashlib.sha256(text).hexdigest(), own, times, *[text.decode()] * with_groups))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f for f, _ in fields])

    schema = "doc_id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<long>, times array<int>" + ", groups string" * with_groups
    return needed(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty(F.col("text")).alias("text")).mapInArrow(align, schema)


def link_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """Of every linked pair of ids: link, times over all documents, and whether no other pair of its B
    id has more. Counted per task first; there are no more rows than pairs of ids."""
    counts = materialize(aligned.selectExpr("inline(arrays_zip(links, times))").groupBy(F.col("links").alias("link")).agg(F.sum("times").alias("times")), "link-counts")
    most = counts.groupBy((F.col("link") % n_b).alias("id_b")).agg(F.max("times").alias("most"))
    return counts.join(most, F.col("link") % n_b == F.col("id_b")).select("link", "times", (F.col("times") == F.col("most")).alias("best"))


def cross_alignment(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text has no tokens, zeros and an empty groups_sha256 where it is null or empty, or where the bytes
    of either tokenization differ from space + text. Null and repeated ids come back as they are, one row
    for each input row; an empty table gives no rows; further columns are ignored. Alignments are written
    once, with distinct links per document; the counts of pairs are broadcast up to a counted bound and
    met by a shuffle beyond it."""
    kind = needed(docs, "doc_id").schema["doc_id"].dataType
    rows = materialize(alignments(docs, path_a, path_b).withColumn("row", F.monotonically_increasing_id()), "alignments")
    n_b = len(PieceTokens(path_b).bytes)  # on the driver, from the file
    counts = broadcast_if_small(materialize(link_counts(rows, n_b), "link-table").withColumnRenamed("times", "total"))
    each = rows.select("row", F.expr("inline(arrays_zip(links, times))")).join(counts, F.col("links") == F.col("link"))
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("total")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("links", "times").join(sums, "row", "left").select(F.col("doc_id").cast(kind).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return cross_alignment(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
