"""Token counts with overlap resynchronisation.

A byte-level BPE tokenizer first cuts a text with a pattern and then merges inside each piece. No
piece of that pattern holds white space except at its start, so a space that follows a character
other than white space always starts a piece: whatever stands before or after, the encoder cuts
there. Such a place is a *proven stable boundary*; special strings hold no spaces, so they never
span one.

Documents of up to ``chunk_chars`` characters are cut at all their stable boundaries and each
distinct piece is encoded once per worker (a bounded memo). Longer ones are encoded in overlapping
chunks with offsets. Neighbouring chunks are spliced at a stable boundary in their overlap at which
a token starts in both encodings. Where the overlap holds none, it is widened, doubling, up to the
rest of the document, so that any text gets the count of one undivided encoding.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.common import needed, text_or_empty
from ledgerlens.sources.tables import table

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 512
MEMO_WORDS = 250_000
SLICE_TEXTS = 256
LIMIT = 512

_SPACE_RUN = re.compile(r"\s ")
_STABLE = re.compile(r"(?<=\S)(?= )")


class Counter:
    """Counts of one tokenizer file. Texts are whole; the memo holds at most MEMO_WORDS pieces."""

    def __init__(self, path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk, self.overlap = chunk_chars, overlap_chars
        self.memo: dict[str, int] = {}

    def _starts(self, text: str, at: int) -> list[int]:
        """Where the text's tokens start, counted from at."""
        return [at + a for a, _ in self.tokenizer.encode(text, add_special_tokens=False).offsets]

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def counts(self, texts: list[str]) -> list[int]:
        pieces = [None if len(t) > self.chunk else self._pieces(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        fresh = list({p for ps in pieces if ps for p in ps if p not in memo})
        memo.update(zip(fresh, self._lengths(fresh), strict=True))
        return [self.spliced(t) if ps is None else sum(map(memo.__getitem__, ps)) for t, ps in zip(texts, pieces, strict=True)]

    @staticmethod
    def _pieces(text: str) -> list[str]:
        if not text:
            return []
        if _SPACE_RUN.search(text) or text[0] == " ":
            return [p for p in _STABLE.split(text) if p]
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else _STABLE.split(text)

    def spliced(self, text: str) -> int:
        """Tokens of a long text, from overlapping chunks."""
        start, total = 0, 0
        end = min(len(text), start + self.chunk)
        left = self._starts(text[start:end], start)
        while end < len(text):
            overlap = self.overlap
            while True:
                begin = max(start, end - overlap)
                stop = min(len(text), begin + self.chunk + overlap)
                right = self._starts(text[begin:stop], begin)
                at = self._common(text, left, right, begin, end)
                if at is not None:
                    break
                if begin == start:  # the overlap is all of the left chunk: encode on from its start
                    end = min(len(text), end + (end - start))
                    left = self._starts(text[start:end], start)
                    if end == len(text):
                        return total + len(left)
                    overlap = self.overlap
                    continue
                overlap *= 2
            n_left, n_right = at
            total += n_left - n_right  # from the spliced place on, the right chunk's tokens count
            start, end, left = begin, stop, right
        return total + len(left)

    @staticmethod
    def _common(text: str, left: list[int], right: list[int], begin: int, end: int) -> tuple[int, int] | None:
        """The last stable boundary in the overlap at which both have a token start: the numbers of
        tokens before it."""
        from bisect import bisect_left

        i = bisect_left(right, end - 1)  # the last character of the left chunk has no right context
        while i > 0:
            i -= 1
            p = right[i]
            if p <= begin:
                return None
            if text[p] != " " or text[p - 1].isspace() or right[i - 1] == p:
                continue
            j = bisect_left(left, p)
            if j < len(left) and left[j] == p:
                return j, i
        return None


_COUNTERS: dict[tuple, Counter] = {}


def _counter(path: str, chunk_chars: int, overlap_chars: int) -> Counter:
    key = (path, chunk_chars, overlap_chars)
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(path, chunk_chars, overlap_chars)
    return _COUNTERS[key]


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    tokenizer_path is a file of the tokenizers library that every executor can open. Null text
    counts as empty, an empty text has no tokens. Null and repeated ids come back as they are,
    one row for each input row; an empty table gives no rows; further columns are ignored. No
    shuffle: memory is one Arrow batch, one long text and the memo."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counter(tokenizer_path, chunk_chars, overlap_chars)
        for batch in batches:
            texts = list(batch["text"])
            n = [c for i in range(0, len(texts), SLICE_TEXTS) for c in counter.counts(texts[i : i + SLICE_TEXTS])]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_bytes": batch["n_bytes"], "n_tokens": pd.Series(n, dtype="int64")})

    texts = needed(docs, "doc_id", "text").select(F.col("doc_id").cast("string").alias("doc_id"), text_or_empty(F.col("text")).alias("text"))
    kind = needed(docs, "doc_id").schema["doc_id"].dataType
    out = texts.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "text").mapInPandas(count, "doc_id string, n_bytes long, n_tokens long")
    return out.select(F.col("doc_id").cast(kind).alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
