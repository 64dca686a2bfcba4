"""Ids of texts by a tokenizer that cuts at white space, through memos of words and of their pieces.

Such a tokenizer drops white space and cuts there, and nothing it does before (composing characters,
lower-casing) reaches across a space, so a text's ids are its words' ids in order. Special strings hold
no spaces either. Each distinct word is encoded once per worker, within a bounded memo.

Words of plain characters (ASCII and Western European letters, digits, ASCII punctuation) are cut once
more, by the tokenizer's own pattern, into pieces that its model encodes by themselves, many in one
call: the last token of each piece ends a word. All other words go to the whole tokenizer.
"""

from __future__ import annotations

import json
import re
from itertools import chain, compress

import numpy as np

MEMO_WORDS = 500_000
STRETCH = 200

# The pattern and the steps of the files whose words may be cut into pieces.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_STEPS = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_CUTS = {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _PATTERN}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = re.compile(rf"[!-~{_LETTERS}]+")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it is printable,
    else the next free one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}


class WordEncoder:
    """Little-endian 32-bit ids of whole texts, as bytes, by one file of the tokenizers library."""

    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        #: Cutting at spaces is proven for this shape of file only; others are encoded text by text.
        self.by_word = spec["normalizer"] == _STEPS and spec["pre_tokenizer"] == _CUTS and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in spec["added_tokens"])
        self.memo_words = memo_words
        self.words: dict[str, bytes] = {"": b""}
        self.pieces: dict[str, bytes] = {}
        if self.by_word:
            self.model = Tokenizer(self.whole.model)
            self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            suffix = spec["model"]["end_of_word_suffix"]
            self.ends = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
            for token, i in self.whole.get_vocab(with_added_tokens=False).items():
                self.ends[i] = token.endswith(suffix)
            self.special = re.compile("|".join(sorted({re.escape(t["content"][:2]) for t in spec["added_tokens"]})) or r"(?!)")
            self.letters = byte_letters()

    def _by_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _by_model(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces, by one call for each stretch of them."""
        shown = [p if p.isascii() else "".join(map(self.letters.__getitem__, p.encode())) for p in pieces]
        out = []
        for i in range(0, len(shown), STRETCH):
            ids = np.array(self.model.encode_batch_fast([" ".join(shown[i : i + STRETCH])], add_special_tokens=False)[0].ids, "<u4")
            data, ends = ids.tobytes(), (np.flatnonzero(self.ends[ids]) + 1) * 4
            out += [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        return out

    def _learn(self, fresh: list[str]) -> None:
        """Put these words into the memo."""
        lower = list(map(str.lower, fresh))
        fit, special = _PLAIN.fullmatch, self.special.search
        fits = [fit(x) is not None and special(x) is None for x in lower]
        plain, other = list(compress(fresh, fits)), [w for w, yes in zip(fresh, fits, strict=True) if not yes]
        cut = list(map(_PIECE.findall, compress(lower, fits)))
        if len(self.pieces) > self.memo_words:
            self.pieces.clear()
        unknown = list(set(chain.from_iterable(cut)) - self.pieces.keys())
        self.pieces.update(zip(unknown, self._by_model(unknown), strict=True))
        of = self.pieces
        self.words.update(zip(plain, [of[ps[0]] if len(ps) == 1 else b"".join([of[p] for p in ps]) for ps in cut], strict=True))
        self.words.update(zip(other, self._by_whole(other), strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_word:
            return self._by_whole(texts)
        if len(self.words) > self.memo_words:
            self.words = {"": b""}
        known, open_, out = self.words.get, [], []
        for text in texts:
            words = self._lowered(text).replace("\n", " ").split(" ")
            ids = list(map(known, words))
            if None in ids:
                open_.append((len(out), ids, [i for i, x in enumerate(ids) if x is None], words))
                out.append(b"")
            else:
                out.append(b"".join(ids))
        self._learn(list({words[i] for _, _, gaps, words in open_ for i in gaps}))
        for place, ids, gaps, words in open_:
            for i in gaps:
                ids[i] = known(words[i])
            out[place] = b"".join(ids)
        return out

    def _lowered(self, text: str) -> str:
        """The text in lower case where that is the tokenizer's own lower case, character by character
        (up to U+00FF), and where no special string can come of it."""
        if self.special.search(text):
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()
