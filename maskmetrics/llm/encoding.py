"""Whole-text tokenisation with a public tokenizer file, memoised by word."""

from __future__ import annotations

import sys
from array import array
from functools import lru_cache
from unicodedata import normalize

import numpy as np

#: Words remembered by one Python worker; the memo is emptied when it is full.
MEMO_WORDS = 1_000_000
#: Characters at which str.split() cuts although the tokenizer sees no white space,
#: and the start of a control string: texts with one go to the tokenizer as they are.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: The byte-level alphabet: visible Latin-1 characters stand for themselves, the other
#: bytes, in order, for the characters from U+0100 on.
_VISIBLE = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_BYTE_LEVEL = {b: 0x100 + k for k, b in enumerate(b for b in range(256) if b not in _VISIBLE)}


class _Memo(dict):
    """Word to ids; a word asked for the first time is encoded.

    A run of letters followed by a run of punctuation is cut between them by the
    pre-tokenizer, and case is dropped, so such words share the ids of their
    lower-case letters, which the tokenizer's model merges without the steps that
    only other words need.
    """

    def __init__(self, whole, merge, code: str):
        self.whole, self.merge, self.code = whole, merge, code

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(".,;:!?#$%&*)")
        if not stem.isalpha() or max(stem) >= "\u0250":
            ids = self[word] = self.whole(word)
            return ids
        tail = word[len(stem) :]
        if stem.isascii():
            stem = key = stem.lower()
        else:
            stem = "".join([c.lower() for c in normalize("NFC", stem)])
            if not stem.isalpha():  # a letter whose lower case carries a mark
                ids = self[word] = self.whole(word)
                return ids
            key = stem.encode().decode("latin-1").translate(_BYTE_LEVEL)
        ids = self.get(stem)
        if ids is None:
            ids = self[stem] = array(self.code, [t.id for t in self.merge(key)]).tobytes()
        if tail:
            end = self.get(tail)
            if end is None:
                end = self[tail] = self.whole(tail)
            ids += end
        self[word] = ids
        return ids


class WordEncoder:
    """Encode texts to ids exactly as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``by_word`` holds only for tokenizers whose pre-tokenizer drops white space and
    never joins across it, as the word-end BPE does; then every word has the same ids
    wherever it stands, and a bounded memo of words saves most of the merging.
    Otherwise each text is encoded as one.  An empty text has no ids.
    """

    def __init__(self, path: str, by_word: bool = True, memo_words: int = MEMO_WORDS):
        from tokenizers import Tokenizer

        if sys.byteorder != "little":
            raise NotImplementedError("ids are kept as little-endian bytes")
        self.tok = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        self.by_word, self.memo_words = by_word, memo_words
        self.memo = _Memo(self._whole, self.tok.model.tokenize, self.code)

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian bytes of ``self.dtype``."""
        out: list[bytes] = []
        known = self.memo.__getitem__
        for text in texts:
            if not self.by_word or any(c in text for c in _ODD):
                out.append(self._whole(text))
            else:
                out.append(b"".join(map(known, text.split())))
            if len(self.memo) > self.memo_words:
                self.memo.clear()
        return out


@lru_cache(maxsize=2)
def encoder(path: str, by_word: bool = True, memo_words: int = MEMO_WORDS) -> WordEncoder:
    """One encoder per Python worker and tokenizer file."""
    return WordEncoder(path, by_word, memo_words)
