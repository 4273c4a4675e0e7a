"""Encoding with public tokenizers, memoised by word.

Both vocabularies cut a text at white space before anything else, so a text's ids are those of its words in order.
Distinct words go through the tokenizers library; the first ``memo_words`` of them stay in a dictionary that a worker
process keeps from task to task (frequent words come early; the dictionary starts anew when too many words miss it).
A word that misses is cut where the vocabulary's own pattern cuts it, and its parts are looked up likewise.
Ids are kept as little-endian 32-bit numbers, so a text is encoded by joining bytes. A text where that cut could
differ from the library's (a blank beside other white space, for the byte-level vocabulary) is encoded whole.
"""

from __future__ import annotations

import array
import os
import re
import sys

import numpy as np
import regex

from scrubline.llm import worker

#: Words kept, and a third as many parts of words, about 200 bytes each. It changes speed only.
MEMO_WORDS = 1_200_000
#: Shares of misses, and the words they are counted over, at which the dictionary starts anew.
STALE_SHARE, STALE_OVER = 0.3, 1_000_000
_BESIDE_BLANK = re.compile(r" \s|\s ")
#: What white space other than single blanks and newlines looks like; where none is found, no regex needs to run.
_OTHER_SPACE = ("\t", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f")
_WIDE_SPACE = ("\x85", "\xa0", "\u1680", *map(chr, range(0x2000, 0x200B)), "\u2028", "\u2029", "\u202f", "\u205f", "\u3000")


def blank_beside_space(text: str) -> bool:
    """Whether a blank stands beside other white space."""
    if "  " in text or " \n" in text or "\n " in text:
        return True
    if any(c in text for c in _OTHER_SPACE) or not text.isascii() and any(c in text for c in _WIDE_SPACE):
        return _BESIDE_BLANK.search(text) is not None
    return False


def pack(ids) -> bytes:
    a = array.array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class _Encoder:
    def __init__(self, path: str, memo_words: int = MEMO_WORDS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # the special tokens' strings in a text are ordinary text
        self.memo_words, self.memo_parts = memo_words, memo_words // 3
        self.memo: dict = {}
        self.parts: dict[str, bytes] = {}
        self.asked = self.missed = 0
        #: Stands between words as one id that no word without MARK has; None if the vocabulary has no such id.
        mark = self.tokenizer.encode(self.MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def whole(self, text: str) -> bytes:
        return pack(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _each(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part: one text of all of them, cut at the marks."""
        plain = [w for w in parts if self.MARK not in w] if self.mark is not None else []
        found = {}
        if plain:
            (coded,) = self.tokenizer.encode_batch_fast([self.BETWEEN.join(plain)], add_special_tokens=False)
            ids = np.array(coded.ids, "<u4")
            at = np.flatnonzero(ids == self.mark)
            if len(at) == len(plain) - 1:
                raw, edges = ids.tobytes(), [-4, *(4 * at).tolist(), 4 * len(ids)]
                found = dict(zip(plain, [raw[a + 4 : b] for a, b in zip(edges, edges[1:])], strict=True))
        odd = [w for w in parts if w not in found]
        if odd:
            found |= zip(odd, [pack(e.ids) for e in self.tokenizer.encode_batch_fast(odd, add_special_tokens=False)], strict=True)
        return found

    def _missing(self, words: list[str]) -> list[bytes]:
        cuts = [self._cut(w) for w in words]
        new = list({p for c in cuts for p in c if p not in self.parts})
        now = self._each(new) if new else {}
        if len(self.parts) < self.memo_parts:
            self.parts.update(now)
            now = self.parts
        else:
            now = _Both(now, self.parts)
        return [now[c[0]] if len(c) == 1 else b"".join([now[p] for p in c]) for c in cuts]

    def _join(self, words: list) -> bytes:
        found = list(map(self.memo.get, words))
        self.asked += len(words)
        if None in found:
            gaps, k, find = [], -1, found.index
            try:
                while True:
                    gaps.append(k := find(None, k + 1))
            except ValueError:  # no further gap
                pass
            new = list({words[k] for k in gaps})
            now = dict(zip(new, self._missing([self._spell(w) for w in new]), strict=True))
            for k in gaps:
                found[k] = now[words[k]]
            if len(self.memo) < self.memo_words:
                self.memo.update(now)
            self.missed += len(gaps)
        if self.asked > STALE_OVER:
            if self.missed > STALE_SHARE * self.asked:
                self.memo.clear()
                self.parts.clear()
            self.asked = self.missed = 0
        return b"".join(found)


class _Both(dict):
    """A dictionary that falls back on another."""

    def __init__(self, first: dict, rest: dict):
        super().__init__(first)
        self.rest = rest

    def __missing__(self, key):
        return self.rest[key]


class ByteLevelEncoder(_Encoder):
    """Byte-level vocabularies: a word takes the blank before it; a newline before that blank is a token by itself."""

    MARK = BETWEEN = "\n"
    #: The vocabulary's own pattern. Fixed value.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")

    @staticmethod
    def _spell(word: str) -> str:
        return " " + word

    def _cut(self, word: str) -> list[str]:
        return self.PATTERN.findall(word)

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if blank_beside_space(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + self._join(rest)


class WordEncoder(_Encoder):
    """Vocabularies of word ends that drop white space. Only ASCII white space cuts here; the library cuts the rest."""

    MARK, BETWEEN = "\x00", " \x00 "
    #: The vocabulary's own pattern, for lower case. Fixed value.
    PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    #: Characters that normalisation changes in case only.
    PLAIN = re.compile("[\x00-\u012f]*")

    @staticmethod
    def _spell(word: bytes) -> str:
        return word.decode()

    def _cut(self, word: str) -> list[str]:
        return self.PATTERN.findall(word.lower()) if self.PLAIN.fullmatch(word) else [word]

    def __call__(self, text: str | None) -> bytes:
        return self._join(text.encode().split()) if text else b""


def encoder(kind: type, path: str, memo_words: int = MEMO_WORDS) -> _Encoder:
    """This process's encoder of a vocabulary file."""
    return worker.held((kind.__name__, path, memo_words), lambda: kind(path, memo_words))
