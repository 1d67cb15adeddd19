"""Encoding whole texts with a vocabulary file of the tokenizers library, each distinct chunk once.

No pre-tokenizer of the two vocabularies lets a token span the place before a run of white space, so the ids of a text are
the ids of its chunks (a run of white space and the run after it) in order. A worker keeps the ids of the chunks it has
met, up to KNOWN of them in two halves, of which the older is let go; new words of plain letters go to the vocabulary's
model alone, other new chunks are encoded together, in one call, and cut apart by the bytes each token stands for.
Where that can't be shown to be exact (rare white space, a cut that falls inside a token), the library gets the text itself.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

KNOWN = 700_000
#: Characters of the longest chunk that is kept from one text to the next: a worker keeps about 100 MB.
LONG = 64
CHUNK = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")
#: The characters that byte-level vocabularies write for bytes which don't print.
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Stands before the first chunk of a text, which follows no space (a text that has it is encoded directly).
MARK = "\x00"
#: A text with none of these, and no white space at its ends, has one white space character between its runs.
IRREGULAR = ("  ", " \n", "\n ", "\n\n", "\t", "\x0b", "\x0c", "\r")
#: White space to a tokenizer or to Python beyond the six characters of CHUNK, and characters that normalisers treat alike.
RARE = re.compile("[\x00\x1c-\x1f\x85\xa0 ᠎ -‏ -  -⁯　﻿]")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text): the ids as little-endian unsigned 32-bit integers; special strings in a text are ordinary text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.known: dict[str, bytes] = {}  # by chunk, of texts with irregular white space
        self.spaced: dict[str, bytes] = {}  # by chunk without its leading space; the first of a text has MARK instead
        self.ends = "</w>" if any(t.endswith("</w>") for t in self.model.get_vocab(with_added_tokens=False)) else ""
        vocab = self.model.get_vocab(with_added_tokens=True)
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)  # in bytes: a byte-level token has a character for each
        for token, i in vocab.items():
            self.width[i] = len(token.removesuffix(self.ends) if self.ends else token)

        self.older: dict[str, bytes] = {}
        self.raw = [i.to_bytes(4, "little") for i in range(len(self.width))]
        self.ends_of = {"": b""} | {c: self.direct(c) for c in ".,"}

    def direct(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _apart(self, new: list[str]) -> list[bytes]:
        """The ids of each chunk, encoded in one call and cut apart."""
        bare = [c.strip(" \t\n\x0b\x0c\r") for c in new] if self.ends else new
        text = (" " if self.ends else "").join(bare)
        ids = np.array(self.model.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        parts = self.model.normalizer.normalize_str(text).split(" ") if self.model.normalizer and self.ends else bare
        if len(parts) == len(new):
            to = np.cumsum([len(p.encode("utf-8", "surrogatepass")) for p in parts])
            at = np.concatenate(([0], np.cumsum(self.width[ids])))
            cut = np.searchsorted(at, to)
            if len(ids) and at[-1] == to[-1] and (at[np.minimum(cut, len(at) - 1)] == to).all():
                raw, cut = ids.astype("<u4").tobytes(), cut.tolist()
                return [raw[4 * a : 4 * b] for a, b in zip([0, *cut[:-1]], cut)]
        return [self.direct(c) for c in new]

    def _stem(self, c: str) -> tuple[str, str]:
        """(stem, end): a letter and a full stop or comma after it are never in one token. A vocabulary that drops white
        space and case has one stem for all of these, where lower case is that of ASCII."""
        end = c[-1] if c[-1] in ".," and c[-2:-1].isalpha() else ""
        if end:
            c = c[:-1]
        if self.ends and c.isascii() and (bare := c.lstrip("\x00\n").lower()):
            c = bare
        return c, end

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if MARK in text:
            return self.direct(text)
        if text[0] in " \n" or text[-1] in " \n" or any(x in text for x in IRREGULAR):
            return self._ids(text)
        chunks = (MARK + text.replace("\n", " \n")).split(" ")
        new = set(chunks).difference(self.spaced)
        if not new:
            return b"".join(map(self.spaced.__getitem__, chunks))
        if RARE.search(text):
            return self.direct(text)
        if len(self.spaced) + len(new) > KNOWN // 2:  # what is met again of the older half comes back from it
            self.older, self.spaced = self.spaced, {}
            new = set(chunks)
        if self.older:
            again = [c for c in new if c in self.older]
            self.spaced.update((c, self.older[c]) for c in again)
            new.difference_update(again)
        stems = list(map(self._stem, new))
        fresh = {s for s, _ in stems if s not in self.spaced}
        if fresh:
            self._learn(fresh)
        self.spaced.update((c, self.spaced[s] + self.ends_of[end]) for c, (s, end) in zip(new, stems, strict=True) if c != s)
        out = b"".join(map(self.spaced.__getitem__, chunks))
        for c in [c for c in new if len(c) > LONG]:
            self.spaced.pop(c, None)
            self.spaced.pop(self._stem(c)[0], None)
        return out

    def _learn(self, fresh: set[str]) -> None:
        """A stem of Latin-1 letters is one word to either pre-tokenizer and normal but for its case: the model alone gives its
        ids. All others go through the whole library."""
        tokenize, lead, odd = self.model.model.tokenize, "" if self.ends else "\u0120", []
        for s in fresh:
            if s.isascii() and s.isalpha():
                word = s
            elif s.isalpha() and max(s) <= "\xff":
                word = (s.lower() if self.ends else s).encode().decode("latin-1").translate(BYTES)
            else:
                odd.append(s)
                continue
            self.spaced[s] = b"".join([self.raw[t.id] for t in tokenize(lead + (word.lower() if self.ends and s.isascii() else word))])
        if odd:  # a chunk follows a space unless it begins the text or a line
            real = [s[1:] if s[0:1] == MARK else s if s[0:1] == "\n" else " " + s for s in odd]
            self.spaced.update(zip(odd, self._apart(real), strict=True))

    def _ids(self, text: str) -> bytes:
        if RARE.search(text):
            return self.direct(text)
        chunks = CHUNK.findall(text)
        new = [c for c in dict.fromkeys(chunks) if c not in self.known]
        if len(self.known) + len(new) > KNOWN // 10:
            self.known.clear()
            new = list(dict.fromkeys(chunks))
        if new:
            self.known.update(zip(new, self._apart(new), strict=True))
        out = b"".join(map(self.known.__getitem__, chunks))
        for c in [c for c in new if len(c) > LONG]:
            del self.known[c]
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path)
