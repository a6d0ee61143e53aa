"""Exact word-level shortcuts for the public tokenizers.

Both classes give what the library gives.  For texts whose characters all lie in
a range that was probed against the library when the worker started, words are
split with a regular expression built from that probe and looked up in a bounded
cache; any other text, and any text that holds a special token's opening, goes
through the library as a whole.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache

#: Probed characters: Latin blocks and general punctuation.
PROBED = [*range(0x00, 0x180), *range(0x2010, 0x2028), *range(0x2030, 0x205F), 0x20AC]
#: Bytes that a worker's cache of ids may take, about.
CACHE = 64 << 20


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _char_class(codes) -> str:
    return "".join(f"\\U{c:08x}" for c in sorted(codes))


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class Cache:
    """Byte strings by text, bounded in bytes: what comes first stays, until a full cache has missed four times what it holds; then it starts anew."""

    #: What an entry takes besides its characters and bytes: two objects and their place in a table, about.
    ENTRY = 150

    def __init__(self, most: int):
        self.known: dict[str, bytes] = {}
        self.room = self.most = most
        self.missed = 0

    def add(self, key: str, value: bytes) -> None:
        cost = len(key) * (1 if key.isascii() else 4) + len(value) + self.ENTRY
        if cost <= min(self.room, self.most // 64):
            self.known[key] = value
            self.room -= cost
            return
        self.missed += 1
        if self.missed > 4 * len(self.known):
            self.known.clear()
            self.room, self.missed = self.most, 0


class WordIds:
    """Ids (two bytes each, little-endian) of a text under a tokenizer with blanks dropped and words cut by class.

    No id spans a blank, so the ids of a blank-delimited stretch are looked up in a bounded cache.
    """

    def __init__(self, path: str, cache: int = CACHE):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.alphabet = byte_alphabet()
        self.cache = Cache(cache)
        norm, pre = self.tok.normalizer, self.tok.pre_tokenizer
        pieces = lambda s: len(pre.pre_tokenize_str(norm.normalize_str(s)))
        kinds: dict[str, list[int]] = {"L": [], "N": [], "O": []}
        ok = []
        for c in PROBED:
            ch = chr(c)
            blank = pieces(ch) == 0
            lowered = norm.normalize_str("a" + ch)
            if blank != (not ch.split()) or lowered != "a" + (" " if blank else ch.lower()) or len(ch.lower()) != 1:
                continue
            ok.append(c)
            if not blank:
                kinds["L" if pieces("a" + ch) == 1 else "O" if pieces("!" + ch) == 1 else "N"].append(ord(ch.lower()))
        self.odd = re.compile(f"[^{_char_class(ok)}]").search
        self.odd_latin = [chr(c) for c in range(256) if c not in ok]
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_char_class(kinds['L'])}]+|[{_char_class(kinds['N'])}]|[{_char_class(kinds['O'])}]+").findall

    def _pack(self, ids) -> bytes:
        return struct.pack(f"<{len(ids)}H", *ids)

    def _is_odd(self, text: str) -> bool:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return bool(self.odd(text))
        return any(c in text for c in self.odd_latin)

    def _word(self, w: str) -> bytes:
        plain = w if w.isascii() and w.isprintable() else "".join([self.alphabet[b] for b in w.encode()])
        return self._pack([t.id for t in self.model.tokenize(plain)])

    def _stretch(self, chunk: str) -> bytes:
        find, add = self.cache.known.get, self.cache.add
        words = self.split(chunk)
        if len(words) == 1:  # a stretch that is a word takes one entry
            out = self._word(chunk)
        else:
            parts = []
            for w in words:
                if (got := find(w)) is None:
                    add(w, got := self._word(w))
                parts.append(got)
            out = b"".join(parts)
        add(chunk, out)
        return out

    def __call__(self, text: str) -> bytes:
        if "<|" in text or self._is_odd(text):
            return self._pack(self.tok.encode(text, add_special_tokens=False).ids)
        get, make = self.cache.known.get, self._stretch
        return b"".join([get(c) or make(c) for c in text.lower().split()])


@lru_cache(maxsize=1)
def word_ids(path: str) -> WordIds:
    """One for all tasks of a worker, whose bounded cache then serves the next task as well."""
    return WordIds(path)


class PreTokens:
    """Raw pre-tokens of a text under a byte-level tokenizer, and how many special tokens it holds."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.pre = self.tok.pre_tokenizer
        self.special = sorted((t.content for t in self.tok.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.cut = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        count = lambda s: len(self.pre.pre_tokenize_str(s))
        kinds: dict[str, list[int]] = {"L": [], "N": [], "O": [], "S": []}
        for c in PROBED:
            ch = chr(c)
            kinds["L" if count("a" + ch) == 1 else "N" if count("1" + ch) == 1 else "O" if count("!" + ch) == 1 else "S"].append(c)
        k = {n: _char_class(v) for n, v in kinds.items()}
        blank = k["S"]
        self.known = re.compile(f"[^{_char_class(PROBED)}]").search
        self.find = re.compile(f" ?[^{blank}]+|[{blank}]+(?![^{blank}])|[{blank}]+").findall

    def segment(self, text: str) -> list[str]:
        """Stretches without an inner blank; the library's own pre-tokens refine them."""
        if self.known(text):
            return [text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text)]
        return self.find(text)

    def __call__(self, text: str) -> tuple[list[str], int]:
        if self.cut is None or not any(s in text for s in self.special):
            return self.segment(text), 0
        parts = self.cut.split(text)
        return [w for p in parts if p for w in self.segment(p)], len(parts) - 1

    def count(self, piece: str) -> int:
        tokenize = self.tok.model.tokenize
        return sum(len(tokenize(p)) for p, _ in self.pre.pre_tokenize_str(piece))
