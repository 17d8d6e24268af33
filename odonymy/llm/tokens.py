"""Exact token ids of whole texts by a public tokenizer, each distinct unit encoded once.

Texts are cut where no token of the two BPE tokenizers used here can reach over: before a
space that a non-space follows, before white space, between letters, digits and other
characters (but not between an apostrophe and a letter: contractions), and around a single
line feed or tab. The ids of a text are then the ids of its units in a row, and a unit met
before needs no second run of the tokenizer. Cutting and looking up units are array work on
code points; units are known by a 64-bit hash. A text with any character from U+0130 on, where
classes and normalization get involved, is given to the tokenizer whole.

The memory is bounded: it is emptied when it holds ``limit`` units, which changes no result.
"""

from __future__ import annotations

import itertools
import os
import unicodedata
from collections.abc import Sequence
from operator import attrgetter

import numpy as np

from odonymy.llm.text import U64, Hasher

RARE, MARK = 0x130, 0x131
LETTER, DIGIT, OTHER, BLANK, END = range(5)


def _classes() -> np.ndarray:
    out = np.full(MARK + 1, OTHER, np.uint8)
    for c in range(RARE):
        kind = unicodedata.category(chr(c))[0]
        out[c] = {"L": LETTER, "N": DIGIT}.get(kind, OTHER)
    out[[*range(9, 14), 0x20, 0x85, 0xA0]] = BLANK
    out[MARK] = END
    return out


CLASS = _classes()
# The alphabet of byte-level BPE: printable bytes stand for themselves, others for U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_ALPHABET = {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}
#: Characters of the first two lengths of UTF-8 below RARE as bytes in that alphabet (0: no second one).
_ALPHABET = np.array([BYTE_ALPHABET.get(b, b) for b in range(256)], np.uint16)
FIRST, SECOND = (np.array([_ALPHABET[b[k]] if len(b) > k else 0 for b in (chr(c).encode() for c in range(MARK))], np.uint16) for k in (0, 1))
SMALL = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(MARK)], np.uint16)
#: Of these alone a unit is a pre-token: no white space or control characters, no apostrophe, none that Python and CLASS see differently.
PLAIN = np.array([not (c <= 0x20 or 0x7F <= c <= 0xA0 or c in (0x27, RARE) or chr(c).isspace() or chr(c).isalpha() != (CLASS[c] == LETTER)) for c in range(MARK)] + [False])
BLOCK = 512  # units whose tokens are objects at once: too few lists for Python to look for garbage
HASH = Hasher(71)
HASH.values = np.random.default_rng(71).integers(0, 1 << 64, MARK + 1, U64)


class Encoder:
    """Ids of texts, with id 0 appended to each."""

    def __init__(self, path: str, limit: int = 1_000_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.words = bool(getattr(self.tokenizer.model, "end_of_word_suffix", None))  # small letters, white space dropped
        self.limit, self.bits = limit, max(10, (2 * limit).bit_length())
        self._empty()

    def _empty(self) -> None:
        self.keys, self.slot = np.zeros(1 << self.bits, U64), np.zeros(1 << self.bits, np.int32)
        self.count, self.used = 1, 1  # unit 0 is the end mark, id 0
        self.flat = np.zeros(1 << 20, np.uint32)
        self.first, self.size = np.zeros(1 << 16, np.int64), np.ones(1 << 16, np.int32)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Number of each hash's unit, -1 if it is new (linear probing)."""
        mask = (1 << self.bits) - 1
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        key = self.keys[at]
        out = np.where(key == h, self.slot[at], -1)
        go = np.flatnonzero((key != h) & (key != 0))
        while len(go):
            at[go] = (at[go] + 1) & mask
            key = self.keys[at[go]]
            hit = key == h[go]
            out[go[hit]] = self.slot[at[go[hit]]]
            go = go[~hit & (key != 0)]
        return out

    def _put(self, h: np.ndarray) -> None:
        """Enters distinct new hashes with the next numbers."""
        mask, todo = (1 << self.bits) - 1, np.arange(len(h))
        at = (h >> U64(64 - self.bits)).astype(np.int64)
        while len(todo):
            free = todo[self.keys[at[todo]] == 0]
            self.keys[at[free]] = h[free]
            won = free[self.keys[at[free]] == h[free]]
            self.slot[at[won]] = self.count + won
            lost = np.ones(len(h), bool)
            lost[won] = False
            todo = todo[lost[todo]]
            at[todo] = (at[todo] + 1) & mask

    def _ids(self, texts: list[str]) -> list[list[int]]:
        """Ids of units. A unit without white space inside, apostrophes or (for words) digits is one
        pre-token, which goes to the tokenizer's model at once, in the byte alphabet it works on."""
        out: list = [None] * len(texts)
        tokenize, whole = self.tokenizer.model.tokenize, []
        for i, text in enumerate(texts):
            core = text[1:] if text[0] == " " else text
            if not core or "'" in core or core[0] in " \n\t" or len(core.split()) != 1 or core[-1].isspace() or core[0].isspace() or (self.words and not core.isalpha() and any(CLASS[min(ord(c), RARE)] == DIGIT for c in core)) or (len(core) > 1 and core[0].isalpha() != core[-1].isalpha()) or max(core) >= "\u0130":
                whole.append(i)
                continue
            unit = core.lower() if self.words else text
            out[i] = [t.id for t in tokenize(unit.encode().decode("latin-1").translate(BYTE_ALPHABET))]
        if whole:
            for i, got in zip(whole, self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False), strict=True):
                out[i] = got.ids
        return out

    def _plain_ids(self, chars: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each unit, all ids) of units that are a pre-token each, brought into the byte alphabet as arrays.

        chars: the units' characters in a row, n for each.
        """
        two = SECOND[chars]
        end = np.cumsum(1 + (two > 0))
        out = np.zeros(int(end[-1]) if len(end) else 0, np.uint16)
        out[end[two > 0] - 1] = two[two > 0]
        out[out == 0] = FIRST[chars]
        shown, bounds = out.astype("<u2").tobytes().decode("utf-16-le"), np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])].tolist()
        tokenize, number, sizes, ids = self.tokenizer.model.tokenize, attrgetter("id"), [], []
        for i in range(0, len(n), BLOCK):
            got = [tokenize(shown[a:b]) for a, b in itertools.pairwise(bounds[i : i + BLOCK + 1])]
            sizes += map(len, got)
            ids += map(number, itertools.chain.from_iterable(got))
        return np.array(sizes, np.int64), np.array(ids, np.uint32)

    def _enter(self, joined: str, code: np.ndarray, kind: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Gives new units the next numbers and appends their ids: first those of units that are a pre-token of one class, then the others'."""
        n, space = stop - start, code[start] == 0x20
        chars = code[np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())]
        seen = np.concatenate([[0], np.cumsum(PLAIN[chars])])[np.concatenate([[0], np.cumsum(n)])]
        plain = (n > space) & (np.diff(seen) == n - space)
        if self.words:
            plain &= kind[start + (n > space) * space] != DIGIT
        mine = np.repeat(plain, n)
        if self.words:
            mine &= chars != 0x20
            chars, n = SMALL[chars], n - space
        got = self._plain_ids(chars[mine], n[plain])
        rest = np.flatnonzero(~plain)
        other = self._ids([joined[a:b] for a, b in zip(start[rest].tolist(), stop[rest].tolist(), strict=True)])
        size, first = np.empty(len(start), np.int64), np.empty(len(start), np.int64)
        size[plain], size[rest] = got[0], np.fromiter(map(len, other), np.int64, len(other))
        for some, before in ((plain, 0), (rest, len(got[1]))):
            first[some] = before + np.cumsum(size[some]) - size[some]
        self._append(first, size, np.concatenate([got[1], np.fromiter(itertools.chain.from_iterable(other), np.uint32)]))

    def _append(self, first: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Gives units the next numbers; their ids are ``size`` ones of flat, from ``first`` on."""
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.count + len(size) > len(self.first):
            self.first, self.size = (np.concatenate([a, np.zeros_like(a)]) for a in (self.first, self.size))
        at = slice(self.count, self.count + len(size))
        self.first[at], self.size[at] = self.used + first, size
        self.flat[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.count += len(size)

    def __call__(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text's ids, end id included)."""
        texts = [t or "" for t in texts]
        joined = "\n".join([*texts, ""])
        point = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
        code = np.minimum(point, RARE).astype(np.uint16)
        code[ends] = MARK
        kind = CLASS[code]
        prev, prev2, nxt = (np.full(len(kind), END, np.uint8) for _ in range(3))
        prev[1:], prev2[2:], nxt[:-1] = kind[:-1], kind[:-2], kind[1:]
        cut = (kind == END) | (prev == END) | ((code == 0x20) & (nxt < BLANK)) | ((prev < BLANK) & (kind == BLANK))
        quote = np.zeros(len(kind), bool)
        quote[1:] = code[:-1] == 0x27
        cut |= (prev < BLANK) & (kind < BLANK) & (prev != kind) & ~(quote & (kind == LETTER))
        space = np.zeros(len(kind), bool)
        space[1:] = code[:-1] == 0x20
        cut |= (kind < BLANK) & (prev == BLANK) & ~space & (prev2 != BLANK)
        hard = np.flatnonzero(np.add.reduceat(code == RARE, np.concatenate([[0], ends[:-1] + 1])) if len(texts) else [])
        for i in hard:  # such a text is one unit
            cut[ends[i] - len(texts[i]) + 1 : ends[i]] = False
        start = np.flatnonzero(cut)
        stop = np.append(start[1:], len(kind))
        h = HASH.ranges(code, start, stop)
        h[h == 0] = 1
        mark = kind[start] == END
        k = np.where(mark, 0, self._find(h))
        fresh = np.flatnonzero(k < 0)
        whole = {}
        if len(hard):  # rare characters all look alike to the hash: these units are not kept
            own = np.searchsorted(start, ends[hard] - np.array([len(texts[i]) for i in hard]))
            whole = dict(zip(own.tolist(), hard.tolist(), strict=True))
            fresh = fresh[~np.isin(fresh, own)]
        new, at = np.unique(h[fresh], return_index=True)
        if self.count + len(new) + len(whole) > self.limit and self.count > 1:
            self._empty()
            return self(texts)
        if len(new):
            if self.count + len(new) > (1 << self.bits) * 3 // 4:
                self.bits = (2 * (self.count + len(new))).bit_length() + 1
                self._empty()
                return self(texts)
            self._put(new)
            self._enter(joined, code, kind, start[fresh[at]], stop[fresh[at]])
            k[fresh] = self._find(h[fresh])
        keep = self.count, self.used
        if whole:
            k[list(whole)] = self.count + np.arange(len(whole))
            got = self._ids([texts[i] for i in whole.values()])
            n = np.fromiter(map(len, got), np.int64, len(got))
            self._append(np.cumsum(n) - n, n, np.fromiter(itertools.chain.from_iterable(got), np.uint32, int(n.sum())))
        size = self.size[k].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(size)])
        ids = self.flat[np.repeat(self.first[k] - total[:-1], size) + np.arange(total[-1])]
        self.count, self.used = keep
        return ids, np.concatenate([[0], total[1:][mark]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file in each worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str) -> str:
    """Where an installed public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)
