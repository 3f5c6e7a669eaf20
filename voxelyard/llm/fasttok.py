"""Exact token ids of whole texts at the cost of one library call for each distinct word.

Both vocabularies cut a text into words by a fixed pattern before any merge, so a text's
ids are those of its words, one after another. Words are found with array operations, known
ones come from a bounded table of hashes, and only new ones go to the tokenizers library.
A text with a character outside Latin blocks, or with a special token's string, goes to the
library whole: its result is the definition."""

from __future__ import annotations

import os

import numpy as np

from .common import U64, mix, prefix_hash, slices, span_hash, string_buffers

SAFE = 0x250
_CLASS = np.full(SAFE, 3, np.uint8)  # 0 white space, 1 letter, 2 number, 3 other


def _classes() -> None:
    import unicodedata

    for c in range(SAFE):
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        _CLASS[c] = 0 if c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0) else 1 if kind == "L" else 2 if kind == "N" else 3


_classes()
_CP_CODE = np.random.default_rng(77).integers(1, 2**63, SAFE, dtype=np.int64).astype(U64) | U64(1)
SLOTS = 22  # bits of the table of words
_LOADED: dict = {}


def load(path: str) -> "WordTokenizer":
    """The tokenizer of a worker; loaded once for each process."""
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


class WordTokenizer:
    """ids for batches of texts; equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.special = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        import json

        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        self.by_space = said["pre_tokenizer"]["type"] == "ByteLevel"  # a space belongs to the word after it
        suffix = said["model"]["end_of_word_suffix"] or ""
        vocab = self.lib.get_vocab(with_added_tokens=True)
        self.token_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for t, i in vocab.items():
            self.token_bytes[i] = len(t.removesuffix(suffix)) if suffix else len(t)
        self.line_end = vocab.get("\u010a", -1)
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << SLOTS, U64)
        self.slot = np.zeros(1 << SLOTS, np.int32)
        self.count = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.off = np.zeros(1 << 16, np.int64)  # end of word i's ids at i + 1

    # -------------------------------------------------------------- table of words
    def find(self, h: np.ndarray) -> np.ndarray:
        at = (h >> U64(64 - SLOTS)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        k = self.keys[at]
        hit = k == h
        out[hit] = self.slot[at[hit]]
        left = np.flatnonzero(~hit & (k != 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << SLOTS) - 1)
            k = self.keys[at[left]]
            hit = k == h[left]
            out[left[hit]] = self.slot[at[left[hit]]]
            left = left[~hit & (k != 0)]
        return out

    def add(self, h: np.ndarray, lists: list) -> None:
        n = len(h)
        lens = np.fromiter(map(len, lists), np.int64, n)
        while self.count + n + 1 > len(self.off):
            self.off = np.concatenate([self.off, np.zeros_like(self.off)])
        base = self.off[self.count]
        ends = base + np.cumsum(lens)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[base : ends[-1]] = np.fromiter((i for x in lists for i in x), np.int32, int(lens.sum()))
        self.off[self.count + 1 : self.count + n + 1] = ends
        number = np.arange(self.count, self.count + n, dtype=np.int32)
        self.count += n
        at = (h >> U64(64 - SLOTS)).astype(np.int64)
        todo = np.arange(n)
        while len(todo):
            free = self.keys[at[todo]] == 0
            tried, first = np.unique(at[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[tried], self.slot[tried] = h[put], number[put]
            done = np.zeros(n, bool)
            done[put] = True
            todo = todo[~done[todo]]
            at[todo] = (at[todo] + 1) & ((1 << SLOTS) - 1)

    # -------------------------------------------------------------- words
    def words(self, cp: np.ndarray, first: np.ndarray):
        """Starts and ends of the words of concatenated texts; ``first``: each text's start."""
        n = len(cp)
        kind = _CLASS[cp]
        head = np.zeros(n + 1, bool)
        head[first] = True
        head[n] = True
        head = head[: n + 1]
        new = np.ones(n, bool)
        new[1:] = kind[1:] != kind[:-1]
        new |= head[:n]
        blank = kind == 0
        if self.by_space:
            last = np.zeros(n, bool)  # white space right before a word of the same text
            last[:-1] = blank[:-1] & ~blank[1:] & ~head[1:n]
            joins = last & (cp == 32)
            start = (new & blank) | last
            own = new & ~blank
            own[1:] &= ~joins[:-1]
            start |= own
        else:
            start = new | (kind == 2)
        apos = np.flatnonzero((cp == 39) & start)
        if len(apos):
            pad = np.concatenate([cp, np.zeros(3, cp.dtype)])
            stop = np.concatenate([head, np.ones(3, bool)])
            a, b = pad[apos + 1], pad[apos + 2]
            one = np.isin(a, [115, 116, 109, 100]) & ~stop[apos + 1]
            two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~stop[apos + 1] & ~stop[apos + 2]
            if not self.by_space:  # it lowers the text first
                a, b = np.where((a > 64) & (a < 91), a + 32, a), np.where((b > 64) & (b < 91), b + 32, b)
                one = np.isin(a, [115, 116, 109, 100]) & ~stop[apos + 1]
                two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & ~stop[apos + 1] & ~stop[apos + 2]
            for hit, size in ((one, 2), (two & ~one, 3)):
                p = apos[hit]
                start[p + 1] = False
                after = p + size
                inside = after < n
                start[after[inside]] |= True
        s = np.flatnonzero(start)
        e = np.append(s[1:], n)
        if not self.by_space:
            keep = ~blank[s]
            s, e = s[keep], e[keep]
        return s, e

    # -------------------------------------------------------------- texts
    def _slow(self, texts: list) -> list:
        return [x.ids for x in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def _new(self, words: list) -> list:
        """ids of distinct words. Words of letters are encoded many at once, parted by a line
        end (a word of its own, or none), and told apart by the length of their tokens."""
        out: list = [None] * len(words)
        plain = [k for k, w in enumerate(words) if w.isalpha() or (w[0] == " " and w[1:].isalpha())]
        for a in range(0, len(plain), 2000):
            some = plain[a : a + 2000]
            ids = np.array(self.lib.encode_batch_fast(["\n".join([words[k] for k in some])], add_special_tokens=False)[0].ids, np.int64)
            if self.by_space:
                ids = np.append(ids, self.line_end)
            size = np.cumsum(self.token_bytes[ids])
            gap = 1 if self.by_space else 0
            ends = np.cumsum(np.fromiter((len((words[k] if gap else words[k].lower()).encode()) + gap for k in some), np.int64, len(some)))
            cut = np.searchsorted(size, ends)
            if cut[-1] + 1 != len(ids) or (size[cut] != ends).any():
                raise ValueError("tokens cross words; the vocabulary doesn't cut words as expected")
            first = 0
            ids = ids.tolist()
            for k, c in zip(some, cut.tolist(), strict=True):
                out[k] = ids[first : c + 1 - gap]
                first = c + 1
        rest = [k for k in range(len(words)) if out[k] is None]
        for k, x in zip(rest, self._slow([words[k] for k in rest]), strict=True):
            out[k] = x
        return out

    def tokens(self, col, most: int = 1 << 18):
        """For slices of a string column: (first row, last row, word numbers' ids flat, offsets
        of rows, byte counts); ids of each row lie between its offsets."""
        data, off = string_buffers(col)
        for i, j in slices(off, most):
            yield i, j, *self._some(data[off[i] : off[j]], off[i : j + 1] - off[i])

    def _some(self, data: np.ndarray, off: np.ndarray):
        rows = len(off) - 1
        raw = data.tobytes()
        whole = raw.decode("utf-8")
        cp = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        if len(cp) == len(data):
            cut = off
        else:
            lead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
            cut = lead[off]
        bad = np.flatnonzero((cp >= SAFE) | (cp == 0x130))
        odd = np.zeros(rows, bool)
        if len(bad):
            odd[np.searchsorted(cut, bad, side="right") - 1] = True
        for mark in self.special:
            p = whole.find(mark)
            while p >= 0:
                odd[np.searchsorted(cut, p, side="right") - 1] = True
                p = whole.find(mark, p + 1)
        lens = np.diff(cut)
        if odd.any():
            keep = np.repeat(~odd, lens)
            plain = cp[keep]
            lens = np.where(odd, 0, lens)
            text = plain.tobytes().decode("utf-32-le")
            cp = plain
        else:
            text = whole
        pos = np.zeros(rows + 1, np.int64)
        np.cumsum(lens, out=pos[1:])
        if len(cp):
            s, e = self.words(cp, pos[:-1][lens > 0])
            h = span_hash(prefix_hash(_CP_CODE[cp]), s, e)
            h[h == 0] = 1
            num = self.find(h)
            miss = np.flatnonzero(num < 0)
            if len(miss):
                fresh, at = np.unique(h[miss], return_index=True)
                if self.count + len(fresh) > (1 << SLOTS) * 6 // 10:
                    self.clear()
                    miss = np.arange(len(h))
                    fresh, at = np.unique(h, return_index=True)
                at = miss[at]
                self.add(fresh, self._new([text[a:b] for a, b in zip(s[at].tolist(), e[at].tolist(), strict=True)]))
                num[miss] = self.find(h[miss])
            per = self.off[num + 1] - self.off[num]
            upto = np.zeros(len(num) + 1, np.int64)
            np.cumsum(per, out=upto[1:])
            ids = self.ids[np.repeat(self.off[num] - upto[:-1], per) + np.arange(upto[-1])]
            ends = upto[np.searchsorted(s, pos)]
        else:
            ids, ends = np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
        if odd.any():
            which = np.flatnonzero(odd)
            parts, counts = [], np.diff(ends)
            slow = dict(zip(which.tolist(), self._slow([raw[off[r] : off[r + 1]].decode("utf-8") for r in which]), strict=True))
            for r in range(rows):
                x = np.array(slow[r], np.int32) if r in slow else ids[ends[r] : ends[r + 1]]
                counts[r] = len(x)
                parts.append(x)
            ids = np.concatenate(parts)
            ends = np.concatenate([[0], np.cumsum(counts)])
        return ids, ends


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
