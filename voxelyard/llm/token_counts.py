"""Token counts by prefix dynamic programming.

1. A word's table: the last token of a prefix is the one that ends there and may follow the last
   token before it, which one pair of tokens decides; then count[i] = count[i - size of the last
   token] + 1. No prefix is encoded again.
2. A text's table has an entry for each prefix, by code points: tokens of the words before, and the
   entry of the word cut by the prefix. White space at a prefix's end is one word, though the text
   goes on; a contraction cut in its middle is two.
3. Strings of special tokens part a text before words are cut, and count as one token; a prefix that
   ends inside one has it as ordinary text.

The query takes its counts from the last entries. Entries equal the library's counts of the prefixes.

Defined results: a null text counts as empty (0 bytes, 0 tokens); repeated rows and ids are each
kept; an empty table gives an empty result; further columns of the input are ignored."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fasttok
from .common import slices, small_batches, string_buffers, table

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 1024
MOST_PAIRS = 1_000_000  # pairs of tokens, and words, that a worker remembers

_BLANK = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_CUT_IN_TWO = ("'re", "'ve", "'ll")


def _alphabet() -> dict[int, int]:
    """The byte-level alphabet: printable bytes stand for themselves, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: b for b in own} | {b: 256 + k for k, b in enumerate(rest)}


class PrefixTokenizer(fasttok.WordTokenizer):
    """tables() gives the counts of all prefixes; the table of words holds each word's steps from one
    prefix to the next in place of its ids."""

    def __init__(self, path: str):
        super().__init__(path)
        if not self.by_space:
            raise ValueError("prefix tables need a byte-level vocabulary")
        self.letters = _alphabet()
        self.vocab = self.lib.get_vocab(with_added_tokens=False)
        self.tails = {t[i:] for t in self.vocab for i in range(len(t))}
        self.marks = re.compile("|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) or "(?!)")
        self.follows: dict[tuple[str, str], bool] = {}
        self.known: dict[str, list[int]] = {}

    def _follow(self, a: str, b: str) -> bool:
        """Whether b stays a token of its own after the token a ("" at a word's start)."""
        got = self.follows.get((a, b))
        if got is None:
            if len(self.follows) >= MOST_PAIRS:
                self.follows.clear()
            got = self.follows[a, b] = [t.value for t in self.lib.model.tokenize(a + b)] == ([a, b] if a else [b])
        return got

    def word(self, part: str) -> list[int]:
        """count[i]: tokens of part[: i + 1] of one word."""
        raw = part.encode()
        s = raw.decode("latin-1").translate(self.letters)
        last, count, out = [""], [0], []
        for i in range(1, len(s) + 1):
            ends, j = [], i - 1
            while j >= 0 and (t := s[j:i]) in self.tails:
                if t in self.vocab:
                    ends.append((j, t))
                j -= 1
            j, t = next((j, t) for j, t in reversed(ends) if self._follow(last[j], t))
            last.append(t)
            count.append(count[j] + 1)
            if i == len(s) or raw[i] & 0xC0 != 0x80:
                out.append(count[i])
        return [1, 2, out[2]] if part in _CUT_IN_TWO else out

    def _known(self, part: str) -> list[int]:
        if part not in self.known:
            if len(self.known) >= MOST_PAIRS:
                self.known.clear()
            self.known[part] = self.word(part)
        return self.known[part]

    def _new(self, words: list) -> list:
        return [np.diff(self.word(w), prepend=0).tolist() for w in words]

    def _slow(self, texts: list) -> list:
        return [np.diff(self.whole(t), prepend=0).tolist() for t in texts]

    def spans(self, text: str):
        """Ordinary parts of a text with the words in each, and the special string after it."""
        at = 0
        for m in [*self.marks.finditer(text), None]:
            end = m.start() if m else len(text)
            words = [(at + a, at + b) for _, (a, b) in self.lib.pre_tokenizer.pre_tokenize_str(text[at:end])] if end > at else []
            yield end, words, m.end() if m else end
            at = m.end() if m else end

    def whole(self, text: str) -> list[int]:
        """Tokens of text[: i + 1], for a text of any characters."""
        out: list[int] = []
        total = 0
        for end, words, after in self.spans(text):
            upto, fixed = [], []
            for k, (a, b) in enumerate(words):
                if k and _BLANK.fullmatch(text, words[k - 1][0], a + 1):
                    fixed.append((a, upto[k - 1] + self._known(text[words[k - 1][0] : a + 1])[-1]))
                upto.append(total)
                counts = self._known(text[a:b])
                out += [total + c for c in counts]
                total += counts[-1]
            for p, c in fixed:
                out[p] = c
            if after > end:
                k = max(len(words) - 3, 0)  # a cut special string may join the words before
                a, before = (words[k][0], upto[k]) if words else (end, total)
                out += [before + len(self.lib.encode(text[a:i], add_special_tokens=False).ids) for i in range(end + 1, after)]
                total += 1
                out.append(total)
        return out

    def tables(self, col, most: int = 1 << 18):
        """For slices of a string column: first row, last row, counts of all prefixes (the empty one's 0
        first) flat, and the rows' offsets."""
        data, off = string_buffers(col)
        for i, j in slices(off, most):
            raw, cut = data[off[i] : off[j]], off[i : j + 1] - off[i]
            steps, ends = self._some(raw, cut)
            rows = np.repeat(np.arange(j - i), np.diff(ends))
            running = np.cumsum(steps, dtype=np.int64)
            base = np.append(0, running)[ends[:-1]]
            text = raw.tobytes().decode("utf-8")
            cp = np.frombuffer(text.encode("utf-32-le"), "<u4")
            blank = (cp < fasttok.SAFE) & (fasttok._CLASS[np.minimum(cp, fasttok.SAFE - 1)] == 0)
            odd = np.zeros(j - i, bool)  # these went through whole()
            odd[rows[(cp >= fasttok.SAFE) | (cp == 0x130)]] = True
            for m in self.marks.finditer(text):
                odd[rows[m.start()]] = True
            fresh = np.ones(len(cp), bool)  # no white space of the same text right before
            fresh[1:] = ~blank[:-1] | (rows[1:] != rows[:-1])
            runs = np.flatnonzero(blank & fresh)
            at = np.flatnonzero(blank[:-1] & ~blank[1:] & ~fresh[:-1] & (rows[1:] == rows[:-1]))
            at = at[~odd[rows[at]]]
            if len(at):
                a = runs[np.searchsorted(runs, at, side="right") - 1]
                tail = [self._known(text[x : y + 1])[-1] for x, y in zip(a.tolist(), at.tolist(), strict=True)]
                running[at] = np.append(0, running)[a] + tail
            flat = np.zeros(len(cp) + j - i, np.int32)
            flat[np.arange(len(cp)) + rows + 1] = running - base[rows]
            yield i, j, flat, ends + np.arange(j - i + 1)


_LOADED: dict[str, PrefixTokenizer] = {}


def load(path: str) -> PrefixTokenizer:
    """The tokenizer of a worker; loaded once for each process."""
    if path not in _LOADED:
        _LOADED[path] = PrefixTokenizer(path)
    return _LOADED[path]


class PrefixTable:
    """Exact token counts of all prefixes of one text."""

    def __init__(self, text: str, vocabulary: str = VOCABULARY):
        tok = load(fasttok.vocabulary(vocabulary))
        self.text = text
        self.upto = [0, *tok.whole(text)]
        self.end = [b for _, words, _ in tok.spans(text) for _, b in words]

    def count(self, n: int) -> int:
        """Tokens of the first n code points."""
        return self.upto[max(0, min(n, len(self.text)))]

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix that ends with a word and has at most ``budget`` tokens."""
        return max((e for e in self.end if self.upto[e] <= budget and not self.text[e - 1].isspace()), default=0)


def prefix_tables(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, prefix): prefix[n] is the token count of the text's first n code points. No
    shuffle; each worker keeps a bounded table of the words it has met."""
    small_batches(docs.sparkSession)
    path = fasttok.vocabulary(vocabulary)

    def run(batches):
        tok = load(path)
        for b in batches:
            ids, size = b.column("doc_id"), np.diff(string_buffers(b.column("text"))[1])
            for i, j, flat, off in tok.tables(b.column("text")):
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(size[i:j]), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))], names=["doc_id", "n_bytes", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, prefix array<int>")


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text: the last entry of its table."""
    n = F.element_at("prefix", -1).cast("long")
    return prefix_tables(docs, vocabulary).select("doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
