"""Benchmark decontamination by latent semantic retrieval.

1. Words are runs of letters and digits (A-Z lowered). Passages are WINDOW words, each half a
   window after the one before. Document frequencies of the benchmark's words are counted over all
   passages of all documents and weigh them; words in more than STOP of the passages weigh nothing,
   unless an item would lose most of its words by that. Items of more than WHOLE words are cut into
   passages, too.
2. A randomised SVD of the TF-IDF passages of all documents, and of the targets (items or their
   passages) with as much weight in all as the documents have: each task adds its passages to
   (A'A) Omega, the sums are joined by rows, and one Nystrom step gives RANK leading singular
   vectors and values.
3. Both sides are folded into that space alone (singular vectors, divided by their values) and
   normalised there. A passage whose cosine with a target reaches NEAR is a candidate.
4. A candidate counts if the longest common subsequence of the item's words and the text around the
   passage covers LCS of the item, and two of the five rarest words of the item (its answer) stand there.
5. Items of under SHORT words say too little for that; they count where all their words stand in a
   row, and those of under LEAST words only as a whole document. Items of common words mostly are
   looked for in both ways.

Targets are taken in blocks of BLOCK_ITEMS, so what is sent to the tasks is bounded; a block reads
the documents three times. Passages are projected some thousand at a time, so a very long text takes
memory for its words only.

Defined results: null and empty texts match nothing, on either side; repeated rows and ids are each
judged and give one row for a (doc_id, item_id), a null id being an id like others; cosine is null
for what was found by its words alone; empty tables give an empty result; further columns are
ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BYTE_CODE, LOWER, SHINGLE_MULT, mix, prefix_hash, slices, small_batches, span_hash, string_buffers, sum_rows, table

WINDOW, STEP = 48, 24
STOP = 0.05
RANK = 128
NEAR = 0.45
LCS = 0.6
WHOLE = 2 * WINDOW  # words of an item that is looked for as one
ANSWER_WORDS, ANSWER_SHARE = 5, 0.4
SHORT, LEAST = 8, 3
BLOCK_ITEMS = 2000
CHUNK = 1 << 18
PART = 4096  # blocks of words that are projected together

_WORD = np.ones(256, bool)
_WORD[:128] = False
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True


def _words(data: np.ndarray, off: np.ndarray):
    """Hashes of all words and the first word of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    inside = _WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.append(False, inside[:-1])
    before[edge[:n]] = False
    after = np.append(inside[1:], False)
    after[edge[1:]] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return span_hash(prefix_hash(BYTE_CODE[LOWER[data]]), start, end), np.searchsorted(start, off)


def _chunks(col):
    data, off = string_buffers(col)
    for i, j in slices(off, CHUNK):
        h, first = _words(data[off[i] : off[j]], off[i : j + 1] - off[i])
        yield i, j, h, first


def _blocks(first: np.ndarray):
    """Rows' words in blocks of STEP: the block of each word, each block's row."""
    n = np.diff(first)
    per = (n + STEP - 1) // STEP
    base = np.append(0, np.cumsum(per))
    row = np.repeat(np.arange(len(n)), per)
    inside = np.arange(first[-1]) - np.repeat(first[:-1], n)
    return np.repeat(base[:-1], n) + inside // STEP, row, base


def _term(vocab: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(vocab, h), len(vocab) - 1)
    return np.where(vocab[at] == h, at, -1)


def pieces(n: int) -> list[tuple[int, int]]:
    """What of an item of n words is looked for: all, or if it is long its passages, as documents are cut."""
    if n <= WHOLE:
        return [(0, n)]
    return [(a, a + WINDOW) for a in range(0, n - WINDOW, STEP)] + [(n - WINDOW, n)]


class Items:
    """Targets (item_id, all words of the item, first and last word) and their items' vocabulary."""

    def __init__(self, targets: list):
        self.targets = targets
        self.vocab = np.unique(np.concatenate([h for _, h, _, _ in targets]))


def _frequencies(docs: DataFrame, vocab: np.ndarray) -> tuple[np.ndarray, float]:
    n = len(vocab)

    def run(batches):
        total = np.zeros((n + 1, 1))
        for b in batches:
            for _, _, h, first in _chunks(b.column("text")):
                block, row, _ = _blocks(first)
                t = _term(vocab, h)
                hit = t >= 0
                key = np.unique(block[hit] * np.int64(n) + t[hit])
                total[:n, 0] += np.bincount(key % n, minlength=n)
                total[n] += len(row)
        return total

    got = sum_rows(docs, run, 1, n + 1)[:, 0]
    return got[:n], max(got[n], 1.0)


def _passages(weight: np.ndarray, vocab: np.ndarray, h: np.ndarray, first: np.ndarray):
    """Weighted words (term, block, weight) in the order of blocks, blocks' rows, first blocks, and which
    block is its row's last."""
    block, row, base = _blocks(first)
    t = _term(vocab, h)
    w = np.where(t >= 0, weight[t], 0).astype(np.float32)
    own = w > 0
    last = np.zeros(len(row), bool)
    last[base[1:][np.diff(base) > 0] - 1] = True
    return t[own], block[own], w[own], row, base, last


def _projected(matrix: np.ndarray, t: np.ndarray, block: np.ndarray, w: np.ndarray, last: np.ndarray):
    """Ranges of blocks, and their passages' sums of the matrix's rows: a passage is a block and the next of
    its row."""
    for lo in range(0, len(last), PART):
        hi = min(lo + PART, len(last))
        more = min(hi + 1, len(last))
        i, j = np.searchsorted(block, (lo, more))
        z = np.zeros((more - lo, matrix.shape[1]), np.float32)
        if j > i:
            heads = np.flatnonzero(np.append(True, np.diff(block[i:j])))
            z[block[i:j][heads] - lo] = np.add.reduceat(matrix[t[i:j]] * w[i:j, None], heads, axis=0)
        go = np.flatnonzero(~last[lo:hi])
        out = z[: hi - lo].copy()
        out[go] += z[go + 1]
        yield lo, hi, out


def target_vectors(items: Items, weight: np.ndarray) -> np.ndarray:
    """(targets x words) weights of the targets' words."""
    own = np.zeros((len(items.targets), len(items.vocab)), np.float32)
    for i, (_, h, a, e) in enumerate(items.targets):
        t = _term(items.vocab, h[a:e])
        np.add.at(own[i], t, weight[t])
    return own


def latent_space(docs: DataFrame, items: Items, weight: np.ndarray, df: np.ndarray, rank: int) -> np.ndarray:
    """The fold into the latent space (words x dimensions): leading singular vectors by their values."""
    vocab = items.vocab
    n = len(vocab)
    k = min(rank, n)
    omega = np.random.default_rng(5).standard_normal((n, k)).astype(np.float32)

    def run(batches):
        y = np.zeros((n, k), np.float64)
        for b in batches:
            for _, _, h, first in _chunks(b.column("text")):
                t, block, w, row, _, last = _passages(weight, vocab, h, first)
                before = None
                for lo, hi, z in _projected(omega, t, block, w, last):
                    c = z.copy()  # a block lies in two passages, its own and the one before
                    go = np.flatnonzero(~last[lo : hi - 1])
                    c[go + 1] += z[go]
                    if lo and not last[lo - 1]:
                        c[0] += before
                    before = z[-1]
                    i, j = np.searchsorted(block, (lo, hi))
                    if j > i:
                        order = np.argsort(t[i:j], kind="stable")
                        part = c[block[i:j][order] - lo] * w[i:j][order][:, None]
                        cut = np.flatnonzero(np.append(True, np.diff(t[i:j][order])))
                        y[t[i:j][order][cut]] += np.add.reduceat(part, cut, axis=0)
        return y

    own = target_vectors(items, weight).astype(np.float64)
    mass, mine = float((df * weight * weight).sum()), float((own * own).sum())
    y = sum_rows(docs, run, k, n) + (mass / mine if mass and mine else 1.0) * (own.T @ (own @ omega))
    core = omega.T.astype(np.float64) @ y
    val, vec = np.linalg.eigh((core + core.T) / 2)
    ok = val > max(val.max(initial=0), 1e-12) * 1e-9
    if not ok.any():
        return np.zeros((n, 1), np.float32)
    lead, size, _ = np.linalg.svd(y @ (vec[:, ok] / np.sqrt(val[ok])), full_matrices=False)
    some = size > size[0] * 1e-6
    return (lead[:, some] / size[some]).astype(np.float32)


def common_subsequence(a: np.ndarray, b: list) -> int:
    """Length of the longest common subsequence of two word sequences, bit-parallel in a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a.tolist()):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        m = where.get(x, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


SCHEMA = "doc_id long, item_id long, cosine double, lcs_share double"


def _gram3(h: np.ndarray) -> np.ndarray:
    """Hash of each three words in a row."""
    return mix(h[:-2] * SHINGLE_MULT[0] + h[1:-1] * SHINGLE_MULT[1] + h[2:] * SHINGLE_MULT[2])


class InARow:
    """Items that are looked for by all their words in a row, from the rarest three of them on."""

    def __init__(self, items: list, rarity):
        self.whole = [(i, h) for i, h in items if len(h) < LEAST]
        self.items = []
        for i, h in items:
            if len(h) >= LEAST:
                r = rarity(h)
                at = int(np.argmax(r[:-2] + r[1:-1] + r[2:]))
                self.items.append((_gram3(h[at : at + 3])[0], at, i, h))
        self.grams = np.unique(np.array([g for g, *_ in self.items], np.uint64))
        self.by_gram: dict[int, list] = {}
        for g, at, i, h in self.items:
            self.by_gram.setdefault(int(g), []).append((at, i, h))

    def find(self, h: np.ndarray, first: np.ndarray):
        """(row, item_id) pairs."""
        for i, want in self.whole:
            at = np.flatnonzero(np.diff(first) == len(want))
            same = np.ones(len(at), bool)
            for k in range(len(want)):
                same &= h[first[at] + k] == want[k]
            for r in at[same].tolist():
                yield r, i
        if not len(self.grams) or len(h) < 3:
            return
        g = _gram3(h)
        hits = np.flatnonzero(self.grams[np.minimum(np.searchsorted(self.grams, g), len(self.grams) - 1)] == g)
        for gram in np.unique(g[hits]).tolist():
            places = hits[g[hits] == gram]
            for at, i, want in self.by_gram[gram]:
                p = places - at
                row = np.searchsorted(first, places, side="right") - 1
                ok = (p >= first[row]) & (p + len(want) <= first[row + 1])
                p, row = p[ok], row[ok]
                for k in range(len(want)):
                    same = h[p + k] == want[k]
                    p, row = p[same], row[same]
                for r in np.unique(row).tolist():
                    yield r, i


def leaks(docs: DataFrame, targets: list, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share) of documents that hold an item of one block of targets; a pair may
    come more than once."""
    docs = docs.select("doc_id", "text")
    items = Items(targets)
    df, total = _frequencies(docs, items.vocab)
    rarity = np.log((1 + total) / (1 + df))
    common = df > STOP * total
    by_words, common_words, long_ = [], [], []
    for x in targets:
        i, h, a, e = x
        weak = common[_term(items.vocab, h[a:e])].mean() > 0.5
        if len(h) < SHORT or weak:
            by_words.append((i, h))
        if len(h) >= SHORT:
            long_.append(x)
            if weak:
                common_words.append(h[a:e])
    weight = np.where(common, 0, rarity)
    for h in common_words:  # these keep a weight, so that the space knows their items
        t = _term(items.vocab, h)
        weight[t] = np.maximum(rarity[t], 1e-3)
    items.targets = long_
    basis = latent_space(docs, items, weight, df, rank) if long_ else None
    return _retrieve(docs, items, weight, rarity, basis, InARow(by_words, lambda h: rarity[_term(items.vocab, h)]))


def _retrieve(docs: DataFrame, items: Items, weight: np.ndarray, rarity: np.ndarray, basis: np.ndarray | None, in_a_row: InARow) -> DataFrame:
    vocab, targets = items.vocab, items.targets
    answers = []
    for i, (_, h, _, _) in enumerate(targets):
        answers.append(answers[-1] if i and h is targets[i - 1][1] else set(h[np.argsort(-rarity[_term(vocab, h)], kind="stable")[:ANSWER_WORDS]].tolist()))
    if basis is not None:
        target = target_vectors(items, weight) @ basis
        target /= np.maximum(np.linalg.norm(target, axis=1, keepdims=True), 1e-30)
    # targets of one item follow one another and share its words
    row_of = np.cumsum([i == 0 or targets[i][1] is not targets[i - 1][1] for i in range(len(targets))]) - 1 if targets else []
    words_of, answers_of, id_of = {}, {}, {}
    for i, q in enumerate(row_of):
        id_of[q], words_of[q], answers_of[q] = targets[i][0], targets[i][1], answers[i]
    offset = [a for _, _, a, _ in targets]

    def candidates(h, first):
        """(row, first word of the passage, target, cosine), passages in their order."""
        t, block, w, row, base, last = _passages(weight, vocab, h, first)
        for lo, hi, z in _projected(basis, t, block, w, last):
            some = np.flatnonzero(z.any(axis=1))
            z = z[some]
            cos = (z @ target.T) / np.maximum(np.linalg.norm(z, axis=1), 1e-30)[:, None]
            p, q = np.nonzero(cos >= NEAR)
            at = some[p] + lo
            yield from zip(row[at].tolist(), (first[row[at]] + (at - base[row[at]]) * STEP).tolist(), q.tolist(), cos[p, q].tolist(), strict=True)

    def run(batches):
        for b in batches:
            docs_, out = b.column("doc_id").to_pylist(), []
            for i, _, h, first in _chunks(b.column("text")):
                if not len(h):
                    continue
                best: dict[tuple[int, int], tuple] = {}
                tried: dict[tuple[int, int], list[int]] = {}
                for r, at, target_no, c in candidates(h, first) if basis is not None else ():
                    q = int(row_of[target_no])
                    words = words_of[q]
                    key = (r, q)
                    if key in best and best[key][1] == 1.0:
                        continue
                    if len(words) > WHOLE:  # where the item would begin and end if the passage is this piece of it
                        begin = at - offset[target_no]
                        if any(abs(begin - x) <= len(words) // 8 for x in tried.get(key, ())):
                            continue
                        tried.setdefault(key, []).append(begin)
                        a, e = begin - len(words) // 4, begin + len(words) + len(words) // 4 + WINDOW
                    else:
                        a, e = at - len(words) // 2, at + WINDOW + len(words) // 2
                    region = h[max(int(first[r]), a) : min(int(first[r + 1]), e)].tolist()
                    if len(answers_of[q].intersection(region)) < ANSWER_SHARE * len(answers_of[q]):
                        continue
                    share = common_subsequence(words, region) / len(words)
                    if share >= LCS:
                        was = best.get(key, (0.0, 0.0))
                        best[key] = (max(min(c, 1.0), was[0]), max(share, was[1]))
                out += [(docs_[i + r], id_of[q], c, s) for (r, q), (c, s) in best.items()]
                out += [(docs_[i + r], item, None, 1.0) for r, item in in_a_row.find(h, first)]
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["doc_id", "item_id", "cosine", "lcs_share"])

    return docs.mapInArrow(run, SCHEMA)


def target_blocks(benchmark: DataFrame):
    """All targets in blocks of BLOCK_ITEMS. Items are read in the order of (item_id, text), nulls first;
    equal rows are one."""
    order = [F.col("item_id").asc_nulls_first(), F.col("text").asc()]
    rest = benchmark.select("item_id", "text").filter("text is not null").distinct()
    block, page, after = [], [], None
    while after is None or len(page) == BLOCK_ITEMS:
        more = rest
        if after is not None:
            item, text = after
            same = F.col("item_id").eqNullSafe(F.lit(item)) & (F.col("text") > text)
            more = rest.filter(same | (F.col("item_id").isNotNull() if item is None else F.col("item_id") > item))
        page = more.orderBy(*order).limit(BLOCK_ITEMS).collect()
        for r in page:
            raw = r["text"].encode()
            h, _ = _words(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            for a, e in pieces(len(h)) if len(h) else []:
                block.append((r["item_id"], h, a, e))
                if len(block) == BLOCK_ITEMS:
                    yield block
                    block = []
        after = (page[-1]["item_id"], page[-1]["text"]) if page else (None, "")
    if block:
        yield block


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All (doc_id, item_id) leaks, block by block of the benchmark."""
    small_batches(docs.sparkSession)
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for k, block in enumerate(target_blocks(benchmark)):
        part = leaks(docs, block)
        out = out.unionByName(part) if k else part
    return out.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("lcs_share").alias("lcs_share"))


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
