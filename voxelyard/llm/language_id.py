"""Language identification as a mixture.

Learned: counts of hashed three-byte grams for each language, over every labelled document outside
the held-out fold. A document is a bag of words drawn from several languages; expectation-
maximisation estimates the proportions from the words' gram likelihoods, and the set of languages
is the one of greatest likelihood less half a log of the words for each language. The prediction is
the set's most frequent language, the score its proportion.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is everything
where nothing was learned; repeated rows are each answered; ties go to the name that sorts first;
a null doc_id is outside the held-out fold; an empty table gives an empty result; further columns
are ignored. A very long text is read whole, as one slice of its own: the memory of a task follows
the longest text, some 60 bytes and 16 a language for each of its bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import GROUP, SPACE, slices, small_batches, string_buffers, table

FOLDS, HELD = 4, 2
BINS = 1 << 16
PARTS = BINS >> 12  # ranges of bins that are added apart
SMOOTH = 0.5
ITERATIONS = 15
CAP = 30.0  # a word's log-likelihood ratios are cut here, so exp() stays in range
_REC = np.dtype([("bin", "<u2"), ("n", "<i8")])
_NORMAL = np.arange(256, dtype=np.uint8)
_NORMAL[65:91] += 32
_NORMAL[48:58] = 48
_NORMAL[SPACE] = 32


def held_out(doc_id) -> "F.Column":
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD, F.lit(False))


def grams(data: np.ndarray, off: np.ndarray):
    """The bin of the gram around each byte, and where words start; texts don't touch."""
    b = np.full(len(data) + 2, 32, np.uint32)
    b[1:-1] = _NORMAL[data]
    left, right = b[:-2].copy(), b[2:].copy()
    inner = off[1:-1][off[1:-1] < len(data)]
    left[inner] = 32
    right[inner[inner > 0] - 1] = 32
    code = ((left << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | right) * np.uint32(2654435761)
    blank = b[1:-1] == 32
    begin = ~blank
    begin[1:] &= blank[:-1]
    head = off[:-1][off[:-1] < len(data)]
    begin[head] = ~blank[head]
    return (code >> np.uint32(16)).astype(np.int64), blank, np.flatnonzero(begin)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities by bin, from rows (text, lang). Counts are summed on the
    executors by (language, range of bins): those of GROUP tasks, then of GROUP such groups, then of all,
    so that no task meets the counts of every task. The driver gets BINS numbers a language."""

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            data, off = string_buffers(b.column("text"))
            for lang, s, e in zip(b.column("lang").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                if e > s:
                    g, blank, _ = grams(data[s:e], np.array([0, e - s]))
                    if lang not in sums:
                        sums[lang] = np.zeros(BINS, np.int64)
                    g = g[~blank]
                    if len(g) > BINS // 8:
                        sums[lang] += np.bincount(g, minlength=BINS)
                    else:
                        np.add.at(sums[lang], g, 1)
        group = TaskContext.get().partitionId() // GROUP
        for lang, c in sums.items():
            yield _counts([(group, lang, p, _packed(c[p << 12 : (p + 1) << 12])) for p in range(PARTS)])

    def add(batches):
        key, held = None, None  # counts come in the order of their keys
        for b in batches:
            for *now, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if key != now:
                    if key is not None:
                        yield _counts([(key[0] // GROUP, *key[1:], _packed(held))])
                    key, held = now, np.zeros(1 << 12, np.int64)
                rec = np.frombuffer(x, _REC)
                held[rec["bin"].astype(np.int64)] += rec["n"]
        if key is not None:
            yield _counts([(key[0] // GROUP, *key[1:], _packed(held))])

    schema = "g int, lang string, part int, counts binary"
    some = docs.mapInArrow(count, schema)
    for _ in range(2):
        some = some.repartition("g", "lang", "part").sortWithinPartitions("g", "lang", "part").mapInArrow(add, schema)
    got = some.select("lang", "part", "counts").collect()  # PARTS rows a language, for each GROUP ** 2 tasks
    langs = sorted({r["lang"] for r in got})
    table_ = np.zeros((len(langs), BINS))
    for r in got:
        rec = np.frombuffer(r["counts"], _REC)
        table_[langs.index(r["lang"]), (r["part"] << 12) + rec["bin"].astype(np.int64)] += rec["n"]
    table_ = (table_ + SMOOTH) / (table_.sum(axis=1, keepdims=True) + SMOOTH * BINS)
    return langs, np.log(table_).astype(np.float32)


def _packed(counts: np.ndarray) -> bytes:
    """The bins that have a count, with it."""
    at = np.flatnonzero(counts)
    rec = np.zeros(len(at), _REC)
    rec["bin"], rec["n"] = at, counts[at]
    return rec.tobytes()


def _counts(rows):
    g, lang, part, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(g, pa.int32()), pa.array(lang, pa.string()), pa.array(part, pa.int32()), pa.array(counts, pa.binary())], names=["g", "lang", "part", "counts"])


def mixture(like: np.ndarray, first: np.ndarray):
    """Proportions (languages x texts) by expectation-maximisation, the size of the chosen set and
    the order of languages, for words' log-likelihoods (languages x words); texts' first words."""
    k, words = like.shape
    n = np.diff(np.append(first, words))
    top = like.max(axis=0)
    p = np.exp(np.maximum(like - top, -CAP)).astype(np.float64)
    pi = np.full((k, len(first)), 1.0 / k)
    for _ in range(ITERATIONS):
        r = p * np.repeat(pi, n, axis=1)
        r /= r.sum(axis=0)
        pi = np.add.reduceat(r, first, axis=1) / n
    order = np.argsort(-pi, axis=0, kind="stable")
    best, size = np.full(len(first), -np.inf), np.ones(len(first), np.int64)
    mask = np.zeros_like(pi)
    cols = np.arange(len(first))
    for s in range(1, k + 1):
        mask[order[s - 1], cols] = 1
        part = pi * mask
        part = part / np.maximum(part.sum(axis=0), 1e-300)
        seen = (p * np.repeat(part, n, axis=1)).sum(axis=0)
        value = np.add.reduceat(np.log(np.maximum(seen, 1e-300)), first) - 0.5 * s * np.log(np.maximum(n, 2))
        better = value > best
        best[better], size[better] = value[better], s
    return pi, size, order


def identify(docs: DataFrame, langs: list[str], logp: np.ndarray) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, lang_set) of rows (doc_id, text). No shuffle."""
    k = len(langs)

    def run(batches):
        for b in batches:
            col = b.column("text")
            data, off = string_buffers(col)
            rows = len(off) - 1
            pred, score, sets = np.full(rows, -1, np.int64), np.zeros(rows), [""] * rows
            for i, j in slices(off, 1 << 18):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                if not len(d) or not k:
                    continue
                low = _NORMAL[d]
                has = np.zeros(len(d) + 1, np.int64)
                np.cumsum((low > 96) & (low < 123), out=has[1:])
                letters = has[o[1:]] > has[o[:-1]]
                for r in np.flatnonzero(~letters & (np.diff(o) > 0)):
                    letters[r] = any(c.isalpha() for c in d[o[r] : o[r + 1]].tobytes().decode("utf-8"))
                g, blank, start = grams(d, o)
                word_row = np.searchsorted(o, start, side="right") - 1
                keep = letters[word_row]
                if not keep.any():
                    continue
                like = np.empty((k, int(keep.sum())), np.float32)
                for x in range(k):
                    v = logp[x][g]
                    v[blank] = 0
                    like[x] = np.add.reduceat(v, start)[keep]
                word_row = word_row[keep]
                heads = np.flatnonzero(np.diff(word_row, prepend=-1))
                who = word_row[heads]
                pi, size, order = mixture(like, heads)
                pred[i + who] = order[0]
                score[i + who] = pi[order[0], np.arange(len(who))]
                for c, r in enumerate(who.tolist()):
                    sets[i + r] = ",".join(sorted(langs[x] for x in order[: size[c], c]))
            names = pa.array([langs[x] if x >= 0 else "und" for x in pred.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), names, pa.array(np.clip(score, 0, 1)), pa.array(sets, pa.string())], names=["doc_id", "held_out", "lang_pred", "score", "lang_set"])

    return docs.select("doc_id", held_out("doc_id").alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, lang_set string")


def language_id(docs: DataFrame) -> DataFrame:
    """Learn from docs' labelled rows outside the held-out fold and answer for every row."""
    small_batches(docs.sparkSession)
    train = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id")).select("text", "lang")
    langs, logp = learn(train)
    return identify(docs, langs, logp)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
