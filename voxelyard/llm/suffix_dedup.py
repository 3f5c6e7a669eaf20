"""Removal of repeated byte strings, by a Burrows-Wheeler transform built column by column.

A byte goes if a string of MATCH bytes that covers it also starts earlier (smaller doc_id, or the
same document further left); strings are judged on the input.

1. Every window of MATCH bytes has an anchor: its gram of GRAM bytes with the least hash (leftmost
   on ties). Consecutive windows with one anchor are a strand of at most MATCH - GRAM + 1 windows.
   Equal windows have equal anchors at equal places, so only strands with one anchor hash can hold
   equal windows, and no two windows of one strand are equal.
2. Strands are exchanged by anchor hash, equal strands combined on the map side first, so that a group
   of copies is one strand of a task. Strands are equal whose two digests are, 96 bits of two
   unlike hashes. Of equal strands, all but the first go whole. An anchor hash with one distinct strand
   is done.
3. The distinct strands that share an anchor hash form collections of short documents. Each round
   inserts one symbol of every document, from its end, into the transform and the array of common
   prefixes, which are read and written from front to back; beyond TAPE bytes they stand in files of the
   task, in Spark's own local folders as other spilled data, and go with it. In the finished order,
   windows with a common prefix of MATCH bytes are equal; the first stays.
4. An anchor hash with very many distinct strands (a frequent line) is split: its windows are
   exchanged one by one, by their own two digests, of equal windows of a task the first only, so no task
   collects them.

Defined results: a null text is empty; repeated rows and equal ids are separate documents, in the
order of (doc_id, text), nulls first; texts shorter than MATCH lose nothing; very long texts are looked
at in parts that overlap; an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import hashlib
import os
import tempfile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BASE_INV, BYTE_CODE, U64, Scratch, _powers, bucket_of, buckets_for, grouped, mix, partitions, prefix_hash, slices, small_batches, span_hash, squeeze, string_buffers, table, text_bytes, unsqueeze, with_uid

MATCH, GRAM = 100, 24
PLACES = MATCH - GRAM + 1
BLOCK = 1 << 18  # bytes of a text that are looked at together
FLUSH = 1_500_000  # strands a task holds before it sends them
CROWD_TASK, CROWD = 16, 64  # distinct strands of one anchor hash in a task, or altogether, beyond which it is split
COLLECTION = 10_000  # strands to a transform, and the rest of the last one's anchor hash
TAPE = 1 << 20
SIDE = (MATCH - GRAM) // 2  # bytes beside the anchor that one half of the windows has in common

STRAND = np.dtype([("key", "<u4"), ("same", "<u8"), ("also", "<u4"), ("uid", "<i8"), ("at", "<u4"), ("n", "u1"), ("kind", "u1"), ("rel", "u1"), ("left", "<u2"), ("right", "<u2")])
GONE = np.dtype([("uid", "<i8"), ("at", "<u4"), ("len", "<u4")])
ASKED = np.dtype([("uid", "<i8"), ("at", "<u4"), ("n", "u1"), ("key", "<u8"), ("split", "u1")])
SENT = np.dtype([("key", "<u8"), ("also", "<u4"), ("uid", "<i8"), ("at", "<u4"), ("len", "u1")])


# ---------------------------------------------------------------- strands
_OTHER = np.random.default_rng(20240301).integers(1, 2**63, 256, dtype=np.int64).astype(U64) | U64(1)
_BASE = U64(0xD1342543DE82EF95)
_INVERSE = U64(pow(int(_BASE), -1, 2**64))


def other_digest(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """32 bits of each span by another hash than span_hash()."""
    s = np.zeros(len(data) + 1, U64)
    np.cumsum(_OTHER[data] * _powers("up2", _BASE, len(data)), out=s[1:])
    return (mix((s[end] - s[start]) * _powers("down2", _INVERSE, len(s))[start]) >> U64(32)).astype(np.uint32)


def strands(data: np.ndarray, off: np.ndarray):
    """First window, windows, anchor hash, content hash and other digest, anchor's offset and the hashes of the
    anchor with SIDE bytes to its left and right, of all strands of some rows."""
    n = len(data)
    z = np.zeros(0, np.int64)
    none = z, z, z.astype(U64), z.astype(U64), z.astype(np.uint32), z, z, z
    if n < MATCH:
        return none
    s = prefix_hash(BYTE_CODE[data])
    inv = _powers("down", BASE_INV, n)
    gram = mix((s[GRAM:] - s[: n - GRAM + 1]) * inv[: n - GRAM + 1])
    low = U64((1 << 20) - 1)
    m = (gram & ~low) | np.arange(len(gram), dtype=U64)
    width = 1
    while width * 2 <= PLACES:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    m = np.minimum(m[: len(m) - (PLACES - width)], m[PLACES - width :])  # least of PLACES grams
    step = np.zeros(n + 1, np.int32)
    first, last = off[:-1], off[1:]
    np.add.at(step, np.maximum(first, last - (MATCH - 1)), 1)
    np.add.at(step, last, -1)
    at = np.flatnonzero(np.cumsum(step[: len(m)]) == 0)
    if not len(at):
        return none
    anchor = (m[at] & low).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)
    heads = np.flatnonzero(new)
    start = at[heads]
    count = np.diff(np.append(heads, len(at)))
    a = anchor[heads]
    # windows from a - SIDE on hold the right side, those before hold the left side
    right, left = start + count - 1 >= a - SIDE, start < a - SIDE
    r = span_hash(s, a, np.where(right, a + GRAM + SIDE, a)) & U64(0xFFFF)
    f = span_hash(s, np.where(left, a - SIDE, a), a + GRAM) & U64(0xFFFF)
    end = start + count + MATCH - 1
    return start, count, gram[a], span_hash(s, start, end), other_digest(data, start, end), a - start, f, r


def row_blocks(uids: np.ndarray, data: np.ndarray, off: np.ndarray):
    """(uids, offsets in the texts, bytes, offsets) of parts of at most about BLOCK bytes; parts of
    a longer text overlap, so that every window lies in exactly one."""
    for i, j in slices(off, BLOCK):
        if j - i == 1 and off[j] - off[i] > 2 * BLOCK:
            for a in range(int(off[i]), int(off[j]), BLOCK):
                e = min(a + BLOCK + MATCH - 1, int(off[j]))
                if e - a >= MATCH:
                    yield uids[i:j], np.array([a - off[i]]), data[a:e], np.array([0, e - a])
        else:
            yield uids[i:j], np.zeros(j - i, np.int64), data[off[i] : off[j]], off[i : j + 1] - off[i]


def _first_of(same: np.ndarray, rec: np.ndarray) -> np.ndarray:
    """Whether each record is the first, by (uid, at), of those with its value of ``same`` and its other
    digest. Where unlike records share ``same`` alone, some later ones may count as first; they are then
    compared by the transform like any others."""
    order = np.argsort(same, kind="stable")
    s, t = same[order], rec["also"][order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (t[1:] != t[:-1])
    out = np.ones(len(s), bool)
    multi = ~new
    multi[:-1] |= ~new[1:]
    idx = order[multi]
    if len(idx):
        sub = idx[np.lexsort((rec["at"][idx], rec["uid"][idx], rec["also"][idx], same[idx]))]
        head = np.ones(len(sub), bool)
        head[1:] = (same[sub][1:] != same[sub][:-1]) | (rec["also"][sub][1:] != rec["also"][sub][:-1])
        out[sub[~head]] = False
    return out


def _gone(rec: np.ndarray, length: np.ndarray) -> np.ndarray:
    g = np.empty(len(rec), GONE)
    g["uid"], g["at"], g["len"] = rec["uid"], rec["at"], length
    return g


def _rows(out: list):
    """(bucket, kind, payload) rows."""
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "kind", "payload"])


_PACKED = "bucket int, kind int, payload binary"
K_STRAND, K_GONE, K_ASKED, K_TEXT, K_SENT = 0, 1, 2, 3, 4


def _by_uid(rec: np.ndarray, n: int, kind: int) -> list:
    if not len(rec):
        return []
    return [(b, kind, squeeze(rec[at])) for b, at in grouped(rec["uid"] % n)]


# ---------------------------------------------------------------- the transform
class Tape:
    """An array that is read and written whole, from front to back: in a file of the task's own
    folder where it is longer than TAPE bytes."""

    def __init__(self, folder: str, name: str):
        self.path, self.turn, self.held = os.path.join(folder, name), 0, None

    def write(self, a: np.ndarray) -> None:
        self.held = a
        if len(a) > TAPE:
            self.turn ^= 1
            a.tofile(f"{self.path}.{self.turn}")
            self.held = None

    def read(self) -> np.ndarray:
        return np.fromfile(f"{self.path}.{self.turn}", np.uint8) if self.held is None else self.held


def local_folder() -> str | None:
    """One of Spark's folders for what a task spills; None where there is none."""
    return next((d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)), None)


NONE = 255  # no byte of UTF-8; stands where a document has no further symbol


def transform(blob: np.ndarray, start: np.ndarray, size: np.ndarray, folder: str):
    """The transform and common prefixes of a collection: one symbol of each document a round,
    from the last to the first. Row q's common prefix is with row q - 1."""
    n = len(start)
    bwt, lcp = Tape(folder, "bwt"), Tape(folder, "lcp")
    bwt.write(blob[start + size - 1])
    lcp.write(np.zeros(n, np.uint8))
    long_first = np.argsort(-size, kind="stable")  # documents still going on come first
    where, left, end = long_first.copy(), size[long_first], (start + size)[long_first]
    for j in range(1, int(size.max(initial=0)) + 1):
        b, old = bwt.read(), lcp.read()
        m, act = len(b), int(np.searchsorted(-left, -j, side="right"))
        order = np.argsort(b, kind="stable")
        rank = np.empty(m, np.int32)
        rank[order] = np.arange(m, dtype=np.int32)
        k = rank[where[:act]].astype(np.int64)
        new = n + k
        stays = np.ones(m + act, bool)
        stays[new] = False
        nb, nl = np.empty(m + act, np.uint8), np.zeros(m + act, np.uint8)
        nb[stays], nl[stays] = b, old
        nb[new] = np.where(left[:act] > j, blob[np.maximum(end[:act] - j - 1, 0)], NONE)
        near = np.zeros(m + 1, bool)  # new rows, and the rows after them
        near[k] = True
        near[k + 1] = True
        near[0] = near[m] = False
        pair = np.flatnonzero(near)
        lo, hi = order[pair - 1], order[pair]
        symbol = b[hi]
        like = (b[lo] == symbol) & (symbol != NONE)
        nl[n + pair[~like & (symbol != NONE)]] = 0
        pair, lo, hi = pair[like], lo[like], hi[like]
        if len(pair):
            by = np.argsort(lo.astype(np.int32), kind="stable")
            ends = np.empty(2 * len(pair), np.int64)
            ends[0::2], ends[1::2] = lo[by] + 1, hi[by] + 1
            least = np.minimum.reduceat(np.append(old, np.uint8(0)), ends)[0::2]
            nl[n + pair[by]] = np.minimum(least, 253) + 1
        where[:act] = new
        bwt.write(nb)
        lcp.write(nl)
    return bwt.read(), lcp.read()


def equal_windows(blob: np.ndarray, start: np.ndarray, size: np.ndarray):
    """(document, offset, group) of all windows of MATCH bytes; equal windows share a group."""
    with tempfile.TemporaryDirectory(dir=local_folder()) as folder:
        bwt, lcp = transform(blob, start, size, folder)
    n = len(start)
    group = np.cumsum(lcp < MATCH)
    order = np.argsort(bwt, kind="stable")
    rank = np.empty(len(bwt), np.int64)
    rank[order] = np.arange(len(bwt))
    pos = np.arange(n)
    who, where, grp = [], [], []
    for j in range(1, int(size.max(initial=0)) + 1):  # from each document's end to its start
        act = np.flatnonzero(size >= j)
        pos[act] = n + rank[pos[act]]
        if j >= MATCH:
            who.append(act)
            where.append(size[act] - j)
            grp.append(group[pos[act]])
    z = [np.zeros(0, np.int64)]
    return np.concatenate(who or z), np.concatenate(where or z), np.concatenate(grp or z)


# ---------------------------------------------------------------- stages
def _find(b_n: int, d_n: int):
    """Texts to packed strands."""

    def send(parts: list):
        rec = np.concatenate(parts)
        first = _first_of(rec["same"], rec)
        out = _by_uid(_gone(rec[~first], rec["n"][~first].astype(np.int64) + MATCH - 1), d_n, K_GONE)
        rec = rec[first]
        spread = mix(rec["key"].astype(U64) + U64(1))
        by_key = np.sort(rec["key"])
        cut = np.flatnonzero(np.append(True, by_key[1:] != by_key[:-1])) if len(by_key) else np.zeros(0, np.int64)
        crowds = by_key[cut[np.diff(np.append(cut, len(by_key))) > CROWD_TASK]]
        crowd = np.isin(rec["key"], crowds)
        rec["kind"] = crowd
        marks = np.zeros(len(crowds), STRAND)
        marks["key"], marks["kind"] = crowds, 2
        rec = np.concatenate([rec, marks])
        where = np.concatenate([np.where(crowd, rec["same"][: len(crowd)], spread), mix(crowds.astype(U64) + U64(1))])
        out += [(b, K_STRAND, squeeze(rec[at])) for b, at in grouped(bucket_of(where, b_n))]
        return _rows(out)

    def run(batches):
        parts, held = [], 0
        for b in batches:
            data, off = string_buffers(b.column("text"))
            uids = b.column("uid").to_numpy()
            for who, base, d, o in row_blocks(uids, data, off):
                start, count, key, same, also, rel, left, right = strands(d, o)
                r = np.searchsorted(o, start, side="right") - 1
                rec = np.zeros(len(start), STRAND)
                rec["key"] = key >> U64(32)
                rec["same"] = mix(same ^ mix(key + count.astype(U64)))
                rec["also"] = also
                rec["uid"], rec["at"], rec["n"] = who[r], start - o[r] + base[r], count
                rec["rel"], rec["left"], rec["right"] = rel, left, right
                parts.append(rec)
                held += len(rec)
                if held >= FLUSH:
                    yield send(parts)
                    parts, held = [], 0
        if held:
            yield send(parts)

    return run


def _halves(rec: np.ndarray, key: np.ndarray, split: np.ndarray):
    """Strands without the half of their windows that no other strand of the anchor hash can
    equal, as its side differs from all others'; and whether any window is left."""
    n, rel = rec["n"].astype(np.int64), rec["rel"].astype(np.int64)
    before = np.clip(rel - SIDE, 0, n)  # windows of the left half

    def shared(side, has):
        own = mix(key ^ mix(rec[side].astype(U64) + U64(7)))
        own[~has] = mix(np.arange(int((~has).sum()), dtype=U64)) | U64(1)
        _, back, times = np.unique(own, return_inverse=True, return_counts=True)
        return has & (times[back] > 1)

    left, right = shared("left", before > 0) | split, shared("right", before < n) | split
    rec = rec.copy()
    rec["at"] += np.where(left, 0, before).astype(np.uint32)
    rec["n"] = np.where(left, np.where(right, n, before), np.where(right, n - before, 0))
    return rec, rec["n"] > 0


def _meet(d_n: int):
    """Packed strands to what goes at once and what the transform is asked about."""

    def run(batches):
        recs, n_key = [], []
        for b in batches:
            out = []
            for bucket, kind, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if kind == K_STRAND:
                    rec, _ = unsqueeze(x, STRAND)
                    recs.append(rec)
                    n_key.append(np.full(len(rec), bucket, np.int64))
                else:
                    out.append((bucket, kind, x))
            if out:
                yield _rows(out)
        if not recs:
            return
        rec, bucket = np.concatenate(recs), np.concatenate(n_key)
        mark = rec["kind"] == 2
        marked = np.unique(rec["key"][mark])
        rec, bucket = rec[~mark], bucket[~mark]
        first = _first_of(rec["same"], rec)
        out = _by_uid(_gone(rec[~first], rec["n"][~first].astype(np.int64) + MATCH - 1), d_n, K_GONE)
        rec, bucket = rec[first], bucket[first]
        plain = rec["kind"] == 0
        key = (bucket.astype(U64) << U64(32)) | rec["key"].astype(U64)
        _, back, n = np.unique(key[plain], return_inverse=True, return_counts=True)
        many = np.ones(len(rec), bool)
        split = ~plain
        many[plain] = n[back] > 1
        split[plain] = n[back] > CROWD
        hot = np.isin(rec["key"], marked)
        many |= hot
        split |= hot
        rec, key, split = rec[many], key[many], split[many]
        rec, keep = _halves(rec, key, split)
        rec, key, split = rec[keep], key[keep], split[keep]
        asked = np.empty(len(rec), ASKED)
        asked["uid"], asked["at"], asked["n"], asked["key"], asked["split"] = rec["uid"], rec["at"], rec["n"], key, split
        yield _rows(out + _by_uid(asked, d_n, K_ASKED))

    return run


def _texts_and(packed: DataFrame, rows: DataFrame, d_n: int, parts: int) -> DataFrame:
    """Rows of texts behind the packed records of their bucket, dealt by bucket."""
    texts = rows.select(F.pmod("uid", F.lit(d_n)).cast("int").alias("bucket"), F.lit(K_TEXT).alias("kind"), F.lit(None).cast("binary").alias("payload"), "uid", "doc_id", "text")
    nothing = packed.select("bucket", "kind", "payload", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    return nothing.unionByName(texts).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")


def _send_strands(b_n: int, d_n: int):
    """Texts with what is asked of them to packed windows and strands, by anchor hash, and to windows that go as
    an equal one of the same task comes first."""

    def flush(parts, texts):
        rec = np.concatenate(parts)
        one = np.flatnonzero(rec["len"] == 0)
        later = one[~_first_of(rec["key"][one], rec[one])]
        out = _by_uid(_joined(_gone(rec[later], np.full(len(later), MATCH))), d_n, K_GONE)
        stay = np.ones(len(rec), bool)
        stay[later] = False
        rec = rec[stay]
        whole = np.cumsum(rec["len"] > 0) - 1  # texts are those of whole strands, in their order
        for b, at in grouped(bucket_of(mix(rec["key"]), b_n)):
            out.append((b, K_SENT, squeeze(rec[at], b"".join(texts[i] for i in whole[at][rec["len"][at] > 0].tolist()))))
        return _rows(out)

    def run(batches):
        asked: dict[int, np.ndarray] = {}
        bucket = None
        parts, texts, held = [], [], 0
        for b in batches:
            for bk, kind, x, uid, _, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bk != bucket:
                    bucket, asked = bk, {}
                    pending: list[np.ndarray] = []
                if kind == K_ASKED:
                    pending.append(unsqueeze(x, ASKED)[0])
                    continue
                if kind != K_TEXT:
                    continue
                if pending:
                    rec = np.concatenate(pending)
                    rec = rec[np.argsort(rec["uid"], kind="stable")]
                    cut = np.flatnonzero(np.diff(rec["uid"])) + 1
                    asked = {int(p["uid"][0]): p for p in np.split(rec, cut)}
                    pending = []
                mine = asked.get(uid)
                if mine is None:
                    continue
                raw = text.encode("utf-8")
                whole = mine[mine["split"] == 0]
                rec = np.zeros(len(whole), SENT)
                rec["key"], rec["uid"], rec["at"], rec["len"] = whole["key"], uid, whole["at"], whole["n"] + np.uint8(MATCH - 1)
                parts.append(rec)
                texts += [raw[at : at + n] for at, n in zip(rec["at"].tolist(), rec["len"].tolist(), strict=True)]
                one = mine[mine["split"] == 1]
                if len(one):
                    n = one["n"].astype(np.int64)
                    first = np.repeat(one["at"].astype(np.int64) - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(int(n.sum()))
                    data = np.frombuffer(raw, np.uint8)
                    rec = np.zeros(len(first), SENT)
                    rec["key"] = span_hash(prefix_hash(BYTE_CODE[data]), first, first + MATCH) | U64(1)
                    rec["also"], rec["uid"], rec["at"] = other_digest(data, first, first + MATCH), uid, first
                    parts.append(rec)
                held += len(whole) + len(parts[-1])
                if held > 200_000:
                    yield flush(parts, texts)
                    parts, texts, held = [], [], 0
        if held:
            yield flush(parts, texts)

    return run


def _compare(d_n: int):
    """Packed windows and strands, by anchor hash, to what goes."""

    def later(uid, at, group):
        """Windows that are not the first of their group."""
        order = np.lexsort((at, uid, group))
        head = np.ones(len(order), bool)
        head[1:] = group[order][1:] != group[order][:-1]
        out = np.zeros(len(order), bool)
        out[order[~head]] = True
        return out

    def run(batches):
        recs, blobs = [], []
        for b in batches:
            gone = [x for x in zip(*(c.to_pylist() for c in b.columns), strict=True) if x[1] == K_GONE]
            if gone:
                yield _rows(gone)
            for x in b.filter(pc.equal(b.column("kind"), K_SENT)).column("payload").to_pylist():
                rec, blob = unsqueeze(x, SENT)
                recs.append(rec)
                blobs.append(blob)
        if not recs:
            return
        rec, blob = np.concatenate(recs), np.frombuffer(b"".join(blobs), np.uint8)
        place = np.append(0, np.cumsum(rec["len"].astype(np.int64)))[:-1]
        gone = []
        one = rec["len"] == 0
        if one.any():
            w = rec[one]
            order = np.lexsort((w["at"], w["uid"], w["also"], w["key"]))
            w = w[order]
            again = np.append(False, (w["key"][1:] == w["key"][:-1]) & (w["also"][1:] == w["also"][:-1]))
            gone.append(_joined(_gone(w[again], np.full(int(again.sum()), MATCH))))
        many = np.flatnonzero(~one)
        many = many[np.argsort(rec["key"][many], kind="stable")]
        keys = rec["key"][many]
        i = 0
        while i < len(many):
            j = min(i + COLLECTION, len(many))
            while j < len(many) and keys[j] == keys[j - 1]:
                j += 1
            at = many[i:j]
            who, off, group = equal_windows(blob, place[at], rec["len"][at].astype(np.int64))
            uid, pos = rec["uid"][at][who], rec["at"][at][who].astype(np.int64) + off
            out = later(uid, pos, group)
            w = np.empty(int(out.sum()), GONE)
            w["uid"], w["at"], w["len"] = uid[out], pos[out], MATCH
            gone.append(_joined(w))
            i = j
        yield _rows(_by_uid(np.concatenate(gone), d_n, K_GONE) if gone else [])

    return run


def _joined(w: np.ndarray) -> np.ndarray:
    """Spans of one document that touch or overlap, as one."""
    if not len(w):
        return w
    w = w[np.lexsort((w["at"], w["uid"]))]
    end = w["at"].astype(np.int64) + w["len"]
    new = np.ones(len(w), bool)
    new[1:] = w["uid"][1:] != w["uid"][:-1]
    base = np.cumsum(new)  # reach within the document: ends grow with the document's number
    reach = np.maximum.accumulate(end + (base << 34)) - (base << 34)
    new[1:] |= w["at"][1:] > reach[:-1]
    heads = np.flatnonzero(new)
    out = w[heads].copy()
    out["len"] = reach[np.append(heads[1:], len(w)) - 1] - out["at"]
    return out


_RESULT = "uid long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _cut(batches, kept: bool):
    """Texts behind the spans that go to the result's rows; with the kept bytes if asked."""
    gone: dict[int, np.ndarray] = {}
    bucket, pending = None, []
    for b in batches:
        rows = []
        for bk, kind, x, uid, doc, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if bk != bucket:
                bucket, gone, pending = bk, {}, []
            if kind == K_GONE:
                pending.append(unsqueeze(x, GONE)[0])
                continue
            if kind != K_TEXT:
                continue
            if pending:
                rec = _joined(np.concatenate(pending))
                cut = np.flatnonzero(np.diff(rec["uid"])) + 1
                gone = {int(p["uid"][0]): p for p in np.split(rec, cut)} if len(rec) else {}
                pending = []
            raw = text.encode("utf-8")
            mine = gone.get(uid)
            rest, removed, spans = raw, 0, 0
            if mine is not None:
                keep, at = [], 0
                for s, n in zip(mine["at"].tolist(), mine["len"].tolist(), strict=True):
                    keep.append(raw[at:s])
                    at = s + n
                    removed += n
                spans = len(mine)
                rest = b"".join([*keep, raw[at:]])
            rows.append((uid, doc, len(raw), removed, spans, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "ignore") if kept else None))
        cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
        arrays = [pa.array(c, pa.int64()) for c in cols[:5]] + [pa.array(cols[5], pa.string())]
        names = ["uid", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if kept:
            arrays.append(pa.array(cols[6], pa.string()))
            names.append("kept")
        yield pa.RecordBatch.from_arrays(arrays, names=names)


def remove_repeats(rows: DataFrame, scratch: Scratch, kept: bool = False) -> DataFrame:
    """(uid, doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of rows (uid, doc_id, text); kept is the
    rest as text, without the bytes of characters that were cut apart."""
    spark = rows.sparkSession
    small_batches(spark)
    _, size = text_bytes(rows)
    n_b = buckets_for(size)
    parts = partitions(spark, size)
    found = rows.select("uid", "text").mapInArrow(_find(n_b, n_b), _PACKED).repartition(parts, "bucket")
    met = scratch.keep(found.mapInArrow(_meet(n_b), _PACKED))
    asked = _texts_and(met.filter(F.col("kind") == K_ASKED), rows, n_b, parts)
    sent = asked.mapInArrow(_send_strands(n_b, n_b), _PACKED).repartition(parts, "bucket")
    compared = sent.mapInArrow(_compare(n_b), _PACKED)
    last = _texts_and(met.filter(F.col("kind") == K_GONE).unionByName(compared), rows, n_b, parts)
    return last.mapInArrow(lambda it: _cut(it, kept), _RESULT + (", kept string" if kept else ""))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "suffix-dedup")
    rows = with_uid(table(spark, sf_dir, "documents"), scratch)
    return remove_repeats(rows, scratch).drop("uid")
