"""N-gram Jaccard join by parity sketches.

A document's set is its distinct WORDS-word shingles. Two sets of sizes a and b with Jaccard
similarity of at least 0.8 differ in at most D = (a + b) // 9 shingles.

1. Equal sets are one class; its smallest document stands for it (a task sends a set once).
2. Pairs are met in bands of D. For a band with D <= d the shingles' hash range is cut into
   p = d + slack blocks and the hashes of a block are XORed into a sketch of 64 parity bits. The
   number of blocks whose sketches differ is at most the Hamming distance of the whole sketch,
   and that at most the symmetric difference. So p - d = slack blocks at least agree, and documents
   that share a block's sketch are candidates. A set takes part in each band that a partner's
   size can call for.
3. Of each block's documents, the smallest is tried first, best shared first; exact verification
   gives links, links give components. A near pair agrees in slack blocks, of which those that are
   empty in both say nothing, so it shares at least slack less the empty blocks of either. The
   blocks that two components share are counted, those of one pair of members are no more; where
   they reach this, one pair is tried. Only for components that are still apart then are pairs of
   members counted. Pairs that reach the bound are verified, and no link between components is lost.
4. A block whose documents are still in more than CROWD components is set aside, and a pair may
   then share one block less. A document whose empty and set-aside blocks reach the slack is
   loose: pairs with a document that isn't loose are found all the same, and pairs of two loose
   ones by a join on their rarest shingles.

Defined results: a null text, or one without words, has 0 shingles and is alone; fewer words than
WORDS make one shingle; repeated rows and equal ids are separate rows, linked as equal texts are;
an empty table gives an empty result; further columns are ignored."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, Scratch, bucket_of, buckets_for, by_bucket, components, distinct_sorted, grouped, mix, partitions, shingles_of, slices, small_batches, squeeze, string_buffers, sum_rows, table, text_bytes, unsqueeze, with_uid, words_of

WORDS = 5
CROWD = 8
BROADCAST_ROWS = 500_000  # ids of 8 bytes: a few MB; more are joined by a shuffle
CHUNK = 1 << 18
FLUSH = 400_000  # sketches a task holds before it sends them
CELLS = 1 << 20  # counts by which shingles are ranked: 4 MB, whatever the input
PAIRS = 1 << 18  # pairs a task holds before it counts and sends them
MAX_SEEN = 200_000  # sets a task remembers; beyond, a set is sent again and made one later
DEALT = 8e6  # bytes of text whose sketches a task is dealt

ENTRY = np.dtype([("key", "<u4"), ("sig", "<u4"), ("sig2", "<u2"), ("uid", "<i8"), ("band", "u1"), ("need", "u1")])
EDGE = np.dtype([("uid", "<i8"), ("pivot", "<i8"), ("n", "<u4")])
MEMBER = np.dtype([("gid", "<u8"), ("uid", "<i8"), ("comp", "<i8"), ("band", "u1"), ("need", "u1")])
LOOSE = np.dtype([("uid", "<i8")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8"), ("ca", "<i8"), ("cb", "<i8"), ("band", "<i4"), ("need", "<i4")])
NAMES = ["a", "b", "ca", "cb", "band", "n", "need"]
_PACKED = "bucket int, kind int, payload binary"
_ACROSS = "a long, b long, ca long, cb long, band int, n long, need int"
K_COMP, K_ENTRY, K_EDGE, K_MEMBER, K_LOOSE, K_PAIR = 0, 1, 2, 3, 4, 5


def bands() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least D, greatest D and blocks of each band; D from 1 on, each band wider by a quarter."""
    low = [1]
    while low[-1] < 1 << 40 and len(low) < 120:
        low.append(max(low[-1] + 1, int(low[-1] * 1.25)))
    a = np.array(low, np.int64)
    d = a[1:] - 1
    return a[:-1], d, d + np.ceil(0.2 * d).astype(np.int64) + 2


LOW, MOST, BLOCKS = bands()


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted arrays of distinct values have similarity 0.8."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 80 * (len(a) + len(b) - both) and both > 0


def _sets(data: np.ndarray, off: np.ndarray):
    """Distinct shingle hashes of each row, ascending, and offsets."""
    _, _, h, first = words_of(data, off)
    return distinct_sorted(*shingles_of(h, first, WORDS))


def _signature(v: np.ndarray, off: np.ndarray):
    """Two 64-bit digests of each row's set."""
    n = np.diff(off)
    a, b = np.zeros(len(n), U64), np.zeros(len(n), U64)
    at = np.flatnonzero(n)
    if len(at):
        a[at] = np.add.reduceat(mix(v + U64(11)), off[at])
        b[at] = np.bitwise_xor.reduceat(mix(v ^ U64(0x5555)), off[at])
    return a, b


def set_sizes(rows: DataFrame) -> DataFrame:
    """(uid, doc_id, n_shingles, s1, s2)."""

    def run(batches):
        for b in batches:
            data, off = string_buffers(b.column("text"))
            n, s1, s2 = (np.zeros(len(off) - 1, np.int64) for _ in range(3))
            for i, j in slices(off, CHUNK):
                v, o = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                x, y = _signature(v, o)
                n[i:j], s1[i:j], s2[i:j] = np.diff(o), x.view(np.int64), y.view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2)], names=["uid", "doc_id", "n_shingles", "s1", "s2"])

    return rows.mapInArrow(run, "uid long, doc_id long, n_shingles long, s1 long, s2 long")


def _rows(out: list):
    cols = list(zip(*out, strict=True)) if out else [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=["bucket", "kind", "payload"])


def block_sketches(v: np.ndarray, off: np.ndarray):
    """For the sets of some rows: (row, band, sketch, blocks that a near pair shares at least) of all
    blocks that aren't empty; and the rows whose empty blocks reach a band's slack."""
    n = np.diff(off)
    first = np.searchsorted(LOW, np.maximum(n // 5, 1), side="right") - 1
    last = np.searchsorted(LOW, n // 4, side="right") - 1  # below 0 where no other set can be near
    rows, tags, keys, needs, loose = [], [], [], [], []
    code = mix(v ^ U64(0xABCDEF))
    for t in range(int(first.min(initial=0)), int(last.max(initial=-1)) + 1):
        who = np.flatnonzero((first <= t) & (t <= last) & (n > 0))
        if not len(who):
            continue
        p = int(BLOCKS[t])
        sizes = n[who]
        upto = np.append(0, np.cumsum(sizes))
        at = np.repeat(off[who] - upto[:-1], sizes) + np.arange(upto[-1])
        block = ((v[at] >> U64(32)) * U64(p)) >> U64(32)
        new = np.ones(len(at), bool)
        new[1:] = block[1:] != block[:-1]
        new[upto[:-1]] = True
        heads = np.flatnonzero(new)
        sketch = np.bitwise_xor.reduceat(code[at], heads)
        r = who[np.searchsorted(upto, heads, side="right") - 1]
        rows.append(r)
        tags.append(np.full(len(r), t, np.uint8))
        keys.append(mix(sketch + mix(block[heads] + U64(t << 40))))
        need = int(p - MOST[t]) - (p - np.diff(np.searchsorted(heads, upto)))
        loose.append(who[need < 1])
        needs.append(np.repeat(np.clip(need, 1, 255), np.diff(np.searchsorted(heads, upto))).astype(np.uint8))
    z, zb = [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)]
    return np.concatenate(rows or z), np.concatenate(tags or zb), np.concatenate(keys or [np.zeros(0, U64)]), np.concatenate(needs or zb), np.concatenate(loose or z)


def _sketch(b_n: int):
    """Texts to packed sketches by bucket; each set once for a task."""

    def run(batches):
        seen: dict[tuple, int] = {}
        parts, held, loose = [], 0, []

        def send():
            rec = np.concatenate([p[0] for p in parts])
            where = np.concatenate([p[1] for p in parts])
            out = [(b, K_ENTRY, squeeze(rec[at])) for b, at in grouped(where)]
            if loose:
                out += [(0, K_LOOSE, squeeze(np.concatenate(loose)))]
            return _rows(out)

        for b in batches:
            data, off = string_buffers(b.column("text"))
            uids = b.column("uid").to_numpy()
            for i, j in slices(off, CHUNK):
                v, o = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                s1, s2 = _signature(v, o)
                keep = np.zeros(j - i, bool)
                for r in np.flatnonzero(np.diff(o) >= 4):
                    k = (int(s1[r]), int(s2[r]))
                    was = seen.get(k)
                    if was is None or uids[i + r] < was:  # a smaller document of a class seen before is sent too
                        seen[k] = int(uids[i + r])
                        keep[r] = True
                if len(seen) > MAX_SEEN:
                    seen.clear()
                n = np.where(keep, np.diff(o), 0)
                v = v[np.repeat(keep, np.diff(o))]
                o = np.append(0, np.cumsum(n))
                r, band, key, need, bad = block_sketches(v, o)
                rec = np.zeros(len(r), ENTRY)
                rec["key"], rec["uid"], rec["band"], rec["need"] = key & U64(0xFFFFFFFF), uids[i:j][r], band, need
                rec["sig"], rec["sig2"] = s1[r] & U64(0xFFFFFFFF), s2[r] & U64(0xFFFF)
                parts.append((rec, bucket_of(key, b_n)))
                held += len(rec)
                if len(bad):
                    x = np.zeros(len(bad), LOOSE)
                    x["uid"] = uids[i:j][bad]
                    loose.append(x)
                if held > FLUSH:
                    yield send()
                    parts, held, loose = [], 0, []
        if parts:
            yield send()

    return run


def _meet(b_n: int):
    """Packed sketches, a bucket at a time, to first trials and the members of shared blocks. A block's
    sketches are all in one bucket."""

    def run(batches):
        for bucket, rec, other in by_bucket(batches, ENTRY, K_ENTRY):
            if other:
                yield _rows(other)
            if len(rec):
                yield _met(bucket, rec, b_n)

    return run


def _met(bucket: int, rec: np.ndarray, b_n: int):
    s = np.sort(rec["key"])
    often = np.unique(s[1:][s[1:] == s[:-1]])
    rec = rec[np.isin(rec["key"], often)]
    if not len(rec):
        return _rows([])
    gid = (U64(bucket) << U64(32)) | rec["key"].astype(U64)
    sig = (rec["sig"].astype(U64) << U64(16)) | rec["sig2"].astype(U64)
    order = np.lexsort((rec["uid"], sig, gid))
    rec, gid, sig = rec[order], gid[order], sig[order]
    new = np.ones(len(rec), bool)  # a class's smallest document in each block
    new[1:] = (gid[1:] != gid[:-1]) | (sig[1:] != sig[:-1])
    rec, gid = rec[new], gid[new]
    heads = np.flatnonzero(np.append(True, gid[1:] != gid[:-1]))
    size = np.diff(np.append(heads, len(gid)))
    pivot = np.repeat(np.minimum.reduceat(rec["uid"], heads), size)
    size = np.repeat(size, size)
    e = (size > 1) & (rec["uid"] != pivot)
    pair = np.zeros(int(e.sum()), EDGE)
    pair["uid"], pair["pivot"] = rec["uid"][e], pivot[e]
    order = np.lexsort((pair["pivot"], pair["uid"]))
    pair = pair[order]
    first = np.flatnonzero(np.append(True, (pair["uid"][1:] != pair["uid"][:-1]) | (pair["pivot"][1:] != pair["pivot"][:-1]))) if len(pair) else np.zeros(0, np.int64)
    times = np.diff(np.append(first, len(pair)))
    pair = pair[first]
    pair["n"] = times
    shared = size > 1
    member = np.zeros(int(shared.sum()), MEMBER)
    member["gid"], member["uid"], member["band"], member["need"] = gid[shared], rec["uid"][shared], rec["band"][shared], rec["need"][shared]
    return _rows([(b, K_EDGE, squeeze(pair[at])) for b, at in grouped(pair["uid"] % b_n)] + [(b, K_MEMBER, squeeze(member[at])) for b, at in grouped(member["uid"] % b_n)])


def _best(batches):
    """Packed trials, a bucket of documents at a time, to the pivot that shares most blocks with each."""
    for _, rec, _ in by_bucket(batches, EDGE):
        rec = rec[np.lexsort((rec["pivot"], rec["uid"]))]
        head = np.flatnonzero(np.append(True, (rec["uid"][1:] != rec["uid"][:-1]) | (rec["pivot"][1:] != rec["pivot"][:-1])))
        n = np.add.reduceat(rec["n"].astype(np.int64), head)
        rec = rec[head]
        rec = rec[np.lexsort((rec["pivot"], -n, rec["uid"]))]
        top = np.append(True, rec["uid"][1:] != rec["uid"][:-1])
        yield pa.RecordBatch.from_arrays([pa.array(rec["uid"][top]), pa.array(rec["pivot"][top])], names=["a", "b"])


def _with_component(b_n: int, only: bool):
    """Components of a bucket's documents, then members of blocks, to members with components.
    Documents without one are their own, or left out if ``only`` holds."""

    def run(batches):
        bucket, uid, comp, known, done, held = None, [], [], None, [], 0

        def send(parts):
            rec = np.concatenate(parts)
            return _rows([(g, K_MEMBER, squeeze(rec[at])) for g, at in grouped(bucket_of(mix(rec["gid"]), b_n))])

        for b in batches:
            for bk, kind, x, u, c in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if bk != bucket:
                    bucket, uid, comp, known = bk, [], [], None
                if kind == K_COMP:
                    uid.append(u)
                    comp.append(c)
                    continue
                if known is None:
                    known = np.array(uid, np.int64), np.array(comp, np.int64)
                    order = np.argsort(known[0])
                    known = known[0][order], known[1][order]
                rec, _ = unsqueeze(x, MEMBER)
                rec["comp"] = rec["uid"]
                hit = np.zeros(len(rec), bool)
                if len(known[0]):
                    at = np.minimum(np.searchsorted(known[0], rec["uid"]), len(known[0]) - 1)
                    hit = known[0][at] == rec["uid"]
                    rec["comp"][hit] = known[1][at[hit]]
                done.append(rec[hit] if only else rec)
                held += len(done[-1])
            if held > FLUSH:
                yield send(done)
                done, held = [], 0
        if held:
            yield send(done)

    return run


def _pairs_of(rec: np.ndarray, new: np.ndarray, heads: np.ndarray, sizes: np.ndarray):
    """Places (i, j) of members of different components of a block, PAIRS or so at a time."""
    left, right, held = [], [], 0
    for s, n in zip(heads.tolist(), sizes.tolist(), strict=True):
        cut = [*np.flatnonzero(new[s : s + n]).tolist(), n]
        for k in range(len(cut) - 2):
            y = np.arange(s + cut[k + 1], s + n)
            step = max(1, PAIRS // len(y))
            for i in range(s + cut[k], s + cut[k + 1], step):
                x = np.arange(i, min(i + step, s + cut[k + 1]))
                left.append(np.repeat(x, len(y)))
                right.append(np.tile(y, len(x)))
                held += len(left[-1])
                if held > PAIRS:
                    yield np.concatenate(left), np.concatenate(right)
                    left, right, held = [], [], 0
    if held:
        yield np.concatenate(left), np.concatenate(right)


def _across(every: bool):
    """Members of blocks, by block, to pairs across components (a, b, their components ca < cb, band,
    blocks shared here, blocks needed at least); members of crowded blocks, with b null. Unless
    ``every`` holds, the smallest member of each component in a block stands for all of them, and
    for the least that any of them needs."""

    def run(batches):
        for _, rec, _ in by_bucket(batches, MEMBER):
            if len(rec):
                yield from pairs(rec)

    def pairs(rec):
        rec = rec[np.lexsort((rec["uid"], rec["comp"], rec["gid"]))]
        heads = np.flatnonzero(np.append(True, rec["gid"][1:] != rec["gid"][:-1]))
        new = np.append(True, (rec["gid"][1:] != rec["gid"][:-1]) | (rec["comp"][1:] != rec["comp"][:-1]))
        comps = np.add.reduceat(new.astype(np.int64), heads)
        sizes = np.diff(np.append(heads, len(rec)))
        if not every:
            lost = rec[np.repeat(comps > CROWD, sizes)]
            z = pa.nulls(len(lost), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(lost["uid"]), z, z, z, pa.array(lost["band"].astype(np.int32)), pa.array(np.ones(len(lost), np.int64)), pa.array(lost["need"].astype(np.int32))], names=NAMES)
            need = np.minimum.reduceat(rec["need"], np.flatnonzero(new))
            rec = rec[new]
            rec["need"] = need
            new, sizes = np.ones(len(rec), bool), comps
            heads = np.cumsum(comps) - comps
        open_ = (comps > 1) & (comps <= CROWD)
        for i, j in _pairs_of(rec, new, heads[open_], sizes[open_]):
            met = np.zeros(len(i), PAIR)
            met["a"], met["b"], met["ca"], met["cb"] = rec["uid"][i], rec["uid"][j], rec["comp"][i], rec["comp"][j]
            met["band"], met["need"] = rec["band"][i], np.maximum(rec["need"][i], rec["need"][j])
            met, n = np.unique(met, return_counts=True)
            cols = {f: pa.array(np.ascontiguousarray(met[f])) for f in PAIR.names} | {"n": pa.array(n.astype(np.int64))}
            yield pa.RecordBatch.from_arrays([cols[c] for c in NAMES], names=NAMES)

    return run


def _chosen(rows: DataFrame, uids: DataFrame) -> DataFrame:
    """Rows of some documents: their ids are broadcast if they are few enough."""
    n = uids.count()
    return rows.join(F.broadcast(uids) if n <= BROADCAST_ROWS else uids, "uid", "left_semi")


def _texts(rows: DataFrame) -> DataFrame:
    """(uid, x): each text, compressed; a half or a third of the bytes of its shingles' hashes."""

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            data, off = string_buffers(b.column("text"))
            out = [pack(data[s:e].tobytes()) for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(out, pa.binary())], names=["uid", "x"])

    return rows.select("uid", "text").mapInArrow(run, "uid long, x binary")


def _linked_texts(pairs: list) -> list:
    """Whether the sets of each pair of texts are linked; a text that comes again is read once."""
    at: dict[bytes, int] = {}
    where = [(at.setdefault(x, len(at)), at.setdefault(y, len(at))) for x, y in pairs]
    off = np.append(0, np.cumsum([len(x) for x in at])).astype(np.int64)
    v, o = _sets(np.frombuffer(b"".join(at), np.uint8), off)
    return [linked(v[o[i] : o[i + 1]], v[o[j] : o[j + 1]]) for i, j in where]


def verified(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the written pairs (a, b) whose sets are linked."""
    uids = scratch.keep(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct())
    texts = _texts(_chosen(rows, uids))
    one = texts.select(F.col("uid").alias("a"), F.col("x").alias("xa"))
    two = texts.select(F.col("uid").alias("b"), F.col("x").alias("xb"))

    def run(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            ok, todo, held = [], [], 0
            for x, y in zip(b.column("xa").to_pylist(), b.column("xb").to_pylist(), strict=True):
                todo.append((unpack(x), unpack(y)))
                held += len(todo[-1][0]) + len(todo[-1][1])
                if held > CHUNK:
                    ok += _linked_texts(todo)
                    todo, held = [], 0
            if todo:
                ok += _linked_texts(todo)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return scratch.keep(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long"))


def _cells(rows: DataFrame) -> np.ndarray:
    """How many sets' shingles fall into each of CELLS ranges of hashes."""

    def run(batches):
        total = np.zeros((CELLS, 1))
        for b in batches:
            data, off = string_buffers(b.column("text"))
            for i, j in slices(off, CHUNK):
                v, _ = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total[:, 0] += np.bincount((v & U64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        return total

    return sum_rows(rows.select("text"), run, 1, CELLS)[:, 0].astype(np.uint32)


def _rarest(rows: DataFrame, count: np.ndarray) -> DataFrame:
    """(uid, n, r, s): the n - ceil(0.8 n) + 1 shingles of each set that are first in the order of
    their cells' counts, then of their hashes, and their ranks r from 0; near sets share one of
    them. Without those alone in a cell."""

    def run(batches):
        for b in batches:
            data, off = string_buffers(b.column("text"))
            uids = b.column("uid").to_numpy()
            for i, j in slices(off, CHUNK):
                v, o = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                n = np.diff(o)
                row = np.repeat(np.arange(i, j), n)
                often = count[(v & U64(CELLS - 1)).astype(np.int64)]
                order = np.lexsort((v, often, row))
                rank = np.arange(len(v)) - np.repeat(o[:-1], n)
                kept = (rank <= np.repeat(n - (4 * n + 4) // 5, n)) & (often[order] > 1)
                order, rank = order[kept], rank[kept]
                yield pa.RecordBatch.from_arrays([pa.array(uids[row[order]]), pa.array(n[row[order] - i]), pa.array(rank), pa.array(v[order].view(np.int64))], names=["uid", "n", "r", "s"])

    return rows.select("uid", "text").mapInArrow(run, "uid long, n long, r long, s long")


def _loose_links(uids: DataFrame, rows: DataFrame, label: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after the links of loose documents. Of those that share a rare shingle, each first
    tries the smallest of a shingle that it shares most with; then the pairs that are
    still in different components are tried, so that copies don't make all their pairs. A near
    pair shares 4/9 of both sizes' sum at least, all from the rank of its first shared shingle on."""
    chosen = _chosen(rows, uids)
    kept = scratch.keep(_rarest(chosen, _cells(chosen)))
    least = kept.groupBy("s").agg(F.min("uid").alias("b"), F.count(F.lit(1)).alias("often")).filter("often > 1").select("s", "b")
    trials = kept.join(least, "s").filter("uid <> b").groupBy("uid", "b").agg(F.count(F.lit(1)).alias("k"))
    best = trials.groupBy("uid").agg(F.max(F.struct(F.col("k"), (-F.col("b")).alias("b"))).alias("m")).select(F.col("uid").alias("a"), (-F.col("m.b")).alias("b"))
    apart = _components_of(best, label).select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
    near = near_enough(scratch.keep(apart), rows, scratch)
    label = _joined(label, verified(near, rows, scratch), scratch)

    named = kept.join(label.select(F.col("node").alias("uid"), "component"), "uid", "left").withColumn("comp", F.coalesce("component", "uid")).drop("component")
    mixed = named.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("s")
    named = scratch.keep(named.join(mixed, "s", "left_semi"))
    scratch.drop(kept)
    x, y = (named.select("s", F.col("uid").alias(u), F.col("n").alias(f"n{u}"), (F.col("n") - F.col("r")).alias(f"m{u}"), F.col("comp").alias(f"c{u}")) for u in ("a", "b"))
    both = x.join(y, (x.s == y.s) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.least("ma", "mb") * 9 >= (F.col("na") + F.col("nb")) * 4))
    rest = near_enough(scratch.keep(both.select("a", "b").distinct()), rows, scratch)
    scratch.drop(named)
    return _joined(label, verified(rest, rows, scratch), scratch)


def _components_of(pairs: DataFrame, label: DataFrame) -> DataFrame:
    """Pairs (a, b, further columns) with components for documents, smaller first; none within one."""
    left = label.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    right = label.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    both = pairs.join(left, "a", "left").join(right, "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")}).filter("ca <> cb")
    keep = [c for c in pairs.columns if c not in ("a", "b")]
    return both.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), F.col("a").alias("one"), F.col("b").alias("other"), *keep)


def _joined(label: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """Labels after further links: only the components that these join are labelled anew."""
    apart = scratch.keep(_components_of(links, label).select("a", "b").distinct())
    if not apart.limit(1).count():
        return label
    top = components(apart, scratch)
    single = top.select("node").join(label, "node", "left_anti").withColumn("component", F.col("node"))
    far = top.select(F.col("node").alias("component"), F.col("component").alias("top"))
    return scratch.keep(label.unionByName(single).join(far, "component", "left").select("node", F.coalesce("top", "component").alias("component")))


def _by_component(across: DataFrame, crowded: DataFrame, rows: DataFrame, label: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Labels after one trial for two components, and the pairs (a, b) of components that are still
    apart and may hold a near pair: no two members share more blocks than their components do."""
    pairs = across.filter("b is not null")
    sums = pairs.groupBy("ca", "cb", "band").agg(F.sum("n").alias("n"), F.min("need").alias("need"))
    named = crowded.join(label.select(F.col("node").alias("uid"), "component"), "uid", "left").groupBy(F.coalesce("component", "uid").alias("of"), "in_band").agg(F.max("lost").alias("lost"))
    may = sums.join(named, (sums.ca == named.of) & (sums.band == named.in_band), "left").filter(F.col("n") >= F.col("need") - F.coalesce("lost", F.lit(0)))
    may = scratch.keep(may.select("ca", "cb").distinct())
    tried = pairs.join(may, ["ca", "cb"], "left_semi").groupBy("ca", "cb", "a", "b").agg(F.sum("n").alias("n"))
    tried = tried.groupBy("ca", "cb").agg(F.max(F.struct("n", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("t"))
    tried = scratch.keep(tried.select((-F.col("t.a")).alias("a"), (-F.col("t.b")).alias("b")).distinct())
    label = _joined(label, verified(near_enough(tried, rows, scratch), rows, scratch), scratch)
    still = _components_of(may.select(F.col("ca").alias("a"), F.col("cb").alias("b")), label)
    return label, scratch.keep(still.select("a", "b").distinct())


def _bit_sketches(rows: DataFrame) -> DataFrame:
    """(uid, n, bits): a parity sketch of each set, of the least power of two of bits from 8 bits
    for each shingle that a near set may differ in, 256 at least."""

    def run(batches):
        for b in batches:
            data, off = string_buffers(b.column("text"))
            n, bits = [], []
            for i, j in slices(off, CHUNK):
                v, o = _sets(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for s, e in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
                    m = max(256, 1 << (2 * (e - s) - 1).bit_length()) if e > s else 256
                    count = np.bincount((v[s:e] & U64(m - 1)).astype(np.int64), minlength=m)
                    n.append(e - s)
                    bits.append(np.packbits((count & 1).astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([b.column("uid"), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["uid", "n", "bits"])

    return rows.select("uid", "text").mapInArrow(run, "uid long, n long, bits binary")


def _fold(x: np.ndarray, size: int) -> np.ndarray:
    """A sketch of fewer bits: halves XORed."""
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def near_enough(pairs: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Those of the written pairs whose sketches' Hamming distance, which the symmetric difference
    can't be below, allows a link."""
    uids = scratch.keep(pairs.select(F.col("a").alias("uid")).union(pairs.select(F.col("b").alias("uid"))).distinct())
    bits = scratch.keep(_bit_sketches(_chosen(rows, uids)))

    def run(batches):
        for b in batches:
            ok = []
            for na, x, nb, y in zip(*(b.column(c).to_pylist() for c in ("na", "xa", "nb", "xb")), strict=True):
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                size = min(len(x), len(y))
                ok.append(int(np.bitwise_count(_fold(x, size) ^ _fold(y, size)).sum()) <= (na + nb) // 9)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    one = bits.select(F.col("uid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    two = bits.select(F.col("uid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))
    return scratch.keep(pairs.join(one, "a").join(two, "b").select("a", "b", "na", "xa", "nb", "xb").mapInArrow(run, "a long, b long"))


def jaccard_components(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(uid, doc_id, n_shingles, component) of rows (uid, doc_id, text); component is a uid."""
    spark = rows.sparkSession
    small_batches(spark)
    _, size = text_bytes(rows)
    n_b, parts = buckets_for(size), partitions(spark, size, DEALT)
    sizes = scratch.keep(set_sizes(rows))
    met = scratch.keep(rows.select("uid", "text").mapInArrow(_sketch(n_b), _PACKED).repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_meet(n_b), _PACKED))
    trials = scratch.keep(met.filter(F.col("kind") == K_EDGE).select("bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_best, "a long, b long"))
    links = verified(near_enough(trials, rows, scratch), rows, scratch)
    label = components(links, scratch)

    def blocks(comps: DataFrame, only: bool) -> DataFrame:
        """Members of shared blocks with their components, dealt by block."""
        comps = comps.select(F.pmod("node", F.lit(n_b)).cast("int").alias("bucket"), F.lit(K_COMP).alias("kind"), F.lit(None).cast("binary").alias("payload"), F.col("node").alias("uid"), F.col("component").alias("comp"))
        members = met.filter(F.col("kind") == K_MEMBER).select("bucket", "kind", "payload", F.lit(None).cast("long").alias("uid"), F.lit(None).cast("long").alias("comp"))
        placed = members.unionByName(comps).repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(_with_component(n_b, only), _PACKED)
        return placed.select("bucket", "payload").repartition(parts, "bucket").sortWithinPartitions("bucket")

    across = scratch.keep(blocks(label, False).mapInArrow(_across(False), _ACROSS))
    crowded = scratch.keep(across.filter("b is null").groupBy(F.col("a").alias("uid"), F.col("band").alias("in_band")).agg(F.sum("n").alias("lost"), F.max("need").alias("need_of")))
    label, still = _by_component(across, crowded, rows, label, scratch)
    scratch.drop(across)
    if still.limit(1).count():
        comps = still.select(F.col("a").alias("component")).union(still.select(F.col("b").alias("component"))).distinct()
        nodes = label.join(comps, "component", "left_semi").select("node", "component")
        alone = comps.select(F.col("component").alias("node"), "component").join(label, "node", "left_anti")
        every = blocks(nodes.unionByName(alone), True).mapInArrow(_across(True), _ACROSS).join(still.select(F.col("a").alias("ca"), F.col("b").alias("cb")), ["ca", "cb"], "left_semi")
        every = scratch.keep(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "band", "n", "need").groupBy("a", "b", "band").agg(F.sum("n").alias("n"), F.max("need").alias("need")))
        less = every.join(crowded, (every.a == crowded.uid) & (every.band == crowded.in_band), "left").filter(F.col("n") >= F.col("need") - F.coalesce("lost", F.lit(0)))
        more = near_enough(scratch.keep(less.select("a", "b").distinct()), rows, scratch)
        first = _components_of(more, label).groupBy("a", "b").agg(F.min(F.struct("one", "other")).alias("p")).select(F.col("p.one").alias("x"), F.col("p.other").alias("y"))
        first = scratch.keep(first.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        label = _joined(label, verified(first, rows, scratch), scratch)  # one pair for two components
        rest = _components_of(more, label).select(F.least("one", "other").alias("a"), F.greatest("one", "other").alias("b"))
        rest = scratch.keep(rest.join(first, ["a", "b"], "left_anti").distinct())
        if rest.limit(1).count():  # then all that are still apart
            label = _joined(label, verified(rest, rows, scratch), scratch)
        scratch.drop(every)

    def unpack(batches):
        for b in batches:
            for x in b.column("payload").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(unsqueeze(x, LOOSE)[0]["uid"])], names=["uid"])

    empty = met.filter(F.col("kind") == K_LOOSE).select("payload").mapInArrow(unpack, "uid long")
    loose = scratch.keep(empty.union(crowded.filter("lost >= need_of").select("uid")).distinct())
    scratch.drop(met)
    if loose.limit(1).count():
        label = _loose_links(loose, rows, label, scratch)
    # classes: equal sets share the smallest document, which alone was linked
    real = sizes.filter("n_shingles > 0")
    rep = real.groupBy("n_shingles", "s1", "s2").agg(F.min("uid").alias("rep"))
    rep = rep.join(label, rep.rep == label.node, "left").select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component"))
    out = real.join(rep, ["n_shingles", "s1", "s2"]).select("uid", "doc_id", "n_shingles", "component")
    return out.unionByName(sizes.filter("n_shingles = 0").select("uid", "doc_id", "n_shingles", F.col("uid").alias("component")))


def with_doc_ids(out: DataFrame) -> DataFrame:
    """component (a uid) as component_id (a doc_id)."""
    names = out.filter("uid = component").select(F.col("uid").alias("component"), F.col("doc_id").alias("component_id"))
    return out.join(names, "component").select("doc_id", "n_shingles", "component_id")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "jaccard")
    out = scratch.keep(jaccard_components(with_uid(table(spark, sf_dir, "documents"), scratch), scratch))
    return with_doc_ids(out)
