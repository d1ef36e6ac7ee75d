"""Long spans that stand verbatim in more than one record.

Every window of ``length`` characters belongs to its minimiser, the substring
of ``SEED`` characters with the smallest hash in it.  A run of consecutive
windows with one minimiser (a super-k-mer) travels as one packed string to the
bucket of the minimiser; the strings that a task sends to one bucket are
compressed together.  In the bucket equal strings are merged, minimisers that
occur in one record only are passed over, and the windows of the rest are
sorted: a window is shared when its group holds two records.  Groups are formed
by a hash and then compared character by character.  Characters are code
points; nothing is normalised.

Hot spots are taken apart before they travel.  Equal strings within a flush are
sent once, and when two records hold one, its stretch is known to be shared and
is reported there and then.  Minimisers are counted first; the windows of a
heavy one are routed by where the minimiser stands in the window (in steps of
``_STEP`` characters) and by the characters that all windows of such a step
have in common.  Equal windows agree in all of that and still meet, while
different surroundings part.  What is still heavy then, counted again with
equal strings merged, travels as single windows routed by all their characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 16
HEAVY = 300_000  # windows of one minimiser beyond which they are routed apart
_STEP = 32  # positions of a heavy minimiser that are routed together
_BITS = 20  # of a packed minimum for the position
_SEGMENT = 1 << 19  # windows of one text hashed at once
_CHUNK = 1 << 16  # characters hashed at once; arrays of so many stay in the cache of a core
_FLUSH = 1 << 26  # characters of packed strings per flush
_WINDOWS = 1 << 17  # windows sorted at once
_BUCKET = 8_000_000  # characters of text per bucket
_PARTITIONS = 10_000  # beyond so many buckets, several share a task

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_NONE = np.empty(0, np.uint64)
_SPOT = np.uint64((1 << _BITS) - 1)
_PACKED = pa.schema([("bucket", pa.int32()), ("meta", pa.binary()), ("packed", pa.binary())])
_COUNTS = pa.schema([("v", pa.int64()), ("n", pa.int64())])


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


@cache
def _codes() -> np.ndarray:
    """A mixed number for every code point."""
    x = np.arange(1, 0x110001, dtype=np.uint64) * _ODD[0]
    x ^= x >> np.uint64(29)
    x *= _ODD[1]
    x ^= x >> np.uint64(32)
    return x


@cache
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``2**bits`` powers of a number and of its inverse, modulo 2**64."""
    tables = []
    for base in (int(_ODD[3]), pow(int(_ODD[3]), -1, 1 << 64)):
        x = np.full(1 << bits, base, np.uint64)
        x[0] = 1
        tables.append(np.cumprod(x, dtype=np.uint64))
    return tables[0], tables[1]


def _sums(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first characters, each by its power, and the inverse powers: a difference by the inverse at its start hashes a substring of any size."""
    powers, inverse = _powers(max(len(points), 1 << 16).bit_length())
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(_codes().take(points) * powers[: len(points)], out=sums[1:])
    return sums, inverse


def _polynomial(h: np.ndarray, size: int, base: np.uint64) -> np.ndarray:
    """Hashes of all substrings of ``size`` elements, modulo 2**64; doubled up from single elements."""
    have = 1
    while have < size:
        step = min(have, size - have)
        h = h[:-step] * np.uint64(pow(int(base), step, 1 << 64)) + h[step:]
        have += step
    return h


def window_minimisers(points: np.ndarray, length: int) -> np.ndarray:
    """For every window the hash of its minimiser (44 bits) and the position of its first occurrence, packed; at most 2**20 points."""
    n = len(points) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    seed = min(SEED, length)
    h = _polynomial(_codes().take(points), seed, _ODD[2])
    h ^= h >> np.uint64(31)
    h *= _ODD[1]
    h ^= h >> np.uint64(30)
    h &= ~_SPOT
    h |= np.arange(len(h), dtype=np.uint64)
    span, have = length - seed + 1, 1
    while have < span:
        step = min(have, span - have)
        h = np.minimum(h[:-step], h[step:])
        have += step
    return h[:n]


def _segments(ids: list, texts: list[str], length: int) -> Iterator[tuple[int, int, str]]:
    """Record, offset and text of pieces with at most ``_SEGMENT`` windows; long texts are cut with an overlap."""
    for i, t in zip(ids, texts):
        for at in range(0, max(len(t) - length + 1, 0), _SEGMENT):
            yield i, at, t[at : at + _SEGMENT + length - 1] if len(t) > _SEGMENT else t


def _windows(texts: list[str], length: int) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts and the packed minimisers of all places in them; of each run of windows with one minimiser its text, place and windows.

    No text is shorter than ``length``.
    """
    joined = "".join(texts)
    lens = np.array([len(t) for t in texts], np.int64)
    packed = window_minimisers(_points(joined), length)
    begins = np.cumsum(lens) - lens
    stops = begins + lens - length + 1  # windows from there on reach into the next text
    turns = np.flatnonzero((packed[1:] ^ packed[:-1]) > _SPOT) + 1
    edges = np.sort(np.concatenate([begins, stops, turns]))
    n = np.diff(edges)
    edges = edges[:-1]
    owner = np.searchsorted(begins, edges, "right") - 1
    keep = (n > 0) & (edges < stops[owner])
    return joined, packed, owner[keep], edges[keep], n[keep]


def _chunks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Records, offsets and texts of about ``_CHUNK`` characters."""
    ids, offsets, texts, size = [], [], [], 0
    for batch in batches:
        for i, at, text in _segments(batch.column(0).to_pylist(), batch.column(1).to_pylist(), length):
            if size and size + len(text) > 1 << _BITS:
                yield ids, offsets, texts
                ids, offsets, texts, size = [], [], [], 0
            ids.append(i)
            offsets.append(at)
            texts.append(text)
            size += len(text)
            if size >= _CHUNK:
                yield ids, offsets, texts
                ids, offsets, texts, size = [], [], [], 0
    if texts:
        yield ids, offsets, texts


def _counts(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Windows per key."""
    order = np.argsort(key)
    first = np.flatnonzero(np.append(True, np.diff(key[order]) != 0))
    return pa.RecordBatch.from_arrays([pa.array(key[order][first].view(np.int64)), pa.array(np.add.reduceat(n[order].astype(np.int64), first))], schema=_COUNTS)


def _count(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Windows per minimiser, summed up per flush; as that of -1 the characters of the texts."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for _, _, texts in _chunks(batches, length):
        held.append((np.array([-1]).view(np.uint64), np.array([sum(map(len, texts))])))
        _, packed, _, at, n = _windows(texts, length)
        held.append((packed[at] >> np.uint64(_BITS), n))
        size += int(n.sum())
        if size >= _FLUSH:
            yield _counts(*map(np.concatenate, zip(*held)))
            held, size = [], 0
    if held:
        yield _counts(*map(np.concatenate, zip(*held)))


def _count_steps(batches: Iterator[pa.RecordBatch], length: int, heavy) -> Iterator[pa.RecordBatch]:
    """Windows per routing key of heavy minimisers, equal strings of a flush counted once."""
    held: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        key, n, ends = (np.concatenate([h[i] for h in held]) for i in range(3))
        once = np.unique(ends, return_index=True)[1]
        return _counts(key[once], n[once])

    for _, _, texts in _chunks(batches, length):
        n, key, ends = _runs(texts, length, *heavy.value)[3:]
        if hot := len(ends):
            held.append((key[-hot:], n[-hot:], ends))
            size += hot * length
        if size >= _FLUSH:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each of ``x`` is in the sorted ``known``."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _mix(key: np.ndarray) -> np.ndarray:
    key = key ^ (key >> np.uint64(29))
    key *= _ODD[3]
    return key ^ (key >> np.uint64(32))


def _runs(texts: list[str], length: int, heavy: np.ndarray, hotter: np.ndarray = _NONE) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of a chunk: the joined text, and of each run its text, position, windows and routing key.

    Runs of heavy minimisers come last; of those also a hash of key and characters.
    """
    joined, packed, owner, at, n = _windows(texts, length)
    v = packed[at] >> np.uint64(_BITS)
    hot = _among(v, heavy)
    key, ends = _mix(v * _ODD[0]), _NONE
    if hot.any():  # runs of heavy minimisers are cut into steps
        step = min(_STEP, length)
        run = np.repeat(np.flatnonzero(hot), n[hot])
        each = np.repeat(at[hot] - (np.cumsum(n[hot]) - n[hot]), n[hot]) + np.arange(len(run))
        spot = (packed[each] & _SPOT).astype(np.int64)
        block = (spot - each) // step
        cut = np.ones(len(each), bool)
        cut[1:] = (run[1:] != run[:-1]) | (spot[1:] != spot[:-1]) | (block[1:] != block[:-1])
        cut = np.flatnonzero(cut)
        m = np.diff(np.append(cut, len(each)))
        sums, inverse = _sums(_points(joined))

        def hashed(first: np.ndarray, size: int | np.ndarray) -> np.ndarray:
            return (sums[first + size] - sums[first]) * inverse[first]

        common = hashed(spot[cut] - block[cut] * step, length - step + 1)  # of the characters that all windows of a step have
        far_key = _mix(_mix(v[run[cut]] * _ODD[0]) ^ (common + block[cut].astype(np.uint64)))
        if (far := _among(far_key, hotter)).any():  # single windows by all their characters
            lone = np.zeros(len(each), bool)
            lone[cut] = True
            lone |= np.repeat(far, m)
            of = (np.cumsum(np.bincount(cut, minlength=len(each))) - 1)[lone]
            cut = np.flatnonzero(lone)
            m, far_key, far = np.where(far[of], 1, m[of]), far_key[of], far[of]
            far_key[far] = _mix(hashed(each[cut[far]], length))
        ends = _mix(far_key ^ _mix(hashed(each[cut], length + m - 1)))
        owner, at = np.concatenate([owner[~hot], owner[run[cut]]]), np.concatenate([at[~hot], each[cut]])
        n, key = np.concatenate([n[~hot], m]), np.concatenate([key[~hot], far_key])
    return joined, owner, at, n, key, ends


def _union(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping or touching intervals of one record made one."""
    if not len(doc):
        return doc, a, b
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    first = np.ones(len(doc), bool)
    first[1:] = doc[1:] != doc[:-1]
    lift = np.cumsum(first) << 32  # keeps the running maximum of one record apart from the next
    reach = np.maximum.accumulate(b + lift)
    first[1:] |= a[1:] + lift[1:] > reach[:-1]
    at = np.flatnonzero(first)
    return doc[at], a[at], (reach - lift)[np.append(at[1:], len(doc)) - 1]


def _pack(batches: Iterator[pa.RecordBatch], length: int, buckets: int, heavy) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=3)
    held: list[tuple] = []
    held_chars = 0

    def flush() -> pa.RecordBatch:
        docs, starts, ns, keys = (np.concatenate([h[i] for h in held]) for i in (1, 2, 4, 5))
        where = np.concatenate([np.full(len(h[1]), i) for i, h in enumerate(held)])
        ats = np.concatenate([h[3] for h in held])
        own = (keys % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(own, kind="stable")
        names, metas, packs, shared = [], [], [], []
        for part in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            number: dict[str, int] = {}
            sid = np.array([number.setdefault(held[w][0][a : a + n + length - 1], len(number)) for w, a, n in zip(where[part].tolist(), ats[part].tolist(), ns[part].tolist())])
            line = np.argsort(sid, kind="stable")
            first = np.flatnonzero(np.diff(sid[line], prepend=-1))
            d, s = docs[part], starts[part]
            low, high = np.minimum.reduceat(d[line], first), np.maximum.reduceat(d[line], first)
            known = (low != high)[sid]  # in two records already: shared from end to end
            if known.any():
                shared.append((d[known], s[known], s[known] + ns[part][known] + length - 1))
            keep = ~known
            keep[line[first]] = True
            e = np.flatnonzero(keep)
            told = known[e]
            meta = b"".join([
                np.array([len(e), len(number)], np.int64).tobytes(), np.diff(np.where(told, low[sid[e]], d[e]), prepend=0).astype(np.int64).tobytes(),
                np.where(told, high[sid[e]] - low[sid[e]], 0).astype(np.int64).tobytes(), np.where(told, -1, s[e]).astype(np.int32).tobytes(), sid[e].astype(np.int32).tobytes(),
                (keys[part][line[first]] >> np.uint64(32)).astype(np.uint32).tobytes(), ns[part][line[first]].astype(np.int32).tobytes(),
            ])
            names.append(int(own[part[0]]))
            metas.append(squeeze.compress(meta))
            packs.append(squeeze.compress("".join(number).encode("utf-8", "surrogatepass")))
        if shared:
            doc, a, b = _union(*(np.concatenate([x[i] for x in shared]) for i in range(3)))
            names.append(int(keys[0] % np.uint64(buckets)))
            metas.append(squeeze.compress(np.concatenate([np.diff(doc, prepend=0), a, b]).astype(np.int64).tobytes()))
            packs.append(None)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(metas, pa.binary()), pa.array(packs, pa.binary())], schema=_PACKED)

    for ids, offsets, texts in _chunks(batches, length):
        joined, owner, at, n, key, _ = _runs(texts, length, *heavy.value)
        lens = np.array([len(t) for t in texts], np.int64)
        start = at - (np.cumsum(lens) - lens)[owner] + np.array(offsets, np.int64)[owner]
        held.append((joined, np.array(ids, np.int64)[owner], start, at, n, key))
        held_chars += int(n.sum()) + len(n) * (length - 1)
        if held_chars >= _FLUSH:
            yield flush()
            held, held_chars = [], 0
    if held_chars:
        yield flush()


def _equal(points: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the windows at ``a`` and ``b`` agree in all characters."""
    out = np.empty(len(a), bool)
    reach = np.arange(length)
    for lo in range(0, len(a), 4096):
        part = slice(lo, lo + 4096)
        out[part] = (points[a[part, None] + reach] == points[b[part, None] + reach]).all(1)
    return out


def _hashes(points: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the windows at ``at``, which ascends; by blocks that stay in the cache of a core."""
    out = np.empty(len(at), np.uint64)
    block = max(1 << 15, 4 * length)
    for lo in range(0, len(points) - length + 1, block):
        sums, inverse = _sums(points[lo : lo + block + length - 1])
        h = sums[length:] - sums[:-length]
        h *= inverse[: len(h)]
        i, j = np.searchsorted(at, (lo, lo + block))
        out[i:j] = h[at[i:j] - lo]
    return out


def _groups(points: np.ndarray, at: np.ndarray, owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows that have equals, in groups, and where each group starts; two are in one group if and only if they agree in all characters.

    Windows of one hash are compared with the first of them.  After a window
    that is equal to its first, the next one of the same string differs from
    the next one there in the last character or not at all, so whole
    comparisons are made where a match begins only.
    """
    h = _hashes(points, at, length)
    low = np.uint64((1 << len(h).bit_length()) - 1)  # bits that give way to the window, so that numbers alone are sorted
    h &= ~low
    h |= np.arange(len(h), dtype=np.uint64)
    h.sort()
    new = np.ones(len(h) + 1, bool)
    np.greater(h[1:] ^ h[:-1], low, out=new[1:-1])
    several = ~(new[1:] & new[:-1])
    order, new = (h[several] & low).astype(np.int64), new[:-1][several]
    starts = np.flatnonzero(new)
    first = np.repeat(order[starts], np.diff(np.append(starts, len(order))))
    lead = np.full(len(h), -2)
    lead[order] = first
    i, f = order[~new], first[~new]
    follows = (lead[i - 1] == f - 1) & (owner[i - 1] == owner[i]) & (owner[f - 1] == owner[f])
    tail, whole = at[i[follows]] + length - 1, ~follows
    if (points[tail] == points[at[f[follows]] + length - 1]).all() and _equal(points, at[i[whole]], at[f[whole]], length).all():
        return order, starts
    # different windows have one hash: these groups are told apart by the characters themselves
    clash = np.isin(first, f[~_equal(points, at[i], at[f], length)])
    number: dict[bytes, int] = {}
    for j in np.flatnonzero(clash).tolist():
        a = at[order[j]]
        first[j] = number.setdefault(points[a : a + length].tobytes(), order[j])
    line = np.argsort(first)
    return order[line], np.flatnonzero(np.append(True, np.diff(first[line]) != 0))


def _shared_windows(pieces: list[str], low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (string, first, after the last) of windows that occur in two records; low and high: records holding a string."""
    counts = np.array([len(p) for p in pieces], np.int64) - (length - 1)
    ends = np.cumsum(counts)
    n = int(ends[-1])
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), counts)
    at = np.arange(n) + owner.astype(np.int64) * (length - 1)
    order, starts = _groups(_points("".join(pieces)), at, owner, length)
    flags = np.repeat(low != high, counts)
    if len(order):
        by = owner[order]
        lo, hi = np.minimum.reduceat(low[by], starts), np.maximum.reduceat(high[by], starts)
        flags[order] = np.repeat(lo != hi, np.diff(np.append(starts, len(order))))
    opens, closes = flags.copy(), flags.copy()
    opens[1:] &= ~flags[:-1]
    closes[:-1] &= ~flags[1:]
    opens[ends - counts], closes[ends - 1] = flags[ends - counts], flags[ends - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    base = (ends - counts)[owner[first]]
    return owner[first], first - base, last + 1 - base


def _solve(rows: list[tuple[bytes, bytes]], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Shared intervals (record, from, to) of one bucket."""
    unpack = zstandard.ZstdDecompressor()
    docs, gaps, starts, sids, keys, ns, source = [], [], [], [], [], [], []
    n_strings = 0
    for i, (meta, _) in enumerate(rows):
        raw = unpack.decompress(meta)
        e, s = np.frombuffer(raw, np.int64, 2).tolist()
        docs.append(np.cumsum(np.frombuffer(raw, np.int64, e, 16)))
        gaps.append(np.frombuffer(raw, np.int64, e, 16 + 8 * e))
        starts.append(np.frombuffer(raw, np.int32, e, 16 + 16 * e))
        sids.append(np.frombuffer(raw, np.int32, e, 16 + 20 * e).astype(np.int64) + n_strings)
        keys.append(np.frombuffer(raw, np.uint32, s, 16 + 24 * e))
        ns.append(np.frombuffer(raw, np.int32, s, 16 + 24 * e + 4 * s))
        source.append(np.full(s, i))
        n_strings += s
    doc, gap, start, sid, key = (np.concatenate(x) for x in (docs, gaps, starts, sids, keys))
    size = [n.astype(np.int64) + length - 1 for n in ns]
    off, size, src = np.concatenate([np.cumsum(s) - s for s in size]), np.concatenate(size), np.concatenate(source)
    # the least and the greatest record that holds each string; every string has an entry
    line = np.argsort(sid, kind="stable")
    first = np.flatnonzero(np.diff(sid[line], prepend=-1))
    low, high = np.minimum.reduceat(doc[line], first), np.maximum.reduceat((doc + gap)[line], first)
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order].astype(np.int64), prepend=-1))
    several = np.minimum.reduceat(low[order], cuts) != np.maximum.reduceat(high[order], cuts)
    wanted = order[np.repeat(several, np.diff(np.append(cuts, len(order))))]  # grouped by key
    if not len(wanted):
        return
    # equal strings of different flushes are merged
    number: dict[str, int] = {}
    piece_of = np.full(n_strings, -1, np.int64)
    keep = np.zeros(n_strings, bool)
    keep[wanted] = True
    for i, (_, packed) in enumerate(rows):
        mine = np.flatnonzero(keep & (src == i))
        if not len(mine):
            continue
        text = unpack.decompress(packed).decode("utf-8", "surrogatepass")
        piece_of[mine] = [number.setdefault(text[a:b], len(number)) for a, b in zip(off[mine].tolist(), (off[mine] + size[mine]).tolist())]
    pieces = list(number)
    number.clear()
    by_piece = wanted[np.argsort(piece_of[wanted], kind="stable")]
    first = np.flatnonzero(np.diff(piece_of[by_piece], prepend=-1))
    low, high = np.minimum.reduceat(low[by_piece], first), np.maximum.reduceat(high[by_piece], first)
    # the occurrences of a piece whose stretches are not reported yet
    entry = np.flatnonzero((start >= 0) & (piece_of[sid] >= 0))
    entry = entry[np.argsort(piece_of[sid[entry]], kind="stable")]
    occurs = np.bincount(piece_of[sid[entry]], minlength=len(pieces))
    begin = np.cumsum(occurs) - occurs
    # strings of one key stay together in a sort
    key_of = key[by_piece[first]]

    def intervals(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        piece, a, b = _shared_windows([pieces[g] for g in ids.tolist()], low[ids], high[ids], length)
        g = ids[piece]
        each = np.repeat(np.arange(len(g)), occurs[g])
        nth = np.arange(len(each)) - np.repeat(np.cumsum(occurs[g]) - occurs[g], occurs[g])
        at = entry[begin[g][each] + nth]
        base = start[at].astype(np.int64)
        return doc[at], base + a[each], base + b[each] + length - 1

    line = np.argsort(key_of, kind="stable")
    windows = np.cumsum(size[by_piece[first]][line] - length + 1)
    last = np.flatnonzero(np.append(np.diff(key_of[line].astype(np.int64)) != 0, True))  # ends of keys
    done = 0
    for at in last.tolist():
        nxt = last[min(np.searchsorted(last, at + 1), len(last) - 1)]
        if at == last[-1] or windows[nxt] - (windows[done - 1] if done else 0) > _WINDOWS:
            yield intervals(line[done : at + 1])
            done = at + 1


def _buckets(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[bytes, bytes]] = []
    current = None
    unpack = zstandard.ZstdDecompressor()

    def batch_of(doc, a, b) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (doc, a, b)], ["doc_id", "a", "b"])

    def solved() -> Iterator[pa.RecordBatch]:
        found = list(_solve(held, length))
        if found:
            yield batch_of(*_union(*(np.concatenate([f[i] for f in found]) for i in range(3))))

    for batch in batches:
        for bucket, meta, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
            if packed is None:  # reported on the way
                doc, a, b = np.frombuffer(unpack.decompress(meta), np.int64).reshape(3, -1)
                yield batch_of(np.cumsum(doc), a, b)
                continue
            if bucket != current and held:
                yield from solved()
                held = []
            current = bucket
            held.append((meta, packed))
    if held:
        yield from solved()


def shared_spans(docs: DataFrame, record: str, text: str, length: int = 160, heavy: int = HEAVY) -> DataFrame:
    """``doc_id``, ``span_start`` (from 0) and ``span_chars``: the maximal stretches covered by shared windows.

    Records without an id or with a null text, or with a text shorter than
    ``length``, share nothing.  Repeats inside one record do not count; rows
    that agree in the id are one record.  Copies are compared like any other
    text; other columns are ignored, and an empty table gives no rows.
    Minimisers of more than ``heavy`` windows are routed apart; this decides
    where windows meet and not what comes out.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(record).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where(F.col("doc_id").isNotNull() & (F.length("text") >= length))

    def beyond(counts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The greatest counts of more than ``least``, at most 2**20 of them, by key."""
        found = counts.groupBy("v").agg(F.sum("n").alias("n")).where((F.col("n") > least) | (F.col("v") == -1)).orderBy(F.desc("n"), "v").limit((1 << 20) + 1).toPandas()
        key, n = found["v"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
        order = np.argsort(key)
        return key[order], n[order]

    lot, n = beyond(rows.mapInArrow(lambda it: _count(it, length), "v bigint, n bigint"), heavy)
    told = lot == np.array([-1]).view(np.uint64)
    total = int(n[told].sum())
    least = max(heavy, total >> 20)  # fewer than 2**20 keys have more
    lot, far = lot[~told & (n > least)], _NONE
    if len(lot):
        first = spark.sparkContext.broadcast((lot,))
        far = beyond(rows.mapInArrow(lambda it: _count_steps(it, length, first), "v bigint, n bigint"), least)[0]
    lots = spark.sparkContext.broadcast((lot, far))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), ceil(total / _BUCKET))
    packed = rows.mapInArrow(lambda it: _pack(it, length, buckets, lots), "bucket int, meta binary, packed binary")
    tasks = min(buckets, _PARTITIONS)
    found = (
        packed.repartitionById(tasks, F.pmod(F.col("bucket"), F.lit(tasks))).sortWithinPartitions("bucket")
        .mapInArrow(lambda it: _buckets(it, length), "doc_id bigint, a bigint, b bigint")
    )
    ordered = Window.partitionBy("doc_id").orderBy("a", "b")
    reach = F.max("b").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    islands = found.withColumn("new", F.coalesce(F.col("a") > reach, F.lit(True)).cast("int"))
    islands = islands.withColumn("island", F.sum("new").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("doc_id", "island").agg(F.min("a").alias("span_start"), (F.max("b") - F.min("a")).alias("span_chars")).drop("island")


def shared_chars(spans: DataFrame) -> DataFrame:
    """``doc_id`` and ``shared_chars``, for records that share anything."""
    return spans.groupBy("doc_id").agg(F.sum("span_chars").alias("shared_chars"))
