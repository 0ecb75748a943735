"""Repeated byte strings across documents, by a merge sort of suffix runs.

Of every 50-byte string (``length``) that starts in several documents, the
document with the smallest id keeps it; all others lose the bytes it covers.

Only suffixes that can matter are sorted. In each 50-byte window the 16-byte
strings with the smallest hash are anchors: equal windows have the same
anchors, so two documents that share a window share an anchor in it.

1. Copies. Documents with equal texts are one text, of the smallest id; the
   other copies are covered from end to end and need no further work.
2. Anchors. Each task passes on its anchors' hashes as sorted blocks, dealt by
   hash; the anchors found under two ids or more come back, dealt by text. An
   anchor that a block has under two ids itself is decided there: only its hash
   is passed on, so that a passage in a third of all texts makes one row a
   block.
3. Runs. Each task takes the suffix at each such anchor (the 50 bytes from it,
   and the 34 before it), sorts them, and passes them on as front-coded runs:
   for each suffix the length of the prefix that it shares with the one before
   and the rest of it. Where a run has the same bytes several times, all but
   the smallest id lose them at once, and the run holds that one only.
4. Merge. A task merges the runs of its part with a loser tree that keeps, for
   each run, the prefix known to be shared with the last suffix put out: the
   longer one wins without a look at the bytes, and of two equal ones only what
   follows is compared. The merged order gives the common prefixes of
   neighbours, hence the classes of equal right parts of any length; a sort
   of the parts before gives the classes of equal left parts; a
   window is a pair of both classes, and the smallest id of each pair decides.
5. Spans. The covered spans come back to their text, are united and cut out.

All comparisons of windows are exact; the hashes only choose anchors and parts.
Where a text repeats a few bytes over and over (a line of dashes), each place
is an anchor of the same hash: such a stretch is passed on as one place with a
distance and a number, and its inner suffixes, which are all the same, as one.
Each text crosses the network once and is read from there in each step.

Defined results
* a null text is empty; a text of fewer than 50 bytes loses nothing;
* equal ids are not smaller than each other: documents that share an id take
  nothing from each other; a null id is larger than all others;
* repeated rows are returned as often as they occur;
* whole texts count, however long; other columns of the input are not looked at, whatever their names;
* an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import materialize

from . import common

LENGTH = 50
ANCHOR = 16
#: Bytes of text whose anchors are sought at a time; anchors and suffixes in a run.
PIECE, RUN_ANCHORS, RUN_SUFFIXES = 1 << 18, 1 << 20, 1 << 17
#: Bytes of text for each part that suffixes are dealt to.
PART_BYTES = 16 * 1024 * 1024
#: Texts that occur more than once (about 100 bytes each) are broadcast up to this number, counted first.
BROADCAST_COPIED = 1_000_000
LAST = 0x7FFFFFFFFFFFFFFF
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _planes(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Non-negative integers as 16-bit planes, the lowest first; the upper ones are mostly zero and compress to nothing."""
    out, rest = [], x.astype(np.uint64)
    while not out or rest.any():
        out.append((rest & np.uint64(0xFFFF)).astype(np.uint16))
        rest = rest >> np.uint64(16)
    return tuple(out)


def _joined(planes) -> np.ndarray:
    out = np.zeros(len(planes[0]), dtype=np.uint64)
    for i, p in enumerate(planes):
        out |= p.astype(np.uint64) << np.uint64(16 * i)
    return out.astype(np.int64)


def _pack(*arrays) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(arrays, protocol=5))


def _unpack(blob: bytes):
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(blob))  # noqa: S301 - our own tasks wrote it


def _sliding(x: np.ndarray, n: int, best) -> np.ndarray:
    """best over each n consecutive values."""
    width = 1
    while width * 2 <= n:
        x = best(x[:-width], x[width:])
        width *= 2
    return best(x[: len(x) - (n - width)], x[n - width :]) if n > width else x


def anchors(data: np.ndarray, ends: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all windows of ``data`` that don't cross one of ``ends``."""
    n, w = len(data), length - anchor + 1
    none = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    if n < length:
        return none
    valid = np.ones(n - length + 1, dtype=bool)
    for end in ends:  # a window that starts fewer than ``length`` bytes before an end crosses it
        valid[max(0, int(end) - length + 1) : int(end)] = False
    if not valid.any():
        return none
    x = data.astype(np.uint64)
    x = (x[:-1] << np.uint64(8)) | x[1:]
    x = (x[:-2] << np.uint64(16)) | x[2:]
    x = (x[:-4] << np.uint64(32)) | x[4:]
    h = (x[: n - anchor + 1] * _M1) ^ ((x[anchor - 8 : n - 7] + _M3) * _M2)
    h ^= h >> np.uint64(32)
    h *= _M3
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)  # never 0
    least = _sliding(h, w, np.minimum)[: len(valid)]
    least = np.where(valid, least, np.uint64(0))
    pad = np.zeros(w - 1, dtype=np.uint64)
    most = _sliding(np.concatenate((pad, least, pad)), w, np.maximum)[: len(h)]
    places = np.flatnonzero(most == h)
    return places, h[places]


#: A place, and in its upper bits how often the same anchor comes again, each time ``stride`` bytes further on.
PLACE_BITS, STRIDE_BITS = 31, 6


def _runs_of_places(h: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors in the order of their texts and places, those of equal hashes at equal distances of a text as one."""
    if len(h) < 2:
        return h, doc, place
    gap = np.diff(place)
    same = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1]) & (gap > 0) & (gap < 1 << STRIDE_BITS)
    begins = np.concatenate(([True], ~same))
    begins[2:] |= same[1:] & same[:-1] & (gap[1:] != gap[:-1])
    first = np.flatnonzero(begins)
    again = np.diff(np.append(first, len(h))) - 1
    stride = np.where(again > 0, gap[np.minimum(first, len(gap) - 1)], 0)
    return h[first], doc[first], place[first] | stride << PLACE_BITS | again << PLACE_BITS + STRIDE_BITS


def _suffixes(text: bytes, packed: int, length: int) -> Iterator[tuple[int, int]]:
    """(place, extent) of a run of anchors: where a stretch repeats itself byte by byte, the places whose surroundings
    are all the same are one place, whose extent is the distance to the last of them."""
    place, stride, again = packed & (1 << PLACE_BITS) - 1, packed >> PLACE_BITS & (1 << STRIDE_BITS) - 1, packed >> PLACE_BITS + STRIDE_BITS
    left, end = length - ANCHOR, place + again * stride + ANCHOR
    low = high = 0
    if again * stride > 2 * length:
        low, high = -(-left // stride), (end - length - place) // stride
        stretch = np.frombuffer(text, dtype=np.uint8, count=end - place, offset=place)
        if high <= low or not np.array_equal(stretch[stride:], stretch[:-stride]):
            low = high = 0
    j = 0
    while j <= again:
        if j == low and high > low:
            yield place + low * stride, (high - low) * stride
            j = high + 1
        else:
            yield place + j * stride, 0
            j += 1


def _dealt_by_text(ordinal: np.ndarray, tid: np.ndarray, place: np.ndarray, parts: int) -> list[tuple[int, bytes]]:
    """(part, block): places by text."""
    if not len(ordinal):
        return []
    part = ((tid.view(np.uint64) * _M1) >> np.uint64(33)).astype(np.int64) % parts
    order = np.lexsort((place, tid, ordinal, part))
    ordinal, tid, place, part = ordinal[order], tid[order], place[order], part[order]
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    out = []
    for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
        begin = np.flatnonzero(np.concatenate(([True], (ordinal[a + 1 : b] != ordinal[a : b - 1]) | (tid[a + 1 : b] != tid[a : b - 1]))))
        sizes = np.diff(np.append(begin, b - a))
        out.append((int(part[a]), _pack(ordinal[a:b][begin], tid[a:b][begin], _planes(sizes), _planes(place[a:b]))))
    return out


def _anchor_blocks(parts: int, length: int):
    """Rows (part, block, decided): sorted anchor hashes with text and place, and those that are known to be shared."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        orders: list[int] = []
        tids: list[int] = []
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> pd.DataFrame:
            nonlocal count
            h, doc, place = (np.concatenate(x) for x in zip(*found, strict=True))
            part = (h % np.uint64(parts)).astype(np.int64)
            h >>= np.uint64(24)  # 40 bits tell the million or so anchors of a part from each other; windows are compared exactly later
            order = np.lexsort((h, part))
            h, doc, place, part = h[order], doc[order], place[order], part[order]
            ordinals, ids = np.array(orders, dtype=np.int64), np.array(tids, dtype=np.int64)
            first = np.concatenate(([True], (h[1:] != h[:-1]) | (part[1:] != part[:-1])))
            begin = np.flatnonzero(first)
            apart = np.minimum.reduceat(ordinals[doc], begin) != np.maximum.reduceat(ordinals[doc], begin)
            here = np.repeat(apart, np.diff(np.append(begin, len(h))))  # decided here: two ids have it
            rows = [(p, blob, True) for p, blob in _dealt_by_text(ordinals[doc[here]], ids[doc[here]], place[here], parts)]
            starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
            for a, b in zip(starts, np.append(starts[1:], len(part)), strict=True):
                known, mine = h[a:b][first[a:b] & here[a:b]], ~here[a:b]
                used, local = np.unique(doc[a:b][mine], return_inverse=True)
                block = _pack(_planes(np.diff(h[a:b][mine], prepend=np.uint64(0))), _planes(local), _planes(place[a:b][mine]), ordinals[used], ids[used], _planes(np.diff(known, prepend=np.uint64(0))))
                rows.append((int(part[a]), block, False))
            found.clear()
            orders.clear()
            tids.clear()
            count = 0
            return pd.DataFrame(rows, columns=["part", "block", "decided"])

        for batch in batches:
            group: list[bytes] = []
            first = len(orders)
            size = 0

            def take(texts: list[bytes], docs: list[int], offset: int = 0) -> None:
                nonlocal count
                data = np.frombuffer(b"".join(texts), dtype=np.uint8)
                ends = np.cumsum([len(t) for t in texts])
                places, h = anchors(data, ends, length)
                if len(places):
                    which = np.searchsorted(ends, places, side="right")
                    starts = np.concatenate(([0], ends[:-1]))
                    found.append(_runs_of_places(h, np.array(docs, dtype=np.int64)[which], places - starts[which] + offset))
                    count += len(found[-1][0])

            for text, ordinal, tid in zip(batch["text"], batch["ord"], batch["tid"], strict=True):
                text = bytes(text)
                orders.append(int(ordinal))
                tids.append(int(tid))
                doc = len(orders) - 1
                if len(text) > PIECE:  # windows in pieces that overlap by a window less a byte
                    for at in range(0, len(text) - length + 1, PIECE):
                        take([text[at : at + PIECE + length - 1]], [doc], at)
                        if count >= RUN_ANCHORS:  # also within a text
                            if group:
                                take([t for t, _ in group], [d for _, d in group])
                                group, size = [], 0
                            yield flush()
                            orders.append(int(ordinal))
                            tids.append(int(tid))
                            doc = 0
                    continue
                group.append((text, doc))
                size += len(text)
                if size >= PIECE:
                    take([t for t, _ in group], [d for _, d in group])
                    group, size = [], 0
            if group:
                take([t for t, _ in group], [d for _, d in group])
            if count >= RUN_ANCHORS or len(orders) > RUN_ANCHORS:
                if found:
                    yield flush()
                else:
                    orders.clear()
                    tids.clear()
        if found:
            yield flush()

    return work


def _shared_anchors(parts: int):
    """Rows (part, block): text and place of the anchors whose hash occurs under two ids, dealt by text; decided ones pass."""

    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        out = [(int(key[0]), blob) for blob in rows["block"][rows["decided"]]]
        h, ordinal, tid, place, known = [], [], [], [], []
        for blob in rows["block"][~rows["decided"].astype(bool)]:
            d, local, p, o, t, k = _unpack(blob)
            local = _joined(local)
            h.append(np.cumsum(_joined(d)))
            ordinal.append(o[local])
            tid.append(t[local])
            place.append(_joined(p))
            known.append(np.cumsum(_joined(k)))
        if h:
            h, ordinal, tid, place, known = (np.concatenate(x) for x in (h, ordinal, tid, place, known))
        if len(h):
            order = np.argsort(h, kind="stable")
            h, ordinal, tid, place = h[order], ordinal[order], tid[order], place[order]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            apart = np.minimum.reduceat(ordinal, starts) != np.maximum.reduceat(ordinal, starts)
            keep = np.repeat(apart | np.isin(h[starts], known), np.diff(np.append(starts, len(h))))
            out += _dealt_by_text(ordinal[keep], tid[keep], place[keep], parts)
        return pd.DataFrame(out, columns=["part", "block"])

    return work


def _places_of_texts(key, rows: pd.DataFrame) -> pd.DataFrame:
    """(ord, tid, places): one row a text with all its shared anchors."""
    ordinal, tid, place = [], [], []
    for blob in rows["block"]:
        o, t, sizes, p = _unpack(blob)
        sizes = _joined(sizes)
        ordinal.append(np.repeat(o, sizes))
        tid.append(np.repeat(t, sizes))
        place.append(_joined(p))
    ordinal, tid, place = np.concatenate(ordinal), np.concatenate(tid), np.concatenate(place)
    order = np.lexsort((place, tid, ordinal))
    ordinal, tid, place = ordinal[order], tid[order], place[order]
    starts = np.flatnonzero(np.concatenate(([True], (ordinal[1:] != ordinal[:-1]) | (tid[1:] != tid[:-1]))))
    return pd.DataFrame({"ord": ordinal[starts], "tid": tid[starts], "places": np.split(place, starts[1:])})


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """The length of the common prefix, given that ``known`` bytes are equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return known + (8 * len(x) - differ.bit_length()) // 8


def _suffix_runs(parts: int, length: int):
    """Rows (part, run, spans): front-coded sorted suffixes with what stands before them and the smallest id that has
    them; the spans that others lose by that."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left = length - ANCHOR
        records: list[tuple] = []
        docs: list[tuple[int, int]] = []

        def flush() -> pd.DataFrame:
            records.sort()
            rows, i = [], 0
            orders, tids = np.array(docs, dtype=np.int64).reshape(-1, 2).T
            while i < len(records):
                part, prefixes, tails, lengths, befores, before_lengths, counts, owners, places, extents = records[i][0], [], [], [], [], [], [], [], [], []
                last, last_before = b"", None
                while i < len(records) and records[i][0] == part:
                    _, suffix, before, doc, place, extent = records[i]
                    if last_before is not None and suffix == last and before == last_before:
                        counts[-1] += 1
                    else:
                        known = common_prefix(last, suffix)
                        prefixes.append(known)
                        tails.append(suffix[known:])
                        lengths.append(len(suffix))
                        befores.append(before)
                        before_lengths.append(len(before))
                        counts.append(1)
                        last, last_before = suffix, before
                    owners.append(doc)
                    places.append(place)
                    extents.append(extent)
                    i += 1
                owners, places, extents, counts = np.array(owners), np.array(places), np.array(extents), np.array(counts)
                # of equal bytes, those of larger ids go, with all windows around their anchor
                ordinals, ids = orders[owners], tids[owners]
                least = np.minimum.reduceat(ordinals, np.concatenate(([0], np.cumsum(counts)[:-1])))
                record = np.repeat(np.arange(len(counts)), counts)
                gone = ordinals > least[record]
                if gone.any():
                    near, far = np.maximum(0, length - np.array(lengths))[record[gone]], np.minimum(left, np.array(before_lengths))[record[gone]]
                    some = near <= far
                    at = places[gone][some]
                    rows.append((part, None, _pack(ordinals[gone][some], ids[gone][some], at - far[some], at + extents[gone][some] - near[some] + length)))
                    owners, places, extents, counts = owners[~gone], places[~gone], extents[~gone], np.bincount(record[~gone], minlength=len(counts))
                used, local = np.unique(owners, return_inverse=True)
                table = np.array([docs[u] for u in used], dtype=np.int64)
                rows.append((part, _pack(np.array(prefixes, np.uint8), b"".join(tails), np.array(lengths, np.uint8), b"".join(befores), np.array(before_lengths, np.uint8), _planes(counts), _planes(local), _planes(places), _planes(extents), table), None))
            records.clear()
            docs.clear()
            return pd.DataFrame(rows, columns=["part", "run", "spans"])

        for batch in batches:
            for text, ordinal, tid, places in zip(batch["text"], batch["ord"], batch["tid"], batch["places"], strict=True):
                text, doc = bytes(text), len(docs)
                docs.append((int(ordinal), int(tid)))
                for packed in np.unique(places).tolist():
                    for p, extent in _suffixes(text, packed, length):
                        suffix = text[p : p + length]
                        records.append((zlib.crc32(suffix[:ANCHOR]) % parts, suffix, text[max(0, p - left) : p], doc, p, extent))
                        if len(records) >= RUN_SUFFIXES:  # also within a text
                            yield flush()
                            doc = 0
                            docs.append((int(ordinal), int(tid)))
        if records:
            yield flush()

    return work


class Run:
    """A front-coded run, read suffix by suffix."""

    def __init__(self, blob: bytes) -> None:
        prefixes, tails, lengths, befores, before_lengths, counts, local, places, extents, table = _unpack(blob)
        self.prefixes, self.lengths = prefixes.tolist(), lengths.tolist()
        self.tails, self.befores, self.before_lengths = tails, befores, before_lengths.tolist()
        self.counts, self.owners, self.places, self.extents = _joined(counts), table[_joined(local)], _joined(places), _joined(extents)
        self.i, self.at, self.before_at, self.suffix, self.before = -1, 0, 0, b"", b""

    def next(self) -> int:
        """Go on; the length of the prefix shared with the suffix before, -1 at the end."""
        self.i += 1
        if self.i >= len(self.prefixes):
            self.suffix = None
            return -1
        known = self.prefixes[self.i]
        n = self.lengths[self.i] - known
        self.suffix = self.suffix[:known] + self.tails[self.at : self.at + n]
        self.at += n
        m = self.before_lengths[self.i]
        self.before = self.befores[self.before_at : self.before_at + m]
        self.before_at += m
        return known


def merged(runs: list[Run]) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(prefix shared with the suffix put out before, run, suffix, what stands before it) in sorted order.

    A loser tree: each inner node holds the run that lost there and the prefix
    that its suffix shares with the winner of that match. When the overall
    winner goes on, all losers on its path share their known prefixes with
    just that winner, so a match is decided by these lengths alone unless they
    are equal, and then by the bytes after them.
    """
    k = len(runs)
    if not k:
        return
    known = [0] * k
    for r in range(k):
        runs[r].next()
    loser = [0] * k

    def match(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        x, y = runs[a].suffix, runs[b].suffix
        if x is None:
            return b, a
        if y is None:
            return a, b
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        n = common_prefix(x, y, known[a])
        smaller = len(x) <= len(y) if n == min(len(x), len(y)) else x[n] < y[n]
        if n == len(x) == len(y):
            smaller = a < b
        win, lose = (a, b) if smaller else (b, a)
        known[lose] = n
        return win, lose

    def build(node: int) -> int:
        if node >= k:
            return node - k
        win, loser[node] = match(build(2 * node), build(2 * node + 1))
        return win

    winner = build(1) if k > 1 else 0
    while runs[winner].suffix is not None:
        run = runs[winner]
        yield known[winner], winner, run.suffix, run.before
        known[winner] = max(0, run.next())
        node = (winner + k) // 2
        while node >= 1:
            winner, loser[node] = match(winner, loser[node])
            node //= 2


def _left_classes(befores: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each left part read backwards, and the part it shares with the one before it in that order."""
    n = len(befores)
    padded = np.frombuffer(b"".join(b[::-1].ljust(width, b"\0") for b in befores), dtype=np.uint8).reshape(n, width)
    lengths = np.fromiter(map(len, befores), dtype=np.int64, count=n)
    order = np.lexsort([lengths] + [padded[:, c] for c in range(width - 1, -1, -1)])
    rows, lengths = padded[order], lengths[order]
    same = rows[1:] == rows[:-1]
    shared = np.where(same.all(1), width, same.argmin(1)) if n > 1 else np.zeros(0, dtype=np.int64)
    shared = np.minimum(shared, np.minimum(lengths[1:], lengths[:-1]))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.arange(n)
    return rank, np.concatenate(([0], shared))


def covered(blobs: list[bytes], length: int = LENGTH) -> pd.DataFrame:
    """(ord, tid, start, stop): what each suffix's text loses around it."""
    runs = [Run(b) for b in blobs]
    prefix, lengths, befores, first, last_run, at = [], [], [], [], [], []
    for known, r, suffix, before in merged(runs):
        prefix.append(known)
        lengths.append(len(suffix))
        befores.append(before)
        last_run.append(r)
    n, left = len(prefix), length - ANCHOR
    # members of each record, in merged order
    last_run = np.array(last_run)
    sizes, starts = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    owners = np.concatenate([r.owners for r in runs])
    places = np.concatenate([r.places for r in runs])
    extents = np.concatenate([r.extents for r in runs])
    base = 0
    for k, r in enumerate(runs):
        mine = np.flatnonzero(last_run == k)  # a run's records come out in its own order
        sizes[mine] = r.counts
        starts[mine] = base + np.concatenate(([0], np.cumsum(r.counts)[:-1]))
        base += len(r.places)
    take = np.repeat(starts - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(len(places))
    owners, places, extents = owners[take], places[take], extents[take]
    record = np.repeat(np.arange(n), sizes)
    least = np.minimum.reduceat(owners[:, 0], np.concatenate(([0], np.cumsum(sizes)[:-1])))
    prefix, lengths = np.array(prefix), np.array(lengths)
    rank, shared = _left_classes(befores, left)
    before_lengths = np.fromiter(map(len, befores), dtype=np.int64, count=n)
    high = np.full(len(places), -1, dtype=np.int64)
    low = np.full(len(places), -1, dtype=np.int64)
    for o in range(left + 1):  # windows that begin o bytes before the anchor
        ok = np.flatnonzero((before_lengths >= o) & (lengths >= length - o))
        if len(ok) == 0:
            continue
        right = np.cumsum(prefix < length - o)
        back = np.cumsum(shared < o) if o else np.zeros(n, dtype=np.int64)
        key = right[ok] * (n + 1) + back[rank[ok]]
        order = np.argsort(key, kind="stable")
        key, who = key[order], ok[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        smallest = np.minimum.reduceat(least[who], begin)
        bound = np.full(n, LAST, dtype=np.int64)
        bound[who] = np.repeat(smallest, np.diff(np.append(begin, len(who))))
        lost = owners[:, 0] > bound[record]
        low[lost & (low < 0)] = o
        high[lost] = o
    some = np.flatnonzero(high >= 0)
    return pd.DataFrame({"ord": owners[some, 0], "tid": owners[some, 1], "start": places[some] - high[some], "stop": places[some] + extents[some] - low[some] + length})


def _covered(length: int):
    def work(key, rows: pd.DataFrame) -> pd.DataFrame:
        known = [pd.DataFrame(dict(zip(("ord", "tid", "start", "stop"), _unpack(blob), strict=True))) for blob in rows["spans"].dropna()]
        runs = list(rows["run"].dropna())
        return pd.concat([*known, *([covered(runs, length)] if runs else [])])

    return work


def unite(spans) -> list[tuple[int, int]]:
    """Maximal runs of overlapping or touching spans."""
    out: list[list[int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], stop)
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for start, stop in spans:
        kept.append(text[at:start])
        at = stop
    return b"".join([*kept, text[at:]])


CUT = "ord long, tid long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,stop:long>>, kept binary"


def _cut(with_text: bool):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for ordinal, tid, text, found in zip(batch["ord"], batch["tid"], batch["text"], batch["spans"], strict=True):
                text = bytes(text)
                spans = unite((int(s["start"]), int(s["stop"])) for s in (found if found is not None else ()))
                kept = cut(text, spans)
                listed = [{"start": a, "stop": b} for a, b in spans]
                rows.append((ordinal, tid, len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), listed, kept if with_text else None))
            yield pd.DataFrame(rows, columns=["ord", "tid", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    return work


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and, ``with_text``, the kept bytes."""
    common.check_columns(docs, doc, text)
    if not ANCHOR + 1 <= length <= 250:
        raise ValueError("the length must be from 17 to 250")
    spark = docs.sparkSession
    raw = F.coalesce(F.encode(F.col(text), "UTF-8"), F.lit(b""))
    rows = docs.select(F.col(doc).cast("long").alias("doc_id"), raw.alias("text"))
    rows = rows.withColumn("ord", F.coalesce("doc_id", F.lit(LAST))).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("tid", F.xxhash64("sha"))
    narrow = materialize(rows.select("doc_id", "ord", "tid", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "narrow")
    total = narrow.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("b")).first()["b"]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)
    first = narrow.groupBy("sha").agg(F.min("ord").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    first = materialize(first, "copied")
    first = F.broadcast(first) if first.count() <= BROADCAST_COPIED else first  # a text with many copies meets its row where it stands
    marked = narrow.join(first, "sha", "left").withColumn("copy", F.coalesce(F.col("ord") > F.col("first"), F.lit(False)))
    unique = marked.filter(F.col("copy") == F.lit(False)).filter(F.col("n_bytes") >= length).select("ord", "tid").distinct()
    texts = rows.select("ord", "tid", "text").repartition(parts, "ord", "tid").join(unique, ["ord", "tid"], "left_semi")
    blocks = texts.mapInPandas(_anchor_blocks(parts, length), "part int, block binary, decided boolean")
    places = blocks.groupBy("part").applyInPandas(_shared_anchors(parts), "part int, block binary")
    places = places.groupBy("part").applyInPandas(_places_of_texts, "ord long, tid long, places array<long>")
    with_places = texts.join(places, ["ord", "tid"]).select("text", "ord", "tid", "places")
    runs = with_places.mapInPandas(_suffix_runs(parts, length), "part int, run binary, spans binary")
    spans = runs.groupBy("part").applyInPandas(_covered(length), "ord long, tid long, start long, stop long")
    spans = spans.groupBy("ord", "tid").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    found = texts.join(spans, ["ord", "tid"]).select("ord", "tid", "text", "spans").mapInPandas(_cut(with_text), CUT)
    # the same row may stand several times among the texts
    found = found.dropDuplicates(["ord", "tid"])
    out = marked.join(found.withColumn("hit", F.lit(True)), ["ord", "tid"], "left")
    gone = F.col("copy") & (F.col("n_bytes") >= length)
    zero = F.lit(0).cast("long")
    whole = F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("stop")))
    none = F.array().cast("array<struct<start:long,stop:long>>")
    out = out.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.lit(EMPTY_SHA)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
        F.when(gone, whole).otherwise(F.coalesce("spans", none)).alias("spans"),
        *([F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
    return out


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicate(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Brute force over all windows, as hex digits (two a byte).
OP2_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, {LAST}) AS o, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT r, doc_id, o, h, (length(h) // 2)::BIGINT AS n FROM d),
p AS (SELECT r, o, n, i, CASE WHEN i <= n - {LENGTH} THEN substr(h, 2 * i + 1, {2 * LENGTH}) END AS w, substr(h, 2 * i + 1, 2) AS c FROM b, unnest(range(0, n)) AS u(i)),
m AS (SELECT w, min(o) AS first FROM p WHERE w IS NOT NULL GROUP BY w),
f AS (SELECT p.r, p.i, p.c, coalesce(first < p.o, false) AS starts FROM p LEFT JOIN m ON m.w = p.w),
g AS (SELECT r, i, c, bool_or(starts) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
l AS (SELECT r, i, c, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY i), false) AS begins FROM g),
a AS (SELECT r, count(*) FILTER (gone) AS n_removed, count(*) FILTER (begins) AS n_spans, coalesce(string_agg(c, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM l GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM b LEFT JOIN a USING (r)
"""

QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
ORACLE_SQL = {"op2_suffix_dedup": OP2_SQL}
