"""SimHash near-duplicates by segment popcounts.

A 64-bit fingerprint is embedded as the bit counts of its 32 two-bit segments.
The Manhattan distance of two embeddings never exceeds the Hamming distance of
the fingerprints. The segments are cut into groups so that fingerprints within
``radius`` have a Manhattan distance of at most 1 in one of the groups (2
groups for a radius up to 3, 4 up to 7). Each group is a grid: a fingerprint
stands in its own cell, and the cells one step away hold all others in range.
A step changes the parity of a cell's sum, so that only the odd cells look at
their neighbours and each pair of cells meets once. What meets is verified by
the Hamming distance of the fingerprints.

Documents with equal fingerprints are one class from the start. The cells are
worked on in sorted order, a bounded piece at a time, and each cell passes on
a spanning forest of its links: a group of thousands of near copies makes as
many rows as it has members, not as many as it has pairs.

Defined results
* null and empty texts, and those without words, have the fingerprint 0 and are linked;
* fewer words than a shingle: the whole sequence is the only shingle;
* repeated rows and repeated ids are all returned, ids are compared as they are;
* a null id is returned with the component of its class, null where that has no other id;
* whole texts count, however long; an empty table gives an empty result;
* ``fingerprint`` and ``component_id`` replace input columns of these names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.storage import arrow_rows, materialize, scratch

from . import common
from .components import components

WORDS, RADIUS = 3, 3
SEED = 42
#: Hashes whose bits are counted at a time, and pairs that are compared at a time.
PIECE, PAIRS = 1 << 15, 1 << 21
FIELDS = 0x5555555555555555


def fingerprint_of(text: str | None, words: int = WORDS) -> int:
    """The fingerprint as an unsigned number."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and the six ASCII spaces only
    if not w:
        return 0
    joined = memoryview(b" ".join(w))
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(w) > words:
        starts, ends = starts[: len(w) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    pieces = ((starts[i : i + PIECE].tolist(), ends[i : i + PIECE].tolist()) for i in range(0, len(starts), PIECE))
    return simhash(np.array([digest(joined[a:b], SEED) for a, b in zip(*p, strict=True)], dtype="<u8") for p in pieces)


def simhash(pieces: Iterable[np.ndarray]) -> int:
    """The bits that over half of the hashes have set; 0 of none."""
    counts, n = np.zeros(64, dtype=np.int64), 0
    for h in pieces:
        counts += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", words: int = WORDS, name: str = "__print") -> DataFrame:
    """``docs`` with the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint_of(t, words) for t in texts], dtype=np.uint64).view(np.int64))

    return docs.withColumn(name, prints(F.col(text)))


def groups_for(radius: int) -> int:
    """Groups of segments so that one of them differs by 1 at most."""
    for groups in (2, 4, 8):
        if radius <= 2 * groups - 1:
            return groups
    raise ValueError("the radius must be from 0 to 15")


def _cells(prints: DataFrame, groups: int) -> DataFrame:
    """(g, cell, probe, print): each fingerprint in its own cell, and as a probe in those that an odd one looks at.

    prints: print, and t, the number of the table of fingerprints that it stands in; g is t times ``groups`` and the group.
    """
    bits = 64 // groups
    mask = (1 << bits) - 1
    rows = prints.select("t", "print", F.explode(F.expr(f"sequence(0, {groups - 1})")).alias("g"))
    rows = rows.withColumn("x", F.expr(f"shiftrightunsigned(print, g * {bits}) & {mask}L")).withColumn("g", F.expr(f"t * {groups} + g"))
    # two-bit fields with the number of bits set in each
    rows = rows.withColumn("cell", F.expr(f"x - (shiftrightunsigned(x, 1) & {FIELDS}L)"))
    own = rows.select("g", "cell", F.lit(False).alias("probe"), "print")
    field = "(shiftrightunsigned(cell, 2 * i) & 3)"
    up = f"transform(filter(sequence(0, {bits // 2 - 1}), i -> {field} < 2), i -> cell + shiftleft(1L, 2 * i))"
    down = f"transform(filter(sequence(0, {bits // 2 - 1}), i -> {field} > 0), i -> cell - shiftleft(1L, 2 * i))"
    odd = rows.filter("bit_count(x) % 2 = 1")
    near = odd.select("g", F.explode(F.expr(f"concat({up}, {down})")).alias("cell"), F.lit(True).alias("probe"), "print")
    return own.unionByName(near)


def _forest(own: np.ndarray, probes: np.ndarray, radius: int, forests: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forests of the links in one cell: among ``own``, and of ``probes`` to ``own``.

    With several, each is a forest of the links that those before have not used.
    """
    every = np.concatenate((own, probes))
    labels = [np.arange(len(every)) for _ in range(forests)]
    step = max(1, PAIRS // max(1, len(own)))
    a, b = [], []
    for i in range(0, len(every), step):
        far = np.bitwise_count(every[i : i + step, None] ^ own[None, :])
        r, c = np.nonzero(far <= radius)
        order = np.argsort(far[r, c], kind="stable")  # nearer pairs come first into the forest
        r, c = r[order] + i, c[order]
        keep = r > c  # own come first: each pair of them once, every probe
        r, c = r[keep], c[keep]
        for f in range(forests):
            left = np.ones(len(r), dtype=bool)  # for the forests that follow
            at = np.arange(len(r))
            while len(at):  # hook roots on smaller roots until all pairs of this piece agree
                lr, lc = labels[f][r[at]], labels[f][c[at]]
                apart = lr != lc
                at, lr, lc = at[apart], lr[apart], lc[apart]
                if not len(at):
                    break
                high, low = np.maximum(lr, lc), np.minimum(lr, lc)
                high, first = np.unique(high, return_index=True)
                left[at[first]] = False
                hook = np.arange(len(every))
                hook[high] = low[first]
                while (hook[hook] != hook).any():
                    hook = hook[hook]
                labels[f] = hook[labels[f]]
            a.append(every[r[~left]])
            b.append(every[c[~left]])
            r, c = r[left], c[left]
            if not len(r):
                break
    none = np.zeros(0, dtype=every.dtype)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _links(radius: int, groups: int, forests: int):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, ...]] = []

        def cells(g, cell, probe, prints):
            """Links of complete cells, which are sorted and stand one after the other."""
            starts = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (cell[1:] != cell[:-1]))))
            sizes = np.diff(np.append(starts, len(g)))
            bases = np.add.reduceat((~probe).astype(np.int64), starts)
            out_a, out_b, out_g = [], [], []
            two = (sizes == 2) & (bases >= 1)  # by far the most
            s = starts[two]
            near = np.bitwise_count(prints[s] ^ prints[s + 1]) <= radius
            out_a.append(prints[s[near]])
            out_b.append(prints[s[near] + 1])
            out_g.append(g[s[near]])
            more = (sizes > 2) & (bases >= 1)
            for s, n, k in zip(starts[more], sizes[more], bases[more], strict=True):
                a, b = _forest(prints[s : s + k], prints[s + k : s + n], radius, forests)
                if len(a):
                    out_a.append(a)
                    out_b.append(b)
                    out_g.append(np.full(len(a), g[s]))
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            return pd.DataFrame({"t": np.concatenate(out_g) // groups, "a": a.view(np.int64), "b": b.view(np.int64)})

        for batch in batches:
            part = batch["g"].to_numpy(), batch["cell"].to_numpy(), batch["probe"].to_numpy(bool), batch["print"].to_numpy().view(np.uint64)
            if not len(part[0]):
                continue
            change = np.flatnonzero((part[0][1:] != part[0][:-1]) | (part[1][1:] != part[1][:-1]))
            last = held[-1] if held else None
            apart = last is not None and (last[0][-1] != part[0][0] or last[1][-1] != part[1][0])
            if apart or len(change):
                cut = 0 if not len(change) else change[-1] + 1
                whole = [tuple(x[:cut] for x in part)] if cut else []
                whole = held + whole
                held = [tuple(x[cut:] for x in part)]
                found = cells(*(np.concatenate(x) for x in zip(*whole, strict=True))) if whole else None
                if found is not None and len(found):
                    yield found
            else:
                held.append(part)
        if held:
            found = cells(*(np.concatenate(x) for x in zip(*held, strict=True)))
            if len(found):
                yield found

    return work


def links(prints: DataFrame, radius: int = RADIUS, forests: int = 1) -> DataFrame:
    """Links (t, a, b) that join all distinct fingerprints (columns t and print) within ``radius`` into their components."""
    groups = groups_for(radius)
    prints = prints if "t" in prints.columns else prints.withColumn("t", F.lit(0))
    cells = _cells(prints, groups)
    cells = cells.repartition("g", "cell").sortWithinPartitions("g", "cell", "probe")
    return cells.mapInPandas(_links(radius, groups, forests), "t int, a long, b long")


def linked(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """(id, __print, component_id) for every row of ``docs``."""
    common.check_columns(docs, doc, text)
    prints = materialize(with_fingerprint(docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text")), "text", words).drop("text"), "prints")
    return with_components(prints, radius)


def with_components(prints: DataFrame, radius: int) -> DataFrame:
    classes = prints.groupBy("__print").agg(F.min("doc_id").alias("first"))
    found = components(links(classes.select(F.col("__print").alias("print")), radius).select("a", "b"))
    least = classes.join(found, F.col("__print") == F.col("node"), "left").withColumn("root", F.coalesce("component", "__print"))
    ids = least.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = least.select("__print", "root").join(ids, "root").select("__print", "component_id")
    return prints.join(ids, "__print")


# --- near-duplicate documents: every pair whose shingles have a Jaccard similarity of DEDUP_SIMILARITY

DEDUP_WORDS, DEDUP_SIMILARITY = 5, 0.8
#: Texts whose shingles are counted to learn which are common. The counts only order the shingles: any order finds the same links.
ORDER_TEXTS, COMMON = 20_000, 4
#: Texts with a shingle in common of which all pairs are proposed; more are verified where they meet, this many by this many.
SMALL_CELL, SLICE = 32, 512
#: Bits of the parities that stand in cells, and of those by which proposed pairs are checked before their sets are fetched.
SHORT_PARITY, LONG_PARITY = 64, 1024
#: Texts with more shingles, on which those bits tell little, also have a parity of two to four bits a shingle.
WIDE_FROM = 512
#: Rows that name texts (about 150 bytes each in memory) are broadcast up to this number, counted first; beyond, both sides are shuffled.
BROADCAST_ROWS = 1_000_000
#: Texts that cross to Python at a time.
TEXTS = 500
LAST = 0x7FFFFFFFFFFFFFFF


def shingles_of(text: str | None, words: int = DEDUP_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; of a shorter text the whole sequence, of none nothing."""
    import xxhash

    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.zeros(0, dtype=np.int64)
    joined = [b" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))]
    return np.unique(np.array([xxhash.xxh64_intdigest(j, SEED) for j in joined], dtype=np.uint64).view(np.int64))


def prefix_of(shingles: np.ndarray, known: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles in the common order, so many that any set with this similarity has one of them among its own first.

    Shingles that are not ``known`` (sorted) to be common come first, by their hash, then
    the others by their counts.
    """
    n = len(shingles)
    length = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        weight = np.where(known[at] == shingles, counts[at], 0)
        shingles = shingles[np.lexsort((shingles, weight))]
    return shingles[:length]


def parity_of(shingles: np.ndarray, bits: int) -> bytes:
    """``bits`` (a power of 2) bits, each the parity of a share of the shingles: two sets differ in no more bits than shingles."""
    at = (shingles.view(np.uint64) >> np.uint64(65 - bits.bit_length())).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def wide_parity(shingles: np.ndarray) -> bytes | None:
    return None if len(shingles) <= WIDE_FROM else parity_of(shingles, 1 << (2 * len(shingles) - 1).bit_length())


def _stacked(parities: list[bytes], size: int) -> np.ndarray:
    """Parities of one length as rows of ``size`` bytes; longer ones are folded, as shares of shingles join in pairs."""
    rows = np.frombuffer(b"".join(parities), dtype=np.uint8).reshape(len(parities), -1)
    while rows.shape[1] > size:
        bits = np.unpackbits(rows, axis=1, bitorder="little")
        rows = np.packbits(bits[:, ::2] ^ bits[:, 1::2], axis=1, bitorder="little")
    return np.ascontiguousarray(rows).view("<u8")


def _possible(similarity: float):
    """Proposed pairs without those whose parities prove the similarity to be less; a pair without parities stays."""
    share = (1 - similarity) / (1 + similarity)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            pa, pb = batch["pa"].to_numpy(), batch["pb"].to_numpy()
            limit = share * (batch["na"] + batch["nb"]).to_numpy() + 1e-9
            stays = np.ones(len(batch), dtype=bool)
            classes: dict[tuple[int, int], list[int]] = {}
            for i, (x, y) in enumerate(zip(pa, pb, strict=True)):
                if x is not None and y is not None:
                    classes.setdefault((len(x), len(y)), []).append(i)
            for (x, y), at in classes.items():
                for k in range(0, len(at), max(1, PAIRS // max(x, y))):
                    some = at[k : k + max(1, PAIRS // max(x, y))]
                    far = np.bitwise_count(_stacked(pa[some].tolist(), min(x, y)) ^ _stacked(pb[some].tolist(), min(x, y))).sum(axis=1, dtype=np.int64)
                    stays[some] = far <= limit[some]
            yield batch.loc[stays, ["a", "b"]]

    return work


def _near_members(similarity: float):
    """Members of two slices of a large cell (or of one) that sizes and parities leave a partner in another component."""
    share = (1 - similarity) / (1 + similarity)

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("n", kind="stable")
        n, own, label = rows["n"].to_numpy(np.int64), rows["own"].to_numpy(), rows["component"].to_numpy()
        one, parity = (own == own[0]).all(), rows["parity"].to_numpy()
        sizes = np.array([len(x) for x in parity])
        until = np.searchsorted(n, np.floor(n / similarity + 1e-9), side="right")  # partners of the same size or more stand before
        near = np.zeros(len(rows), dtype=bool)
        for x in np.unique(sizes).tolist():
            mine = np.flatnonzero(sizes == x)
            for y in (x, 2 * x):  # within these sizes of texts the lengths differ by a factor of 2 at most
                other = mine if y == x else np.flatnonzero(sizes == y)
                if not len(other):
                    continue
                left, right = _stacked(parity[mine].tolist(), x), _stacked(parity[other].tolist(), x)
                for i, r in enumerate(mine):
                    begin, end = np.searchsorted(other, r + 1), np.searchsorted(other, until[r])
                    some = other[begin:end]
                    if not len(some):
                        continue
                    hit = label[some] != label[r]
                    if not one:
                        hit &= own[some] != own[r]
                    if not hit.any():
                        continue
                    far = np.bitwise_count(right[begin:end][hit] ^ left[i]).sum(axis=1, dtype=np.int64)
                    some = some[hit]
                    some = some[far <= share * (n[some] + n[r]) + 1e-9]
                    if len(some):
                        near[r] = near[some] = True
        return pd.DataFrame({"cell": rows["cell"].to_numpy()[near], "sid": rows["sid"].to_numpy()[near]})

    return work


def _cell_pairs(similarity: float):
    share = (1 - similarity) / (1 + similarity)

    def possible(n, parity, a, b):
        """False where sizes or parities prove the similarity to be less."""
        size = np.minimum(n[a], n[b]) + 1e-9 >= similarity * np.maximum(n[a], n[b])
        return size & (np.bitwise_count(parity[a] ^ parity[b]) <= share * (n[a] + n[b]) + 1e-9)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        held: list[tuple[np.ndarray, ...]] = []

        def cells(h, sid, n, parity):
            """Proposed pairs (cell is null), and the texts of large cells (b is null), of complete cells in sorted order."""
            fresh = np.concatenate(([True], (h[1:] != h[:-1]) | (sid[1:] != sid[:-1])))  # equal sets are one text
            h, sid, n, parity = h[fresh], sid[fresh], n[fresh], parity[fresh]
            starts = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
            sizes = np.diff(np.append(starts, len(h)))
            two = starts[sizes == 2]
            left, right, large = [two], [two + 1], {}
            for s, k in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                if k <= SMALL_CELL:
                    i, j = np.triu_indices(k, 1)
                else:
                    by_size = np.lexsort((parity[s : s + k], n[s : s + k]))
                    i, j = np.concatenate((np.zeros(k - 1, dtype=np.int64), by_size[:-1])), np.concatenate((np.arange(1, k), by_size[1:]))
                    members = sid[s : s + k]
                    large[xxhash.xxh64_intdigest(members.tobytes(), SEED) >> 1] = members
                left.append(s + i)
                right.append(s + j)
            left, right = np.concatenate(left), np.concatenate(right)
            near = possible(n, parity, left, right)
            pairs = np.unique(np.sort(np.stack((sid[left[near]], sid[right[near]]), axis=1), axis=1), axis=0)
            none = pd.array([None] * len(pairs), dtype="Int64")
            yield pd.DataFrame({"cell": none, "a": pairs[:, 0], "b": pd.array(pairs[:, 1], dtype="Int64")})
            for cell, members in large.items():
                none = pd.array([None] * len(members), dtype="Int64")
                yield pd.DataFrame({"cell": pd.array(np.full(len(members), cell), dtype="Int64"), "a": members, "b": none})

        for batch in batches:
            part = batch["h"].to_numpy(), batch["sid"].to_numpy(), batch["n"].to_numpy(np.int64), batch["parity"].to_numpy().view(np.uint64)
            if not len(part[0]):
                continue
            change = np.flatnonzero(part[0][1:] != part[0][:-1])
            if held and held[-1][0][-1] != part[0][0]:
                cut = change[-1] + 1 if len(change) else 0
            elif len(change):
                cut = change[-1] + 1
            else:
                held.append(part)
                continue
            whole = held + ([tuple(x[:cut] for x in part)] if cut else [])
            held = [tuple(x[cut:] for x in part)]
            if whole:
                yield from cells(*(np.concatenate(x) for x in zip(*whole, strict=True)))
        if held:
            yield from cells(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return work


def _verified(similarity: float):
    """Links that join the texts of two slices of a large cell (or of one slice) as all their pairs would."""

    def work(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("sid")
        sid, own = rows["sid"].to_numpy(), rows["own"].to_numpy()
        one = (own == own[0]).all()
        sets = [np.asarray(s, dtype=np.int64) for s in rows["s"]]
        n = np.array([len(s) for s in sets])
        starts = np.concatenate(([0], np.cumsum(n)[:-1]))
        _, code = np.unique(np.concatenate(sets), return_inverse=True)
        _, label = np.unique(rows["component"].to_numpy(), return_inverse=True)
        mark = np.zeros(len(code), dtype=bool)
        a, b = [], []
        for x in range(len(sid) - 1):
            if (label[x + 1 :] == label[x]).all():
                continue
            mine = code[starts[x] : starts[x] + n[x]]
            mark[mine] = True
            begin = starts[x + 1]
            both = np.add.reduceat(mark[code[begin:]].astype(np.int64), starts[x + 1 :] - begin)
            mark[mine] = False
            hit = (both / (n[x + 1 :] + n[x] - both) >= similarity) & (label[x + 1 :] != label[x])
            if not one:
                hit &= own[x + 1 :] != own[x]
            for y in np.flatnonzero(hit) + x + 1:
                if label[y] != label[x]:
                    a.append(sid[x])
                    b.append(sid[y])
                    label[label == label[y]] = label[x]
        return pd.DataFrame({"a": np.array(a, dtype=np.int64), "b": np.array(b, dtype=np.int64)})

    return work


def shingle_links(rows: DataFrame, first: DataFrame, words: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(tid, sid) with the hash of each text's set of shingles, and links (a, b) that join the sets into the components of all similar pairs.

    rows: ord, tid and text; first: the smallest ord of each tid. Fingerprints of
    the sets propose pairs by the grid of segment popcounts. What they miss (at
    this similarity about ten bits differ, too many for a selective grid) the
    prefix filter proposes. Two similar
    sets have one of their first shingles in common (prefix filter), so that the
    cells of equal first shingles hold every similar pair. Small cells propose
    their pairs, large ones a few; the similarity of these is computed. In
    large cells whose texts are not joined by then all other pairs are computed
    too, without listing them.
    """
    spark = rows.sparkSession
    n_first = first.count()
    if n_first <= BROADCAST_ROWS:
        one = rows.join(F.broadcast(first), ["tid", "ord"], "left_semi")
    else:  # the texts are shuffled once, and read from there
        one = materialize(rows.join(first, ["tid", "ord"], "left_semi"), "unique")

    @F.pandas_udf("array<long>")
    def shingles(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield part.map(lambda t: shingles_of(t, words))

    every = max(1, n_first // ORDER_TEXTS)
    sample = one.filter(F.pmod(F.xxhash64("tid"), F.lit(every)) == 0).select(F.explode(shingles("text")).alias("h"))
    with arrow_rows(spark, TEXTS):
        frequent = sample.groupBy("h").count().filter(F.col("count") >= COMMON).orderBy("h").toArrow()
    order = spark.sparkContext.broadcast((frequent["h"].to_numpy(), frequent["count"].to_numpy()))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        for batch in batches:
            sets = [shingles_of(t, words) for t in batch["text"]]
            yield pd.DataFrame({
                "tid": batch["tid"], "sid": np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], dtype=np.uint64).view(np.int64),
                "n": [len(s) for s in sets], "parity": np.frombuffer(b"".join([parity_of(s, SHORT_PARITY) for s in sets]), dtype="<i8"), "long": [parity_of(s, LONG_PARITY) for s in sets], "wide": [wide_parity(s) for s in sets],
                "print": np.array([simhash(s[i : i + PIECE].view("<u8") for i in range(0, len(s), PIECE)) for s in sets], dtype=np.uint64).view(np.int64),
                "prefix": [prefix_of(s, *order.value, similarity) for s in sets],
            })

    with arrow_rows(spark, TEXTS):
        placed = materialize(one.select("tid", "text").mapInPandas(place, "tid string, sid long, n int, parity long, long binary, wide binary, print long, prefix array<long>"), "placed")
    keyed = placed.select("tid", "sid").distinct()
    cells = placed.select("sid", "n", "parity", F.explode("prefix").alias("h")).repartition("h").sortWithinPartitions("h", "sid")
    met = materialize(cells.mapInPandas(_cell_pairs(similarity), "cell long, a long, b long"), "met")
    proposed = met.filter("cell IS NULL").select("a", "b").union(_by_prints(placed.select("sid", "print"))).distinct()
    proposed = materialize(proposed, "proposed")
    large = materialize(met.filter("cell IS NOT NULL").select("cell", F.col("a").alias("sid")).distinct(), "large")
    for name, parity in (("likely", F.col("long")), ("likelier", F.col("wide"))):
        asked = proposed.select(F.col("a").alias("sid")).union(proposed.select("b")).distinct()
        sides = placed.select("sid", "n", parity.alias("p")).filter("p IS NOT NULL").join(asked, "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("p").alias("p"))
        both = proposed.join(sides.toDF("a", "na", "pa"), "a", "left").join(sides.toDF("b", "nb", "pb"), "b", "left")
        with arrow_rows(spark, 4 * TEXTS):
            proposed = materialize(both.mapInPandas(_possible(similarity), "a long, b long"), name)

    def sets_of(wanted: DataFrame) -> DataFrame:
        """(sid, s): the shingles of one text of each set; a repeated row gives a repeated set."""
        wanted = materialize(wanted.distinct(), "wanted")
        texts = keyed.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("tid").alias("tid"))
        texts = F.broadcast(texts) if wanted.count() <= BROADCAST_ROWS else texts
        with arrow_rows(spark, TEXTS):
            return materialize(one.join(texts, "tid").select("sid", shingles("text").alias("s")), "shingles")

    sets = sets_of(proposed.select(F.col("a").alias("sid")).union(proposed.select("b")))
    pairs = proposed.join(sets.withColumnRenamed("sid", "a").withColumnRenamed("s", "sa"), "a").join(sets.withColumnRenamed("sid", "b").withColumnRenamed("s", "sb"), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    held = materialize(pairs.filter(both / (F.size("sa") + F.size("sb") - both) >= similarity).select("a", "b").distinct(), "held")
    if large.isEmpty():
        return keyed, held

    joined = large.join(components(held).withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    joined = materialize(joined, "joined")
    apart = joined.groupBy("cell").agg(F.count("*").alias("k"), F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("cell", "k")
    members = _dealt(joined.join(apart, "cell"))
    sides = placed.select("sid", "n", F.coalesce("wide", "long").alias("parity")).join(members.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.first("n").alias("n"), F.first("parity").alias("parity"))
    near = members.join(sides, "sid").groupBy("cell", "i", "j").applyInPandas(_near_members(similarity), "cell long, sid long")
    near = materialize(near.distinct(), "near")
    if near.isEmpty():
        return keyed, held
    sizes = near.groupBy("cell").agg(F.count("*").alias("k"))
    members = _dealt(near.join(joined, ["cell", "sid"]).join(sizes, "cell"))
    rest = members.join(sets_of(near.select("sid")), "sid").groupBy("cell", "i", "j").applyInPandas(_verified(similarity), "a long, b long")
    return keyed, materialize(held.union(rest), "links")


def _by_prints(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets proposed by their fingerprints (columns sid, print): one set of each fingerprint with its
    others, and those of fingerprints that the grid links."""
    classes = materialize(rows.groupBy("print").agg(F.min("sid").alias("first")), "prints")
    near = materialize(links(classes.select("print")).select("a", "b"), "print-links")
    one, other = classes.toDF("a", "x"), classes.toDF("b", "y")
    between = near.join(one, "a").join(other, "b").select("x", "y")
    within = rows.join(classes, "print").select(F.col("first").alias("x"), F.col("sid").alias("y"))
    pairs = between.union(within).filter("x <> y")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _dealt(members: DataFrame) -> DataFrame:
    """Members of cells (cell, sid, component, k) once for each pair of slices that holds their own."""
    slices = F.ceil(F.col("k") / SLICE).cast("int")
    members = members.withColumn("slices", slices).withColumn("own", F.pmod(F.xxhash64("sid"), "slices").cast("int"))
    members = members.withColumn("other", F.explode(F.expr("sequence(0, slices - 1)")))
    return members.select("cell", "sid", "component", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def text_id(text: Column) -> Column:
    """128 bits of a text's SHA-256, as hex digits; null like empty."""
    return F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32)


def duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", words: int = DEDUP_WORDS, similarity: float = DEDUP_SIMILARITY) -> DataFrame:
    """(ord, tid, n, keeper_ord, keeper_tid): each distinct (id, text), how often it occurs, and the one that stays for its group.

    Two texts are linked if they share ``similarity`` of their distinct
    shingles (Jaccard), and a group is what links join: no link is missed.
    """
    if docs.schema[doc].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{doc} must hold integers: the smallest one of a group stays")
    rows = docs.select(F.coalesce(F.col(doc).cast("long"), F.lit(LAST)).alias("ord"), F.col(text).alias("text"))
    rows = rows.withColumn("tid", text_id(F.col("text")))
    narrow = materialize(rows.select("ord", "tid"), "narrow")
    texts = materialize(narrow.groupBy("tid").agg(F.min("ord").alias("ord")), "texts")
    keyed, held = shingle_links(rows, texts, words, similarity)
    groups = texts.join(keyed, "tid").join(components(held).withColumnRenamed("node", "sid"), "sid", "left").withColumn("group", F.coalesce("component", "sid"))
    groups = groups.select("tid", "ord", "group")
    keepers = groups.groupBy("group").agg(F.min(F.struct("ord", "tid")).alias("k"))
    kept = groups.join(keepers, "group").select("tid", F.col("k.ord").alias("keeper_ord"), F.col("k.tid").alias("keeper_tid"))
    return narrow.groupBy("ord", "tid").agg(F.count("*").alias("n")).join(kept, "tid")


def deduplicate(docs: DataFrame, doc: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: the smallest id, once."""
    common.check_columns(docs, doc, text)
    with scratch(docs.sparkSession):
        found = materialize(duplicates(docs, doc, text, **options), "duplicates", keep=True)
    stays = (F.col("ord") == F.col("keeper_ord")) & (F.col("tid") == F.col("keeper_tid"))
    gone = found.filter(~stays).select(F.col("ord").alias("__o"), F.col("tid").alias("__t"))
    again = found.filter(stays & (F.col("n") > 1)).select(F.col("ord").alias("__o"), F.col("tid").alias("__t"))
    keyed = docs.withColumn("__ord", F.coalesce(F.col(doc).cast("long"), F.lit(LAST))).withColumn("__tid", text_id(F.col(text)))
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    at = (F.col("__ord") == F.col("__o")) & (F.col("__tid") == F.col("__t"))
    out = keyed.join(small(gone), at, "left_anti")
    if not again.isEmpty():  # the same row several times
        again = small(again)
        out = out.join(again, at, "left_anti").unionByName(out.join(again, at, "left_semi").dropDuplicates(["__ord", "__tid"]))
    return out.drop("__ord", "__tid")


def hex_of(column: Column) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return linked(docs).select("doc_id", hex_of(F.col("__print")).alias("fingerprint"), "component_id")


QUERIES = {"op8_simhash_dedup": op8_simhash_dedup}
ORACLE_SQL: dict = {}
