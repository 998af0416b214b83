"""N-gram Jaccard join (operator 2) by universe partitioning.

Documents are sets of word shingles, kept as sorted 64-bit hashes. Sizes
fall into bands, each a factor of 100/percent wide, so that linked sets
lie in one band or in neighbouring ones. In the scheme of a band the hash
universe is cut into m segments. Two sets that link differ in at most
d = (100 - percent) / (100 + percent) * (|x| + |y|) elements, so of the
segments that x has elements in, all but d are the same in y.

*Index.* Every set is indexed in its own band's scheme by a hash of each
of its non-empty segments, and, for the `designated` segments, by that of
every one-deletion neighbour.
*Probe and allocation.* The larger set probes its own scheme and the next
smaller one. A probe of a segment by its exact subset accounts for one
difference, one that also takes its one-deletion neighbours for two; d + 1
must be accounted for. The cheapest allocation takes the segments of most
elements, which the fewest other sets share, leaves out empty ones, which
many do, and buys what is missing with one-deletion neighbours of
designated segments. A set that cannot reach d + 1 so (its hashes fell
into too few segments) makes the whole join start anew with another salt,
as does a clash of the 64-bit names of sets. A set's elements are 64-bit hashes
of its shingles, and counts of shared elements are exact over these: two
unlike shingles of one pair of documents are taken for one with a chance
of |x| |y| / 2**64, 1e-11 for two texts of 15,000 words.
*Lists.* Signatures go to partitions in packed blocks. Sets that share one
form a list. Of its long lists each set leaves out the longest, as many as
its allocation has to spare, so a passage that many unrelated documents
share is not compared at all. Short lists give all their pairs, of which
those stay that share more lists than the larger set has to spare. What is
left of a long list gives the pairs of its most central member with each
other one; after these are verified and their components known, long lists that still
hold several are taken again: each member is written as a bit mask of what
it shares with the list's central one and its other elements, which decides
any pair exactly, and members of different components are compared so.
*Verification* compares the whole sets of each candidate pair. Sets are
made again from the texts of candidates; each goes to the partition of its
pair's less connected member, so a hub is sent once per partition.

Equal sets are one node from the start. Nothing is capped or sampled.

Defined results: null and empty texts, and texts of white space, have no
shingles and are linked with nothing (component_id is their own id); a
row without an id lends none, its component_id is the smallest id linked
with it or null; repeated rows give repeated rows; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from ._common import SLICE_BYTES, as_bytes, materialise, shuffle_partitions, slices, temporary
from .components import components

WORDS, PERCENT = 5, 75
#: Lists of so many sets give all their pairs.
SHORT = 3
#: Designated segments of a scheme; schemes of small sets designate all.
DESIGNATED, SMALL = 8, 32
#: Candidate ids are broadcast up to so many, beyond that they are joined by shuffle.
BROADCAST_IDS = 500_000
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_CACHED = 400_000
# a slice's rows are numbered in 15 bits of a packed signature, and slices() counts at least 64 bytes a row
assert SLICE_BYTES // 64 < 1 << 15
_M1, _M2, _K1, _K2 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = (x ^ x >> np.uint64(30)) * _M1
    x = (x ^ x >> np.uint64(27)) * _M2
    return x ^ x >> np.uint64(31)


class Bands:
    """Sizes and schemes: least and largest size, segments and designated segments of each band."""

    def __init__(self, percent: int = PERCENT, most: int = 1 << 40):
        self.num, self.den, self.percent = 100 - percent, 100 + percent, percent
        low, lows, highs = 1, [], []
        while low < most:
            lows.append(low)
            highs.append(100 * low // percent)
            low = highs[-1] + 1
        self.low, self.high = np.array(lows, np.int64), np.array(highs, np.int64)
        above = 100 * self.high // percent
        worst = np.maximum(2 * self.high, self.high + above) * self.num // self.den
        small = self.high <= SMALL
        self.segments = worst + 1 + 6 + worst // 16
        self.segments[small] = np.maximum(self.segments[small], 64)
        self.designated = np.where(small, self.segments, DESIGNATED)

    def of(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, n, "right") - 1

    def differences(self, n: np.ndarray, other: np.ndarray) -> np.ndarray:
        """The most elements in which linked sets of these sizes differ."""
        return (n + other) * self.num // self.den


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


class Shingler:
    """Sorted distinct shingle hashes of texts."""

    def __init__(self, words: int = WORDS, salt: int = 0):
        rng = np.random.default_rng(words)
        self.words, self.salt = words, np.uint64(salt * 0x2545F4914F6CDD1D % 2**64)
        self.odd = rng.integers(1, 2**63, 2 * words, np.uint64) * np.uint64(2) + np.uint64(1)
        self.known = _Hashes()

    def sets(self, texts: list[bytes | None]) -> list[np.ndarray]:
        if len(self.known) > _CACHED:
            self.known.clear()
        get, k = self.known.__getitem__, self.words
        docs = [t.translate(_LOWER).split() if t else [] for t in texts]
        flat = np.fromiter(map(get, chain.from_iterable(docs)), np.uint64, sum(map(len, docs)))
        rolled = np.zeros(max(0, len(flat) - k + 1), np.uint64)
        for j in range(k):
            rolled += flat[j : j + len(rolled)] * self.odd[j]
        rolled = mix(mix(rolled) ^ self.salt)
        out, at = [], 0
        for d in docs:
            n = len(d)
            if n >= k:
                s = rolled[at : at + n - k + 1].copy()
                s.sort()
                s = s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif n:
                one = (flat[at : at + n] * self.odd[k : k + n]).sum(dtype=np.uint64) + np.uint64(n)
                s = mix(mix(np.array([one], np.uint64)) ^ self.salt)
            else:
                s = np.empty(0, np.uint64)
            out.append(s)
            at += n
        return out


def signatures(sets: list[np.ndarray], bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For non-empty sets: signature, set number and probe-only flag of each entry; what each set's allocation has to spare in its own
    scheme and below; -1 there: it can't reach its differences."""
    sizes = np.array([len(s) for s in sets], np.int64)
    own = bands.of(sizes)
    found, spare = [], np.zeros((2, len(sets)), np.int64)
    for below in (0, 1):
        band = own - below
        who = np.arange(len(sets)) if not below else np.flatnonzero((band >= 0) & (100 * bands.high[np.maximum(band, 0)] >= bands.percent * sizes))
        if not len(who):
            continue
        scheme, n = band[who], sizes[who]
        u = np.concatenate([sets[i] for i in who])
        doc = np.repeat(np.arange(len(who)), n)
        seg = (u >> np.uint64(32)) * bands.segments[scheme].astype(np.uint64)[doc] >> np.uint64(32)
        edge = np.concatenate(([True], (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])))
        starts = np.flatnonzero(edge)
        counts = np.diff(np.append(starts, len(u)))
        mixed = mix(u + _K2)
        sums, sdoc, sseg = np.add.reduceat(mixed, starts), doc[starts], seg[starts]
        place = mix(sseg * _K1 + (scheme.astype(np.uint64)[sdoc] + np.uint64(1)) * _K2)
        filled = np.bincount(sdoc, minlength=len(who))
        need = bands.differences(n, bands.high[scheme] if below else n) + 1
        spared = filled - need
        short = spared < 0
        chosen = sseg < bands.designated[scheme].astype(np.uint64)[sdoc]
        # whoever is indexed gives the neighbours that leave two elements; whoever falls short probes with all of its own
        near = chosen & ((counts >= 3) & (not below) | (counts >= 2) & short[sdoc])
        bought = np.bincount(sdoc[chosen & (counts >= 2)], minlength=len(who))
        spare[below, who] = np.where(short, np.where(spared + bought >= 0, 0, -1), spared)
        keep = np.ones(len(starts), bool)
        if below:  # no index here: the segments of most elements suffice, and a few more to leave out long lists
            most = need + 4 + need // 32
            order = np.lexsort((-counts, sdoc))
            first = np.concatenate(([0], np.cumsum(filled)[:-1]))
            keep[order] = np.arange(len(order)) - first[sdoc[order]] < most[sdoc[order]]
            spare[below, who] = np.minimum(spare[below, who], np.maximum(most - need, 0))
        flag = np.full(int(keep.sum()), below, np.uint8)
        found.append((mix(sums[keep] + place[keep]), who[sdoc[keep]], flag))
        if near.any():
            of = np.cumsum(edge) - 1
            some = near[of]
            found.append((mix(sums[of[some]] - mixed[some] + place[of[some]]), who[doc[some]], np.full(int(some.sum()), below, np.uint8)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.uint8), spare[0], spare[1]
    return *(np.concatenate(c) for c in zip(*found, strict=True)), spare[0], spare[1]


_META = np.dtype([("doc", "<i8"), ("null", "u1"), ("node", "<u8"), ("n", "<i8"), ("high", "<u8"), ("low", "<u8"), ("own", "<i4"), ("below", "<i4")])
_BLOCK = "key int, kind int, nodes binary, body binary"
_FOUND = "kind int, a long, b long, n long, own int, below int, high long, low long"


def _blocks(keys: list[int], words: int, percent: int, salt: int):
    """Texts to packed blocks: kind 0 signatures for partition `key`, kind 1 a row for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler, bands, seen, turn = Shingler(words, salt), Bands(percent), set(), 0
        parts = len(keys)
        for batch in batches:
            for part in slices(batch, "text"):
                sets = shingler.sets(as_bytes(part.column("text")))
                meta = np.zeros(len(sets), _META)
                ids = part.column("doc_id")
                meta["null"] = np.asarray(ids.is_null().to_numpy(zero_copy_only=False))
                meta["doc"] = ids.fill_null(0).to_numpy()
                meta["n"] = [len(s) for s in sets]
                fresh = []
                for i, s in enumerate(sets):
                    if len(s):
                        raw = s.tobytes()
                        wide = xxhash.xxh3_128_intdigest(raw)
                        meta["high"][i], meta["low"][i], meta["node"][i] = wide >> 64, wide & (2**64 - 1), xxhash.xxh3_64_intdigest(raw, 11)
                        if int(meta["node"][i]) not in seen:
                            seen.add(int(meta["node"][i]))
                            fresh.append(i)
                rows = []
                if fresh:
                    sig, who, flag, own, below = signatures([sets[i] for i in fresh], bands)
                    meta["own"][fresh], meta["below"][fresh] = own, below
                    to = ((sig >> np.uint64(48)) * np.uint64(parts) >> np.uint64(16)).astype(np.uint16 if parts <= 1 << 16 else np.uint32)
                    order = np.argsort(to, kind="stable")
                    to, sig, who, flag = to[order], sig[order], who[order], flag[order]
                    cuts = np.searchsorted(to, np.arange(parts + 1))
                    names = meta["node"][fresh]
                    for p in range(parts):
                        a, b = cuts[p], cuts[p + 1]
                        if a < b:
                            there, local = np.unique(who[a:b], return_inverse=True)
                            value = sig[a:b] << np.uint64(16) | local.astype(np.uint64) << np.uint64(1) | flag[a:b].astype(np.uint64)
                            rows.append((keys[p], 0, names[there].tobytes(), value.tobytes()))
                rows.append((keys[turn % parts], 1, b"", meta.tobytes()))
                turn += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["key", "kind", "nodes", "body"])

    return run


def _long(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _found(kind: int, a, b, n=None, own=None, below=None, high=None, low=None, null=None) -> pa.RecordBatch:
    size, none = len(a), lambda t: pa.nulls(len(a), t)
    cols = [pa.array(np.full(size, kind, np.int32)), pa.array(a, pa.int64(), mask=null), pa.array(b, pa.int64())]
    for x, t in ((n, pa.int64()), (own, pa.int32()), (below, pa.int32()), (high, pa.int64()), (low, pa.int64())):
        cols.append(none(t) if x is None else pa.array(x, t))
    return pa.RecordBatch.from_arrays(cols, [f.split()[0] for f in _FOUND.split(", ")])


def _lists(short: int):
    """One partition's blocks to: kind 0 documents, kind 1 candidate pairs, kind 2 members of long lists (list, node, probe-only)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for key, kind, nodes, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 1:
                    m = np.frombuffer(body, _META)
                    yield _found(0, m["doc"], _long(m["node"].copy()), m["n"], m["own"], m["below"], _long(m["high"].copy()), _long(m["low"].copy()), m["null"].astype(bool))
                else:
                    value, names = np.frombuffer(body, np.uint64), np.frombuffer(nodes, np.uint64)
                    low = value & np.uint64(0xFFFF)
                    held.setdefault(key, []).append((value >> np.uint64(16), names[(low >> np.uint64(1)).astype(np.int64)], (low & np.uint64(1)).astype(np.uint8)))
        for key in list(held):
            sig, node, flag = (np.concatenate(c) for c in zip(*held.pop(key), strict=True))
            order = np.argsort(sig)
            sig = sig[order]
            same = sig[1:] == sig[:-1]
            shared = np.concatenate((same, [False])) | np.concatenate(([False], same))
            sig, node, flag = sig[shared], node[order][shared], flag[order][shared]
            del order, same, shared
            order = np.lexsort((flag, node, sig))
            sig, node, flag = sig[order], node[order], flag[order]
            # copies of a set that different tasks sent, and a set's probe beside its index entry
            first = np.concatenate(([True], (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])))[: len(sig)]
            sig, node, flag = sig[first], node[first], flag[first]
            if not len(sig):
                continue
            starts = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1])))
            sizes = np.diff(np.append(starts, len(sig)))
            names, number = np.unique(node, return_inverse=True)
            number = number.astype(np.uint64)
            pairs = []
            for g in range(2, short + 1):
                at = starts[sizes == g]
                for i, j in combinations(range(g), 2) if len(at) else ():
                    below = flag[at + i] | flag[at + j]
                    ok = (flag[at + i] & flag[at + j]) == 0
                    pairs.append((number[at + i] << np.uint64(32) | number[at + j] << np.uint64(1) | below)[ok])
            long = sizes > short
            if long.any():
                of = np.repeat(np.arange(len(starts)), sizes)
                some = long[of]
                yield _found(2, _long(sig[some] ^ np.uint64(key) << np.uint64(48)), _long(node[some]), flag[some].astype(np.int64), sizes[of[some]].astype(np.int32))
            if pairs:
                pairs, shared = np.unique(np.concatenate(pairs), return_counts=True)
                for i in range(0, len(pairs), 1 << 16):
                    p = pairs[i : i + (1 << 16)]
                    a, b = (p >> np.uint64(32)).astype(np.int64), (p >> np.uint64(1) & np.uint64(0x7FFFFFFF)).astype(np.int64)
                    yield _found(1, _long(names[a]), _long(names[b]), shared[i : i + (1 << 16)].astype(np.int64), (p & np.uint64(1)).astype(np.int32))

    return run


def _set_rows(words: int, salt: int):
    """Texts to (node, elements)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingler = Shingler(words, salt)
        for batch in batches:
            for part in slices(batch, "text"):
                raw = [s.tobytes() for s in shingler.sets(as_bytes(part.column("text"))) if len(s)]
                names = np.array([xxhash.xxh3_64_intdigest(r, 11) for r in raw], np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(_long(names), pa.int64()), pa.array(raw, pa.binary())], ["node", "elements"])

    return run


def _compare(percent: int):
    """Sets (kind 0) before the pairs (kind 1) of each bucket: the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sets = None, {}
        for batch in batches:
            a, b = [], []
            for k, kind, x, y, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "a", "b", "elements")), strict=True):
                if k != bucket:
                    bucket, sets = k, {}
                if kind == 0:
                    sets[x] = np.frombuffer(raw, np.uint64)
                    continue
                u, v = sets[x], sets[y]
                if 100 * min(len(u), len(v)) < percent * max(len(u), len(v)):
                    continue
                if len(u) > len(v):
                    u, v = v, u
                at = np.searchsorted(v, u)
                at[at == len(v)] = 0
                both = int((v[at] == u).sum())
                if 100 * both >= percent * (len(u) + len(v) - both):
                    a.append(x)
                    b.append(y)
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _mask_rows():
    """Sets (kind 0) before the pairs of a hub and a node (kind 1): which of the hub's elements the node has, as bits, and its others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, sets = None, {}
        for batch in batches:
            rows = []
            for k, kind, hub, node, raw in zip(*(batch.column(c).to_pylist() for c in ("bucket", "kind", "a", "b", "elements")), strict=True):
                if k != bucket:
                    bucket, sets = k, {}
                if kind == 0:
                    sets[hub] = np.frombuffer(raw, np.uint64)
                    continue
                u, v = sets[hub], sets[node]
                has = np.isin(u, v, assume_unique=True)
                rows.append((hub, node, np.packbits(has).tobytes(), v[np.isin(v, u, assume_unique=True, invert=True)].tobytes()))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["hub", "node", "mask", "others"])

    return run


def _block_pairs(percent: int):
    """Blocks of members of one hub, sorted by (hub, bi, bj): links between a probing x and a smaller y of another component.

    Two sets share what they share of the hub, counted by bits, and what they share of their others: the pair is decided exactly.
    Components that a link joins count as one from there on, so a block gives at most as many links as it has members."""

    def pairs(x: list, y: list) -> pa.RecordBatch | None:
        width = -(-max(len(r[3]) for r in x) // 8) * 8
        bits = np.frombuffer(b"".join(r[3].ljust(width, b"\0") for r in y), np.uint64).reshape(len(y), -1)
        node, label, n = (np.array([r[i] for r in y], np.int64) for i in (0, 1, 2))
        others = [np.frombuffer(r[4], np.uint64) for r in y]
        extra = np.array([len(o) for o in others], np.int64)
        joined: dict[int, int] = {}
        a, b = [], []
        for who, own, size, mask, rest in x:
            while own in joined:
                own = joined[own]
            rest = np.frombuffer(rest, np.uint64)
            ok = np.flatnonzero((label != own) & (n <= size) & (100 * n >= percent * size))
            if not len(ok):
                continue
            common = np.bitwise_count(bits[ok] & np.frombuffer(mask.ljust(width, b"\0"), np.uint64)).sum(axis=1).astype(np.int64)
            most = common + np.minimum(extra[ok], len(rest))
            may = 100 * most >= percent * (size + n[ok] - most)
            for i, both in zip(ok[may].tolist(), common[may].tolist(), strict=True):
                if label[i] == own:
                    continue
                both += len(np.intersect1d(others[i], rest, assume_unique=True))
                if 100 * both >= percent * (size + int(n[i]) - both):
                    a.append(min(int(node[i]), who))
                    b.append(max(int(node[i]), who))
                    joined[int(label[i])] = own
                    label[label == label[i]] = own
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"]) if a else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, x, y = None, [], []
        for batch in batches:
            for hub, bi, bj, side, *row in zip(*(batch.column(c).to_pylist() for c in ("hub", "bi", "bj", "side", "node", "label", "n", "mask", "others")), strict=True):
                if (hub, bi, bj) != key:
                    if x and y and (got := pairs(x, y)) is not None:
                        yield got
                    key, x, y = (hub, bi, bj), [], []
                (y if side else x).append(row)
        if x and y and (got := pairs(x, y)) is not None:
            yield got

    return run


#: Members of a hub that one task compares with as many others, and the bytes of their masks.
BLOCK_ROWS, BLOCK_BYTES = 4096, 1 << 25
#: Shares into which the members of each hub are dealt where the hubs are too many to broadcast.
SALTS = 16


def _across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members (hub, node, label, n, probing) of long lists with several components: links of a probing member and a smaller one of
    another component. Blocks of a hub's members meet in separate tasks, so no hub needs to fit one."""
    n = shuffle_partitions(members.sparkSession)
    asked = members.select(F.col("hub").alias("a"), F.col("node").alias("b"), F.pmod(F.xxhash64("node"), F.lit(2 * n)).cast("int").alias("bucket"))
    masks = _with_sets(asked, sets, n).mapInArrow(_mask_rows(), "hub long, node long, mask binary, others binary")
    rows = materialise(members.join(masks, ["hub", "node"]), "jaccard-masks")
    most = F.greatest(F.lit(16), F.least(F.lit(BLOCK_ROWS), F.lit(BLOCK_BYTES) / F.greatest(F.max(F.octet_length("mask") + F.octet_length("others")), F.lit(1))))
    blocks = materialise(rows.groupBy("hub").agg(F.ceil(F.count("*") / most).cast("int").alias("blocks")), "jaccard-hubs")
    # a row for each hub: broadcast up to a checked number, beyond it dealt by hub and salt, so that no hub's members meet in one task
    if blocks.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(blocks), "hub")
    else:
        salted = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int")).join(salted, ["hub", "salt"]).drop("salt")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    columns = ["node", "label", "n", "mask", "others"]
    x = rows.where("probing").select("hub", F.col("own").alias("bi"), F.col("other").alias("bj"), F.lit(0).alias("side"), *columns)
    y = rows.select("hub", F.col("other").alias("bi"), F.col("own").alias("bj"), F.lit(1).alias("side"), *columns)
    dealt = x.unionByName(y).repartition(n, "hub", "bi", "bj").sortWithinPartitions("hub", "bi", "bj")
    return dealt.mapInArrow(_block_pairs(percent), "a long, b long")


def _with_sets(counted: DataFrame, sets: DataFrame, n: int) -> DataFrame:
    """Pairs (bucket, a, b) with the sets their buckets need, each sent once to a bucket: sorted by bucket, sets first."""
    asked = materialise(counted.select("bucket", F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-asked")
    # requests are broadcast up to a checked number; beyond it both sides are dealt by node
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_IDS else asked
    sent = sets.join(asked, "node").select("bucket", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "elements")
    told = counted.select("bucket", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("elements"))
    return sent.unionByName(told).repartition(n, "bucket").sortWithinPartitions("bucket", "kind")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets link. Bucketed by the member with fewer pairs; a set is sent once to each bucket that asks for it."""
    n = shuffle_partitions(pairs.sparkSession)
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").count()
    counted = pairs.join(degree.select(F.col("node").alias("a"), F.col("count").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("count").alias("db")), "b")
    many = 2 * n
    counted = counted.select("a", "b", F.pmod(F.xxhash64(F.when(F.col("da") <= F.col("db"), F.col("a")).otherwise(F.col("b"))), F.lit(many)).cast("int").alias("bucket"))
    return _with_sets(counted, sets, n).mapInArrow(_compare(percent), "a long, b long")


def _sets_of(df: DataFrame, docs: DataFrame, nodes: DataFrame, words: int, salt: int) -> DataFrame:
    """(node, elements) of the nodes, and perhaps of others, shingled again from one text each."""
    members = docs.where("n_shingles > 0").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    members = materialise(members, "jaccard-members")
    ids = members.where("doc_id is not null").select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = df.join(ids, "doc_id", "left_semi")
    if members.where("doc_id is null").limit(1).count():  # nodes without an id: all such texts are shingled again
        texts = texts.unionByName(df.where("doc_id is null"))
    return materialise(texts.mapInArrow(_set_rows(words, salt), "node long, elements binary"), "jaccard-sets")


def _partition_keys(spark, n: int) -> list[int]:
    """For each of n partitions an integer that hash partitioning sends there, so blocks are dealt evenly."""
    got = spark.range(64 * n).select(F.col("id").cast("int").alias("id")).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).collect()
    if len(got) < n:
        return list(range(n))
    return [r.id for r in sorted(got, key=lambda r: r.p)]


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, short: int = SHORT, salts: int = 8) -> DataFrame:
    """A row per input row: doc_id, n_shingles, component_id. Ids are compared in their own type; integers come out as long."""
    if not isinstance(df.schema[id_col].dataType, (ByteType, ShortType, IntegerType, LongType)):
        return _by_rows(df, id_col, text_col, words=words, percent=percent, short=short, salts=salts)
    df = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    for salt in range(salts):
        with temporary() as keep:
            out = _join(df, words, percent, short, salt)
            if out is not None:
                return keep(materialise(out, "jaccard-components"))
    raise RuntimeError("no salt gave every set an allocation and every set a name of its own")


def _by_rows(df: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    """similar() for ids that are no integers: rows are numbered, and a component's smallest id is found afterwards."""
    with temporary() as keep:
        return keep(materialise(_named(df, id_col, text_col, options), "jaccard-components"))


def _named(df: DataFrame, id_col: str, text_col: str, options: dict) -> DataFrame:
    rows = materialise(df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "jaccard-rows")
    found = similar(rows, "row", "text", **options).withColumnRenamed("doc_id", "row").join(rows.select("row", "doc_id"), "row")
    found = materialise(found, "jaccard-named")
    least = found.groupBy("component_id").agg(F.min("doc_id").alias("least"))
    return found.join(least, "component_id").select("doc_id", "n_shingles", F.col("least").alias("component_id"))


def _join(df: DataFrame, words: int, percent: int, short: int, salt: int) -> DataFrame | None:
    spark = df.sparkSession
    n = min(shuffle_partitions(spark), 1 << 16)
    blocks = df.mapInArrow(_blocks(_partition_keys(spark, n), words, percent, salt), _BLOCK)
    found = materialise(blocks.repartition(n, "key").mapInArrow(_lists(short), _FOUND), "jaccard-lists")
    docs = found.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("node"), F.col("n").alias("n_shingles"), "own", "below", "high", "low")
    classes = docs.where("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("rep"), F.max("n_shingles").alias("n"), F.max("own").alias("own"), F.max("below").alias("below"), F.min("high").alias("h0"), F.max("high").alias("h1"), F.min("low").alias("l0"), F.max("low").alias("l1"))
    if docs.where("own < 0 or below < 0").limit(1).count() or classes.where("h0 <> h1 or l0 <> l1").limit(1).count():
        return None
    # long lists: every set leaves out its longest ones, as many as its allocation has to spare (one shuffle, by node)
    entries = found.where("kind = 2").select(F.col("a").alias("list"), F.col("b").alias("node"), F.col("n").cast("int").alias("probe"), F.col("own").alias("size"))
    entries = entries.repartition(n, "node").join(classes.select("node", "own", "below").hint("shuffle_merge"), "node")
    own = Window.partitionBy("node", "probe")
    place = F.row_number().over(own.orderBy(F.desc("size"), "list"))
    spare = F.when(F.col("probe") == 1, F.col("below")).otherwise(F.col("own"))
    entries = entries.withColumn("probing", place > spare).withColumn("held", F.count("*").over(own).cast("int"))
    entries = materialise(entries.select("list", "node", "probe", "held", "probing"), "jaccard-entries")
    # the member of most long lists is the most central one: edited copies differ less from it than from one another (one shuffle, by list)
    dealt = entries.select("list", "node", "held", "probing").repartition(n, "list")
    hubs = dealt.groupBy("list").agg(F.max(F.struct("held", "node")).alias("hub"), F.max("probing").alias("probed")).where("probed").select("list", F.col("hub.node").alias("hub"))
    members = materialise(dealt.join(hubs.hint("shuffle_merge"), "list").groupBy("hub", "node").agg(F.max("probing").alias("probing")), "jaccard-members")
    stars = members.where("probing and hub <> node").select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()
    # short lists: linked sets share more lists than the larger one has to spare; some of these may be long
    counted = found.where("kind = 1").groupBy("a", "b", F.col("own").alias("probe")).agg(F.sum("n").alias("shared"))
    held = entries.groupBy("node", "probe").agg(F.max("held").alias("long"))
    for side in ("a", "b"):
        own = classes.select(F.col("node").alias(side), F.col("n").alias(f"n_{side}"), F.col("own").alias(f"own_{side}"), F.col("below").alias(f"below_{side}"))
        counted = counted.join(own, side)
    own, below = (F.when(F.col("n_a") >= F.col("n_b"), F.col(f"{x}_a")).otherwise(F.col(f"{x}_b")) for x in ("own", "below"))
    counted = counted.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").withColumn("needed", F.when(F.col("probe") == 1, below).otherwise(own) + 1)
    enough = counted.where("shared >= needed").select("a", "b")
    rest = counted.where("shared < needed").withColumn("larger", F.when(F.col("n_a") >= F.col("n_b"), F.col("a")).otherwise(F.col("b")))
    rest = rest.join(held.withColumnRenamed("node", "larger"), ["larger", "probe"]).where("shared + long >= needed").select("a", "b")
    pairs = materialise(enough.unionByName(rest).unionByName(stars).distinct(), "jaccard-pairs")
    nodes = materialise(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "jaccard-nodes")
    sets = _sets_of(df, docs, nodes, words, salt)
    links = materialise(_verified(pairs, sets, percent), "jaccard-links")
    labels = materialise(components(links), "jaccard-labels")
    # hubs whose lists hold several components still: their pairs across components
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("hub").agg(F.min("label").alias("l0"), F.max("label").alias("l1")).where("l0 <> l1").select("hub")
    several = labelled.join(mixed, "hub", "left_semi").join(classes.select("node", "n"), "node")
    several = materialise(several.select("hub", "node", "label", "n", "probing"), "jaccard-several")
    if several.limit(1).count():
        others = several.select("node").distinct().join(nodes, "node", "left_anti")
        sets = sets.unionByName(_sets_of(df, docs, materialise(others, "jaccard-more-nodes"), words, salt))
        more = materialise(_across(several, sets, percent), "jaccard-more-links")
        if more.limit(1).count():
            labels = materialise(components(links.unionByName(more)), "jaccard-labels")
    reps = classes.select("node", "rep").join(labels, "node", "left").select("node", "rep", F.coalesce("label", "node").alias("label"))
    reps = materialise(reps, "jaccard-reps")
    linked = reps.join(labels.select(F.col("label")).distinct(), "label", "left_semi").groupBy("label").agg(F.min("rep").alias("least"))
    reps = reps.join(linked, "label", "left").select("node", F.coalesce("least", "rep").alias("component_id"))
    full = docs.where("n_shingles > 0").join(reps, "node").select("doc_id", "n_shingles", "component_id")
    return full.unionByName(docs.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))
