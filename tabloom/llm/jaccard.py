"""Exact Jaccard self-join of shingle sets, with an R-tree over count vectors.

A document's set holds the hashes of its distinct 5-word shingles.  Equal sets are
one node, named by a hash of the set (its print); a second hash tells apart sets
whose prints collide.

Hashes are ordered from rare to frequent: what stands often enough in the whole
corpus comes last, the least frequent of it first.  Two sets whose Jaccard similarity
reaches 4/5 share one of the first fifth of each set's hashes in that order, so nodes
meet only in the postings of those hashes (their prefix).

A set of SECTION or more shingles is dealt into sections by hash, twice as many for
each doubling, so that a section holds SECTION / 2 to SECTION of them.  If two sets
reach 4/5 so does one of their pairs of sections, for the shares of the sections
average to the whole; hence sections meet, each with a vector of its own, and what a
posting carries doesn't grow with the document.  A set that may link with smaller
ones of the level below also stands there.

A section's shingles are counted in GROUPS groups by hash.  The overlap of two
sections is at most the sum of the coordinate minima of their count vectors, and in a
large posting the vectors are packed into the leaves of an R-tree (by size, then by
the widest coordinates): two leaves are compared only if the minima of their boxes'
upper corners leave room for the overlap that their sizes ask for, and then two
points by the same bound.  Where two sections first meet, the hashes before that
place are not common, which bounds the overlap as well.  Pairs that survive are
verified on the whole sets.

A posting is cut into chains, in which each section is at least 4/5 of the size of
the next; only members of a chain can link.  In a chain of at most FEW all surviving
pairs are verified.  In a longer one each node is first verified against one
partner, again and again on what is then one component, until a round joins nothing;
last, all surviving pairs between different components are.  That makes the result
exact.  A pair is taken where its sections first meet: each row carries the hashes
of the last places where its section met others.  A chain with more than ``hot`` rows
is dealt into blocks by size and each pair of blocks that sizes allow is a task's
work.

Null, empty and blank texts have an empty set and link with nothing; with fewer
than five words the whole sequence is one shingle.  Very long texts need memory for
one text's hashes.  Ids come in only at the end, and a component is named by the
smallest id in it.  Rows that share an id are one document with several texts, and
so in one component.  A text with a null id is a document of its own: its component
is null unless it is linked with another id.  An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, MIX, NOT_SPACE, U, chunks, forget, runs, save, span_hash, splitmix
from .components import DEGREE, HUBS, components

SHINGLE, GROUPS, LEAF = 5, 256, 64
#: The largest count that a vector keeps; what exceeds it is bounded by the sizes.
FULL = 15
#: Sets of so many shingles are dealt into sections of fewer.
SECTION = 512
#: Chains up to this length have all their pairs verified at once.
FEW = 8
#: Rows of a chain that stand in one block; a plan's limit, results are the same for any.
HOT = 1 << 15
#: Leaders that a long chain offers its nodes in a round (the last round is exact for any number).
LEADERS = 64
#: Rounds after the first; the last takes all pairs that are left.
ROUNDS = 2
#: Earlier meeting places that a row knows.
BEFORE = 4
#: Hashes that one task counts together, and how often a hash must stand among them to be counted as frequent at all.
COUNTED, OFTEN = 1 << 20, 4
#: At most so many hashes are frequent: those that are more than this share of all.
FREQUENT = 1_000_000
#: Nodes (24 bytes each) that are broadcast at most to fetch their texts.
NEEDED = 1_000_000
_NO_ID = (1 << 63) - 1
_48 = (1 << 48) - 1


def _shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in their order, and their offsets."""
    low = LOWER[data]
    starts, ends = runs(NOT_SPACE[low], off)
    word = span_hash(low, starts, ends)
    first = np.searchsorted(starts, off)
    count = np.diff(first)
    shingles = np.where(count >= SHINGLE, count - SHINGLE + 1, np.minimum(count, 1))
    total = np.concatenate(([0], np.cumsum(shingles)))
    at = np.arange(total[-1]) + np.repeat(first[:-1] - total[:-1], shingles)
    short = np.repeat(count < SHINGLE, shingles)
    h = np.zeros(len(at), np.uint64)
    padded = np.append(word, np.zeros(SHINGLE, np.uint64))
    for k in range(SHINGLE):
        h += padded[at + k] * MIX[k]
    size = np.full(len(at), SHINGLE, np.uint64)
    for i in np.flatnonzero(short).tolist():
        own = word[at[i] : at[i] + count[np.searchsorted(total, i, "right") - 1]]
        size[i] = len(own)
        h[i] = (own * np.array(MIX[: len(own)])).sum()
    return splitmix(h + size), total


def shingle_sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after the other, and their offsets."""
    h, at = _shingles(data, off)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        h[a:b].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[at[:-1][np.diff(at) > 0]] = True
    return h[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def prefix_length(n):
    """How many of the first hashes of a set of n any set that links with it must meet."""
    return np.where(n > 0, n - (4 * n + 4) // 5 + 1, 0)


def level_of(n):
    """0 below SECTION shingles, and one more for each doubling; a set of level k has 2 ** k sections."""
    return np.maximum(0, np.floor(np.log2(np.maximum(n, 1) / SECTION)).astype(np.int64) + 1)


def section_of(low, level):
    """The section of 48-bit hashes in sets of a level."""
    return (low >> 12) & ((1 << level) - 1)


def _pack(low: np.ndarray) -> np.ndarray:
    """48-bit hashes, 6 bytes each."""
    return np.ascontiguousarray(low.astype(np.int64).view(np.uint8).reshape(-1, 8)[:, :6])


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view(np.int64).ravel()


def _halves(counts: np.ndarray) -> np.ndarray:
    """Rows of counts, at most FULL, two to a byte: group i with group i + half of them."""
    half = counts.shape[1] // 2
    counts = np.minimum(counts, FULL).astype(np.uint8)
    return counts[:, :half] | (counts[:, half:] << 4)


def _counts(raw: list[bytes]) -> np.ndarray:
    """Count vectors, one a row."""
    packed = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return np.concatenate((packed & 15, packed >> 4), axis=1)


def _prints(h: np.ndarray, at: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each set; 0 for empty ones."""
    some = n > 0
    out = [np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)]
    if some.any():
        for x, salt in zip(out, (U(3), U(5)), strict=True):
            x[some] = splitmix(np.add.reduceat(splitmix(h + salt), at[:-1][some]) + n[some].astype(np.uint64)).view(np.int64)
    return out


def _binaries(data: np.ndarray, sizes: np.ndarray):
    """An Arrow column of consecutive pieces of data."""
    import pyarrow as pa

    off = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))]).cast(pa.binary())


def _often(batches) -> Iterator:
    """(text) to hashes that stand OFTEN or more times among COUNTED ones of a task, with their counts; -1 counts all."""
    import pyarrow as pa

    held, size, total = [], 0, 0

    def counted():
        h = np.sort(np.concatenate(held))
        new = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        count = np.diff(np.append(new, len(h)))
        keep = count >= OFTEN
        return pa.RecordBatch.from_arrays([pa.array(h[new[keep]]), pa.array(count[keep])], names=["hash", "count"])

    for batch in batches:
        for part in chunks(batch.column(0)):
            low = (_shingles(part.data, part.off)[0] >> U(16)).astype(np.int64)
            held.append(low)
            size += len(low)
            total += len(low)
            if size >= COUNTED:
                yield counted()
                held, size = [], 0
    if size:
        yield counted()
    yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([total])], names=["hash", "count"])


def frequent_hashes(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes that are frequent in all texts, sorted, and the binary logarithms of their counts; at most FREQUENT.

    Any order of the hashes gives the same links; this one keeps widely shared passages out of prefixes."""
    counts = save(docs.select("text").mapInArrow(_often, "hash long, count long").groupBy("hash").agg(F.sum("count").alias("count")), "often")
    total = counts.filter("hash = -1").agg(F.sum("count")).first()[0] or 0
    found = counts.filter((F.col("hash") >= 0) & (F.col("count") > max(4 * OFTEN, total // FREQUENT))).orderBy("hash").toArrow()
    return found.column(0).to_numpy(), np.minimum(np.log2(found.column(1).to_numpy()), 31).astype(np.uint8)


def _profile(frequent: tuple[np.ndarray, np.ndarray]):
    """(id, text, key) to a row for each section: id, key, n, print, other (a second print), tag, size, vector, prefix, first (of its text)."""
    common, heat = frequent

    def sections(low, rank, at, level, native):
        """Columns of the sections of sets low[at[i]:at[i + 1]], each of its level; sets without one (level -1) are left out."""
        doc = np.repeat(np.arange(len(level)), np.diff(at))
        low, rank, doc = (x[level[doc] >= 0] for x in (low, rank, doc))
        section = section_of(low, level[doc])
        # the hashes of a set are in order already; a stable sort keeps that within section and rank
        order = np.argsort((doc << 43) | (section << 5) | rank, kind="stable") if section.any() or rank.any() else slice(None)
        low, section, doc = low[order], section[order], doc[order]
        new = np.ones(len(low), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (section[1:] != section[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(low)))
        of = np.cumsum(new) - 1
        vector = np.bincount(of * GROUPS + (low & (GROUPS - 1)), minlength=len(start) * GROUPS).reshape(-1, GROUPS)
        prefix = prefix_length(size)
        inside = np.arange(len(low)) - start[of] < prefix[of] if len(start) else np.zeros(0, bool)
        tag = (level[doc[start]] << 40 | section[start]) << 1 | int(native)
        return doc[start], tag, size, _halves(vector), _pack(low[inside]), prefix

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for part in chunks(batch.column(1)):
                h, at = shingle_sets(part.data, part.off)
                n = np.diff(at)
                some = n > 0
                prints, other = _prints(h, at, n)
                low = (h >> U(16)).astype(np.int64)
                rank = np.zeros(len(low), np.uint8)
                if len(common):
                    i = np.minimum(np.searchsorted(common, low), len(common) - 1)
                    rank = np.where(common[i] == low, heat[i], 0).astype(np.uint8)
                level = level_of(n)
                down = some & (level > 0) & (level_of(-(-4 * n // 5)) < level)
                made = [sections(low, rank, at, np.where(some, level, -1), True), sections(low, rank, at, np.where(down, level - 1, -1), False)]
                none = np.flatnonzero(~some)
                made.append((none, np.zeros(len(none), np.int64), np.zeros(len(none), np.int64), np.zeros((len(none), GROUPS // 2), np.uint8), np.zeros((0, 6), np.uint8), np.zeros(len(none), np.int64)))
                doc, tag, size, vector, prefix, count = (np.concatenate(x) for x in zip(*made, strict=True))
                first = np.zeros(len(doc), bool)
                first[np.unique(doc, return_index=True)[1]] = True
                cols = [pa.array(n[doc]), pa.array(prints[doc], mask=~some[doc]), pa.array(other[doc]), pa.array(tag), pa.array(size), _binaries(vector, np.full(len(doc), GROUPS // 2)), _binaries(prefix, 6 * count), pa.array(first)]
                rows = pa.array(doc)
                given = [batch.column(i).slice(part.first, len(part)).take(rows) for i in (0, 2)]
                yield pa.RecordBatch.from_arrays([*given, *cols], names=["id", "key", "n", "print", "other", "tag", "size", "vector", "prefix", "first"])

    return run


def _post(batches) -> Iterator:
    """(print, tag, size, prefix) to a row for each hash of the prefix: hash and level in one, and size, place and native in another."""
    import pyarrow as pa

    for batch in batches:
        own, tag, n = (batch.column(i).to_numpy() for i in range(3))
        raw = batch.column(3).to_pylist()
        size = np.array([len(x) // 6 for x in raw], np.int64)
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        tag, n = np.repeat(tag, size), np.repeat(n, size)
        yield pa.RecordBatch.from_arrays([pa.array(_unpack(b"".join(raw)) | (tag >> 41) << 48), pa.array(n << 32 | place << 1 | tag & 1), pa.array(np.repeat(own, size))], names=["hash", "pack", "print"])


def _shared(batches) -> Iterator:
    """Rows sorted by hash, pack and print that have another row of their hash near their size: with their tag, the number of their chain, whether it is long, and their place in it."""
    import pyarrow as pa

    def out(cols, few):
        h, pack, own, chain, place = cols
        level = h >> 48
        tag = (level << 40 | section_of(h & _48, level)) << 1 | pack & 1
        return pa.RecordBatch.from_arrays([*map(pa.array, (h, pack, own, tag, chain, place)), pa.array(np.full(len(h), not few) if isinstance(few, bool) else ~few)], names=["hash", "pack", "print", "tag", "chain", "place", "long"])

    held, open_ = None, False  # the last chain while it is short, or its last row once it is known to be long
    for batch in batches:
        if not batch.num_rows:
            continue
        h, pack, own = (c.to_numpy() for c in batch.columns)
        chain, place = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        if held is not None:
            h, pack, own = (np.concatenate(x) for x in zip(held[:3], (h, pack, own), strict=True))
        size = pack >> 32
        new_hash = np.ones(len(h), bool)
        new_hash[1:] = h[1:] != h[:-1]
        new = new_hash.copy()
        new[1:] |= 5 * size[:-1] < 4 * size[1:]
        number, start = np.cumsum(new) - 1, np.flatnonzero(new)
        # chains are named by the size of their first member, which tells those of a hash apart
        chain, place = size[start][number], np.arange(len(h)) - start[number]
        skip = 0
        if held is not None:
            chain[number == 0], place[number == 0] = held[3][0], place[number == 0] + held[4][0]
            skip = 1 if open_ else 0  # that row is out already
        count = np.bincount(number)
        count[0] += int(held[4][0]) if held is not None else 0
        last = number == number[-1]
        is_long = count[-1] > FEW
        give = (count[number] > 1) & ~last
        if is_long:
            give |= last
        give[:skip] = False
        i = np.flatnonzero(give)
        if len(i):
            yield out([x[i] for x in (h, pack, own, chain, place)], count[number[i]] <= FEW)
        rest = np.flatnonzero(last)[-1:] if is_long else np.flatnonzero(last)
        held, open_ = [x[rest] for x in (h, pack, own, chain, place)], bool(is_long)
    if held is not None and not open_ and len(held[0]) > 1:
        yield out(held, True)


def _allows(bound, n_a, n_b):
    """Whether an overlap of at most bound can reach a similarity of 4/5."""
    return 9 * bound >= 4 * (n_a + n_b)


def _meets(a, b, n, rest):
    """Whether sizes allow a link, and the hashes from the meeting place on its overlap."""
    return (5 * n[a] >= 4 * n[b]) & (5 * n[b] >= 4 * n[a]) & _allows(np.minimum(rest[a], rest[b]), n[a], n[b])


def _bounded(a: np.ndarray, b: np.ndarray, n: np.ndarray, v: np.ndarray, over: np.ndarray) -> np.ndarray:
    """Pairs whose coordinate minima leave room; over is what each point has beyond its vector's counts."""
    ok = np.zeros(len(a), bool)
    for at in range(0, len(a), 1 << 14):
        i, j = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
        least = np.minimum(v[i], v[j]).sum(1, dtype=np.int64)
        ok[at : at + (1 << 14)] = _allows(least + np.minimum(over[i], over[j]), n[i], n[j])
    return ok


class Points:
    """Rows of postings: sizes, what is left from the meeting place on, vectors, and what decides which pairs count."""

    __slots__ = ("before", "comp", "h", "n", "native", "node", "over", "rest", "side", "v")

    def __init__(self, h, pack, node, v, before, comp=None, side=None):
        self.h, self.node, self.v, self.before, self.comp, self.side = h, node, v, before, comp, side
        self.n, self.native = pack >> 32, (pack & 1).astype(bool)
        self.rest = self.n - ((pack & 0xFFFFFFFF) >> 1)
        self.over = self.n - v.sum(1, dtype=np.int64)

    def may(self, a, b, once=True):
        """Which of the pairs of rows count, before their vectors are looked at; with once only where they first meet."""
        ok = _meets(a, b, self.n, self.rest) & (self.native[a] | self.native[b]) & (self.node[a] != self.node[b])
        if self.comp is not None:
            ok &= self.comp[a] != self.comp[b]
        if self.side is not None:
            ok &= self.side[a] != self.side[b]
        if once:
            i = np.flatnonzero(ok)
            x, y = self.before[a[i]], self.before[b[i]]
            met = np.zeros(len(i), bool)
            for k in range(BEFORE):
                met |= ((x[:, k : k + 1] == y) & (x[:, k : k + 1] >= 0)).any(1)
            ok[i[met]] = False
        return ok

    def pairs(self, a, b, once=True):
        keep = self.may(a, b, once)
        a, b = a[keep], b[keep]
        ok = _bounded(a, b, self.n, self.v, self.over)
        return a[ok], b[ok]

    def part(self, x: slice, side: bool) -> Points:
        out = Points.__new__(Points)
        for name in self.__slots__:
            value = getattr(self, name)
            setattr(out, name, None if value is None or (name == "side" and not side) else value[x])
        return out


def tree_pairs(p: Points) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of points that count and whose bound allows a link, by an R-tree of one level over the leaves."""
    wide = np.argsort(-p.v.std(axis=0))[:2]
    slab = (np.log(np.maximum(p.n, 1)) * 20).astype(np.int64)
    order = np.lexsort((p.v[:, wide[1]], p.v[:, wide[0]], slab))
    leaves = [order[i : i + LEAF] for i in range(0, len(order), LEAF)]
    top = np.stack([p.v[x].max(axis=0) for x in leaves])
    lo, hi, over = np.array([p.n[x].min() for x in leaves]), np.array([p.n[x].max() for x in leaves]), np.array([p.over[x].max() for x in leaves])
    one = np.array([p.comp[x[0]] for x in leaves]) if p.comp is not None else None
    pure = np.array([(p.comp[x] == p.comp[x[0]]).all() for x in leaves]) if p.comp is not None else None
    found_a, found_b = [], []
    for i, x in enumerate(leaves):
        j = np.arange(i, len(leaves))
        j = j[(5 * hi[j] >= 4 * lo[i]) & (5 * hi[i] >= 4 * lo[j])]
        j = j[_allows(np.minimum(top[i], top[j]).sum(1, dtype=np.int64) + np.minimum(over[i], over[j]), lo[i], lo[j])]
        if one is not None and pure[i]:
            j = j[~pure[j] | (one[j] != one[i])]
        for y in (leaves[k] for k in j):
            a, b = np.repeat(x, len(y)), np.tile(y, len(x))
            if x is y:
                a, b = a[a < b], b[a < b]
            a, b = p.pairs(a, b)
            found_a.append(a)
            found_b.append(b)
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _all_pairs(p: Points, start: np.ndarray, size: np.ndarray, most: int) -> list:
    """Pairs of the runs of at most ``most`` rows, all runs of a size at once."""
    found = []
    for k in np.unique(size[(size >= 2) & (size <= most)]).tolist():
        rows = start[size == k]
        i, j = np.triu_indices(k, 1)
        step = max(1, (1 << 16) // len(i))
        for at in range(0, len(rows), step):
            x = rows[at : at + step, None] + np.arange(k)
            found.append(p.pairs(x[:, i].ravel(), x[:, j].ravel()))
    return found


def _leader_pairs(p: Points, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """Each point with the first of some leaders that its bound allows; another turn has other leaders."""
    rank = splitmix(p.node.view(np.uint64) + U(turn)) if turn else p.node
    order = np.argsort(rank, kind="stable")
    leader = np.full(len(p.n), -1)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    if p.comp is not None:  # a leader of each of the largest components, so that what stands apart meets them
        _, heads, members = np.unique(p.comp[order], return_index=True, return_counts=True)
        lead = order[heads[np.argsort(-members, kind="stable")[:LEADERS]]]
    else:
        lead = order[:LEADERS]
    for x in lead:
        free = np.flatnonzero(leader < 0)
        free = free[(place[free] > place[x]) | (p.comp is not None)]
        a, _ = p.pairs(free, np.full(len(free), x), once=False)
        leader[a] = x
    a = np.flatnonzero(leader >= 0)
    return a, leader[a]


def _match(kind: str, turn: int = 0):
    """Rows sorted by hash, chain, block, other, pack to pairs (a, b) of nodes, a the larger.

    few: all pairs of short chains; leaders: one partner for each node; rest: all pairs across components."""

    def pairs_of(h, chain, block, other, side, pack, node, raw, before, comp):
        import pyarrow as pa

        p = Points(h, pack, node, _counts(raw.tolist()), before, comp, side)
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (chain[1:] != chain[:-1]) | (block[1:] != block[:-1]) | (other[1:] != other[:-1])
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, len(h)))
        found = []
        if kind == "few":
            p.side = None
            found = _all_pairs(p, start, size, FEW)
        else:
            for s, k in zip(start.tolist(), size.tolist(), strict=True):
                if comp is not None and (comp[s : s + k] == comp[s]).all():
                    continue
                part = p.part(slice(s, s + k), block[s] != other[s])
                if kind == "leaders":
                    a, b = _leader_pairs(part, turn)
                elif k <= LEAF:
                    i, j = np.triu_indices(k, 1)
                    a, b = part.pairs(i, j)
                else:
                    a, b = tree_pairs(part)
                found.append((a + s, b + s))
        a = node[np.concatenate([x for x, _ in found])] if found else np.zeros(0, np.int64)
        b = node[np.concatenate([y for _, y in found])] if found else np.zeros(0, np.int64)
        if kind != "leaders":
            a, b = np.maximum(a, b), np.minimum(a, b)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        keep = np.ones(len(a), bool)
        keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    def run(batches) -> Iterator:
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns[:7]]
            raw = np.empty(batch.num_rows, object)
            raw[:] = batch.column(7).to_pylist()
            before = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[8 : 8 + BEFORE]], axis=1)
            new = [*cols, raw, before, batch.column(8 + BEFORE).to_numpy() if batch.num_columns > 8 + BEFORE else cols[6]]
            kept = new if kept is None else [np.concatenate(x) for x in zip(kept, new, strict=True)]
            if len(kept[0]) < 1 << 15:
                continue
            cut = int(np.argmax(np.logical_and.reduce([kept[i] == kept[i][-1] for i in range(4)])))
            if cut:
                yield pairs_of(*(x[:cut] for x in kept[:-1]), kept[-1][:cut] if batch.num_columns > 8 + BEFORE else None)
                kept = [x[cut:] for x in kept]
        if kept is not None and len(kept[0]):
            yield pairs_of(*kept[:-1], kept[-1] if batch.num_columns > 8 + BEFORE else None)

    return run


def _sets(batches) -> Iterator:
    """(text, node, other) to node and set where the text has that second print."""
    import pyarrow as pa

    for batch in batches:
        own = batch.column(2).to_numpy()
        for part in chunks(batch.column(0)):
            h, at = shingle_sets(part.data, part.off)
            n = np.diff(at)
            _, other = _prints(h, at, n)
            keep = np.flatnonzero((n > 0) & (other == own[part.first : part.first + len(part)]))
            data = _pack((h >> U(16)).astype(np.int64))
            found = pa.array([data[at[i] : at[i + 1]].tobytes() for i in keep.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(1).take(pa.array(keep + part.first)), found], names=["node", "set"])


def _verify(batches) -> Iterator:
    """(a, b, set of a, set of b) to the pairs whose similarity reaches 4/5."""
    import pyarrow as pa

    for batch in batches:
        ok = []
        for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            both = np.sort(np.concatenate((_unpack(x), _unpack(y))), kind="stable")
            ok.append(bool(_allows(int((both[1:] == both[:-1]).sum()), len(x) // 6, len(y) // 6)))
        keep = pa.array(np.flatnonzero(ok))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep)], names=["a", "b"])


def _linked(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, repeats: bool) -> DataFrame:
    """The pairs (a, b) that are links; nodes has print, other, and id and key of one of its texts; docs has id, key and text, with repeats some id twice."""
    need = pairs.select(F.col("a").alias("print")).unionByName(pairs.select(F.col("b").alias("print"))).distinct()
    need = save(need.join(nodes, "print").select("id", "key", F.col("print").alias("node"), "other"), "needed")
    # four numbers a row: up to NEEDED rows they go to all tasks, beyond that texts are shuffled to them
    sets = docs.join(F.broadcast(need) if need.count() <= NEEDED else need, ["id", "key"]).select("text", "node", "other").mapInArrow(_sets, "node long, set binary")
    sets = save(sets.dropDuplicates(["node"]) if repeats else sets, "sets")
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("set_b")), "b")
    return save(both.select("a", "b", "set_a", "set_b").mapInArrow(_verify, "a long, b long"), "verified")


_KEYS = ["hash", "chain", "block", "other"]
_ROW = [*_KEYS, "side", "pack", "node", "vector", *(f"before{k}" for k in range(1, BEFORE + 1))]


def _whole(rows: DataFrame) -> DataFrame:
    """Rows of chains that are one block."""
    return rows.withColumns({"block": F.lit(0).cast("long"), "other": F.lit(0).cast("long"), "side": F.lit(0)}).select(_ROW)


def _blocks(rows: DataFrame, hot: int) -> DataFrame:
    """Rows with block, other and side; those of a chain with more than hot rows stand in each pair of blocks that sizes allow."""
    key = ["hash", "chain"]
    busy = rows.filter(F.col("place") >= hot).select(key).distinct()
    if not busy.limit(1).count():
        return _whole(rows)
    parts = rows.join(busy, key).withColumns({"part": F.floor(F.col("place") / (hot // 2 or 1)), "n": F.shiftright("pack", 32)})
    sizes = parts.groupBy(*key, "part").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    x, y = sizes.select(*key, F.col("part").alias("block"), "hi"), sizes.select(F.col("hash").alias("h"), F.col("chain").alias("c"), F.col("part").alias("other"), "lo")
    meet = x.join(y, (F.col("hash") == F.col("h")) & (F.col("chain") == F.col("c")) & (F.col("block") <= F.col("other")) & (5 * F.col("hi") >= 4 * F.col("lo"))).select(*key, "block", "other")
    left = meet.select("*", F.col("block").alias("part"), F.lit(0).alias("side"))
    right = meet.filter("block < other").select("*", F.col("other").alias("part"), F.lit(1).alias("side"))
    dealt = parts.join(left.unionByName(right), [*key, "part"]).select(_ROW)
    return _whole(rows.join(busy, key, "left_anti")).unionByName(dealt)


def _matched(rows: DataFrame, kind: str, turn: int = 0) -> DataFrame:
    return rows.repartition(*_KEYS).sortWithinPartitions(*_KEYS, "pack", "node").mapInArrow(_match(kind, turn), "a long, b long")


def _named(profile: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The profile, and its nodes: print, id and key of one text, other, copies.  Sets that share a print by chance get prints of their own."""
    nodes = lambda p: save(p.filter("first AND n > 0").groupBy("print").agg(F.min("id").alias("id"), F.min_by("key", "id").alias("key"), F.min("other").alias("other"), F.max("other").alias("most"), F.count("*").alias("copies")), "nodes")
    found = nodes(profile)
    clash = found.filter("other <> most").select("print", F.lit(True).alias("clash"))
    if clash.limit(1).count():
        profile = profile.join(clash, "print", "left").withColumn("print", F.when(F.col("clash"), F.xxhash64("print", "other")).otherwise(F.col("print")))
        profile = save(profile.drop("clash"), "profiles")
        found = nodes(profile)
    return profile, found.drop("most")


def _links(profile: DataFrame, nodes: DataFrame, docs: DataFrame, repeats: bool, same: DataFrame | None, hot: int) -> DataFrame:
    """Links (a, b) between prints that join all nodes of a component; same: pairs that are linked in any case."""
    sections = profile.filter("n > 0").groupBy("print", "tag").agg(*(F.first(c).alias(c) for c in ("size", "vector", "prefix")))
    sections = save(sections, "sections")
    forget(profile)
    post = sections.select("print", "tag", "size", "prefix").mapInArrow(_post, "hash long, pack long, print long")
    shared = post.repartition("hash").sortWithinPartitions("hash", "pack", "print").mapInArrow(_shared, "hash long, pack long, print long, tag long, chain long, place long, long boolean")
    own = Window.partitionBy("print", "tag").orderBy("pack")
    shared = save(shared, "shared")
    posted = shared.join(sections.select("print", "tag", "vector"), ["print", "tag"])
    posted = posted.withColumns({f"before{k}": F.coalesce(F.lag("hash", k).over(own), F.lit(-1)) for k in range(1, BEFORE + 1)}).withColumnRenamed("print", "node").drop("tag")
    posted = save(posted, "postings")
    forget(shared, sections)
    pairs = _matched(_whole(posted.filter("NOT long")), "few").distinct()
    rows = _blocks(posted.filter("long"), hot)
    led = lambda found: found.groupBy("a").agg(F.min("b").alias("b"))
    links = _linked(save(pairs.unionByName(led(_matched(rows, "leaders"))).distinct(), "pairs"), nodes, docs, repeats)
    if same is not None:
        links = save(links.unionByName(same), "linked")
    for turn in range(1, ROUNDS + 1):
        part = components(links)
        labelled = rows.join(part, "node", "left").select(*_ROW, F.coalesce("component", "node").alias("component"))
        last = turn == ROUNDS
        pairs = save(_matched(labelled, "rest").distinct() if last else led(_matched(labelled, "leaders", turn)), "pairs")
        more = _linked(pairs, nodes, docs, repeats) if pairs.limit(1).count() else pairs
        # a component is a star of its smallest node, so links don't add up from round to round
        links = save(part.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more), "linked")
    forget(posted)
    return links


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """id, n_shingles, component_id."""
    kind = docs.schema[id_col].dataType
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("key", F.xxhash64("text"))
    profile = docs.select("id", "text", "key").mapInArrow(_profile(frequent_hashes(docs)), "id long, key long, n long, print long, other long, tag long, size long, vector binary, prefix binary, first boolean")
    profile, nodes = _named(save(profile, "profiles"))
    texts = save(profile.filter("first").select("id", "key", "n", "print", "other"), "texts")
    again = texts.groupBy("id").agg(F.count("*").alias("rows"), F.count("print").alias("filled"), F.min("print").alias("lo"), F.max("print").alias("hi"))
    again = save(again.filter("rows > 1"), "again")
    repeats = bool(again.limit(1).count())
    again = again.filter(F.col("id") != _NO_ID)
    same = None
    if again.filter("lo <> hi").limit(1).count():  # the texts of an id
        same = texts.filter("n > 0").select("id", "print").join(again.filter("lo <> hi").select("id", "lo"), "id")
        same = same.filter("print <> lo").select(F.col("print").alias("a"), F.col("lo").alias("b")).distinct()
    links = _links(profile, nodes, docs, repeats, same, hot)
    found = nodes.select("print", "id").join(components(links).withColumnRenamed("node", "print"), "print")
    names = found.groupBy("component").agg(F.min("id").alias("name"))
    found = found.join(names, "component").select("print", "name")
    found = nodes.join(found, "print", "left").select("print", F.coalesce("name", "id").alias("component"), "copies")
    # texts with many copies are HUBS at most; their rows stay where they are
    many = max(DEGREE, -(-texts.count() // HUBS))
    hubs = found.filter(F.col("copies") > many).select("print", F.col("component").alias("hub"))
    marked = texts.select("id", F.col("n").alias("n_shingles"), "print").join(F.broadcast(hubs), "print", "left")
    calm = marked.filter("hub IS NULL").drop("hub").join(found.filter(F.col("copies") <= many).drop("copies"), "print", "left")
    out = calm.unionByName(marked.filter("hub IS NOT NULL").withColumnRenamed("hub", "component"))
    mixed = again.filter("filled > 0 AND filled < rows").select("id")
    if mixed.limit(1).count():  # rows without words of an id that has texts as well
        of_id = out.join(mixed, "id").groupBy("id").agg(F.min("component").alias("own"))
        out = out.join(of_id, "id", "left").withColumn("component", F.coalesce("component", "own"))
    given = lambda c: F.when(c != _NO_ID, c).cast(kind)
    return out.select(given(F.col("id")).alias(id_col), "n_shingles", given(F.coalesce("component", "id")).alias("component_id"))


def op6_jaccard_join(spark, sf_dir):
    from .common import table

    return near_duplicates(table(spark, sf_dir, "documents"))


OP6_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT r.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id"""
