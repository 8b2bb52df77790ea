"""Exact removal of repeated byte strings with run-compressed Burrows-Wheeler transforms.

Every byte covered by a ``LENGTH``-byte string that also starts earlier in the
corpus is removed.  The corpus is dealt into groups that can be judged alone:

1. The least hash of a window's 32-byte grams is its anchor, so equal windows
   have equal anchors.  Neighbouring windows with one anchor place form a piece.
   Pieces are sorted by anchor and content; all pieces with the same content but
   the first are repeats as a whole.  Contents are compared by 64-bit hashes there.
   A passage that stands twice in a chunk of texts is remembered by its task, and
   only the first piece of it that the task has seen goes to its anchor, so that a
   passage of all documents is a row or so of its anchor for each task.
2. Only pieces whose anchor has several contents (or a tie within itself) are
   fetched as bytes.  Sorted by anchor, they are read in buckets of about a
   megabyte.  A bucket's Burrows-Wheeler transform is cut into runs of one
   symbol; the suffixes at the run ends are sampled with their longest common
   prefix; streaming over the text, each suffix takes the last sample less the
   distance to it, which gives the matching statistics of every position.  Long
   matches chain suffixes into classes of equal windows, and all but the first of
   a class are marked.
3. An anchor with more pieces than ``many``, or more bytes than a bucket may hold,
   gets its windows dealt singly by their hash, so no anchor has to pass through a
   task; of a window that stands more often than that, the first is found by a
   partial aggregate and sent to all others.

Documents are ordered by id (null first).  Rows with one id and one text are one
document, each returned; rows with one id and different texts are ordered by a
hash of the text.  Null, empty and shorter texts keep every byte; a very long text
needs memory for itself and its marks.  An empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _TABLE, MIX, U, chunks, save, span_hash, splitmix, spread

LENGTH, GRAM = 100, 32
WINDOWS = LENGTH - GRAM + 1
#: Bytes of pieces that one transform takes, and that one anchor may have before its windows are dealt singly.
BUCKET, MOST = 1 << 20, 1 << 24
#: Pieces of one anchor, and places of one window, that one task sees at most; beyond HUBS such anchors or windows, more.
MANY, HUBS = 32_768, 1_000_000
#: Repeated contents that a task remembers at most (24 bytes each).
REMEMBERED = 200_000
#: A document's number among those of its id stands above this bit of a position.
COPY = 40
_NULL = -(1 << 63)


def _least(keys: np.ndarray, n: int) -> np.ndarray:
    """The least of each WINDOWS consecutive keys."""
    m, w = keys, 1
    while 2 * w <= WINDOWS:
        m = np.minimum(m[:-w], m[w:])
        w *= 2
    return np.minimum(m[:n], m[WINDOWS - w : WINDOWS - w + n])


def pieces(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, start, windows, tie) of all pieces of the texts; starts count from the array's start."""
    n = len(data) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none.astype(np.uint64), none, none, none.astype(bool)
    x = _TABLE[data]
    for k, p in enumerate((1, 2, 4, 8, 16)):
        x = x[:-p] * MIX[k] + (x[p:] ^ (x[p:] >> U(31)))
    x = splitmix(x) & ~U(127)
    place = np.arange(len(x), dtype=np.uint64) & U(127)
    first, last = _least(x | place, n), _least(x | (U(127) - place), n)
    across = np.zeros(n + 1, np.int32)
    edges = off[1:-1]
    np.add.at(across, np.clip(edges - LENGTH + 1, 0, n), 1)
    np.add.at(across, np.clip(edges, 0, n), -1)
    valid = np.cumsum(across[:-1]) == 0
    differs = first[1:] != first[:-1]
    new, end = valid.copy(), valid.copy()
    new[1:] &= ~valid[:-1] | differs
    end[:-1] &= ~valid[1:] | differs
    start, stop = np.flatnonzero(new), np.flatnonzero(end)
    if not len(start):
        return none.astype(np.uint64), none, none, none.astype(bool)
    tie = ((first & U(127)) != (U(127) - (last & U(127)))) & valid
    return first[start] & ~U(127), start, stop - start + 1, np.logical_or.reduceat(tie, start)


def repeated_windows(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For texts in order, whether a LENGTH-byte window starts at each byte that also starts at an earlier byte."""
    n = len(data)
    size = np.diff(off)
    left = np.repeat(off[1:], size) - np.arange(n)
    key = np.zeros(n, np.uint64)
    symbol = data.astype(np.uint64) + U(1)
    for k in range(7):
        key <<= U(9)
        key[: n - k] |= np.where(left[: n - k] > k, symbol[k:], U(0))
    ranks, depths, depth = [], [], 7
    longest = int(size.max(initial=0))
    while True:
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate((np.zeros(1, np.int64), np.cumsum(sorted_[1:] != sorted_[:-1])))
        ranks.append(rank.astype(np.int32))
        depths.append(depth)
        if depth >= longest or rank.max() == n - 1:
            break
        key = rank * (n + 1)
        key[: n - depth] += np.where(left[: n - depth] > depth, rank[depth:] + 1, 0)
        depth *= 2
    # order is the suffix array of texts that end in distinct ends, ordered as the texts are
    begins = np.zeros(n, bool)
    begins[off[:-1]] = True
    before = order - 1
    symbols = np.where(begins[order], -1, data[before].astype(np.int16))
    head = np.ones(n, bool)
    head[1:] = (symbols[1:] != symbols[:-1]) | (symbols[1:] < 0)
    # samples at the run ends: the longest common prefix of each run's first suffix with the last of the run before
    j = np.flatnonzero(head)
    a, b = order[j].copy(), order[np.maximum(j - 1, 0)].copy()
    common = np.zeros(len(j), np.int64)
    most = np.minimum(left[a], left[b])
    for d, rank in sorted(zip(depths, ranks, strict=True), key=lambda x: -x[0]):
        inside = common + d <= most
        at_a, at_b = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        same = inside & (rank[at_a] == rank[at_b])
        common += np.where(same, d, 0)
    for _ in range(6):
        inside = common < most
        at_a, at_b = np.minimum(a + common, n - 1), np.minimum(b + common, n - 1)
        common += inside & (data[at_a] == data[at_b])
    common[j == 0] = 0
    # streamed in text order: a position inside a run has one symbol less in common than the position before it
    sampled = np.full(n, -1, np.int64)
    value = np.zeros(n, np.int64)
    value[order[j]] = common
    sampled[order[j]] = order[j]
    sampled = np.maximum.accumulate(sampled)
    statistics = value[sampled] - (np.arange(n) - sampled)
    first = np.flatnonzero(statistics[order] < LENGTH)
    earliest = np.minimum.reduceat(order, first)
    repeated = np.zeros(n, bool)
    repeated[order] = order != np.repeat(earliest, np.diff(np.append(first, n)))
    return repeated


def _arrays(batch, *names):
    return [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names]


def _emit(**columns):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _mask(flags: np.ndarray):
    import pyarrow as pa

    return pa.array(flags)


class _Seen:
    """The earliest place of contents that a task has seen repeated, up to REMEMBERED of them (the rest is judged at its anchor)."""

    def __init__(self):
        self.key, self.doc, self.pos = (np.zeros(0, np.int64) for _ in range(3))

    def earlier(self, key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For pieces with distinct keys: whether the task has seen the content earlier in the corpus, and whether at this very place."""
        later, same = np.zeros(len(key), bool), np.zeros(len(key), bool)
        if not len(self.key):
            return later, same
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        i = np.flatnonzero(self.key[at] == key)
        j = at[i]
        same[i] = (doc[i] == self.doc[j]) & (pos[i] == self.pos[j])
        later[i] = ((doc[i] > self.doc[j]) | ((doc[i] == self.doc[j]) & (pos[i] > self.pos[j])))
        first = i[~later[i]]
        self.doc[at[first]], self.pos[at[first]] = doc[first], pos[first]
        return later, same

    def add(self, key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> None:
        new = ~np.isin(key, self.key)
        if not new.any() or len(self.key) >= REMEMBERED:
            return
        key, doc, pos = (np.concatenate(x) for x in ((self.key, key[new]), (self.doc, doc[new]), (self.pos, pos[new])))
        order = np.argsort(key, kind="stable")
        self.key, self.doc, self.pos = key[order], doc[order], pos[order]


def _cut(batches) -> Iterator:
    """(doc, copy, text) to pieces."""
    seen = _Seen()
    for batch in batches:
        doc, copy = _arrays(batch, "doc", "copy")
        for part in chunks(batch.column(batch.schema.get_field_index("text"))):
            anchor, start, windows, tie = pieces(part.data, part.off)
            if len(start):
                i = np.searchsorted(part.off, start, "right") - 1
                content = span_hash(part.data, start, start + windows + LENGTH - 1).view(np.int64)
                anchor, own, pos = anchor.view(np.int64), doc[part.first + i], (copy[part.first + i] << COPY) + start - part.off[i]
                # of equal pieces the earliest goes to its anchor; the others are repeats wherever they are dealt to
                order = np.lexsort((pos, own, content, anchor))
                anchor, content, own, pos, windows, tie = (x[order] for x in (anchor, content, own, pos, windows, tie))
                whole, twin = np.zeros(len(order), bool), np.zeros(len(order), bool)
                whole[1:] = (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1])
                twin[1:] = whole[1:] & (own[1:] == own[:-1]) & (pos[1:] == pos[:-1])
                key = (splitmix(anchor.view(np.uint64)) ^ content.view(np.uint64)).view(np.int64)
                first = np.flatnonzero(~whole)
                whole[first], twin[first] = seen.earlier(key[first], own[first], pos[first])
                common = first[np.append(whole[1:], False)[first] & ~whole[first]]
                seen.add(key[common], own[common], pos[common])
                dealt = np.where(whole, splitmix((own * 31 + pos).view(np.uint64)).view(np.int64), anchor)
                kept = ~twin
                yield _emit(dealt=dealt[kept], anchor=anchor[kept], content=content[kept], doc=own[kept], pos=pos[kept], windows=windows[kept].astype(np.int32), tie=tie[kept], whole=whole[kept])


def _judge(batches) -> Iterator:
    """Pieces sorted by anchor, content, doc and pos: whole repeats (fetch false), and pieces to compare (fetch true).

    One pass with one held row: the first content of the anchor read last."""
    last, held, contents = None, None, 0
    for batch in batches:
        sure = batch.column(batch.schema.get_field_index("whole")).to_numpy(zero_copy_only=False)
        if sure.any():
            at = np.flatnonzero(sure)
            yield _emit(**{c: x[at] for c, x in zip(("anchor", "doc", "pos", "windows"), _arrays(batch, "anchor", "doc", "pos", "windows"), strict=True)}, fetch=np.zeros(len(at), bool))
            batch = batch.filter(_mask(~sure))
        if not batch.num_rows:
            continue
        anchor, content, doc, pos, windows, tie = _arrays(batch, "anchor", "content", "doc", "pos", "windows", "tie")
        before = (lambda x, k: np.concatenate(([x[0] if last is None else last[k]], x[:-1])))
        new_anchor = anchor != before(anchor, 0)
        new = new_anchor | (content != before(content, 1))
        twin = ~new & (doc == before(doc, 2)) & (pos == before(pos, 3))
        if last is None:
            new_anchor[0], new[0], twin[0] = True, True, False
        group = np.cumsum(new_anchor)  # 0: the anchor read last
        n = np.bincount(group[new], minlength=group[-1] + 1)
        n[0] += contents
        fetch = new & ((n[group] >= 2) | tie)
        whole = ~new & ~twin
        kept = np.flatnonzero(fetch | whole)
        if held is not None and n[0] >= 2:
            yield _emit(**{k: np.array([v]) for k, v in held.items()}, fetch=np.array([True]))
            held = None
        if len(kept):
            yield _emit(anchor=anchor[kept], doc=doc[kept], pos=pos[kept], windows=windows[kept], fetch=fetch[kept])
        if group[-1] > 0:
            held = None
        contents = int(n[-1])
        alone = np.flatnonzero(new & (group == group[-1]))
        if contents == 1 and len(alone) and not tie[alone[0]]:
            i = alone[0]
            held = {"anchor": anchor[i], "doc": doc[i], "pos": pos[i], "windows": windows[i]}
        last = (anchor[-1], content[-1], doc[-1], pos[-1])


def _marked(batches) -> Iterator:
    """(doc, copy, text, marks) to the marked pieces of each chunk of texts: the chunk, and doc, pos, begin, windows, anchor of each."""
    for batch in batches:
        marks = batch.column(batch.schema.get_field_index("marks"))
        at = np.asarray(marks.offsets)
        flat = marks.flatten()
        base = at[0]
        pos, windows, anchor = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "windows", "anchor"))
        doc, copy = _arrays(batch, "doc", "copy")
        for part in chunks(batch.column(batch.schema.get_field_index("text"))):
            lo, hi = at[part.first] - base, at[part.first + len(part)] - base
            row = np.searchsorted(at - base, np.arange(lo, hi), "right") - 1
            begin = part.off[row - part.first] + (pos[lo:hi] & ((1 << COPY) - 1))
            yield part, doc[row], pos[lo:hi], begin, windows[lo:hi].astype(np.int64), anchor[lo:hi]


def _fetch(batches) -> Iterator:
    """The bytes of each marked piece."""
    import pyarrow as pa

    for part, doc, pos, begin, windows, anchor in _marked(batches):
        raw = part.data.tobytes()
        text = pa.array([raw[a:b] for a, b in zip(begin.tolist(), (begin + windows + LENGTH - 1).tolist(), strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(pos), text], names=["anchor", "doc", "pos", "bytes"])


def _windows(batches) -> Iterator:
    """The hash of each window of each marked piece."""
    for part, doc, pos, begin, windows, anchor in _marked(batches):
        for i in range(0, len(windows), 4096):
            n = windows[i : i + 4096]
            row = i + np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = begin[row] + k
            yield _emit(anchor=anchor[row], hash=span_hash(part.data, at, at + LENGTH).view(np.int64), doc=doc[row], pos=pos[row] + k)


_FOUND = "single boolean, anchor long, hash long, doc long, pos long, windows int"


def _compare(batches) -> Iterator:
    """Pieces sorted by anchor, doc and pos to repeated windows (single false), or all windows of overfull anchors (single true)."""
    anchors, docs, places, texts, size = [], [], [], [], 0
    over = None

    def spans():
        data = np.frombuffer(b"".join(texts), np.uint8)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
        flag = repeated_windows(data, off)
        begin = flag.copy()
        starts_text = np.zeros(len(flag), bool)
        starts_text[off[:-1]] = True
        begin[1:] &= ~flag[:-1] | starts_text[1:]
        end = flag.copy()
        end[:-1] &= ~flag[1:] | starts_text[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(end) + 1
        row = np.searchsorted(off, s, "right") - 1
        zero = np.zeros(len(s), np.int64)
        return _emit(single=np.zeros(len(s), bool), anchor=zero, hash=zero, doc=np.array(docs)[row], pos=np.array(places)[row] + s - off[row], windows=(e - s).astype(np.int32))

    def singles():
        for i in range(0, len(texts), 4096):
            data = np.frombuffer(b"".join(texts[i : i + 4096]), np.uint8)
            size_ = np.array([len(t) for t in texts[i : i + 4096]])
            off = np.concatenate(([0], np.cumsum(size_)))
            n = size_ - LENGTH + 1
            row = np.repeat(np.arange(len(n)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            at = off[row] + k
            yield _emit(single=np.ones(len(row), bool), anchor=np.full(len(row), over), hash=span_hash(data, at, at + LENGTH).view(np.int64), doc=np.array(docs[i : i + 4096])[row], pos=np.array(places[i : i + 4096])[row] + k, windows=np.ones(len(row), np.int32))

    for batch in batches:
        for anchor, doc, pos, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if anchors and anchor != anchors[-1]:
                if over is not None:
                    yield from singles()
                elif size >= BUCKET:
                    yield spans()
                if over is not None or size >= BUCKET:
                    anchors, docs, places, texts, size = [], [], [], [], 0
                over = None
            if size >= MOST:
                first = next(i for i, a in enumerate(anchors) if a == anchors[-1])
                if first:  # whole anchors before the overfull one
                    mine = [x[first:] for x in (anchors, docs, places, texts)]
                    del anchors[first:], docs[first:], places[first:], texts[first:]
                    yield spans()
                    anchors, docs, places, texts = mine
                over = anchor
                yield from singles()
                anchors, docs, places, texts, size = [], [], [], [], 0
            anchors.append(anchor)
            docs.append(doc)
            places.append(pos)
            texts.append(text)
            size += len(text)
    if texts:
        if over is not None:
            yield from singles()
        else:
            yield spans()


def _later(batches) -> Iterator:
    """Single windows sorted by anchor, hash, doc and pos: all but the first of each hash."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = _arrays(batch, "anchor", "hash", "doc", "pos")
        same = np.ones(len(cols[0]), bool)
        for k in (0, 1):
            same &= cols[k] == np.concatenate(([cols[k][0] if last is None else last[k]], cols[k][:-1]))
        if last is None:
            same[0] = False
        last = [c[-1] for c in cols]
        i = np.flatnonzero(same)
        yield _emit(doc=cols[2][i], pos=cols[3][i], windows=np.ones(len(i), np.int32))


def _finish(batches) -> Iterator:
    """(id, text, spans) to what is left of each text."""
    import pyarrow as pa

    for batch in batches:
        marks = batch.column(2)
        at = np.asarray(marks.offsets) - np.asarray(marks.offsets)[0]
        flat = marks.flatten()
        pos, windows = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("pos", "windows"))
        pos = pos & ((1 << COPY) - 1)
        for part in chunks(batch.column(1)):
            raw, rows = part.data.tobytes(), []
            for i in range(len(part)):
                text = raw[part.off[i] : part.off[i + 1]]
                lo, hi = at[part.first + i], at[part.first + i + 1]
                if lo == hi:
                    rows.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), []))
                    continue
                order = np.argsort(pos[lo:hi], kind="stable")
                s = pos[lo:hi][order]
                e = np.maximum.accumulate(s + windows[lo:hi][order] + LENGTH - 1)
                new = np.concatenate(([True], s[1:] > e[:-1]))
                s, e = s[new], e[np.concatenate((np.flatnonzero(new)[1:] - 1, [len(e) - 1]))]
                left = hashlib.sha256()
                for a, b in zip([0, *e.tolist()], [*s.tolist(), len(text)], strict=True):
                    left.update(text[a:b])
                rows.append((len(text), int((e - s).sum()), len(s), left.hexdigest(), [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), span), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.first, len(part)), *cols], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed"])


def _repeated(windows: DataFrame, many: int) -> DataFrame:
    """doc and pos of all places (anchor, hash, doc, pos) of each window but the first."""
    key = ["anchor", "hash"]
    most = max(many, -(-windows.count() // HUBS))
    common = windows.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos")).alias("first")).filter(F.col("n") > most)
    common = F.broadcast(save(common.select(*key, "first"), "common"))  # HUBS at most
    spread_ = windows.join(common, key).filter(F.struct("doc", "pos") != F.col("first")).select("doc", "pos", F.lit(1).alias("windows"))
    calm = windows.join(common, key, "left_anti").select(*key, "doc", "pos").repartition(*key).sortWithinPartitions(*key, "doc", "pos")
    return spread_.unionByName(calm.mapInArrow(_later, "doc long, pos long, windows int"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", many: int = MANY) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256, removed (array of start and end in bytes)."""
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    if docs.groupBy("doc").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count():
        copy = F.dense_rank().over(Window.partitionBy("doc").orderBy(F.xxhash64("text"), "text")) - 1
        docs = save(docs.withColumn("copy", copy.cast("long")), "documents")
    else:
        docs = docs.withColumn("copy", F.lit(0).cast("long"))
    own = docs.select("doc", "copy", "text")
    cut = own.mapInArrow(_cut, "dealt long, anchor long, content long, doc long, pos long, windows int, tie boolean, whole boolean")
    cut = cut.repartition("dealt").sortWithinPartitions("dealt", "content", "doc", "pos").drop("dealt")
    judged = save(cut.mapInArrow(_judge, "anchor long, doc long, pos long, windows int, fetch boolean"), "pieces")
    number = F.shiftright("pos", COPY).alias("copy")
    marked = lambda rows: own.join(rows.groupBy("doc", number).agg(F.collect_list(F.struct("pos", "windows", "anchor")).alias("marks")), ["doc", "copy"])
    fetch = judged.filter("fetch")
    most = max(many, -(-fetch.count() // HUBS))
    busy = save(fetch.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("anchor"), "busy")
    single = []
    if busy.limit(1).count():
        single.append(marked(fetch.join(F.broadcast(busy), "anchor", "left_semi")).mapInArrow(_windows, "anchor long, hash long, doc long, pos long"))  # HUBS at most
        fetch = fetch.join(F.broadcast(busy), "anchor", "left_anti")
    # few bytes, but a lot of work for each: tasks by rows, not by bytes
    fetched = marked(fetch).mapInArrow(_fetch, "anchor long, doc long, pos long, bytes binary")
    fetched = fetched.repartition(spread(fetch, 10_000), "anchor").sortWithinPartitions("anchor", "doc", "pos")
    found = save(fetched.mapInArrow(_compare, _FOUND), "matches")
    spans = judged.filter("NOT fetch").select("doc", "pos", "windows").unionByName(found.filter("NOT single").select("doc", "pos", "windows"))
    if found.filter("single").limit(1).count():
        single.append(found.filter("single").select("anchor", "hash", "doc", "pos"))
    if single:
        windows = single[0] if len(single) == 1 else single[0].unionByName(single[1])
        spans = spans.unionByName(_repeated(save(windows, "windows"), many))
    spans = spans.groupBy("doc", number).agg(F.collect_list(F.struct("pos", "windows")).alias("spans"))
    none = F.array().cast("array<struct<pos:bigint,windows:int>>")
    whole = docs.join(spans, ["doc", "copy"], "left").select("id", "text", F.coalesce("spans", none).alias("spans"))
    return whole.mapInArrow(_finish, f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start:long,end:long>>").withColumnRenamed("id", id_col)


def op1_suffix_dedup(spark, sf_dir):
    from .common import table

    return remove_repeats(table(spark, sf_dir, "documents")).drop("removed")
