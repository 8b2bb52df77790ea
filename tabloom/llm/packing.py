"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Documents are encoded by a public tokenizer, closed by one end id, and only those
longer than the capacity are cut.  What has to be packed is then a number of
pieces of each length, a histogram with at most ``capacity`` entries whatever the
corpus, and the driver packs that histogram alone:

* pieces over one third of the capacity are matched at most twice a bin, each
  longest one with the longest that still fits;
* smaller pieces, longest first, go to the bins with the tightest gap that holds
  them; what fits nowhere opens bins, filled in the same way.

Equal bins are handled as one entry with a count, so the plan has a bounded
number of rows.  Pieces of a length are numbered in parallel (salted by a hash,
so a length that a third of all pieces share is spread over many tasks) and each
finds its bin and offset in the plan by its number.

Null and empty texts are one piece holding the end id.  A very long text becomes
many pieces.  Repeated rows are packed as often as they come; rows with equal
ids are kept apart by nothing but their place.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, chunks, runs, save, span_hash

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Distinct words whose ids a Python worker remembers.
REMEMBER = 300_000


#: The rules of normalising and splitting under which words can be encoded alone; other vocabularies encode whole texts.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def by_words(path: str) -> bool:
    """Whether a tokenizer file has the rules under which words can be encoded alone."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return all(spec.get(k) == v for k, v in WORD_RULES.items()) and all(t["content"].startswith("<|") for t in spec.get("added_tokens", []))


class WordEncoder:
    """Encodes texts as the tokenizer does, but each distinct word of a pass once.

    A text is cut at ASCII white space, and between an ASCII letter and an ASCII
    sign other than the apostrophe; the tokenizer's own splitting cuts there
    too, and no rule of its normaliser crosses such a place.  A text that could
    hold a special token's string is encoded whole, and so are all texts by a
    tokenizer of other rules.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = by_words(path)
        if not self.words:
            return
        self.known: dict[int, int] = {}
        self.pool = np.zeros(1 << 16, np.uint32)
        self.n_ids = 0
        (self.bar,) = self.tokenizer.encode("|", add_special_tokens=False).ids
        letter = np.zeros(256, bool)
        letter[97:123] = True
        sign = np.zeros(256, bool)
        sign[[c for c in range(33, 127) if not chr(c).isalnum() and c != 39]] = True
        self.kind = letter.astype(np.uint8) + 2 * sign.astype(np.uint8)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids of all words, and how many each has. Many words are encoded as one text, each followed by a bar;
        no word has a bar (see kind), so the bar's id stands for the ends of words only."""
        joined = [" | ".join(words[i : i + 512]) + " |" for i in range(0, len(words), 512)]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)])
        end = np.flatnonzero(ids == self.bar)
        return ids[ids != self.bar], np.diff(end, prepend=-1) - 1

    def _learn(self, keys: list[int], words: list[str]) -> None:
        plain = [i for i, w in enumerate(words) if "|" not in w]
        ids, sizes = self._encode_words([words[i] for i in plain]) if plain else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        if len(plain) < len(words):
            other = [i for i, w in enumerate(words) if "|" in w]
            found = self._encode([words[i] for i in other])
            plain, sizes = plain + other, np.append(sizes, [len(x) for x in found])
            ids = np.concatenate((ids, *(np.array(x, np.uint32) for x in found)))
        while self.n_ids + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(len(self.pool), np.uint32)))
        self.pool[self.n_ids : self.n_ids + len(ids)] = ids
        ends = self.n_ids + np.cumsum(sizes)
        # a word's place in the pool and its size in one number
        self.known.update(zip((keys[i] for i in plain), (((ends - sizes) << 24) | sizes).tolist(), strict=True))
        self.n_ids += len(ids)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of all texts, one after the other, and their offsets."""
        if not self.words:
            raw = data.tobytes()
            parts = self._encode([raw[a:b].decode() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            return np.array([i for p in parts for i in p], np.uint32), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        low = LOWER[data]
        starts, ends = runs(NOT_SPACE[low], off)
        kind = self.kind[low]
        cut = np.flatnonzero((kind[:-1] | kind[1:]) == 3) + 1
        cut = cut[(kind[cut - 1] != 0) & (kind[cut] != 0)]
        if len(cut):
            word = np.searchsorted(starts, cut, "right") - 1
            inside = (word >= 0) & (cut > starts[word]) & (cut < ends[word])
            cut = cut[inside]
            starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        keys = span_hash(low, starts, ends)
        unique, first, back = np.unique(keys, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBER:
            self.known, self.n_ids = {}, 0
        listed = unique.tolist()
        slot = np.fromiter(map(self.known.get, listed, repeat(-1)), np.int64, len(listed))
        new = np.flatnonzero(slot < 0)
        if len(new):
            raw = low.tobytes()
            at = first[new]
            self._learn(unique[new].tolist(), [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)])
            slot[new] = np.fromiter(map(self.known.get, unique[new].tolist()), np.int64, len(new))
        slot = slot[back]
        begin, size = slot >> 24, slot & ((1 << 24) - 1)
        total = np.concatenate((np.zeros(1, np.int64), np.cumsum(size)))
        ids = self.pool[np.arange(total[-1]) - np.repeat(total[:-1] - begin, size)]
        bounds = total[np.searchsorted(starts, off)]
        return self._special(data, off, ids, bounds)

    def _special(self, data: np.ndarray, off: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124)) if len(data) > 1 else np.zeros(0, np.int64)
        docs = np.unique(np.searchsorted(off, mark, "right") - 1) if len(mark) else []
        if not len(docs):
            return ids, bounds
        raw = data.tobytes()
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(off) - 1)]
        for i, whole in zip(docs, self._encode([raw[off[i] : off[i + 1]].decode() for i in docs]), strict=True):
            parts[i] = np.asarray(whole, np.uint32)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """id, piece, start, length, ids_crc32; with keep_ids the piece's ids as well (array of int)."""
    kind = docs.schema[id_col].dataType.simpleString()

    def encode(batches) -> Iterator:
        import os

        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordEncoder(tokenizer_path)
        for batch in batches:
            for part in chunks(batch.column(1)):
                ids, bounds = encoder.encode(part.data, part.off)
                n = len(part)
                doc, piece, start, length, crc, kept = [], [], [], [], [], []
                for i in range(n):
                    own = np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        got = own[at : at + capacity]
                        doc.append(part.first + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(got))
                        crc.append(zlib.crc32(got.tobytes()))
                        if keep_ids:
                            kept.append(got.astype(np.int32))
                cols = [batch.column(0).take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["__id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    out = docs.select(F.col(id_col), F.col(text_col)).mapInArrow(encode, f"__id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)
    return out.withColumnRenamed("__id", id_col)


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(length, first number, last number + 1, first bin, offset) for pieces numbered from 0 within their length."""
    left = {k: v for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int]] = []
    bins = 0
    gaps: list[int] = []  # sorted gaps that some bin has
    open_: dict[int, list[tuple[int, int]]] = {}  # gap -> (first bin, how many)

    def put(length: int, n: int, first_bin: int, offset: int) -> None:
        plan.append((length, used[length], used[length] + n, first_bin, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, first_bin: int, n: int) -> None:
        if gap > 0:
            if gap not in open_:
                open_[gap] = []
                insort(gaps, gap)
            open_[gap].append((first_bin, n))

    large = sorted(k for k in left if 3 * k > capacity)
    for length in reversed(large):
        while left[length]:
            i = bisect_left(large, capacity - length + 1) - 1
            while i >= 0 and left[large[i]] < (2 if large[i] == length else 1):  # none left beside the piece itself
                i -= 1
            mate = large[i] if i >= 0 else None
            n = left[length]
            if mate == length:
                n //= 2
            elif mate is not None:
                n = min(n, left[mate])
            put(length, n, bins, 0)
            if mate is not None:
                put(mate, n, bins, length)
            leave(capacity - length - (mate or 0), bins, n)
            bins += n
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            i = bisect_left(gaps, length)
            if i == len(gaps):  # opens bins, each with as many of this length as fit
                each = min(capacity // length, left[length])
                n = left[length] // each
                for k in range(each):
                    put(length, n, bins, k * length)
                leave(capacity - each * length, bins, n)
                bins += n
                continue
            gap = gaps[i]
            first_bin, n = open_[gap].pop()
            each = min(gap // length, left[length])
            take = min(n, left[length] // each)
            for k in range(each):
                put(length, take, first_bin, capacity - gap + k * length)
            if take < n:
                open_[gap].append((first_bin + take, n - take))
            if not open_[gap]:
                del open_[gap]
                gaps.pop(i)
            leave(gap - each * length, first_bin, take)
    return plan


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """pieces (with ``length`` from 1 to capacity) with sequence_id and offset; order names the columns that tell pieces apart."""
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(pack_histogram(counts, capacity), "p_length long, p_from long, p_to long, p_bin long, p_offset long")
    plan = plan.groupBy("p_length").agg(F.sort_array(F.collect_list(F.struct("p_from", "p_to", "p_bin", "p_offset"))).alias("steps"))
    salts = max(8, -(-sum(counts.values()) // 20_000))
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    numbered = salted.withColumn("__n", F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order)) - 1)
    numbered = numbered.join(sizes, ["length", "__salt"]).withColumn("__n", F.col("__n") + F.col("__before"))
    # at most `capacity` rows, each a length with the steps of its plan
    placed = numbered.join(F.broadcast(plan), F.col("length") == F.col("p_length"))
    step = F.filter("steps", lambda s: (s["p_from"] <= F.col("__n")) & (F.col("__n") < s["p_to"]))[0]
    placed = placed.withColumn("__step", step)
    return placed.select(*[F.col(c) for c in pieces.columns], (F.col("__step.p_bin") + F.col("__n") - F.col("__step.p_from")).alias("sequence_id"), F.col("__step.p_offset").alias("offset"))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = save(tokenized_pieces(docs, tokenizer_path, id_col, text_col, capacity, end_id), "pieces")
    return pack(pieces, [id_col, "piece", "ids_crc32"], capacity)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_best_fit_packing(spark, sf_dir):
    from .common import table

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary_path())
