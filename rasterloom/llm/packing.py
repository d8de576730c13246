"""Packing documents into fixed sequences by cutting-stock column generation.

1. One pass tokenizes each whole text, appends the end id and cuts at multiples of the capacity, so only documents longer
   than a sequence are cut. A piece's class is its length in steps of `grain`, rounded up. The pass also gives
   each piece its rank among the pieces of its class in its partition; the table is written once, so ranks are final.
2. The histogram of classes (capacity/grain rows at most) goes to the driver. A linear program over patterns, multisets
   of classes that fit a sequence, minimises the number of sequences. Its columns are generated: a knapsack dynamic
   program over the dual prices finds the pattern that helps most, until Farley's bound proves the gap small.
3. Pattern counts are rounded down; what is left, a few pieces a pattern, is packed first-fit-decreasing.
4. A piece's global rank in its class is its local rank plus the counts of earlier partitions. Each pattern owns an
   interval of ranks in each class it holds, so a rank gives the sequence and the slot without any search over documents.
5. Offsets are running sums of true lengths within a sequence, which has capacity/grain pieces at most.

Nulls, ties, empties: a null or empty text is the end id alone. Repeated rows and null ids are packed like any other row.
An empty table gives an empty table. Other columns aren't read.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .numbering import Numbers, remembered

PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, part int, cls int, local_rank long"


def byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte: itself where it is printable, else the next free character from 256."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class WordIds:
    """Token ids of texts, word by word: ids of a text are those of its pieces between white space, one after another.

    That holds for tokenizers that drop white space and never merge across it. The first `most` pieces are remembered
    for the life of the worker, later ones for one call, so memory is bounded.

    For tokenizers that lower-case, cut letters from the rest and mark word ends, two short cuts give the same ids: a
    Latin-1 text is lower-cased before it is cut; a piece of letters alone goes to the merges directly, many at a time,
    and its end is found by the mark; and a comma or full stop behind letters is a token of its own.
    """

    LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"  # the cut that the short cuts rely on, a fixed value

    def __init__(self, path: str, most: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        made = json.loads(self.tokenizer.to_str())
        kinds = [n["type"] for n in (made["normalizer"] or {}).get("normalizers", [])]
        cut = ((made["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        self.short = kinds == ["NFC", "Replace", "Lowercase"] and cut == self.LETTERS and made["model"].get("end_of_word_suffix") == "</w>"
        if self.short:
            self.merges = Tokenizer.from_file(path)
            self.merges.normalizer, self.merges.pre_tokenizer = None, CharDelimiterSplit(" ")
            spelled = byte_letters()
            self.spelling = {c: "".join(spelled[b] for b in chr(c).encode()) for c in range(128, 256)}
            vocabulary = self.tokenizer.get_vocab()
            self.is_end = np.zeros(max(vocabulary.values()) + 1, bool)
            self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
            self.marks = {m: vocabulary[m + "</w>"] for m in ",."}
        self.index = Numbers()
        self.starts, self.lengths, self.flat = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.uint32)
        self.used = 0  # ids in flat
        self.index[""] = 0

    def _add(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        while len(self.index) > len(self.starts):
            self.starts, self.lengths = (np.concatenate((x, np.zeros_like(x))) for x in (self.starts, self.lengths))
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        at = np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces))
        self.starts[at] = self.used + np.cumsum(sizes) - sizes
        self.lengths[at] = sizes
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _learn(self, new: list[str]) -> None:
        """Find the ids of new pieces. `new` grows by the words before a comma or full stop that aren't known either."""
        letters, marked, others = [], [], []
        for w in new:
            if not self.short:
                others.append(w)
            elif self._plain(w):
                letters.append(w)
            elif w[-1] in self.marks and self._plain(w[:-1]):
                marked.append(w)
                self.index[w[:-1]]
            else:
                others.append(w)
        for at in range(0, len(letters), 1000):
            some = letters[at : at + 1000]
            ids = np.array(self.merges.encode_batch_fast([" ".join(some).translate(self.spelling)], add_special_tokens=False)[0].ids, np.uint32)
            self._add(some, ids, np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1))
        for at in range(0, len(others), 1000):
            some = others[at : at + 1000]
            ids = [x.ids for x in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._add(some, np.array([i for own in ids for i in own], np.uint32), np.array([len(own) for own in ids], np.int64))
        if marked:
            base = np.array([self.index[w[:-1]] for w in marked])
            sizes = self.lengths[base] + 1
            ids = np.empty(int(sizes.sum()), np.uint32)
            ends = np.cumsum(sizes) - 1
            inner = np.ones(len(ids), bool)
            inner[ends] = False
            ids[inner], ids[ends] = self._gathered(base), [self.marks[w[-1]] for w in marked]
            self._add(marked, ids, sizes)

    @staticmethod
    def _plain(w: str) -> bool:
        return w.isalpha() and w.islower() and (w.isascii() or max(w) < "\u0100")

    def _gathered(self, pieces: np.ndarray) -> np.ndarray:
        sizes = self.lengths[pieces]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(self.starts[pieces] - ends + sizes, sizes) + np.arange(ends[-1])]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """One uint32 array for each text."""
        used, number, rows = self.used, self.index.__getitem__, []
        new = self.index.fresh()
        for text in texts:
            text = text or ""
            if self.short:
                try:
                    text.encode("latin-1")
                    text = text.lower()
                except UnicodeEncodeError:
                    pass
            rows.append(np.array(list(map(number, text.replace("\n", " ").split(" "))), np.int64))
        self._learn(new)
        out = [self._gathered(row) for row in rows]
        if len(self.index) > self.most:
            self.index.forget(new)
            self.used = used
        return out


def word_ids(path: str) -> WordIds:
    """One for each worker and tokenizer."""
    return remembered(("word ids", path), lambda: WordIds(path))


def _pieces(path: str, end_id: int, capacity: int, grain: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, task = word_ids(path), TaskContext.get()
        part = task.partitionId() if task else 0
        ranks = np.zeros(capacity // grain + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                some = batch.slice(at, 200)
                cols: list[list] = [[] for _ in range(8)]
                for doc, ids in zip(some.column(0).to_pylist(), words.encode(some.column(1).to_pylist()), strict=True):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for start in range(0, len(ids), capacity):
                        own = ids[start : start + capacity]
                        cls = -(-len(own) // grain)
                        for col, x in zip(cols, (doc, start, len(own), len(ids), own.tobytes(), part, cls, int(ranks[cls])), strict=True):
                            col.append(x)
                        ranks[cls] += 1
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
                names = ["doc_id", "start", "length", "doc_tokens", "ids", "part", "cls", "local_rank"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, grain: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents with their ids (little-endian unsigned 32-bit), not yet written."""
    shared.small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return narrow.mapInArrow(_pieces(tokenizer, end_id, capacity, grain), PIECES)


def best_pattern(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of widths that fits: prices[w] is width w's price. Unbounded knapsack over capacities."""
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for c in range(1, capacity + 1):
        values = best[c - 1 :: -1] + prices[1 : c + 1]
        w = int(values.argmax())
        best[c], took[c] = values[w], w + 1
        if best[c - 1] >= best[c]:
            best[c], took[c] = best[c - 1], 0
    counts, c = np.zeros(len(prices), np.int64), capacity
    while c > 0:
        if took[c]:
            counts[took[c]] += 1
            c -= took[c]
        else:
            c -= 1
    return float(best[capacity]), counts


def cutting_stock(demand: np.ndarray, capacity: int, gap: float = 5e-4, most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows of counts by width) and how often each is used, covering demand[w] pieces of each width w exactly.

    Revised simplex on the pattern program. Ends when no pattern prices out or Farley's bound is within `gap`; `most`
    pivots only bound the effort, any basis covers the demand.
    """
    widths = np.flatnonzero(demand)
    if not len(widths):
        return np.zeros((0, len(demand)), np.int64), np.zeros(0, np.int64)
    n = len(widths)
    columns = np.diag(capacity // widths)
    inverse = np.diag(1.0 / (capacity // widths))
    x = inverse @ demand[widths].astype(float)
    for _ in range(most):
        prices = np.zeros(capacity + 1)
        prices[widths] = np.maximum(inverse.sum(axis=0), 0)
        value, pattern = best_pattern(prices, capacity)
        if value <= 1 + gap:
            break
        column = pattern[widths]
        direction = inverse @ column
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        pivot = inverse[leave] / direction[leave]
        inverse -= np.outer(direction, pivot)
        inverse[leave] = pivot
        x = np.maximum(x - direction * ratio[leave], 0)
        x[leave] = ratio[leave]
        columns[:, leave] = column
    used = np.floor(x + 1e-6).astype(np.int64)
    rest = demand[widths].astype(np.int64) - columns @ used
    for p in range(n):  # rounding errors must never cover more than there is
        while used[p] and (rest < 0).any() and (columns[rest < 0, p] > 0).any():
            used[p] -= 1
            rest += columns[:, p]
    patterns = np.zeros((n, len(demand)), np.int64)
    patterns[:, widths] = columns.T
    left = np.zeros(len(demand), np.int64)
    left[widths] = rest
    keep = used > 0
    tail = first_fit(left, capacity)
    return np.concatenate((patterns[keep], tail)), np.concatenate((used[keep], np.ones(len(tail), np.int64)))


def first_fit(demand: np.ndarray, capacity: int) -> np.ndarray:
    """First-fit-decreasing of the pieces that rounding left: a few for each pattern."""
    bins: list[np.ndarray] = []
    room: list[int] = []
    for w in range(len(demand) - 1, 0, -1):
        at = 0
        for _ in range(int(demand[w])):
            while at < len(room) and room[at] < w:
                at += 1
            if at == len(room):
                bins.append(np.zeros(len(demand), np.int64))
                room.append(capacity)
            bins[at][w] += 1
            room[at] -= w
    return np.array(bins, np.int64).reshape(len(bins), len(demand))


def _intervals(patterns: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, ...]:
    """By (class, first rank): the pattern's first sequence, how many of the class a sequence holds, its first slot."""
    bases = np.cumsum(used) - used
    next_rank = np.zeros(patterns.shape[1], np.int64)
    rows = []
    for pattern, n, base in zip(patterns, used, bases, strict=True):
        slot = 0
        for w in np.flatnonzero(pattern)[::-1]:
            rows.append((int(w), int(next_rank[w]), int(base), int(pattern[w]), slot))
            next_rank[w] += n * pattern[w]
            slot += int(pattern[w])
    rows.sort()
    return tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) if rows else tuple(np.zeros(0, np.int64) for _ in range(5))


def _placed(table: tuple[np.ndarray, ...], n_carry: int):
    cls, first, base, times, slot = table
    span = np.int64(1) << np.int64(44)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = cls * span + first
        for batch in batches:
            own, rank = (batch.column(n_carry + i).to_numpy().astype(np.int64) for i in (0, 1))
            at = np.searchsorted(keys, own * span + rank, side="right") - 1
            k = rank - first[at]
            cols = [*batch.columns[:n_carry], pa.array(base[at] + k // times[at]), pa.array(slot[at] + k % times[at])]
            yield pa.RecordBatch.from_arrays(cols, names=[*batch.schema.names[:n_carry], "sequence_id", "slot"])

    return run


def place(pieces: DataFrame, capacity: int = 2048, grain: int = 8) -> DataFrame:
    """The written pieces with sequence_id and offset; the columns part, cls and local_rank go, all others stay."""
    units = capacity // grain
    counts = shared.write(pieces.groupBy("cls", "part").agg(F.count("*").alias("n")), "class-counts")
    demand = np.zeros(units + 1, np.int64)
    for row in counts.groupBy("cls").agg(F.sum("n").alias("n")).collect():  # a row for each class: units at most
        demand[row["cls"]] = row["n"]
    table = _intervals(*cutting_stock(demand, units))
    before = Window.partitionBy("cls").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("cls", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    carry = [c for c in pieces.columns if c not in ("part", "cls", "local_rank")]
    ranked = pieces.join(bases, ["cls", "part"]).select(*carry, "cls", (F.col("local_rank") + F.col("before")).alias("rank"))
    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in carry)
    placed = ranked.mapInArrow(_placed(table, len(carry)), f"{kinds}, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(*carry, "sequence_id", F.coalesce(F.sum("length").over(earlier), F.lit(0)).alias("offset"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 2048, grain: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return place(shared.write(token_pieces(docs, tokenizer, end_id, capacity, grain, id_col, text_col), "pieces"), capacity, grain)


def sequences(packed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the ids of each sequence, padded to capacity unless the length is a power of two."""
    parts = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    joined = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    exact = F.bit_count("length") == 1
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(capacity) - F.col("length")).cast("int")))
    return parts.select("sequence_id", "length", F.when(exact, joined).otherwise(F.concat(joined, pad)).alias("ids"))
