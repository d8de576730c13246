"""Near-duplicate documents by SuperMinHash, banding, verification on whole shingle sets, and union-find grouping.

1. A text is lower-cased (A-Z) and cut into words at ASCII white space; its set is its distinct k-word shingles, each a
   64-bit hash. Fewer words make one shingle; no words make an empty set, linked with nothing.
2. Equal sets collapse into one class by a 128-bit digest of the sorted set, so exact copies never meet in a bucket.
3. Each class gets a SuperMinHash signature: every element walks a random permutation of the slots, one step a level, and
   offers level + fraction to the slot it reaches. The walk of a set stops at the first level that fills all its slots.
4. Bands of `rows` slots are hashed. The number of bands follows from the threshold: a pair at it is missed with
   probability `miss` at most.
5. In each bucket the smallest id is the leader, and each member is verified with it on whole sets. Links become
   components: union-find inside each partition, then star contraction between partitions.
6. Where buckets still hold several components, members that can't have another link are set aside: shingles that no
   other such set has lower what two sets can share, and so the similarity they can reach. Groups that share much, but
   too little, are thus spared from being compared pair by pair. Setting some aside makes more shingles single, so this is
   done up to `peels` times while it is worth it. If many pairs are left, other leaders follow, a linear number of pairs each.
7. What is left is verified pair by pair: members of one bucket in different components, once a pair, whose sizes,
   single shingles and overlap with one set of the bucket, the pivot, allow the threshold. Every step is exact: each pair that meets in a bucket is verified, connected
   already, or shown to be no link. There is no cap on partners.

Nulls, ties, empties: a null text is an empty one. Rows that share a doc_id are one document: they are in one component.
A null doc_id takes the component of its equals, null if none of them has an id, and is kept only in that last case.
An empty table gives an empty table. Columns beyond id and text aren't read, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .numbering import remembered

GOLDEN, MIX_A, MIX_B = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB  # splitmix64, fixed values
CHUNK = 20_000  # shingles that are signed together
SIGNED = "doc_id long, n_shingles long, s1 long, s2 long, bands array<long>"


class WordHashes(dict):
    """Word to 64-bit hash; emptied when it holds `most` words."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(MIX_A)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(MIX_B)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, k: int, words: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    seq = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not seq:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(words.__getitem__, seq), np.uint64, len(seq))
    span = min(k, len(seq))
    total = np.full(len(seq) - span + 1, span, np.uint64)
    for i in range(span):
        total = total * np.uint64(GOLDEN) + h[i : len(seq) - span + 1 + i]
    total = _mixed(total)
    total.sort()
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def superminhash(elements: np.ndarray, owner: np.ndarray, n_sets: int, slots: int) -> np.ndarray:
    """Signatures of n_sets sets at once: element i belongs to set owner[i]. Values: level in the high 32 bits, fraction below.

    Level by level: at level j each element of an unfinished set swaps slot j of its own permutation with a random later
    one and offers its value to the slot found there. A later level can only offer more, so a set whose slots are all
    filled is finished.
    """
    sig = np.full((n_sets, slots), np.iinfo(np.uint64).max, np.uint64)
    flat, low = sig.reshape(-1), np.uint64(0xFFFFFFFF)
    perm = np.empty((0, slots), np.uint16)
    open_sets = np.zeros(n_sets, bool)
    open_sets[owner] = True
    for level in range(slots):
        with np.errstate(over="ignore"):
            r = _mixed(elements + np.uint64((GOLDEN * (level + 1)) & (2**64 - 1)))
        to = (level + (((r & low) * np.uint64(slots - level)) >> np.uint64(32)).astype(np.int64)).astype(np.int64)
        if level == 0:
            slot = to
        else:
            at = np.arange(len(elements))
            slot = perm[at, to].astype(np.int64)
            perm[at, to] = perm[at, level]
        np.minimum.at(flat, owner * slots + slot, (np.uint64(level) << np.uint64(32)) | (r >> np.uint64(32)))
        still = sig.max(axis=1) >= (np.uint64(level + 1) << np.uint64(32))
        still &= open_sets
        if not still.any():
            break
        if still.sum() < open_sets.sum():
            stay = still[owner]
            elements, owner, to = elements[stay], owner[stay], to[stay]
            perm = perm[stay] if level else perm
            open_sets = still
        if level == 0:
            perm = np.tile(np.arange(slots, dtype=np.uint16), (len(elements), 1))
            perm[np.arange(len(elements)), to] = 0
    return sig


def band_hashes(sig: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit hash for each band of `rows` slots; the band's number is part of it."""
    n_bands = sig.shape[1] // rows
    parts = sig[:, : n_bands * rows].reshape(len(sig), n_bands, rows)
    total = np.broadcast_to(np.arange(1, n_bands + 1, dtype=np.uint64), (len(sig), n_bands)).copy()
    for i in range(rows):
        total = _mixed(total * np.uint64(GOLDEN) + parts[:, :, i])
    return total


def rows_for(threshold: float) -> int:
    """Slots a band: as many as keep a pair at the threshold in about 27 % of the bands, so that pairs far below meet in few."""
    return max(1, round(math.log(0.27) / math.log(threshold))) if threshold < 1 else 16


def bands_for(threshold: float, rows: int, miss: float) -> int:
    return math.ceil(math.log(miss) / math.log1p(-(threshold**rows))) if threshold < 1 else 1


def _signed(k: int, rows: int, n_bands: int):
    slots = rows * n_bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered("word hashes", WordHashes)

        def emit(ids: list[int | None], sets: list[np.ndarray]) -> pa.RecordBatch:
            sizes = np.array([len(s) for s in sets])
            owner = np.repeat(np.arange(len(sets)), sizes)
            bands = band_hashes(superminhash(np.concatenate(sets), owner, len(sets), slots), rows).view(np.int64)
            full = sizes > 0
            prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            offsets = np.concatenate(([0], np.cumsum(np.where(full, n_bands, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(bands[full].reshape(-1)))
            cols = [pa.array(ids, pa.int64()), pa.array(sizes.astype(np.int64)), pa.array(prints[:, 0]), pa.array(prints[:, 1]), lists]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "s1", "s2", "bands"])

        ids, sets, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids.append(doc)
                    sets.append(shingle_set(text, k, words))
                    held += len(sets[-1])
                    if held > CHUNK or len(ids) >= 2000:
                        yield emit(ids, sets)
                        ids, sets, held = [], [], 0
        if ids:
            yield emit(ids, sets)

    return run


def _sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = remembered("word hashes", WordHashes)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t, k, words) for t in part.column(1).to_pylist()]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(sets).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], ["doc_id", "shingles"])

    return run


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over one partition's links; a link (node, root) for each node that isn't its own root."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while (p := parent.setdefault(top, top)) != top:
            top = p
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 50_000):
        part = nodes[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([parent[x] for x in part], pa.int64())], ["node", "root"])


def _flat(forest: DataFrame) -> bool:
    """Whether each node hangs on one root and no root hangs on another node."""
    ends = forest.select(F.col("node").alias("x"), F.lit(1).alias("below")).unionByName(forest.select(F.col("root").alias("x"), F.lit(0).alias("below")).distinct())
    seen = ends.groupBy("x").agg(F.sum("below").alias("below"), F.count("*").alias("n")).where((F.col("below") > 0) & (F.col("n") > 1))
    return seen.isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for each node of a link that isn't its component's smallest, root being that smallest.

    Union-find shrinks each partition's links to a forest; large-star and small-star rounds then join the forests until
    every tree is flat. All of it is joins and partial aggregates over links; nothing but a yes or no goes to the driver.
    """
    forest = shared.write(links.select(F.col(a).cast("long"), F.col(b).cast("long")).mapInArrow(_forest, "node long, root long"), "forest")
    while not _flat(forest):
        # large star: each neighbour above a node hangs on the node's smallest neighbour
        both = forest.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(forest.select(F.col("root").alias("u"), F.col("node").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.join(least, "u").where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m"))).select(F.col("v").alias("node"), F.col("m").alias("root")).distinct()
        large = shared.write(large, "large-star")
        # small star: a node and its smaller neighbours hang on the smallest of them
        least = large.groupBy("node").agg(F.min("root").alias("m"))
        moved = large.join(least, "node").where(F.col("root") != F.col("m")).select(F.col("root").alias("node"), F.col("m").alias("root"))
        after = shared.write(least.select("node", F.col("m").alias("root")).unionByName(moved).distinct(), "small-star")
        shared.drop(forest, large)
        forest = after
    return forest


def near_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, rows: int | None = None, miss: float = 1e-6, peels: int = 3, leader_rounds: int = 2
) -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    shared.small_batches(docs.sparkSession)
    rows = rows or rows_for(threshold)
    n_bands, per_mille = bands_for(threshold, rows, miss), round(threshold * 1000)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = shared.write(narrow.mapInArrow(_signed(k, rows, n_bands), SIGNED), "signatures")

    with_words = signed.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    classes = with_words.groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = shared.write(classes, "classes")
    members = classes.select("rep", "n", F.explode("bands").alias("bucket"))
    met = members.groupBy("bucket").agg(F.min(F.struct("rep", "n")).alias("first"), F.max("rep").alias("last")).where("first.rep < last")
    members = shared.write(members.join(met.select("bucket", F.col("first.rep").alias("leader"), F.col("first.n").alias("leader_n")), "bucket"), "buckets")
    sets = shared.write(narrow.join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi").mapInArrow(_sets(k), "doc_id long, shingles array<long>"), "shingle-sets")

    def fits(a: str, b: str) -> F.Column:
        """Sizes that allow the threshold: a necessary condition, so that nothing is lost."""
        return (F.least(a, b) * 1000) >= (F.greatest(a, b) * per_mille)

    def verified(pairs: DataFrame) -> DataFrame:
        """Those of the pairs (a, b) whose whole sets reach the threshold, written."""
        joined = pairs.distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("x")), "a")
        joined = joined.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y")), "b")
        common, both = F.size(F.array_intersect("x", "y")).cast("long"), (F.size("x") + F.size("y")).cast("long")
        return shared.write(joined.where(common * 1000 >= (both - common) * per_mille).select("a", "b"), "links")

    def led(rows_led: DataFrame) -> DataFrame:
        """Pairs of each member with its bucket's leader."""
        pairs = rows_led.where((F.col("rep") != F.col("leader")) & fits("n", "leader_n"))
        return pairs.select(F.least("rep", "leader").alias("a"), F.greatest("rep", "leader").alias("b"))

    links = verified(led(members))
    forest = components(links)

    def mixed_members() -> tuple[DataFrame, int, int]:
        """Members of buckets that hold several components, how many pairs those have across, how many members."""
        placed = members.join(forest.withColumnRenamed("node", "rep"), "rep", "left").select("bucket", "rep", "n", "own", F.coalesce("root", "rep").alias("root"))
        shares = placed.groupBy("bucket", "root").agg(F.count("*").alias("m")).groupBy("bucket").agg(F.count("*").alias("roots"), F.sum("m").alias("all"), F.sum(F.col("m") * F.col("m")).alias("sq"))
        mixed = shared.write(shares.where("roots > 1").select("bucket", ((F.col("all") * F.col("all") - F.col("sq")) / 2).alias("pairs"), "all"), "mixed")
        left = mixed.agg(F.sum("pairs").alias("pairs"), F.sum("all").alias("all")).first()
        if not left["pairs"]:
            return mixed, 0, 0
        return shared.write(placed.join(mixed.select("bucket"), "bucket"), "placed"), left["pairs"], left["all"]

    def without_lone(placed: DataFrame) -> DataFrame:
        """placed with own, how many of a set's shingles no other open set has, without members that rules out in a bucket.

        Two sets with similarity t share t / (1 + t) of their sizes' sum, and at most what isn't single in either.
        """
        open_reps = placed.select(F.col("rep").alias("doc_id")).distinct()
        spread = sets.join(open_reps, "doc_id").select("doc_id", F.explode("shingles").alias("shingle"))
        single = spread.groupBy("shingle").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("other")).where("rep = other").groupBy("rep").agg(F.count("*").alias("single"))
        counted = placed.drop("own").join(single, "rep", "left").withColumn("own", F.coalesce("single", F.lit(0))).drop("single")
        least = counted.groupBy("bucket").agg(F.min("n").alias("least"))
        return counted.join(least, "bucket").where(F.col("n") * 1000 - F.col("own") * (1000 + per_mille) >= F.col("least") * per_mille).select("bucket", "rep", "n", "own")

    members = members.select("bucket", "rep", "n", F.lit(0).cast("long").alias("own"))
    placed, pairs, n_members = mixed_members()
    for _ in range(peels):
        if pairs > 2 * n_members:
            members = shared.write(without_lone(placed), "open-members")
            placed, pairs, n_members = mixed_members()
    for turn in range(leader_rounds):
        if pairs > 8 * n_members:
            # one other leader a bucket: a linear number of pairs
            lead = placed.groupBy("bucket").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("o"), F.col("rep").alias("leader"), F.col("n").alias("leader_n"), F.col("root").alias("lr"))).alias("s"))
            lead = placed.join(lead.select("bucket", "s.leader", "s.leader_n", "s.lr"), "bucket").where(F.col("root") != F.col("lr"))
            links = links.unionByName(verified(led(lead)))
            forest = components(links)
            placed, pairs, n_members = mixed_members()
    if pairs:
        # what each member shares with one set of its bucket bounds what two members share: in it, and outside of it
        placed = placed.join(placed.groupBy("bucket").agg(F.min("rep").alias("pivot")), "bucket")
        near = placed.select("rep", "pivot").distinct().join(sets.select(F.col("doc_id").alias("rep"), F.col("shingles").alias("x")), "rep")
        near = near.join(sets.select(F.col("doc_id").alias("pivot"), F.col("shingles").alias("y")), "pivot").select("rep", "pivot", F.size(F.array_intersect("x", "y")).alias("common"))
        meets = placed.groupBy("rep").agg(F.collect_set("bucket").alias("meets"))
        placed = placed.join(near, ["rep", "pivot"]).join(meets, "rep").withColumn("outside", F.greatest(F.col("n") - F.col("common") - F.col("own"), F.lit(0)))
        x, y = (placed.select("bucket", *[F.col(c).alias(f"{i}_{c}") for c in ("rep", "n", "root", "own", "common", "outside", "meets")]) for i in "ab")
        needed = (F.col("a_n") + F.col("b_n")) * per_mille
        shared_enough = ((F.col("a_n") - F.col("a_own")) * (1000 + per_mille) >= needed) & ((F.col("b_n") - F.col("b_own")) * (1000 + per_mille) >= needed)
        shared_enough &= (F.least("a_common", "b_common") + F.least("a_outside", "b_outside")) * (1000 + per_mille) >= needed
        once = F.col("bucket") == F.array_min(F.array_intersect("a_meets", "b_meets"))
        across = x.join(y, "bucket").where((F.col("a_rep") < F.col("b_rep")) & (F.col("a_root") != F.col("b_root")) & fits("a_n", "b_n") & shared_enough & once)
        links = links.unionByName(verified(across.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b"))))
        forest = components(links)
    found = classes.select("s1", "s2", "rep").join(forest.withColumnRenamed("node", "rep"), "rep", "left").select("s1", "s2", F.coalesce("root", "rep").alias("root"))
    own = signed.drop("bands").join(found, ["s1", "s2"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("root"))
    out = own.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
