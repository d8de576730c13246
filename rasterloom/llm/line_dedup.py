"""Line deduplication across documents.

Every line's key is hashed to 128 bits. Occurrences are range-partitioned by (hash, document descending, row, position), so
that a key held by a third of all documents spans many partitions, and sorted so inside each partition. One pass streams
over each partition: it keeps a key's first document and passes on the places of the others. A key that it can't decide,
as it may continue in a neighbour or has more than `HELD` places before it has enough documents, gets a tally of its documents;
tallies are summed and joined back to the places that are still open. Documents then get a compressed bitmap of the lines to
keep, made of the places alone: no text is hashed twice.

A row is told from others of its document by a hash of its text, so what goes to a row are places in that row, however many
rows share an id or have none.

Nulls, ties, empties: a null or empty text is one empty line. A null doc_id sorts below all others and counts as one
document. Rows that share a doc_id are one document: what goes from it goes from each of its rows. An empty table gives
an empty table. Columns beyond id and text are read only when named in `carry`; those must not be called n_lines, n_dropped,
keep_bitmap or as the kept text is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WHITE = b" \t\n\x0b\x0c\r"
DROP, OPEN, TALLY = 0, 1, 2
MOST_TALLIES = 200_000  # tallies that are broadcast, 24 bytes each; more are joined like any other table
HELD = 1000  # places of one key that wait in memory for a decision
OCCURRENCE = "h1 long, h2 long, doc_id long, row long, pos int"
STREAMED = "kind byte, h1 long, h2 long, doc_id long, row long, pos int, n long"
PLAN = ["n_lines", "n_dropped", "keep_bitmap"]


def line_digests(text: str | None, min_chars: int) -> list[bytes | None]:
    """The 16-byte digest of each line's key, None for keys that are too short to count."""
    out: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        key = line.strip(WHITE).lower()  # bytes.lower() changes A-Z only
        if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars):
            out.append(None)
        else:
            out.append(xxhash.xxh3_128_digest(key))
    return out


def _occurrences(min_chars: int):
    """(doc_id, row, text) to a row for each line whose key counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                digests: list[bytes] = []
                places: list[int] = []
                counts = np.zeros(part.num_rows, np.int64)
                for i, text in enumerate(part.column(2).to_pylist()):
                    before = len(places)
                    for pos, d in enumerate(line_digests(text, min_chars)):
                        if d:
                            digests.append(d)
                            places.append(pos)
                    counts[i] = len(places) - before
                pair = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                own = pa.array(np.repeat(np.arange(part.num_rows), counts))
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), part.column(0).take(own), part.column(1).take(own), pa.array(places, pa.int32())], ["h1", "h2", "doc_id", "row", "pos"])

    return run


def _stream(min_docs: int):
    """Decide what one sorted partition can decide. State: the current key, its first document, how many it has, held places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, top, doc_now, n, opened = None, None, None, 0, True  # opened: decided by tallies, as a first key is
        held: list[tuple] = []
        out: list[tuple] = []

        def close(at_end: bool) -> None:
            """The current key has no more rows here."""
            if key is None:
                return
            if opened or at_end:  # a document at an edge may go on in the next partition
                out.append((TALLY, *key, top, None, None, max(n - 2, 0)))
                if n > 1:
                    out.append((TALLY, *key, doc_now, None, None, 0))
            if at_end and not opened:
                out.extend((OPEN, *key, *x, 0) for x in held)

        for batch in batches:
            for h1, h2, doc, row, pos in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (h1, h2) != key:
                    close(False)
                    opened, key, held, n, top, doc_now = key is None, (h1, h2), [], 1, doc, doc
                elif doc != doc_now:
                    n, doc_now = n + 1, doc
                    if n == min_docs and not opened:
                        out.extend((DROP, *key, *x, 0) for x in held)
                        held = []
                if opened:
                    out.append((OPEN, h1, h2, doc, row, pos, 0))
                elif n >= min_docs and n > 1:
                    out.append((DROP, h1, h2, doc, row, pos, 0))
                elif n > 1:
                    held.append((doc, row, pos))
                    if len(held) > HELD:
                        opened = True
                        out.extend((OPEN, *key, *x, 0) for x in held)
                        held = []
            if out:
                yield _rows(out)
                out = []
        close(True)
        if out:
            yield _rows(out)

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int8(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["kind", "h1", "h2", "doc_id", "row", "pos", "n"])


def decisions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """The lines that each row loses, as (doc_id, row, gone array<int>); row is the xxHash of the text, null texts empty.

    A key found in at least min_docs documents goes from all but the largest id that holds it.
    """
    shared.small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text"))
    seen = shared.write(narrow.mapInArrow(_occurrences(min_chars), OCCURRENCE), "line-occurrences")
    # nulls sort last in descending order, below every id
    order = ["h1", "h2", F.desc_nulls_last("doc_id"), "row", "pos"]
    streamed = shared.write(seen.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), STREAMED), "line-decisions")
    shared.drop(seen)
    # tallies of the first and last key of each partition and of keys with many places: documents inside, and both edge ones
    edges = F.countDistinct("doc_id") + F.max(F.col("doc_id").isNull().cast("int"))
    tally = streamed.where(F.col("kind") == TALLY).groupBy("h1", "h2").agg((F.sum("n") + edges).alias("n"), F.max("doc_id").alias("top")).where(F.col("n") >= min_docs).select("h1", "h2", "top")
    late = streamed.where(F.col("kind") == OPEN).select("h1", "h2", "doc_id", "row", "pos")
    tally = F.broadcast(tally) if tally.count() <= MOST_TALLIES else tally  # a key of many places isn't one task
    late = late.join(tally, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "row", "pos")
    gone = streamed.where(F.col("kind") == DROP).select("doc_id", "row", "pos").unionByName(late)
    return gone.groupBy("doc_id", "row").agg(F.collect_set("pos").alias("gone"))


def pack_bitmap(keep: list[bool] | np.ndarray) -> bytes:
    """Bit i, most significant first, says whether line i stays; zlib-compressed after the line count."""
    bits = np.packbits(np.asarray(keep, bool)).tobytes()
    return len(keep).to_bytes(4, "little") + zlib.compress(bits, 6)


def unpack_bitmap(bitmap: bytes) -> np.ndarray:
    n = int.from_bytes(bitmap[:4], "little")
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap[4:]), np.uint8), count=n).astype(bool)


def _bitmaps(n_carry: int, with_kept: bool):
    """Carried columns, text, gone places to carried columns, PLAN and, if asked for, the kept text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lines, dropped, maps, kept = [], [], [], []
                for text, gone in zip(part.column(n_carry).to_pylist(), part.column(n_carry + 1).to_pylist(), strict=True):
                    keep = np.ones(text.count("\n") + 1, bool)
                    keep[gone or []] = False
                    lines.append(len(keep))
                    dropped.append(len(gone or ()))
                    maps.append(pack_bitmap(keep))
                    if with_kept:
                        kept.append("\n".join([x for x, k in zip(text.split("\n"), keep.tolist(), strict=True) if k]) if gone else text)
                plan = [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(maps, pa.binary()), *([pa.array(kept, pa.string())] if with_kept else [])]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_carry], *plan], names=[*part.schema.names[:n_carry], *PLAN, *(["kept"] if with_kept else [])])

    return run


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), min_chars: int = 20, min_docs: int = 3, kept_col: str | None = None) -> DataFrame:
    """A row for each row of docs: id, the carried columns, n_lines, n_dropped, keep_bitmap and, if kept_col names it, the
    text of the lines that stay, joined by line ends.

    carry must not hold n_lines, n_dropped, keep_bitmap or kept_col; rename such columns first.
    """
    kept = [id_col, *carry]
    gone = decisions(docs, id_col, text_col, min_chars, min_docs).select(F.col("doc_id").alias("_gone_id"), F.col("row").alias("_gone_row"), "gone")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(kept)], F.col(id_col).cast("long").alias("_id"), F.xxhash64(text).alias("_row"), text.alias("_text"))
    joined = rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_row") == F.col("_gone_row")), "left")
    joined = joined.select(*[f"_c{i}" for i in range(len(kept))], "_text", "gone")
    more = "" if kept_col is None else ", kept string"
    schema = ", ".join([*(f"_c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(kept)), "n_lines long, n_dropped long, keep_bitmap binary" + more])
    out = joined.mapInArrow(_bitmaps(len(kept), kept_col is not None), schema)
    return out.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(kept)], *PLAN, *([] if kept_col is None else [F.col("kept").alias(kept_col)]))


def apply_bitmap(text: str | None, bitmap: bytes) -> str:
    """The text without the lines that the bitmap drops. A null text is empty."""
    lines = (text or "").split("\n")
    return "\n".join([x for x, k in zip(lines, unpack_bitmap(bitmap), strict=True) if k])


def kept_text(df: DataFrame, text_col: str = "text", bitmap_col: str = "keep_bitmap", out_col: str = "kept") -> DataFrame:
    """df with out_col: the lines that stay, from bitmaps made before. Texts that lose nothing come back as they are."""

    @F.pandas_udf("string")
    def kept(texts: pd.Series, maps: pd.Series) -> pd.Series:
        return pd.Series([apply_bitmap(t, b) for t, b in zip(texts, maps, strict=True)], dtype=object)

    return df.withColumn(out_col, kept(F.col(text_col), F.col(bitmap_col)))
