"""Canonical exact fingerprints, by DataFrame functions only.

A text's canonical form is its NFKC form, case-folded, normalised again, with runs of white space made one space and none
at the ends. Its fingerprint is four 64-bit xxHash lanes of that form, as 64 hex digits. Texts with equal fingerprints
are compared byte for byte with the bucket's leader, its smallest id; one that differs, a collision, gets a SHA-512 of
its canonical form appended. A bucket is joined on its fingerprint, leader to members, so its size needs no bound.

Normalisation and case folding come from the ICU library that Spark ships for its collations, called inside the JVM.

Nulls, ties, empties: a null text is an empty one. Repeated rows are compared like any others. Rows with a null id get
fingerprints, but no comparison by id: their fingerprint is the plain one. An empty table gives an empty table.
Columns beyond id and text aren't read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared

NORMALIZER, CHARACTERS = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"
LANES = (11, 23, 37, 53)  # seeds of the lanes, fixed values


def _nfkc(text: Column) -> Column:
    return F.java_method(F.lit(NORMALIZER), F.lit("compose"), text, F.lit(True))


def canonical(text: Column) -> Column:
    """The canonical form of a text column."""
    folded = F.java_method(F.lit(CHARACTERS), F.lit("foldCase"), _nfkc(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(_nfkc(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(canon: Column) -> Column:
    """256 bits of xxHash as 64 hex digits."""
    return F.lower(F.concat(*[F.lpad(F.hex(F.xxhash64(F.lit(seed).cast("long"), canon)), 16, "0") for seed in LANES]))


def suffix(canon: Column) -> Column:
    """What a colliding text's fingerprint gets appended."""
    return F.concat(F.lit("-"), F.sha2(canon, 512))


def same_row(h: str) -> Column:
    """Whether a row's text has the hash in column h. Not an equality of two sides, which would become a join key and
    shuffle the texts once more, by both keys."""
    return F.xxhash64("text").bitwiseXOR(F.col(h)) == 0


def collisions(texts: DataFrame, prints: DataFrame) -> DataFrame:
    """(doc_id, h) of the rows whose canonical form isn't that of their bucket's leader.

    texts: doc_id, text. prints, written: doc_id, h (a hash of the raw text, to tell rows of one id apart), fingerprint.
    """
    leaders = prints.where("doc_id is not null").groupBy("fingerprint").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "h")).alias("leader")).where("n > 1")
    led = prints.where("doc_id is not null").join(leaders.select("fingerprint", "leader"), "fingerprint")
    led = led.where((F.col("doc_id") != F.col("leader.doc_id")) | (F.col("h") != F.col("leader.h"))).select("doc_id", F.col("h").alias("want"), "fingerprint")
    heads = leaders.select(F.col("leader.doc_id").alias("doc_id"), F.col("leader.h").alias("want"), "fingerprint")

    def with_text(rows: DataFrame, name: str) -> DataFrame:
        found = texts.join(rows, "doc_id").where(same_row("want"))
        return found.select("doc_id", F.col("want").alias("h"), "fingerprint", canonical(F.col("text")).alias(name))

    lead = with_text(heads, "lead").dropDuplicates(["fingerprint"]).select("fingerprint", "lead")
    return with_text(led, "own").join(lead, "fingerprint").where(F.col("own") != F.col("lead")).select("doc_id", "h")


def prepared(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of all rows, and the written table of doc_id, h, n_chars and plain fingerprint."""
    # without an alias where none is needed: an alias in one branch alone would keep plans from sharing one shuffle of the texts
    plain = id_col == "doc_id" and docs.schema[id_col].dataType.simpleString() == "bigint"
    own_id = F.col(id_col) if plain else F.col(id_col).cast("long").alias("doc_id")
    texts = docs.select(own_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    prints = texts.select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("n_chars"), wide_hash(canonical(F.col("text"))).alias("fingerprint"))
    return texts, shared.write(prints, "fingerprints")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, fingerprint, group_id (the smallest id with that fingerprint), group_size."""
    texts, prints = prepared(docs, id_col, text_col)
    bad = collisions(texts.where("doc_id is not null"), prints).distinct().withColumn("bad", F.lit(True))
    canon = texts.join(bad, "doc_id").where(same_row("h")).select("doc_id", "h", suffix(canonical(F.col("text"))).alias("more")).distinct()
    full = prints.join(canon, ["doc_id", "h"], "left").select("doc_id", F.concat("fingerprint", F.coalesce("more", F.lit(""))).alias("fingerprint"))
    sizes = full.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return full.join(sizes, "fingerprint").select("doc_id", "fingerprint", "group_id", "group_size")


def successors(ids: DataFrame) -> DataFrame:
    """(doc_id, next_id) over distinct ids, ascending; the last is followed by the first.

    Ids are range-partitioned and written, so each partition orders its own; the first id of each partition, a row for
    each, joins the partitions.
    """
    spark = ids.sparkSession
    ranged = ids.where("doc_id is not null").distinct().repartitionByRange("doc_id").withColumn("part", F.spark_partition_id())
    ranged = shared.write(ranged, "ids")
    firsts = [(r["part"], r["first"]) for r in ranged.groupBy("part").agg(F.min("doc_id").alias("first")).orderBy("part").collect()]
    after = [(p, firsts[(i + 1) % len(firsts)][1]) for i, (p, _) in enumerate(firsts)]
    after = F.broadcast(spark.createDataFrame(after, "part int, after long"))  # a row for each partition
    lead = F.lead("doc_id").over(Window.partitionBy("part").orderBy("doc_id"))
    return ranged.withColumn("lead", lead).join(after, "part").select("doc_id", F.coalesce("lead", "after").alias("next_id"))


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness: 1.0 for equal canonical forms, else 0.0.

    The edited text has its last quarter of code points replaced by as many (or all) first ones of the next document. Of
    rows that share an id the next document is the one with the smallest hash. Rows without an id follow nothing: their
    edited text only loses its last quarter, near_next is 0.0.
    """
    texts, prints = prepared(docs, id_col, text_col)
    known = texts.where("doc_id is not null")
    order = shared.write(successors(prints.select("doc_id")), "successors")
    one = prints.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("h", "fingerprint")).alias("s"), F.max("n_chars").alias("most"))
    of_next = one.select(F.col("doc_id").alias("next_id"), F.col("s.h").alias("next_h"), F.col("s.fingerprint").alias("next_fingerprint"))
    links = shared.write(order.join(one.select("doc_id", F.floor(F.col("most") / 4).alias("need")), "doc_id").join(of_next, "next_id"), "links")

    wanted = links.select(F.col("doc_id").alias("for_id"), F.col("next_id").alias("doc_id"), "next_h", "next_fingerprint", "need")
    heads = known.join(wanted, "doc_id").where(same_row("next_h"))
    heads = heads.select(F.col("for_id").alias("doc_id"), F.expr("substring(text, 1, cast(need as int))").alias("head"), "next_fingerprint")
    heads = heads.groupBy("doc_id").agg(F.min("head").alias("head"), F.min("next_fingerprint").alias("next_fingerprint"))  # rows of one id and hash are equal
    bad = collisions(known, prints).groupBy("doc_id").agg(F.collect_set("h").alias("bad"))

    rows = known.join(heads, "doc_id", "left").join(bad, "doc_id", "left")
    lone = texts.where("doc_id is null").select("doc_id", "text", F.lit("").alias("head"), F.lit(None).cast("string").alias("next_fingerprint"), F.lit(False).alias("collides"))
    rows = rows.withColumn("collides", F.coalesce(F.array_contains("bad", F.xxhash64("text")), F.lit(False))).select(*lone.columns).unionByName(lone)
    quarter = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring("text", 1, F.length("text") - quarter), F.substring("head", 1, quarter))
    rows = rows.select("doc_id", "text", "collides", "next_fingerprint", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("canon", canonical(F.col("text"))).withColumn("edited_canon", canonical(F.col("edited")))
    rows = rows.withColumn("plain", wide_hash(F.col("canon"))).withColumn("edited_plain", wide_hash(F.col("edited_canon")))
    same = (F.col("plain") == F.col("edited_plain")) & (F.col("canon") == F.col("edited_canon"))
    own_more = F.when(F.col("collides"), suffix(F.col("canon"))).otherwise("")
    edited_more = F.when(same, own_more).when(F.col("plain") == F.col("edited_plain"), suffix(F.col("edited_canon"))).otherwise("")
    near_next = ~F.col("collides") & F.col("next_fingerprint").eqNullSafe(F.col("plain"))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.concat("plain", own_more).alias("fingerprint"), F.concat("edited_plain", edited_more).alias("edited_fingerprint"),
        same.cast("double").alias("near_edited"), near_next.cast("double").alias("near_next"),
    )
