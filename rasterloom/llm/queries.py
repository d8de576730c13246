"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, html_text, licenses, line_dedup, media, mixing, near_dedup, packing, shared, toxicity, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to Zstandard WARC archives and read back; equal payloads of 1000 bytes or more revisit one."""
    folder = shared.new_path(spark, "warc")
    archives = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.resolved(shared.write(warc.read_archives(archives, folder), "records"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents linked at a similarity of 0.85 of their 3-word shingles."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), k=3, threshold=0.85)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence texts among whole documents and their lines."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_media_sniffing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as 8-bit audio of undeclared type, recognised by its bytes, read back and measured."""
    stored = media.store_texts(table(spark, sf_dir, "documents"))
    return media.wav_features(media.sniff(stored, declared_col="declared", carry=("doc_id", "n_bytes")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document by a model fitted on the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn to the production weights: 60 % of all tokens, three passes at most."""
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, mixing.PRODUCTION, mixing.by_number(F.col("source")))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 20 characters or more that three documents share stay in the largest id alone."""
    plan = line_dedup.line_dedup(table(spark, sf_dir, "documents"), kept_col="kept")
    return plan.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op10_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Documents cut and packed into sequences of 2048 tokens."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    packed = packing.place(shared.write(pieces, "pieces"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def queries() -> dict[str, Query]:
    return {
        "op1_warc": op1_warc,
        "op2_fingerprints": op2_fingerprints,
        "op3_minhash_near_dedup": op3_minhash_near_dedup,
        "op4_license_scan": op4_license_scan,
        "op5_media_sniffing": op5_media_sniffing,
        "op6_toxicity": op6_toxicity,
        "op7_mixing": op7_mixing,
        "op8_line_dedup": op8_line_dedup,
        "op9_html_text": op9_html_text,
        "op10_packing": op10_packing,
    }


OP8_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from d),
k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l),
s as (select key, max(doc_id) as top from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
j as (select k.doc_id, k.pos, k.line, coalesce(k.doc_id <> s.top, false) as gone from k left join s on k.key = s.key)
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from j group by doc_id
"""


OP1_SQL = """
with p as (select page_id, coalesce(html, '') as payload from pages),
t as (select payload, max(page_id) as top from p where strlen(payload) >= 1000 group by payload)
select page_id, cast(strlen(p.payload) as bigint) as payload_bytes, sha1(p.payload) as payload_digest,
  case when page_id <> top then 'revisit' else 'response' end as record_type, case when page_id <> top then top end as refers_to
from p left join t on p.payload = t.payload
"""

OP3_SQL = """
with recursive words as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w
  from documents),
spots as (select doc_id, w, unnest(range(case when len(w) = 0 then 0 else greatest(len(w) - 2, 1) end)) as i from words),
sets as (select distinct doc_id, array_to_string(list_slice(w, i + 1, i + 3), ' ') as shingle from spots),
sizes as (select doc_id, count(*) as n from sets group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as c from sets a join sets b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
reach(doc_id, other) as (select a, b from links union select r.doc_id, l.b from reach r join links l on l.a = r.other),
found as (select doc_id, min(other) as least from reach group by doc_id)
select d.doc_id, coalesce(n, 0) as n_shingles, least(d.doc_id, coalesce(f.least, d.doc_id)) as component_id,
  least(d.doc_id, coalesce(f.least, d.doc_id)) = d.doc_id as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join found f on f.doc_id = d.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_minhash_near_dedup": OP3_SQL, "op4_license_scan": licenses.sql(), "op8_line_dedup": OP8_SQL}
