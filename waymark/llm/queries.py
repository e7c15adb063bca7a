"""Registered queries of this subpackage, and their SQL statements."""

from __future__ import annotations

from pyspark.sql import functions as F

from waymark.llm import alignment, collocation, crf, jaccard, lines, mixture, naming, perspectives, positional, reshard, secrets, token_files, warc
from waymark.llm.common import table
from waymark.session import tune

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op4_positional_index")
def op4(spark, sf):
    """Words of documents that stand in 13-word windows of benchmark items."""
    judged = positional.contamination(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated",
    )


@query("op7_mixture", r"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT source, source_size, [5, 2, 1][(r - 1) % 3 + 1] AS weight, 2 * source_size AS most, r FROM s),
o AS (SELECT *, coalesce(sum(most) OVER (ORDER BY most / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
  sum(weight) OVER (ORDER BY most / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open, sum(source_size) OVER () AS total FROM w),
l AS (SELECT *, (1.5::DOUBLE * total - held) / open AS level FROM o),
f AS (SELECT level FROM l WHERE weight * level <= most ORDER BY most / weight, r LIMIT 1),
t AS (SELECT source, source_size, least(weight * f.level, most::DOUBLE) AS target FROM w, f),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), ''))[1:13] AS BIGINT)::DOUBLE / 4503599627370496 AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + (u < rate - floor(rate))::INT) AS BIGINT) AS taken FROM j""")
def op7(spark, sf):
    """Words that the mix takes of every document."""
    return mixture.taken_words(table(spark, sf, "documents"))


@query("op8_block_naming", r"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256 FROM t JOIN g USING (body)""")
def op8(spark, sf):
    """Exact groups of whole texts."""
    return naming.exact_groups(table(spark, sf, "documents"))


@query("op1_warc_dictionary")
def op1(spark, sf):
    """Pages written to archives and read back."""
    records = warc.read_archives(warc.write_archives(table(spark, sf, "pages")), payloads=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


@query("op5_line_deletions")
def op5(spark, sf):
    """Lines of documents that repeat an earlier one, whatever their length, or differ from it by one edit."""
    return lines.dropped_lines(table(spark, sf, "documents"), least_exact=0)


@query("op9_perspectives", r"""WITH t AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations),
s AS (SELECT DISTINCT conv_id, role AS speaker FROM t WHERE role <> 'system'),
j AS (SELECT t.*, speaker, CASE WHEN role = 'system' THEN 'system' WHEN role = speaker THEN 'assistant' ELSE 'user' END AS as_role FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
h AS (SELECT *, '<|im_start|>' || as_role || CASE WHEN as_role = 'user' THEN ' name=' || role ELSE '' END || chr(10) AS head FROM j),
g AS (SELECT *, head || text || '<|im_end|>' || chr(10) AS segment FROM h),
e AS (SELECT *, CAST(sum(length(segment)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "end" FROM g)
SELECT conv_id, speaker, turn, as_role, segment, "end" - length(segment) AS begin, "end", CASE WHEN as_role = 'assistant' THEN "end" - length(segment) + length(head) END AS mask_begin,
  CASE WHEN as_role = 'assistant' THEN "end" - 1 END AS mask_end FROM e""")
def op9(spark, sf):
    """Every dialogue from each speaker's side."""
    return perspectives.rotate(table(spark, sf, "conversations"))


@query("op10_token_efficiency")
def op10(spark, sf):
    """Spans of secrets: the stated kinds, and random strings."""
    found = secrets.scan(spark, table(spark, sf, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")


@query("op6_vertical_partitions")
def op6(spark, sf):
    """Groups of documents that share four fifths of their five-word shingles."""
    return jaccard.similar_groups(table(spark, sf, "documents")).select("doc_id", "n_shingles", "component_id")


OLD_SHARDS, NEW_SHARDS = 12, 16


@query("op3_min_cost_reshard")
def op3(spark, sf):
    """Documents moved from shards by source to sixteen of near equal bytes."""
    docs = table(spark, sf, "documents")
    by_source = F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(OLD_SHARDS))
    sharded = reshard.reshard(docs, by_source, OLD_SHARDS, NEW_SHARDS)
    text = F.coalesce("text", F.lit(""))
    return sharded.select("doc_id", reshard.size_of("text").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "moved")


@query("op2_crf_language")
def op2(spark, sf):
    """Languages of whole documents, learned from the rows that are not held out."""
    docs = table(spark, sf, "documents")
    return crf.predict(docs, crf.learn(docs)).select("doc_id", crf.held_out().alias("held_out"), "lang_pred", "score")


@query("op11_simple8b_ids")
def op11(spark, sf):
    """Token ids of whole documents, written to files in order and read back."""
    return token_files.read_tokens(token_files.write_tokens(table(spark, sf, "documents"))).drop("ids")


@query("op12_pointer_jumping")
def op12(spark, sf):
    """Groups and links of the tokens of two tokenizers."""
    return alignment.align(table(spark, sf, "documents"))[0]


@query("op13_count_streams")
def op13(spark, sf):
    """Phrases of each language that are said more often than their parts would be."""
    return collocation.collocations(table(spark, sf, "documents"))
