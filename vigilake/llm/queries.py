"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, conversation_repair, decontamination, exact_dedup, line_dedup, near_dup, neighbours, packing, pii, token_files, toxicity, warc, whitening
from .common import scratch, table


def op3_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.render(table(spark, sf_dir, "conversations"))


OP3 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS body,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
         count(*) OVER (PARTITION BY conv_id) AS turns
  FROM conversations),
p AS (
  SELECT *, '<|' || role || '|>' || chr(10) || body || '<|end|>' || chr(10) AS said,
         string_agg(md5(role) || md5(body), '') OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM t),
whole AS (SELECT prefix, min(conv_id) AS conv_id FROM p WHERE pos = turns GROUP BY prefix),
kept AS (SELECT conv_id FROM whole WHERE prefix NOT IN (SELECT prefix FROM p WHERE pos < turns))
SELECT p.conv_id, CAST(floor((pos - 1) / 1024) AS BIGINT) AS part, CAST(max(turns) AS BIGINT) AS turns,
       CAST(min(pos) AS BIGINT) AS first_turn, string_agg(said, '' ORDER BY pos) AS chat
FROM p JOIN kept USING (conv_id) GROUP BY 1, 2
"""


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4 = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, octet_length(body) AS n, upper(sha1(body)) AS code FROM p),
o AS (SELECT page_id, n, code, max(page_id) OVER (PARTITION BY code) AS owner FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform(range(4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST('0x' || substr(code, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INTEGER)) & 31) AS BIGINT), 1)), '')), '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM o
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


OP6 = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, CAST(count(*) OVER same AS BIGINT) AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed"), F.sha2("text", 256).alias("text_sha256"))


OP10 = """
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, i AS pos, array_to_string(list_slice(lines, i + 1, i + 3), chr(10)) AS body, least(len(lines), 3) AS size
  FROM (SELECT doc_id, lines, unnest(range(greatest(len(lines) - 2, 1))) AS i FROM d)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY size, body ORDER BY doc_id, pos) AS nth FROM w WHERE trim(regexp_replace(body, '\\s+', ' ', 'g')) <> ''),
g AS (SELECT DISTINCT r.doc_id, pos + k AS line FROM r, range(3) AS s(k), d WHERE nth > 1 AND d.doc_id = r.doc_id AND pos + k < len(d.lines)),
l AS (SELECT doc_id, u.i AS line, lines[u.i + 1] AS body, len(lines) AS n FROM d, unnest(range(len(lines))) AS u(i))
SELECT l.doc_id, CAST(max(n) AS INTEGER) AS n_lines,
       coalesce(string_agg(CAST(g.line AS VARCHAR), ',' ORDER BY g.line) FILTER (WHERE g.line IS NOT NULL), '') AS removed,
       sha256(coalesce(string_agg(body, chr(10) ORDER BY l.line) FILTER (WHERE g.line IS NULL), '')) AS text_sha256
FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = l.line GROUP BY l.doc_id
"""



def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), stride=20)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train_on(docs))

    def listed(spans):
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.getField("kind"), s.getField("begin").cast("string"), s.getField("end").cast("string"))))

    def number_of(kind):
        return F.size(F.filter("spans", lambda s: s.getField("base") & (s.getField("kind") == kind))).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s.getField("base"))
    return found.select(
        "doc_id", *map(number_of, pii.KINDS), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), (F.size("spans") - F.size(base)).cast("long").alias("n_added")
    )


def in_fold(column: str = "doc_id"):
    """Whether a row's label is held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def toxicity_field(spark: SparkSession, docs: DataFrame, sf_dir: str) -> toxicity.Field:
    return toxicity.train(docs, table(spark, sf_dir, "labels").where(~in_fold()))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity_field(spark, docs, sf_dir))
    return scored.select("doc_id", in_fold().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").cast("long").alias("n_spans"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("code")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_files.checksums(token_files.read_tokens(spark, path))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    told, turns = conversation_repair.repair(conversation_repair.damage(rows))
    prints = conversation_repair.fingerprints(turns).select("conv_id", "sha256")
    every = rows.select(F.col("conv_id").alias("id")).distinct()
    out = every.join(told, F.col("id").eqNullSafe(told["conv_id"]), "left").drop("conv_id").join(prints, F.col("id").eqNullSafe(prints["conv_id"]), "left")
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    )


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return neighbours.search(neighbours.index(rows), rows.where("vec_id % 20 = 0"), 20)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.vectors(table(spark, sf_dir, "embeddings"))
    return whitening.whiten(rows, whitening.fit(rows))


QUERIES = {
    "op1_decontamination": (op1_decontamination, None),
    "op3_chat_snapshots": (op3_chat_snapshots, OP3),
    "op4_warc_round_trip": (op4_warc_round_trip, OP4),
    "op2_pii": (op2_pii, None),
    "op7_toxicity": (op7_toxicity, None),
    "op5_near_duplicates": (op5_near_duplicates, None),
    "op6_exact_dedup": (op6_exact_dedup, OP6),
    "op8_token_files": (op8_token_files, None),
    "op9_packing": (op9_packing, None),
    "op10_line_dedup": (op10_line_dedup, OP10),
    "op11_conversation_repair": (op11_conversation_repair, None),
    "op12_nearest_neighbours": (op12_nearest_neighbours, None),
    "op13_whitening": (op13_whitening, None),
}
