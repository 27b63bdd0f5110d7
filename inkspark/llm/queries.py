"""The registered queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import new_path
from . import exact_dedup as exact
from . import hard_negatives as mining
from . import html_extract, licenses, mixing, near_dedup, packing, periodic, quality, sharding
from . import line_dedup as line
from . import token_files, warc
from .common import n_words, table


def tokenizer_file() -> str:
    """The public vocabulary that the contract names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_line_dedup(spark, sf_dir):
    out = line.line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "text", "lines_removed")


def op2_near_dedup(spark, sf_dir):
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=4)


def op3_mix_sources(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    sizes = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.mix(sizes).select(
        "doc_id", "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate", "source",
    )


def op4_main_text(spark, sf_dir):
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op5_license_scan(spark, sf_dir):
    found = licenses.license_scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "licenses", "n_sentences")


def op6_token_files(spark, sf_dir):
    path = new_path(spark, "token-files")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_file())
    read = token_files.read_tokens(spark, path).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return token_files.with_starts(read)


def op7_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.digests(packing.pack(packing.pieces_of(docs, tokenizer_file())))


def op8_quality_rules(spark, sf_dir):
    out = quality.quality_rules(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    )
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "llr",
    )


def op9_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(table(spark, sf_dir, "documents"))


def op10_shards(spark, sf_dir):
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    return sharding.shard(rows).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op11_periodic_runs(spark, sf_dir):
    found = periodic.periodic_runs(periodic.repeated_tails(table(spark, sf_dir, "documents")))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform(
        "runs",
        lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")),
    )
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_hard_negatives(spark, sf_dir):
    seventh = F.col("vec_id") % 7 == 0
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.when(seventh, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        mining.scaled(F.col("embedding"), 256).alias("vector"),
    )
    return mining.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_warc(spark, sf_dir):
    path = new_path(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_near_dedup": op2_near_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_main_text": op4_main_text,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_quality_rules": op8_quality_rules,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_shards": op10_shards,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_warc": op13_warc,
}

# Windows of lines just long enough, from each line on and up to each line; of equal windows
# all but the first are copies, unless they overlap it.
_LINES = r"""
        WITH line AS (
          SELECT doc_id, unnest(x) AS line, unnest(range(len(x))) AS no
          FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)),
        numbered AS (
          SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS seq
          FROM (SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM line)
          WHERE n > 0),
        summed AS (
          SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY seq) AS upto FROM numbered),
        run AS (
          SELECT a.doc_id, a.seq AS start, b.seq - a.seq + 1 AS d
          FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.seq BETWEEN a.seq AND a.seq + @ - 1
          WHERE b.upto - a.upto + a.n >= @
            AND (b.upto - b.n - a.upto + a.n < @ OR b.upto - a.upto < @)),
        named AS (
          SELECT r.doc_id, start, d, string_agg(line, chr(10) ORDER BY seq) AS body
          FROM run r JOIN numbered l ON l.doc_id = r.doc_id AND seq BETWEEN start AND start + d - 1
          GROUP BY r.doc_id, start, d),
        placed AS (
          SELECT *, first_value(doc_id) OVER w AS first_doc, first_value(start) OVER w AS first_start
          FROM named WINDOW w AS (PARTITION BY body ORDER BY doc_id, start)),
        cut AS (
          SELECT DISTINCT l.doc_id, l.no
          FROM placed p JOIN numbered l ON l.doc_id = p.doc_id AND seq BETWEEN start AND start + d - 1
          WHERE NOT (first_doc = p.doc_id AND start < first_start + d)),
        rest AS (
          SELECT doc_id, count(c.no) AS lines_removed,
                 string_agg(line, chr(10) ORDER BY l.no) FILTER (c.no IS NULL) AS body
          FROM line l LEFT JOIN cut c USING (doc_id, no) GROUP BY doc_id)
        SELECT doc_id, CASE WHEN lines_removed > 0 THEN coalesce(body, '') ELSE text END AS text,
               coalesce(lines_removed, 0) AS lines_removed
        FROM documents LEFT JOIN rest USING (doc_id)
"""

# Every pair that shares a shingle is counted; components are what can be reached.
_NEAR = r"""
        WITH RECURSIVE word AS (
          SELECT doc_id, regexp_extract_all(
                   translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                   '[^\x20\x09-\x0D]+') AS w
          FROM documents),
        held AS MATERIALIZED (
          SELECT doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(
                                [array_to_string(w[i:i + 3], ' ') for i in range(1, len(w) - 2)])
                              WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
          FROM word),
        each AS MATERIALIZED (SELECT doc_id, unnest(s) AS v FROM held),
        pair AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
          FROM each a JOIN each b ON a.v = b.v AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        link AS MATERIALIZED (
          SELECT a, b FROM pair JOIN held x ON x.doc_id = a JOIN held y ON y.doc_id = b
          WHERE 100 * c >= 80 * (len(x.s) + len(y.s) - c)),
        reach AS (
          SELECT doc_id, doc_id AS other FROM held
          UNION SELECT r.doc_id, l.b FROM reach r JOIN link l ON l.a = r.other)
        SELECT doc_id, len(any_value(s)) AS n_shingles, min(other) AS component_id,
               doc_id = min(other) AS kept
        FROM held JOIN reach USING (doc_id) GROUP BY doc_id
"""

# Of equal texts (runs of white space as one space) the smallest id stays.
ORACLE: dict[str, str] = {
    "op1_line_dedup": _LINES.replace("@", str(line.MIN_WORDS)),
    "op2_near_dedup": _NEAR,
    "op5_license_scan": licenses.oracle(),
    "op9_exact_dedup": r"""
        WITH hashed AS (
          SELECT doc_id,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'))
                   AS text_sha256
          FROM documents),
        owned AS (
          SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size
          FROM hashed GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256
        FROM hashed JOIN owned USING (text_sha256)
    """,
    "op12_hard_negatives": """
        WITH held AS (
          SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                 [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
          FROM embeddings
          WHERE label IS NOT NULL AND embedding IS NOT NULL
            AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        scored AS (
          SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                 list_dot_product(a.q, b.q)::BIGINT AS score
          FROM held a JOIN held b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positive AS (
          SELECT * FROM scored WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
        SELECT p.anchor_id, p.other_id AS positive_id,
               (row_number() OVER (PARTITION BY p.anchor_id, p.other_id
                                   ORDER BY n.score DESC, n.other_id))::INT AS rank,
               n.other_id AS negative_id, p.score AS positive_score, n.score AS negative_score
        FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same
         AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
        QUALIFY rank <= 3
    """,
    # Base32 takes five bits for a character, eight characters for ten hex digits.
    "op13_warc": """
        WITH held AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        first AS (SELECT html, min(page_id) AS first FROM held GROUP BY html),
        digest AS (
          SELECT page_id, first, strlen(html) AS payload_bytes, sha1(html) AS hex
          FROM held JOIN first USING (html))
        SELECT page_id, payload_bytes,
               list_aggregate([
                 substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                        ((('0x' || substr(hex, 10 * (i // 8) + 1, 10))::BIGINT
                          >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)
                 FOR i IN range(32)], 'string_agg', '') AS payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM digest
    """,
}
