"""Queries of problem 2: records too long for a strategy, and their pieces."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataloom.llm.splitting import piece_text, split_files, split_texts
from strataloom.session import ensure_checkpoint_dir
from strataloom.sources.tables import table

KEYS = ["doc_id", "doc_version"]
FILES, FILE_RANGE = 64, 1 << 20


def _pieces(spark: SparkSession, folder: str, only_cut: bool) -> DataFrame:
    return split_texts(table(spark, folder, "document_records"), table(spark, folder, "chunk_strategies"), KEYS, "text", only_cut=only_cut)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each pair of a record and a strategy under which it comes out in several pieces."""
    return _pieces(spark, folder, True).filter("piece_no = 0").select(*KEYS, "strategy_name", "strategy_version")


def p2_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of every record under every strategy, by offset into its text."""
    return _pieces(spark, folder, False)


def p2_piece_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The pieces of oversized records with their text."""
    texts = table(spark, folder, "document_records").select(*KEYS, "text").dropDuplicates(KEYS)
    pieces = _pieces(spark, folder, True)
    return pieces.join(texts, KEYS).select(*pieces.columns, piece_text("text").alias("piece_text"))


def p2_files(spark: SparkSession, folder: str) -> DataFrame:
    """The records' texts written as files of plain text in the shared folder, and the pieces of each file by byte offset."""
    path = f"{ensure_checkpoint_dir(spark)}/texts-{uuid.uuid4().hex}"
    texts = table(spark, folder, "document_records").filter("text is not null").dropDuplicates(KEYS)
    named = texts.select(F.pmod(F.crc32("doc_id"), F.lit(FILES)).alias("part"), *KEYS, "text").repartition(FILES, "part").sortWithinPartitions("part", *KEYS)
    named.select("part", "text").write.partitionBy("part").text(path)
    pieces = split_files(spark, f"{path}/part=*/*", table(spark, folder, "chunk_strategies"), range_bytes=FILE_RANGE)
    return pieces.select(F.regexp_extract("path", r"part=(\d+)", 1).cast("int").alias("part"), *pieces.columns[1:])


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces, "p2_piece_texts": p2_piece_texts, "p2_files": p2_files}

#: White space is written out, as the SQL engine's own class knows ASCII only.
_WHITE = r"\x{9}-\x{d}\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKEN = f"[^{_WHITE}]+"
_BREAK = r"\x{d}\x{a}|[\x{a}-\x{d}\x{85}\x{2028}\x{2029}]"
_END = r"""[.!?\x{2026}\x{3002}\x{ff01}\x{ff1f}\x{61f}\x{964}]["\x{27})\]}>\x{bb}\x{201d}\x{2019}*_]{0,2}$"""
ORACLES = {
    "p2_found": f"""
        WITH n AS (SELECT DISTINCT doc_id, doc_version, len(regexp_extract_all(text, '{_TOKEN}')) AS n FROM document_records WHERE text IS NOT NULL)
        SELECT n.doc_id, n.doc_version, s.strategy_name, s.strategy_version FROM n JOIN chunk_strategies s ON n.n > s.chunk_size_tokens""",
    "p2_pieces": f"""
        WITH d AS (SELECT DISTINCT doc_id, doc_version, text FROM document_records WHERE text IS NOT NULL),
        x AS (SELECT doc_id, doc_version, len(regexp_extract(text, '^[{_WHITE}]*')) AS lead, regexp_extract_all(text, '{_TOKEN}') AS toks, regexp_extract_all(text, '{_TOKEN}([{_WHITE}]*)', 1) AS gaps FROM d),
        t AS (SELECT doc_id, doc_version, lead, len(toks) AS n, unnest(range(len(toks))) AS i, unnest(toks) AS tok, unnest(gaps) AS gap FROM x),
        p AS (SELECT *, lead + coalesce(sum(len(tok) + len(gap)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, least(2, len(regexp_extract_all(lag(gap) OVER w, '{_BREAK}'))) AS breaks, regexp_matches(lag(tok) OVER w, '{_END}') AS sentence
            FROM t WINDOW w AS (PARTITION BY doc_id, doc_version ORDER BY i)),
        q AS (SELECT doc_id, doc_version, n, i, b, b + len(tok) AS e, CASE WHEN breaks > 0 THEN breaks + 1 WHEN sentence THEN 1 ELSE 0 END AS strength FROM p),
        s AS (SELECT DISTINCT strategy_name, strategy_version, chunk_size_tokens AS size, o, (chunk_size_tokens - o) // 2 AS slack, chunk_size_tokens - o - (chunk_size_tokens - o) // 2 AS step
            FROM (SELECT *, least(greatest(coalesce(chunk_overlap_tokens, 0), 0), chunk_size_tokens - 1) AS o FROM chunk_strategies) WHERE chunk_size_tokens >= 1),
        g AS (SELECT doc_id, doc_version, strategy_name, strategy_version, n, size, o, step, slack, i, strength, ceil((i - o) / step)::BIGINT AS k, ceil((n - o) / step)::BIGINT AS last FROM q, s WHERE n > size),
        c AS (SELECT doc_id, doc_version, strategy_name, strategy_version, n, o, last, k, max(strength * 1000000000 + i) % 1000000000 AS cut FROM g WHERE k > 0 AND k < last AND i > o + k * step - greatest(slack, 1) GROUP BY ALL
            UNION ALL SELECT DISTINCT doc_id, doc_version, strategy_name, strategy_version, n, CASE WHEN n > size THEN o ELSE 0 END, CASE WHEN n > size THEN ceil((n - o) / step)::BIGINT ELSE 1 END, 0, CASE WHEN n > size THEN o ELSE 0 END FROM q, s),
        r AS (SELECT *, coalesce(lead(cut) OVER (PARTITION BY doc_id, doc_version, strategy_name, strategy_version ORDER BY k), n) AS after FROM c)
        SELECT r.doc_id, r.doc_version, strategy_name, strategy_version, k::INT AS piece_no, last::INT AS n_pieces, (cut - o)::BIGINT AS first_token, (after - cut + o)::BIGINT AS n_tokens, f.b::BIGINT AS char_start, l.e::BIGINT AS char_end
        FROM r JOIN q f ON f.doc_id = r.doc_id AND f.doc_version = r.doc_version AND f.i = cut - o JOIN q l ON l.doc_id = r.doc_id AND l.doc_version = r.doc_version AND l.i = after - 1""",
}
