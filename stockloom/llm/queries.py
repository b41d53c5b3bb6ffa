"""The registered queries of this package and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stockloom.llm.common import ready, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(build: Callable[[SparkSession, str], DataFrame]):
    QUERIES[build.__name__] = build
    return build


def vocabulary() -> str:
    """Default place of the byte-level vocabulary; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op10_pack_documents(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.packing import pack_documents

    return pack_documents(table(ready(spark), directory, "documents"), vocabulary())


@query
def op8_simhash_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.simhash import near_duplicates

    return near_duplicates(table(ready(spark), directory, "documents"))


@query
def op7_language_id(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.language import identify

    return identify(table(ready(spark), directory, "documents"))


@query
def op9_document_fingerprints(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.sketches import compare_edits

    return compare_edits(table(ready(spark), directory, "documents"))


# Host rules of the url query: (verdict, host and start of the path).
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query
def op1_url_filter(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.urls import judge_urls

    return judge_urls(table(ready(spark), directory, "pages"), URL_RULES)


@query
def op3_embedding_near_duplicates(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.embeddings import near_vectors

    return near_vectors(table(ready(spark), directory, "embeddings"))


@query
def op2_warc_round_trip(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.warc import archive_pages, archived_records

    pages = table(ready(spark), directory, "pages")
    return archived_records(archive_pages(pages), pages.schema["page_id"].dataType)


SQL["op2_warc_round_trip"] = """
WITH p AS (
    SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), d AS (
    SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, unhex(sha1(body)) AS raw,
           min(page_id) OVER (PARTITION BY body) AS first_page
    FROM p
), bits AS (
    SELECT page_id, payload_bytes, first_page,
           list_transform(range(0, 20), lambda i: ('0x' || substr(hex(raw), 2 * i + 1, 2))::BIGINT) AS b
    FROM d
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 +
           (((b[5 * k // 8 + 1] * 256 + coalesce(b[5 * k // 8 + 2], 0)) >> (11 - 5 * k % 8)) & 31))::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_page THEN first_page END AS refers_to
FROM bits
"""


@query
def op4_source_mixture(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.mixing import mixture_schedule

    return mixture_schedule(table(ready(spark), directory, "documents")).drop("copies")


SQL["op4_source_mixture"] = """
WITH RECURSIVE docs AS (
    SELECT doc_id, source, length(coalesce(text, ''))::BIGINT AS size FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS total FROM docs GROUP BY source
), parts AS (
    SELECT source, greatest(1, ceil(total / 65536.0))::BIGINT AS blocks,
           greatest(1, floor(1000 * pow(total, 0.75) / sum(pow(total, 0.75)) OVER () + 0.5))::BIGINT AS n,
           row_number() OVER (ORDER BY source) AS i
    FROM totals
), given AS (
    SELECT list(n ORDER BY i) AS ns, sum(n)::BIGINT AS q, count(*)::BIGINT AS k FROM parts
), turns AS (
    SELECT -1::BIGINT AS t, list_transform(ns, lambda x: 0::BIGINT) AS done, 0::BIGINT AS pick FROM given
    UNION ALL
    SELECT t + 1, list_transform(done, lambda d, j: d + (j = best)::BIGINT), best
    FROM (
        SELECT t, done, list_position(due, list_min(due))::BIGINT AS best
        FROM (
            SELECT t, done, list_transform(ns, lambda x, j:
                CASE WHEN done[j] * q // x <= t + 1 THEN (((done[j] + 1) * q + x - 1) // x) * k + j
                     ELSE 9000000000000000 END) AS due
            FROM turns, given WHERE t + 1 < q
        )
    )
), slots AS (
    SELECT pick AS i, t AS slot, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM turns WHERE t >= 0
), last_slot AS (
    SELECT max((blocks - 1) // n * q + slot) + 1 AS stop
    FROM parts JOIN slots USING (i), given WHERE j = (blocks - 1) % parts.n
), granted AS (
    SELECT i, any_value(stop) // any_value(q) * any_value(parts.n) + count(*) FILTER (slot < stop % q) AS granted
    FROM parts JOIN slots USING (i), given, last_slot GROUP BY i
), placed AS (
    SELECT doc_id, source, size,
           (sum(size) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
    FROM docs
), blocked AS (
    SELECT p.*, parts.i, parts.n, parts.blocks, g.granted, least(start // 65536, parts.blocks - 1) AS block
    FROM placed p JOIN parts USING (source) JOIN granted g USING (i)
), repeated AS (
    SELECT *, unnest(range(0, (granted - 1 - block) // blocks + 1)) AS epoch FROM blocked
)
SELECT doc_id, source, size, start, block, epoch,
       (epoch * blocks + block) // r.n * q + slot AS slot
FROM repeated r JOIN slots s ON s.i = r.i AND s.j = (epoch * blocks + block) % r.n, given
"""


@query
def op5_training_order(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.shards import order_documents

    return order_documents(table(ready(spark), directory, "documents"), vocabulary())


@query
def op6_main_text(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.html import extract_pages

    return extract_pages(table(ready(spark), directory, "pages"))


SQL["op3_embedding_near_duplicates"] = """
WITH RECURSIVE v AS (
    SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
    SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS norm, len(e) AS n FROM v
    WHERE len(e) > 0 AND list_count(e) = len(e) AND len(list_filter(e, lambda x: isfinite(x))) = len(e)
      AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.n = b.n
    WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9
), reach AS (
    SELECT a, b FROM links
    UNION
    SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), lowest AS (
    SELECT a, min(b) AS low FROM reach GROUP BY a
), counted AS (
    SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low, vec_id)) AS kept
FROM embeddings LEFT JOIN counted c ON c.a = vec_id LEFT JOIN lowest l ON l.a = vec_id
"""


@query
def op11_token_alignment(spark: SparkSession, directory: str) -> DataFrame:
    import public_tokenizers
    from stockloom.llm.alignment import align_documents

    docs = table(ready(spark), directory, "documents")
    return align_documents(docs, vocabulary(), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op12_filter_scores(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.lm import score_documents

    return score_documents(table(ready(spark), directory, "documents"))


@query
def op13_phrases(spark: SparkSession, directory: str) -> DataFrame:
    from stockloom.llm.phrases import mine_phrases

    return mine_phrases(table(ready(spark), directory, "documents"))


SQL["op13_phrases"] = """
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[.,;:!?\\x0A-\\x0D]')), '[^ \\x09]+') AS w
    FROM documents
), starts AS (
    SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces
), grams AS (
    SELECT lang, unnest(list_transform(range(1, least(3, len(w) - i + 1) + 1), lambda k: w[i:i + k - 1])) AS g FROM starts
), f AS (
    SELECT lang, g, count(*)::HUGEINT AS f FROM grams GROUP BY lang, g
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY lang
), candidates AS (
    SELECT lang, g, f AS a FROM f WHERE len(g) > 1 AND f >= 10
), cuts AS (
    SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM candidates
), scored AS (
    SELECT c.lang, c.g, c.a, c.k, x.f AS l, y.f AS r, 1000000 * c.a * c.a // (x.f * y.f) AS score
    FROM cuts c JOIN f x ON x.lang = c.lang AND x.g = c.g[1:c.k] JOIN f y ON y.lang = c.lang AND y.g = c.g[c.k + 1:]
), best AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1
), inside AS (
    SELECT lang, unnest([g[1:2], g[2:3]]) AS g, a AS longer FROM candidates WHERE len(g) = 3
), most AS (
    SELECT lang, g, max(longer) AS longer FROM inside GROUP BY lang, g
), ranked AS (
    SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.l, b.r, b.score FROM best b LEFT JOIN most m ON m.lang = b.lang AND m.g = b.g
    WHERE longer IS NULL OR 100 * longer < 50 * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase,
       a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score
FROM ranked JOIN totals USING (lang) QUALIFY rank <= 2000
"""
