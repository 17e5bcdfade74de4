"""Queries of the subpackage by name, and the SQL that some must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm.encoding import restore_encoding
from paperloom.llm.leakage import leaked_items
from paperloom.llm.near_duplicates import duplicate_groups, similar_rows, text_rows
from paperloom.llm.packing import pack, pack_each, pack_tiers_of_each, token_sizes
from paperloom.llm.quality import classify_form, text_statistics
from paperloom.llm.repeated_lines import repeated_lines, without_repeated_lines
from paperloom.llm.scan_noise import repair_scans
from paperloom.llm.splitting import split_oversized
from paperloom.session import shared, table


def p1_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages and record titles with wrongly decoded stretches, with the text as first written where it can be found."""
    return restore_encoding([
        ("document_pages", table(spark, sf_dir, "document_pages"), "page_row_id", "text"),
        ("source_records", table(spark, sf_dir, "source_records"), "record_seq", "title"),
    ])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_restored(spark, sf_dir).select("tbl", "row_id")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every page and chunk over its source's target."""
    options = table(spark, sf_dir, "chunk_options")
    pages = split_oversized(table(spark, sf_dir, "document_pages"), "document_pages", "page_row_id", options, "page_number", "page_number")
    chunks = split_oversized(table(spark, sf_dir, "canonical_chunks"), "canonical_chunks", "chunk_row_id", options, "page_start", "page_end")
    return pages.unionByName(chunks)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).filter("piece_no = 1 AND n_pieces > 1").select("tbl", "row_id")


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as continuous paragraphs, with what was repaired."""
    return repair_scans(table(spark, sf_dir, "document_pages"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [("hyphen", "n_hyphen"), ("char", "n_char"), ("header", "n_header"), ("page_no", "n_page_no")]
    found = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.lit(k)) for k, c in kinds]))
    return p3_repaired(spark, sf_dir).select("page_row_id", F.explode(found).alias("noise"))


def _chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_rows(table(spark, sf_dir, "canonical_chunks"), "chunk_row_id", "document_key", F.col("text"))


def _record_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = F.when(F.col("description").isNotNull(), F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.col("description")))
    return text_rows(table(spark, sf_dir, "source_records"), "record_seq", "id", described)


def p5_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similar rows of different documents (chunks) or records, with their similarity."""
    chunks = similar_rows(_chunk_texts(spark, sf_dir)).withColumn("tbl", F.lit("canonical_chunks"))
    records = similar_rows(_record_texts(spark, sf_dir)).withColumn("tbl", F.lit("source_records"))
    return chunks.unionByName(records).select("tbl", "id_a", "id_b", "similarity")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pairs(spark, sf_dir).select("tbl", "id_a", "id_b")


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of equal texts, group of similar ones and number of links of every chunk and described record."""
    chunks = duplicate_groups(_chunk_texts(spark, sf_dir)).withColumn("tbl", F.lit("canonical_chunks"))
    records = duplicate_groups(_record_texts(spark, sf_dir)).withColumn("tbl", F.lit("source_records"))
    return chunks.unionByName(records).select("tbl", "row_id", "class_id", "group_id", "n_links")


def p6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each source repeats, with the number of its documents that have them."""
    confirmed, _ = repeated_lines(table(spark, sf_dir, "document_pages"))
    return confirmed.select(F.col("src").alias("source"), F.col("form").alias("line_form"), "n_docs", "src_docs")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, places = repeated_lines(table(spark, sf_dir, "document_pages"))
    return places.select(F.col("page_id").alias("page_row_id"), "line_no")


def p6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page without its source's repeated lines."""
    pages = table(spark, sf_dir, "document_pages")
    confirmed, _ = repeated_lines(pages)
    return without_repeated_lines(pages, confirmed).select(F.col("page_id").alias("page_row_id"), "n_removed", "text")


def _capacities(spark: SparkSession, sf_dir: str) -> dict[str, int]:
    return {r[0]: r[1] for r in table(spark, sf_dir, "containers").filter("capacity_tokens > 0").select("container", "capacity_tokens").collect()}


def p8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents once for each capacity as the largest, each routed to the tier of its length among the capacities
    up to it, longer containers' gaps filled from shorter tiers."""
    return pack_tiers_of_each(token_sizes(table(spark, sf_dir, "documents")), _capacities(spark, sf_dir))


def p8_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in containers of each capacity alone, once per capacity."""
    return pack_each(token_sizes(table(spark, sf_dir, "documents")), _capacities(spark, sf_dir))


def p8_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents once, each routed to the tier of its length, longer containers' gaps filled from shorter tiers."""
    return pack(shared(token_sizes(table(spark, sf_dir, "documents"))), _capacities(spark, sf_dir))


def p9_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and items with similar or equal windows of 13 words, or with a window of the item's length that is a near
    copy of the item."""
    return leaked_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_windows(spark, sf_dir).filter("n_exact > 0").select("doc_id", "item_id")


def p10_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_statistics(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))


def p10_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's kind by the mixture."""
    return classify_form(p10_statistics(spark, sf_dir), table(spark, sf_dir, "doc_labels"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p10_kinds(spark, sf_dir).filter("kind <> 'prose'").select("doc_id")


QUERIES = {
    "p1_found": p1_found, "p1_restored": p1_restored,
    "p2_found": p2_found, "p2_pieces": p2_pieces,
    "p3_found": p3_found, "p3_repaired": p3_repaired,
    "p5_found": p5_found, "p5_pairs": p5_pairs, "p5_groups": p5_groups,
    "p6_found": p6_found, "p6_lines": p6_lines, "p6_pages": p6_pages,
    "p8_pack": p8_pack, "p8_tiers": p8_tiers, "p8_each": p8_each,
    "p9_found": p9_found, "p9_windows": p9_windows,
    "p10_found": p10_found, "p10_kinds": p10_kinds, "p10_statistics": p10_statistics,
}

_WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_LINES = rf"""
WITH l AS (SELECT page_row_id, document_key, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM document_pages WHERE text IS NOT NULL),
f AS (SELECT *, trim(regexp_replace(regexp_replace(lower(line), '\p{{Nd}}+', '#', 'g'), '[{_WHITE}]+', ' ', 'g')) AS form FROM l WHERE regexp_matches(line, '(?:\p{{L}}+[^\p{{L}}]+){{3}}\p{{L}}') AND source IS NOT NULL AND document_key IS NOT NULL),
s AS (SELECT source, count(DISTINCT document_key) AS src_docs FROM document_pages GROUP BY 1),
k AS (SELECT source, form, count(DISTINCT document_key) AS n_docs FROM f GROUP BY 1, 2),
c AS (SELECT source, form, n_docs, src_docs FROM k JOIN s USING (source) WHERE n_docs >= 3 AND n_docs >= 0.08 * src_docs)
"""
_SIMILAR = r"""
WITH RECURSIVE r AS (SELECT 'canonical_chunks' AS tbl, chunk_row_id AS id, document_key AS own, text FROM canonical_chunks WHERE text IS NOT NULL
UNION ALL SELECT 'source_records', record_seq, id, coalesce(title, '') || ' ' || description FROM source_records WHERE description IS NOT NULL),
w AS (SELECT tbl, id, own, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM r),
g AS (SELECT DISTINCT tbl, id, own, hash(array_to_string(w[k:k + 2], ' ')) AS g FROM (SELECT tbl, id, own, w, unnest(range(1, len(w) - 1)) AS k FROM w)),
n AS (SELECT tbl, id, count(*) AS n FROM g GROUP BY 1, 2),
"""
_PAIRS = _SIMILAR + r"""
c AS (SELECT x.tbl, x.id AS id_a, y.id AS id_b, count(*) AS c FROM g x JOIN g y ON x.tbl = y.tbl AND x.g = y.g AND x.id < y.id AND x.own <> y.own GROUP BY 1, 2, 3),
p AS (SELECT c.tbl, id_a, id_b, c.c, a.n AS n_a, b.n AS n_b FROM c JOIN n a ON a.tbl = c.tbl AND a.id = id_a JOIN n b ON b.tbl = c.tbl AND b.id = id_b WHERE 2 * c.c >= a.n + b.n - c.c)
"""
_GROUPS = _SIMILAR + r"""
t AS (SELECT tbl, text, min(id) AS class_id FROM r GROUP BY 1, 2), m AS (SELECT r.tbl, r.id AS row_id, class_id FROM r JOIN t ON r.tbl = t.tbl AND r.text = t.text),
f AS (SELECT g.tbl, g.id, g.g FROM g JOIN t ON g.tbl = t.tbl AND g.id = t.class_id),
c AS (SELECT x.tbl, x.id AS a, y.id AS b, count(*) AS c FROM f x JOIN f y ON x.tbl = y.tbl AND x.g = y.g AND x.id <> y.id GROUP BY 1, 2, 3),
l AS (SELECT c.tbl, c.a, c.b FROM c JOIN n x ON x.tbl = c.tbl AND x.id = c.a JOIN n y ON y.tbl = c.tbl AND y.id = c.b WHERE 2 * c.c >= x.n + y.n - c.c),
reach AS (SELECT tbl, class_id AS a, class_id AS b FROM t UNION SELECT reach.tbl, reach.a, l.b FROM reach JOIN l ON l.tbl = reach.tbl AND l.a = reach.b),
k AS (SELECT tbl, a, min(b) AS group_id FROM reach GROUP BY 1, 2), d AS (SELECT tbl, a, count(*) AS n_links FROM l GROUP BY 1, 2)
SELECT m.tbl, m.row_id, m.class_id, k.group_id, coalesce(d.n_links, 0) AS n_links FROM m JOIN k ON k.tbl = m.tbl AND k.a = m.class_id LEFT JOIN d ON d.tbl = m.tbl AND d.a = m.class_id"""
SQL = {
    "p2_found": rf"""
SELECT 'document_pages' AS tbl, page_row_id AS row_id FROM document_pages JOIN chunk_options USING (source) WHERE len(regexp_extract_all(text, '[^{_WHITE}]+')) > target_tokens
UNION ALL
SELECT 'canonical_chunks', chunk_row_id FROM canonical_chunks JOIN chunk_options USING (source) WHERE len(regexp_extract_all(text, '[^{_WHITE}]+')) > target_tokens""",
    "p5_found": _PAIRS + "SELECT tbl, id_a, id_b FROM p",
    "p5_pairs": _PAIRS + "SELECT tbl, id_a, id_b, c::DOUBLE / (n_a + n_b - c) AS similarity FROM p",
    "p5_groups": _GROUPS,
    "p6_found": _LINES + "SELECT page_row_id, line_no FROM f JOIN c USING (source, form)",
    "p6_pages": _LINES + """, x AS (SELECT page_row_id, line_no FROM f JOIN c USING (source, form)),
a AS (SELECT page_row_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM document_pages WHERE text IS NOT NULL),
kept AS (SELECT page_row_id, string_agg(line, chr(10) ORDER BY line_no) AS text FROM a ANTI JOIN x USING (page_row_id, line_no) GROUP BY 1), d AS (SELECT page_row_id, count(*) AS n FROM x GROUP BY 1)
SELECT p.page_row_id, coalesce(d.n, 0)::INT AS n_removed, CASE WHEN p.text IS NOT NULL THEN coalesce(kept.text, '') END AS text FROM document_pages p LEFT JOIN kept USING (page_row_id) LEFT JOIN d USING (page_row_id)""",
    "p6_lines": _LINES + "SELECT source, form AS line_form, n_docs, src_docs FROM c",
    "p10_statistics": rf"""
WITH stop AS (SELECT list(DISTINCT lower(word)) AS s FROM common_words WHERE word IS NOT NULL),
t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT doc_id, x, regexp_extract_all(lower(x), '[\p{{L}}\p{{N}}]+') AS w, list_filter(string_split(x, chr(10)), lambda y: trim(y) <> '') AS f, string_split(x, chr(10)) AS l FROM t),
m AS (SELECT *, len(w) AS n, length(regexp_replace(x, '[{_WHITE}]+', '', 'g')) AS dense, length(regexp_replace(x, '[^\p{{L}}]+', '', 'g')) AS letters, length(array_to_string(w, '')) AS in_words FROM w)
SELECT doc_id, n AS n_words, len(f) AS n_lines, CASE WHEN n > 0 THEN in_words / n ELSE 0.0 END::DOUBLE AS mean_word_length, CASE WHEN dense > 0 THEN greatest(dense - in_words, 0) / dense ELSE 0.0 END::DOUBLE AS symbol_share,
least(CASE WHEN len(f) > 0 THEN len(regexp_extract_all(x, '(?m)[.!?:;…]["''”’»)\]]*[ \t]*$')) / len(f) ELSE 0.0 END::DOUBLE, 1.0) AS punctuated_share,
CASE WHEN n > 0 THEN len(list_filter(w, lambda y: list_contains(s, y))) / n ELSE 0.0 END::DOUBLE AS common_share,
least(CASE WHEN n > 0 THEN len(regexp_extract_all(x, '\p{{L}}*\p{{N}}[\p{{L}}\p{{N}}]*')) / n ELSE 0.0 END::DOUBLE, 1.0) AS digit_share,
least(CASE WHEN n > 0 THEN len(list_distinct(w)) / sqrt(n::DOUBLE) ELSE 0.0 END::DOUBLE / 20, 1.0) AS distinct_share,
CASE WHEN length(x) > 0 THEN coalesce(list_sum(list_transform(l, lambda y: CASE WHEN length(y) >= 50 THEN length(y) ELSE 0 END)), 0) / length(x) ELSE 0.0 END::DOUBLE AS long_line_share,
CASE WHEN n > 0 THEN len(regexp_extract_all(x, '\p{{L}}[,;]? \p{{L}}')) / n ELSE 0.0 END::DOUBLE AS sentence_share, CASE WHEN dense > 0 THEN letters / greatest(dense, 1) ELSE 0.0 END::DOUBLE AS word_share
FROM m, stop""",
    "p9_found": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
dg AS (SELECT doc_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS k FROM d)),
ig AS (SELECT DISTINCT item_id, array_to_string(w[k:k + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS k FROM i))
SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
}
