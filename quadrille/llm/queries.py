"""The queries of this subpackage, one per operator, over whole tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from quadrille.llm.common import cut, table
from quadrille.llm.op01_quality_rules import quality_rules
from quadrille.llm.op02_token_counts import count_tokens
from quadrille.llm.op03_language import identify_languages
from quadrille.llm.op04_quality_classifier import score_quality
from quadrille.llm.op05_mix import mixed
from quadrille.llm.op06_warc import drop_archives, read_records, write_archives
from quadrille.llm.op07_secrets import find_secrets
from quadrille.llm.op08_decontaminate import contaminated
from quadrille.llm.op09_repeats import remove_repeats
from quadrille.llm.op10_near_dup import near_duplicates


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"))
    found = cut(read_records(index).drop("url", "payload"))
    drop_archives(spark, index)
    return found


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "item_id", "similarity")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("kept")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_token_counts": op2_token_counts,
        "op3_language": op3_language,
        "op4_quality_classifier": op4_quality_classifier,
        "op5_mix": op5_mix,
        "op6_warc": op6_warc,
        "op7_secrets": op7_secrets,
        "op8_decontaminate": op8_decontaminate,
        "op9_repeats": op9_repeats,
        "op10_near_dup": op10_near_dup,
        "pipeline": corpus_pipeline.run,
    }


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_sql(text: str) -> str:
    """DuckDB SQL for the list of a text's words."""
    return f"list_filter(regexp_split_to_array(coalesce({text}, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"


def shingles_sql(words: str, k: int) -> str:
    """DuckDB SQL for the distinct k-word shingles of a word list; a short one is a shingle as a whole."""
    windows = f"list_transform(range(1, greatest(len({words}) - {k - 2}, 2)), lambda i: array_to_string({words}[i:i + {k - 1}], ' '))"
    return f"CASE WHEN len({words}) = 0 THEN [] ELSE list_distinct({windows}) END"


def near_dup_ctes(docs: str, k: int, percent: int) -> str:
    """CTEs ending in ``roots(doc_id, n_shingles, component_id)``, by comparing all that share a shingle."""
    return f"""
w AS (SELECT doc_id, {words_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")} AS ws FROM {docs}),
s AS (SELECT doc_id, {shingles_sql("ws", k)} AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id
      GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= {percent} * (x.n + y.n - count(*))),
r(doc_id, reach) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, p.b FROM r JOIN p ON p.a = r.reach),
roots AS (SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.reach) AS component_id
          FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY s.doc_id, s.sh)"""


_LOWER_WORDS = words_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")

# A digest's 160 bits are 32 digits of five bits; five hexadecimal digits hold four of them.
OP6_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), '') AS payload_digest FROM p),
l AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to FROM l"""

# Every window of an item's size in every document that shares a shingle with it; items of under five words as they are.
OP8_SQL = f"""
WITH i AS (SELECT item_id, {_LOWER_WORDS} AS w FROM benchmark), i5 AS (SELECT item_id, w, len(w) AS n, list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k + 4], ' ')) AS sh FROM i WHERE len(w) >= 5),
d AS (SELECT doc_id, {_LOWER_WORDS} AS w FROM documents), d5 AS (SELECT doc_id, list_transform(range(1, greatest(len(w) - 3, 1)), lambda k: array_to_string(w[k:k + 4], ' ')) AS sh FROM d),
seeds AS (SELECT item_id, n, unnest(sh) AS g FROM i5), hits AS (SELECT doc_id, unnest(sh) AS g FROM d5),
pairs AS (SELECT DISTINCT doc_id, item_id FROM hits JOIN seeds USING (g)),
starts AS (SELECT doc_id, item_id, i5.sh AS a, d5.sh AS b, unnest(range(0, greatest(len(d5.sh) - (i5.n - 4), 0) + 1)) AS s, i5.n - 4 AS k FROM pairs JOIN i5 USING (item_id) JOIN d5 USING (doc_id)),
sims AS (SELECT doc_id, item_id, s, list_sum(list_transform(list_distinct(a), lambda x: least(len(list_filter(a, lambda y: y = x)), len(list_filter(b[s + 1:s + k], lambda y: y = x))))) AS shared, len(a) + len(b[s + 1:s + k]) AS total FROM starts)
SELECT doc_id, item_id, max(shared::DOUBLE / (total - shared)) AS similarity FROM sims WHERE shared >= 0.8 * (total - shared) GROUP BY doc_id, item_id
UNION ALL SELECT doc_id, item_id, 1.0 FROM i JOIN d ON len(i.w) BETWEEN 1 AND 4 AND list_contains(list_transform(range(1, greatest(len(d.w) - len(i.w) + 2, 1)), lambda k: array_to_string(d.w[k:k + len(i.w) - 1], ' ')), array_to_string(i.w, ' '))"""

OP10_SQL = f"""WITH RECURSIVE {near_dup_ctes("documents", 4, 80)}
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM roots"""


def oracle_sql() -> dict[str, str]:
    found = {"op6_warc": OP6_SQL, "op8_decontaminate": OP8_SQL, "op10_near_dup": OP10_SQL}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
