"""The queries of the ten operators and the pipeline, and SQL where SQL can express one."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tessera.llm.decontaminate import op6_decontamination
from tessera.llm.jaccard import op3_jaccard_join
from tessera.llm.katz import op8_lm_scoring
from tessera.llm.neighbours import op9_neighbours
from tessera.llm.pieces import op4_sentencepiece
from tessera.llm.quality import op10_quality
from tessera.llm.sharding import op5_sharding
from tessera.llm.substrings import op7_substring_dedup
from tessera.llm.tokencount import op1_token_counts
from tessera.llm.toxicity import op2_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_token_counts, op2_toxicity, op3_jaccard_join, op4_sentencepiece, op5_sharding, op6_decontamination, op7_substring_dedup, op8_lm_scoring, op9_neighbours, op10_quality)
} | {"pipeline": corpus_pipeline.run}

SQL: dict[str, str] = {
    "op7_substring_dedup": r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
windows AS (
  SELECT doc_id, unnest(list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i + 49], ' ')))) AS k,
         unnest(range(1, len(ws) - 48)) AS i
  FROM texts WHERE len(ws) >= 50),
firsts AS (SELECT k, min(doc_id) AS least FROM windows GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM windows JOIN firsts USING (k) WHERE least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS p FROM texts),
kept AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM texts t LEFT JOIN kept USING (doc_id)
""",
} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
