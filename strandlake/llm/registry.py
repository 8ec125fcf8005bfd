"""The queries of this subpackage: one per operator, over its whole table, and their SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandlake.llm.audio import op5_audio
from strandlake.llm.middles import op11_middles
from strandlake.llm.mixing import op8_mixing
from strandlake.llm.negatives import op13_negatives
from strandlake.llm.neighbours import op10_neighbours
from strandlake.llm.passages import op1_passages
from strandlake.llm.pieces import op3_pieces
from strandlake.llm.quality import op7_quality
from strandlake.llm.secrets import op9_secrets
from strandlake.llm.simhash import op4_simhash
from strandlake.llm.suffixes import op6_suffixes
from strandlake.llm.token_files import op2_token_files
from strandlake.llm.word_table import op12_word_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_passages": op1_passages,
    "op2_token_files": op2_token_files,
    "op3_pieces": op3_pieces,
    "op4_simhash": op4_simhash,
    "op5_audio": op5_audio,
    "op6_suffixes": op6_suffixes,
    "op7_quality": op7_quality,
    "op8_mixing": op8_mixing,
    "op9_secrets": op9_secrets,
    "op10_neighbours": op10_neighbours,
    "op11_middles": op11_middles,
    "op12_word_table": op12_word_table,
    "op13_negatives": op13_negatives,
}

#: SQL says what op1 removes. The others hold tokenizers, 64-bit hashes over shingles, stored streams, windows of bytes, trained
#: models, draws or approximate searches, which it can't express (or not over whole tables); tests hold them against
#: brute force or the libraries.
ORACLE_SQL: dict[str, str] = {
    "op1_passages": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
        x AS (SELECT doc_id, unnest(list_transform(range(1, len(words) - 11), lambda i: {'p': i, 't': array_to_string(words[i:i + 12], ' ')})) AS v FROM w),
        win AS (SELECT doc_id, v.p AS p, v.t AS t FROM x),
        own AS (SELECT t, min(doc_id) AS owner FROM win GROUP BY t),
        hit AS (SELECT doc_id, p FROM win JOIN own USING (t) WHERE doc_id > owner),
        gone AS (SELECT DISTINCT doc_id, p + k AS p FROM hit, range(0, 13) r(k)),
        word AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM w),
        kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
        SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
    """,
}
