"""The queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

import corpus_pipeline

from . import binary_ids, bpe, html_text, langid, licences, media, mixing, near_dedup, passages, quality

QUERIES: dict = {
    "op1_language_id": langid.op1_language_id,
    "op2_token_ids": binary_ids.op2_token_ids,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_html_text": html_text.op6_html_text,
    "op7_licence_scan": licences.op7_licence_scan,
    "op8_substring_dedup": passages.op8_substring_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_media_columns": media.op10_media_columns,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict = {"op9_mixing": mixing.OP9_SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
