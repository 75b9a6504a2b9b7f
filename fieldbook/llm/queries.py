"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldbook.llm import exact_dedup, langid, lexical, licenses, media, mixing, near_dedup, personal_data, quality, sentencepieces, spelling, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": mixing.op1_mixing,
    "op2_langid": langid.op2_langid,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_licenses": licenses.op4_licenses,
    "op5_near_dedup": near_dedup.op5_near_dedup,
    "op6_media": media.op6_media,
    "op7_sentencepieces": sentencepieces.op7_sentencepieces,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_quality": quality.op10_quality,
    "op11_lexical_search": lexical.op11_lexical_search,
    "op12_spelling": spelling.op12_spelling,
    "op13_personal_data": personal_data.op13_personal_data,
}

ORACLE_SQL: dict[str, str] = {
    "op4_licenses": licenses.OP4_SQL,
    "op5_near_dedup": near_dedup.OP5_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_lexical_search": lexical.OP11_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_personal_data": personal_data.OP13_SQL,
}
