"""The queries of this subpackage, by the names under which the entry module offers them."""

from __future__ import annotations

from quillmark.llm import chat_format, debruijn_dedup, decontaminate, forest_search, language_id, pii, sentencepiece_codec, simhash_dedup, suffix_dedup, toxicity

QUERIES = {
    "op1_sentencepiece": sentencepiece_codec.query,
    "op2_decontaminate": decontaminate.query,
    "op3_suffix_dedup": suffix_dedup.query,
    "op4_forest_search": forest_search.query,
    "op5_debruijn_dedup": debruijn_dedup.query,
    "op6_toxicity": toxicity.query,
    "op7_language_id": language_id.query,
    "op8_chat_format": chat_format.query,
    "op9_simhash_dedup": simhash_dedup.query,
    "op10_pii": pii.query,
}
#: DuckDB SQL of those that SQL can express.
SQL: dict[str, str] = {"op2_decontaminate": decontaminate.SQL, "op3_suffix_dedup": suffix_dedup.SQL, "op5_debruijn_dedup": debruijn_dedup.SQL, "op8_chat_format": chat_format.SQL, "op10_pii": pii.SQL}
