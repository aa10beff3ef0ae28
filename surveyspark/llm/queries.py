"""Queries of the corpus operators and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from . import chat, codes, decontaminate, embeddings, jaccard, language, mixing, pii, quality, repeats, runs, tokens, warc

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_tokens": tokens.op2_tokens,
    "op3_language": language.op3_language,
    "op4_pii": pii.op4_pii,
    "op5_warc": warc.op5_warc,
    "op6_repeats": repeats.op6_repeats,
    "op7_jaccard": jaccard.op7_jaccard,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality": quality.op9_quality,
    "op10_embeddings": embeddings.op10_embeddings,
    "op11_runs": runs.op11_runs,
    "op12_codes": codes.op12_codes,
    "op13_chat": chat.op13_chat,
}
ORACLES = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_jaccard": jaccard.OP7_SQL,
    "op8_mixing": mixing.OP8_SQL,
    "op10_embeddings": embeddings.OP10_SQL,
    "op12_codes": codes.OP12_SQL,
    "op13_chat": chat.OP13_SQL,
}
