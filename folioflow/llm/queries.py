"""The queries opN_<name>, one for each operator, and their SQL for DuckDB where SQL can say it."""

from __future__ import annotations

from . import chat, decontaminate, langid, linededup, lm, mixing, neardup, quality, sharding, tokenfiles

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_near_duplicates": neardup.op2_near_duplicates,
    "op3_line_dedup": linededup.op3_line_dedup,
    "op4_language": langid.op4_language,
    "op5_token_tables": tokenfiles.op5_token_tables,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_mixing": mixing.op7_mixing,
    "op8_sharding": sharding.op8_sharding,
    "op9_chat": chat.op9_chat,
    "op10_lm_score": lm.op10_lm_score,
}
ORACLES: dict[str, str] = {
    "op1_quality": quality.OP1_SQL,
    "op3_line_dedup": linededup.OP3_SQL,
    "op6_decontaminate": decontaminate.OP6_SQL,
}
