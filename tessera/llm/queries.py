"""The registered queries of this folder, and SQL twins where SQL can express them."""

from __future__ import annotations

from tessera.llm.chat_format import OP2_SQL, op2
from tessera.llm.decontaminate import op10
from tessera.llm.lm_scoring import op6
from tessera.llm.media_gif import op9
from tessera.llm.mixing import OP3_SQL, op3
from tessera.llm.simhash import op7
from tessera.llm.sql_twins import OP4_SQL, OP10_SQL
from tessera.llm.substring_dedup import op4
from tessera.llm.token_output import op1
from tessera.llm.toxicity import op5
from tessera.llm.url_filter import OP8_SQL, op8

QUERIES = {
    "op1_token_output": op1,
    "op2_chat_format": op2,
    "op3_mix_sources": op3,
    "op4_substring_dedup": op4,
    "op5_toxicity": op5,
    "op6_lm_scoring": op6,
    "op7_simhash": op7,
    "op8_url_filter": op8,
    "op9_media_gif": op9,
    "op10_decontaminate": op10,
}

ORACLES: dict[str, str] = {
    "op2_chat_format": OP2_SQL,
    "op3_mix_sources": OP3_SQL,
    "op4_substring_dedup": OP4_SQL,
    "op8_url_filter": OP8_SQL,
    "op10_decontaminate": OP10_SQL,
}
