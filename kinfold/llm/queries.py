"""The subpackage's queries by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from . import bpe_automaton, chat, matroska, multi_index, packing, pii, quality, simhash, substring, token_files

QUERIES: dict[str, Callable] = {
    "op1_quality": quality.op1_quality,
    "op2_chat_format": chat.op2_chat_format,
    "op3_substring_dedup": substring.op3_substring_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op4_pii": pii.op4_pii,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_bpe": bpe_automaton.op8_bpe,
    "op9_multi_index": multi_index.op9_multi_index,
    "op10_matroska": matroska.op10_matroska,
}
ORACLE_SQL: dict[str, str] = {
    "op2_chat_format": chat.ORACLE,
    "op3_substring_dedup": substring.ORACLE,
}
