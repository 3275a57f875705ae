"""Queries of this subpackage, and the SQL that gives the same rows where SQL can express them."""

from . import bpe, chat, decontaminate, grades, langid, lengths, licences, mixing, repetition, simhash

QUERIES = {
    "op1_bpe_round_trip": bpe.op1_bpe_round_trip,
    "op2_length_histogram": lengths.op2_length_histogram,
    "op3_repetition_rules": repetition.op3_repetition_rules,
    "op4_chat_format": chat.op4_chat_format,
    "op5_language": langid.op5_language,
    "op6_simhash_components": simhash.op6_simhash_components,
    "op7_ordinal_grades": grades.op7_ordinal_grades,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_licence_scan": licences.op9_licence_scan,
    "op10_context_mixing": mixing.op10_context_mixing,
}
ORACLES: dict[str, str] = {
    "op3_repetition_rules": repetition.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op8_decontamination": decontaminate.OP8_SQL,
    "op9_licence_scan": licences.OP9_SQL,
}
