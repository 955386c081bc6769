"""The registered queries of this subpackage and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from graphloom.llm import ann, chat, decontaminate, knn_quality, langid, minhash, mixing, packing, pii, rules, search, urlfilter, yinyang

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality_classifier": knn_quality.op3_quality_classifier,
    "op4_chat_preferences": chat.op4_chat_preferences,
    "op5_language_id": langid.op5_language_id,
    "op6_minhash_dedup": minhash.op6_minhash_dedup,
    "op7_ann": ann.op7_ann,
    "op8_quality_rules": rules.op8_quality_rules,
    "op9_url_filter": urlfilter.op9_url_filter,
    "op10_pii": pii.op10_pii,
    "op11_lexical_search": search.op11_lexical_search,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_yinyang": yinyang.op13_yinyang,
}

ORACLES: dict[str, str] = {
    "op2_mixing": mixing.oracle(),
    "op4_chat_preferences": chat.ORACLE,
    "op9_url_filter": urlfilter.ORACLE,
    "op11_lexical_search": search.ORACLE,
    "op12_decontamination": decontaminate.ORACLE,
    "op13_yinyang": yinyang.oracle(),
}
