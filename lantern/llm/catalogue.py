"""The queries of the corpus operators and their DuckDB twins."""

from __future__ import annotations

from lantern.llm import chat, codes, decontamination, html, linededup, middle, mixing, neardup, pii, quality, sharding, simhash, warc


def queries() -> dict:
    return {
        "op1_quality": quality.op1_quality,
        "op2_warc": warc.op2_warc,
        "op3_html": html.op3_html,
        "op4_mix": mixing.op4_mix,
        "op5_pii": pii.op5_pii,
        "op6_neardup": neardup.op6_neardup,
        "op7_chat": chat.op7_chat,
        "op8_leaks": decontamination.op8_leaks,
        "op9_lines": linededup.op9_lines,
        "op10_shards": sharding.op10_shards,
        "op11_middle": middle.op11_middle,
        "op12_codes": codes.op12_codes,
        "op13_simhash": simhash.op13_simhash,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.oracle(),
        "op4_mix": mixing.oracle(),
        "op6_neardup": neardup.oracle(),
        "op7_chat": chat.oracle(),
        "op9_lines": linededup.oracle(),
        "op10_shards": sharding.oracle(),
        "op11_middle": middle.oracle(),
        "op12_codes": codes.oracle(),
    }
