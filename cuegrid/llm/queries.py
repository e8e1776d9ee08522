"""Queries of this subpackage and the SQL that other engines can run for them."""

from __future__ import annotations

from cuegrid.llm import bpe, exact_dedup, filter_audit, langid, lexical, minhash, mixing, mixlm, pii, projections, quotes, urls, winnowing


def queries() -> dict:
    out = {
        "op1_quotes": quotes.op1_quotes,
        "op2_langid": langid.op2_langid,
        "op3_mixing": mixing.op3_mixing,
        "op4_bpe": bpe.op4_bpe,
        "op5_urls": urls.op5_urls,
        "op6_pii": pii.op6_pii,
        "op7_projections": projections.op7_projections,
        "op8_minhash": minhash.op8_minhash,
        "op9_mixlm": mixlm.op9_mixlm,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_lexical": lexical.op11_lexical,
        "op12_filter_audit": filter_audit.op12_filter_audit,
        "op13_winnowing": winnowing.op13_winnowing,
    }
    return out


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quotes": quotes.OP1_SQL,
        "op3_mixing": mixing.OP3_SQL,
        "op10_exact_dedup": exact_dedup.OP10_SQL,
        "op11_lexical": lexical.OP11_SQL,
        "op12_filter_audit": filter_audit.OP12_SQL,
        "op13_winnowing": winnowing.OP13_SQL,
    }
