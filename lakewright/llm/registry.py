"""The corpus queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from lakewright.llm import decontaminate, langid, lattice_lm, minmax_dedup, order_minhash, packing, quality, sharding, toolcalls, url_filter


def queries() -> dict:
    return {
        "op1_empirical_bayes": quality.op1_empirical_bayes,
        "op2_redirects": url_filter.op2_redirects,
        "op3_positional_index": decontaminate.op3_positional_index,
        "op4_karmarkar_karp": sharding.op4_karmarkar_karp,
        "op5_length_buckets": packing.op5_length_buckets,
        "op6_tool_calls": toolcalls.op6_tool_calls,
        "op7_order_minhash": order_minhash.op7_order_minhash,
        "op8_bigru": langid.op8_bigru,
        "op9_minmax": minmax_dedup.op9_minmax,
        "op10_lattice": lattice_lm.op10_lattice,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_redirects": url_filter.ORACLE,
        "op3_positional_index": decontaminate.ORACLE,
        "op6_tool_calls": toolcalls.ORACLE,
        "op9_minmax": minmax_dedup.ORACLE,
    }
