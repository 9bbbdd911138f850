"""Queries of this subpackage, and DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, hilbert, licenses, orderhash, packing, simhash, substring, tokenfile, toxicity, warczip

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_packing": packing.op3_packing,
    "op4_orderhash": orderhash.op4_orderhash,
    "op5_tokenfile": tokenfile.op5_tokenfile,
    "op6_decontaminate": decontaminate.op6_decontaminate,
    "op7_warc": warczip.op7_warc,
    "op8_licenses": licenses.op8_licenses,
    "op9_hilbert": hilbert.op9_hilbert,
    "op10_substring": substring.op10_substring,
}
ORACLES: dict[str, str] = {"op7_warc": warczip.OP7_SQL, "op10_substring": substring.OP10_SQL}
