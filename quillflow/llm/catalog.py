"""The corpus operators' queries by name, with SQL for those that SQL can express."""

from __future__ import annotations

from quillflow.llm.decontaminate import decontaminate_exact, op3_decontaminate
from quillflow.llm.fingerprint import fingerprint_edits, op2_fingerprint
from quillflow.llm.html import op5_html
from quillflow.llm.language import op4_language, pages_language
from quillflow.llm.minhash import op1_minhash
from quillflow.llm.oracle import ORACLE_SQL
from quillflow.llm.packing import op9_packing, packing_coverage
from quillflow.llm.secrets import op8_secrets, secret_spans
from quillflow.llm.sharding import op7_sharding, sharding_round_trip
from quillflow.llm.toxicity import op10_toxicity
from quillflow.llm.urls import op6_urls

QUERIES = {
    f.__name__: f
    for f in (
        op1_minhash, op2_fingerprint, op3_decontaminate, op4_language, op5_html, op6_urls, op7_sharding, op8_secrets, op9_packing, op10_toxicity, decontaminate_exact, fingerprint_edits, packing_coverage, pages_language, secret_spans, sharding_round_trip,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
