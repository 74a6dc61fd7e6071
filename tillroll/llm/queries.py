"""The registered queries of this package and their SQL."""

from __future__ import annotations

from tillroll.llm import collocations, line_dedup, merkle, warc
from tillroll.llm.byte_bpe import op5_byte_bpe
from tillroll.llm.html_text import op6_wrapper_text
from tillroll.llm.packing import op1_pow2_packing
from tillroll.llm.quality import op7_quality_rules
from tillroll.llm.simhash import op8_simhash
from tillroll.llm.token_counts import op4_token_counts
from tillroll.llm.toxicity import op3_weak_toxicity
from tillroll.llm.urls import op2_url_filter
from tillroll.llm.winnowing import op10_winnowing

QUERIES = {f.__name__: f for f in (
    op1_pow2_packing, op2_url_filter, op3_weak_toxicity, op4_token_counts, op5_byte_bpe, op6_wrapper_text,
    op7_quality_rules, op8_simhash, warc.op9_warc, op10_winnowing, line_dedup.op11_line_dedup, merkle.op12_merkle_manifest,
    collocations.op13_collocations)}

#: Where SQL can express the query.
ORACLES = {"op9_warc": warc.ORACLE_SQL, "op11_line_dedup": line_dedup.ORACLE_SQL,
           "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_collocations": collocations.ORACLE_SQL}
