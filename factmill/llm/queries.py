"""The queries of this subpackage and their SQL, for __spark_entry__.py, which adds the pipeline itself."""

from __future__ import annotations

from factmill.llm.decontaminate import op7_decontamination
from factmill.llm.language import op5_language
from factmill.llm.near import op9_near_duplicates
from factmill.llm.pieces import op1_sentencepiece
from factmill.llm.pii import op2_pii
from factmill.llm.secret_scan import op10_secrets
from factmill.llm.topk import OP3_SQL, op3_topk
from factmill.llm.toxicity import op4_toxicity
from factmill.llm.url_filter import OP6_SQL, op6_url_filter
from factmill.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_pii": op2_pii,
    "op3_topk": op3_topk,
    "op4_toxicity": op4_toxicity,
    "op5_language": op5_language,
    "op6_url_filter": op6_url_filter,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_secrets": op10_secrets,
}

ORACLE_SQL: dict[str, str] = {"op3_topk": OP3_SQL, "op6_url_filter": OP6_SQL, "op8_warc": OP8_SQL}
