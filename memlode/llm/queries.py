"""The queries of the training-data operators."""

from __future__ import annotations

from memlode.llm.chat_format import op6_chat_format
from memlode.llm.decontaminate import op2_decontamination
from memlode.llm.divergence import DIVERGENCE_SQL, op11_source_divergence
from memlode.llm.html_extract import op10_html_extract
from memlode.llm.language_id import op7_language_id
from memlode.llm.mixing import op9_mixing
from memlode.llm.pii import op8_pii
from memlode.llm.quality_model import op3_quality_classifier
from memlode.llm.quality_rules import op5_quality_rules
from memlode.llm.repair import REPAIR_SQL, op12_conversation_repair
from memlode.llm.simhash import op1_simhash
from memlode.llm.topk import TOPK_SQL, op13_topk
from memlode.llm.warc import op4_warc_derivatives

OPERATORS = (
    op1_simhash, op2_decontamination, op3_quality_classifier, op4_warc_derivatives, op5_quality_rules,
    op6_chat_format, op7_language_id, op8_pii, op9_mixing, op10_html_extract,
    op11_source_divergence, op12_conversation_repair, op13_topk,
)


def queries() -> dict:
    return {f.__name__: f for f in OPERATORS}


#: The formatted conversations' digests from the table itself; the other operators have no SQL form:
#: 64-bit hashes, trained models, seeded draws or Python parsers stand in their contracts.
CHAT_SQL = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(text) + (length(text) - length(replace(text, chr(92), ''))) + 2 * len(regexp_extract_all(text, '</?s>|\\[/?INST\\]|\\[ASST\\]|\\[/?SYS\\]|\\[/?ROLE\\]')) AS n,
  CASE role WHEN 'user' THEN 13 WHEN 'assistant' THEN 10 WHEN 'system' THEN 11 ELSE 17 + length(role) END AS marks FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum(n + marks) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""


def oracle_sql() -> dict:
    return {"op6_chat_format": CHAT_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_conversation_repair": REPAIR_SQL, "op13_topk": TOPK_SQL}
