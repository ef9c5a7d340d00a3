"""The text operators' queries and SQL, from their modules."""

from __future__ import annotations

from engramlake.llm import decontaminate, htmltext, language, licenses, lines, lmscore, mixing, quality, simhash, toxicity

_MODULES = (decontaminate, htmltext, language, licenses, lines, lmscore, mixing, quality, simhash, toxicity)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
SQL = {name: s for m in _MODULES for name, s in m.SQL.items()}
