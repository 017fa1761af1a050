"""Deterministic stand-in for a language model.

It exercises the data flow and must not be read as analysis. Real users pass
their own ``infer_fn(system, user, schema_name) -> JSON text``.
"""

from __future__ import annotations

import json
import re
from collections import Counter

_LINE = re.compile(r"^\[id=([^\]]+)\] (.*) @ (\S+)$", re.MULTILINE)
_CLUSTER = re.compile(r"^=== CLUSTER (\S+) · .* ===$", re.MULTILINE)
_REF = re.compile(r"^\[(D\d+)\]", re.MULTILINE)


def _segment(text: str, label: str | None) -> dict:
    authors = sorted({m.group(2) for m in _LINE.finditer(text)})
    body = " ".join(_LINE.sub("", text).split())
    words = Counter(w for w in re.findall(r"\w+", body.lower()) if len(w) > 5)
    topics = [w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:3]]
    out = {
        "message_ids": [], "title": " ".join(topics) or "empty", "summary": body,
        "topics": topics, "entities": [{"name": a, "type": "person"} for a in authors],
        "key_points": [], "sentiment": "neutral", "sentiment_score": 0.0, "language": "cs",
        "discussion_type": "question" if "?" in body else "discussion", "resolved": None,
    }
    if label:
        out["source_cluster"] = label
    return out


def rule_based(system: str, user: str, schema_name: str) -> str:
    """Fixed-rule reply for each of the three response schemas."""
    if schema_name == "discussion_enrichment":
        heads = list(_CLUSTER.finditer(user))
        if not heads:
            return json.dumps({"segments": [_segment(user, None)]})
        ends = [h.start() for h in heads[1:]] + [len(user)]
        return json.dumps({"segments": [
            _segment(user[h.end():e], h.group(1)) for h, e in zip(heads, ends, strict=True)]})
    if schema_name == "query_plan":
        question = user.split("\n\n", 1)[0].split("\n", 1)[-1].strip()
        return json.dumps({
            "search_queries": [question], "topics": [question], "entities": [], "intent": "other",
            "preferred_discussion_types": [], "answer_language": "cs"})
    refs = _REF.findall(user)
    return json.dumps({
        "answer": " ".join(f"[{r}]" for r in refs), "used_citations": refs,
        "confidence": "high" if len(refs) > 1 else "medium", "caveats": None})
