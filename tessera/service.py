"""One JSON request, one JSON answer."""

from __future__ import annotations

import json

from tessera.engine import Engine


def answer(engine: Engine, line: str) -> str:
    """ops ping and search; the limit is 40 unless given, and between 1 and 120; nulls are left out."""
    request = json.loads(line)
    op = request.get("op")
    if op == "ping":
        return json.dumps({"ok": True})
    if op != "search":
        return json.dumps({"ok": False, "error": f"unknown op: {op}"})
    limit = max(1, min(120, request.get("limit", 40)))
    rows = engine.search(request.get("query", ""), limit).collect()
    camel = {"visual_score": "visualScore", "meaning_score": "meaningScore", "matched_text": "matchedText", "local_time": "localTime"}
    hits = [{camel.get(k, k): v for k, v in r.asDict().items() if v is not None} for r in rows]
    return json.dumps({"ok": True, "hits": hits}, default=str, ensure_ascii=False)
