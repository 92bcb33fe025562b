"""Offline default of the relevance judge."""

from __future__ import annotations

import re

_PARTS = re.compile(r"\*/\n(.*)\n\*/\nand this question:\n/\*\n(.*)\n\*/", re.S)


def overlap_judge(prompts: list[str]) -> list[str]:
    """yes when at least half of the question's words stand in the description."""
    out = []
    for p in prompts:
        m = _PARTS.search(p)
        have, asked = (set(re.findall(r"\w\w+", t.lower())) for t in (m.group(1), m.group(2))) if m else (set(), set())
        out.append("yes" if asked and 2 * len(asked & have) >= len(asked) else "no")
    return out
