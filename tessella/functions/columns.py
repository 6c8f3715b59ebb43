"""Column matching between schemas and insert planning."""

from __future__ import annotations

import re
import unicodedata

from .values import edit_distance


def plain(name: str) -> str:
    """No accents, lower case, letters and digits only."""
    bare = "".join(c for c in unicodedata.normalize("NFD", name) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]", "", bare.lower())


TIERS = (
    lambda a, b: a == b,
    lambda a, b: a.lower() == b.lower(),
    lambda a, b: plain(a) == plain(b) != "",
    lambda a, b: len(a) == 10 and plain(b).startswith(plain(a)) or len(b) == 10 and plain(a).startswith(plain(b)),
    lambda a, b: min(len(plain(a)), len(plain(b))) >= 5 and edit_distance(plain(a), plain(b)) == 1,
)


def auto_map(source: list[str], target: list[str]) -> dict[str, str]:
    """Target column to source column, tier by tier from exact names to one edit; a tier takes only pairs that are
    unique both ways, and takes them out before the next."""
    out: dict[str, str] = {}
    left, right = list(source), list(target)
    for same in TIERS:
        pairs = [(a, b) for a in left for b in right if same(a, b)]
        for a, b in pairs:
            if sum(x == a for x, _ in pairs) == 1 and sum(y == b for _, y in pairs) == 1:
                out[b] = a
        left, right = [a for a in left if a not in out.values()], [b for b in right if b not in out]
    return out


def insert_plan(columns: list[dict], mapped: dict[str, str], defaults: dict[str, str]) -> tuple[list[str], list[str]]:
    """Columns to insert, and required ones that nothing fills. A column has name, nullable and has_default."""
    used = [c["name"] for c in columns if c["name"] in mapped or defaults.get(c["name"], "").strip()]
    missing = [c["name"] for c in columns if c["name"] not in used and not c["nullable"] and not c["has_default"]]
    return used, missing
