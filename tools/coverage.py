"""Print the SURVEY section 2 inventory coverage: ID -> driver queries that
exercise it (from the ``ids`` tags of the registry)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import ledgerlight.queries  # noqa: E402,F401
from ledgerlight.registry import REGISTRY  # noqa: E402

GROUPS = {"A": range(1, 9), "B": [1, 3, 4, 5, 6, 8, 9, 10, 11, 12], "C": range(1, 32),
          "D": range(1, 24), "J": range(1, 29), "F": range(1, 14), "G": range(1, 10),
          "H": range(1, 6), "I": range(1, 4), "K": range(1, 12), "L": range(1, 5), "M": range(1, 24)}
PYTEST_ONLY = {"A8": "tests/test_load.py", "B11": "tests/test_load.py", "D23": "tests/test_filters_columns.py",
               "L4": "tests/test_semantics.py",
               "B5": "tests/test_load.py", "B8": "tests/test_load.py", "K9": "tests/test_periods.py",
               "K10": "tests/test_periods.py"}


def expand(tok: str) -> list[str]:
    m = re.match(r"^([A-Z])(\d+)-([A-Z]?)(\d+)$", tok)
    if m:
        return [f"{m.group(1)}{i}" for i in range(int(m.group(2)), int(m.group(4)) + 1)]
    return [tok]


def main() -> None:
    seen: dict[str, list[str]] = {}
    for name, e in REGISTRY.items():
        for tok in re.findall(r"[A-Z][0-9]+(?:-[A-Z]?[0-9]+)?|K-wrap|K-clamp", e.ids):
            for t in expand(tok):
                seen.setdefault(t, []).append(name)
    ids = [f"{g}{i}" for g, rng in GROUPS.items() for i in rng] + ["K-wrap", "K-clamp"]
    print("| ID | checked by |")
    print("| --- | --- |")
    for i in ids:
        if i in seen:
            qs = sorted(set(seen[i]))
            shown = ", ".join(f"`{q}`" for q in qs[:4]) + (f" (+{len(qs) - 4})" if len(qs) > 4 else "")
        else:
            shown = PYTEST_ONLY.get(i, "**not covered**")
        print(f"| {i} | {shown} |")


if __name__ == "__main__":
    main()
