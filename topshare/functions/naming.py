"""Rules on column names.  They run on the driver, on names only."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Sequence

from topshare.functions import fixed


def standard_names(names: Sequence[str]) -> dict[str, str]:
    """New name -> original name: lower case, words joined by "_", repeats numbered."""
    mapping: dict[str, str] = {}
    for original in names:
        words = [w for w in re.split(r"[\W_]+", str(original).strip().lower()) if w]
        # A header without any word still needs a name that Spark can address.
        base = name = "_".join(words) or "column"
        number = 1
        while name in mapping:
            number += 1
            name = f"{base}_{number}"
        mapping[name] = original
    return mapping


def says_percent(name: str) -> bool:
    return re.search(fixed.PERCENT_NAME, name) is not None


def says_date_text(name: str) -> bool:
    return re.search(fixed.DATE_TEXT_NAME, name) is not None


def time_kind(name: str) -> str | None:
    """date, year, month or quarter by name; the first that fits."""
    kinds = {
        "date": fixed.DATE_NAME,
        "year": fixed.YEAR_NAME,
        "month": fixed.MONTH_NAME,
        "quarter": fixed.QUARTER_NAME,
    }
    return next((kind for kind, pattern in kinds.items() if re.search(pattern, name.lower())), None)


def may_be_negative(name: str) -> bool:
    return any(word in name.lower() for word in fixed.NEGATIVE_ALLOWED)


def alias_for(name: str) -> str:
    """Identifier-like names get an alias that is the same in every run."""
    if any(re.match(pattern, name.lower()) for pattern in fixed.IDENTIFIER_NAMES):
        number = int(hashlib.md5(name.encode()).hexdigest()[:8], 16) % 1000
        return f"[ANONYMIZED_COLUMN_{number:03d}]"
    return name
