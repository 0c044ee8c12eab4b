"""Coverage of the required fields and what can be derived, for a known list of targets."""

from __future__ import annotations

from tallybook.registry import DERIVATIONS, REQUIRED_FIELDS


def required_fields_of(targets: list[str]) -> list[str]:
    return [f for f, t in REQUIRED_FIELDS.items() if t in set(targets)]


def closure(covered: list[str]) -> list[str]:
    """Fields the derivation rules add, in the order they become known."""
    known, added = set(covered), []
    grown = True
    while grown:
        fresh = []
        for name, _, needs in DERIVATIONS:
            if name not in known and known.issuperset(needs):
                known.add(name)
                fresh.append(name)
        added += fresh
        grown = bool(fresh)
    return added


def coverage_of_targets(targets: list[str], computed: list[str]) -> tuple[float, list[str], list[str]]:
    """Share of required fields present after cleaning, the computed ones, and the missing ones."""
    present = set(required_fields_of(targets))
    derived = [f for f in computed if f not in present]
    covered = present | set(derived)
    missing = [f for f in REQUIRED_FIELDS if f not in covered]
    pct = round((len(REQUIRED_FIELDS) - len(missing)) / len(REQUIRED_FIELDS) * 100, 1)
    return pct, derived, missing
