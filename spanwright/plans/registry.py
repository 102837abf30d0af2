"""All queries of the library and their oracles."""

from importlib import import_module

MODULES = ["changes", "texts", "anchoring", "study", "history"]


def _merged(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        part = getattr(import_module(f"spanwright.plans.{module}"), name)
        if clash := out.keys() & part.keys():
            raise ValueError(f"query named twice: {sorted(clash)}")
        out |= part
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracles() -> dict:
    return _merged("ORACLES")
