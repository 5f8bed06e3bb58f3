"""Queries of this subpackage, and SQL for those that SQL can express."""

from importlib import import_module

MODULES = ("fingerprints", "quality", "substring_dedup", "toxicity", "suffix_dedup", "simhash", "decontamination", "url_filters", "secrets", "packing", "conversations", "whitening", "token_counts")


def _gather(name: str) -> dict:
    from pkgutil import iter_modules

    here = {m.name for m in iter_modules(import_module(__package__).__path__)}
    return {k: v for m in MODULES if m in here for k, v in getattr(import_module(f"{__package__}.{m}"), name).items()}


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _gather("ORACLE_SQL")
