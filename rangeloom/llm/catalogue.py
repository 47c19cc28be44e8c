"""Queries of the training-data operators; ``OPERATORS`` lists their modules."""

from __future__ import annotations

from rangeloom.llm import language, media, mixing, neighbours, packing, passages, pii, simhash, toxicity, transducer

OPERATORS = (pii, toxicity, neighbours, packing, media, passages, simhash, transducer, mixing, language)


def queries():
    return {name: f for module in OPERATORS for name, f in module.QUERIES.items()}


def oracle_sql():
    return {name: sql for module in OPERATORS for name, sql in getattr(module, "ORACLES", {}).items()}
