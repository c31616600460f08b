"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from functools import wraps
from importlib import import_module

from .common import ship

#: query: (module, function)
_QUERIES = {
    "op1_merged_bwt_dedup": "suffix",
    "op2_forest_components": "embeddings",
    "op3_kd_sharding": "sharding",
    "op4_simhash_components": "simhash",
    "op5_edited_counts": "token_counts",
    "op6_bpe_round_trip": "bpe",
    "op7_pivot_topk": "topk",
    "op8_block_labeller": "html_text",
    "op9_language_id": "langid",
    "op10_pack_documents": "packing",
    "op11_exponion_codes": "codes",
    "op12_delete_join_variants": "variants",
    "op13_isolation_rules": "quality",
}

MODULES = [f"{__package__}.{m}" for m in _QUERIES.values()]


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {
        name: _shipped(getattr(import_module(f"{__package__}.{m}"), name))
        for name, m in _QUERIES.items()
    }


def oracle_sql() -> dict[str, str]:
    found = {}
    for name, m in _QUERIES.items():
        sql = getattr(import_module(f"{__package__}.{m}"), "ORACLE_SQL", None)
        if sql:
            found[name] = sql
    return found
