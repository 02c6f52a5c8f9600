"""The subpackage's queries and, where SQL can express them, their SQL."""

from tessera.llm import byte_bpe, exact_dedup, licenses, mixing, ngram_join, pii, quality, sharding, toxicity, vector_search

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_quality": quality.query,
    "op3_sharding": sharding.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_toxicity": toxicity.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_licenses": licenses.query,
    "op8_pii": pii.query,
    "op9_mixing": mixing.query,
    "op10_exact_topk": vector_search.query,
}

ORACLES = {
    "op3_sharding": sharding.oracle(),
    "op4_exact_dedup": exact_dedup.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_exact_topk": vector_search.ORACLE,
}
