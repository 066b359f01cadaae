"""The registered queries of this subpackage; a package that is missing shows here, when this module is imported."""

from __future__ import annotations

import corpus_pipeline

from . import align, bwtdedup, nnpu, pst, revsearch, rpforest, simhash, spviterbi, tokenfile, tokenfst, urlfilter, warc, winnow

#: query name -> module; each module has a function of that name and, where SQL can say it, SQL.
MODULES = {
    "op1_warc": warc,
    "op2_url_filters": urlfilter,
    "op3_token_output": tokenfile,
    "op4_simhash_near_dedup": simhash,
    "op6_sentencepiece": spviterbi,
    "op8_benchmark_decontamination": winnow,
    "op9_toxicity": nnpu,
    "op7_lm_scoring": pst,
    "op5_suffix_array_dedup": bwtdedup,
    "op10_embedding_near_dedup": rpforest,
    "op11_ranked_lexical_search": revsearch,
    "op12_token_counts": tokenfst,
    "op13_cross_tokenizer_alignment": align,
}


def queries() -> dict:
    return {q: getattr(m, q) for q, m in MODULES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {q: m.SQL for q, m in MODULES.items() if getattr(m, "SQL", None)}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
