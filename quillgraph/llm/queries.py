"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm.byte_bpe import op13_byte_bpe
from quillgraph.llm.decontaminate import DECONTAMINATION_SQL, op7_decontaminate
from quillgraph.llm.lm_scoring import op2_lm_scoring
from quillgraph.llm.merkle_manifest import MERKLE_SQL, op11_merkle_manifest
from quillgraph.llm.mixing import op8_mixing
from quillgraph.llm.ngram_join import NGRAM_SQL, op9_ngram_join
from quillgraph.llm.preference import PREFERENCE_SQL, op3_preference
from quillgraph.llm.quality import op4_quality
from quillgraph.llm.sort_means import SORT_MEANS_SQL, op12_sort_means
from quillgraph.llm.token_archive import op6_token_archive
from quillgraph.llm.token_counts import op1_token_counts
from quillgraph.llm.toxicity import op5_toxicity
from quillgraph.llm.topk_search import TOPK_SQL, op10_topk_search


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_preference": op3_preference,
        "op4_quality": op4_quality,
        "op5_toxicity": op5_toxicity,
        "op6_token_archive": op6_token_archive,
        "op7_decontaminate": op7_decontaminate,
        "op8_mixing": op8_mixing,
        "op9_ngram_join": op9_ngram_join,
        "op10_topk_search": op10_topk_search,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_sort_means": op12_sort_means,
        "op13_byte_bpe": op13_byte_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_preference": PREFERENCE_SQL,
        "op7_decontaminate": DECONTAMINATION_SQL,
        "op9_ngram_join": NGRAM_SQL,
        "op10_topk_search": TOPK_SQL,
        "op11_merkle_manifest": MERKLE_SQL,
        "op12_sort_means": SORT_MEANS_SQL,
    }
