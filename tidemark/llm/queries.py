"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm.ann import op2_inverted_multi_index
from tidemark.llm.bpe import op9_byte_bpe
from tidemark.llm.compaction import OP3_SQL, op3_size_tiered_compaction
from tidemark.llm.divergence import OP13_SQL, op13_source_divergence
from tidemark.llm.interactions import OP11_SQL, op11_filter_interactions
from tidemark.llm.lines import op10_line_dedup
from tidemark.llm.media import op5_wav_fingerprints
from tidemark.llm.ngram import op1_elias_fano_lm
from tidemark.llm.packing import op6_vector_best_fit
from tidemark.llm.simhash import op8_simhash_near_dedup
from tidemark.llm.substring import op4_repeated_phrases
from tidemark.llm.toxicity import op7_toxicity
from tidemark.llm.warc import OP12_SQL, op12_warc_dictionary

QUERIES = {
    f.__name__: f
    for f in (
        op1_elias_fano_lm,
        op2_inverted_multi_index,
        op3_size_tiered_compaction,
        op4_repeated_phrases,
        op5_wav_fingerprints,
        op6_vector_best_fit,
        op7_toxicity,
        op8_simhash_near_dedup,
        op9_byte_bpe,
        op10_line_dedup,
        op11_filter_interactions,
        op12_warc_dictionary,
        op13_source_divergence,
    )
}

ORACLE_SQL: dict[str, str] = {"op3_size_tiered_compaction": OP3_SQL, "op11_filter_interactions": OP11_SQL, "op12_warc_dictionary": OP12_SQL, "op13_source_divergence": OP13_SQL}
