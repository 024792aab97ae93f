"""The registered queries of this subpackage and the SQL that states them, where SQL can."""

from quillon.llm.gif_media import op10_gif_media
from quillon.llm.html_crf import op3_html_crf
from quillon.llm.language_id import op4_language_id
from quillon.llm.line_runs import OP13_SQL, op13_line_runs
from quillon.llm.lsa_decontam import op1_lsa_decontam
from quillon.llm.merkle_manifest import OP11_SQL, op11_merkle_manifest
from quillon.llm.ngram_join import OP7_SQL, op7_ngram_join
from quillon.llm.quality_gam import op5_quality_gam
from quillon.llm.sentence_spans import OP6_SQL, op6_sentence_spans
from quillon.llm.source_mix import OP2_SQL, op2_source_mix
from quillon.llm.suffix_dedup import OP8_SQL, op8_suffix_dedup
from quillon.llm.token_alignment import op12_token_alignment
from quillon.llm.toxicity_ftrl import op9_toxicity_ftrl

QUERIES = {
    "op1_lsa_decontam": op1_lsa_decontam,
    "op2_source_mix": op2_source_mix,
    "op3_html_crf": op3_html_crf,
    "op4_language_id": op4_language_id,
    "op5_quality_gam": op5_quality_gam,
    "op6_sentence_spans": op6_sentence_spans,
    "op7_ngram_join": op7_ngram_join,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_toxicity_ftrl": op9_toxicity_ftrl,
    "op10_gif_media": op10_gif_media,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_token_alignment": op12_token_alignment,
    "op13_line_runs": op13_line_runs,
}

ORACLES = {"op2_source_mix": OP2_SQL, "op6_sentence_spans": OP6_SQL, "op7_ngram_join": OP7_SQL, "op8_suffix_dedup": OP8_SQL, "op11_merkle_manifest": OP11_SQL, "op13_line_runs": OP13_SQL}
