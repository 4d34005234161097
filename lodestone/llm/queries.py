"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from lodestone.llm.bpe import op10_bpe
from lodestone.llm.decontaminate import OP2_SQL, op2_decontaminate
from lodestone.llm.html_text import op3_html_text
from lodestone.llm.line_dedup import OP1_SQL, op1_line_dedup
from lodestone.llm.lloyd import OP12_SQL, op12_lloyd
from lodestone.llm.ngram_join import OP13_SQL, op13_ngram_join
from lodestone.llm.pii import op8_pii
from lodestone.llm.quality_rules import OP4_SQL, op4_quality_rules
from lodestone.llm.sharding import OP6_SQL, op6_sharding
from lodestone.llm.simhash import op7_simhash
from lodestone.llm.source_divergence import OP11_SQL, op11_source_divergence
from lodestone.llm.toxicity import op5_toxicity
from lodestone.llm.warc import OP9_SQL, op9_warc

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_html_text": op3_html_text,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_sharding": op6_sharding,
    "op7_simhash": op7_simhash,
    "op8_pii": op8_pii,
    "op9_warc": op9_warc,
    "op10_bpe": op10_bpe,
    "op11_source_divergence": op11_source_divergence,
    "op12_lloyd": op12_lloyd,
    "op13_ngram_join": op13_ngram_join,
}

ORACLE_SQL = {
    "op1_line_dedup": OP1_SQL,
    "op2_decontaminate": OP2_SQL,
    "op4_quality_rules": OP4_SQL,
    "op6_sharding": OP6_SQL,
    "op9_warc": OP9_SQL,
    "op11_source_divergence": OP11_SQL,
    "op12_lloyd": OP12_SQL,
    "op13_ngram_join": OP13_SQL,
}
