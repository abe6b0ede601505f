"""Registered queries of the corpus operators, one per operator."""

from __future__ import annotations

from detflow.llm import exact_dedup, line_dedup, manifest, phrases, variants
from detflow.llm.decontamination import op3_decontamination
from detflow.llm.exact_dedup import op5_exact_dedup
from detflow.llm.html import op6_html
from detflow.llm.licences import op4_licences
from detflow.llm.line_dedup import op8_line_dedup
from detflow.llm.manifest import op13_manifest
from detflow.llm.ngram_join import op7_ngram_join
from detflow.llm.packing import op1_packing
from detflow.llm.phrases import op11_phrases
from detflow.llm.quality import op9_quality
from detflow.llm.secrets import op2_secrets
from detflow.llm.toxicity import op10_toxicity
from detflow.llm.variants import op12_variants

QUERIES = {q.__name__: q for q in (op1_packing, op2_secrets, op3_decontamination, op4_licences, op5_exact_dedup, op6_html, op7_ngram_join,
                                  op8_line_dedup, op9_quality, op10_toxicity, op11_phrases, op12_variants, op13_manifest)}
SQL = {"op5_exact_dedup": exact_dedup.SQL, "op8_line_dedup": line_dedup.SQL, "op11_phrases": phrases.SQL, "op12_variants": variants.SQL,
       "op13_manifest": manifest.SQL}
