"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from corpus_pipeline import run
from verso.llm.chains import op2_passages
from verso.llm.chat import op8_chat
from verso.llm.codes import OP13_SQL, op13_codes
from verso.llm.decontaminate import op10_decontamination
from verso.llm.licenses import op3_licenses
from verso.llm.minhash import OP7_SQL, op7_near_duplicates
from verso.llm.mixing import OP9_SQL, mix_shards, op9_mixing
from verso.llm.ngrams import op12_scores
from verso.llm.quality import OP1_SQL, op1_quality
from verso.llm.secrets import op4_secrets
from verso.llm.suffixes import op6_suffixes
from verso.llm.trie import OP11_SQL, op11_prefix_trie
from verso.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    "op1_quality": op1_quality,
    "op2_passages": op2_passages,
    "op3_licenses": op3_licenses,
    "op4_secrets": op4_secrets,
    "op5_warc": op5_warc,
    "op6_suffixes": op6_suffixes,
    "op7_near_duplicates": op7_near_duplicates,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_scores": op12_scores,
    "op13_codes": op13_codes,
    "mix_shards": mix_shards,
    "pipeline": run,
}
ORACLES = {
    "op1_quality": OP1_SQL,
    "op5_warc": OP5_SQL,
    "op7_near_duplicates": OP7_SQL,
    "op9_mixing": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op13_codes": OP13_SQL,
}
