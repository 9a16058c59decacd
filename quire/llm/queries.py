"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .ann import op10_ann
from .bpe import op4_bpe
from .decontam import op2_decontaminate
from .langid import op6_language
from .oracles import ORACLE_SQL
from .pii import op1_pii
from .resample import op13_resample
from .secrets import op7_secret_scan
from .sharding import op9_shard
from .simhash import op8_simhash
from .substring import op5_substring_dedup
from .toxicity import op11_toxicity
from .vectorcodes import op12_vector_codes
from .warc import op3_warc

QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_bpe": op4_bpe,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_language": op6_language,
    "op7_secret_scan": op7_secret_scan,
    "op8_simhash": op8_simhash,
    "op9_shard": op9_shard,
    "op10_ann": op10_ann,
    "op11_toxicity": op11_toxicity,
    "op12_vector_codes": op12_vector_codes,
    "op13_resample": op13_resample,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
