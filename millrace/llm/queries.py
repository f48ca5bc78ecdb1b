"""The registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from millrace.llm.collocations import OP12_SQL, op12_collocations
from millrace.llm.decontamination import op6_decontamination
from millrace.llm.mixing import op7_mixing
from millrace.llm.quality_rules import op4_quality_rules
from millrace.llm.secret_scan import op13_secret_scan
from millrace.llm.sharding import op3_sharding
from millrace.llm.simhash_dedup import op10_simhash_dedup
from millrace.llm.substring_dedup import OP2_SQL, op2_substring_dedup
from millrace.llm.suffix_dedup import OP5_SQL, op5_suffix_dedup
from millrace.llm.toxicity import op8_toxicity
from millrace.llm.url_filters import OP1_SQL, op1_url_filters
from millrace.llm.vector_codes import OP11_SQL, op11_vector_codes
from millrace.llm.warc import OP9_SQL, op9_warc


def queries() -> dict:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_sharding": op3_sharding,
        "op4_quality_rules": op4_quality_rules,
        "op5_suffix_dedup": op5_suffix_dedup,
        "op6_decontamination": op6_decontamination,
        "op7_mixing": op7_mixing,
        "op8_toxicity": op8_toxicity,
        "op9_warc": op9_warc,
        "op10_simhash_dedup": op10_simhash_dedup,
        "op11_vector_codes": op11_vector_codes,
        "op12_collocations": op12_collocations,
        "op13_secret_scan": op13_secret_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op5_suffix_dedup": OP5_SQL, "op9_warc": OP9_SQL, "op11_vector_codes": OP11_SQL, "op12_collocations": OP12_SQL}
