"""Queries of the training-data operators, and the SQL that states the same where SQL can."""

from __future__ import annotations

from .ann import op7_nearest
from .decontam import OP4_SQL, op4_decontaminate
from .langid import op10_langid
from .linededup import op3_line_dedup
from .lmscore import OP6_SQL, OP6_TRIGRAMS_SQL, op6_lm_score, op6_lm_score_trigrams
from .mixing import op1_entropy_mix
from .neardup import OP9_SQL, op9_near_duplicates
from .pii import op8_pii
from .quality import op2_quality
from .warc import OP5_SQL, op5_warc


def queries() -> dict:
    return {
        "op1_entropy_mix": op1_entropy_mix,
        "op2_quality": op2_quality,
        "op3_line_dedup": op3_line_dedup,
        "op4_decontaminate": op4_decontaminate,
        "op5_warc": op5_warc,
        "op6_lm_score": op6_lm_score,
        "op6_lm_score_trigrams": op6_lm_score_trigrams,
        "op7_nearest": op7_nearest,
        "op8_pii": op8_pii,
        "op9_near_duplicates": op9_near_duplicates,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op5_warc": OP5_SQL, "op9_near_duplicates": OP9_SQL, "op6_lm_score": OP6_SQL, "op6_lm_score_trigrams": OP6_TRIGRAMS_SQL}
