"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kindred.llm.licences import op4_licences
from kindred.llm.merge_replay import op3_merge_replay
from kindred.llm.neighbour_votes import op5_neighbour_votes
from kindred.llm.packing import op6_packing
from kindred.llm.quality_rules import OP2_SQL, op2_quality_rules
from kindred.llm.recompression import OP10_SQL, op10_recompression
from kindred.llm.simhash import op8_simhash
from kindred.llm.sketches import op7_sketches
from kindred.llm.token_files import op1_token_files
from kindred.llm.url_cascade import OP9_SQL, op9_url_cascade


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_quality_rules": op2_quality_rules,
        "op3_merge_replay": op3_merge_replay,
        "op4_licences": op4_licences,
        "op5_neighbour_votes": op5_neighbour_votes,
        "op6_packing": op6_packing,
        "op7_sketches": op7_sketches,
        "op8_simhash": op8_simhash,
        "op9_url_cascade": op9_url_cascade,
        "op10_recompression": op10_recompression,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2_SQL, "op9_url_cascade": OP9_SQL, "op10_recompression": OP10_SQL}
