"""The subpackage's queries by name; SQL exists for none whose rows it cannot express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm.ann import op5_nearest_neighbours
from quillon.llm.audio import op8_audio_features
from quillon.llm.bpe import op3_bpe_replay
from quillon.llm.langid import op9_language_id
from quillon.llm.lines import op4_line_templates
from quillon.llm.minhash import op1_minhash_near_dedup
from quillon.llm.packing import op2_pack_sequences
from quillon.llm.suffixes import op6_repeated_passages
from quillon.llm.toxicity import op7_toxicity
from quillon.llm.warc import op10_warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_pack_sequences,
        op3_bpe_replay,
        op4_line_templates,
        op5_nearest_neighbours,
        op6_repeated_passages,
        op7_toxicity,
        op8_audio_features,
        op9_language_id,
        op10_warc_round_trip,
    )
}

ORACLES: dict[str, str] = {}
