"""The registered queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from gleaner.llm import licences, line_dedup, manifest, url_filters
from gleaner.llm.fingerprints import q_fingerprints
from gleaner.llm.jaccard_join import q_jaccard_join
from gleaner.llm.mixing import q_mix
from gleaner.llm.neighbours import q_neighbours
from gleaner.llm.packing import q_packing
from gleaner.llm.periods import q_periods
from gleaner.llm.pieces import q_pieces
from gleaner.llm.sharding import q_shards
from gleaner.llm.toxicity import q_toxicity

QUERIES = {
    "op1_entropy_mix": q_mix,
    "op2_hash_tree_shards": q_shards,
    "op3_multiprobe_neighbours": q_neighbours,
    "op4_temporal_url_filter": url_filters.q_url_filters,
    "op5_line_dedup_mphf": line_dedup.q_line_dedup,
    "op6_sum_of_squares_packing": q_packing,
    "op7_ngram_jaccard_join": q_jaccard_join,
    "op8_merkle_fingerprints": q_fingerprints,
    "op9_deobfuscated_toxicity": q_toxicity,
    "op10_licence_digests": licences.q_licences,
    "op11_distinct_chunk_pieces": q_pieces,
    "op12_tiled_period_runs": q_periods,
    "op13_merkle_manifest": manifest.q_manifest,
}

SQL: dict[str, str] = {
    "op4_temporal_url_filter": url_filters.SQL,
    "op5_line_dedup_mphf": line_dedup.SQL,
    "op10_licence_digests": licences.SQL,
    "op13_merkle_manifest": manifest.SQL,
}
