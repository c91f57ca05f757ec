"""The queries of this package, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from sparkcorpus.llm.ball_kmeans import SQL_OP12, op12_ball_kmeans
from sparkcorpus.llm.bpe import op7_bpe
from sparkcorpus.llm.hnsw import SQL_OP2, op2_embedding_dedup
from sparkcorpus.llm.jaccard_join import SQL_OP8, op8_jaccard_join
from sparkcorpus.llm.lm_score import op4_lm_score
from sparkcorpus.llm.merkle import SQL_OP11, op11_merkle_manifest
from sparkcorpus.llm.mixing import op9_mixing
from sparkcorpus.llm.quality_model import op3_quality_model
from sparkcorpus.llm.quality_rules import op6_quality_rules
from sparkcorpus.llm.rank_bpe import op13_rank_bpe
from sparkcorpus.llm.substring_dedup import SQL_OP10, op10_substring_dedup
from sparkcorpus.llm.url_filter import SQL_OP5, op5_url_filter
from sparkcorpus.llm.warc import SQL_OP1, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_embedding_dedup": op2_embedding_dedup,
    "op3_quality_model": op3_quality_model,
    "op4_lm_score": op4_lm_score,
    "op5_url_filter": op5_url_filter,
    "op6_quality_rules": op6_quality_rules,
    "op7_bpe": op7_bpe,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_mixing": op9_mixing,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_ball_kmeans": op12_ball_kmeans,
    "op13_rank_bpe": op13_rank_bpe,
}

ORACLES = {
    "op1_warc": SQL_OP1,
    "op2_embedding_dedup": SQL_OP2,
    "op5_url_filter": SQL_OP5,
    "op8_jaccard_join": SQL_OP8,
    "op10_substring_dedup": SQL_OP10,
    "op11_merkle_manifest": SQL_OP11,
    "op12_ball_kmeans": SQL_OP12,
}
