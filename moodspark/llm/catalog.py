"""Registered queries of the package and the SQL that defines their results."""

import corpus_pipeline
from moodspark.llm import (
    compression,
    conversations,
    divergence,
    hnsw,
    licenses,
    lines,
    minhash,
    packing,
    personal,
    sharding,
    templates,
    toxicity,
    urls,
)

QUERIES = {
    "op1_decontamination": templates.op1_decontamination,
    "op2_near_vectors": hnsw.op2_near_vectors,
    "op3_line_dedup": lines.op3_line_dedup,
    "op4_minhash": minhash.op4_minhash,
    "op5_quality": compression.op5_quality,
    "op6_personal_data": personal.op6_personal_data,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_url_filter": urls.op8_url_filter,
    "op9_packing": packing.op9_packing,
    "op10_licenses": licenses.op10_licenses,
    "op11_divergence": divergence.op11_divergence,
    "op12_sharding": sharding.op12_sharding,
    "op13_conversations": conversations.op13_conversations,
    "pipeline": corpus_pipeline.run,
}
SQL = {
    "op3_line_dedup": lines.OP3_SQL,
    "op10_licenses": licenses.OP10_SQL,
    "op11_divergence": divergence.OP11_SQL,
    "op12_sharding": sharding.OP12_SQL,
    "op13_conversations": conversations.OP13_SQL,
}
if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
