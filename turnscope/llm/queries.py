"""The registered queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from .chat import OP13_SQL, op13_chat_format
from .clusters import OP11_SQL, op11_centroid_clusters
from .codes import OP12_SQL, op12_vector_codes
from .decontaminate import op3_benchmark_decontamination
from .embeddings import op9_embedding_near_dedup
from .mixing import OP6_SQL, op6_mix_sources
from .oracles import OP2_SQL, OP8_SQL, OP9_SQL
from .quality import op5_quality_crf
from .secrets import op8_secret_scan
from .simhash import op1_simhash_near_dedup
from .suffix import op2_suffix_array_dedup
from .toxicity import op4_toxicity_segments
from .urlfilter import op10_url_filter
from .warc import OP7_SQL, op7_warc_revisits

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_suffix_array_dedup": op2_suffix_array_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_toxicity_segments": op4_toxicity_segments,
    "op5_quality_crf": op5_quality_crf,
    "op6_mix_sources": op6_mix_sources,
    "op7_warc_revisits": op7_warc_revisits,
    "op8_secret_scan": op8_secret_scan,
    "op9_embedding_near_dedup": op9_embedding_near_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_vector_codes": op12_vector_codes,
    "op13_chat_format": op13_chat_format,
}

ORACLES: dict[str, str] = {
    "op2_suffix_array_dedup": OP2_SQL,
    "op6_mix_sources": OP6_SQL,
    "op7_warc_revisits": OP7_SQL,
    "op8_secret_scan": OP8_SQL,
    "op9_embedding_near_dedup": OP9_SQL,
    "op11_centroid_clusters": OP11_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
