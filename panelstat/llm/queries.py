"""The queries of the training-data operators and their DuckDB SQL."""

from panelstat.llm import embedding_copies, exact_dedup, fill_middle, hard_negatives, jaccard_join, license_scan, mixing
from panelstat.llm.edit_fingerprint import op5_edit_fingerprint
from panelstat.llm.embedding_copies import op11_embedding_copies
from panelstat.llm.exact_dedup import op7_exact_dedup
from panelstat.llm.fill_middle import op12_fill_middle
from panelstat.llm.hard_negatives import op13_hard_negatives
from panelstat.llm.jaccard_join import op3_jaccard_join
from panelstat.llm.license_scan import op10_license_scan
from panelstat.llm.mixing import op4_mix_sources
from panelstat.llm.piece_transducer import op8_piece_transducer
from panelstat.llm.quality import op1_quality_classifier
from panelstat.llm.secret_scan import op9_secret_scan
from panelstat.llm.token_counts import op6_token_counts
from panelstat.llm.token_files import op2_token_files

QUERIES = {f.__name__: f for f in (
    op1_quality_classifier, op2_token_files, op3_jaccard_join, op4_mix_sources, op5_edit_fingerprint, op6_token_counts,
    op7_exact_dedup, op8_piece_transducer, op9_secret_scan, op10_license_scan,
    op11_embedding_copies, op12_fill_middle, op13_hard_negatives)}

ORACLE = {"op3_jaccard_join": jaccard_join.ORACLE, "op4_mix_sources": mixing.ORACLE,
          "op7_exact_dedup": exact_dedup.ORACLE,
          "op10_license_scan": license_scan.ORACLE, "op11_embedding_copies": embedding_copies.ORACLE,
          "op12_fill_middle": fill_middle.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE}
