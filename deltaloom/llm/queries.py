"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from deltaloom.llm.bpe import op1_bpe
from deltaloom.llm.html_extract import op4_html
from deltaloom.llm.jaccard_join import op7_jaccard_join
from deltaloom.llm.lm_scoring import op8_lm_scoring
from deltaloom.llm.mixing import op3_mixing
from deltaloom.llm.quality_classifier import op2_quality_classifier
from deltaloom.llm.quality_rules import op10_quality_rules
from deltaloom.llm.substring_dedup import op9_substring_dedup
from deltaloom.llm.telephony import op6_telephony
from deltaloom.llm.warc import OP5_SQL, op5_warc

QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_quality_classifier, op3_mixing, op4_html, op5_warc, op6_telephony, op7_jaccard_join, op8_lm_scoring,
        op9_substring_dedup, op10_quality_rules,
    )
}
SQL = {"op5_warc": OP5_SQL}
