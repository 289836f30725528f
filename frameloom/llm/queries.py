"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from frameloom.llm.byte_pairs import op11_byte_bpe
from frameloom.llm.exact import OP6_SQL, op6_exact_dedup
from frameloom.llm.filter_audit import OP12_SQL, op12_filter_audit
from frameloom.llm.fingerprints import op2_fingerprints
from frameloom.llm.hard_negatives import OP13_SQL, op13_hard_negatives
from frameloom.llm.licenses import op1_license_scan
from frameloom.llm.mixing import op10_mixing
from frameloom.llm.neardup import OP4_SQL, op4_near_dedup
from frameloom.llm.packing import op7_packing
from frameloom.llm.quality import op3_quality
from frameloom.llm.secret_scan import op5_secret_scan
from frameloom.llm.sharding import op9_sharding
from frameloom.llm.warc import OP8_SQL, op8_warc

QUERIES = {"op3_quality": op3_quality, "op9_sharding": op9_sharding, "op10_mixing": op10_mixing, "op1_license_scan": op1_license_scan, "op5_secret_scan": op5_secret_scan, "op2_fingerprints": op2_fingerprints, "op8_warc": op8_warc, "op4_near_dedup": op4_near_dedup, "op6_exact_dedup": op6_exact_dedup, "op7_packing": op7_packing, "op11_byte_bpe": op11_byte_bpe, "op12_filter_audit": op12_filter_audit, "op13_hard_negatives": op13_hard_negatives}
SQL = {"op8_warc": OP8_SQL, "op4_near_dedup": OP4_SQL, "op6_exact_dedup": OP6_SQL, "op12_filter_audit": OP12_SQL, "op13_hard_negatives": OP13_SQL}
