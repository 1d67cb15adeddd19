"""The queries of this subpackage and the SQL that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import op10_decontamination
from .divergence import OP13_SQL, op13_source_divergence
from .langid import op12_language_id
from .merkle import OP11_SQL, op11_merkle_manifest
from .neardup import op2_near_duplicates
from .packing import op1_packing
from .pii import op7_personal_data
from .quality import op9_quality_rules
from .quotes import op5_quotation_links
from .secrets import op3_secret_scan
from .tokenfile import op6_token_files
from .urls import OP8_SQL, op8_url_filter
from .warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_secret_scan": op3_secret_scan,
    "op4_warc": op4_warc,
    "op5_quotation_links": op5_quotation_links,
    "op6_token_files": op6_token_files,
    "op7_personal_data": op7_personal_data,
    "op8_url_filter": op8_url_filter,
    "op9_quality_rules": op9_quality_rules,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_language_id": op12_language_id,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op4_warc": OP4_SQL,
    "op8_url_filter": OP8_SQL,
    "op11_merkle_manifest": OP11_SQL,
    "op13_source_divergence": OP13_SQL,
}
