"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarmac.llm.common import table
from tarmac.llm.decontam import DECONTAM_SQL, contamination
from tarmac.llm.exact_dedup import EXACT_SQL, exact_report
from tarmac.llm.language import language_report, page_report as page_languages
from tarmac.llm.line_dedup import LINES_SQL, line_report
from tarmac.llm.mixing import MIX_SQL, mix_report
from tarmac.llm.near_dedup import near_classes
from tarmac.llm.substring_dedup import repeat_report
from tarmac.llm.toxicity import toxicity_report
from tarmac.llm.url_filter import URL_SQL, page_report
from tarmac.llm.warc import WARC_SQL, round_trip


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    docs = lambda spark, sf: table(spark, sf, "documents")
    pages = lambda spark, sf: table(spark, sf, "pages")
    return {
        "op1_substring_dedup": lambda spark, sf: repeat_report(docs(spark, sf)),
        "op2_near_dedup": lambda spark, sf: near_classes(docs(spark, sf)),
        "op3_language_id": lambda spark, sf: language_report(docs(spark, sf)),
        "llm_page_languages": lambda spark, sf: page_languages(pages(spark, sf), docs(spark, sf)),
        "op4_exact_dedup": lambda spark, sf: exact_report(docs(spark, sf)),
        "op5_toxicity": lambda spark, sf: toxicity_report(docs(spark, sf), table(spark, sf, "labels")),
        "op6_mixing": lambda spark, sf: mix_report(docs(spark, sf)),
        "op7_warc": lambda spark, sf: round_trip(pages(spark, sf)),
        "op8_url_filter": lambda spark, sf: page_report(pages(spark, sf)),
        "op9_decontamination": lambda spark, sf: contamination(docs(spark, sf), table(spark, sf, "benchmark"), shortest=1),
        "op10_line_dedup": lambda spark, sf: line_report(docs(spark, sf)),
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": EXACT_SQL, "op7_warc": WARC_SQL, "op8_url_filter": URL_SQL, "op9_decontamination": DECONTAM_SQL, "op6_mixing": MIX_SQL, "op10_line_dedup": LINES_SQL}
