"""From raw documents to packed training batches.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again as the docs of the next. Rejected, copied and
contaminated documents go; personal data are replaced; what stays is packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sonarium.llm import common, decontaminate, neardup, packing, pii, quality

STAGES = [
    ("quality rules", quality.stage_quality),
    ("near-duplicates", neardup.stage_near_duplicates),
    ("decontamination", decontaminate.stage_decontaminate),
    ("personal data", pii.stage_pii),
    ("packing", packing.stage_packing),
]

#: SQL can express neither expectation-maximisation nor minhashes; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents, each written to the shared folder and read again."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        if before is not None:
            common.dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
