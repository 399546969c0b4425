"""The corpus pipeline: toxicity, line dedup, n-gram Jaccard join, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept:

* toxicity: documents predicted toxic go;
* line dedup: later repeats of runs of lines go from the texts, every document stays;
* n-gram Jaccard join: of documents linked at five words and similarity 0.8, the one with the smallest doc_id stays;
* decontamination: documents that hold a benchmark window go;
* packing: documents become pieces placed in sequences of at most 4096 tokens.

All but the last return the columns of ``documents``. ``run`` writes each stage's result as Parquet to the
shared folder and reads it again, so a lost executor never costs more than its stage. There is no SQL for
the whole (models and tokens cannot be expressed); tests hold it against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stratagrid.llm import decontam, jaccard, lines, packing, toxicity
from stratagrid.llm.common import cut, free, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line dedup", lines.stage),
    ("n-gram Jaccard join", jaccard.stage),
    ("benchmark decontamination", decontam.stage),
    ("best-fit packing", packing.stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = None
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if held is not None:
            free(held)
        held = docs
    return STAGES[-1][1](spark, docs, sf_dir)
