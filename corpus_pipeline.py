"""Corpus pipeline: language ID, near-duplicate removal, decontamination, redaction, tokenisation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from morrowgrid.llm.bpe import tokenize_stage
from morrowgrid.llm.decontamination import drop_leaks_stage
from morrowgrid.llm.kernel import shared_folder
from morrowgrid.llm.language_id import keep_known_language
from morrowgrid.llm.near_dup import keep_one_stage
from morrowgrid.llm.pii import redact_stage

#: Each function takes (spark, docs, sf_dir); what it returns is written as Parquet and read again as the next one's docs.
STAGES = [
    ("language_id", keep_known_language),
    ("near_dedup", keep_one_stage),
    ("decontamination", drop_leaks_stage),
    ("pii_redaction", redact_stage),
    ("bpe_tokens", tokenize_stage),
]

#: No stage but the exact drops can be said in SQL: the trained models, sampling and byte-pair merging can't.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes between them is Parquet in the shared checkpoint folder.

    One row for each document that all stages keep, with its columns and the last stage's. Null, empty and
    wordless texts go at the first stage; rows that repeat an id and text go but for one at the second; what
    else nulls, ties and clashing names do is said at each stage. An empty table gives no row. A stage's
    folder is deleted once the next one's is written; the last one is what the result reads.
    """
    shared_folder(spark)
    base = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    where, done = f"{base}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{where}/{name}")
        docs = spark.read.parquet(f"{where}/{name}")
        if done:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{where}/{done}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
        done = name
    return STAGES[-1][1](spark, docs, sf_dir)
