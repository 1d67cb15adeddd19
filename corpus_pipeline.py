"""A corpus pipeline over documents, each stage written as Parquet and read again by the next.

1. quality_rules drops documents that the repetition rules reject.
2. near_duplicates keeps one document of each class.
3. decontamination drops documents that hold a benchmark passage.
4. secret_scans masks secrets in the texts (n_chars follows).
5. packing gives the pieces and sequences of what is left.

Null and empty texts have no words, so the first stage rejects them. Rows with a null doc_id stay if their texts do; of equal rows one
stays. A table without rows gives none. Extra columns pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tradeweave.llm import decontaminate, neardup, packing, quality, secrets
from tradeweave.llm.common import Scratch, table
from tradeweave.llm.tokens import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: What the stage before wrote for itself, by stage: it can go when the next one begins, as that reads what was written out.
_own: dict[int, list[Scratch]] = {}


def _stage(k: int) -> Callable[[Stage], Stage]:
    """Stage k of one corpus. It lets go of the tables that stage k - 1 last wrote for itself; those of the last stage stay, as its
    result reads them. Stages of two corpora must not take turns."""

    def wrap(fn: Stage) -> Stage:
        def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            for old in _own.pop(k - 1, []):
                old.drop()
            known = set(map(id, Scratch.made))
            out = fn(spark, docs, sf_dir)
            _own[k] = [s for s in Scratch.made if id(s) not in known]
            return out

        return run

    return wrap


@_stage(0)
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.kept(docs)


@_stage(1)
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.one_of_each(docs)


@_stage(2)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage(3)
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


@_stage(4)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("packing", packing_stage),
]

#: SQL can't express most stages; tests hold them against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, fn) in enumerate(STAGES):
        docs = fn(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.keep(docs, name)
    return docs
