"""Corpus pipeline: quality, near duplicates, decontamination, source mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet and read again as the next one's ``docs``; all but the last
return the columns of ``documents``. Every stage works on all rows that its predecessor
kept. The cases that each stage defines for nulls, empty and repeated
rows are those of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coexnet.llm.common import save, table, unused
from coexnet.llm.decontaminate import drop_contaminated
from coexnet.llm.jaccard import keep_one
from coexnet.llm.mix import mix
from coexnet.llm.quality import PuNetwork, fit_quality, held_out, score_quality

LEAST_SCORE = 0.5


_fitted: dict[tuple, PuNetwork] = {}


def classifier(spark: SparkSession, sf_dir: str) -> PuNetwork:
    """Learned from the training fold of ``labels`` and the whole ``documents`` table, whatever a stage is given; so it is the same in all stages.

    Both stages that score share one fit: the last network is held, and used again as long as the rows of both tables are
    the same by the sums of their hashes.
    """
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    digest = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*df.columns).cast("decimal(38)")), F.sum(F.hash(*df.columns).cast("long"))).first())
    key = (sf_dir, digest(docs), digest(labels))
    if key not in _fitted:
        model = fit_quality(docs, labels, lambda c: ~held_out(c))
        _fitted.clear()
        _fitted[key] = model
    return _fitted[key]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (score of at least 0.5)."""
    [score] = unused(docs, "__quality")
    return score_quality(docs, classifier(spark, sf_dir), score_col=score).where(F.col(score) >= LEAST_SCORE).select(*(F.col(f"`{c}`") for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles: that with the smallest id."""
    return keep_one(docs, n=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: every document with the words that are taken of it, weighted by its quality score."""
    scored = score_quality(docs.select("doc_id", "text", "source"), classifier(spark, sf_dir), score_col="weight")
    return mix(scored, F.col("weight")).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("source_mix", source_mix)]

#: The classifier and the search for edited passages have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
