"""A bounded, repeatable sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tabwright.session import staged


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_label: int, seed: int, where: Column | None = None
) -> tuple[DataFrame, dict[int, int]]:
    """Whole rows of at most ``per_label`` labelled ids of each label (0 and 1), and how many ids each label has.

    Ids are taken in the order of a hash, so the sample does not depend on the layout of the
    tables. Null ids and labels are left out. The ids are at most ``2 * per_label``, which bounds
    the broadcast.
    """
    known = labels.select("doc_id", F.col(label).cast("int").alias("__label")).filter("doc_id IS NOT NULL")
    known = known.filter(F.col("__label").isin(0, 1))
    if where is not None:
        known = known.filter(where)
    known = known.dropDuplicates(["doc_id"])
    counts = {int(r[0]): int(r[1]) for r in known.groupBy("__label").count().collect()}
    order = [F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")]
    taken = [known.filter(F.col("__label") == v).orderBy(*order).limit(per_label) for v in (0, 1)]
    ids = staged(taken[0].unionByName(taken[1]), "sample-ids")
    return docs.join(F.broadcast(ids), "doc_id"), counts
