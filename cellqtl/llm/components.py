"""Connected components of a table of links, by hooking and pointer jumping in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import save


def merged(edges: DataFrame, start: DataFrame | None = None, rounds: int | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`components` and the links (a, b, both ways) that its last round still saw between different labels. A later call that starts from these
    labels needs no others of ``edges``: ids of one label move as one, so a link inside of a label is dropped as soon as it is."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()  # drops null ends, too
    both = save(both, "links")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c"))
    if start is not None:
        # as they are, so that ids of one label move as one
        label = label.join(start.select("id", F.col("c").alias("was")), "id", "full").select("id", F.coalesce("was", "c").alias("c"))
    label = save(label, "labels")
    done = 0
    while True:
        ends = both.join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").join(label.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a")
        ends = save(ends.where("ca <> cb"), "links")
        both = ends.select("a", "b")
        if done == rounds or not both.limit(1).count():
            return label, both
        # the least label next to any member hooks the whole tree under it
        hook = ends.groupBy(F.col("ca").alias("c")).agg(F.min(F.least("ca", "cb")).alias("h"))
        hooked = label.join(hook, "c", "left").select("id", F.coalesce("h", "c").alias("c"))
        jump = hooked.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        label = save(hooked.join(jump, "c", "left").select("id", F.least("c", F.coalesce("cc", "c")).alias("c")), "labels")
        done += 1


def components(edges: DataFrame, start: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """``edges`` a, b (long) -> id, c for every id in a link, c the smallest id of its component. Each round writes its
    labels to the shared folder; the number of rounds grows with the logarithm of a component's diameter.

    ``start`` (id, c): labels of an earlier call over other links, from which this one goes on. With ``rounds`` it ends after so many, and c
    may be another id of the component than the smallest: ids of one c are linked, but those of a component may have several.

    Defined cases: a link to itself and a link with a null end count for nothing; repeated links count once; without links the
    result is empty; extra columns are ignored."""
    return merged(edges, start, rounds)[0]
