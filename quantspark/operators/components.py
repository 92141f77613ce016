"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantspark.shared import Scratch, stored

from .nets import labels


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, component) of every node of an edge; a component's name is its least node.

    Labels spread to neighbours and then jump to their label's label, so rounds grow with the logarithm of a chain's
    length. Each round is written to the shared folder; whether a label changed is all that comes to the driver, and only the
    last round's table stays.
    """
    e = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst")
    with Scratch() as outer:
        both = stored(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "edges")
        labels = stored(both.groupBy("src").agg(F.min("dst").alias("m")).select(F.col("src").alias("id"), F.least("src", "m").alias("component")), "labels")
        while True:
            with Scratch() as round_:
                near = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("m"))
                spread = labels.join(near, labels["id"] == near["src"]).select("id", F.col("component").alias("was"), F.least("component", "m").alias("component"))
                to = labels.select(F.col("id").alias("_id"), F.col("component").alias("_to"))
                spread = spread.join(to, spread["component"] == to["_id"], "left").select("id", "was", F.least("component", F.coalesce("_to", "component")).alias("component"))
                spread = round_.keep(stored(spread, "labels"))
            labels = spread.select("id", "component")
            if spread.filter("was <> component").isEmpty():
                outer.keep(spread)
                return labels


def page_components(rows: DataFrame, pairs: DataFrame, key: str, name: str, page: list[str]) -> DataFrame:
    """`rows` with `name`, the least key of their page that pairs (page, a, b) lead to; keys are unique within a page.

    A graph that lies inside one page is solved there: a page's pairs are one task's arrays.
    """

    def solve(t: pa.Table) -> pa.Table:
        keys, back = np.unique(np.concatenate([t["a"].to_numpy(), t["b"].to_numpy()]), return_inverse=True)
        least = labels(len(keys), back[: t.num_rows], back[t.num_rows :])
        own = {c: pa.array([t[c][0].as_py()] * len(keys), t.schema.field(c).type) for c in page}
        return pa.table({**own, "_key": pa.array(keys), name: pa.array(keys[least])})

    kinds = {f.name: f.dataType.simpleString() for f in pairs.schema}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in page), "_key long", f"{name} long"])
    pairs = pairs.select(*page, F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    found = pairs.groupBy(*page).applyInArrow(solve, schema).withColumnRenamed("_key", key)
    return rows.join(found, [*page, key], "left").withColumn(name, F.coalesce(name, key))
