"""Remaps of ids through collisions, in the order in which they were found."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIELDS = ["id", "new1", "new2", "new3", "origin", "bundle"]
IDS = FIELDS[:4]


def through_collisions(rows: Iterable[tuple], remaps: Iterable[tuple[int, int]]) -> tuple[list[tuple], dict[int, int]]:
    """(rows, names): the rows (id, new1, new2, new3, origin, bundle) after the remaps (new, old), and the names that ids end up with.

    ``old`` went into the cluster that its last row names first; that cluster's row, if it names ``new``, goes, as does ``old``'s own. ``new``
    is then called ``old`` everywhere. Where the cluster held more than two, what else came out of it takes the name of the other one
    that went in. A cluster that is gone already, or an ``old`` without a row, leaves the renaming.
    """
    held = [list(r) for r in rows]
    names: dict[int, int] = {}

    def rename(a: int, b: int) -> None:
        for r in held:
            r[:4] = [b if x == a else x for x in r[:4]]
        for k, v in names.items():
            if v == a:
                names[k] = b
        names.setdefault(a, b)

    for new, old in remaps:
        own = next((r for r in reversed(held) if r[0] == old), None)
        cluster = own[1] if own else None
        row = next((r for r in held if cluster is not None and r[0] == cluster and new in r[1:4]), None)
        mate = next((r[0] for r in held if cluster is not None and r[1] == cluster and r[0] != old), None)
        other = next((x for x in row[1:4] if x is not None and x != new), None) if row else None
        held = [r for r in held if r is not own and r is not row]
        rename(new, old)
        if row and row[5] > 2 and mate is not None and other is not None:
            rename(other, mate)
    return [tuple(r) for r in held], names


def remapped_collisions(collisions: DataFrame, remaps: DataFrame) -> DataFrame:
    """(video, id, new1, new2, new3, origin, bundle) after ``remaps`` (video, place, new, old), applied in the order of place.

    Rows are taken in the order of ids, a video's rows and remaps meet in one task. Videos without remaps keep their rows.
    """
    kinds = dict(collisions.dtypes)
    listed = remaps.groupBy("video").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", F.col("new").cast("long").alias("new"), F.col("old").cast("long").alias("old")))), lambda m: F.struct(m["new"], m["old"])).alias("_remaps"))
    rows = collisions.select("video", *[F.col(c).cast("long").alias(c) for c in FIELDS])
    plain = rows.join(listed, "video", "left_anti")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = [[None if x is None or x != x else int(x) for x in r] for r in pdf.sort_values("id")[FIELDS].itertuples(index=False)]
        out, _ = through_collisions([tuple([*v[:5], v[5] or 0]) for v in values], [(int(m["new"]), int(m["old"])) for m in pdf["_remaps"].iloc[0]])
        told = pd.DataFrame(out, columns=FIELDS).astype("Int64")
        told.insert(0, "video", key[0])
        return told

    done = rows.join(listed, "video").groupBy("video").applyInPandas(fold, f"video {kinds['video']}, " + ", ".join(f"{c} long" for c in FIELDS))
    return plain.withColumn("bundle", F.coalesce("bundle", F.lit(0))).unionByName(done).select("video", *FIELDS)
