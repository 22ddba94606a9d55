"""Stable identities, parent and child objects, populations, sample metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def entity_id(dataset: Column, operation: str, kind: str, label: Column, frame: Column | None = None, parent: Column | None = None) -> Column:
    """dataset/operation/kind/frame[/parent]/label; a missing frame is '-'."""
    parts = [dataset, F.lit(operation), F.lit(kind), F.coalesce(frame.cast("string"), F.lit("-")) if frame is not None else F.lit("-")]
    return F.concat_ws("/", *parts, *([parent.cast("string")] if parent is not None else []), label.cast("string"))


def migrate(column: Column, old: str, new: str) -> Column:
    """Another dataset in front, where the id begins with the old one."""
    return F.when(F.startswith(column, F.lit(f"{old}/")), F.concat(F.lit(f"{new}/"), F.substring(column, len(old) + 2, 1_000_000))).otherwise(column)


def active(table: DataFrame, population: DataFrame, id: str) -> DataFrame:
    """Rows of the active population."""
    return table.join(population.select(id), id, "left_semi")


def children_of(parents: DataFrame, children: DataFrame, on: list[str]) -> DataFrame:
    """Parents with the number and ids of their children; parents without any stay."""
    kids = children.groupBy(*on).agg(F.count(F.lit(1)).alias("n_children"), F.min("child").alias("first_child"), F.max("child").alias("last_child"))
    return parents.join(kids, on, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))


def tier(pinned: Column, selected: Column, excluded: Column) -> Column:
    return F.when(pinned, "pinned").when(selected, "selected").when(excluded, "excluded").otherwise("filtered_in")


def stem(path: Column) -> Column:
    """File name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def attach_samples(images: DataFrame, sheet: DataFrame, fields: list[str]) -> DataFrame:
    """Condition fields by image stem, sheet before in-app before file name, field by field; blank cells are absent. Of several
    sheet rows of one stem, the first in the order of its values counts."""
    clean = sheet.select(stem(F.col("stem")).alias("stem"), *(F.nullif(F.trim(F.col(f)), F.lit("")).alias(f"sheet_{f}") for f in fields))
    # of several rows of a stem the least values win, whatever order the sheet is read in
    clean = clean.groupBy("stem").agg(F.min(F.struct(*clean.columns[1:])).alias("s")).select("stem", "s.*")
    out = images.join(clean, "stem", "left")
    return out.select(*[c for c in images.columns if not c.startswith(("app_", "name_"))], *(F.coalesce(f"sheet_{f}", f"app_{f}", f"name_{f}").alias(f) for f in fields))


def partial_hash(content: Column, size: int = 65536) -> Column:
    """First 32 hex digits of SHA-256 over head, middle and tail of at most `size` bytes each, and the length."""
    n = F.octet_length(content)
    piece = lambda at: F.substring(content, at, size)
    whole = F.concat(piece(F.lit(1)), piece(F.greatest(F.lit(1), (n / 2).cast("int"))), piece(F.greatest(F.lit(1), n - size + 1)), n.cast("string").cast("binary"))
    return F.substring(F.sha2(whole, 256), 1, 32)
