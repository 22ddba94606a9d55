"""Recorded pipelines: a list of steps with parameters is checked, turned into one lazy plan and run by name; goals pick steps."""

from __future__ import annotations

import inspect
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import cells, coloc, objects, pixel, planes, spatial, tracks


@dataclass(frozen=True)
class Operation:
    """A step's name, what it reads and makes, and its plan: relations and parameters to a relation."""

    name: str
    reads: tuple[str, ...]
    makes: str
    plan: Callable[..., DataFrame]
    defaults: dict = field(default_factory=dict)
    summary: str = ""


REGISTRY: dict[str, Operation] = {}


def register(name: str, reads: tuple[str, ...], makes: str, summary: str = "", **defaults):
    """Add an operation; a name that is taken is an error. This is also how users add their own."""

    def add(plan):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered already")
        REGISTRY[name] = Operation(name, reads, makes, plan, defaults, summary)
        return plan

    return add


def _options(kernel) -> dict:
    """A kernel's options and their defaults, by its signature."""
    return {n: p.default for n, p in inspect.signature(kernel).parameters.items() if p.default is not p.empty}


for _name, _kernel in planes.FILTERS.items():
    register(_name, ("pixels",), "pixels", f"filter {_name}", **_options(_kernel))(lambda pixels, _n=_name, **p: planes.filtered(pixels, _n, **p))
register("rescale", ("pixels",), "pixels", "min-max rescaling", low=0.0, high=1.0)(lambda pixels, low, high: pixel.rescale(pixels, low, high).select("img", "y", "x", "v"))
register("invert", ("pixels",), "pixels", "inversion", top=1.0)(lambda pixels, top: pixel.invert(pixels, top))
register("clip_low", ("pixels",), "pixels", "negatives become zero")(pixel.clip_low)
register("flat_field", ("pixels", "reference"), "pixels", "division by a flat reference", dark=0.0)(lambda pixels, reference, dark: pixel.flat_field(pixels, reference, dark).select("img", "y", "x", "v"))
register("subtract_background", ("pixels", "background"), "pixels", "background taken off")(lambda pixels, background: pixel.subtract_background(pixels, background).select("img", "y", "x", "v"))
register("crop_to_labels", ("pixels", "labels"), "pixels", "box of the labels", pad=0)(lambda pixels, labels, pad: pixel.crop_to_mask(pixels, labels.select("img", "y", "x"), pad).select("img", "y", "x", "v"))
register("frame_range", ("stack",), "stack", "frames from first to last", first=0, last=1 << 31)(lambda stack, first, last: stack.where(F.col("t").between(first, last)))
register("projection", ("stack",), "pixels", "one plane of a stack", how="max")(lambda stack, how: pixel.projection(stack, how))
register("bleach_correction", ("stack", "factors"), "stack", "frames times their factors")(cells.bleach_corrected)
register("segment", ("pixels",), "labels", "threshold, fill, split", method="otsu", least=6)(lambda pixels, method, least: planes.segmented(pixels, method, least))
register("remove_small", ("labels",), "labels", "labels of few pixels go", least=6)(objects.remove_small)
register("renumber", ("labels",), "labels", "labels counted from 1", offset=0)(cells.renumbered)
register("regions", ("labels", "pixels"), "objects", "region statistics")(lambda labels, pixels: objects.region_statistics(labels, pixels))
register("flag_sizes", ("objects",), "objects", "size outliers", k=3.5)(lambda objects_, k: objects.outliers(objects_, "area", ["img"], k))
register("partition", ("labels", "pixels"), "fields", "partition of each field")(lambda labels, pixels: objects.partition_field(labels, pixels))
register("field_summary", ("labels", "pixels"), "field_summary", "objects of each field", microns=1.0)(objects.field_summary)
register("size_distribution", ("objects",), "size_distribution", "likelihoods of size laws")(lambda objects_: objects.size_mle(objects_, ["img"], "area"))
register("client_enrichment", ("labels", "pixels"), "enrichment", "dense over dilute", background=0.0)(objects.enrichment)
register("cell_enrichment", ("labels", "cells", "pixels"), "cell_enrichment", "enrichment in each cell", shell=5, background=0.0)(cells.cell_enrichment)
register("cell_summary", ("labels", "cells"), "cell_summary", "objects of each cell", microns=1.0)(cells.cell_summary)
register("cell_fractals", ("labels", "cells"), "cell_fractals", "box dimensions", side=512, least=16)(cells.cell_fractals)
register("line_profile", ("pixels",), "profile", "values along a line", line=(0.0, 0.0, 0.0, 1.0), width=1, how="mean")(lambda pixels, line, width, how: cells.line_profile(pixels, tuple(line), width, how))
register("pixel_coloc", ("channels",), "coloc", "pixel coefficients", a="v1", b="v2")(coloc.pixel_coefficients)
register("frame_coloc", ("channel_stack",), "coloc_trace", "coefficients of each frame")(cells.frame_coefficients)
register("spatial_metrology", ("points",), "neighbours", "nearest neighbours of each cell")(spatial.nearest_neighbours)
register("ripley", ("points", "areas"), "ripley", "Ripley's K and L", radii=(1.0, 2.0, 4.0))(lambda points, areas, radii: spatial.ripley_l(points, areas, list(radii)))
register("frame_shapes", ("frame_labels",), "shapes", "shapes in each frame", microns=1.0)(lambda labels, microns: cells.shape(labels, ["img", "t"], microns))
register("link", ("detections",), "linked", "greedy links", reach=2.0)(lambda detections, reach: planes.link_greedy(detections, reach))
register("merge_fission", ("frame_labels",), "events", "merges and fissions")(tracks.merges_and_fissions)
register("drift_correction", ("tracks",), "tracks", "common motion taken off")(tracks.drift_corrected)
register("msd", ("tracks",), "msd", "mean square displacement", most_lag=20, least_length=200, interval=1.0)(tracks.msd)
register("survival", ("tracks",), "survival", "Kaplan-Meier", total_frames=1 << 31)(tracks.kaplan_meier)
register("melt", ("objects",), "long", "long form")(lambda objects_: objects.melt(objects_.withColumn("id", F.concat_ws("/", "img", "label")).drop("label"), "object", "id", {"area": "px"}, ["img"]))


@dataclass
class StepResult:
    step: str
    status: str  # ok, skipped or error; an error if and only if there is one
    error: Exception | None = None


def operations(spark) -> DataFrame:
    """The vocabulary."""
    return spark.createDataFrame([(o.name, list(o.reads), o.makes, o.summary, json.dumps(o.defaults)) for o in REGISTRY.values()], "name string, reads array<string>, makes string, summary string, defaults string")


def replay(steps: str | list[dict], relations: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], list[StepResult]]:
    """Relations after all steps, each step {"op": name, "params": {..}} reading what the ones before made. The plan stays
    lazy; a failed step leaves its output out and later steps that need it are skipped."""
    steps = json.loads(steps) if isinstance(steps, str) else steps
    have, results, lost = dict(relations), [], set()
    for s in steps:
        op = REGISTRY.get(s["op"])
        try:
            if op is None:
                raise KeyError(f"no operation {s['op']}")
            if missing := [r for r in op.reads if r not in have or r in lost]:
                if lost & set(missing):
                    results.append(StepResult(s["op"], "skipped"))
                    lost.add(op.makes)
                    continue
                raise ValueError(f"{op.name} needs {', '.join(missing)}")
            extra = set(s.get("params", {})) - set(op.defaults)
            if extra:
                raise ValueError(f"{op.name} has no parameter {', '.join(sorted(extra))}")
            have[op.makes] = op.plan(*(have[r] for r in op.reads), **{**op.defaults, **s.get("params", {})})
            results.append(StepResult(s["op"], "ok"))
        except Exception as e:  # noqa: BLE001  a step's failure is its result
            results.append(StepResult(s["op"], "error", e))
            if op is not None:
                lost.add(op.makes)
    return have, results


def plan_for(goal: str, have: set[str]) -> list[str]:
    """Shortest list of operations that makes a relation from those there are; filters are never put in unasked."""
    makers = [o for o in REGISTRY.values() if o.makes not in o.reads]
    paths: dict[str, list[str]] = {h: [] for h in have}
    while goal not in paths:
        new = {}
        for o in makers:
            if o.makes not in paths and all(r in paths for r in o.reads):
                steps = list(dict.fromkeys(x for r in o.reads for x in paths[r])) + [o.name]
                if o.makes not in new or len(steps) < len(new[o.makes]):
                    new[o.makes] = steps
        if not new:
            raise ValueError(f"no way to {goal}")
        paths |= new
    return paths[goal]
