"""Commands: process, dry-run, mesh, cells, colours and describe."""

from __future__ import annotations

import argparse
import logging
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from granula.functions import settings


def _session() -> SparkSession:
    return SparkSession.builder.appName("granula").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def _config(args: argparse.Namespace) -> settings.RunConfig:
    return settings.RunConfig.of(
        object_mask=args.object_mask, entities=None if args.entities is None else tuple(settings.parse_names(args.entities)), voxel_size=settings.parse_voxel_size(args.voxel_size) if args.voxel_size else None,
        label_map=tuple(sorted(settings.label_map(Path(args.label_map).read_text()).items())) if args.label_map else (), contact_um=args.contact_um, histograms=args.histograms, skeletons=tuple(settings.parse_names(args.skeletons)) if args.skeletons else (),
        label_map_entity=args.label_map_entity, clip=not args.no_clip, auto_label_masks=args.auto_label_masks, max_skeleton_voxels=args.max_skeleton_voxels, skeleton_prune=args.skeleton_prune, polarity_spread=args.polarity_spread,
        exclude=tuple(args.exclude), baseline_excluded=tuple(args.baseline_excluded), groups=tuple(args.group), noun=args.noun,
    )


def _process(args: argparse.Namespace) -> int:
    from granula.process import run

    palette = settings.palette(Path(args.colours).read_text()) if args.colours else None
    failures = run.process(_session(), args.root, args.output, _config(args), palette, **({"description": args.description} if args.description else {}))
    bad = failures.orderBy("object_id").collect()
    for r in bad:
        print(f"{r.object_id}: {r.error}", file=sys.stderr)
    return 1 if bad else 0


def _dry_run(args: argparse.Namespace) -> int:
    from granula.process import run

    presence, problems, memory = run.dry_run(_session(), args.root, _config(args))
    for r in presence.orderBy("entity_kind", "entity_name").collect():
        print(f"{r.entity_kind}:{r.entity_name} in {r.objects} objects")
    for r in memory.orderBy("object_id").collect():
        print(f"{r.object_id}: {r.bytes} bytes at its peak")
    found = problems.orderBy("path").collect()
    for r in found:
        print(f"{r.path}: {r.problem}", file=sys.stderr)
    return 1 if found else 0


def _mesh(args: argparse.Namespace) -> int:
    from granula.operators import bricks, geometry
    from granula.process import measurers, run

    spark, config = _session(), _config(args)
    voxels, kinds, objects, failures = run.loaded(spark, args.root, config)
    for size in [tuple(r[0]) for r in objects.select("voxel_size").distinct().collect()]:
        mine = objects.where(F.col("voxel_size") == F.array(*map(F.lit, size))).select("object_id")
        batch = measurers.Batch(voxels.join(mine, "object_id", "left_semi"), kinds.join(mine, "object_id", "left_semi"), size, config)
        if batch.dims == 3:
            pairs = bricks.gaps(batch.of_kind["label"], size, config.contact_um)
            found = geometry.geometry_rows(batch.voxels, batch.entities, size, batch.shaped, pairs, args.surface, args.method)
        else:
            found = batch.shaped.join(geometry.outlines(batch.voxels, size), measurers.INSTANCE).withColumnRenamed("entity", "entity_name")
        geometry.write_geometry(found.withColumn("fingerprint", F.lit(config.fingerprint())), f"{args.output}/{'x'.join(map(str, size))}")
    return 1 if not failures.isEmpty() else 0


def _cells(args: argparse.Namespace) -> int:
    from granula.process import cells

    made = cells.derive(_session(), args.membrane, args.seeds, args.outside, args.output, settings.parse_voxel_size(args.voxel_size), args.walls, args.least_um3, args.reach_um, args.store, drop_edge=args.drop_edge)
    for r in made.orderBy("label").collect():
        print(r.folder)
    return 0


def _colours(args: argparse.Namespace) -> int:
    from granula.sources import reports

    print(f"{reports.recolour(_session(), args.report, settings.palette(Path(args.palette).read_text()))} rows have a colour")
    return 0


def _describe(args: argparse.Namespace) -> int:
    from granula.sources import reports

    reports.describe(args.report, args.text)
    return 0


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="granula", description=__doc__)
    out.add_argument("-q", "--quiet", action="count", default=0)
    out.add_argument("-v", "--verbose", action="count", default=0)
    commands = out.add_subparsers(dest="command", required=True)
    for name, do, said in (("process", _process, "measure folders into a report"), ("dry-run", _dry_run, "what process would find"), ("mesh", _mesh, "geometry only")):
        c = commands.add_parser(name, help=said)
        c.set_defaults(do=do)
        c.add_argument("root")
        if name != "dry-run":
            c.add_argument("-o", "--output", required=True)
        c.add_argument("--object-mask")
        c.add_argument("--entities")
        c.add_argument("--voxel-size")
        c.add_argument("--label-map")
        c.add_argument("--label-map-entity", help="the one label entity that the map splits")
        c.add_argument("--no-clip", action="store_true", help="keep what lies outside the object mask")
        c.add_argument("--auto-label-masks", action="store_true", help="masks of several components become label entities")
        c.add_argument("--contact-um", type=float, default=0.5)
        c.add_argument("--histograms", action="store_true")
        c.add_argument("--skeletons", help="names of the structures whose instances get centre lines")
        c.add_argument("--max-skeleton-voxels", type=int, default=500_000)
        c.add_argument("--skeleton-prune", type=float, default=2.0)
        c.add_argument("--polarity-spread", action="store_true")
        c.add_argument("--exclude", action="append", default=[])
        c.add_argument("--baseline-excluded", action="append", default=[])
        c.add_argument("-p", "--group", action="append", default=[])
        c.add_argument("--noun", default="object")
        c.add_argument("--colours")
        if name == "process":
            c.add_argument("--description", default="")
        if name == "mesh":
            c.add_argument("--surface", choices=("auto", "mesh", "ellipsoid"), default="auto")
            c.add_argument("--method", choices=("surface_nets", "isosurface"), default="surface_nets")
    c = commands.add_parser("cells", help="cell folders from membranes and seeds")
    c.set_defaults(do=_cells)
    for flag in ("--membrane", "--seeds", "--voxel-size", "--output"):
        c.add_argument(flag, required=True)
    c.add_argument("--outside")
    c.add_argument("--store")
    c.add_argument("--walls", type=int, default=3)
    c.add_argument("--least-um3", type=float, default=40.0)
    c.add_argument("--reach-um", type=float)
    c.add_argument("--drop-edge", action="store_true")
    c = commands.add_parser("colours", help="give a report the colours of a palette")
    c.set_defaults(do=_colours)
    c.add_argument("report")
    c.add_argument("palette")
    c = commands.add_parser("describe", help="set the description of a report")
    c.set_defaults(do=_describe)
    c.add_argument("report")
    c.add_argument("text")
    return out


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.WARNING + 10 * (args.quiet - args.verbose))
    try:
        return args.do(args)
    except ValueError as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
