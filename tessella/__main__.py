"""Jobs from the command line: ``python -m tessella detect FILES...`` and ``python -m tessella time FILES...``."""

from __future__ import annotations

import argparse
import statistics
import sys
import time


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tessella", description="Square fiducial markers in image files.")
    jobs = top.add_subparsers(dest="job", required=True)
    for name, text in (("detect", "print the markers of each file"), ("time", "print how long detection takes")):
        p = jobs.add_parser(name, help=text)
        p.add_argument("files", nargs="+", help="image files or folders that Spark can read")
        p.add_argument("-f", "--family", action="append", default=None, help="a marker family; may be given again (tag16h5)")
        p.add_argument("-c", "--hamming", type=int, default=1, help="wrong bits that are corrected")
        p.add_argument("-x", "--decimate", type=float, default=2.0, help="factor by which the image is made smaller")
        p.add_argument("-b", "--blur", type=float, default=0.0, help="sigma of the blur; negative sharpens")
        p.add_argument("-0", "--no-refine", action="store_true", help="don't move sides to the strongest gradient")
        p.add_argument("-t", "--threads", type=int, default=0, help="cores in local mode; 0 leaves the master as it is")
        p.add_argument("-i", "--iterations", type=int, default=1, help="how often the job is run")
        p.add_argument("-q", "--quiet", action="store_true", help="only the totals")
        p.add_argument("-d", "--debug", action="store_true", help="the time of each step")
    return top


def main(args: list[str] | None = None, spark=None) -> int:
    o = parser().parse_args(args)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from . import ship
    from .config import DetectorConfig
    from .operators import compare, decode
    from .plans import detect as plan
    from .sources import readers

    if spark is None:
        builder = SparkSession.builder.appName("tessella")
        spark = (builder.master(f"local[{o.threads}]") if o.threads else builder).getOrCreate()
    ship(spark)
    cfg = DetectorConfig(families=tuple(o.family or ["tag16h5"]), max_hamming=o.hamming, quad_decimate=o.decimate, quad_sigma=o.blur, refine_edges=not o.no_refine)
    images = readers.read_images(spark, *o.files)
    took = []
    for _ in range(o.iterations):
        began = time.perf_counter()
        found = plan.detect(images, cfg)
        rows = found.orderBy("image_id", "id", "family", "cx", "cy") if o.job == "detect" and not o.quiet else None
        counts = decode.hamming_histogram(found).orderBy(F.col("image_id").asc_nulls_last())
        for r in rows.toLocalIterator() if rows is not None else ():
            print(f"{r.image_id}: {r.family} {r.id}, {r.hamming} wrong bits, margin {r.decision_margin:.3f}, centre ({r.cx:.2f}, {r.cy:.2f})")
        total = counts.where("image_id is null").first()
        took.append(1000 * (time.perf_counter() - began))
        print(f"markers {total.n if total else 0}, by wrong bits {[total[f'h{k}'] for k in range(o.hamming + 1)] if total else []}")
    for r in readers.rejects(images).toLocalIterator():
        print(f"{r.image_id}: {r.status}", file=sys.stderr)
    if o.job == "time":
        print(f"{len(took)} runs, mean {statistics.fmean(took):.1f} ms, deviation {statistics.pstdev(took):.1f} ms")
    if o.debug:
        steps = compare.stage_deltas(plan.stage_stamps(images, cfg), "image_id", ["seq"], "utime").groupBy("seq", "name").agg(F.avg("delta").alias("us")).orderBy("seq")
        for r in steps.collect():
            print(f"{r.name}: {(r.us or 0) / 1000:.3f} ms an image")
    return 0


if __name__ == "__main__":
    sys.exit(main())
