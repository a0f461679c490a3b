"""Command line: ``python -m cubeloom.cli VERB ...``; results on stdout, logs on stderr."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable, Sequence
from typing import Any

from . import errors, logs
from .plans import requests as rq


def _ints(text: str) -> tuple[int, ...]:
    return tuple(int(x) for x in text.split(",") if x.strip())


def _floats(text: str) -> tuple[float, ...]:
    return tuple(float(x) for x in text.split(",") if x.strip())


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cubeloom")
    top.add_argument("--log-level")
    top.add_argument("--log-format", choices=("text", "json"))
    verbs = top.add_subparsers(dest="verb", required=True)

    def verb(name: str, help_: str, output: bool = True, product: bool = True) -> argparse.ArgumentParser:
        p = verbs.add_parser(name, help=help_)
        p.add_argument("--json", action="store_true")
        if product:
            p.add_argument("--input", "-i", required=True)
            p.add_argument("--bands", type=_ints)
            p.add_argument("--proj-autofix", default=True, action=argparse.BooleanOptionalAction, help="accepted; projections are built in")
        if output:
            p.add_argument("--output-dir", "-o", required=name != "validate", default=None if name != "validate" else ".")
            p.add_argument("--overwrite", action="store_true")
            if name != "validate":
                p.add_argument("--product-id")
        return p

    flag = {"action": argparse.BooleanOptionalAction}
    verb("version", "versions of the engine", False, False).add_argument("--verbose", action="store_true")
    p = verb("inspect", "what a product's headers say", False)
    p.add_argument("--checksum", action="store_true")
    p.add_argument("--band-limit", type=int, default=10)
    p = verb("validate", "check a product before processing")
    p.add_argument("--dem")
    p.add_argument("--require-rpc", default=False, **flag)
    p.add_argument("--require-wavelengths", default=False, **flag)
    p.add_argument("--require-georeferencing", default=True, **flag)
    p.add_argument("--max-uncompressed-gb", type=float, default=16.0, help="0: no limit")
    p.add_argument("--strict", action="store_true")
    p = verb("preview", "a stretched PNG")
    p.add_argument("--composite", default="true-color")
    p.add_argument("--band", type=int)
    p.add_argument("--lower-percentile", type=float, default=2.0)
    p.add_argument("--upper-percentile", type=float, default=98.0)
    p.add_argument("--per-band", dest="per_band", action="store_true", default=True)
    p.add_argument("--joint", dest="per_band", action="store_false")
    p.add_argument("--max-dimension", type=int, default=2048)
    p.add_argument("--blur-kernel", type=int)
    p = verb("calculate-index", "a normalised-difference index")
    p.add_argument("--index", default="ndvi")
    for name, value in (("red", 665.0), ("nir", 842.0), ("green", 560.0), ("tolerance", 15.0)):
        p.add_argument(f"--{name}-nm", type=float, default=value)
    p.add_argument("--nodata", type=float, default=-9999.0)
    p.add_argument("--statistics", action="store_true")
    p = verb("spectral-profile", "the mean spectrum around a pixel")
    p.add_argument("--row", type=int, required=True)
    p.add_argument("--col", type=int, required=True)
    p.add_argument("--window-size", type=int, default=1)
    p = verb("quality-mask", "quality classes")
    p.add_argument("--saturation-dn", type=float, default=65535.0)
    p.add_argument("--low-signal-dn", type=float, default=10.0)
    p.add_argument("--band-fraction", type=float, default=0.5)
    p.add_argument("--evaluation-wavelengths-nm", type=_floats, default=(490.0, 560.0, 665.0, 842.0), help="empty: every band")
    p.add_argument("--morphology", default=True, **flag)
    p.add_argument("--morphology-operation", default="dilate")
    p.add_argument("--morphology-kernel-shape", default="rect")
    p.add_argument("--morphology-kernel-size", type=int, default=3)
    p.add_argument("--morphology-iterations", type=int, default=1)
    p.add_argument("--spectral-anomaly", action="store_true")
    p.add_argument("--anomaly-cv-threshold", type=float, default=2.0)
    p.add_argument("--statistics", action="store_true")
    for name in ("reproject", "orthorectify"):
        p = verb(name, "a raster on another grid" if name == "reproject" else "a raster on a map grid, by sensor model and elevation")
        p.add_argument("--target-crs", default="auto")
        p.add_argument("--resolution", type=float, default=None if name == "reproject" else 30.0)
        p.add_argument("--resampling", default="bilinear")
        p.add_argument("--data-semantics", default="continuous")
        p.add_argument("--snap-to-grid", action="store_true")
        p.add_argument("--nodata", type=float)
        if name == "reproject":
            p.add_argument("--reference-raster")
        else:
            p.add_argument("--dem", required=True)
            p.add_argument("--rpc-dem-missing-value", type=float)
            p.add_argument("--rpc-height-scale", type=float, default=1.0)
            p.add_argument("--rpc-dem-apply-vdatum-shift", action="store_true")
            p.add_argument("--warp-memory-mb", type=int, default=512)
    return top


def _request(a: argparse.Namespace) -> Any:
    values = {k: v for k, v in vars(a).items() if k not in ("verb", "json", "log_level", "log_format", "proj_autofix")}
    if a.verb == "quality-mask":
        parts = {k: values.pop(f"morphology_{k2}") for k, k2 in (
            ("operation", "operation"), ("shape", "kernel_shape"), ("size", "kernel_size"), ("iterations", "iterations"),
        )}
        values["morphology"] = rq.build(rq.Morphology, enabled=values.pop("morphology"), **parts)
    if a.verb == "validate":
        values["max_uncompressed_gb"] = values["max_uncompressed_gb"] or None
        values["check_output"] = values["output_dir"] != "."
    kinds = {
        "validate": rq.ValidationRequest, "preview": rq.PreviewRequest, "calculate-index": rq.IndexRequest, "spectral-profile": rq.ProfileRequest,
        "quality-mask": rq.MaskRequest, "reproject": rq.ReprojectRequest, "orthorectify": rq.OrthoRequest,
    }
    return rq.build(kinds[a.verb], **values)


def _session():  # noqa: ANN202
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("cubeloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def run(argv: Sequence[str], session: Callable[[], Any] = _session) -> int:
    """Exit code of a command line."""
    a = parser().parse_args(argv)
    try:
        logs.configure(a.log_level, a.log_format)
        from . import report, services

        if a.verb == "version":
            env = report.environment()
            print(json.dumps(env) if a.json else "\n".join(f"{k}: {v}" for k, v in env.items()) if a.verbose else env["engine"])
            return 0
        if a.verb == "inspect":
            found = report.inspect(session(), a.input, list(a.bands) if a.bands else None, a.checksum)
            print(json.dumps(errors.json_safe(found), default=str, indent=2) if a.json else report.inspection_text(found, a.band_limit))
            return 0
        request = _request(a)
        if a.verb == "validate":
            found = report.validate(session(), request)
            print(json.dumps(errors.json_safe(found), indent=2) if a.json else report.validation_text(found))
            report.raise_if_invalid(found)
            return 0
        services_by_verb = {
            "preview": services.render_preview, "calculate-index": services.calculate_index, "spectral-profile": services.extract_profile,
            "quality-mask": services.build_mask, "reproject": services.reproject, "orthorectify": services.orthorectify,
        }
        out = services_by_verb[a.verb](session(), request)
        print(json.dumps(errors.json_safe(out), indent=2) if a.json else "\n".join(f"{k}: {v}" for k, v in out.items()))
        return 0
    except errors.CubeError as e:
        print(json.dumps(e.to_dict()) if getattr(a, "json", False) else f"error: {e}", file=sys.stderr)
        return e.exit_code


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
