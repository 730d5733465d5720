"""Command line: ``python -m heliogrid.cli --scene DIR --met FILE --lat X --lon Y --out DIR``."""

from __future__ import annotations

import argparse

from . import api, session
from .operators.simulation import OUTPUTS


def boolean(text: str) -> bool:
    if text.strip().lower() in ("true", "t", "yes", "y", "1", "on"):
        return True
    if text.strip().lower() in ("false", "f", "no", "n", "0", "off"):
        return False
    raise argparse.ArgumentTypeError(f"not a truth value: {text}")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Outdoor thermal comfort of an urban scene")
    p.add_argument("--scene", required=True, help="folder of Building_DSM.tif, DEM.tif, Trees.tif")
    p.add_argument("--met", required=True, help="own-met text file")
    p.add_argument("--lat", type=float, required=True)
    p.add_argument("--lon", type=float, required=True)
    p.add_argument("--utc-offset", type=float, default=0.0)
    p.add_argument("--tile-size", type=int, default=1000)
    p.add_argument("--overlap", type=int, default=20)
    p.add_argument("--landcover", type=boolean, default=False)
    p.add_argument("--outputs", default="utci", help="comma-separated: " + ", ".join(OUTPUTS))
    p.add_argument("--out", required=True)
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    if a.tile_size <= 0 or a.overlap < 0:
        raise SystemExit("tile size must be positive and overlap not negative")
    spark = session.session()
    api.thermal_comfort(spark, a.scene, a.met, a.lat, a.lon, a.utc_offset, a.tile_size, a.overlap, tuple(a.outputs.split(",")), a.landcover, out=a.out)


if __name__ == "__main__":
    main()
