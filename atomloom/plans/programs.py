"""The four programs: fit, predict, tabulate, convert.

python -m atomloom fit PARAMS.json | predict POTENTIAL IN.xyz OUT.xyz | tabulate PARAMS.json | convert IN.xml OUT.json
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession

from atomloom.operators.fit import read_fit
from atomloom.operators.potentials import predict as predict_terms
from atomloom.operators.structures import set_predictions, strip_virials
from atomloom.operators.tabulate import Grids, tabulate
from atomloom.sources import files, gap_xml, xyz


def fit(spark: SparkSession, spec: dict):
    """Fit a potential to training_data_xyz and write it to output_file."""
    if "output_file" in spec:
        files.check_writable(spec["output_file"])
    structures, atoms = xyz.read_xyz(spark, spec["training_data_xyz"])
    if not spec.get("use_virials", True):
        structures = strip_virials(structures)
    potential = read_fit(spec).fit(structures, atoms)
    if "output_file" in spec:
        files.write_potential(potential, spec["output_file"])
    return potential


def predict(spark: SparkSession, spec: dict):
    """Predict input_xyz with potential_file; the frames are written to output_xyz."""
    potential = files.load_potential(spec["potential_file"])
    structures, atoms = xyz.read_xyz(spark, spec["input_xyz"])
    p, f = predict_terms(structures, atoms, potential)
    structures, atoms = set_predictions(structures, atoms, p, f)
    if "output_xyz" in spec:
        xyz.write_xyz(structures, atoms, spec["output_xyz"])
    return structures, atoms


def tabulate_potential(spark: SparkSession, spec: dict):
    """Tabulate potential_file on the grids; spline tables and eam.fs files get output_file_prefix."""
    potential = files.load_potential(spec["potential_file"])
    grids = Grids.read(spec)
    tables = tabulate(potential, grids, spark)
    prefix = spec["output_file_prefix"]
    files.write_tables(tables, grids, spec, potential, prefix + ".tables")
    return tables, files.write_eam_fs(tables, grids, prefix)


def convert(source: str, target: str) -> dict:
    out = gap_xml.convert(source)
    with open(target, "w") as f:
        json.dump(out, f, indent=4)
    return out


def main(args: list[str]) -> int:
    from .session import local_session

    if len(args) == 3 and args[0] == "convert":
        convert(args[1], args[2])
        return 0
    if (len(args) != 4 or args[0] != "predict") and (len(args) != 2 or args[0] not in ("fit", "tabulate")):
        print(__doc__)
        return 2
    spark = SparkSession.getActiveSession() or local_session()
    if args[0] == "predict":
        predict(spark, {"potential_file": args[1], "input_xyz": args[2], "output_xyz": args[3]})
    elif args[0] == "fit":
        fit(spark, files.read_json(args[1]))
    else:
        tabulate_potential(spark, files.read_json(args[1]))
    return 0
