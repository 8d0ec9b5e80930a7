"""Import of GAP potentials in XML with side files of sparse points."""

from __future__ import annotations

import math
import os
import xml.etree.ElementTree as ET

from atomloom.functions.elements import SYMBOL
from atomloom.operators.potentials import read_potential

_KINDS = (("eam_density", "eam"), ("distance_2b", "2b"), ("angle_3b", "3b"))


def _settings(text: str) -> dict[str, str]:
    """key=value words of a descriptor line."""
    return dict(w.split("=", 1) for w in text.split() if "=" in w)


def _kind(text: str) -> str:
    for word, kind in _KINDS:
        if word in text:
            return kind
    raise ValueError(f"unknown descriptor: {text}")


def _side_file(node: ET.Element, folder: str, n: int, dim: int) -> list[list[float]]:
    with open(os.path.join(folder, node.get("sparseX_filename"))) as f:
        v = [float(x) for x in f.read().split()]
    if len(v) < n * dim:
        raise ValueError(f"{node.get('sparseX_filename')} has fewer than {n} points")
    return [v[k * dim : (k + 1) * dim] for k in range(n)]


def _number(s: dict[str, str], *names: str) -> str:
    for n in names:
        if n in s:
            return SYMBOL[int(s[n])]
    raise ValueError(f"no {names[0]} in {s}")


def convert_pairpot(node: ET.Element) -> dict:
    glue = node.find("Glue_params")
    if glue is None:
        raise ValueError("only Glue pair potentials can be read")
    species = {t.get("type"): SYMBOL[int(t.get("atomic_num"))] for t in glue.findall("per_type_data")}
    data = {}
    for p in glue.findall("per_pair_data"):
        points = p.find("potential_pair").findall("point")
        pair = sorted((species[p.get("type1")], species[p.get("type2")]))
        data[",".join(pair)] = {"r": [float(x.get("r")) for x in points], "E": [float(x.get("E")) for x in points]}
    return {"type": "spline_pairpot", "pair_data": data}


def convert_isolated(node: ET.Element) -> dict:
    e0 = {SYMBOL[int(x.get("Z"))]: float(x.get("value")) for x in node.findall("e0") if float(x.get("value")) != 0.0}
    return {"type": "isolated_atom", "energies": e0, "error_on_unknown": False}


def _density(s: dict[str, str], prefactor: float) -> dict:
    kind, rc = s.get("pair_function"), float(s["cutoff"])
    r_min = float(s["rmin"]) if "rmin" in s else rc - float(s["cutoff_transition_width"]) if "cutoff_transition_width" in s else None
    if kind in ("FSgen", "FSGen"):
        if "order" not in s:
            raise ValueError("FSgen needs order")
        return {"type": "fsgen", "cutoff": rc, "degree": float(s["order"]), "prefactor": prefactor}
    if kind in ("polycutoff", "coscutoff"):
        if r_min is None:
            raise ValueError(f"{kind} needs rmin")
        return {"type": kind, "cutoff": rc, "r_min": r_min, "prefactor": prefactor}
    raise ValueError(f"unknown pair_function {kind!r}")


def _prefactor(mode: str, receiver: int, giver: int) -> float | None:
    if mode == "FSsym":
        return math.sqrt(receiver * giver) / 40.0
    if mode == "FSgen":
        return receiver**0.1 * math.sqrt(giver) / 10.0
    if mode == "EAM":
        return math.sqrt(giver) / 10.0
    return None


def convert_descriptors(node: ET.Element, folder: str) -> dict:
    """Sparse nodes with equal hyper-parameters become one descriptor."""
    same: dict[tuple, list[tuple[dict, ET.Element]]] = {}
    for n in node.findall("gpCoordinates"):
        text = (n.findtext("descriptor") or "").strip()
        s = _settings(text)
        if s.get("covariance_type") != "ard_se":
            raise ValueError(f"covariance_type must be ard_se: {text}")
        names = ("delta", "theta_uniform", "cutoff", "rmin", "cutoff_transition_width", "pair_function", "order", "mode")
        same.setdefault((_kind(text), *(s.get(k, "") for k in names)), []).append((s, n))
    out = {}
    for number, key in enumerate(sorted(same)):
        kind, s = key[0], same[key][0][0]
        rc = float(s["cutoff"])
        r_min = float(s["rmin"]) if "rmin" in s else rc - float(s.get("cutoff_transition_width", 0.5))
        d: dict = {"type": kind, "kernel": {"type": "squared_exp", "length_scale": float(s["theta_uniform"]), "energy_scale": float(s["delta"])}}
        data: dict = {}
        for own, n in same[key]:
            alpha = [float(x.get("alpha")) for x in n.findall("sparseX")]
            pts = _side_file(n, folder, len(alpha), 3 if kind == "3b" else 1)
            if kind == "2b":
                name = ",".join(sorted((_number(own, "Z1"), _number(own, "Z2"))))
            elif kind == "3b":
                name = ",".join((_number(own, "Z", "Z_center"), *sorted((_number(own, "Z1"), _number(own, "Z2")))))
            else:
                name = _number(own, "Z")
            data[name] = {"sparse_points": [dict(zip("xyz", p)) if kind == "3b" else p[0] for p in pts], "coefficients": alpha}
        d["sparse_data"] = data
        if kind == "eam":
            fs = [_density(s, 1.0)]
            numbers = [int(own["Z"]) for own, _ in same[key]]
            for a in numbers:
                for b in numbers:
                    if (k := _prefactor(s.get("mode", "blind"), a, b)) is not None:
                        fs.append(_density(s, k) | {"species_ordered": [SYMBOL[b], SYMBOL[a]]})
            d["pair_functions"] = fs
        else:
            d["cutoff"] = {"type": "coscutoff", "cutoff": rc, "r_min": r_min}
        out[str(number)] = d
    return {"type": "gap", "descriptors": out}


def convert(path: str) -> dict:
    """The JSON form of an XML potential."""
    root, folder = ET.parse(path).getroot(), os.path.dirname(os.path.abspath(path))
    pair, gap = root.find("pairpot"), root.find("GAP_params")
    if pair is None and gap is None:
        raise ValueError("neither pairpot nor GAP_params")
    parts = {}
    if gap is not None:
        inner = {}
        if gap.find("GAP_data") is not None:
            inner["isolated_atom"] = convert_isolated(gap.find("GAP_data"))
        if gap.find("gpSparse") is not None:
            inner["GAP"] = convert_descriptors(gap.find("gpSparse"), folder)
        parts["xml_gap"] = {"type": "composite", "potentials": inner}
    if pair is not None:
        parts["xml_pairpot"] = convert_pairpot(pair)
    return next(iter(parts.values())) if len(parts) == 1 else {"type": "composite", "potentials": parts}


def read_gap_xml(path: str):
    return read_potential(convert(path))
