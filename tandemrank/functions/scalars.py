"""Scalar preparers as SQL expressions: code ranges, provenance level, strata labels, relations, array decoding."""

from __future__ import annotations

# Last code of each class.
CODE_CLASSES = [
    (2, "triclinic"), (15, "monoclinic"), (74, "orthorhombic"), (142, "tetragonal"), (167, "trigonal"),
    (194, "hexagonal"), (230, "cubic"),
]


def code_class(code: str) -> str:
    """Class of an integer code 1..230; anything else is ``unknown``."""
    arms = " ".join(f"WHEN {code} <= {last} THEN '{name}'" for last, name in CODE_CLASSES)
    return f"CASE WHEN {code} IS NULL OR {code} < 1 THEN 'unknown' {arms} ELSE 'unknown' END"


def provenance_level(reduced: str, full: str, manifest: list[str]) -> str:
    """``unresolved`` without both tensor forms, ``L1`` with any manifest field, else ``L2``."""
    known = " OR ".join(f"coalesce(CAST({m} AS STRING), '') != ''" for m in manifest)
    return f"CASE WHEN {reduced} IS NULL OR {full} IS NULL THEN 'unresolved' WHEN {known} THEN 'L1' ELSE 'L2' END"


def stratum_label(left: str, right: str) -> str:
    """The common label, or ``cross_source_mismatch``."""
    return f"IF({left} = {right}, {left}, 'cross_source_mismatch')"


def relation(left: str, right: str) -> str:
    """``identical``, ``related_setting`` when one label contains the other, ``different``, ``unknown``."""
    return (
        f"CASE WHEN {left} IS NULL OR {right} IS NULL THEN 'unknown' WHEN {left} = {right} THEN 'identical' "
        f"WHEN contains({left}, {right}) OR contains({right}, {left}) THEN 'related_setting' ELSE 'different' END"
    )


def lattice_distance(left: list[str], right: list[str], left_volume: str, right_volume: str) -> str:
    """Largest relative length difference after scaling the right lengths to the left volume."""
    scale = f"pow({left_volume} / ({right_volume} + 1e-12D), 1D / 3D)"
    terms = ", ".join(f"abs({a} - {b} * {scale}) / (abs({a}) + 1e-6D)" for a, b in zip(left, right))
    return f"greatest({terms})"


def lattice_strain(left: list[str], right: list[str]) -> str:
    """Largest relative length difference; a zero length leaves its ratio out."""
    return "greatest(" + ", ".join(f"abs({a} / nullif({b}, 0) - 1)" for a, b in zip(left, right)) + ")"


def decode_matrix(text: str, rows: int, cols: int) -> str:
    """Flat array from an array-literal string; null if it is not ``rows`` by ``cols`` numbers."""
    m = f"from_json({text}, 'array<array<double>>')"
    flat = f"flatten({m})"
    ok = f"size({m}) = {rows} AND forall({m}, r -> size(r) = {cols}) AND forall({flat}, x -> x IS NOT NULL)"
    return f"IF({ok}, {flat}, NULL)"


def reproduction_status(reported: str, computed: str, tol: float = 1e-2, window: float = 2e-3) -> str:
    """``verified`` within a relative tolerance, or where both are near zero; rows without a reported value are ``not_reported``."""
    rel = f"abs({reported} - {computed}) / greatest(abs({reported}), 1e-12D)"
    return (
        f"CASE WHEN {reported} IS NULL THEN 'not_reported' WHEN {computed} IS NULL THEN 'tensor_not_verified' WHEN {rel} < {tol}D OR "
        f"(abs({reported}) < {window}D AND abs({computed}) < {window}D) THEN 'verified' ELSE 'mismatch' END"
    )
