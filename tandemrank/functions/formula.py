"""Formula columns: reduced form, prototypes, chemistry class and composition, as SQL expressions.

A formula is a run of element symbols with optional amounts, such as ``NaClO3``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element symbols in order of atomic number.
SYMBOLS = [
    "H", "He", "Li", "Be", "B", "C", "N", "O", "F", "Ne", "Na", "Mg", "Al", "Si", "P", "S", "Cl", "Ar", "K", "Ca",
    "Sc", "Ti", "V", "Cr", "Mn", "Fe", "Co", "Ni", "Cu", "Zn", "Ga", "Ge", "As", "Se", "Br", "Kr", "Rb", "Sr", "Y",
    "Zr", "Nb", "Mo", "Tc", "Ru", "Rh", "Pd", "Ag", "Cd", "In", "Sn", "Sb", "Te", "I", "Xe", "Cs", "Ba", "La", "Ce",
    "Pr", "Nd", "Pm", "Sm", "Eu", "Gd", "Tb", "Dy", "Ho", "Er", "Tm", "Yb", "Lu", "Hf", "Ta", "W", "Re", "Os", "Ir",
    "Pt", "Au", "Hg", "Tl", "Pb", "Bi", "Po", "At", "Rn", "Fr", "Ra", "Ac", "Th", "Pa", "U", "Np", "Pu", "Am", "Cm",
    "Bk", "Cf", "Es", "Fm", "Md", "No", "Lr", "Rf", "Db", "Sg", "Bh", "Hs", "Mt", "Ds", "Rg", "Cn", "Nh", "Fl",
    "Mc", "Lv", "Ts", "Og",
]
# Chemistry class of the anion-forming elements.
CLASSES = {
    "O": "oxide", "S": "sulfide", "Se": "selenide", "Te": "telluride", "F": "halide", "Cl": "halide", "Br": "halide",
    "I": "halide", "N": "nitride",
}
# Fixed value: the accepted tokens, an element symbol with an optional amount.
TOKEN = "([A-Z][a-z]?)([0-9]*[.]?[0-9]*)"


def with_counts(df: DataFrame, formula: str) -> DataFrame:
    """Add ``_parts``: array of (element, amount) summed per element, sorted by element; null if unparsable."""
    f = f"`{formula}`"
    df = df.selectExpr("*", f"regexp_extract_all({f}, '{TOKEN}', 1) AS _el", f"regexp_extract_all({f}, '{TOKEN}', 2) AS _am")
    whole = f"size(_el) > 0 AND NOT array_contains(_am, '.') AND array_join(zip_with(_el, _am, (e, a) -> concat(e, a)), '') = {f}"
    tokens = "zip_with(_el, _am, (e, a) -> named_struct('e', e, 'n', IF(a = '', 1D, try_cast(a AS DOUBLE))))"
    # Sorted tokens are merged as they come; nothing is looked up again per element.
    last = "try_element_at(acc, -1)"
    merged = (
        f"aggregate(array_sort({tokens}), CAST(array() AS ARRAY<STRUCT<e: STRING, n: DOUBLE>>), (acc, p) -> "
        f"IF({last}.e = p.e, concat(slice(acc, 1, size(acc) - 1), array(named_struct('e', p.e, 'n', {last}.n + p.n))), "
        "concat(acc, array(p))))"
    )
    return df.selectExpr("*", f"IF({whole}, {merged}, NULL) AS _parts").drop("_el", "_am")


def reduced_formula(df: DataFrame, formula: str, out: str = "reduced_formula") -> DataFrame:
    """Amounts over the smallest one, in element order; an unparsable formula stays as it is."""
    df = with_counts(df, formula).selectExpr("*", "array_min(transform(filter(_parts, p -> p.n > 0), p -> p.n)) AS _min")
    ratio = "p.n / _min"
    text = f"concat(p.e, IF(abs({ratio} - 1) <= 1e-9 * greatest(abs({ratio}), 1), '', CAST(try_cast(bround({ratio}) AS BIGINT) AS STRING)))"
    return df.selectExpr(
        "*", f"IF(_parts IS NULL OR _min IS NULL, nullif(`{formula}`, ''), array_join(transform(_parts, p -> {text}), '')) AS `{out}`"
    ).drop("_parts", "_min")


def prototype(df: DataFrame, formula: str, out: str = "prototype") -> DataFrame:
    """Whole parts of the amounts over their greatest common divisor (Euclid), largest first, with letters for the elements."""
    # Euclid's steps: 92 suffice for two 64-bit numbers.
    divisor = (
        "aggregate(sequence(1, 92), named_struct('a', g, 'b', x), (s, i) -> "
        "IF(s.b = 0, s, named_struct('a', s.b, 'b', s.a % s.b)), s -> s.a)"
    )
    df = with_counts(df, formula).selectExpr("*", "reverse(array_sort(transform(_parts, p -> try_cast(p.n AS BIGINT)))) AS _n")
    df = df.selectExpr(
        "*", f"greatest(1, aggregate(_n, 0L, (g, x) -> {divisor})) AS _g"
    )
    letter = "concat(char(65 + i), IF(x div _g > 1, CAST(x div _g AS STRING), ''))"
    return df.selectExpr("*", f"array_join(transform(_n, (x, i) -> {letter}), '') AS `{out}`").drop("_parts", "_n", "_g")


def element_key(df: DataFrame, formula: str, out: str = "element_key") -> DataFrame:
    return with_counts(df, formula).selectExpr(
        "*", f"array_join(transform(_parts, p -> p.e), '-') AS `{out}`"
    ).drop("_parts")


def chemistry_class(df: DataFrame, formula: str, out: str = "chemistry_class") -> DataFrame:
    """Classes of the anion formers joined by ``_`` in element order; ``other`` without any, ``unknown`` unparsed."""
    arms = " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in CLASSES.items())
    label = f"array_distinct(array_compact(transform(_parts, p -> CASE p.e {arms} END)))"
    return with_counts(df, formula).selectExpr(
        "*", f"CASE WHEN _parts IS NULL THEN 'unknown' WHEN size({label}) = 0 THEN 'other' ELSE array_join({label}, '_') END AS `{out}`"
    ).drop("_parts")


def composition(df: DataFrame, formula: str, slots: int = 94) -> DataFrame:
    """Heavy fraction (atomic number over 20), amounts, elements, largest atomic number and the fraction vector.

    Unknown symbols make all of them null.
    """
    names = "array(" + ", ".join(f"'{s}'" for s in SYMBOLS) + ")"
    z = f"array_position({names}, p.e)"
    df = with_counts(df, formula).selectExpr(
        "*", f"transform(_parts, p -> named_struct('z', CAST({z} AS INT), 'n', p.n)) AS _zn"
    ).selectExpr("*", "IF(exists(_zn, p -> p.z = 0), NULL, _zn) AS _z")
    total = "aggregate(_z, 0D, (s, p) -> s + p.n)"
    return df.selectExpr(
        "*", f"aggregate(_z, 0D, (s, p) -> s + IF(p.z > 20, p.n, 0D)) / {total} AS heavy_fraction",
        f"{total} AS atom_count", "size(_z) AS n_elements", "array_max(transform(_z, p -> p.z)) AS max_z",
        f"IF(_z IS NULL, NULL, transform(sequence(1, {slots}), k -> aggregate(filter(_z, p -> p.z = k), 0D, (s, p) -> s + p.n) / ({total} + 1e-12D))) AS fractions",
    ).drop("_parts", "_zn", "_z")


def with_source_token(df: DataFrame, source: str, sources: list[str], features: str = "fractions") -> DataFrame:
    """Append a one-hot source token to a feature vector."""
    token = F.array(*[F.when(F.col(source) == F.lit(s), 1.0).otherwise(0.0) for s in sources])
    return df.withColumn(features, F.concat(F.col(features), token))
