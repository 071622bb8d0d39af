"""Spectral indices as column expressions, and formulas of the user's own.

Sources: Rouse 1974 (NDVI), Huete 2002 (EVI), Camps-Valls 2021 (kNDVI), Crist 1985 (tasselled cap on reflectance).
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL where the sum is 0 or an input is negative."""
    return F.when((a >= 0) & (b >= 0), F.try_divide(a - b, a + b))


def evi(gain: float = 2.5, soil: float = 1.0, c1: float = 6.0, c2: float = 7.5) -> Column:
    n, r, b = F.col("NIR"), F.col("RED"), F.col("BLU")
    return gain * F.try_divide(n - r, n + c1 * r - c2 * b + soil)


def fvc(soil: float = 0.15, vegetation: float = 0.9) -> Column:
    """Fractional vegetation cover by squared, scaled NDVI, from 0 to 1."""
    x = (_nd("NIR", "RED") - soil) / (vegetation - soil)
    return F.least(F.greatest(x * x, F.lit(0.0)), F.lit(1.0))


def _nd(a: str, b: str) -> Column:
    return normalized_difference(F.col(a), F.col(b))


def _weighted(**weights: float) -> Column:
    terms = [F.lit(w) * F.col(b) for b, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


#: Feature name to expression; MNDWI and NDBI also go by the shorter names MDWI and NDB.
INDICES: dict[str, Callable[[], Column]] = {
    "NDVI": lambda: _nd("NIR", "RED"),
    "NDMI": lambda: _nd("NIR", "SW1"),
    "NDWI": lambda: _nd("GRN", "NIR"),
    "MNDWI": lambda: _nd("GRN", "SW1"),
    "NDBI": lambda: _nd("SW1", "NIR"),
    "NBR": lambda: _nd("NIR", "SW2"),
    "KNDVI": lambda: F.tanh(_nd("NIR", "RED") * _nd("NIR", "RED")),
    "EVI": evi,
    "FVC": fvc,
    "RNB": lambda: F.try_divide(F.col("NIR"), F.col("BLU")),
    "SWR": lambda: F.try_divide(F.col("SW2"), F.col("SW1")),
    "TCG": lambda: _weighted(BLU=-0.1603, GRN=-0.2819, RED=-0.4934, NIR=0.7940, SW1=-0.0002, SW2=-0.1446),
    "TCB": lambda: _weighted(BLU=0.2043, GRN=0.4158, RED=0.5524, NIR=0.5741, SW1=0.3124, SW2=0.2303),
    "TCW": lambda: _weighted(BLU=0.0315, GRN=0.2021, RED=0.3102, NIR=0.1594, SW1=-0.6806, SW2=-0.6109),
}
INDICES["MDWI"], INDICES["NDB"] = INDICES["MNDWI"], INDICES["NDBI"]


def formula(text: str, variables: dict[str, str]) -> Column:
    """An arithmetic formula over variables that stand for bands; a division by zero is NULL, ** is a power."""
    if not re.fullmatch(r"[\w\s+\-*/().,]*", text):
        raise ValueError(f"formula has characters that aren't arithmetic: {text}")
    names = set(re.findall(r"[A-Za-z_]\w*", text))
    env = {v: F.col(b) for v, b in variables.items()}
    if unknown := names - set(env) - set(_FUNCTIONS):
        raise ValueError(f"formula uses unknown variables: {sorted(unknown)}")
    return _evaluate(text, env)


_FUNCTIONS: dict[str, Callable[..., Column]] = {"sqrt": F.sqrt, "exp": F.exp, "log": F.ln, "abs": F.abs, "min": F.least, "max": F.greatest, "tanh": F.tanh, "sin": F.sin, "cos": F.cos}


def _evaluate(text: str, env: dict[str, Column]) -> Column:
    import ast

    binary = {ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Div: F.try_divide, ast.Pow: F.pow}

    def walk(node: ast.AST) -> Column:
        if isinstance(node, ast.BinOp) and type(node.op) in binary:
            return binary[type(node.op)](walk(node.left), walk(node.right))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, ast.USub):
            return -walk(node.operand)
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)):
            return F.lit(float(node.value))
        if isinstance(node, ast.Name):
            return env[node.id]
        if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
            return _FUNCTIONS[node.func.id](*map(walk, node.args))
        raise ValueError(f"formula can't be read: {text}")

    return walk(ast.parse(text.strip(), mode="eval").body)


def add_features(df: DataFrame, features: list[str], formulas: dict[str, dict] | None = None) -> DataFrame:
    """Adds the features that aren't columns yet, in their order, so that a formula may use one before it."""
    formulas = formulas or {}
    for name in features:
        if name in formulas:
            df = df.withColumn(name, formula(formulas[name]["formula"], formulas[name]["variable_map"]))
        elif name not in df.columns:
            if name not in INDICES:
                raise ValueError(f"unknown feature {name}")
            df = df.withColumn(name, INDICES[name]())
    return df
