"""Chemical formulas: parsing, canonical spelling and validation; meant for distinct formulas."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

#: The elements in order of atomic number, and electronegativities by which formulas are ordered.
ELEMENTS = (
    "H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru Rh Pd Ag Cd In Sn Sb Te I Xe "
    "Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At Rn Fr Ra Ac Th Pa U Np Pu Am Cm Bk Cf Es Fm Md No Lr"
).split()
ELECTRONEGATIVITY = dict(
    H=2.20, Li=0.98, Be=1.57, B=2.04, C=2.55, N=3.04, O=3.44, F=3.98, Na=0.93, Mg=1.31, Al=1.61, Si=1.90, P=2.19, S=2.58, Cl=3.16, K=0.82, Ca=1.00, Sc=1.36, Ti=1.54, V=1.63, Cr=1.66, Mn=1.55,
    Fe=1.83, Co=1.88, Ni=1.91, Cu=1.90, Zn=1.65, Ga=1.81, Ge=2.01, As=2.18, Se=2.55, Br=2.96, Rb=0.82, Sr=0.95, Y=1.22, Zr=1.33, Nb=1.6, Mo=2.16, Ru=2.2, Rh=2.28, Pd=2.20, Ag=1.93, Cd=1.69,
    In=1.78, Sn=1.96, Sb=2.05, Te=2.1, I=2.66, Cs=0.79, Ba=0.89, La=1.1, Ce=1.12, Hf=1.3, Ta=1.5, W=2.36, Re=1.9, Os=2.2, Ir=2.2, Pt=2.28, Au=2.54, Hg=2.00, Tl=1.62, Pb=2.33, Bi=2.02, U=1.38,
)
_PIECE = re.compile(r"([A-Z][a-z]?)(\d+(?:\.\d+)?)?|([(\[])|([)\]])(\d+(?:\.\d+)?)?")


def composition(text: str) -> dict[str, float]:
    """Counts of elements; brackets may nest. ValueError if the text is no formula."""
    stack: list[dict[str, float]] = [{}]
    text, at = re.sub(r"\s+", "", text), 0
    if not text:
        raise ValueError("empty formula")
    while at < len(text):
        m = _PIECE.match(text, at)
        if not m:
            raise ValueError(f"{text[at:]} is no part of a formula")
        element, count, opened, closed, times = m.groups()
        if element:
            if element not in ELEMENTS:
                raise ValueError(f"{element} is no element")
            stack[-1][element] = stack[-1].get(element, 0) + float(count or 1)
        elif opened:
            stack.append({})
        else:
            if len(stack) == 1:
                raise ValueError("a bracket closes that was not opened")
            for name, n in stack.pop().items():
                stack[-1][name] = stack[-1].get(name, 0) + n * float(times or 1)
        at = m.end()
    if len(stack) > 1:
        raise ValueError("a bracket stays open")
    return stack[0]


def canonical(text: str) -> str:
    """Elements by electronegativity, with counts, apart by spaces: "H2 O1"."""
    found = composition(text)
    order = sorted(found, key=lambda e: (ELECTRONEGATIVITY.get(e, 9.0), ELEMENTS.index(e)))
    return " ".join(f"{e}{found[e]:.8g}" for e in order if found[e])


RESULT = StructType([StructField(n, IntegerType() if n == "mp_hits" else StringType()) for n in ("input", "canonical", "mp_hits", "status", "error")])


@pandas_udf(RESULT)
def validate_udf(formulas: pd.Series) -> pd.DataFrame:
    """Whether each text without its white space is a formula in canonical spelling (ok), in another (corrected), or none (invalid).

    Canonical spelling has spaces between elements, so only formulas of one element can be ok.
    """
    rows = []
    for text in formulas:
        try:
            made = canonical(text or "")
            rows.append((text, made, -1, "ok" if made == re.sub(r"\s+", "", text) else "corrected", None))
        except ValueError as error:
            rows.append((text, None, -1, "invalid", f"parse-error: {error}"))
    return pd.DataFrame(rows, columns=["input", "canonical", "mp_hits", "status", "error"])


def checked(rows: DataFrame, hits: DataFrame | None = None, column: str = "formula") -> DataFrame:
    """``rows`` with formula_validation; with ``hits`` (formula, hits), formulas that are spelt well but unknown are invalid."""
    distinct = rows.select(F.col(column).alias("formula_")).where("formula_ is not null").distinct()
    made = distinct.withColumn("v", validate_udf("formula_"))
    if hits is not None:
        made = made.join(hits.select(F.col("formula").alias("known"), F.col("hits").cast("int").alias("n")), F.col("v.canonical") == F.col("known"), "left")
        count = F.when(F.col("v.canonical").isNull(), -1).otherwise(F.coalesce("n", F.lit(0)))
        status = F.when((count == 0) & (F.col("v.status") == "ok"), "invalid").otherwise(F.col("v.status"))
        made = made.select("formula_", F.struct("v.input", "v.canonical", count.alias("mp_hits"), status.alias("status"), "v.error").alias("v"))
    return rows.join(made.withColumnRenamed("v", "formula_validation"), F.col(column) == F.col("formula_"), "left").drop("formula_")
