"""Solar elemental abundances (Lodders 2020) and element symbols."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Atomic number and log10 abundance on the scale H = 12.
SOLAR_LOG10 = """
1 12.00, 2 10.924, 3 3.27, 4 1.31, 5 2.77, 6 8.47, 7 7.85, 8 8.73, 9 4.61, 10 8.15, 11 6.27, 12 7.52, 13 6.42,
14 7.51, 15 5.43, 16 7.15, 17 5.23, 18 6.50, 19 5.07, 20 6.27, 21 3.04, 22 4.90, 23 3.95, 24 5.63, 25 5.47, 26 7.45,
27 4.86, 28 6.20, 29 4.24, 30 4.61, 31 3.07, 32 3.59, 33 2.29, 34 3.34, 35 2.60, 36 3.22, 37 2.36, 38 2.88, 39 2.15,
40 2.55, 41 1.4, 42 1.92, 44 1.77, 45 1.04, 46 1.65, 47 1.21, 48 1.71, 49 0.76, 50 2.07, 51 1.06, 52 2.18, 53 1.71,
54 2.25, 55 1.08, 56 2.17, 57 1.17, 58 1.58, 59 0.75, 60 1.45, 62 0.94, 63 0.51, 64 1.05, 65 0.31, 66 1.12, 67 0.46,
68 0.92, 69 0.11, 70 0.91, 71 0.09, 72 0.70, 73 -0.16, 74 0.67, 75 0.23, 76 1.33, 77 1.31, 78 1.60, 79 0.80, 80 1.08,
81 0.76, 82 2.03, 83 0.66, 90 0.04, 92 -0.54
"""

# Symbols in order of the atomic number, from 1.
SYMBOLS = """
H He Li Be B C N O F Ne Na Mg Al Si P S Cl Ar K Ca Sc Ti V Cr Mn Fe Co Ni Cu Zn Ga Ge As Se Br Kr Rb Sr Y Zr Nb Mo Tc Ru
Rh Pd Ag Cd In Sn Sb Te I Xe Cs Ba La Ce Pr Nd Pm Sm Eu Gd Tb Dy Ho Er Tm Yb Lu Hf Ta W Re Os Ir Pt Au Hg Tl Pb Bi Po At
Rn Fr Ra Ac Th Pa U
""".split()


def solar_rows() -> list[tuple[int, str, float]]:
    pairs = [entry.split() for entry in SOLAR_LOG10.replace("\n", " ").split(",")]
    return [(int(z), SYMBOLS[int(z) - 1], 10 ** float(a)) for z, a in pairs]


def solar_abundances(spark: SparkSession) -> DataFrame:
    """(atomic_number, element, abundance), one row per element."""
    return spark.createDataFrame(solar_rows(), "atomic_number int, element string, abundance double")
