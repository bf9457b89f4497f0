"""Contig names, their numbers and the compact order of panel contigs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INVALID, DECOY, VIRUS, MITO, PHIX = 1003, 999, 1000, 1001, 1002
#: Largest number of a contig whose reads are called, and of one that may be a partner.
LAST_CALLED, LAST_PARTNER = 1000, 1001


def contig_index(name: Column) -> Column:
    """Number of a contig name; names outside the known forms are INVALID. Patterns are only tried where a name is no plain number."""
    return F.transform(F.array(name), _contig_index)[0]


def _contig_index(name: Column) -> Column:
    digits = F.regexp_extract(name, r"^(\d+)", 1)
    scaffold = F.regexp_extract(name, r"^GL0*(\d+)", 1)
    return (
        F.when(F.substring(name, 1, 1).between("0", "9"), F.coalesce(F.when(F.length(name) < 4, name.try_cast("int")), digits.try_cast("int")))
        .when(name.startswith("h"), DECOY).when(name.startswith("X"), 40).when(name.startswith("Y"), 41)
        .when(name.startswith("G"), F.coalesce(scaffold.try_cast("int"), F.lit(INVALID)))
        .when(name.startswith("MT"), MITO).when(name.startswith("N"), VIRUS).when(name.startswith("p"), PHIX)
        .otherwise(INVALID)
    )


def panel_index(index: Column) -> Column:
    """Place in the panel's order: 1-22, X, Y, scaffolds 191-249, decoy, virus; -2 for others. The number is found once, not at each comparison."""
    return F.transform(F.array(index), _panel_index)[0]


def _panel_index(index: Column) -> Column:
    return F.when(index.between(1, 22), index - 1).when(index == 40, 22).when(index == 41, 23).when(index.between(191, 249), index - 167).when(index == DECOY, 83).when(index == VIRUS, 84).otherwise(-2)


def is_primary(panel: Column) -> Column:
    """1-22 and X, and whatever the panel lacks."""
    return panel < 23


def contig_name(index: Column) -> Column:
    """Name of a contig's number, null for numbers without contig (fixed names)."""
    return (
        F.when(index.between(1, 22), index.cast("string")).when(index == 40, "X").when(index == 41, "Y").when(index.between(191, 249), F.concat(F.lit("GL000"), index.cast("string"), F.lit(".1")))
        .when(index == DECOY, "hs37d5").when(index == VIRUS, "NC_007605").when(index == MITO, "MT").when(index == PHIX, "phiX174")
    )
