"""Standard channel layouts of the CAF container and its channel labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Core Audio layout tags by number, with the channel order each names.
# Only orders that decoded labels can spell; of equal orders the first counts.
STANDARD = [
    (100, "C"),
    (101, "L R"),
    (108, "L R Ls Rs"),
    (109, "L R Ls Rs C"),
    (110, "L R Ls Rs C Cb"),
    (111, "L R Ls Rs C Cb Lw Rw"),
    (113, "L R C"),
    (114, "C L R"),
    (115, "L R C Cb"),
    (116, "C L R Cb"),
    (117, "L R C Ls Rs"),
    (119, "L C R Ls Rs"),
    (120, "C L R Ls Rs"),
    (121, "L R C LFE Ls Rs"),
    (122, "L R Ls Rs C LFE"),
    (123, "L C R Ls Rs LFE"),
    (124, "C L R Ls Rs LFE"),
    (125, "L R C LFE Ls Rs Cb"),
    (126, "L R C LFE Ls Rs Lsc Rsc"),
    (127, "C Lsc Rsc L R Ls Rs LFE"),
    (128, "L R C LFE Ls Rs Lb Rb"),
    (129, "L R Ls Rs C LFE Lsc Rsc"),
    (131, "L R Cb"),
    (133, "L R LFE"),
    (134, "L R LFE Cb"),
    (135, "L R LFE Ls Rs"),
    (136, "L R C LFE"),
    (137, "L R C LFE Cb"),
    (138, "L R Ls Rs LFE"),
    (140, "L R Ls Rs C Lb Rb"),
    (141, "C L R Ls Rs Cb"),
    (142, "C L R Ls Rs Cb LFE"),
    (143, "C L R Ls Rs Lb Rb"),
    (144, "C L R Ls Rs Lb Rb Cb"),
]

# CAF label codes of the decoded channel labels.
LABEL_CODES = {
    "L": 1, "R": 2, "C": 3, "LFE": 4, "Ls": 5, "Rs": 6, "Lsc": 7, "Rsc": 8, "Cb": 9, "Lsd": 10, "Rsd": 11, "Tc": 12,
    "Tfl": 13, "Tfc": 14, "Tfr": 15, "Tbl": 16, "Tbr": 18, "Lb": 33, "Rb": 34, "Lw": 35, "Rw": 36, "LFE2": 37, "Tsl": 49, "Tsr": 51,
}


def orders() -> list[tuple[str, int]]:
    """(order, tag): a tag is its number above its channel count."""
    return [(order, number << 16 | len(order.split())) for number, order in STANDARD]


def standard(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(orders(), "order string, tag int")


def tag_for(labels: list[str]) -> int | None:
    return dict(orders()).get(" ".join(labels))
