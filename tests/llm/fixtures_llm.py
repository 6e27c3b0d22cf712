"""Small tables with every odd case that the operators define."""

import os

import pytest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")

# Names that operators use inside or for their results.
CLASHING = ("score", "ids", "class", "component_id", "n_shingles", "shard", "spans", "_id", "_text", "content", "leaf")

LONG = "word " * 30_000 + "x" * 50_000 + " end."

ODD = [
    (1, "Alpha beta gamma delta epsilon zeta."),
    (2, None),
    (3, ""),
    (4, " \n\t "),
    (None, "Alpha beta gamma delta epsilon zeta."),
    (5, "alpha BETA gamma delta epsilon zeta."),
    (5, "alpha BETA gamma delta epsilon zeta."),
    (6, "one"),
    (7, LONG),
    (8, "漢字 ünï 😀 don't 12,345 ..."),
    (None, None),
]


def odd_documents(spark):
    rows = [(key, text, "en", "src", None, *(["clash"] * len(CLASHING))) for key, text in ODD]
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {extra}")


def no_documents(spark):
    return odd_documents(spark).limit(0)


def by_id(df, *names):
    return sorted(((tuple(r) for r in df.select(*names).collect())), key=lambda r: tuple((v is not None, v) for v in r))
