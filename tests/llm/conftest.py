from __future__ import annotations

import pytest

from panelspark.llm.ship import ship

SCHEMA = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, block STRING, node STRING, kind INT, label STRING"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text) or (doc_id, text, lang, source), with extra columns whose names operators use too."""
    ship(spark)

    def build(rows, partitions: int = 3):
        full = [(r[0], r[1], *(r[2:4] if len(r) > 2 else ("en", "s")), None, "x", None, 7, "y") for r in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build
