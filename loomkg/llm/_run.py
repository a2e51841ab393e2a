"""Arrow plumbing shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomkg.common import ship
from loomkg.llm import _bytes as B

PIECE = 1 << 23


def arrow_map(df: DataFrame, f: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, text: int | None = None) -> DataFrame:
    """mapInArrow of a function of one batch; text: the column by whose bytes large batches are cut."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in [batch] if text is None else B.pieces(batch, text, PIECE):
                out = f(piece)
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def bounded(labels: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows, chosen by the hash of the key: small enough to broadcast."""
    return labels.where(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(most)
