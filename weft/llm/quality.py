"""Quality classifier: line marginals of a conditional random field, weighted by length (operator 9)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import lines as ln
from weft.llm import text as tx

#: Documents the field is trained on, at most.
SAMPLE = 3000
#: Least score of a document that is predicted to be good.
THRESHOLD = 0.3

SCORE = "score double, predicted int, n_lines bigint, worst_line double"
_EMPTY = pa.struct([("score", pa.float64()), ("predicted", pa.int32()), ("n_lines", pa.int64()), ("worst_line", pa.float64())])


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, **cols) -> ln.Field:
    """A field for good and bad lines: each line of a training document has the document's quality label."""
    return ln.train(*ln.line_table(ln.labelled_sample(docs, labels, "quality", size, **cols)))


def scores(docs: DataFrame, field: ln.Field, text_col: str = "text", out: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with a struct of their quality: the mean of the lines' marginals of being good, weighted by line length.

    ``worst_line`` is the least marginal of a line (null without lines).  Null,
    empty and blank texts have no lines; their score is 0.  Equal rows get
    equal scores; every row of the input is in the output once.
    """
    weights = (field.weights, field.start, field.turn)

    def make():
        own = ln.Field(*weights)
        return lambda column: tx.joined([judge(run, own, threshold) for run in tx.runs(column)], _EMPTY)

    return tx.annotate(docs, text_col, make, SCORE, out)


def judge(run: tx.Run, field: ln.Field, threshold: float) -> pa.StructArray:
    lines = ln.Lines(run)
    good, _ = ln.marginals(field, lines.features, lines.first)
    whole = np.bincount(lines.row, lines.length, run.rows)
    score = np.divide(np.bincount(lines.row, lines.length * good, run.rows), whole, out=np.zeros(run.rows), where=whole > 0)
    score = np.clip(score, 0, 1)
    worst = np.full(run.rows, np.inf)
    np.minimum.at(worst, lines.row, good)
    return tx.struct(
        score=score, predicted=(score >= threshold).astype(np.int32), n_lines=pa.array(np.diff(lines.first), type=pa.int64()),
        worst_line=pa.array(np.where(np.isinf(worst), 0, worst), mask=np.isinf(worst)),
    )
