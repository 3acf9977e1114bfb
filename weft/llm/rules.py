"""Quality rules: Viterbi line labelling by a conditional random field decides retention (operator 2)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weft.llm import lines as ln
from weft.llm import text as tx

#: Documents the field is trained on, at most.
SAMPLE = 3000
#: Least share of a kept document's length that is on content lines.
CONTENT = 0.5
#: Fewest words, and largest percentage of words in repeated three-word windows, of a document that passes the base.
MIN_WORDS, MAX_REPEAT = 50, 50

VERDICT = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, content_share double, n_lines bigint, n_content_lines bigint, labels string"


def train(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, **cols) -> ln.Field:
    """A field for content and boilerplate lines: lines of documents labelled 1 for quality are content, of the others boilerplate."""
    return ln.train(*ln.line_table(ln.labelled_sample(docs, labels, "quality", size, **cols)))


def verdicts(docs: DataFrame, field: ln.Field, text_col: str = "text", out: str = "verdict", content: float = CONTENT) -> DataFrame:
    """The documents with a struct of their base measures, their line labels and the verdict.

    ``labels`` has a letter for each line with a word, in order: C content, B
    boilerplate.  Null, empty and blank texts have no words and no lines, a
    content share of 0, fail the base and aren't kept.  Equal rows get equal
    verdicts; every row of the input is in the output once.
    """
    weights = (field.weights, field.start, field.turn)

    def make():
        own = ln.Field(*weights)

        def work(column: pa.Array) -> pa.Array:
            parts = [label(run, own, content) for run in tx.runs(column)]
            return tx.joined(parts, _EMPTY)

        return work

    return tx.annotate(docs, text_col, make, VERDICT, out)


def label(run: tx.Run, field: ln.Field, content: float) -> pa.StructArray:
    lines = ln.Lines(run)
    good = ln.viterbi(field, lines.features, lines.first)
    row = lines.row
    whole = np.bincount(row, lines.length, run.rows)
    share = np.divide(np.bincount(row, lines.length * good, run.rows), whole, out=np.zeros(run.rows), where=whole > 0)
    failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > MAX_REPEAT * lines.n_words)
    letters = np.where(good > 0, ord("C"), ord("B")).astype(np.uint8)
    marks = pa.StringArray.from_buffers(run.rows, pa.py_buffer(lines.first.astype(np.int32)), pa.py_buffer(letters.tobytes()))
    i64 = lambda x: pa.array(np.asarray(x), type=pa.int64())
    return tx.struct(
        n_words=i64(lines.n_words), word_chars=i64(lines.word_chars), n_symbols=i64(lines.n_symbols), n_dup_lines=i64(lines.n_dup_lines), n_repeat_words=i64(lines.n_repeat_words),
        base_failed=failed, kept=~failed & (share >= content), content_share=share, n_lines=i64(np.diff(lines.first)), n_content_lines=i64(np.bincount(row, good, run.rows).astype(np.int64)), labels=marks,
    )


_EMPTY = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("content_share", pa.float64()), ("n_lines", pa.int64()), ("n_content_lines", pa.int64()), ("labels", pa.string())])
