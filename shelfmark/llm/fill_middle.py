"""Fill-in-the-middle transformation with a learned rank index.

A text is cut at token boundaries (a token is white space and the word after it, or
white space at the end) into prefix, middle and suffix, which are put together in
another order with markers between them.

The cuts are ranks: "after the k-th token".  A piecewise-linear index takes a rank to
its offset.  It is fitted to all boundaries of a text: a segment is the straight line
from its first boundary to its last; a segment that misses some boundary by more than
``ERROR`` code points is halved.  A boundary's residual then fits one byte, and the
predicted offset plus the residual is the exact one.  Fitting is array work over all
texts of a batch at once, as many rounds as the most crooked text needs halvings.

Defined results: a null text counts as empty: 0 tokens, form ``plain``, an empty
output; a null id enters the hash as nothing (``42:``); repeated rows get the same
result each; other columns of the input are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .utf8 import buffer_of
from .words import by_slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: code points by which a segment may miss a boundary: residuals are signed bytes
ERROR = 127


class Boundaries(NamedTuple):
    """Offsets (code points) of all token boundaries of some texts, 0 first."""

    offsets: np.ndarray
    starts: np.ndarray  # the boundaries of text i are offsets[starts[i]:starts[i + 1]]

    @property
    def tokens(self) -> np.ndarray:
        return np.diff(self.starts) - 1


def boundaries(texts: pa.Array) -> Boundaries:
    data, at = buffer_of(texts)
    space = (data == 0x20) | ((data >= 9) & (data <= 13))
    ends = np.zeros(len(data), bool)
    filled = np.flatnonzero(at[1:] > at[:-1])
    ends[at[1:][filled] - 1] = True  # a text's last byte ends its last token
    ends[:-1] |= ~space[:-1] & space[1:]
    after = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before a byte
    place = np.flatnonzero(ends)
    owner = np.searchsorted(at, place, "right") - 1
    starts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(at) - 1) + 1)])
    offsets = np.zeros(starts[-1], np.int64)
    held = np.ones(len(offsets), bool)
    held[starts[:-1]] = False
    offsets[held] = after[place + 1] - after[at[owner]]
    return Boundaries(offsets, starts)


class RankIndex(NamedTuple):
    """Error-bounded line segments through boundaries, and what they miss."""

    first: np.ndarray  # first and last boundary of each segment, by number
    last: np.ndarray
    low: np.ndarray  # their offsets
    high: np.ndarray
    residuals: np.ndarray  # int8, one for each boundary

    def offsets(self, numbers: np.ndarray) -> np.ndarray:
        """Exact offsets of boundaries given by number."""
        segment = np.searchsorted(self.first, numbers, "right") - 1
        return self._predicted(segment, numbers) + self.residuals[numbers]

    def _predicted(self, segment: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        return _line(self.first[segment], self.last[segment], self.low[segment], self.high[segment], numbers)


def _line(first, last, low, high, at):
    return low + (at - first) * (high - low) // np.maximum(last - first, 1)


def fit(found: Boundaries, error: int = ERROR) -> RankIndex:
    offsets = found.offsets
    residuals = np.zeros(len(offsets), np.int8)
    first, last = found.starts[:-1], found.starts[1:] - 1
    done: list[np.ndarray] = []
    while len(first):
        counts = last - first + 1
        ahead = np.cumsum(counts) - counts
        at = np.arange(counts.sum()) + np.repeat(first - ahead, counts)
        spread = [np.repeat(x, counts) for x in (first, last, offsets[first], offsets[last])]
        missed = offsets[at] - _line(*spread, at)
        good = np.maximum.reduceat(np.abs(missed), ahead) <= error
        held = np.repeat(good, counts)
        residuals[at[held]] = missed[held]
        done.append(np.stack([first[good], last[good]]))
        first, last = first[~good], last[~good]
        half = (first + last) // 2
        first, last = np.stack([first, half + 1], 1).ravel(), np.stack([half, last], 1).ravel()
    pairs = np.concatenate([np.zeros((2, 0), np.int64), *done], axis=1)
    pairs = pairs[:, np.argsort(pairs[0], kind="stable")]
    return RankIndex(pairs[0], pairs[1], offsets[pairs[0]], offsets[pairs[1]], residuals)


def rank_index(docs: DataFrame, error: int = ERROR) -> DataFrame:
    """The index of each text as a table: (doc_id, n, ranks, low, high, residuals).

    Segment i runs from rank ranks[i] to the rank before ranks[i + 1] (the last one to
    n), from offset low[i] to high[i]; residuals holds a signed byte for each rank."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = boundaries(batch.column("text"))
        index = fit(found, error)
        cuts = np.searchsorted(index.first, found.starts)
        own = np.repeat(found.starts[:-1], np.diff(cuts))

        def lists(values):
            return pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(values))

        raw = index.residuals.tobytes()
        residuals = [raw[a:b] for a, b in zip(found.starts[:-1].tolist(), found.starts[1:].tolist())]
        columns = [batch.column("doc_id"), pa.array(found.tokens), lists(index.first - own), lists(index.low), lists(index.high), pa.array(residuals, pa.binary())]
        return pa.record_batch(columns, ["doc_id", "n", "ranks", "low", "high", "residuals"])

    schema = "doc_id long, n long, ranks array<long>, low array<long>, high array<long>, residuals binary"
    return docs.select("doc_id", "text").mapInArrow(by_slices(work), schema)


# -- the transformation -------------------------------------------------------


def _draw(seed: int, group: int) -> Column:
    """Number ``group`` (from 1) of the eight-digit groups of an id's hash."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(name, 256), 8 * group - 7, 8), 16, 10).cast("long")


def _put_together(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = pc.fill_null(batch.column("text"), "")
    found = boundaries(texts)
    index = fit(found)
    form = batch.column("form")
    n = found.tokens
    one, two = (batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2"))
    changed = np.flatnonzero(pc.not_equal(form, "plain").to_numpy(zero_copy_only=False))
    begin = found.starts[:-1][changed]
    before = index.offsets(begin + np.minimum(one, two)[changed])
    after = index.offsets(begin + np.maximum(one, two)[changed])
    output = texts.to_pylist()
    forms = form.to_pylist()
    prefix, middle = [None] * len(output), [None] * len(output)
    for i, a, b in zip(changed.tolist(), before.tolist(), after.tolist()):
        text = output[i]
        prefix[i], middle[i] = a, b - a
        if forms[i] == "psm":
            output[i] = f"{PREFIX}{text[:a]}{SUFFIX}{text[b:]}{MIDDLE}{text[a:b]}"
        else:
            output[i] = f"{SUFFIX}{text[b:]}{PREFIX}{text[:a]}{MIDDLE}{text[a:b]}"
    columns = [batch.column("doc_id"), pa.array(n), form, pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(output, pa.string())]
    return pa.record_batch(columns, ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def fill_in_middle(docs: DataFrame, rate: int = 50, suffix_first: int = 80, seed: int = 42) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of ``docs``.

    Of 100 texts about ``rate`` change, ``suffix_first`` percent of those into the form
    ``spm`` (suffix, prefix, middle), the others into ``psm``.  The id and ``seed`` decide
    alone, so reruns agree."""
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(text, F.lit(mark))
    plain = (text == "") | marked | (F.col("h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < suffix_first, "spm").otherwise("psm")
    drawn = docs.select("doc_id", "text", *[_draw(seed, k).alias(f"h{k}") for k in range(1, 5)])
    rows = drawn.select("doc_id", "text", "h1", "h2", form.alias("form"))
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(by_slices(_put_together), schema)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text an output was made of.  It holds no marker, so the first of each is ours."""
    out = F.col(output)
    mid = F.instr(out, MIDDLE)
    middle = F.substr(out, mid + len(MIDDLE))

    def pieces(mark: str) -> tuple[Column, Column]:
        cut = F.instr(out, mark)
        return F.substr(out, F.lit(4), cut - 4), F.substr(out, cut + 3, mid - cut - 3)

    prefix, suffix = pieces(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix = pieces(PREFIX)
    spm = F.concat(prefix, middle, suffix)
    return F.when(F.col(form) == "psm", psm).when(F.col(form) == "spm", spm).otherwise(out)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digests = {"output_sha256": F.sha2("output", 256), "restored_sha256": F.sha2(restored(), 256)}
    return made.withColumns(digests).drop("output")


REFERENCE = r"""
WITH hashed AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), cut AS (
  SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS tokens,
         CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
         CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM hashed
), placed AS (
  SELECT *, CAST(len(tokens) AS BIGINT) AS n,
         least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a,
         greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
              WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM cut
), pieces AS (
  SELECT *, array_to_string(tokens[1:a], '') AS prefix, array_to_string(tokens[a + 1:b], '') AS middle,
         array_to_string(tokens[b + 1:], '') AS suffix
  FROM placed
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t
                        WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM pieces
"""
