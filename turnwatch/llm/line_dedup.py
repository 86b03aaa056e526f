"""Line dedup by overlapping windows of three lines (operator 3)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnwatch.llm.rows import fresh

WINDOW = 3
#: A window without a character other than white space is not judged.
INK = r"[^\x20\x09-\x0D]"


def window_hashes(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW) -> DataFrame:
    """``(doc, at, h1, h2)``: two hashes of the ``window`` lines that start at line ``at``."""
    lines = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("doc"), F.split(text_col, "\n").alias("lines"))
    starts = F.sequence(F.lit(1), F.size("lines") - F.lit(window - 1))
    joined = F.transform(starts, lambda i: F.concat_ws("\n", F.slice("lines", i, window)))
    return (lines.filter(F.size("lines") >= window)
            .select("doc", F.posexplode(joined).alias("at", "w")).filter(F.col("w").rlike(INK))
            .select("doc", "at", F.xxhash64(F.lit(1), "w").alias("h1"), F.xxhash64(F.lit(2), "w").alias("h2")))


def later_windows(windows: DataFrame) -> DataFrame:
    """``(doc, at)`` of every window whose lines also start at a smaller ``(doc, at)``. Equal windows
    are summed up before the shuffle; the join back is a plain one, whose large keys Spark splits."""
    first = (windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("n"))
             .filter("n > 1").select("h1", "h2", "first"))
    return windows.join(first, ["h1", "h2"]).filter(F.struct("doc", "at") > F.col("first")).select("doc", "at")


def covered(starts, window: int) -> np.ndarray:
    """The distinct lines that windows starting at ``starts`` cover, in order."""
    at = np.asarray(starts, np.int64)
    return np.unique((at[:, None] + np.arange(window)).ravel())


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with every line removed that a repeated window covers, but for the window's first
    occurrence (smallest id, then line). Windows are judged on the input. Two columns follow:
    ``n_lines`` and ``n_removed``.

    A text with fewer lines than a window stays; so do a null text (no lines) and a text whose id is null.
    Windows of white space only are not judged. Rows that repeat an id and a text are occurrences
    at the same place: none is later, both stay as they are. A document of which no line is left has an empty text."""
    doc, at = fresh(docs, "doc"), fresh(docs, "at")
    gone = (later_windows(window_hashes(docs, id_col, text_col, window))
            .groupBy(F.col("doc").alias(doc)).agg(F.collect_set("at").alias(at)))

    @F.pandas_udf("kept string, n int")
    def cut(texts: pd.Series, starts: pd.Series) -> pd.DataFrame:
        kept, n = [], []
        for text, rows in zip(texts, starts):
            if text is None or rows is None:
                kept.append(None)
                n.append(0)
                continue
            lines, drop = text.split("\n"), covered(rows, window)
            flags = np.ones(len(lines), bool)
            flags[drop] = False
            kept.append("\n".join([x for x, keep in zip(lines, flags) if keep]))
            n.append(len(drop))
        return pd.DataFrame({"kept": kept, "n": n})

    text, out = F.col(text_col), fresh(docs, "out")
    joined = docs.join(gone, docs[id_col] == gone[doc], "left")
    touched = F.col(at).isNotNull()
    joined = joined.withColumn(out, cut(F.when(touched, text), F.col(at)))
    lines = F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).cast("long")
    return joined.select(
        *[F.when(touched, F.col(out)["kept"]).otherwise(text).alias(c) if c == text_col else F.col(c)
          for c in docs.columns],
        lines.alias("n_lines"), F.when(touched, F.col(out)["n"]).otherwise(0).cast("long").alias("n_removed"))
