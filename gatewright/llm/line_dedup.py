"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded as 128-bit hashes of their normalised form, distinct documents are counted
for each hash (with a map-side combine, so a line in every document costs one row a task), and
the positions to drop return to their documents. Only hashes are shuffled until then; the text
moves once, as lines, to meet the positions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewright.llm.common import ints, keyed, public_id, rows, skew_join
from gatewright.session import in_arrow

BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode()) >= least)


def _line_hashes(batches, least: int, distinct: bool):
    """(did, th, pos, h1, h2) of lines; with distinct, each hash once a document."""
    for batch in batches:
        for part, texts in rows(batch):
            did, th, pos, digests = [], [], [], []
            for d, t, text in zip(ints(part, "did"), ints(part, "th"), texts):
                seen = set()
                for i, line in enumerate(text.translate(LOWER).split(b"\n")):
                    key = line.strip(BLANKS)
                    if not _long_enough(key, least):
                        continue
                    h = xxhash.xxh3_128_digest(key)
                    if distinct:
                        if h in seen:
                            continue
                        seen.add(h)
                    did.append(d)
                    th.append(t)
                    pos.append(i)
                    digests.append(h)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(pos, pa.int32()), pa.array(h[:, 0]), pa.array(h[:, 1])],
                ["did", "th", "pos", "h1", "h2"],
            )


def _hashes(docs: DataFrame, least: int, distinct: bool) -> DataFrame:
    return in_arrow(docs, lambda it: _line_hashes(it, least, distinct), "did long, th long, pos int, h1 long, h2 long")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """Return doc_id, n_lines, n_dropped, kept_text for each row of docs (doc_id, text, ...).

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least
    min_chars code points found in at least min_docs documents lose all their lines except in
    the largest doc_id that holds them. A null or empty text is one empty line. Each row is a
    document: repeated rows of a doc_id count one by one, and all rows of the largest doc_id
    keep the line. A null doc_id counts as the smallest. Extra columns are ignored.
    """
    base = keyed(docs)
    common = (
        _hashes(base, min_chars, True)
        .groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("n_docs"), F.max("did").alias("keeper"))
        .where(F.col("n_docs") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    drops = (
        skew_join(_hashes(base, min_chars, False), common, ["h1", "h2"])
        .where(F.col("did") < F.col("keeper"))
        .groupBy("did", "th")
        .agg(F.collect_set("pos").alias("drop"))
    )
    # Texts are split after they have met their positions: as strings they move in fewer bytes.
    met = base.join(drops, ["did", "th"], "left").withColumn("lines", F.split("text", "\n"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))
    return met.select(
        public_id().alias("doc_id"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("drop").isNull(), F.col("text"))
        .otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
        .alias("kept_text"),
    )
