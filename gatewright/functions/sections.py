"""Sections of an annual report, as row-wise expressions.

A text is split once into the blocks that begin with an item heading; of each block its length, its
label and the length of its heading are kept. A section is the longest span between an end and the
nearest start before it, found by one fold over the blocks, so the time grows with the text and its
headings, whatever their number. No text is shuffled and nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SECTION_CHARS = 1_000
#: Section -> label of its heading, and labels of what can follow; the first one found anywhere ends it.
BOUNDS = {"item_1a": ("1A", ("1B", "1C", "2")), "item_7": ("7", ("7A", "8"))}
DEFAULT_SECTIONS = ("item_1a", "item_7")

#: Case-insensitive; ^ only after a line feed.
LINE = r"(?imd)^(?=[ \t]*item[ \t\x{a0}]*(?:1A|1B|1C|2|7|8))"
#: What Python's strip() takes off.
EDGES = r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$"


def _heading(label: str) -> str:
    """A heading at the start of a block. It has no right boundary: label 7 also begins 7A."""
    return rf"^(?i:[ \t]*item[ \t\x{{a0}}]*{label})[ \t]*[.:\-–—]?[ \t]*"


LABELS = ("1A", "1B", "1C", "2", "7A", "7", "8")
#: The label of a block; of two that fit, the longer one.
LABEL = rf"^(?i:[ \t]*item[ \t\x{{a0}}]*({'|'.join(LABELS)}))"


def _marks(text: Column) -> Column:
    """array<struct<n, label, head>> of the blocks of a text: length, label ('' for none), and length of the heading where a section can start."""

    def mark(b):
        label = F.upper(F.regexp_extract(b, LABEL, 1))
        head = F.lit(0)
        for start, _ in BOUNDS.values():
            head = F.when(label.startswith(start), F.length(F.regexp_extract(b, _heading(start), 0))).otherwise(head)
        return F.struct(F.length(b).alias("n"), label.alias("label"), head.alias("head"))

    return F.transform(F.split(text, LINE), mark)


def _longest(marks: Column, label: str, follower: Column) -> Column:
    """struct<starts, start, span> of the longest section, the earliest of equal ones; start is null without any.

    Sections end where the follower stands, or, if it is null, with the text. A heading label also
    begins those it is a part of (7 begins 7A), and such a block ends one section before it starts another.
    """
    state = "at: int, starts: int, last: int, start: int, span: int"
    kind = f"struct<{state}>"
    begin = F.from_json(F.lit('{"at": 0, "starts": 0, "span": -1}'), kind)

    def ended(acc, here):
        longer = acc["last"].isNotNull() & here & (acc["at"] - acc["last"] > acc["span"])
        return F.when(longer, acc["last"]).otherwise(acc["start"]), F.when(longer, acc["at"] - acc["last"]).otherwise(acc["span"])

    def step(acc, b):
        start, span = ended(acc, F.coalesce(b["label"].startswith(follower) & (b["label"] != ""), F.lit(False)))
        own = b["label"].startswith(label)
        last = F.when(own & (b["head"] < b["n"]), acc["at"] + b["head"]).otherwise(acc["last"])  # one at the end of the text has nothing behind it
        return F.struct((acc["at"] + b["n"]).alias("at"), (acc["starts"] + own.cast("int")).alias("starts"), last.alias("last"), start.alias("start"), span.alias("span"))

    def finish(acc):
        start, span = ended(acc, follower.isNull())
        return F.struct(acc["starts"].alias("starts"), start.alias("start"), span.alias("span"))

    return F.aggregate(marks, begin, step, finish)


def _has(marks: str, label: str) -> Column:
    return F.exists(marks, lambda b: b["label"].startswith(label))


def _section(work: DataFrame, name: str, out: str) -> DataFrame:
    """work (_x, _marks, ...) with `out`: struct<text, failed, reason> of one section."""
    if name not in BOUNDS:
        raise KeyError(f"no bounds for section {name!r}, only for {', '.join(sorted(BOUNDS))}")
    label, followers = BOUNDS[name]
    first = F.lit(None).cast("string")
    for f in reversed(followers):
        first = F.when(_has("_marks", f), F.lit(f)).otherwise(first)
    # Each step is a column of its own, so that none is computed again inside a lambda.
    work = work.withColumn("_follower", first).withColumn("_best", _longest(F.col("_marks"), label, F.col("_follower")))
    piece = F.regexp_replace(F.substring(F.col("_x"), F.col("_best.start") + 1, F.col("_best.span")), EDGES, "")
    work = work.withColumn("_piece", F.when(F.col("_best.start").isNotNull(), piece).otherwise(""))
    reason = (
        F.when(F.col("_best.starts") == 0, F.lit(f"no 'Item {label}' heading in {name}"))
        .when(F.col("_best.start").isNull(), F.lit(f"no 'Item {label}' heading stands before an end of {name}"))
        .when(F.length("_piece") < MIN_SECTION_CHARS, F.concat(F.lit(f"{name} has "), F.length("_piece").cast("string"), F.lit(f" characters, fewer than {MIN_SECTION_CHARS}")))
        .otherwise("")
    )
    # Generated, not projected: a later filter on the outcome is then not pushed below these steps, each written out in full.
    result = F.explode(F.array(F.struct(F.col("_piece").alias("text"), (reason != "").alias("failed"), reason.alias("reason"))))
    return work.withColumn(out, result).drop("_follower", "_best", "_piece")


def _marked(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_x", F.coalesce(F.col(text), F.lit(""))).withColumn("_marks", _marks(F.col("_x")))


def extract(df: DataFrame, text: str, name: str, out: str) -> DataFrame:
    """df with `out`: struct<text, failed, reason> of one section of the text column (null text: no heading)."""
    return _section(_marked(df, text), name, out).drop("_x", "_marks")


def extract_all(df: DataFrame, text: str, names: tuple[str, ...] = DEFAULT_SECTIONS) -> DataFrame:
    """df with body, section_failed and failure_reason over several sections.

    Bodies that were found are joined by a blank line in the order asked for; any failure fails
    the row, and its reasons are joined by "; ". A failed section never stands for the whole text.
    """
    work = _marked(df, text)
    for i, name in enumerate(names):
        work = _section(work, name, f"_section{i}")
    parts = F.array(*[F.col(f"_section{i}") for i in range(len(names))])
    found = F.transform(F.filter(parts, lambda p: ~p["failed"]), lambda p: p["text"])
    reasons = F.transform(F.filter(parts, lambda p: p["failed"]), lambda p: p["reason"])
    return work.withColumns(
        {"body": F.array_join(found, "\n\n"), "section_failed": F.size(reasons) > 0, "failure_reason": F.array_join(reasons, "; ")}
    ).drop("_x", "_marks", *[f"_section{i}" for i in range(len(names))])
