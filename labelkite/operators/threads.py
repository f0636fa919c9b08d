"""Threads of messages: inherit from the opening message, collect a thread as nested rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.operators.skew import lookup_join
from labelkite.shared import written


def thread_roots(
    messages: DataFrame, thread: str, position: str, columns: list[str], root: str = "first"
) -> DataFrame:
    """Opening message of each thread, with the thread's number of messages.

    ``root`` tells whether it stands first or last. A plain aggregate: a thread with a third of all
    messages still costs one row by task.
    """
    pick = F.min_by if root == "first" else F.max_by
    return messages.groupBy(thread).agg(
        pick(F.struct(*columns), F.col(position)).alias("opening"),
        F.count("*").alias("messages"),
    )


def inherit_from_root(
    messages: DataFrame,
    thread: str,
    position: str,
    columns: list[str],
    root: str = "first",
) -> DataFrame:
    """Messages that lack one of the columns take it from the opening message of their thread.

    Where that has none either, the cell stays empty. All other columns are untouched.
    """
    roots = thread_roots(messages, thread, position, columns, root).select(
        thread,
        *[F.col("opening")[c].alias(f"_root_{c}") for c in columns],
    )
    joined = lookup_join(messages, written(roots, "roots"), thread, how="left")
    return joined.withColumns({c: F.coalesce(c, f"_root_{c}") for c in columns}).select(
        *messages.columns
    )


def collect_thread(
    messages: DataFrame,
    thread: str,
    position: str,
    columns: list[str],
    root: str = "first",
    max_messages: int = 100_000,
) -> DataFrame:
    """``(thread, messages, original_request, comments)``: one nested row by thread.

    ``comments`` holds all messages, the opening one included, in order. A row must fit in a task's
    memory, so a thread with more than ``max_messages`` stops the job; ``thread_rows`` has no such
    bound. The opening is joined by a plain shuffle on the thread, as both sides are unique on it.
    """
    roots = thread_roots(messages, thread, position, columns, root)
    size = F.when(F.col("messages") <= max_messages, F.col("messages")).otherwise(
        F.raise_error(F.concat(F.lit("too many messages for one row: thread "), F.col(thread).cast("string")))
    )
    roots = written(roots.withColumn("messages", size), "roots")
    nested = messages.groupBy(thread).agg(
        F.array_sort(F.collect_list(F.struct(position, *columns))).alias("comments")
    )
    return nested.hint("merge").join(roots.hint("merge"), thread).select(
        thread, "messages", F.col("opening").alias("original_request"), "comments"
    )


def thread_rows(
    messages: DataFrame, thread: str, position: str, columns: list[str], root: str = "first"
) -> DataFrame:
    """``(thread, position, opens, <columns>)``: a thread in long form, however large it is.

    ``opens`` marks the opening message. Only its position is looked up, so no text is copied.
    """
    pick = F.min if root == "first" else F.max
    roots = messages.groupBy(thread).agg(pick(position).alias("_root"))
    joined = lookup_join(messages, written(roots, "roots"), thread, how="left")
    return joined.select(thread, position, (F.col(position) == F.col("_root")).alias("opens"), *columns)
