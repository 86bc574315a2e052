"""Table functions in Python, registered at run time and called from SQL.

    register(spark)
    spark.sql("select page_id, s.* from pages, lateral scripts_in_html(html) s")
    spark.sql("select * from context_of(table(lines) partition by log_id order by line_no)")

register_pass() makes a user's record pass such a function. Spark deals the table by its partition columns and
sorts it; a function's object sees one log's rows, streamed, and keeps only its state.
"""

from __future__ import annotations

import copy
from collections import namedtuple
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from spoor.functions.html import scripts_in
from spoor.plans.records import RecordPass
from spoor.plans.stepwise import ContextPass
from spoor.session import ship


class ScriptsInHtml:
    """scripts_in_html(html): kind (src, inline or handler), text, in the order of the page; no rows for a null."""

    def eval(self, html: str) -> Iterator[tuple[str, str]]:
        yield from scripts_in(html)


def function_of(work: RecordPass, keys: tuple[str, ...] = ("log_id",)):
    """The class of a table function over a table of records, partitioned by keys: keys and the output of work."""
    record = namedtuple("Record", work.columns)

    class Records:
        def __init__(self) -> None:
            self.work = copy.deepcopy(work)
            self.state = self.work.start()
            self.log: tuple | None = None

        def eval(self, row: Row) -> Iterator[tuple]:
            self.log = tuple(row[k] for k in keys)
            self.state, rows = self.work.step(self.state, record(*(row[c] for c in work.columns)))
            for r in rows:
                yield (*self.log, *r)

        def terminate(self) -> Iterator[tuple]:
            if self.log is not None:
                for r in self.work.finish(self.state):
                    yield (*self.log, *r)

    return Records


def register_pass(spark: SparkSession, name: str, work: RecordPass, keys: tuple[str, ...] = ("log_id",), kind: str = "string") -> None:
    """name(table(...) partition by keys order by ...) in SQL. kind: the type of the keys."""
    ship(spark)
    spark.udtf.register(name, udtf(function_of(work, keys), returnType=", ".join([f"{k} {kind}" for k in keys] + [work.output])))


def register(spark: SparkSession) -> None:
    """The functions of this module: scripts_in_html and context_of."""
    ship(spark)
    spark.udtf.register("scripts_in_html", udtf(ScriptsInHtml, returnType="kind string, text string"))
    register_pass(spark, "context_of", ContextPass())
