"""Run a corpus of SQL statements and keep outcomes and results as tables.

Statements come from models, so they are not trusted. Each runs as a subquery, which the
SQL grammar only allows for queries; files as relations are switched off; calls that leave
the engine are refused.

Statements that differ only in constants they compare with (``... = 17``, ``... = 'F'``) are a
family. A family of some size is analysed once, and runs as one lateral join of the table of its
constants with the statement: one job, however many members it has, and their texts never come
to the driver. A family that a lateral join would change is only analysed as one: if its first
and its last member fail alike, so do all. The other statements run in pages, a page as one union
in one job. A job that fails is halved until the statement that makes it fail is alone; its error
is its outcome, as is a run that takes longer than a limit.

All jobs write to one table, in a part of their own each; the parts of jobs that ended are read.
"""

from __future__ import annotations

import threading
from collections import deque
from collections.abc import Callable, Iterable, Iterator, Mapping
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import reduce
from itertools import count, islice

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from sqlgauge import settings as S
from sqlgauge.functions.sqltext import KEYWORDS, changed_tokens, masked, token_text
from sqlgauge.functions.text import bind, is_blank, prompt_key
from sqlgauge.operators.resultsets import to_result_rows
from sqlgauge.session import scratch_path

OUTCOME_SCHEMA = "sql_key string, ok boolean, condition string, message string"
ROW_SCHEMA = "sql_key string, row_no bigint, cells array<struct<col: string, val: string>>"
# Calls into the JVM, names built at run time, and scripts (a USING that names a command).
FORBIDDEN_PATTERN = r"(?i)\b(?:reflect|java_method|try_reflect)\b|\bidentifier \(|\busing [?\"]"
# Every text in which that pattern finds something has one of these words, in any case; other texts need no tokens.
_SUSPECT = r"(?iu)reflect|java_method|identifier|using"
#: Statements of a page, members from which on a family runs as one, and pieces of a family that failed.
PAGE = 32
FAMILY = 8
PIECES = 8
TIME_LIMIT = "TIME_LIMIT"

# A comparison with a constant, a text, or anything else; together the pieces are the whole statement.
_EQUALS = r"(?<![<>!=])=\s*"
_COMMENT = r"--[^\n]*|/\*(?!\+).*?\*/"
_PIECE = rf"(?s)({_COMMENT}|{_EQUALS}(?:'[^'\\]*'(?!')|\d{{1,9}}(?![\w.]))|'(?:[^'\\]|'')*'|[^'=/-]+|.)"
# What pieces are not told in: such statements have no family.
_UNREAD = r"/\*\+|[`\"\\]"
# What a lateral join would read in another way, or keeps no order of: such statements run by themselves.
_ALONE = (r"(?is)\b(?:order|limit|offset|fetch|over|union|except|minus|intersect|tablesample|lateral|"
          r"rand|randn|random|uuid|shuffle|monotonically_increasing_id|from_json)\b")
_TEXT_MARK, _NUMBER_MARK = "= {text}", "= {number}"


@dataclass(frozen=True)
class Corpus:
    """Outcome per statement and result rows of the ones that ran."""

    outcomes: DataFrame
    rows: DataFrame | None


def refusal(sql: Column) -> Column:
    """Why a statement is refused before it reaches the engine; null if it is not."""
    return F.when(F.coalesce(is_blank(sql), F.lit(True)), F.lit("BLANK_STATEMENT")).when(
        sql.rlike(_SUSPECT), F.when(masked(token_text(sql)).rlike(FORBIDDEN_PATTERN), F.lit("FORBIDDEN_CALL")))


def statement_table(statements: DataFrame, sql: str) -> DataFrame:
    """Distinct statements ``(sql_key, sql_text, refused)``."""
    return statements.select(F.col(sql).alias("sql_text")).filter("sql_text is not null").select(
        prompt_key(F.col("sql_text")).alias("sql_key"), "sql_text").dropDuplicates(["sql_key"]).withColumn(
        "refused", refusal(F.col("sql_text")))


def with_family(statements: DataFrame) -> DataFrame:
    """Add ``family`` (the text with marks for its constants, null if it must run alone) and ``constants``.

    ``alike`` is such a text for the statements that must run alone, followed by which of the constants are the
    same; null if the constants cannot be told.
    """
    pieces = F.regexp_extract_all("sql_text", F.lit(_PIECE), 1)
    # a piece that begins with a sign of equality holds nothing else or is a constant
    is_constant = lambda p: p.startswith("=") & (p != "=")
    bare = lambda p: F.regexp_replace(p, r"\A=\s*", "")
    comment = lambda p: p.startswith("--") | p.startswith("/*")
    mark = lambda p: F.when(comment(p), F.lit(" ")).when(~is_constant(p), p).when(
        bare(p).startswith("'"), F.lit(_TEXT_MARK)).otherwise(F.lit(_NUMBER_MARK))
    found = statements.withColumn("_pieces", pieces)
    # a mark that the text holds by itself would be taken for a constant
    plain = ~F.col("sql_text").rlike(_UNREAD) & ~F.col("sql_text").rlike(r"= \{(?:text|number)\}")
    text = F.when(plain & F.exists("_pieces", is_constant), F.array_join(F.transform("_pieces", mark), ""))
    alone = F.col("sql_text").rlike(_ALONE)
    found = found.withColumns({
        "family": F.when(~alone, text),
        "alike": F.when(alone, text),
        "constants": F.transform(F.filter("_pieces", is_constant), lambda p: F.regexp_replace(bare(p), "\\A'|'\\z", "")),
    }).drop("_pieces")
    same = F.array_join(F.transform("constants", lambda c: F.array_position("constants", c).cast("string")), ",")
    return found.withColumn("alike", F.concat("alike", F.lit("\n-- "), same))


def guarded_session(spark: SparkSession, views: Mapping[str, str] | None = None) -> SparkSession:
    """A session of its own with the given views only; files cannot be named as relations."""
    session = spark.newSession()
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    session.conf.set("spark.sql.ansi.enabled", "true")
    for conf in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        if spark.conf.get(conf, None) is not None:
            session.conf.set(conf, spark.conf.get(conf))
    for name, path in (views or {}).items():
        session.read.parquet(path).createOrReplaceTempView(name)
    return session


def as_query(session: SparkSession, sql: str) -> DataFrame:
    """Analyse a statement as a subquery: commands and second statements do not parse."""
    body = sql.strip().rstrip(";")
    return session.sql(f"SELECT * FROM (\n{body}\n) AS statement")


def _as_family(session: SparkSession, family: str, view: str) -> DataFrame:
    """The family's statement for each row of a view of constants, with ``sql_key`` as the first column."""
    parts, no = [], 0
    rest = family.strip().rstrip(";")
    while marks := [m for m in (_TEXT_MARK, _NUMBER_MARK) if m in rest]:
        mark = min(marks, key=rest.index)
        before, rest = rest.split(mark, 1)
        parts += [before, f"= {view}.{'t' if mark == _TEXT_MARK else 'n'}{no}"]
        no += 1
    body = "".join(parts) + rest
    return session.sql(f"SELECT {view}.sql_key, statement.* FROM {view}, LATERAL (\n{body}\n) AS statement")


def _failure(key: str, error: Exception) -> Row:
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    first_line = (str(error).strip().splitlines() or [""])[0]
    return Row(sql_key=key, ok=False, condition=condition or type(error).__name__, message=first_line)


def _success(key: str) -> Row:
    return Row(sql_key=key, ok=True, condition=None, message="ok")


def _pages(items: Iterable[Row], size: int) -> Iterator[list[Row]]:
    items = iter(items)
    while page := list(islice(items, size)):
        yield page


def _in_order(pool: ThreadPoolExecutor, work: Callable, items: Iterable, ahead: int) -> Iterator:
    """Results in the order of the items, of which only a few are taken ahead."""
    waiting: deque[Future] = deque()
    for item in items:
        waiting.append(pool.submit(work, item))
        if len(waiting) > ahead:
            yield waiting.popleft().result()
    while waiting:
        yield waiting.popleft().result()


@dataclass
class _Run:
    """One run over a corpus: the guarded session, the folder, and the jobs that ended."""

    session: SparkSession
    base: str
    execute: bool
    timeout: float | None
    numbers: Iterator[int] = field(default_factory=count)
    ended: list[int] = field(default_factory=list)

    def write(self, rows: DataFrame) -> Exception | None:
        """Write the rows of one job; the error if it fails."""
        no = next(self.numbers)
        tag, late = f"sqlgauge-{threading.get_ident()}-{no}", threading.Event()

        def stop() -> None:
            late.set()
            self.session.sparkContext.cancelJobsWithTag(tag)

        timer = threading.Timer(self.timeout, stop) if self.timeout else None
        self.session.sparkContext.addJobTag(tag)
        try:
            if timer:
                timer.start()
            rows.write.mode("overwrite").parquet(f"{self.base}/rows/job={no}")
            self.ended.append(no)
            return None
        except Exception as error:  # any failure of a statement is data
            return TimeoutError(f"{TIME_LIMIT}: took longer than {self.timeout} s") if late.is_set() else error
        finally:
            if timer:
                timer.cancel()
            self.session.sparkContext.removeJobTag(tag)

    # -- statements by themselves

    def page(self, page: list[Row]) -> list[Row]:
        """Outcomes of statements: each is analysed, those that can run do so in one job."""
        done, ready = [], []
        for s in page:
            try:
                query = as_query(self.session, s["sql_text"])
                rows = to_result_rows(query, F.lit(s["sql_key"]), "result").withColumnRenamed("case_id", "sql_key")
                ready.append((s["sql_key"], rows.drop("side")))
            except Exception as error:
                done.append(_failure(s["sql_key"], error))
        if not self.execute:
            return done + [_success(key) for key, _ in ready]
        return done + self.together(ready)

    def together(self, ready: list[tuple[str, DataFrame]]) -> list[Row]:
        if not ready:
            return []
        error = self.write(reduce(DataFrame.unionByName, [rows for _, rows in ready]))
        if error is None:
            return [_success(key) for key, _ in ready]
        if len(ready) == 1:
            return [_timed_out(ready[0][0], error) if isinstance(error, TimeoutError) else _failure(ready[0][0], error)]
        half = len(ready) // 2
        return self.together(ready[:half]) + self.together(ready[half:])

    # -- families

    def family(self, family: Row) -> list[Row]:
        """How the members of a family, or pieces of it, came out.

        ``(family_key, pieces, piece, ok, condition, message)``: ``ok`` null sends the piece to the pages.
        """
        key = family["family_key"]
        tell = lambda pieces, piece, ok, error=None: Row(
            family_key=key, pieces=pieces, piece=piece, ok=ok, condition=error and error.condition,
            message="ok" if ok else error and error.message)
        try:
            names = as_query(self.session, family["sample"]).columns
        except Exception as error:
            failure = _failure(key, error)
            return [tell(1, 0, False, failure) if family["family"] or self.fails_alike(family["last"], failure)
                    else tell(1, 0, None)]
        if not family["family"]:
            return [tell(1, 0, None)]
        if not self.execute:
            return [tell(1, 0, True)]

        def part(pieces: int, piece: int) -> list[Row]:
            try:
                rows = self.members(family, names, pieces, piece)
            except Exception:  # the statement does not work as a lateral join
                rows = None
            if rows is None:
                return [tell(pieces, piece, None)]
            if self.write(rows) is None:
                return [tell(pieces, piece, True)]
            if pieces > 1 or family["n"] <= PIECES * PAGE:
                return [tell(pieces, piece, None)]
            return [r for p in range(PIECES) for r in part(PIECES, p)]

        return part(1, 0)

    def fails_alike(self, sql: str, failure: Row) -> bool:
        try:
            as_query(self.session, sql)
        except Exception as error:
            return _failure(failure["sql_key"], error) == failure
        return False

    def members(self, family: Row, expected: list[str], pieces: int, piece: int) -> DataFrame | None:
        """Result rows of a piece of a family; null if its columns are named after the constants."""
        given = self.session.read.parquet(f"{self.base}/statements").where(
            (F.col("family_key") == family["family_key"]) & (_piece(pieces) == piece))
        values = F.col("constants")
        typed = [v for i in range(family["width"]) for v in (
            F.get(values, F.lit(i)).alias(f"t{i}"), F.get(values, F.lit(i)).try_cast("int").alias(f"n{i}"))]
        view = f"given_{next(self.numbers)}"
        given.select("sql_key", *typed).createOrReplaceTempView(view)
        try:
            found = _as_family(self.session, family["family"], view)
        finally:
            self.session.catalog.dropTempView(view)
        names = found.columns[1:]
        if names != expected:
            return None
        renamed = found.toDF("_given_key", *[f"_{i}" for i in range(len(names))])
        named = [c if names.count(c) == 1 else f"{c}#{i}" for i, c in enumerate(names)]
        order = sorted(range(len(names)), key=lambda i: named[i])
        cells = [F.struct(F.lit(named[i]).alias("col"), F.col(f"_{i}").cast("string").alias("val")) for i in order]
        return renamed.select(F.col("_given_key").alias("sql_key"), F.monotonically_increasing_id().alias("row_no"),
                              F.array(*cells).alias("cells"))


def _timed_out(key: str, error: TimeoutError) -> Row:
    return Row(sql_key=key, ok=False, condition=TIME_LIMIT, message=str(error))


def _piece(pieces: int | Column) -> Column:
    return F.pmod(F.xxhash64("sql_key"), F.lit(pieces) if isinstance(pieces, int) else pieces)


_FAMILY_SCHEMA = "family_key string, pieces bigint, piece bigint, ok boolean, condition string, message string"


def run_statements(session: SparkSession, statements: DataFrame, execute: bool = True, parallel: int = 4,
                   timeout: float | None = None, family: int = FAMILY) -> Corpus:
    """Run each statement of ``statement_table`` once, in the guarded ``session``.

    ``execute=False`` only analyses (names, types, arity): no rows are read. ``timeout`` is the number of seconds
    a job may take; a statement that by itself takes longer has the outcome ``TIME_LIMIT``. ``family`` is the
    number of members from which on a family runs as one. Tables are of the session of ``statements``. The driver
    sees one text for each family, and those of the statements that run by themselves, a few pages at a time.
    """
    spark = statements.sparkSession
    run = _Run(session, scratch_path(spark, "statements"), execute, timeout)
    keyed = with_family(statements).withColumn(
        "family_key", F.sha2(F.coalesce("family", "alike"), 256)).drop("alike")
    keyed.write.parquet(f"{run.base}/statements")
    stored = spark.read.schema(keyed.schema).parquet(f"{run.base}/statements")
    todo = stored.where("refused is null")
    families = todo.where("family_key is not null").groupBy("family_key", "family").agg(
        F.count(F.lit(1)).alias("n"), F.min("sql_text").alias("sample"), F.max("sql_text").alias("last"),
        F.max(F.size("constants")).alias("width"))

    def keep(name: str, schema: str, parts: Iterator[list[Row]]) -> DataFrame:
        """Store rows that the driver makes, part by part."""
        path = f"{run.base}/{name}"
        spark.createDataFrame([], schema).write.parquet(f"{path}/part=0")
        for no, rows in enumerate(parts, 1):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/part={no}")
        return spark.read.schema(schema).parquet(path).drop("part")

    with ThreadPoolExecutor(max_workers=parallel) as pool:
        many = families.where(F.col("n") >= family).toLocalIterator(prefetchPartitions=True)
        told = (r for rows in _in_order(pool, run.family, many, 2 * parallel) for r in rows)
        told = keep("families", _FAMILY_SCHEMA, _pages(told, PAGE))
        by_family = todo.join(told, (todo["family_key"] == told["family_key"])
                              & (_piece(F.col("pieces")) == F.col("piece")), "left")
        alone = by_family.where("ok is null").select("sql_key", "sql_text").toLocalIterator(prefetchPartitions=True)
        paged = keep("outcomes", OUTCOME_SCHEMA, _in_order(pool, run.page, _pages(alone, PAGE), 2 * parallel))
    refused = stored.where("refused is not null").select(
        "sql_key", F.lit(False).alias("ok"), F.col("refused").alias("condition"), F.lit("refused").alias("message"))
    outcomes = paged.unionByName(refused).unionByName(
        by_family.where("ok is not null").select("sql_key", "ok", "condition", "message"))
    if not execute:
        return Corpus(outcomes, None)
    spark.createDataFrame([], ROW_SCHEMA).write.parquet(f"{run.base}/rows/job=-1")
    # a handful of numbers: rows are not dealt by the job that made them
    ended = F.broadcast(spark.createDataFrame([(n,) for n in run.ended], "job int"))
    rows = spark.read.schema(ROW_SCHEMA + ", job int").parquet(f"{run.base}/rows")
    return Corpus(outcomes, rows.join(ended, "job", "left_semi").select("sql_key", "row_no", "cells"))


def _faults_of(condition: str) -> list[S.FaultType]:
    return [f for f in S.FAULT_TYPES if f.condition == condition]


def fault_category(condition: Column, broken: Column | None = None, right: Column | None = None) -> Column:
    """Fault type and category of an engine error condition (its class, before any dot).

    What a parser error comes from is told by aligning the tokens of the broken statement with those of the
    right one: a reserved word lost for one other word, a sign added, or an operator lost. Without a right
    statement, or after any other change, such an error has a category only.
    """
    head = F.substring_index(condition, ".", 1)
    none = F.lit(None).cast("string")
    name = category = none
    for cond in dict.fromkeys(f.condition for f in S.FAULT_TYPES):
        if len(faults := _faults_of(cond)) == 1:
            name = F.when(head == cond, F.lit(faults[0].name)).otherwise(name)
            category = F.when(head == cond, F.lit(faults[0].category)).otherwise(category)
    for cond, of in S.FAULT_CATEGORIES.items():
        category = F.when(head == cond, F.lit(of)).otherwise(category)
    if broken is not None and right is not None:
        name = bind(changed_tokens(right, broken), lambda d: F.when(
            head.isin("PARSE_SYNTAX_ERROR", "UNSUPPORTED_TYPED_LITERAL"), _fault_of_change(d["lost"], d["added"])
        ).otherwise(name))
    return F.struct(name.alias("fault"), category.alias("category"))


def _fault_of_change(lost: Column, added: Column) -> Column:
    one_lost, one_added = F.get(lost, F.lit(0)), F.get(added, F.lit(0))
    is_word = lambda t: t.rlike(r"\A[\p{L}_$]")
    swapped = (F.size(lost) == 1) & (F.size(added) == 1)
    return (
        F.when(swapped & one_lost.isin(*KEYWORDS) & is_word(one_added), F.lit("keyword_misspelling"))
        .when((F.size(lost) == 0) & (F.size(added) == 1) & ~one_added.rlike(r"\A[\p{L}\p{N}_$'\"`]"),
              F.lit("illegal_character"))
        .when((F.size(lost) == 1) & (F.size(added) == 0) & ~one_lost.rlike(r"\A[\p{L}\p{N}_$'\"`]"),
              F.lit("operator_deletion")))
