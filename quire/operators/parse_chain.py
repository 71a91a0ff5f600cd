"""Parsing by a chain of backends with a quality gate: whole documents first, then the pages of those that failed.

Every attempt is a row of a ledger: (level, doc_id, page, backend, markdown, reasons, error, ok). A round takes the units that are
still open for one backend, parses them, and is committed as one folder. A run that is stopped goes on at the rounds that are missing,
and a finished run adds nothing when it is started again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.core import pin
from quire.operators.models import call_model
from quire.operators.quality import merge_pages, parse_quality
from quire.session import materialize
from quire.sources.folders import finished

#: Page of an attempt on a whole document.
WHOLE = -1
_KEYS = ["doc_id", "page"]


@dataclass(frozen=True)
class Backend:
    """``parse`` adds ``markdown`` (null: nothing found) and ``error`` (null: none) to the units and keeps their columns.

    The answer of a backend that is not ``judged`` is taken as it is, like that of a correction from the page image.
    """

    name: str
    parse: Callable[[DataFrame], DataFrame]
    judged: bool = True


def model_backend(name: str, make: Callable[[], Callable[[list[str]], list[str]]], payload: str = "payload", judged: bool = True, **options) -> Backend:
    """A backend around a function from payloads to Markdown texts, built once per task."""

    def parse(units: DataFrame) -> DataFrame:
        return call_model(units, payload, "markdown", make, **options).withColumnRenamed("markdown_error", "error").drop("markdown_ms")

    return Backend(name, parse, judged)


class ParseLedger:
    """Attempts below ``path``, a folder per round; a round without its end mark does not count and is written again."""

    def __init__(self, spark: SparkSession, path: str, doc_id: str = "string"):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = (
            f"level string, doc_id {doc_id}, page int, backend string, markdown string, reasons array<string>, error string, ok boolean"
        )

    def attempts(self) -> DataFrame:
        done = [f"{self.path}/{n}" for n in finished(self.spark, self.path)[0]]
        return self.spark.read.schema(self.schema).parquet(*done) if done else self.spark.createDataFrame([], self.schema)

    def add(self, attempts: DataFrame) -> DataFrame:
        """Commit a round and return it as written. A column ``unit`` is kept beside the attempts; only the returned rows show it."""
        _, number = finished(self.spark, self.path)
        path = f"{self.path}/round-{number:06d}"
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.attempts().schema.fields]
        rows = attempts.select(*columns, *[c for c in attempts.columns if c == "unit"])
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)


def _open(units: DataFrame, keys: DataFrame, ledger: ParseLedger, level: str, backend: str, tries: int) -> DataFrame | None:
    """Units that no backend has settled and this one has neither answered nor failed ``tries`` times; None if there is none.

    Open units are found on keys and flags alone, and written; payloads are only read to be parsed.
    """
    mine = F.col("backend") == backend
    closed = (
        ledger.attempts()
        .where(F.col("level") == level)
        .groupBy(*_KEYS)
        .agg(
            F.max("ok").alias("settled"),
            F.max(F.coalesce(mine & F.col("error").isNull(), F.lit(False))).alias("answered"),
            F.count_if(mine).alias("tried"),
        )
        .where(F.col("settled") | F.col("answered") | (F.col("tried") >= tries))
    )
    left = materialize(keys.join(closed.select(*_KEYS), _KEYS, "left_anti"), "open-units")
    return None if left.isEmpty() else units.join(left, _KEYS, "left_semi")


def _attempt(units: DataFrame, backend: Backend, level: str, again: bool, on: bool) -> DataFrame:
    """Attempts on ``units``. Those that may be asked ``again`` after an error, or go ``on`` to a further backend, carry their unit."""
    none = F.lit(None).cast("int")
    tables, fences = [F.col(c) if c in units.columns else none for c in ("tables", "fences")]
    rows = pin(backend.parse(units), "_text", F.when(F.col("error").isNull(), F.col("markdown")))
    given = F.col("_text").isNotNull()
    reasons: Column = F.when(given, parse_quality(F.col("_text"), tables, fences)) if backend.judged else F.lit(None)
    rows = pin(rows, "_reasons", F.coalesce(reasons, F.array().cast("array<string>")))
    ok = given & (F.size("_reasons") == 0)
    carried = ~ok & (F.lit(on) | (F.lit(again) & F.col("error").isNotNull()))
    return rows.select(
        F.lit(level).alias("level"), *_KEYS, F.lit(backend.name).alias("backend"), F.col("_text").alias("markdown"),
        F.col("_reasons").alias("reasons"), "error", ok.alias("ok"), F.when(carried, F.struct(*units.columns)).alias("unit"),
    )


def run_chain(
    units: DataFrame, backends: list[Backend], ledger: ParseLedger, level: str, tries: int = 2, keys: DataFrame | None = None
) -> None:
    """Rounds until no unit is open: each backend in order, and again for units at which it failed with an error.

    ``units`` is (doc_id, page, payload) with any further columns, one row per unit; optional ``tables`` and ``fences`` are the expected
    counts. A backend that answers badly is not asked again, one that fails is asked ``tries`` times.

    In a first run a round hands the units that stay open on to the next one, so payloads are not shuffled for a round. A run that
    goes on with attempts of an earlier one finds its units by the ledger. ``keys`` are the (doc_id, page) of the units, if they are
    cheaper to come by than from these.
    """
    keys = units.select(*_KEYS) if keys is None else keys
    if not ledger.attempts().where(F.col("level") == level).isEmpty():
        return _resumed_chain(units, keys, backends, ledger, level, tries)
    left = units
    for n, backend in enumerate(backends):
        todo, bad = left, []
        for attempt in range(1, tries + 1):
            if keys.isEmpty():
                break
            done = ledger.add(_attempt(todo, backend, level, attempt < tries, n + 1 < len(backends)))
            bad.append(done.where("NOT ok AND error IS NULL").select("unit.*"))
            failed = done.where("NOT ok AND error IS NOT NULL")
            todo, keys = failed.select("unit.*"), failed.select(*_KEYS)
        left = reduce(DataFrame.unionByName, [*bad, todo])
        keys = left.select(*_KEYS)


def _resumed_chain(units: DataFrame, keys: DataFrame, backends: list[Backend], ledger: ParseLedger, level: str, tries: int) -> None:
    for backend in backends:
        for _ in range(tries):
            todo = _open(units, keys, ledger, level, backend.name, tries)
            if todo is None:
                break
            if ledger.add(_attempt(todo, backend, level, False, False).drop("unit")).where("error IS NOT NULL").isEmpty():
                break


def parse_documents(docs: DataFrame, pages: DataFrame, backends: list[Backend], corrector: Backend, ledger: ParseLedger, tries: int = 2) -> None:
    """Fill the ledger: documents by the chain; the pages of failed ones by the chain and then the corrector.

    ``docs`` is (doc_id, payload, ...), ``pages`` (doc_id, page, payload, ...). The expected counts of a document do not hold for its
    pages, so pages are judged without them. A failed document without pages goes to the corrector whole. Null ids are left out.
    """
    whole = docs.where("doc_id IS NOT NULL").withColumn("page", F.lit(WHOLE))
    run_chain(whole, backends, ledger, "doc", tries)
    # Settled by the chain, so that a later correction of the whole document does not bring its pages in or out.
    settled = ledger.attempts().where(F.col("ok") & (F.col("level") == "doc") & F.col("backend").isin([b.name for b in backends]))
    failed = whole.join(settled.select("doc_id"), "doc_id", "left_anti")
    paged = pages.where("doc_id IS NOT NULL AND page IS NOT NULL").drop("tables", "fences")
    # Written, so that open pages are found without their texts.
    keys = materialize(paged.select(*_KEYS), "page-keys")
    alone = failed.join(keys.select("doc_id"), "doc_id", "left_anti")
    run_chain(alone, [corrector], ledger, "doc", tries, materialize(alone.select(*_KEYS), "lone-keys"))
    lost = failed.select("doc_id")
    todo = paged.join(lost, "doc_id", "left_semi")
    run_chain(todo, [*backends, corrector], ledger, "page", tries, keys.join(lost, "doc_id", "left_semi").select(*_KEYS))


def parsed_units(docs: DataFrame, pages: DataFrame, ledger: ParseLedger) -> DataFrame:
    """``doc_id, page, backend, markdown``: a row per settled document (page -1), and one per page of the others.

    A page, or a document without pages, that nothing could parse has no backend and an empty text.
    """
    good = ledger.attempts().where("ok").select("level", *_KEYS, "backend", "markdown")
    whole = good.where("level = 'doc'").drop("level")
    left = docs.where("doc_id IS NOT NULL").select("doc_id").join(whole.select("doc_id"), "doc_id", "left_anti")
    keys = pages.where("doc_id IS NOT NULL AND page IS NOT NULL").select(*_KEYS)
    units = left.join(keys, "doc_id", "left").select("doc_id", F.coalesce("page", F.lit(WHOLE)).alias("page"))
    done = units.join(good.where("level = 'page'").drop("level"), _KEYS, "left")
    return whole.unionByName(done.withColumn("markdown", F.coalesce("markdown", F.lit(""))))


def merged_document_pages(units: DataFrame, keep_tail: bool = False) -> DataFrame:
    """``doc_id, page, kind, kept`` of parsed units, pages joined over table and list breaks."""
    return merge_pages(units.select(*_KEYS, F.col("markdown").alias("text")), keep_tail)


def retry_stats(units: DataFrame, corrector: str) -> DataFrame:
    """Per document: the backend of a whole parse, pages, corrected pages and pages left empty."""
    page = F.col("page") != WHOLE
    return units.groupBy("doc_id").agg(
        F.max(F.when(~page, F.col("backend"))).alias("backend"),
        F.count_if(page).alias("pages"),
        F.count_if(F.col("backend") == corrector).alias("corrected"),
        F.count_if(F.col("backend").isNull()).alias("empty"),
    )
