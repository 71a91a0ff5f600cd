"""The parsing chain against a plain loop over documents and pages; interrupted runs, failing models, odd inputs."""

import pytest
from pyspark.sql import functions as F

from quire.operators import parse_chain as P

GAP = "# a\n### b\n"


def backend(name, answers, judged=True):
    """Answers by (doc, page); an exception stands for a failure of that unit."""
    rows = [(d, p, None if isinstance(a, Exception) else a, str(a) if isinstance(a, Exception) else None) for (d, p), a in answers.items()]

    def parse(units):
        known = units.sparkSession.createDataFrame(rows, "doc_id string, page int, markdown string, error string")
        return units.join(known, ["doc_id", "page"], "left")

    return P.Backend(name, parse, judged)


def plain(docs, pages, chain, corrector):
    """(doc, page) -> (backend, text) by loops, and the number of attempts."""
    out, tries = {}, 0

    def attempt(unit, backends):
        nonlocal tries
        for name, answers, judged in backends:
            answer = answers.get(unit)
            tries += 2 if isinstance(answer, Exception) else 1
            if isinstance(answer, str) and (not judged or (answer.strip() and not answer.startswith(GAP))):
                return name, answer
        return None

    for d in docs:
        done = attempt((d, -1), chain)
        mine = [p for e, p in pages if e == d]
        if not done and not mine:
            done = attempt((d, -1), [corrector]) or (None, "")
        if done:
            out[d, -1] = done
        else:
            out.update({(d, p): attempt((d, p), [*chain, corrector]) or (None, "") for p in mine})
    return out, tries


CHAIN = [
    ("one", {("a", -1): "fine", ("b", -1): GAP, ("c", -1): ValueError("x"), ("b", 0): "page", ("b", 1): GAP, ("b", 2): ValueError("y"), ("d", -1): " "}, True),
    ("two", {("c", -1): "second", ("b", 1): "| t |\n|---|\n| 1 |", ("d", -1): "", ("b", 4): GAP}, True),
]
EYES = ("eyes", {("b", 2): "| 2 |", ("d", -1): GAP, ("b", 4): "", ("b", 3): ValueError("z")}, False)
DOCS, PAGES = ["a", "b", "c", "d", "e"], [("a", 0), ("b", 0), ("b", 1), ("b", 2), ("b", 3), ("b", 4), ("c", 0)]


@pytest.fixture(scope="module")
def inputs(spark):
    docs = spark.createDataFrame([(d, "x", 3) for d in DOCS if d != "a"] + [("a", "x", None), (None, "x", None)], "doc_id string, payload string, tables int")
    # The expected tables of a document would reject every page; they are not asked of pages.
    docs = docs.withColumn("tables", F.when(F.col("doc_id") == "b", F.col("tables")))
    pages = spark.createDataFrame([(d, p, "x", 9) for d, p in PAGES] + [(None, 0, "x", 9), ("b", None, "x", 9)], "doc_id string, page int, payload string, tables int")
    return docs, pages


def chain():
    return [backend(*b) for b in CHAIN]


def test_same_as_plain_loop(spark, inputs, tmp_path):
    ledger = P.ParseLedger(spark, str(tmp_path / "ledger"))
    P.parse_documents(*inputs, chain(), backend(*EYES), ledger)
    units = P.parsed_units(*inputs, ledger)
    want, tries = plain(DOCS, PAGES, CHAIN, EYES)
    assert {(r.doc_id, r.page): (r.backend, r.markdown) for r in units.collect()} == want
    assert ledger.attempts().count() == tries
    P.parse_documents(*inputs, chain(), backend(*EYES), ledger)
    assert ledger.attempts().count() == tries
    stats = {r.doc_id: (r.backend, r.pages, r.corrected, r.empty) for r in P.retry_stats(units, "eyes").collect()}
    assert stats == {"a": ("one", 0, 0, 0), "b": (None, 5, 2, 1), "c": ("two", 0, 0, 0), "d": ("eyes", 0, 1, 0), "e": (None, 0, 0, 1)}
    kinds = {(r.doc_id, r.page): r.kind for r in P.merged_document_pages(units).collect()}
    assert kinds["b", 1] == "append" and kinds["b", 2] == "table"


def test_reasons_are_kept(spark, inputs, tmp_path):
    ledger = P.ParseLedger(spark, str(tmp_path / "ledger"))
    P.parse_documents(*inputs, chain(), backend(*EYES), ledger)
    first = {r.doc_id: (r.reasons, r.error, r.ok) for r in ledger.attempts().where("level = 'doc' AND backend = 'one'").collect()}
    assert first["a"] == ([], None, True) and first["c"] == ([], "x", False) and first["d"] == (["empty"], None, False)
    assert first["b"] == (["table_loss", "heading_discontinuous"], None, False)


def test_rounds_of_a_first_run_join_no_payloads(spark, inputs, tmp_path):
    docs, pages = inputs
    plans = []

    def watched(b):
        def parse(units):
            plans.append(units._jdf.queryExecution().optimizedPlan().toString())
            return b.parse(units)

        return P.Backend(b.name, parse, b.judged)

    ledger = P.ParseLedger(spark, str(tmp_path / "ledger"))
    P.run_chain(docs.where("doc_id IS NOT NULL").withColumn("page", F.lit(P.WHOLE)), [watched(b) for b in chain()], ledger, "doc")
    assert len(plans) == 3 and not any("Join" in p for p in plans)  # the failure of "c" is asked again
    P.run_chain(pages.where("doc_id = 'b' AND page >= 0").drop("tables"), [watched(b) for b in (*chain(), backend(*EYES))], ledger, "page")
    assert len(plans) == 8 and not any("Join" in p for p in plans)
    assert ledger.attempts().columns == ["level", *P._KEYS, "backend", "markdown", "reasons", "error", "ok"]


def test_interrupted_run_goes_on(spark, inputs, tmp_path):
    ledger = P.ParseLedger(spark, str(tmp_path / "ledger"))

    def crash(units):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        P.parse_documents(*inputs, [chain()[0], P.Backend("two", crash)], backend(*EYES), ledger)
    before = ledger.attempts().count()
    (tmp_path / "ledger" / "round-000009").mkdir()  # a round that was begun and never finished
    P.parse_documents(*inputs, chain(), backend(*EYES), ledger)
    want, tries = plain(DOCS, PAGES, CHAIN, EYES)
    assert 0 < before < tries == ledger.attempts().count()
    assert {(r.doc_id, r.page): (r.backend, r.markdown) for r in P.parsed_units(*inputs, ledger).collect()} == want


def test_new_documents_only(spark, inputs, tmp_path):
    docs, pages = inputs
    ledger = P.ParseLedger(spark, str(tmp_path / "ledger"))
    P.parse_documents(docs.where("doc_id <> 'c'"), pages, chain(), backend(*EYES), ledger)
    P.parse_documents(docs, pages, chain(), backend(*EYES), ledger)
    assert ledger.attempts().count() == plain(DOCS, PAGES, CHAIN, EYES)[1]


def test_empty_input_and_model(spark, inputs, tmp_path):
    docs, pages = inputs
    ledger = P.ParseLedger(spark, str(tmp_path / "ledger"))
    P.parse_documents(docs.limit(0), pages.limit(0), chain(), backend(*EYES), ledger)
    assert ledger.attempts().count() == 0 and P.parsed_units(docs.limit(0), pages, ledger).count() == 0

    def make():
        return lambda texts: [t.upper() for t in texts]

    P.parse_documents(docs, pages, [P.model_backend("m", make)], backend(*EYES), ledger)
    found = {r.doc_id: r.markdown for r in P.parsed_units(docs.where("doc_id <> 'b'"), pages, ledger).collect()}
    assert found == {"a": "X", "c": "X", "d": "X", "e": "X"}
