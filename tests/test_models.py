from quire.operators.models import call_model, embed, judged


def test_call_model_retries_and_reports(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, prompt string").coalesce(1)

    def flaky():
        seen = []

        def answer(prompts):
            seen.append(1)
            if len(seen) < 2:
                raise RuntimeError("busy")
            return [p.upper() for p in prompts]

        return answer

    rows = call_model(df, "prompt", "answer", flaky, base_delay=0.01).orderBy("id").collect()
    assert [r.answer for r in rows] == ["A", "B"] and all(r.answer_error is None for r in rows)

    def broken():
        def answer(prompts):
            raise ValueError("no")

        return answer

    rows = call_model(df, "prompt", "answer", broken, tries=2, base_delay=0.01).collect()
    assert all(r.answer is None and r.answer_error == "ValueError: no" for r in rows)


def test_judge_replies(spark):
    df = spark.createDataFrame([('{"faithfulness": 2, "context_recall": "x"}',), ("nothing",)], "reply string")
    good, bad = judged(df).collect()
    assert good.faithfulness == 1.0 and good.context_recall is None and good.verdict == "pass"
    assert bad.verdict == "error" and bad.judge_error == "no json"


def test_embed_keeps_every_row_and_isolates_failures(spark):
    texts = ["ab", None, "bad", "", "abb", "nan", "b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)

    def make():
        def encode(batch):
            if "bad" in batch:
                raise RuntimeError("refused")
            return [[float(t.count("a")), float(t.count("b")) if t != "nan" else float("nan")] for t in batch]

        return encode

    rows = {r.id: r for r in embed(df, "text", "v", make, 2).collect()}
    assert len(rows) == len(texts)
    assert all(abs(x - 0.5**0.5) < 1e-12 for x in rows[0].v) and rows[0].v_error is None and rows[6].v == [0.0, 1.0]
    assert rows[1].v is None and rows[1].v_error == "no text"
    assert rows[2].v is None and rows[2].v_error == "RuntimeError: refused"
    assert rows[3].v == [0.0, 0.0] and rows[3].v_error is None
    assert abs(rows[4].v[1] - 2 / 5**0.5) < 1e-12
    assert rows[5].v is None and rows[5].v_error == "ValueError: not finite"


def test_embed_reports_a_wrong_shape_and_takes_no_rows(spark):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, text string")
    out = embed(df, "text", "v", lambda: lambda batch: [[1.0]] * len(batch), 3)
    assert [(r.v, r.v_error) for r in out.orderBy("id").collect()] == [(None, "ValueError: shape (1, 1), not (1, 3)"), (None, "no text")]
    assert embed(df.where("false"), "text", "v", lambda: lambda batch: [[1.0]] * len(batch), 1).collect() == []
