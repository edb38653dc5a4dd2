from siltstone.operators import answers


def test_profile_of_more_statements_than_a_stack_has_frames(spark):
    """12,000 statements: the budget of the field cuts them, and the pattern that does so doesn't recurse."""
    rows = spark.sql("SELECT 1 AS entity_id, 's' AS school, 'a b' AS org, '' AS title, CAST(NULL AS string) AS bio, transform(sequence(1, 12000), x -> concat('w', x)) AS statements, array('t') AS topics, CAST(array() AS array<string>) AS publications")
    r = answers.semantic_profile(rows).first()
    lines = r.profile.split("\n")
    assert lines[:2] == ["学校：s", "学院：a b"] and lines[2:2050] == [("研究方向原文：" if i == 1 else "") + f"w{i}" for i in range(1, 2049)] and lines[2050:] == ["规范主题：t"]
    assert r.n_tokens == len(r.profile.split())


def test_fields_within_tokens_share_a_worker(spark):
    """Each evaluation in the plan is a worker a task, with a tokenizer of its own: one for all fields, one for the whole, one for the count."""
    import public_tokenizers

    rows = spark.sql("SELECT 1 AS entity_id, 's' AS school, 'a b' AS org, '教授' AS title, 'b' AS bio, array('x', 'y') AS statements, array('t') AS topics, array('p') AS publications")
    made = answers.semantic_profile(rows, tokenizer=public_tokenizers.path("byte_bpe_50k.json"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") <= 4  # with NFKC
    assert made.first().profile.split("\n") == ["学校：s", "学院：a b", "职称：教授", "研究方向原文：x", "y", "规范主题：t", "代表成果：p", "简介：b"]
