"""Templates as a table: added, replaced and removed without new code, applied by columns and in SQL."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import templates as tm

SHEET = tm.Template("order_sheet", (r"(?im)^order\b", r"(?im)^ship(?:ping|ment)\b"), (tm.Section("Order", (r"(?im)^order\b",), ("Topic",), True), tm.Section("Shipping", (r"(?im)^shipping\b",), ("Concept",))))
TEXTS = ["Order 7\nof many things, to be sent at once\nShipping by sea", "# Abstract\nWe study.\n# Introduction\nx\n# Methodology\ny\n# Results\nz", "short", None, "plain prose without any headings whatsoever, yet of a certain length"]


def detected(spark, known):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    return {r.id: (r.template, r.score) for r in tm.detect(df, "id", templates=known).collect()}


def test_a_table_of_templates(spark, tmp_path):
    path = str(tmp_path / "templates")
    tm.create_table(spark, path)
    assert tm.read_templates(spark, path) == tm.TEMPLATES
    before = detected(spark, tm.TEMPLATES)
    assert before[0][0] == "generic"
    tm.add_template(spark, path, SHEET)
    known = tm.read_templates(spark, path)
    assert known == (*tm.TEMPLATES, SHEET)
    after = detected(spark, known)
    assert after[0] == ("order_sheet", 1.0) and all(after[i] == before[i] for i in range(1, 5))
    changed = SHEET._replace(patterns=(r"(?im)^nowhere\b",) * 3)
    tm.add_template(spark, path, changed)
    assert tm.read_templates(spark, path)[-1] == changed and detected(spark, tm.read_templates(spark, path))[0] == ("order_sheet", 0.6)
    tm.remove_template(spark, path, "order_sheet")
    tm.remove_template(spark, path, "lecture_notes")
    assert tm.read_templates(spark, path) == tm.TEMPLATES[1:]
    tm.add_template(spark, path, SHEET)
    assert tm.read_templates(spark, path)[-1] == SHEET


@pytest.mark.parametrize("bad", [SHEET._replace(name=" "), SHEET._replace(name="generic"), SHEET._replace(patterns=()), SHEET._replace(sections=()), SHEET._replace(patterns=("(",)), SHEET._replace(sections=(tm.Section("S", (), ()),))])
def test_templates_that_are_not_whole_are_refused(spark, tmp_path, bad):
    path = str(tmp_path / "templates")
    tm.create_table(spark, path)
    with pytest.raises(ValueError, match="template|pattern"):
        tm.add_template(spark, path, bad)
    assert tm.read_templates(spark, path) == tm.TEMPLATES


def test_the_table_function_gives_the_same_scores(spark):
    known = (*tm.TEMPLATES, SHEET)
    tm.register_function(spark, known)
    spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").createOrReplaceTempView("texts_for_templates")
    got = {(r.id, r.template): r.score for r in spark.sql("SELECT id, d.* FROM texts_for_templates, LATERAL detect_templates(text) d").collect()}
    assert len(got) == len(TEXTS) * len(known)
    scores = [F.round(tm.score(F.coalesce("text", F.lit("")), t), 4).alias(t.name) for t in known]
    for r in spark.table("texts_for_templates").select("id", *scores).collect():
        assert {t.name: got[r.id, t.name] for t in known} == {t.name: r[t.name] for t in known}
    best = spark.sql("SELECT id, d.template FROM texts_for_templates, LATERAL detect_templates(text) d WHERE d.rank = 1 AND d.score > 0.3 ORDER BY id").collect()
    assert [(r.id, r.template) for r in best] == [(0, "order_sheet"), (1, "research_paper")]
