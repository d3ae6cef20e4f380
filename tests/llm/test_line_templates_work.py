"""Work of the line templates: what is compared, and what the driver's plans hold."""

from __future__ import annotations

from barlight.llm import line_templates
from tests.llm.test_text_operators import docs, unlike

PASSAGE = "A passage that many texts of all kinds hold in them"


def test_a_plan_holds_no_table_of_hashes(spark, monkeypatch):
    longest, durable = [], line_templates.durable

    def measured(df):
        longest.append(len(df._jdf.queryExecution().toString()))
        return durable(df)

    monkeypatch.setattr(line_templates, "durable", measured)
    rows = [(i, f"{unlike(i, 0)}\n{PASSAGE}\n{unlike(i, 1)}") for i in range(8)]
    out = line_templates.drop_recurring_lines(docs(spark, rows))
    assert {r["text"] for r in out.collect()} == {f"{unlike(i, 0)}\n{unlike(i, 1)}" for i in range(8)}
    assert max(longest) < 150_000  # with the bitmap as a constant: its 131,072 words, again and again


def test_first_texts_settle_a_template_and_all_texts_the_others(spark, monkeypatch):
    compared, apart = [], line_templates.apart

    def counted(left, texts):
        compared.append(left.count())
        return apart(left, texts)

    monkeypatch.setattr(line_templates, "apart", counted)
    rows = [(i, f"{unlike(i, 0)}\n{PASSAGE}\n{unlike(i, 1)}") for i in range(40)]
    got = line_templates.drop_recurring_lines(docs(spark, rows)).collect()
    assert all(r["n_dropped"] == 1 for r in got)
    assert max(compared) <= line_templates.FIRST  # all 40 before

    base = [unlike(50, k) for k in range(5)]
    near = [(100 + i, "\n".join([*base[:3], base[3].replace(base[3].split()[3], f"edit{'abcdefghijklmnop'[i]}"), PASSAGE, base[4]])) for i in range(12)]  # more than FIRST, of more lines than the others
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, [*near, *rows[:2]])).collect()}
    assert all(PASSAGE not in got[i] for i in (0, 1, *range(100, 112)))
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring_lines(docs(spark, [*near, rows[0]])).collect()}
    assert all(PASSAGE in text for text in got.values())  # two texts that are no near copies don't make it recur


def test_masks_take_each_token_with_a_digit(spark):
    lines = {"": "", " ": "", "a1b2 c": "<*> c", "é9 x": "<*> x", "\ta 1": "a <*>", "a\x0b2\x0c3": "a <*> <*>", "  1  2 x3y  ": "<*> <*> <*>", "x\t": "x", "no digit": "no digit", "9": "<*>", "a1 b\rc": "<*> b c"}
    rows = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_templates.masked(line_templates.F.col("line")).alias("mask")).collect()
    assert {r["line"]: r["mask"] for r in rows} == lines
