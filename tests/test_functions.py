"""Text, label and vector functions on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from reminis.functions import formats as fm
from reminis.functions import text as tx
from reminis.functions import vectors as vx


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_tokens_have_ascii_boundaries(spark):
    text = F.lit("Café foo_bar don't schön x9 ÄRGER naïve")
    assert value(spark, tx.raw_tokens(text)) == ["caf", "don", "t", "sch", "n", "x9", "rger", "na", "ve"]
    assert value(spark, tx.tokenize(F.lit("What is the dark mode of us"))) == ["dark", "mode"]
    assert value(spark, tx.rerank_tokens(F.lit("dark us dark"))) == ["dark", "us"]
    assert value(spark, tx.tokenize(F.lit(""))) == []


def test_sections(spark):
    assert value(spark, tx.sections(F.lit("pre\n## A\nbody a\n### sub\n## B\nbody b\n"))) == ["## A\nbody a\n### sub\n", "## B\nbody b\n"]
    assert value(spark, tx.sections(F.lit("no headings"))) == ["no headings"]
    assert value(spark, tx.sections(F.lit("## A\nx"))) == ["## A\nx"]


@pytest.mark.parametrize(("text", "kind"), [("the latest thing", "recency"), ("used   to", "historical"), ("now, in history", "recency"), ("currently", "default"), ("", "default")])
def test_intent(spark, text, kind):
    assert value(spark, tx.intent(F.lit(text))) == kind


def test_stripping(spark):
    assert value(spark, tx.strip_blocks(F.lit("[MEMORY]\na\n[/MEMORY] What is it? [MEMORY][/MEMORY]\n"))) == "What is it?"
    prompt = 'Sender (untrusted metadata):\n```json\n{"a": 1}\n```\n\nCan you tell me?'
    assert value(spark, tx.strip_envelope(F.lit(prompt))) == "Can you tell me?"
    assert value(spark, tx.strip_envelope(F.lit("[12:00] [chat] "))) is None
    assert value(spark, tx.join_blocks(F.array(F.lit(" a "), F.lit("  "), F.lit("b\n")))) == "a b"


def test_exchange_hash(spark):
    text = tx.exchange_text(F.lit("a"), F.lit("b"))
    assert value(spark, F.sha2(text, 256)) == "29cd8bc81fe1becd7a343abad3f5e897209d02685ae0c299c12ef143f90c7e92"


@pytest.mark.parametrize(
    ("document", "result"),
    [("", "<b>\nnew\n<e>\n"), ("x", "x\n\n<b>\nnew\n<e>\n"), ("a <b>old<e> z", "a <b>\nnew\n<e> z"), ("<e> <b>\n", "<e> <b>\n\n<b>\nnew\n<e>\n")],
)
def test_upsert_section(spark, document, result):
    assert value(spark, tx.upsert_section(F.lit(document), F.lit("new"), "<b>", "<e>")) == result


@pytest.mark.parametrize(
    ("days", "label"),
    [(0, "today"), (0.99, "today"), (1.99, "yesterday"), (2, "2 days ago"), (6.9, "6 days ago"), (13.9, "1 week ago"), (14, "2 weeks ago"), (21, "3 weeks ago"),
     (59, "1 month ago"), (60, "2 months ago"), (90, "3 months ago"), (729, "1 year ago"), (730, "2 years ago"), (1095, "3 years ago"), (-1, "today")],
)
def test_age_label(spark, days, label):
    assert value(spark, fm.age_label(F.lit(float(days)))) == label


def test_labels(spark):
    assert value(spark, fm.elapsed_label(F.lit(1))) == "1 second ago"
    assert value(spark, fm.elapsed_label(F.lit(7200))) == "2 hours ago"
    assert value(spark, fm.elapsed_label(F.lit(86400))) == "1 day ago"
    assert value(spark, fm.bytes_label(F.lit(1023))) == "1023 B"
    assert value(spark, fm.bytes_label(F.lit(1536))) == "1.5 KB"
    assert value(spark, fm.tier(F.lit(0.065))) == "[HIGH]"
    assert value(spark, fm.rounded_tenth(F.lit(-0.25))) == -0.2
    assert value(spark, fm.confidence_of(F.lit("other"))) == 0.95
    assert value(spark, fm.decay_lambda(F.lit(None).cast("string"))) == 0.005


def test_decay(spark):
    at = {d: value(spark, fm.decay(F.lit(0.012), F.lit(float(d)))) for d in (0, 30, 90)}
    assert at[0] == 1 and 0.6 < at[30] < 0.7 and 0.33 < at[90] < 0.35


def test_cosine(spark):
    a, b, zero = (F.array(*[F.lit(x).cast("float") for x in v]) for v in ((1, 0), (0.6, 0.8), (0, 0)))
    assert value(spark, vx.cosine_distance(a, b)) == pytest.approx(0.4)
    assert math.isnan(value(spark, vx.cosine_distance(a, zero)))
    assert math.isnan(value(spark, vx.cosine_distance(a, F.lit(None).cast("array<float>"))))
    assert value(spark, vx.is_zero(zero)) and not value(spark, vx.is_zero(b))
    with pytest.raises(Exception, match="different lengths"):
        value(spark, vx.cosine_distance(a, F.array(F.lit(1.0).cast("float"))))


def test_append_section(spark):
    assert value(spark, tx.append_section(F.lit("a"), "## M\n", "## M")) == "a\n\n## M\n"
    assert value(spark, tx.append_section(F.lit("## M"), "## M\n", "## M")) == "## M"
