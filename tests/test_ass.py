"""ASS/SSA scripts, event text, and options."""

import pytest
from pyspark.sql import functions as F

from cueframe.functions import ass_text
from cueframe.operators.ass import parse_ass, write_ass
from cueframe.plans.options import AssOptions, CueOptions, EventFormat, SrtOptions

HEAD = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
LINE = "Dialogue: 0,0:00:01.00,0:00:02.00,Default,A,0,0,0,,Hello, world\n"


def parsed(spark, content, options=AssOptions()):
    return parse_ass(spark.createDataFrame([(1, content)], "doc_id int, content string"), options)


def test_round_trip(spark):
    content = HEAD + "; no comment\n".replace("; ", ";") + LINE + "Comment: 1,0:00:01.00,100:00:02.00,,,0,0,0,,\n\n[Fonts]\nfontname: a\n;M`:x\n"
    assert write_ass(parsed(spark, content)).collect()[0]["content"] == content


@pytest.mark.parametrize("line,code", [("Dialogue: 0,bad,", "InvalidTimestamp.InvalidLength"), ("Dialogue: x,", "InvalidField(Layer)"), ("Dialogue: 0", "TooFewFields(10,1)"), ("words", "UnexpectedLine"), (": x", "UnexpectedLine"), ("[Open", "UnclosedSection")])
def test_errors_end_a_script(spark, line, code):
    got = parsed(spark, HEAD + line + "\n" + LINE).orderBy("ordinal").collect()
    assert got[-1]["error"] == code and not any(r["event"] for r in got)
    lossy = parsed(spark, HEAD + line + "\n" + LINE, AssOptions.lossy()).where("event is not null").collect()
    assert lossy[-1]["event"]["text"] == "Hello, world"


def test_missing_format(spark):
    assert parsed(spark, "[Events]\n" + LINE).where("error is not null").collect()[0]["error"] == "MissingFormat"
    assert parsed(spark, "[Events]\n" + LINE, AssOptions(allow_missing_format=True)).where("event is not null").collect()[0]["event"]["name"] == "A"


@pytest.mark.parametrize("text,want", [("a\\Nb\\hc", "a\nb\xa0c"), ("{\\i1}x{\\p1}m 0{\\p0}y", "xy"), ("c{d", "c{d"), ("\\{a\\}", "{a}"), ("a\\b", "a\\b"), ("{x}\\", "\\")])
def test_plain_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(ass_text.plain_text(F.col("t")).alias("p")).collect()[0]["p"] == want


def test_override_tags(spark):
    got = spark.createDataFrame([("x(\\b1)\\t(0,\\fs2)\\ iclip(1\\foo",)], "t string").select(ass_text.override_tags(F.col("t")).alias("o")).collect()[0]["o"]
    assert [(t["name"], t["args"], t["known"]) for t in got] == [("t", "(0,\\fs2)", True), ("iclip", "(1\\foo", True)]


def test_options():
    assert SrtOptions.from_json('{"ignore_orphan_text": true}') == SrtOptions(ignore_orphan_text=True)
    assert SrtOptions.from_json(SrtOptions.lossy().to_json()) == SrtOptions.lossy()
    assert CueOptions.from_json("{}").max_depth == 16
    with pytest.raises(ValueError):
        AssOptions.from_json('{"allow_short_event": 1}')
    f = EventFormat.declared("Text, Odd, actor, Name, Layer")
    assert f.columns == ("Text", None, None, "Name", "Layer") and EventFormat.from_json(f.to_json()) == f
    with pytest.raises(ValueError):
        EventFormat.from_json('{"slots": [5,null,null,null,null,null,null,null,null,null,null,null], "fields": 5}')
