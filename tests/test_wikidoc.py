import json
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import wikidoc

NOW = date(2024, 6, 15)
TEXT = """{{Infobox scientist
| name = Ada ''L''
| birth_date = {{birth date|1815|12|10}}
| site = {{URL|https://www.example.org/x}}
}}
'''Ada''' was a [[mathematician]]s' friend.<ref name="a">{{cite web|title=T|last=B|first=C|year=1999|access-date=2 May}}</ref> She met Dr. Who. {{coord|10|30|N|20|15|W|display=title}}
[[File:A.jpg|thumb|200px|alt=pic|With [[B|bee]]]] More <ref>plain [[x]]</ref> text.<ref name="a" />
== Life ==
* one
* two
{| class="wikitable"
|+ cap
! Year !! Place
|-
| rowspan="2" | 1999 || [[P|Q]]
|-
| R
|}
=== Later ===
See [https://x.org site] and [[Page#part|there]].
== References ==
[[Category:People|Ada]]
"""


def said(t):
    return wikidoc.parse_document("T", t, NOW)["sections"][0]["text"]


def test_document():
    d = wikidoc.parse_document(None, TEXT, NOW)
    assert d["title"] == "Ada" and d["categories"] == ["People"] and not d["disambiguation"] and d["redirect"] is None
    assert d["infoboxes"] == [{"type": "scientist", "data": {"name": "Ada L", "birth_date": "December 10, 1815", "site": "example.org"}}]
    assert d["tables"] == [[{"Year": "1999", "Place": "Q"}, {"Year": "1999", "Place": "R"}]]
    assert [r["type"] for r in d["references"]] == ["web", "inline", "web"] and d["references"][2]["author"] == "B, C" and d["references"][1]["inline"] == "plain x"
    assert d["images"] == [{"file": "A.jpg", "format": "thumb", "size": "200px", "alt": "pic", "caption": "With bee"}]
    assert [(s["title"], s["depth"]) for s in d["sections"]] == [("", 0), ("Life", 0), ("Later", 1)]
    assert d["coordinates"] == [{"lat": 10.5, "lon": -20.25}] and d["sections"][1]["text"] == "• one\n• two"
    assert [(x.get("page"), x.get("anchor"), x["text"]) for x in d["links"]] == [("mathematician", None, "mathematicians"), (None, None, "site"), ("Page", "part", "there")]
    assert d["summary"].startswith("Ada was a mathematicians' friend.")


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{convert|5|km|mi}}", "5 km"), ("{{frac|1|2|3}}", "1 2/3"), ("{{val|12345|u=m}}", "12,345 m"), ("{{sortname|A|B}}", "A B"), ("{{hlist|a|b||c}}", "a, b, c"),
        ("{{age|2000|7|1}}", "23"), ("{{diff-ymd|2000|1|20|2001|3|10}}", "1 years, 1 months, 20 days"), ("{{as of|2020|5}}", "As of May 2020"), ("{{currentyear}}", "2024"),
        ("{{nowrap|{{lang|fr|été}}}}", "été"), ("a{{ndash}}b", "a–b"), ("{{US$|5}}", "US$5"), ("{{round|2.5}} {{round|-2.5}}", "3 -2"), ("{{percentage|1|3|2}}", "33.33%"),
        ("{{plural|1|cat}} {{plural|2|cat}}", "1 cat 2 cats"), ("{{ord|21}} {{ord|12}}", "21st 12th"), ("{{unknown|x}}z", "z"), ("{{min|3|2}} {{max|3|2}}", "2 3"), ("{{open", "{{open"),
        ("{{formatnum|1234567}}", "1,234,567"), ("{{century|1815}}", "19"), ("x &amp; <b>y</b>", "x & y"), ("", ""),
    ],
)
def test_templates(text, want):
    assert said(text) == want


def test_redirect_and_disambiguation():
    assert wikidoc.parse_document("T", "#REDIRECT [[Other page#s]]", NOW)["redirect"] == "Other page"
    assert wikidoc.parse_document("T (disambiguation)", "", NOW)["disambiguation"] and wikidoc.parse_document("T", "T may refer to:\n* a", NOW)["disambiguation"]


def test_sentences():
    assert wikidoc.sentences("Mr. X met J. Doe. They left! Did they? Yes") == ["Mr. X met J. Doe.", "They left!", "Did they?", "Yes"]


@pytest.mark.parametrize("text", ["{{" * 20_000, "[[" * 5_000, "<ref>" * 5_000, "{|\n" * 5_000, "{{a|" * 5_000 + "}}" * 5_000, "[[File:" * 200, "'" * 20_000, "=" * 20_000])
def test_pathological(text):
    began = time.time()
    wikidoc.parse_document("T", text, NOW)
    assert time.time() - began < 2


def test_column(spark):
    df = spark.createDataFrame([(1, "T", TEXT), (2, None, None)], "id int, title string, w string").withColumn("d", wikidoc.document(F.col("title"), F.col("w"), NOW))
    one, none = df.orderBy("id").select("d", wikidoc.infobox_field(wikidoc.infobox_of(F.col("d.infoboxes"), "scien"), "Birth-date").alias("b")).collect()
    assert none["d"] is None and one["b"] == "December 10, 1815" and one["d"]["markdown"].startswith("# T\n") and json.loads(one["d"]["json"])["title"] == "T"


@pytest.mark.parametrize("piece", ["{{", "[[File:a", "{{a|", "[[File:a|[[b]]"])
def test_unclosed_markup_grows_in_proportion(piece):
    """Ten times the markup takes about ten times as long, not a hundred."""
    took = []
    for n in (1000, 10_000):
        begun = time.process_time()
        wikidoc.parse_document("T", piece * n, NOW)
        took.append(time.process_time() - begun)
    assert took[1] < 40 * took[0] + 0.2


def test_long_image():
    text = "a [[File:x.png|thumb|" + "long caption [[link]] " * 1000 + "]] b"
    found = wikidoc.parse_document("T", text, NOW)
    assert len(found["images"]) == 1 and "caption" not in found["sections"][0]["text"]
