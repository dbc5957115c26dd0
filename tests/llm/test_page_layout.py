"""Cells over several rows and columns, inherited visibility, formulas, drawings and inputs."""

import pytest

from signalbook.llm import html_text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><td rowspan=2>aaaa<td>b<tr><td>c</table>", "aaaa | b\n     | c"),
        ("<table><tr><td>k<td rowspan=3>mm<td>z<tr><td>l<tr><td>m<td>y</table>", "k | mm | z\nl |\nm |    | y"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>wide<td>b<tr><td>c<td>d<tr><td>1<td>2<td>3<td>4</table>", "a | wide  | b\nc |       | d\n1 | 2 | 3 | 4"),
        ("<table><thead><tr><th rowspan=0>h<th>i</thead><tbody><tr><td>a<td>b</table>", "h | i\na | b"),
        ("<table><tr><td rowspan=x>a<td rowspan=-1>b<tr><td>c<td>d</table>", "a | b\nc | d"),
        ("<table><tr><td colspan=1000 rowspan=65534>q<td>w<tr><td>e</table>", "q | w\n | e"),
        ("<table><tr><td style='visibility:hidden'>xx<td>b<tr><td>a<td>c<tr style='visibility:collapse'><td>q<td>r</table>", "  | b\na | c"),
        ("<table style='visibility:hidden'><tr><td>n<td style='visibility:visible'>y</table>", " | y"),
        ("<div style='visibility:hidden'>no <b style='visibility: visible'>yes <i>too</i></b> no</div>z", "yes too\nz"),
        ("<div style='display:none'><b style='visibility:visible;display:block'>no</b></div>z", "z"),
        ("<p style='display:none;display:block'>a</p><p hidden style='display:block'>b</p><p style='x-display:none'>c</p>", "a\n\nb\n\nc"),
        ("See <math><mi>x</mi><mo>+</mo><mn>1</mn><annotation>no</annotation></math> here", "See x+1 here"),
        ("A<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><text>axis</text><text>label</text></svg>", "A axis label"),
        ("<input type=email value=a@b><input type=password value=p><input value=q><input type=NUMBER value=3><input type=checkbox value=on>", "a@b q 3"),
        ("<p style='visibility:hidden'><img alt=no><input value=no></p>z", "z"),
    ],
)
def test_layout(page, text):
    assert html_text.text_of_page(page) == text


def test_tables_in_tables_stay_aligned():
    inner = "<table><tr><td>x<td>1<tr><td>long<td>2</table>"
    page = inner
    for _ in range(30):
        page = f"<table><tr><td>{page}<td>r</table>"
    text = html_text.text_of_page(page)
    assert text.split("\n")[0].startswith("x    | 1 | r") and text.split("\n")[1].startswith("long | 2")
    assert html_text.text_of_page("<table><tr><td>" * 3000 + "x").strip() == "x"
