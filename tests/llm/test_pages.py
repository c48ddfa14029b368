"""Main text of pages written by hand, apart from the rule that makes the labelled table."""

import pytest

from quire.llm.html_extract import main_text

LONG = "The river had been rising since the early morning and by noon the water stood at the second step of the old mill, where nobody had seen it in forty years."
MORE = "In the village people carried their chairs and carpets upstairs, called their cats, and then stood at the windows with nothing left to do but watch."
NAV = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/a>About us</a></li></ul></nav>"
FOOT = "<footer><p>Copyright 2024 The Daily Paper. All rights reserved.</p><a href=/p>Privacy</a></footer>"

PAGES = {
    "one paragraph": ("<body><p>Hello world.</p></body>", ["Hello world."]),
    "bare paragraph": ("<p>Just this.", ["Just this."]),
    "unmarked heading and prose": (f"<body><h1>A flood</h1><p>{LONG}</p><p>{MORE}</p></body>", ["A flood", LONG, MORE]),
    "three paragraphs of fifteen words": ("<h1>On walking</h1>" + "<p>one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen</p>" * 3, ["On walking"] + ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen"] * 3),
    "short paragraph between long ones": (f"<p>{LONG}</p><p>It was not.</p><p>{MORE}</p>", [LONG, "It was not.", MORE]),
    "unmarked heading, list and prose": (f"<h1>Bread</h1><ul><li>flour</li><li>water and salt</li></ul><p>{LONG}</p><p>{MORE}</p>", ["Bread", "flour", "water and salt", LONG, MORE]),
    "unmarked with menu and footer": (f"{NAV}<h1>A flood</h1><p>{LONG}</p><p>Yes.</p>{FOOT}", ["A flood", LONG, "Yes."]),
    "unmarked quotation": (f"<p>{LONG}</p><blockquote>Nothing lasts.</blockquote><p>{MORE}</p>", [LONG, "Nothing lasts.", MORE]),
    "unmarked caption": (f"<p>{LONG}</p><figure><img src=x><figcaption>The mill in spring</figcaption></figure><p>{MORE}</p>", [LONG, "The mill in spring", MORE]),
    "unmarked advert": (f"<p>{LONG}</p><div class=ad>Buy boats now, cheap and dry.</div><p>{MORE}</p>", [LONG, MORE]),
    "unmarked cookie notice": (f"<div class=cookie-banner><p>We use cookies to make this site work better for you.</p></div><p>{LONG}</p>", [LONG]),
    "unmarked form": (f"<p>{LONG}</p><form><p>Write to us about this story.</p><input></form>", [LONG]),
    "text in a div": (f"<body><div>{LONG} {MORE}</div></body>", [f"{LONG} {MORE}"]),
    "scripts and styles": (f"<head><title>T</title><style>p{{color:red}}</style><script>var a='<p>no</p>'</script></head><body><p>{LONG}</p></body>", [LONG]),
    "article": (f"{NAV}<article><h1>A flood</h1><p>{LONG}</p><p>{MORE}</p></article>{FOOT}", ["A flood", LONG, MORE]),
    "article of one line": (f"{NAV}<article><p>No news today.</p></article>{FOOT}", ["No news today."]),
    "article with linked items": (f"<article><h1>Sources</h1><p>{LONG}</p><ul><li><a href=1>The mill book</a></li><li><a href=2>Annals of the river</a></li></ul><p>{MORE}</p></article>", ["Sources", LONG, "The mill book", "Annals of the river", MORE]),
    "article with search results explained": (f"<article><p>{LONG}</p><div class='search-results-explained'>{MORE}</div></article>", [LONG, MORE]),
    "article with formula": (f"<article><p>So <math><mi>a</mi><mo>=</mo><mn>2</mn></math> holds. {LONG}</p></article>", [f"So a=2 holds. {LONG}"]),
    "article with aside": (f"<article><p>{LONG}</p><aside><p>More on rivers and mills in our long archive.</p></aside><p>{MORE}</p></article>", [LONG, MORE]),
    "article with advert": (f"<article><p>{LONG}</p><div class=advertisement><p>Boats, dry and cheap, at the harbour.</p></div><p>{MORE}</p></article>", [LONG, MORE]),
    "article with comments": (f"<article><p>{LONG}</p></article><section id=comments><h2>Comments</h2><p>I liked this piece a lot, thank you for it.</p></section>", [LONG]),
    "article with share bar": (f"<article><p>{LONG}</p><div class=share><a>Tweet</a> <a>Mail</a></div></article>", [LONG]),
    "article with quotation and caption": (f"<article><p>{LONG}</p><blockquote>Nothing lasts, said the miller.</blockquote><figure><figcaption>His mill</figcaption></figure><p>{MORE}</p></article>", [LONG, "Nothing lasts, said the miller.", "His mill", MORE]),
    "article with subheadings": (f"<article><h1>A</h1><p>{LONG}</p><h2>Later</h2><p>{MORE}</p><h3>At last</h3><p>It fell.</p></article>", ["A", LONG, "Later", MORE, "At last", "It fell."]),
    "article with table": (f"<article><p>{LONG}</p><table><tr><th>Year</th><td>Metres</td></tr></table><p>{MORE}</p></article>", [LONG, "Year", "Metres", MORE]),
    "article with header": (f"<article><header><h1>A flood</h1></header><p>{LONG}</p></article>{FOOT}", ["A flood", LONG]),
    "main element": (f"{NAV}<main><h1>A flood</h1><p>{LONG}</p></main>{FOOT}", ["A flood", LONG]),
    "div of class post": (f"{NAV}<div class=post><h1>A flood</h1><p>{LONG}</p><p>{MORE}</p></div><div class=sidebar><p>Popular stories of this week and the last.</p></div>", ["A flood", LONG, MORE]),
    "body with layout classes": (f"<body class='right-sidebar single'><article><p>{LONG}</p></article></body>", [LONG]),
    "links inside prose": (f"<article><p>{LONG} See <a href=x>the old maps</a> for more.</p></article>", [f"{LONG} See the old maps for more."]),
    "entities": (f"<article><p>Fish &amp; chips &mdash; &#8364;5.</p><p>{LONG}</p></article>", ["Fish & chips — €5.", LONG]),
    "white space": ("<article><p>a  b\n\tc</p><p>  d </p></article>", ["a b c", "d"]),
    "line breaks": (f"<article><p>One<br>two<br/>three</p><p>{LONG}</p></article>", ["One two three", LONG]),
    "hidden": (f"<article><p>{LONG}</p><div hidden><p>Not shown to anybody who reads this.</p></div></article>", [LONG]),
    "comment in markup": (f"<article><!-- <p>no</p> --><p>{LONG}</p></article>", [LONG]),
    "unclosed paragraphs": (f"<article><p>{LONG}<p>{MORE}<p>End.</article>{FOOT}", [LONG, MORE, "End."]),
    "nested inline markup": (f"<article><p><b>The <i>river</i></b> rose. {LONG}</p></article>", [f"The river rose. {LONG}"]),
    "numbered list": (f"<article><p>{LONG}</p><ol><li>Fill the bags.</li><li>Bar the door.</li></ol></article>", [LONG, "Fill the bags.", "Bar the door."]),
    "preformatted": (f"<article><p>{LONG}</p><pre>make all</pre><p>{MORE}</p></article>", [LONG, "make all", MORE]),
    "newsletter box": (f"<article><p>{LONG}</p><div class=newsletter-signup><p>Get the best of our stories by mail each day.</p></div></article>", [LONG]),
    "breadcrumbs": (f"<div class=breadcrumbs><a>Home</a> <a>News</a></div><article><h1>A flood</h1><p>{LONG}</p></article>", ["A flood", LONG]),
    "only a menu": (f"<body>{NAV}{FOOT}</body>", []),
    "nothing": ("<html><body></body></html>", []),
}


@pytest.mark.parametrize("name", PAGES)
def test_page(name):
    markup, want = PAGES[name]
    assert main_text(markup) == "\n\n".join(want)
