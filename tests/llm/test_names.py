"""Names of classes on pages, and names of columns that operators must keep."""

import pytest
from cases import documents

from tidewheel.llm import exact_dedup, html_extract, jaccard_join

LONG = "A long paragraph about the budget of the city, which was passed on Monday after a long debate in the council."


@pytest.mark.parametrize("names", ['class="post hentry tag-politics category-social"', 'id="content" class="comments-open"', 'class="single-post has-sidebar no-comments"', 'class="page-template-login-free"'])
def test_names_that_say_something_about_an_article_keep_its_text(names):
    for tag in ("article", "div"):
        assert html_extract.extract(f"<{tag} {names}><p>{LONG}</p><p>{LONG}</p></{tag}>")[0] == f"{LONG}\n{LONG}"


@pytest.mark.parametrize("names", ['class="comment-list"', 'id="comment-42"', 'class="widget sidebar-left"', 'class="site-footer"', 'class="cookie-notice"', 'class="ad-slot-3"', 'class="social_share"', 'role="navigation"'])
def test_names_of_parts_beside_the_article_drop_theirs(names):
    assert html_extract.extract(f"<article><p>{LONG}</p><p>{LONG}</p></article><div {names}><p>{LONG} Other.</p></div>")[0] == f"{LONG}\n{LONG}"


def test_text_in_formulas_and_literal_text_stays():
    page = f"<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TEX</annotation></math> be so. {LONG}</p><object data=x><p>{LONG}</p></object><xmp><b>literal &amp; whole, long enough to stay on any page</b></xmp><p>{LONG}</p>"
    assert html_extract.extract(page)[0] == f"Let x=2 be so. {LONG}\n{LONG}\n<b>literal &amp; whole, long enough to stay on any page</b>\n{LONG}"


def test_columns_of_any_name_are_kept(spark):
    docs = documents(spark).selectExpr("doc_id", "text", "lang as _name", "source as `_name_`", "n as `a``b`", "score as _kept")
    for got in (jaccard_join.drop_near_copies(docs), exact_dedup.drop_exact_copies(docs)):
        assert got.dtypes == docs.dtypes and 0 < got.count() < docs.count()
