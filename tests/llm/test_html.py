"""Main-text extraction on broken, nested and wrapped pages."""

import random
import time

import pytest

from corpuslab.llm import html_main

PIECES = (
    "< <div <p> </p> <nav> </nav> <![foo[ ]]> <!-- --> <!x <?pi &amp &#x &#99999999; <article> </article> text <a> </a> <form> <main> </main> <script> </script> \x00 <br/> "
    "<li> </ <![CDATA[ <!DOCTYPE [ ] > <title> <style> <textarea> <td> <div/> word &copy; <h1> <header> <aside> </aside> <body>"
).split(" ")


def test_no_page_fails():
    rnd = random.Random(3)
    for _ in range(3000):
        html_main.main_text("".join(rnd.choice(PIECES) + rnd.choice(("", " ")) for _ in range(rnd.randint(1, 40))))


def test_depth_costs_no_more_than_length():
    began = time.time()
    for html in ("<div class=menu>" * 20_000 + "text here" + "</div>" * 20_000, "<div><p>some text</p>" * 20_000):
        html_main.main_text(html)
    assert time.time() - began < 60


@pytest.mark.parametrize(
    "page, expected",
    [
        ("<form><h1>T</h1><p>Article text in a form, long enough.</p></form>", "T\n\nArticle text in a form, long enough."),
        ("<nav><a href=x>m</a><article><p>Swallowed by an unclosed nav.</p></article>", "Swallowed by an unclosed nav."),
        ("<aside><article><p>A card at the side, which is rather long.</p></article></aside><article><p>The text.</p><p>More of it, and more, and more.</p></article>", "The text.\n\nMore of it, and more, and more."),
        ("<article><p>Text of the article.</p><form><label>Mail</label></form></article><footer>f</footer>", "Text of the article."),
        ("<footer>All the words of this page are in its footer.</footer>", ""),
        ("<p>before <![foo[ x ]]> after</p>", "before after"),
        ("<article><h2>Head</h2><p>Long paragraph of an article with many words in it.</p><p>Hi.</p><table><tr><td>cell</td></tr></table></article>", "Head\n\nLong paragraph of an article with many words in it.\n\nHi.\n\ncell"),
        ("<body><div class=header>Site</div><div><h1>Title</h1><p>A body text that goes on for a while, without tags.</p></div><div class='related posts'><a>x</a></div></body>", "Title\n\nA body text that goes on for a while, without tags."),
        ("<article><p>One sentence of news.</p></article><div class=comments>" + "<p>What a reader has to say about that, at length.</p>" * 20 + "</div>", "One sentence of news."),
        ("<article><div class='article-header'><h1>Title</h1><p>Lead.</p></div><p>Text of the article, and more of it.</p></article>", "Title\n\nLead.\n\nText of the article, and more of it."),
        ("<div><div class=post-header><h1>Title</h1></div><p>Text of the post, which goes on for some time.</p></div>", "Title\n\nText of the post, which goes on for some time."),
        ("<article><header><h1>Title</h1></header><p>Text of the article, and more of it.</p></article>", "Title\n\nText of the article, and more of it."),
        ("<article><div class=ad-hoc-query><p>Asked now and then.</p></div><div class=related-work><p>Others did it too.</p></div><p class=social-science>A field.</p><p>Text, and more of it.</p></article>", "Asked now and then.\n\nOthers did it too.\n\nA field.\n\nText, and more of it."),
        ("<article><div class='ad slot-1'><p>Buy.</p></div><div id=adBanner>Buy now.</div><p>Text, and more of it.</p><div class='related-posts'><p>Else.</p></div><div class=post-comments><p>I say.</p></div></article>", "Text, and more of it."),
        ("<article><p>Intro <span class=share>share of market</span> text, and <em class=ad>more</em>.</p></article>", "Intro share of market text, and more."),
        ("<body><div><p>A long first paragraph that makes up nearly all of what is said on this page.</p><ul><li>first of the list</li><li>second</li></ul><p>End.</p></div></body>", "A long first paragraph that makes up nearly all of what is said on this page.\n\nfirst of the list\n\nsecond\n\nEnd."),
        ("<body><p>A long first paragraph that makes up nearly all of what is said on this page.</p><ul><li>first of the list</li><li>second</li></ul><p>End.</p><footer>f</footer></body>", "A long first paragraph that makes up nearly all of what is said on this page.\n\nfirst of the list\n\nsecond\n\nEnd."),
        ("<main><div class='site has-sidebar'><p>Text of the page, and more of it.</p><div class=comments><p>a</p></div><div class=comments><p>a</p></div></div></main>", "Text of the page, and more of it."),
        ("<div class=comments><article><p>A reader's own words, quite a few.</p></article></div><article><p>News.</p></article>", "News."),
        (None, ""),
        ("<div class=comments><p>Nothing but what readers say.</p></div>", "Nothing but what readers say."),
    ],
)
def test_labelled_pages(page, expected):
    assert html_main.main_text(page) == expected
