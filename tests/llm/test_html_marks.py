"""Which class and id words drop what lies inside, by plain cases."""

import pytest

from tidemill.llm.html import BlockRules, main_text

TALK = "I was at the place and it is the best of all that we have for you, said the one who was with us in it on that day. " * 2
STORY = "The council has said that it will be the first of its kind to build a bridge of this size over the river in the north. " * 3


@pytest.mark.parametrize(
    "tag",
    [
        "div class='user-comments'", "div class='fb-comments'", "div class='c-comments'", "section id='reader-comments'", "li class='comment-body'", "div class='l-sidebar'", "div class='blog-sidebar'", "div class='cookie-policy-banner'", "div class='ad-300x250'", "div class='google-ads'",
        "div class='mobile-menu'", "article class='comment'", "article class='comment-item' id='c17'", "div class='commentList'", "div class='PostComments'", "div class='article__comments'", "div class='newsletter-box-wide'", "ol class='disqus_thread'", "div class='sidebar-right'", "div class='top-nav'",
        "div class='x' role='complementary'", "div class='adslot_3'", "div class='story-footer'", "div class='comment__text'",
    ],
)
@pytest.mark.parametrize("times", [1, 6])
def test_marked_parts_go(tag, times):
    """Inside the article and beside it, even if the part is longer than the article."""
    name = tag.split()[0]
    part = f"<{tag}>" + f"<p>{TALK}</p>" * (times if "omment" in tag or "disqus" in tag else 1) + f"</{name}>"
    want = f"Title\n\n{STORY.strip()}"
    assert main_text(f"<body><article><h1>Title</h1><p>{STORY}</p>{part}</article></body>", BlockRules()) == want
    assert main_text(f"<body><article><h1>Title</h1><p>{STORY}</p></article>{part}</body>", BlockRules()) == want


@pytest.mark.parametrize(
    "tag",
    [
        "div class='no-sidebar'", "div class='with-ads'", "article class='post comments-open'", "article class='post has-sidebar'", "div class='comments-closed'", "div class='layout-sidebar-left'", "div class='side-effects'", "div class='ad-hoc'", "div class='alert-free'",
        "div class='read-and-share'", "main class='comments'", "div class='story-body'", "div id='commentary'", "div class='menuet'", "div class='page-theme-widget'",
    ],
)
def test_what_only_looks_marked_stays(tag):
    name = tag.split()[0]
    assert main_text(f"<body><{tag}><p>{STORY}</p></{name}><p>{STORY}</p><p>{STORY}</p></body>", BlockRules()) == "\n\n".join([STORY.strip()] * 3)


def test_a_wrapper_with_a_marked_class_stays():
    page = f"<div class='my-sidebar'><article><p>{STORY}</p></article></div><p>x</p>"
    assert STORY.strip() in main_text(page, BlockRules())
    page = f"<div class='app-comments'><article><p>{STORY}</p><div class='app-comments'><p>{TALK}</p></div></article></div>"
    assert main_text(page, BlockRules()) == STORY.strip()
