"""Pages whose markup leaves out end tags keep the text that follows."""

import pytest

from siltstream.llm.html import blocks, default_field, main_text

STORY = "<article><p>The story goes on and on.</p></article>"


@pytest.mark.parametrize(
    "before",
    [
        "<html><head><title>T</title><body>",
        "<html><head><meta charset=utf-8><style>p{}</style><script>a<b</script>",
        "<head><title>T</title></head><body><svg viewBox='0 0 1 1'/>",
        "<body><math/>",
        "<body><svg><title>Icon</title><g/></svg>",
        "<body><iframe src=x>",
        "<body><noscript>",
        "<body><object data=x>",
        "<body><video src=x>",
        "<body><audio src=x/>",
        "<body><canvas id=c>",
        "<body><template>",
        "<body><script src='x.js'/>",
        "<body><object>no<object>no</object>no</object>",
    ],
)
@pytest.mark.parametrize("after", ["", "<iframe src=y></iframe><svg><path d=x></svg><video></video><script>b()</script><noscript>no</noscript><object>no</object>"])
def test_text_after_open_elements_stays(before, after):
    assert main_text(before + STORY + after, default_field()) == "The story goes on and on."


def test_head_ends_at_its_first_other_content():
    assert [(b.path, b.text) for b in blocks("<html><head><title>T</title> Text <b>is</b> here.<p>More</p>")] == [(("html",), "Text is here."), (("html", "p"), "More")]
    assert [(b.path, b.text) for b in blocks("<html><head><meta name=x><p>Text")] == [(("html", "p"), "Text")]


def test_code_is_never_text():
    assert [b.text for b in blocks("<p>One</p><script>var a = '<script>';</script><p>Two</p><script src=http://x/>code</script><script>b <p>c</p>")] == ["One", "Two"]
    assert [b.text for b in blocks("<svg><script>'<svg>'</script><!-- <svg> --><text>no</text></svg><p>Yes</p>")] == ["Yes"]


def test_many_open_elements_take_linear_time():
    page = "<svg><video><iframe><noscript><object>" * 20000 + "<p>Text"
    assert [b.text for b in blocks(page)] == ["Text"]
