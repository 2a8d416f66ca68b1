import html

from hypothesis import HealthCheck, given, settings, strategies as st

from secretsift.functions.masking import mask
from secretsift.functions.text import strip, strip_tags, unescape_html

QUIET = dict(deadline=None, max_examples=6, suppress_health_check=list(HealthCheck))

PIECES = st.sampled_from([
    "&amp;", "&amp", "&lt;", "&gt", "&quot;", "&#39;", "&#x27;", "&#0;", "&#128;", "&#x80", "&#129;",
    "&#xD800;", "&#1114112;", "&#99999999999999999999;", "&#11;", "&#xFFFE;", "&#65", "&#x41;", "&#;",
    "&#x;", "&notin;", "&notit;", "&not", "&copycat", "&nosuch;", "&", "&&", "&;", "&zwnj;", "&NotEqualTilde;",
    "&eacute;", "&Eacute", "a", "b;", " ", "<", "#", "é", "&#00065;", "&#128512;", "&apos;", "&hearts;",
])
TEXTS = st.lists(st.lists(PIECES, max_size=6).map("".join), min_size=150, max_size=150)


@settings(**QUIET)
@given(texts=TEXTS)
def test_unescape_equals_html_rules(apply, texts):
    assert apply(unescape_html, texts) == [html.unescape(t) for t in texts]


def test_unescape_every_named_reference(apply):
    names = sorted(html.entities.html5)
    texts = [f"x&{n}y" if n.endswith(";") else f"x&{n} y" for n in names]
    assert apply(unescape_html, texts) == [html.unescape(t) for t in texts]


def test_strip_equals_python(apply):
    texts = ["\x1c a　", "\xa0\tb \n", "c", "", "   "]
    assert apply(strip, texts) == [t.strip() for t in texts]


def test_strip_tags(apply):
    assert apply(strip_tags, ["<a href='x'>a&amp;b</a> c", "plain"]) == ["a&b c", "plain"]


@settings(**QUIET)
@given(values=st.lists(st.text(min_size=1, max_size=60), min_size=100, max_size=100))
def test_mask_never_shows_the_value(apply, values):
    for value, shown in zip(values, apply(mask, values)):
        head = shown[:-3]
        assert shown.endswith("***") and value.startswith(head)
        assert len(head) <= min(4, len(value) // 4)
