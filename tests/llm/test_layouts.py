"""Main text of pages written by hand in layouts that the generator does not make, and the field's gradient by finite differences."""

import numpy as np
import pytest

from skarn.llm import html_text

A = "The council met on Tuesday evening to decide on the new bridge over the river."
B = "Most of the members spoke in favour of the plan, though some asked for more time."
C = "Building is to begin in spring."
MENU = "<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li><li><a href=/s>Sport</a></li></ul></nav>"
FOOT = "<footer><p>&copy; 2024 The Daily Page. All rights reserved.</p></footer>"
SIDE = "<aside class=sidebar><h3>Most read</h3><ul><li><a href=1>Storm ahead</a></li><li><a href=2>Cup final</a></li></ul></aside>"
HEAD = "<!DOCTYPE html><html><head><title>t</title></head>"

PAGES = {
    "page-wide form": (f"{HEAD}<body><form id=f><div class=content><h1>News</h1><p>{A}</p><p>{B}</p></div></form></body></html>", ["News", A, B]),
    "body class": (f"{HEAD}<body class='sidebar-right'><div><h1>News</h1><p>{A}</p><p>{B}</p></div></body></html>", ["News", A, B]),
    "comments-open": (f"{HEAD}<body><div class='post comments-open'><h1>News</h1><p>{A}</p><p>{B}</p></div></body></html>", ["News", A, B]),
    "header in article": (f"{HEAD}<body>{MENU}<article><header><h1>Real headline</h1></header><p>{A}</p><p>{C}</p></article>{FOOT}</body></html>", ["Real headline", A, C]),
    "form around menu, article and footer": (f"{HEAD}<body><form method=post action='x.aspx' id=aspnetForm>{MENU}<div id=main><h1>Bridge</h1><p>{A}</p><p>{B}</p></div>{SIDE}{FOOT}</form></body></html>", ["Bridge", A, B]),
    "wrapper classes": (f"{HEAD}<body class='home page nav-fixed'><div id=wrap class='site has-sidebar menu-open'>{MENU}<div class='row'><div class='col content'><h1>Bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p></div><div class='col sidebar'><h3>Tags</h3><p><a href=/t>river</a></p></div></div>{FOOT}</div></body></html>", ["Bridge", A, B, C]),
    "comments after the article": (f"{HEAD}<body><div class='post comments-open'><article><h1>Bridge</h1><p>{A}</p><p>{B}</p></article><section class=comments><h3>2 comments</h3><div class=comment><p>I do not think that this bridge is needed at all, to be honest.</p></div><div class=comment><p>Well said!</p></div></section></div></body></html>", ["Bridge", A, B]),
    "nested wrappers": (f"{HEAD}<body><div class=outer><div class='inner ad-free'><div><div><main><h1>Bridge</h1><p>{A}</p><h2>Cost</h2><p>{B}</p><ul><li>steel and stone</li><li>work</li></ul></main></div></div></div></div>{FOOT}</body></html>", ["Bridge", A, "Cost", B, "steel and stone", "work"]),
    "section with lead": (f"{HEAD}<body><header class=masthead><div>The Daily Page</div></header>{MENU}<section class='article-body'><h1>Bridge</h1><p><strong>{C}</strong></p><p>{A}</p><blockquote>{B}</blockquote></section>{FOOT}</body></html>", ["Bridge", C, A, B]),
    "unclosed paragraphs": (f"{HEAD}<body>{MENU}<div class='entry-content'><h1>Bridge</h1><p>{A}<p>{B}<p>{C}</div>{FOOT}</body></html>", ["Bridge", A, B, C]),
    "search form above": (f"{HEAD}<body><form class=search><label>Search the site</label><input><button>Go</button></form>{MENU}<article><h1>Bridge</h1><p>{A}</p><p>{B}</p></article></body></html>", ["Bridge", A, B]),
    "cookie notice inside a wrapper": (f"{HEAD}<body><div id=page class='cookie-ok'><div class='cookie notice'><p>We use cookies to make this site work better for you.</p><button>OK</button></div><article><h1>Bridge</h1><p>{A}</p><p>{B}</p></article></div></body></html>", ["Bridge", A, B]),
    "links and inline marks": (f"{HEAD}<body><div class='l-page social-on'><article class=post><h1>The <em>new</em> bridge</h1><p>{A} <a href=/x>More on it</a>, by the way.</p><p>{B}</p></article><div class='share social'><a href=/f>Share</a> <a href=/t>Post</a></div></div></body></html>", ["The new bridge", f"{A} More on it, by the way.", B]),
    "only a menu and a footer": (f"{HEAD}<body>{MENU}{FOOT}</body></html>", []),
    "centered": (f"{HEAD}<body><center class='promo-page'><div class=main><article class=post><h1>Bridge</h1><p>{A}</p><p>{B}</p></article></div>{SIDE}</center></body></html>", ["Bridge", A, B]),
}


@pytest.mark.parametrize("name", sorted(PAGES))
def test_layout(name):
    page, want = PAGES[name]
    assert html_text.extract(page, html_text.default_model()).split("\n") == (want or [""])


def test_wrappers_change_nothing():
    """Any wrapper around all of a page's body leaves its text as it is."""
    model = html_text.default_model()
    inner = f"{MENU}<article><h1>Bridge</h1><p>{A}</p><p>{B}</p><p>{C}</p></article>{SIDE}{FOOT}"
    for tag in ("form", "div", "section", "center", "span"):
        for words in ("", "sidebar", "comments", "has-ads nav-open", "footer-sticky", "menu", "advert cookie popup"):
            page = f"{HEAD}<body class='{words}'><{tag} class='{words}'>{inner}</{tag}></body></html>"
            assert html_text.extract(page, model) == "\n".join(["Bridge", A, B, C]), (tag, words)


def test_gradient_by_differences():
    rng = np.random.default_rng(4)
    model = html_text.ChainField({}, rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2))
    feats = [np.array(sorted(rng.choice(6, rng.integers(1, 5), replace=False))) for _ in range(5)]
    labels = np.array([0, 1, 1, 0, 1])

    def score(path):
        e = sum(model.weights[at][:, y].sum() for at, y in zip(feats, path))
        return e + model.first[path[0]] + sum(model.steps[a, b] for a, b in zip(path, path[1:]))

    def likelihood():
        every = [score([k >> i & 1 for i in range(5)]) for k in range(32)]
        return score(labels.tolist()) - np.log(np.exp(every).sum())

    own, which, up, pairs, first = html_text.gradient(model, feats, labels)
    grads = dict(zip(which.tolist(), up))
    assert np.isclose(own, likelihood())
    for target, got in ((model.weights, np.array([grads.get(i, np.zeros(2)) for i in range(6)])), (model.steps, pairs), (model.first, first)):
        for at in np.ndindex(target.shape):
            held = target[at]
            target[at] = held + 1e-6
            up = likelihood()
            target[at] = held - 1e-6
            down = likelihood()
            target[at] = held
            assert np.isclose((up - down) / 2e-6, got[at], atol=1e-5)
