"""Pages with tags left out or never closed."""

import time

import numpy as np
import pytest

from faultscope.llm.dom import blocks_of, features, read_page


@pytest.mark.parametrize("page,blocks", [
    ("<html><head><title>T</title><article><p>One</p></article>", ["One"]), ("<head><meta charset=x><link href=y><p>One", ["One"]), ("<head><title>T</title>One", ["One"]),
    ("<head><title>T<body><p>One", ["One"]), ("<head><style>p{}</style><script>1</script><noscript><img></noscript><base></head><p>One", ["One"]),
    ("<head><title>T</title><noscript><p>No</p></noscript><meta></head><p>One", ["One"]), ("<head><template><p>No</p></template><title>T</title><body>One", ["One"]),
    ("<div>a<button>b</div><p>One</p>", ["ab", "One"]), ("<div><select><option>b</div><p>One</p>", ["b", "One"]), ("<div><object>b</div><p>One</p>", ["b", "One"]),
    ("<div><video>No</div><p>One</p>", ["One"]), ("<div><noscript>No</div><p>One</p>", ["One"]), ("<div><svg><path d=1/></div><p>One</p>", ["One"]),
    ("<article><svg><path><p>One</p><p>Two</p></article>", ["One", "Two"]),
    ("<div><video>" + "<p>" * 9 + "No</div>" + "<p>One", ["One"]), ("<div><video><div>No</div>No</video>a</div>", ["a"]), ("<div><video><p>No</video>a</div>", ["a"]), ("<div><iframe/>a</div>", ["a"]),
    ("<p>where <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds</p>", ["where x=1 holds"]), ("<p>a <svg><g/><title>No</title><style>No</style></svg> b</p>", ["a b"]),
    ("<p>a</p><script>No</script><template><p>No</p></template><p>b</p>", ["a", "b"])])
def test_what_is_shown(page, blocks):
    nodes = read_page(page)
    assert all(x.parent < k for k, x in enumerate(nodes))
    assert blocks_of(nodes, np.ones(len(nodes), bool)) == blocks


@pytest.mark.parametrize("page", [
    lambda n: "<a " * n, lambda n: '<a href="' * n, lambda n: "<x><table>" + "<div>" * n + "</x>" * n, lambda n: "<p><button>" + "<b>" * n + "<div>x</div>" * n,
    lambda n: "<ul>" + "<li>" * n, lambda n: "<div>" * n + "x", lambda n: "<!--" * n, lambda n: "</" * n, lambda n: "<a" + " b=c" * n + ">x", lambda n: '<a b="' + ">" * n])
def test_hostile_pages_take_linear_time(page):
    def seconds(n):
        start = time.process_time()
        nodes = read_page(page(n))
        features(nodes)
        return time.process_time() - start

    seconds(1000)
    # Sixteen times the page in far less than 256 times the time, and never long.
    small, large = max(seconds(5_000), 0.01), seconds(80_000)
    assert large < 64 * small and large < 20


def test_what_never_ends_is_not_shown():
    for tail in ("<a href='x", "<a <b <c", "<!-- x <p>y", "</p"):
        nodes = read_page(f"<p>one <b>two</b><p>three {tail}")
        assert blocks_of(nodes, [True] * len(nodes)) == ["one two", "three"]
