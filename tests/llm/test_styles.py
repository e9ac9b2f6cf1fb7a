"""Visibility of operator 10: pages with what shows of them, and random trees and sheets against a plain evaluator."""

import random

import pytest

from parley.llm import html_text, styles

PAGES = [
    ("<style>@media print{.x{display:none}}</style><p class=x>Hello", "Hello"),
    ("<style>@media screen{.x{display:none}}</style><p class=x>no<p>yes", "yes"),
    ("<style>@media not print{.x{display:none}}</style><p class=x>no<p>yes", "yes"),
    ("<style>@media print,screen{.x{display:none}}</style><p class=x>no<p>yes", "yes"),
    ("<style>@media (max-width:600px){.d{display:none}}@media (min-width:37.5em){.e{display:none}}</style><b class=d>d</b><b class=e>e</b>", "d"),
    ("<style media=print>p{display:none}</style><p>yes", "yes"),
    ("<style>@supports (x:y){.a{display:none}}@layer z{.b{display:none}}@font-face{display:none}@keyframes k{from{display:none}}</style><i class=a>a</i><i class=b>b</i>c", "c"),
    ("<style>.m{display:none}.m.open{display:block}</style><p class='m open'>yes<p class=m>no", "yes"),
    ("<style>.x{display:none}.x{display:block}</style><p class=x>yes", "yes"),
    ("<style>#i{display:none}.x{display:block}</style><p class=x id=i>no", ""),
    ("<style>p{display:none!important}.x{display:block}</style><p class=x>no", ""),
    ("<style>p{display:none!important}</style><p style='display:block'>no<div>yes</div>", "yes"),
    ("<style>p{display:none}</style><p style='display:block'>yes", "yes"),
    ("<style>.a .b{display:none}div>i{display:none}</style><div class=a><u><b class=b>no</b></u><i>no</i><u><i>yes</i></u></div>", "yes"),
    ("<style>.a:hover,.a+b,.a::before{display:none}</style><i class=a>yes</i> <b>too</b>", "yes too"),
    ("<style>[data-x]{display:none}[type='y']{display:none}</style><i data-x>no</i><i type=y>no</i><i type=z>yes</i>", "yes"),
    ("<style>/* .a{display:none} */ .b{/* display:none */}</style><i class=a>a</i><i class=b>b</i>", "ab"),
    ("<p class=x>no</p><style>.x{display:none}</style>yes", "yes"),
    ("<!-- <style>.x{display:none}</style> --><script>'<style>.x{display:none}</style>'</script><p class=x>yes", "yes"),
    ("<div style='visibility:hidden'>no<span style='visibility:visible'>yes</span>no</div>", "yes"),
    ("<div style='display:none'>no<span style='display:block;visibility:visible'>no</span></div>yes", "yes"),
    ("<style>.h{visibility:hidden}.v{visibility:visible}</style><ul class=h><li>no<li class=v>yes</ul>", "- yes"),
    ("<div hidden>no</div><div hidden style='display:block'>yes</div><div hidden=until-found>too</div>", "yes\ntoo"),
    ("<!-->a<!--->b<!-- no --!>c<!-- no", "abc"),
    ("<svg viewBox='0 0 1 1'><title>no</title><desc>no</desc><path d='M0'/><text x=1>one <tspan>two</tspan></text><text>three</text><defs><text>no</text></defs></svg>after", "one two\nthree\nafter"),
    ("<style>p{display:none", ""),
    ("<style>}{.x{display:none}</style><p class=x>yes", "yes"),
    ("<STYLE TYPE='text/css'>P{DISPLAY:NONE}</STYLE><p>no<div>yes</div>", "yes"),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_what_shows(page, text):
    assert html_text.render(page)[1] == text


@pytest.mark.parametrize(("query", "holds"), [("", True), ("all", True), ("screen and (min-width: 100px)", True), ("screen and (min-width: 3000px)", False), ("only screen", True), ("not screen", False), ("print, (max-width: 90em)", True), ("(hover: none)", False), ("speech", False)])
def test_media(query, holds):
    assert styles.for_screens(query) == holds


class Node:
    def __init__(self, r, words, parent, depth):
        self.tag, self.parent = r.choice(["div", "span", "b"]), parent
        self.classes = {c for c in "xyz" if r.random() < 0.3}
        self.id = r.choice(["", "", "", "p", "q"])
        self.style = r.choice([None] * 6 + ["display:none", "display:block", "visibility:hidden", "visibility:visible", "display:none !important"])
        self.children = []
        for _ in range(r.randint(1, 3)):
            if depth and r.random() < 0.7:
                self.children.append(Node(r, words, self, depth - 1))
            else:
                words.append(f"w{len(words)}")
                self.children.append(words[-1])

    def source(self):
        marks = (f" class='{' '.join(sorted(self.classes))}'" if self.classes else "") + (f' id="{self.id}"' if self.id else "") + (f" style='{self.style}'" if self.style else "")
        inside = "".join(x.source() if isinstance(x, Node) else f" {x} " for x in self.children)
        return f"<{self.tag}{marks}>{inside}</{self.tag}>"


def simple(r):
    tag, classes, name = r.choice(["", "", "div", "span", "b"]), sorted({r.choice("xyz") for _ in range(r.randint(0, 2))}), r.choice(["", "", "", "p", "q"])
    return (tag, classes, name) if tag or classes or name else ("", ["x"], "")


def fits(s, node):
    return (not s[0] or s[0] == node.tag) and set(s[1]) <= node.classes and (not s[2] or s[2] == node.id)


def chain_fits(chain, node):
    """chain: [(compound, how it stands to the one before)], the element's own last."""
    if not fits(chain[-1][0], node):
        return False
    if len(chain) == 1:
        return True
    above = []
    while node.parent:
        node = node.parent
        above.append(node)
        if chain[-1][1] == ">":
            break
    return any(chain_fits(chain[:-1], a) for a in above)


def shown_words(node, rules, visible=True):
    said = {"display": [], "visibility": []}
    for place, (chain, prop, value, important) in enumerate(rules):
        if chain_fits(chain, node):
            weight = [sum(bool(c[2]) for c, _ in chain), sum(len(c[1]) for c, _ in chain), sum(bool(c[0]) for c, _ in chain)]
            said[prop].append(((important, 0, weight, place), value))
    if node.style:
        prop, value = node.style.replace(" !important", "").split(":")
        said[prop].append((("important" in node.style, 1, [], 0), value))
    top = {p: max(x, key=lambda v: v[0])[1] for p, x in said.items() if x}
    if top.get("display") == "none":
        return []
    visible = top.get("visibility", "visible" if visible else "hidden") == "visible"
    return [w for c in node.children for w in (([c] if visible else []) if isinstance(c, str) else shown_words(c, rules, visible))]


def test_random_trees_and_sheets():
    r, hidden = random.Random(7), 0
    for _ in range(1500):
        words = []
        root = Node(r, words, None, 4)
        rules, sheet = [], ""
        for _ in range(r.randint(0, 6)):
            chain = [(simple(r), r.choice([" ", ">"])) for _ in range(r.choice([1, 1, 2, 3]))]
            prop = r.choice(["display", "visibility"])
            value, important = r.choice(["none", "block"] if prop == "display" else ["hidden", "visible"]), r.random() < 0.1
            rules.append((chain, prop, value, important))
            text = lambda s: s[0] + "".join(f".{c}" for c in s[1]) + (f"#{s[2]}" if s[2] else "")
            sheet += "".join((how if i else "") + text(s) for i, (s, how) in enumerate(chain)) + f"{{{prop}:{value}{'!important' if important else ''}}}\n"
        found = html_text.render(f"<style>{sheet}</style>{root.source()}")[1].split()
        assert found == shown_words(root, rules), (sheet, root.source())
        hidden += len(found) < len(words)
    assert hidden > 500
