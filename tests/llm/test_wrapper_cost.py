"""What op7 does for each page: white space in one pass, matchings of child lists worked out once for a layout."""

import random
import re
import sys
import time

from opsweave.llm import wrapper


def test_every_white_space_becomes_one_space():
    points = [chr(c) for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and chr(c) not in "<&"]
    text = "".join(f"a{c}{c}b" for c in points)
    assert [n.text for n in wrapper._texts(wrapper.parse(f"<p> {text}\n</p>"))] == [re.sub(r"\s+", " ", text).strip()]


def test_plain_text_costs_less_than_a_match_for_each_space():
    text = " ".join(["word"] * 200_000)
    page = f"<article><p>{text}</p></article>"

    def least(work):
        runs = []
        for _ in range(5):
            start = time.process_time()
            work()
            runs.append(time.process_time() - start)
        return min(runs)

    assert least(lambda: wrapper.parse(page)) < least(lambda: re.sub(r"\s+", " ", text))


def test_child_lists_of_a_layout_are_matched_once(monkeypatch):
    def page(middle):
        return f"<body><div><h1>t</h1>{middle}<ul><li>x</li></ul></div></body>"

    calls = []
    whole = wrapper.Shapes._pairs
    monkeypatch.setattr(wrapper.Shapes, "_pairs", lambda self, x, y: calls.append((x, y)) or whole(self, x, y))
    layout = wrapper.LayoutWrapper(page("<p>a</p><table><tr><td>b</td></tr></table><p>c</p>"))
    slots = [[(slot, n.tag) for slot, n in wrapper.slots_of(layout.read(page(f"<p>{k}</p><h2>s</h2><p>{k}</p>")))] for k in range(5)]
    assert 0 < len(calls) == len(set(calls)) and all(s == slots[0] for s in slots)
    calls.clear()
    assert list(wrapper.slots_of(layout.read(page("<p>a</p><table><tr><td>b</td></tr></table><p>c</p>")))) and not calls


def test_long_lists_are_matched_whole():
    """Lists too long to be kept, and more kinds of lists than are kept, give the slots that matching anew gives."""
    rng = random.Random(4)
    kinds = ["<p>a</p>", "<h2>b</h2>", "<ul><li>c</li></ul>", "<div><p>d</p></div>"]
    pages = ["<body><div>" + "".join(rng.choices(kinds, k=rng.choice((3, 12, 40)))) + "</div></body>" for _ in range(900)]
    layout = wrapper.LayoutWrapper(pages[0])
    for page in pages:
        kept = [slot for slot, _ in wrapper.slots_of(layout.read(page))]
        known, layout.shapes.pairings = layout.shapes.pairings, {}
        assert kept == [slot for slot, _ in wrapper.slots_of(layout.read(page))]
        layout.shapes.pairings = known
    assert len(layout.shapes.pairings) == wrapper.MAX_PAIRINGS
