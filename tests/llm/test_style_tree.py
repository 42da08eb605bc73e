"""The importance of elements against one worked out page by page."""

import math
from collections import defaultdict

import pytest

from punctual.llm import html_text
from punctual.llm.html_text import CONTENT, Page, main_text, style_tree

SCHEMA = "page_id long, url string, html string"


def page(title, words, extra="", links=3):
    items = "".join(f"<li>link {i}</li>" for i in range(links))
    return (f"<html><body><div class='top'><p>Our site</p><ul>{items}</ul></div><div class='story'><h1>{title}</h1>"
            + "".join(f"<p>{title} {w} and {w * 3}</p>" for w in words) + f"</div><div class='bottom'><p>All rights kept</p>{extra}</div></body></html>")


def site():
    rows = [(i, f"https://one.org/{i}", page(f"Story {i}", range(i, i + 4 + i % 3), "<p>Terms</p>" * (i % 2), 2 + i % 3)) for i in range(9)]
    rows += [(20 + i, f"https://two.org/{i}", page(f"Note {i}", [i * 7, i * 7 + 1, i])) for i in range(3)]
    rows += [(40, "https://one.org/copy", rows[0][2]), (41, None, page("Alone", [1])), (42, "https://two.org/none", None), (43, "https://two.org/empty", "")]
    return rows


def plain(rows):
    """Entropy of texts and of children over the different pages of a host."""
    pages = defaultdict(dict)
    for _, url, source in rows:
        own = Page(source or "")
        blocks = own.candidates()
        if blocks:
            host = html_text.host_of(url)
            pages[host].setdefault(frozenset(text for text, _, _ in blocks), (blocks, own.elements))
    found = {}
    for host, each in pages.items():
        holders, texts, styles = defaultdict(set), defaultdict(set), defaultdict(set)
        for number, (blocks, elements) in enumerate(each.values()):
            for text, path, _ in blocks:
                texts[path, text].add(number)
                for n in range(1, len(path) + 1):
                    holders[path[:n]].add(number)
            for path, children in elements:
                styles[path, children].add(number)
                holders[path].add(number)
        for element, held in holders.items():
            weight = total = style = 0.0
            for (path, _), on in texts.items():
                if path[: len(element)] == element:
                    m = len(holders[path])
                    weight += len(on) * (1 - math.log(len(on)) / math.log(m) if m > 1 else 1.0)
                    total += len(on)
            own = [on for (path, _), on in styles.items() if path == element]
            for on in own:
                p = len(on) / len(held)
                style += -p * math.log(p) / math.log(len(held)) if len(held) > 1 else 1.0
            content = weight / total if total else 1.0
            found[host, html_text._code(*element)] = (len(held), CONTENT * content + (1 - CONTENT) * min(style, 1.0))
    return found


def test_importance_equals_one_worked_out_plainly(spark):
    rows = site()
    expected = plain(rows)
    result = {(row.host, row.element): (row.pages, row.importance) for row in style_tree(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert result.keys() == expected.keys()
    for key, (pages, importance) in expected.items():
        assert result[key][0] == pages and result[key][1] == pytest.approx(importance), key


def test_the_tree_alone_removes_what_a_host_repeats(spark):
    """No page declares an article, and no class says what anything is."""
    rows = [(i, f"https://one.org/{i}", page(f"Story {i}", range(i, i + 5)).replace("top", "a1").replace("story", "b2").replace("bottom", "c3")) for i in range(8)]
    for row in main_text(spark.createDataFrame(rows, SCHEMA)).collect():
        i = row.page_id
        assert row.text == "\n\n".join([f"Story {i}", *(f"Story {i} {w} and {w * 3}" for w in range(i, i + 5))]) and row.n_removed > 0


def test_odd_pages(spark):
    """Null ids and sources, repeated rows, extra columns, a very long page, an empty table."""
    long = page("Long", range(30_000))
    rows = [(None, "https://x.org/a", page("A", [1])), (1, None, None), (2, "not a url", ""), (3, "https://x.org/b", long), (3, "https://x.org/b", long),
            (4, "https://x.org/c", "<p>open <b>text"), (5, "https://x.org/d", "<script>only()</script>")]
    frame = spark.createDataFrame([(*row, 7, "x", 1.0) for row in rows], f"{SCHEMA}, n_chars long, host string, importance double")
    found = main_text(frame).collect()
    texts = defaultdict(list)
    for row in found:
        texts[row.page_id].append(row.text)
        assert row.n_chars == len(row.text)
    assert len(found) == 7 and texts[1] == texts[2] == texts[5] == [""] and texts[4] == ["open text"]
    assert texts[3][0] == texts[3][1] and texts[3][0].count("\n\n") >= 30_000 and "A 1 and 3" in texts[None][0]
    assert main_text(spark.createDataFrame([], SCHEMA)).count() == 0
