"""Problem 6: pages of one site with the same surroundings and articles of their own."""

import pytest

from feedmill.llm.boilerplate import Page, _numbered, boilerplate_lines, common_subsequence, main_text, surroundings

NAMES = "north south east west upper lower inner outer grand little old new".split()


def _article(k):
    return [
        "By the Tolmby newsdesk" if k % 2 else f"Text: Anna Berg{'abcdefghijkl'[k]}",
        f"The {NAMES[k]} harbour board signed the quay plan near {NAMES[k]}by, but the union has not accepted it yet.",
        f"{NAMES[k].title()} plans stand",
        f"A pension fund is expected to pay for the {NAMES[k]} depot, because the council declined to do so in spring.",
    ]


def _page(k):
    head = ["• Home", "• News", "• Sport", "• About us", f"Tolmby Post › news › {NAMES[k]}", "We use cookies to measure traffic and to remember your choices."]
    tail = ["Related articles", f"- The {NAMES[-k]} mill bought a depot", f"- A {NAMES[k - 3]} bank opened a plant", f"Read also: The {NAMES[k]} court delayed a plan", f"Shared {k * 7} times — tell a friend", "© 2024 Tolmby Post. All rights reserved."]
    lines, out = [], set()
    for part, keep in ((head, False), (_article(k)[:2], True), (["{{ad_slot_2}}"], False), (_article(k)[2:], True), (tail, False)):
        for line in part:
            lines.append(line)
            if not keep:
                out.add(len(lines))
    return "\n".join(lines), out


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"https://tolmby.example/news/{NAMES[k]}-{k}", _page(k)[0]) for k in range(12)]
    rows += [(50, "https://tolmby.example/news/a-50", None), (51, None, ""), (52, None, "Please enable JavaScript to continue."), (53, "https://lone.example/x", "\n".join(_article(3))), (54, "https://tolmby.example/news/b", "word " * 50_000)]
    return spark.createDataFrame(rows, "id long, url string, text string")


def test_lines(pages):
    got = {}
    for r in boilerplate_lines(pages).collect():
        got.setdefault(r.id, set()).add(r.line_no)
    assert got == {k: _page(k)[1] for k in range(12)}


def test_main_text(pages):
    got = {r.id: r.text for r in main_text(pages).collect()}
    assert all(got[k] == "\n".join(_article(k)) for k in range(12))
    assert got[50] is None and got[51] == "" and got[53] == "\n".join(_article(3))
    assert main_text(pages.limit(0)).collect() == []


def test_long_list():
    own = _article(3)
    listed = [f"- The {a} mill bought a {b} depot" for a, b in zip(NAMES, NAMES[1:])]
    page = Page(1, "tolmby.example", "\n".join([*own[:2], "Related articles", *listed, *own[2:]]))
    assert surroundings(page, []) == set(range(3, 4 + len(listed)))
    # without bullets the article's own subhead may follow, but not at the page's end
    plain = [line[2:] for line in listed]
    page = Page(1, "tolmby.example", "\n".join([*own[:2], "Related articles", *plain[:4], *own[2:]]))
    assert surroundings(page, []) == {3, 4, 5, 6, 7}
    page = Page(1, "tolmby.example", "\n".join([*own, "Related articles", *plain]))
    assert surroundings(page, []) == set(range(5, 6 + len(plain)))


def _strange(k):
    """A page whose surroundings no list knows."""
    head = ["Zorn | Blif | Quom | Dask", f"Zorn › quom › {NAMES[k]}", "Plig the wumble to see more of it"]
    tail = ["Wumbled most", f"The {NAMES[-k]} mill bought a depot", f"A {NAMES[k - 3]} bank opened a plant near the bay", f"Plomb: The {NAMES[k]} court delayed a plan", "Grommed by the Tolmby Post and its wumblers, who gromm what is grommed and no more than that."]
    lines, out = [], set()
    for part, keep in ((head, False), (_article(k), True), (tail, False)):
        for line in part:
            lines.append(line)
            if not keep:
                out.add(len(lines))
    return "\n".join(lines), out


def test_alignment_decides(spark, monkeypatch):
    """Without the alignment nothing of these pages is found; with it, all."""
    pages = [Page(k, "tolmby.example", _strange(k)[0]) for k in range(12)]
    near = lambda k: pages[:k] + pages[k + 1 :]
    assert [surroundings(p, near(k)) for k, p in enumerate(pages)] == [_strange(k)[1] for k in range(12)]
    monkeypatch.setattr("feedmill.llm.boilerplate.common_subsequence", lambda a, b: [])
    assert all(not surroundings(p, near(k)) for k, p in enumerate(pages))


def test_copies_are_passed_over(spark):
    """A page amid more copies than it has neighbours on either side still meets other pages."""
    article = "\n".join([*_article(2), "A long paragraph of the article that each of its copies repeats, so that nobody could take one of them for another page of the site at all."] * 2)
    rows = [(k, f"https://tolmby.example/news/{k:04}", _strange(k % 12)[0]) for k in range(24)]
    head, tail = _strange(2)[0].split("\n")[:3], _strange(2)[0].split("\n")[-5:]
    rows += [(100 + k, f"https://tolmby.example/news/0012-{k:04}", "\n".join([*head, article, *tail])) for k in range(60)]
    found = boilerplate_lines(spark.createDataFrame(rows, "id long, url string, text string").coalesce(1)).where("id = 130").collect()
    assert {1, 2, 3} <= {r.line_no for r in found}


def _aligned(a, b):
    return set(common_subsequence(_numbered(list(a)), _numbered(list(b))))


def test_alignment():
    assert _aligned("axbycz", "abc") == {0, 2, 4}
    assert _aligned("ab", "ba") in ({0}, {1})
    assert _aligned("aabaa", "aab") == {0, 1, 2}
    assert _aligned("", "a") == set()
