import random
from collections import Counter

import pytest

from mendwell.llm import markup as M


def n(text):
    c = Counter(M.clean(text)[1])
    return tuple(c[k] for k in M.KINDS)


@pytest.mark.parametrize("text, counts", [
    (None, (0, 0, 0, 0)), ("", (0, 0, 0, 0)), (" \n\t", (0, 0, 0, 0)), ("Background\nPlain text with 3 * 2 * 4 and $15 and $20, error #42.", (0, 0, 0, 0)),
    ("# A\n\nText\n=====\n\n- x\n  - y\n1. z\n\n---\n", (2, 3, 0, 0)),
    ("## A ##\n```sh\n# no\n- no\n$a$\n```\nSee `- x` and \\# no, \\$5 and \\$6, $a+b$, $$c$$.", (1, 0, 1, 2)),
    ("~~~\nopen to the end\n- no", (0, 0, 1, 0)), ("Some text\n2. goes on\n", (0, 0, 0, 0)),
    ("<h1>A</h1><ul><li>x<ul><li>y</ul></ul><pre><code>&lt;li&gt;z</code></pre><!-- <h2>no</h2> --><script>'<li>'</script>", (1, 2, 1, 0)),
    ("<p>\\(a\\) and \\[b\\] and <math><mtext>c</mtext></math> cost $15 and a film&nbsp; $20</p>", (0, 0, 0, 3)),
    ("&lt;h2&gt;A&lt;/h2&gt;\n&lt;pre&gt;x &amp;lt;li&amp;gt;&lt;/pre&gt;", (1, 0, 1, 0)),
    ("==A ==\n\n===B===\n* x\n** y\n# z\n<pre>\n* no\n</pre>\n:<math>a</math> '''b'''<ref>* no</ref>\n<nowiki>== no ==</nowiki>", (2, 3, 1, 1)),
    ("\\section*{A}\n% \\section{no}\n\\begin{itemize}\n  \\item x\n  \\item y\n\\end{itemize}\n\\begin{verbatim}\n\\item no $a$\n\\end{verbatim}\n$a$ \\[b\\] \\(c\\) \\$5 and \\$6\n\\begin{equation}\nd\n\\end{equation}", (1, 2, 1, 4)),
    ("# A\r\n\r\n- x\r\n", (1, 1, 0, 0)),
])
def test_elements(text, counts):
    assert n(text) == counts


def test_texts_keep_structure_and_lose_marks():
    clean, _ = M.clean("# A title #\n\nSome **bold** [link](http://x.example/1) &amp; more.\n\n* item `code`\n\n```\nx = 1\n```\n\n$a$")
    assert clean == "# A title\n\nSome bold link & more.\n\n- item code\n\n\n```\nx = 1\n```\n\n\n$a$".replace("\n\n\n", "\n\n")
    assert M.clean("\\section*{Sound}\nA \\textbf{bold} word\\footnote{x}.")[0] == "# Sound\nA bold word."


def test_lines_of_tags_alone_are_no_content():
    lines = "<p>" + "Long enough text of an article. " * 5 + "</p>\n"
    clean, _ = M.clean("<div><a href=x>up</a><a href=y>on</a><br><img></div>\n" * 3 + lines * 5)
    assert "up" not in clean and clean.count("Long enough") == 25


def test_frames(spark):
    df = spark.createDataFrame([(1, "# A\n- x\n- y", "k"), (2, None, "k"), (3, "", "k"), (None, "# B", "k"), (4, "word " * 200_000, "k"), (1, "# A", "k")], "siis_id bigint, content string, kind string")
    assert sorted(map(tuple, M.found(df, "siis_id", "content").collect())) == [(1, "heading", 1), (1, "heading", 1), (1, "list_item", 1), (1, "list_item", 2)]
    assert M.texts(df, "siis_id", "content").count() == 6
    assert M.found(df.limit(0), "siis_id", "content").count() == 0


def planted(rng):
    """An article with menus, crumbs and a footer around and between its own lines: (source, own lines, own elements)."""
    said = [f"Step {i} says in whole words what is to be done with the {w} before anything else is tried." for i, w in enumerate(("tray", "cover", "cable", "panel", "clock"))]
    menu = ["<ul class=m>", *(f"<li><a href='/{i}'><b>{w}</b></a></li>" for i, w in enumerate(("Home", "Shop", "Help", "Press", "Jobs"))), "</ul>"]
    crumbs = ["<div><a href=/>up</a> <a href=/a>on</a> <a href=/b>top</a></div>", "<div><span></span><img src=x><br></div>"]
    own = ["<h1>Trays and covers of all kinds</h1>", *(f"<p>{s}</p>" for s in said), "<ol>", *(f"<li>{s}</li>" for s in said[:3]), "</ol>", "<p>" + " ".join(said) + "</p>"]
    at = rng.randrange(3, 6)
    return "\n".join(menu + crumbs + own[:at] + crumbs + own[at:] + menu + crumbs), ["# Trays and covers of all kinds", *said, *("- " + s for s in said[:3]), " ".join(said)], ["heading"] + ["list_item"] * 3


def test_regions_decide_texts_and_elements(monkeypatch):
    rng = random.Random(1)
    cases = [planted(rng) for _ in range(20)]

    def right():
        got = [M.clean(source) for source, _, _ in cases]
        texts = sum([x for x in text.split("\n") if x.strip()] == own for (text, _), (_, own, _) in zip(got, cases))
        return texts, sum(marks == own for (_, marks), (_, _, own) in zip(got, cases))

    assert right() == (20, 20)
    monkeypatch.setattr(M, "content", lambda lines: [True] * len(lines))
    assert right() == (0, 0)


def test_links_within_words_and_lone_lists_of_links_stay():
    source = "<p>" + "Long enough text of an article. " * 5 + "</p>\n<ul>\n<li>Open <a href=x>the list</a> and wait for the light to go out</li>\n<li><a href=x>The whole of this item is a link, and long enough to be one that is read</a></li>\n</ul>"
    assert M.clean(source)[1] == ["list_item", "list_item"]
    assert M.clean("- [choose](https://help.example/975)\n- [x](y)")[1] == ["list_item", "list_item"]


def test_commands_are_unwrapped_however_deep():
    deep = 5000
    assert M.clean("\\section{A}\n" + "\\emph{" * deep + "word" + "}" * deep + " \\textbf{open {x}")[0] == "# A\nword \\textbf{open {x}"
    assert M.clean("\\section{A}\n\\textbf{a {b} \\emph{c}} d")[0] == "# A\na {b} c d"


def test_two_means_settle():
    lines = [([], "x" * (3 + i % 7), 4, 0) for i in range(300)] + [([], "y" * (300 + i), 1, 0) for i in range(300)]
    kept = M.content(lines)
    assert not any(kept[:290]) and all(kept[310:])
