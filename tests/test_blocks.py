"""Blocks of markdown and of web pages, case by case."""

import pytest

from veridex.operators import blocks
from veridex.operators.blocks import markdown, web


def short(found, *names):
    return [tuple(b.get(n) for n in names) for b in found]


@pytest.mark.parametrize(
    "source, want",
    [
        ("# T\n\nfirst\nsecond line\n\n```sh\nx=1\n```\n", [("paragraph", "first second line", "T", 3, 4, 0, None), ("code_block", "x=1", "T", 6, 8, 0, "sh")]),
        ("# Top\n\nintro\n\n## Sub A\n\nalpha\n\n## Sub B\n\nbeta\n", [("paragraph", "intro", "Top", 3, 3, 0, None), ("paragraph", "alpha", "Top / Sub A", 7, 7, 0, None), ("paragraph", "beta", "Top / Sub B", 11, 11, 0, None)]),
        ("# Doc\n\n- item one\n  - nested a\n  - nested b\n- item two\n", [("list_item", "item one", "Doc", 3, 3, 1, None), ("list_item", "nested a", "Doc", 4, 4, 2, None), ("list_item", "nested b", "Doc", 5, 5, 2, None), ("list_item", "item two", "Doc", 6, 6, 1, None)]),
        ("# A\n\n### C\n\nunder c\n\n#\n\nbody\n", [("paragraph", "under c", "A / C", 5, 5, 0, None), ("paragraph", "body", "", 9, 9, 0, None)]),
        ("# Real\n\n> ## Fake\n\n### Sub\n\nbody\n", [("paragraph", "body", "Real / Sub", 7, 7, 0, None)]),
        ("# Real\n\n> ## Fake\n>\n> quoted body\n\nafter\n", [("paragraph", "quoted body", "Real / Fake", 5, 5, 0, None), ("paragraph", "after", "Real", 7, 7, 0, None)]),
        ("# Top\n\n- intro\n\n  ## InList\n\n  body in list\n\nouter tail\n", [("list_item", "intro", "Top", 3, 3, 1, None), ("list_item", "body in list", "Top / InList", 7, 7, 1, None), ("paragraph", "outer tail", "Top", 9, 9, 0, None)]),
        ("﻿# H\r\n\r\nbody\r\n", [("paragraph", "body", "H", 3, 3, 0, None)]),
        ("```python\nprint('hi')\nprint(2)\n```\n", [("code_block", "print('hi')\nprint(2)", "", 1, 4, 0, "python")]),
        ("text before\n\n<div onclick='x()'>raw</div>\n\ntext after\n", [("paragraph", "text before", "", 1, 1, 0, None), ("paragraph", "text after", "", 5, 5, 0, None)]),
        ("# only heading\n", []),
        ("<!-- just a comment -->\n", []),
        ("\n\n", []),
        ("", []),
        ("~~~\n# no heading\n```\n> no quote", [("code_block", "# no heading\n```\n> no quote", "", 1, 4, 0, None)]),
        ("Title\n=====\npara\nlast\n---\nmore", [("paragraph", "more", "Title / para last", 6, 6, 0, None)]),
        ("    code\n\n    more\n\ntext\n    lazy", [("code_block", "code\n\nmore", "", 1, 3, 0, None), ("paragraph", "text lazy", "", 5, 6, 0, None)]),
        ("> quote\nlazy\n\n1. one\n2. two\n\n   - deep\n\n***\nend", [("paragraph", "quote lazy", "", 1, 2, 0, None), ("list_item", "one", "", 4, 4, 1, None), ("list_item", "two", "", 5, 5, 1, None), ("list_item", "deep", "", 7, 7, 2, None), ("paragraph", "end", "", 10, 10, 0, None)]),
        ("- ```\n  in item\n\n  still\n  ```\n- > quote in item\n", [("code_block", "in item\n\nstill", "", 1, 5, 1, None), ("list_item", "quote in item", "", 6, 6, 1, None)]),
        ("#no\n####### seven\n# closed ##\nx", [("paragraph", "#no ####### seven", "", 1, 2, 0, None), ("paragraph", "x", "closed", 4, 4, 0, None)]),
        ("para\n2. not a list\n1. list", [("paragraph", "para 2. not a list", "", 1, 2, 0, None), ("list_item", "list", "", 3, 3, 1, None)]),
        ("> ```\n> code\nout", [("code_block", "code", "", 1, 2, 0, None), ("paragraph", "out", "", 3, 3, 0, None)]),
    ],
)
def test_markdown(source, want):
    assert short(markdown(source), "kind", "text", "heading_path", "start_line", "end_line", "list_depth", "code_info") == want


@pytest.mark.parametrize(
    "source, text",
    [
        ('before <script>alert(1)</script> <a href="javascript:go()">link</a> ![alt *em*](http://evil.example/x.png) after', "before alert(1) link alt em after"),
        ("中文段落，包含 emoji 🙂 与 CJK。", "中文段落，包含 emoji 🙂 与 CJK。"),
        ("a **b** *c* __d__ _e_ `*f*` \\*g\\* snake_case_name 2 * 3 * 4", "a b c d e *f* *g* snake_case_name 2 * 3 * 4"),
        ("[text](http://x.example/(a)) &amp; &copy; <http://y.example>", "text & © http://y.example"),
        ("one  \ntwo\nthree", "one\ntwo three"),
        ("``a ` b`` c", "a ` b c"),
    ],
)
def test_inline(source, text):
    assert markdown(source)[0]["text"] == text


@pytest.mark.parametrize(
    "source, want",
    [
        ("<html><head><title>t</title></head><body><h1>Doc</h1><h2>Intro</h2><p>First paragraph.</p><ul><li>one</li><li>two</li></ul></body></html>", [("paragraph", "First paragraph.", "Doc / Intro", 0), ("list_item", "one", "Doc / Intro", 1), ("list_item", "two", "Doc / Intro", 1)]),
        ("<body><main><h2>Quoted</h2><blockquote><p>Nested quote text.</p></blockquote><p>After quote.</p></main></body>", [("blockquote", "Nested quote text.", "Quoted", 0), ("paragraph", "After quote.", "Quoted", 0)]),
        ("<body><article><h3>Code</h3><pre>def f():\n    return 1</pre><p>Explanation.</p></article></body>", [("code_block", "def f():\n    return 1", "Code", 0), ("paragraph", "Explanation.", "Code", 0)]),
        ("<body><header><h1>Site</h1></header><nav>menu</nav><main><p>Real body.</p></main><script>alert('x')</script><style>.a{}</style><footer>foot</footer></body>", [("paragraph", "Real body.", "", 0)]),
        ("<body><main><h1>A</h1><h2>B</h2><p>p1</p><h2>C</h2><p>p2</p><p>p3</p></main></body>", [("paragraph", "p1", "A / B", 0), ("paragraph", "p2", "A / C", 0), ("paragraph", "p3", "A / C", 0)]),
        ("<body><h1>Only title</h1><script>x()</script></body>", []),
        ("<p>outside</p><article><p>in<b>side</b></article><article><p>second</article>", [("paragraph", "in side", "", 0)]),
        ("<ul><li>a<ul><li>b<li>c</ul><li>d</ul>", [("list_item", "a b c", "", 1), ("list_item", "d", "", 1)]),
        ("<p>one<p>two<div>no block</div><template><p>t</p></template><noscript><p>n</p></noscript>&lt;x&gt;", [("paragraph", "one", "", 0), ("paragraph", "two", "", 0)]),
        ("", []),
    ],
)
def test_web(source, want):
    assert short(web(source), "kind", "text", "heading_path", "list_depth") == want


def test_awkward_rows(spark):
    rows = [(None, "a"), (1, None), (1, ""), (2, "b\n\nc"), (2, "b\n\nc"), (3, "- x " * 100_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, kind string")
    got = sorted((str(r.doc_id), r.ordinal, r.kind) for r in blocks.markdown_blocks(df).collect())
    assert got == sorted([("None", 0, "paragraph"), *[("2", k, "paragraph") for k in (0, 1)] * 2, *[("3", 0, "list_item")]])
    assert blocks.markdown_blocks(df.limit(0)).count() == blocks.html_blocks(df.limit(0), "doc_id", "text").count() == 0
