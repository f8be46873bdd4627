import itertools

import pytest

from tessellore.llm import markup as mk

TREE = mk.train(*mk.labelled())


def clean(text):
    return "\n\n".join(b.text for b in mk.blocks_of(text, TREE)[0] if b.content)


def found(text):
    return mk.blocks_of(text, TREE)[1]


HAVE = {
    "html": ["a <b>bold</b> b", "x<br/>y", "x <BR> y", "<!-- note -->", "<!DOCTYPE html>", "a &amp; b", "it&#39;s", "q&#x27;", '<a name="x"></a>', "<font size=2>x</font>", "</td>"],
    "wiki": ["[[Page]]", "see [[Page#a|b]]", "{{clear}}", "{{#if: a | b}}", "{{Infobox x\n| name = y\n}}", "{{Infobox x\n| name", "== Head ==", "=====Deep=====", "{| class=\"x\"\n|-\n| a\n|}", "''it''", "'''bo'''", "__TOC__", "said ~~~~", "[https://a.example label here]"],
    "latex": ["\\frac{1}{2}", "\\begin{x}", "a $x^2 + 1$ b", "$k$ is", "$$ p_t < 3 $$", "\\(x \\le 3\\)", "\\[ y = 3 \\]", "\\textbf{x}", "~\\url{https://a}", "$O(n)$", "\\item x"],
    "block": ["[block:code]\n{}\n[/block]", "[/block]", "<Tabs>", "</Card>", "<Image src=\"x\" />", "<Cards columns={2}>", "<Callout icon=\"star\">"],
}
NONE = [
    "Replace <batchKey> with it", "It returns Map<String, Nornoren> here", "a List<String> b", "<https://a.example/b>", "<help@a.example>", "from $8.05 to $81.9 per", "asks $5; B asks $7 per", "$92 or $1255 is",
    "Costs: $\u200b153 today, US$ 1576 later", "C:\\temp\\new", "\\\\server\\share", "a\\_b\\_c \\*d\\*", "~~gone~~", "If 24<pageSize then X stops; if pageSize>24 it", "R&D teams", "x?a=1&lt=3&copy=2", "`<b>` and `{{x}}` or ``[[a]] ` $x$``",
    "```html\n<b>x</b>\n```", "~~~\n[[x]]\n~~~", "````md\n```\n[[x]]\n```\n<b>\n````", "Title\n=====\n\ntext", "__init__ and __bold__", "set x to '' or ''", "{{userName}} is filled", "see the [label](https://a.example) there", "[[1, 2]]", "a = b = c", "<TOKEN> goes here", "`` ` `` <x",
]


@pytest.mark.parametrize("family,text", [(f, t) for f, texts in HAVE.items() for t in texts])
def test_constructs_are_found(family, text):
    assert family in found(text)
    assert found(f"Before.\n\n{text}\n\nAfter.") == found(text)


@pytest.mark.parametrize("text", NONE)
def test_what_only_looks_like_markup(text):
    assert found(text) == set()


@pytest.mark.parametrize("text", [t for t in NONE if "\n" not in t])
def test_text_without_markup_is_left_alone(text):
    assert clean(text) == text


CASES = {
    "<h2>Head</h2>text": "## Head\n\ntext",
    "<ul><li>a</li><li>b</li></ul>": "- a\n- b",
    "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td>2</td></tr></table>": "| A | B |\n| --- | --- |\n| 1 | 2 |",
    "a<script>var x = 1;</script>b &lt; c": "ab < c",
    "<pre>x &lt; 1</pre>": "```\nx < 1\n```",
    "== Head ==\ntext": "## Head\n\ntext",
    "See [[Page|the page]] and '''bold'''.": "See the page and bold.",
    "{| class=\"x\"\n|-\n! A !! B\n|-\n| 1 || 2\n|}": "| A | B |\n| --- | --- |\n| 1 | 2 |",
    "{{Infobox x\n| name = y\n| limit = 3\n}}": "- name: y\n- limit: 3",
    "\\section{Head}\ntext": "## Head\n\ntext",
    "\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}": "- a\n- b",
    "\\begin{tabular}{ll}\na & b \\\\\nc & d\n\\end{tabular}": "| a | b |\n| --- | --- |\n| c | d |",
    "\\begin{equation}\nx = 1\n\\end{equation}": "$$x = 1$$",
    "Here \\(x \\le 3\\) holds, $k$ too.": "Here $x \\le 3$ holds, $k$ too.",
    "\\textbf{a} and \\emph{b}": "a and b",
    "[block:api-header]\n{\"title\": \"T\"}\n[/block]\ntext": "## T\n\ntext",
    "[block:code]\n{\"codes\": [{\"code\": \"x = 1\", \"language\": \"python\"}]}\n[/block]": "```python\nx = 1\n```",
    "[block:callout]\n{\"type\": \"info\", \"title\": \"T\", \"body\": \"B\"}\n[/block]": "> T\n> B",
    "[block:parameters]\n{\"data\": {\"h-0\": \"A\", \"h-1\": \"B\", \"0-0\": \"1\", \"0-1\": \"2\"}, \"cols\": 2, \"rows\": 1}\n[/block]": "| A | B |\n| --- | --- |\n| 1 | 2 |",
    "<Tabs>\n<Tab title=\"x\">\ntext\n</Tab>\n</Tabs>": "text",
    "```py\n<b>[[x]]</b>\n```\n\nafter": "```py\n<b>[[x]]</b>\n```\n\nafter",
    "keep `<b>` code": "keep `<b>` code",
}


@pytest.mark.parametrize("text", CASES)
def test_clean_text(text):
    assert clean(text) == CASES[text]


def test_boilerplate_goes_and_content_stays():
    menu = "[Home](/) [Docs](/docs) [API](/api)"
    text = f"{menu}\n\nThis page tells how to connect a client to the [queue](/q) and what the limits are.\n\n## Limits\n\n- [one](/1)\n- two\n\n{menu}"
    assert clean(text) == "\n\n".join(text.split("\n\n")[1:-1])


def test_menus_of_any_syntax_go():
    """Link density is that of the source: of anchors and wiki links as well, and of lists."""
    said = "This page tells how to connect a client to the queue and what the limits are."
    for menu in ("<ul>\n<li><a href=\"/\">Home</a></li>\n<li><a href=\"/d\">Docs</a></li>\n\n<li><a href=\"/a\">API</a></li>\n</ul>", "<a href='/'>Home</a> | <a href='/d'>Docs</a> | <a href='/a'>API</a>", "- [Home](/)\n- [Docs](/d)\n- [API](/a)", "[[Main Page]] [[Help|Help]] [[Talk]] [[Log]]"):
        assert clean(f"{menu}\n\n{said}\n\n{said}") == f"{said}\n\n{said}"
        assert clean(f"{said}\n\n{said}\n\n{menu}") == f"{said}\n\n{said}"
        assert found(f"{menu}\n\n{said}") == found(menu)  # what goes is searched all the same


def test_constructs_over_blank_lines_stay_together():
    assert clean("a b c\n\n<!-- x\n\ny -->\n\nd e f") == "a b c\n\nd e f"
    assert clean("{{Infobox x\n| name = y\n\n| limit = 3\n}}") == "- name: y\n- limit: 3"
    assert clean("<pre>\nx\n\ny\n</pre>") == "```\nx\n\ny\n```"
    assert clean("{{ never closed\n\n" * 3 + "end") == "\n\n".join(["{{ never closed"] * 3 + ["end"])


def test_the_tree_learns_its_table():
    features, labels = mk.labelled()
    assert all(mk.predict(TREE, tuple(f)) == y for f, y in zip(features, labels))
    held = [((40, 0, 33, 0.1, 2, 20, 0), mk.MARKED), ((40, 0, 33, 0.0, 0, 20, 0), mk.PLAIN), ((3, 1.0, 2, 0.0, 0, 4, 1.0), mk.BOILERPLATE), ((0, 0, 9, 0.9, 9, 3, 1.0), mk.BOILERPLATE), ((20, 0, 5, 0.0, 0, 30, 0), mk.PLAIN)]
    assert all(mk.predict(TREE, f) == y for f, y in held)


def test_no_block_with_marks_is_passed_over():
    """Whatever the other figures are, a block with marks is searched: the tree costs no recall."""
    sizes, shares = (0, 1, 2, 3, 5, 8, 13, 21, 34, 90, 400, 5_000), (0.0, 0.1, 0.25, 0.4, 0.6, 1.0)
    for before, own, after in itertools.product(sizes, sizes, sizes[::3]):
        for linked, share, marks in itertools.product((0.0, 0.5, 1.0), shares, (1, 2, 7, 300)):
            assert mk.predict(TREE, (before, linked, own, share, marks, after, linked)) != mk.PLAIN


def test_dirty_rows(spark):
    rows = [("t", 1, None, "x"), ("t", 2, "", "x"), ("t", 3, " \n ", "x"), ("t", 4, "<b>x</b> [[y]]", "x"), ("t", 4, "<b>x</b> [[y]]", "x"), ("t", None, "``` \nopen <b>", "x"), ("t", 5, "<" * 50_000 + "{{" * 20_000 + "$" * 999 + "\\begin{a}" * 999, "x")]
    df = spark.createDataFrame(rows, "tbl string, row_id bigint, body string, families string")
    out = mk.clean_texts(df)
    got = {r["row_id"]: r for r in out.collect()}
    assert [got[i]["clean_text"] for i in (1, 2, 3, 4)] == ["", "", "", "x y"]
    assert got[None]["families"] == [] and got[None]["codes"] == 1
    assert sorted(tuple(r) for r in mk.found_families(out).filter("row_id = 4").collect()) == [("t", 4, "html")] * 2 + [("t", 4, "wiki")] * 2
    assert mk.clean_texts(df.limit(0)).count() == 0


def test_deep_nesting_leaves_nothing_behind():
    template = command = environment = "x"
    kept, part = mk.Kept(), "x"
    for name in ("center", "quote", "flushleft", "minipage", "small", "large", "sloppypar", "figure"):
        template = "{{N|" + template + "}}"
        command = "\\textbf{" + command + "}"
        environment = f"\\begin{{{name}}}[h]\n\\begin{{{name}x}}\n{environment}\n\\end{{{name}x}}\n\\end{{{name}}}"
        part = kept.put(f"({part})")
    assert clean(f"Some words before {template} and words after it.") == "Some words before x and words after it."
    assert clean(f"Some words before {command} and words after it.") == "Some words before x and words after it."
    assert "{" not in mk.convert(environment, mk.Kept()) and "\\" not in mk.convert(environment, mk.Kept())
    assert kept.back(part) == "(" * 8 + "x" + ")" * 8
