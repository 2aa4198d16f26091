import random
import re
from html import unescape

from candor.llm import htmlrender, queries
from candor.llm.htmlrender import render


def test_blocks_and_space():
    assert render("<p>a  b\n c<p>d<div>e</div>f") == "a b c\n\nd\n\ne\nf"
    assert render("<h1>T</h1>x<br>y<br><br>z <b>bold</b>, <i>it</i>alic") == "T\n\nx\ny\n\nz bold, italic"
    assert render("<pre>a\n  b\n\nc</pre>after") == "a\n  b\n\nc\n\nafter"
    assert render("one&amp;two &lt;3 &#233;") == "one&two <3 é"


def test_lists():
    assert render("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e") == "* a\n* b\n  * c\n* d\n\ne"
    assert render("<ol start=9><li>x<li>y<p>z</ol>") == "9. x\n10. y\n\n    z"
    assert render("<dl><dt>t<dd>d<dt>u<dd>e</dl>") == "t\n    d\nu\n    e"


def test_tables():
    assert render("<table><tr><th>Name<th>N<tr><td>long name<td>1<tr><td>x<td>22</table>") == "Name       N\nlong name  1\nx          22"
    assert render("<table><caption>C</caption><tbody><tr><td colspan=2>wide cell here<td>r</tr><tr><td>a</td><td>b</td><td>c</table>z").split("\n")[0] == "C"
    assert render("<table><tr><td>a<p>b</td><td><ul><li>i<li>j</ul></td></tr></table>") == "a b  * i * j"
    assert render("<table><td>only") == "only"


def test_spans():
    assert render("<table><tr><td rowspan=2>A<td>B<tr><td>C<tr><td colspan=2>wide<td>z</table>") == "A  B\n   C\nwide  z"
    assert render("<table><tr><th rowspan=0>k<th>a<th>b<tr><td>1<td colspan='2x'>2<td>3<tr><td>4</table>") == "k  a  b\n   1  2  3\n   4"
    assert render("<table><tbody><tr><td rowspan=9>A<td>B<tbody><tr><td>C<td>D</table>") == "A  B\nC  D"
    assert render(f"<table><tr><td colspan={'9' * 5000}>a<td rowspan=-3>b<tr><td colspan=0>c<td colspan=é>d</table>") == "a     b\nc  d"
    wide = "<table>" + ("<tr>" + "<td colspan=1000>c" * 100) * 50 + "</table>"
    assert render(wide).split("\n") == ["  ".join("c" * 100)] * 50
    stairs = render("<table>" + "<tr><td rowspan=0>x" * 5000 + "</table>").split()
    assert stairs == ["x"] * 5000
    assert len(render("<table>" + "<tr><td rowspan=0>x" * 5000 + "</table>")) < 20_000


def test_cells_stand_where_a_grid_puts_them():
    rng = random.Random(4)
    for _ in range(300):
        rows = [[(f"{r}{'abcde'[c]}" + "y" * rng.randrange(6), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2, 4])) for c in range(rng.randrange(5))] for r in range(rng.randrange(1, 6))]
        grid, at = {}, {}
        for r, row in enumerate(rows):
            x = 0
            for text, columns, down in row:
                while (r, x) in grid:
                    x += 1
                at[text] = x
                grid |= {(r + i, x + j): text for i in range(down) for j in range(columns)}
                x += columns
        lines = render("<table>" + "".join("<tr>" + "".join(f"<td colspan={c} rowspan={d}>{t}</td>" for t, c, d in row) + "</tr>" for row in rows) + "</table>").split("\n")
        lines, rows = [x for x in lines if x], [row for row in rows if row]
        assert [x.split() for x in lines] == [[t for t, *_ in row] for row in rows]
        # cells of a column begin at the same place, unless one that spans columns has pushed what follows on
        begins = {}
        for line, row in zip(lines, rows):
            for k, (text, *_) in enumerate(row):
                if all(c == 1 for _, c, _ in row[:k]):
                    begins.setdefault(at[text], set()).add(line.index(text))
        assert all(len(x) == 1 for x in begins.values())


def test_any_markup_is_read(spark):
    assert render("<div>" * 250 + "<script>evil()</script><p hidden>secret</p>txt") == "txt"
    assert render("<div>" * 300 + "<b>a</b></div>b") == "a\nb"
    assert render("a<![x") == "a" and render("a<![if !IE]>b<![endif]>c<!ELEMENT x>d<!>e") == "abcde"
    rng = random.Random(2)
    tags = "table tr td tbody caption form p div ul ol li b a dl dt select option button script style head title body pre details summary template col svg".split()
    pieces = [*(f"<{t}>" for t in tags), *(f"</{t}>" for t in tags), "<!", "<![", "<![CDATA[", "<!--", "-->", "<?", "</", "<", ">", "]]>", "&", "&#", "&#x110000;", "<td rowspan=3 colspan=2>", "<a b=", "'", "\x00", "w "]
    pages = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(2000)]
    pages += ["<![x", f"<td colspan={'9' * 5000}>a", "<ul><li>x" * 3000, "<i>" + "<b>" * 30000 + "</u>" * 30000 + "</i>z"]
    out = htmlrender.extract(spark.createDataFrame(list(enumerate(pages)), "page_id long, html string")).collect()
    assert len(out) == len(pages) and all(r.text is not None for r in out)
    assert len(out[-2].text) < 3000 * (htmlrender.INDENT_MOST + 4) and out[-2].text.count("x") == 3000


def test_misplaced_in_a_table():
    assert render("<table><tr><form><td>Name</td><td>x</td></form></tr></table>") == "Name  x"
    assert render("<form><table><form><tr><td>a</form><td>b</table>c</form>d") == "a  b\n\nc\nd"
    assert render("a<table><tr>stray<td>x</td>more<td>y</table>z") == "astraymore\n\nx  y\n\nz"
    assert render("<table><tr><td>x</td><div>d<b>e</b><td>y</tr>s<p>p<tr><td>z</table>") == "de\ns\n\np\n\nx  y\nz"
    assert render("<table><tbody>t<tr><script>s</script><td>x<tr hidden>u<td>y</table>") == "tu\n\nx"
    assert render("<table><colgroup>g<col><tr><td>x<caption>C</table>") == "g\n\nC\nx"
    assert render("<div><table><tr></div><td>x<table><tr>in<td>y</table></table>z</div>") == "xin y\n\nz"
    assert render("<table><tr><td>x<table><td>y</table><td>z<tr><table><td>v</table>w") == "x y  z\n\nv\n\nw"
    assert render("<table><tr><template><tr>s<td>t</template><td>x<td><template><tr>u</template>y</table>") == "x  y"


def test_text_ends_an_open_head():
    assert render("<head><title>T</title>Hello <b>x</b>") == "Hello x"
    assert render("<html><head> <title>T</title> \n<style>s</style>Hello<p>x") == "Hello\n\nx"
    assert render("<head><script>s</script>\n</head>Hello") == "Hello"


def test_visibility():
    hidden = "<head><title>t</title><style>s</style></head><script>var a='</p>'</script><template>x</template><noscript>n</noscript><div hidden>h</div><p style='color:red; display : none'>d</p><span style='visibility:hidden'>v</span><!-- c --><dialog>g</dialog>"
    assert render(hidden + "<details><summary>sum</summary>more</details><details open><summary>s2</summary>seen</details>") == "sum\ns2\nseen"
    assert render("<head><title>x</title><p>no end of head") == "no end of head"


def test_broken_and_odd(spark):
    assert render(None) == render("") == "" and render("plain  text") == "plain text"
    assert render("</p></div>a<b><i>c</b>d</i><td>e") == "acde" or render("</p></div>a<b><i>c</b>d</i><td>e").replace(" ", "") == "acde"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000 + "y"
    assert "".join(render(deep).split()) == "xy"
    assert render("<p " + "a" * 10 + " unclosed") == ""
    long = "<p>" + "word " * 50000
    assert len(render(long).split()) == 50000
    pages = spark.createDataFrame([(1, None, "t"), (None, "<p>a", "u"), (2, "", "v"), (2, "", "v")], "page_id long, html string, text string")
    assert sorted(map(str, ((r.page_id, r.text) for r in htmlrender.extract(pages).collect()))) == ["(1, '')", "(2, '')", "(2, '')", "(None, 'a')"]
    assert htmlrender.extract(pages.limit(0)).count() == 0


def test_every_visible_word_of_the_pages(spark, sf):
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    out = {r.page_id: r.text for r in queries.op8_html_extraction(spark, sf).collect()}
    assert out.keys() == html.keys()
    for i, h in html.items():
        bare = re.sub(r"(?s)<(script|style|title|noscript|template)\b.*?</\1\s*>|<!--.*?-->", " ", h)
        if re.search(r"(?i)hidden|display|<(svg|iframe|object|select|textarea|details|dialog)", bare):
            continue
        words = unescape(re.sub(r"(?s)<[^>]*>", "", bare)).split()
        assert "".join(re.sub(r"(?m)^ *(\*|\d+\.) ", "", out[i]).split()) == "".join("".join(words).split()), i
