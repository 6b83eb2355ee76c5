import pytest

from tallyframe.llm import tag_paths

LONG = "A sentence of the article, with a comma and an end. " * 6


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("   \n", ""),
        ("<p></p><nav>Menu</nav>", ""),
        ("just text &amp; no tags", "just text & no tags"),
        ("<article><h1>Head</h1><p>One &lt;b&gt; &#233;&eacute;&nbsp;x</p><p>Two</p></article>", "Head One <b> éé x Two"),
        ("<article><p><b>bold</b>er <i>it</i>\n\t alic<br>next<p>last", "bolder it alic next last"),
        ("<article><p>a</p><aside>no</aside><footer>no</footer><form>no<input></form><script>no</script><style>no</style>b</article>", "a b"),
        ("<nav>x</nav><header>x</header><main><p>short</p></main><footer>x</footer>", "short"),
        ("<article><p>t</p><div class='comments'><p>reader</p></div><div id='cookie-notice'>c</div></article>", "t"),
        ("<article>cut &am", "cut &am"),
        ("<article><ul><li>one<li>two</ul><table><tr><td>x<td>y</table></article>", "one two x y"),
        ("<article><p>x</p></article><div class=ad>buy</div>", "x"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><p>yes</article>", "yes"),
        ("<div><p>" + LONG + "</p></div>" * 3, LONG.strip()),
    ],
)
def test_pages(html, text):
    assert tag_paths.main_text(html) == text


def test_ratios_decide_without_a_marked_article():
    links = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(30))
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(5)) + "<p>Short one.</p>"
    page = f"<body><div class='box'><ul>{links}</ul></div><div class='text'>{body}</div><div class='end'><span>Top</span></div></body>"
    want = " ".join([f"{LONG}{i}" for i in range(5)] + ["Short one."])
    assert tag_paths.main_text(page) == want


LINKS = "".join(f"<li><a href='/{i}'>Link {i}</a></li>" for i in range(30))
BODY = "".join(f"<p>{LONG}{i}</p>" for i in range(5)) + "<p>Short one.</p>"
TEXT = " ".join([f"{LONG}{i}" for i in range(5)] + ["Short one."])


@pytest.mark.parametrize("part", ["main", "article", "div role='main'"])
def test_ratios_decide_within_a_marked_part(part):
    page = (
        f"<body><div>out</div><{part}><div><ul>{LINKS}</ul></div><div><h1>Head</h1>{BODY}</div>"
        f"<div><h2>More</h2><ul>{LINKS}</ul></div><div><span>Top</span></div></{part.split()[0]}></body>"
    )
    assert tag_paths.main_text(page) == f"Head {TEXT}"


def test_short_parts_of_a_marked_article_stay():
    lists = "<h2>List</h2><ul><li>one<li>two</ul><table><tr><td>x<td>y</table><blockquote>q</blockquote>"
    page = f"<article><header>h</header><h1>Head</h1><div>{BODY}{lists}<ul>{LINKS}</ul></div></article>"
    assert tag_paths.main_text(page) == f"Head {TEXT} List one two x y q"


def test_class_rule_for_nested_articles():
    page = "<{0}><article class='post has-sidebar'>{1}</article>{2}</{0}>"
    comment = f"<article class='comment'><p>{LONG}</p></article>"
    assert tag_paths.main_text(f"<article class='has-sidebar'>{BODY}{comment}</article>") == TEXT
    assert tag_paths.main_text(f"<main><article class='post'>{BODY}</article>{comment}</main>") == TEXT
    assert tag_paths.main_text(page.format("main", BODY, "")) == TEXT


def test_rows(spark):
    rows = [(1, "u", "<article><p>Ünï 😀</p></article>", 1), (1, "u", "<article><p>Ünï 😀</p></article>", 1), (None, None, None, 2), (3, "v", "<article>" + "<p>word</p>" * 20000, 3)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text int")
    out = tag_paths.extract(df).collect()
    assert [(r.page_id, r.url, r.n_chars) for r in out] == [(1, "u", 5), (1, "u", 5), (None, None, 0), (3, "v", 99999)]
    assert out[0].text == "Ünï 😀" and out[2].text == ""
    assert tag_paths.extract(df.limit(0)).collect() == []
