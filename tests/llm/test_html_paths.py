"""``html.extract`` by the votes of each host's pages on tag-class paths."""

from factspark.llm import html

SCHEMA = "page_id long, url string, html string"


def para(n, word):
    return "<p>" + " ".join(f"{word}{k}" for k in range(n)) + "</p>"


def plain(source):
    return " ".join(html.re.sub(r"<[^>]+>", " ", source).split())


def test_long_paths_that_differ_late(spark):
    """Two paths of far over 400 characters, equal up to their last class: their votes must not be pooled, and the winner must be found."""
    deep = "".join(f'<div class="{" ".join(f"utilityq{chr(97 + k)}{chr(97 + x)}" for x in range(9))}">' for k in range(6))
    good = [f'<body>{deep}<div class="story">{para(60, f"g{k}x")}</div><div class="more">{para(8, "m")}</div></body>' for k in range(4)]
    odd = f'<body>{deep}<div class="story">{para(20, "s")}</div><div class="more">{para(90, "m")}</div></body>'  # its own best is the wrong one
    rows = [(k, f"https://long.example/{k}", t) for k, t in enumerate([*good, odd])]
    got = {r["page_id"]: r for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k]["text"] for k in range(4)] == [plain(para(60, f"g{k}x")) for k in range(4)]
    assert got[4]["text"] == plain(para(20, "s"))
    assert len(got[4]["path"]) > 400 and {got[k]["path"] for k in range(5)} == {got[4]["path"]}
    own = html.Page(odd)
    assert own.text(own.best()) != got[4]["text"]


def test_mixed_templates_of_one_host(spark):
    """A third of the pages, and one page of a rare kind, hold their text elsewhere than most, beside a stray block on the common path."""
    lead = f"<div>{para(6, 'lead')}</div>"
    common = [f"<body><div>{para(80, f'c{k}x')}</div></body>" for k in range(20)]
    minority = [f"<body>{lead}<article>{para(80, f'a{k}x')}</article></body>" for k in range(10)]
    rare = f'<body>{lead}<section class="rare">{para(90, "r")}</section></body>'
    led = f'<body><div>{para(40, "short")}</div><section class="rare">{para(70, "around")}</section></body>'  # its own best is not its template
    rows = [(k, f"https://mixed.example/{k}", t) for k, t in enumerate([*common, *minority, rare, led])]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [got[k] for k in range(20)] == [plain(para(80, f"c{k}x")) for k in range(20)]
    assert [got[20 + k] for k in range(10)] == [plain(para(80, f"a{k}x")) for k in range(10)]
    assert got[30] == plain(para(90, "r"))
    assert got[31] == plain(para(40, "short"))


def test_given_pages_whole(spark):
    """``extract`` itself, not the parser alone, gives each given page's article."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r["page_id"]: r["text"] for r in html.extract(pages).collect()}
    for r in pages.collect():
        article = html.re.search(r"<article>(.*?)</article>", r["html"], html.re.S)[1]
        assert got[r["page_id"]] == html.re.sub(r"\s+", " ", html.html.unescape(html.re.sub(r"<[^>]+>", " ", article))).strip()
