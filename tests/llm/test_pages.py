import pytest

from tallyglass.llm import extract

MENU = "<nav><a>Home</a><a>News</a></nav><header class=site>The Site</header>"
NOTE = "<div>This web site stores small files on your device to remember what you chose last time</div>"


def _page(body, head="<title>T</title><style>p{}</style><script>var a='<p>no</p>';</script>"):
    return f"<!DOCTYPE html><html><head>{head}</head><body>{MENU}{body}<footer>&copy; 2020</footer></body></html>"


@pytest.mark.parametrize(("html", "text"), [
    ("", ""), ("plain &amp; simple\n text", "plain & simple text"), ("<p>a<p>b", "a\n\nb"), ("<p>a<br>b&nbsp;c</p>", "a b c"),
    (_page("<article><h1>Title</h1><p>One &lt;two&gt; <b>three</p><p>four</article>"), "Title\n\nOne <two> three\n\nfour"),
    (_page("<article><p>a</p><aside>x</aside><div class='reader-comments'><p>y</p></div><p class=notice>z</p><p>b</p></article>"), "a\n\nb"),
    (_page("<article><p>a</p><form><p>mail</p><input></form><ul><li>i<li>j</ul></article><div>outside</div>"), "a\n\ni\n\nj"),
    (_page("<main><div hidden>h</div><div style='display: none'>s</div><p>x<!-- c --> y</p></main>"), "x y"),
    ("<article><p title='a>b'>quoted</p><p title='open>rest</p></article>", "quoted\n\nrest"),
    ("<div id=main><p>one long paragraph</p><p>two long paragraph</p><p>three long one</p></div><article><p>Short teaser</p></article>", "one long paragraph\n\ntwo long paragraph\n\nthree long one\n\nShort teaser"),
    ("<article><div class='share-price'><p>The price rose</p></div><div id=notice-of-motion>Moved</div><div class=comments-on-law>Law</div><p class=social-sciences>S</p><div class=search-results>R</div></article>",
     "The price rose\n\nMoved\n\nLaw\n\nS\n\nR"),
    ("<div class='post-header'><h1>Title</h1></div><p>text</p><div class='site-header'>Site</div><div class='comment-list'><p>c</p></div><div class=ad-slot-3>buy</div><div class=left_sidebar>s</div>", "Title\n\ntext"),
    ("<article><p>a</p><div class='related-work-and-more'><a href=x>first link here</a> <a href=y>second link</a></div></article>", "a"),
    ("<article><p>cut off &am", "cut off &am"), ("<article><script>never closed <p>x", ""), ("<p>İ<script>a</SCRIPT >b</p>", "İ b"),
])
def test_one_page(html, text):
    assert extract.choose([extract.blocks(html)]) == [text]


def test_repeated_blocks_go_and_copies_stay():
    pages = [_page(f"{NOTE}<div>{' '.join(f'word{i}x{k}' for k in range(40))}</div>") for i in range(6)]
    assert extract.choose([extract.blocks(p) for p in pages]) == [" ".join(f"word{i}x{k}" for k in range(40)) for i in range(6)]
    same = ["<div>" + " ".join(f"copy{k}" for k in range(30)) + "</div>"] * 4
    assert extract.choose([extract.blocks(p) for p in same]) == [" ".join(f"copy{k}" for k in range(30))] * 4


def test_template_inside_articles_goes_and_shared_passages_stay():
    own = [" ".join(f"a{i}b{k}" for k in range(40)) for i in range(12)]
    call = "Become a member today and read every story that our writers publish this year"
    passage = "this passage of many words stands in some of the articles of the host and must not go"
    pages = [f"<article><p>{own[i]}</p><p>{call}</p>{f'<p>{passage}</p>' if i % 2 else ''}</article>" for i in range(12)]
    assert extract.choose([extract.blocks(p) for p in pages]) == [own[i] + (f"\n\n{passage}" if i % 2 else "") for i in range(12)]


@pytest.mark.parametrize("shard", [extract.SHARD, 500])
def test_table(spark, shard):
    rows = [(i, f"https://h{i % 2}.example.org/{i}", _page(f"<article><p>text {i} &eacute;</p></article>"), "x", 3) for i in range(20)]
    rows += [(20, None, "<p>no url</p>", "x", 3), (21, "https://h0.example.org/", None, "x", 3), (22, "odd", "", "x", 3), (3, rows[3][1], rows[3][2], "x", 3),
             (23, "https://long.example.org/", "<article><p>" + "long text " * 50_000 + "</p></article>", "x", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, page int")
    got = extract.main_text(pages, shard=shard)
    assert got.columns == ["page_id", "url", "text"]
    want = [(i, u, f"text {i} é" if i < 20 else {20: "no url", 23: ("long text " * 50_000).strip()}.get(i, "")) for i, u, *_ in rows]
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert extract.main_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize("shard", [extract.SHARD, 20_000])
def test_a_block_on_few_pages_of_a_large_host_goes(spark, shard):
    own = [" ".join(f"own{i}x{k}" for k in range(40)) for i in range(200)]
    section = "<div>Section pages about the garden and the kitchen and all that belongs to them</div>"
    pair = " ".join(f"two{k}" for k in range(12))
    rows = [(i, f"https://big.example.org/{i}", f"{section if i % 16 == 0 else ''}<div>{own[i]}</div>{f'<p>{pair}</p>' if i in (5, 6) else ''}") for i in range(200)]
    got = extract.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), shard=shard).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: own[i] + (f"\n\n{pair}" if i in (5, 6) else "") for i in range(200)}


def test_a_long_banner_on_every_page_goes_and_whole_copies_stay():
    banner = " ".join(f"banner{k}" for k in range(40))
    pages = [f"<div>{banner}</div><p>page{i} is short and stands alone</p>" for i in range(10)]
    assert extract.choose([extract.blocks(p) for p in pages]) == [f"page{i} is short and stands alone" for i in range(10)]
    assert extract.choose([extract.blocks(f"<div>{banner}</div><p>the same</p>")] * 10) == [f"{banner}\n\nthe same"] * 10
