import random
import time

import pytest

from segstat.llm import html_blocks, token_counts
from segstat.llm.queries import tokenizer_path

CASES = [
    ("", ""),
    ("<p>short", "short"),
    ("<html><body><nav><a href=/a>One</a><a>Two</a></nav><article><h1>Head &amp; tail</h1><p>First <b>bo</b>ld<br>second</p><p>x &lt; y</article><footer>no</footer>",
     "Head & tail First bold second x < y"),
    ("<article><p>Kept</p><aside>no</aside><form>no</form><div class='comment-list'><p>no</p></div><p>also  \n kept</article><p>outside", "Kept also kept"),
    ("<main><header><h1>Title</h1></header><p>Body</p></main><header>Site</header>", "Title Body"),
    ("<div id=sidebar>" + "links and links " * 20 + "</div><div><p>" + "real words stand here " * 8 + "</p><p>end</p></div><div class=cookie-notice>" + "we use " * 30 + "</div>",
     ("real words stand here " * 8).strip() + " end"),
    ("<article>a<script>var t='</p>';</script>b<style>p{}</style><!-- c --> d &#233;&nbsp;e < f</article>", "ab d é e < f"),
    ("<article><p>one</p><div class='ad'>buy</div><p>two", "one two"),
    ("<article " + "x" * 5000 + "<p>begun in a tag", "begun in a tag"),
    ("<div class='content has-sidebar'><p>" + "an article in here " * 12 + "</p></div>", ("an article in here " * 12).strip()),
    ("<div id='post'><p>A short article of one line.</p></div>", "A short article of one line."),
    ("<p title=don't>Hello there</p><p>and it's more</p>", "Hello there and it's more"),
    ("<p>before it</p><a name=top><p>all of the text after the anchor</p>", "before it all of the text after the anchor"),
    ("<p>Text with <a href=x>an unclosed link<p>and more text here</p>", "Text with an unclosed link and more text here"),
    ("<head><title>no</title><body><p>head never closed</p>", "head never closed"),
    ("<main><article><p>The post</p></article><article class=comment><p>a reader</p></article><p class='advert'>buy</p><p>end</p></main>", "The post end"),
]
WORDS = "plain words of the text "
TEASER = "<article><p>Read this too</p></article>" + "<div><p>" + WORDS * 20 + "</p><p>last line</p></div>"
NOTICE = "<div>We set cookies</div>" + "<div><a href=a>Menu entry</a></div>" * 4 + "<div><p>" + WORDS * 20 + "</p></div>" + "<div><a href=b>Next one</a></div>" * 4 + "<div>All rights</div>"


@pytest.mark.parametrize("page,want", CASES)
def test_main_text(page, want):
    assert html_blocks.main_text(page) == want


def test_windows_decide():
    """Without windows (every line its own, no surge) the unmarked notice and footer stay and the teaser hides the text."""
    assert html_blocks.main_text(NOTICE) == (WORDS * 20).strip()
    assert html_blocks.main_text(NOTICE, window=1, share=10 ** 6) == "We set cookies " + WORDS * 20 + "All rights"
    assert html_blocks.main_text(TEASER) == "Read this too " + WORDS * 20 + "last line"
    assert html_blocks.main_text(TEASER, share=10 ** 6) == "Read this too"


def plain_lines(lines):
    """The rule on (text, is link, in article) lines, each window added up anew."""
    weight = [0 if link and not main else len(text) for text, link, main in lines]
    add = lambda w, i: sum(w[i:i + 3])
    own = [w if main else 0 for w, (_, _, main) in zip(weight, lines)]
    need = max([1, max([add(weight, i) for i in range(len(lines))], default=0) // 8])
    if any(add(own, i) >= need for i in range(len(lines))):
        weight, need = own, 1
    kept, begun = [], False
    for i, (text, _, _) in enumerate(lines):
        begun = add(weight, i) > 0 and (begun or add(weight, i) >= need)
        kept += [text] if begun and weight[i] else []
    return " ".join(kept)


def test_equals_a_plain_scan_of_lines():
    rng = random.Random(11)
    for _ in range(400):
        parts = []
        for main in rng.choice([[False], [False, True, False], [True]]):
            parts += [("w" * rng.choice([1, 5, 30, 400]), rng.random() < 0.5, main) for _ in range(rng.randrange(9))]
        page, was = "", False
        for text, link, main in parts:
            page += "<article>" * (main and not was) + "</article>" * (was and not main)
            page += f"<div><a href=x>{text}</a></div>" if link else f"<div>{text}</div>"
            was = main
        assert html_blocks.main_text(page) == plain_lines(parts)


LONG = ["<a " * 330_000, "<script" * 150_000, '<a ="<a >"' * 100_000, "<div>" * 60_000 + "</x>" * 100_000, "<" * 10 ** 6, "<!--" * 250_000,
        '<a ="x>y" ' * 100_000, "<div " + 'class="' * 150_000 + ">", "<p title='x =\"" * 70_000 + ">", "&" * 10 ** 6]


@pytest.mark.parametrize("page", LONG, ids=range(len(LONG)))
def test_a_megabyte_of_odd_markup(page):
    begun = time.process_time()
    html_blocks.main_text(page)
    assert time.process_time() - begun < 10


def test_pages_table(spark):
    rows = [(i, f"u{i}", page, "t", 5) for i, (page, _) in enumerate(CASES)] + [(50, None, None, None, None), (1, "u1", CASES[2][0], "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int")
    found = html_blocks.extract(pages)
    assert sorted(found.columns) == ["html", "n_chars", "page_id", "text", "url"]
    got = sorted((r["page_id"], r["text"], r["n_chars"]) for r in found.collect())
    want = sorted([(i, t, len(t)) for i, (_, t) in enumerate(CASES)] + [(50, "", 0), (1, CASES[2][1], len(CASES[2][1]))])
    assert got == want and html_blocks.extract(pages.limit(0)).collect() == []


def plain(pieces):
    from tokenizers import Tokenizer, models, pre_tokenizers
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return lambda text: len(t.encode(text, add_special_tokens=False).ids)


def test_counts_match_the_tokenizer(spark, small):
    pieces = token_counts.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    counter, want = token_counts.Counter(pieces), plain(pieces)
    rng = random.Random(1)
    texts = ["", " ", "  ", "a  b", " a", "\n", "日本 🎉🎉 x", "<0x0A> <s>", "▁a▁▁b", "a ", "é" * 900]
    texts += ["".join(rng.choice("abc é▁ \n🎉日x<>s") for _ in range(rng.randrange(40))) for _ in range(300)]
    assert [counter.text(t) for t in texts] == [want(t) for t in texts]
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(80)
    docs = docs.unionByName(spark.createDataFrame([(900, None, "en", "s", 0), (None, "a", None, None, None)], docs.schema)).selectExpr("*", "1 AS n_tokens")
    found = token_counts.count_tokens(docs, tokenizer_path("piece_bpe_32k.model"))
    assert sorted(found.columns) == sorted(docs.columns)
    assert all(r["n_tokens"] == want(r["text"] or "") for r in found.collect())
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path("piece_bpe_32k.model")).collect() == []


def test_ties_take_the_longer_last_piece():
    pieces = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("aa", -2.0), ("▁a", -2.0), ("b", -1.0)] + [(f"<0x{i:02X}>", -20.0) for i in range(256)]
    counter, want = token_counts.Counter(pieces), plain(pieces)
    for n in range(1, 9):
        assert counter.text("a" * n + "b") == want("a" * n + "b")
