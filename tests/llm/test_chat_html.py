import hashlib
import random
import time

import pytest

from boscage.llm import chat, html

SCHEMA = "conv_id long, turn long, role string, text string, example string"


def test_escape_round_trip():
    rng = random.Random(4)
    parts = ["\\", "###", "#", "</turn>", "</turn>\n", "<", ":", "\n", "a", "### Assistant: ", " "]
    for _ in range(3000):
        turns = [("".join(rng.choice(parts) for _ in range(rng.randint(0, 4))), "".join(rng.choice(parts) for _ in range(rng.randint(0, 6)))) for _ in range(rng.randint(1, 4))]
        text = "".join(f"{chat.HEAD}{chat.escape_role(r)}: {chat.escape(t)}{chat.END}" for r, t in turns)
        assert chat.parse(text) == turns


def test_prefix_examples(spark):
    rows = [
        (1, 0, "user", "hi", "x"), (1, 1, "assistant", "\\### Assistant: </turn> ok", "x"), (1, 2, "user", None, "x"), (1, 3, "assistant", "", "x"),
        (2, 0, "system", "s", "x"), (2, 1, "user", "u" * 50000, "x"),
        (3, 0, "assistant", "a", "x"), (3, 0, "assistant", "a", "x"), (3, 1, "assistant", "b", "x"),
        (4, None, None, None, None), (None, 1, "assistant", "n", None), (5, 1, "assistant", "second", "x"), (5, 0, "user", "first", "x"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    examples = chat.prefix_examples(df)
    assert examples.where("conv_id = 1 and loss_start is not null").count() == 2
    for e in examples.where("conv_id = 5").collect():
        assert e.text[e.loss_start : e.loss_end] == "second" and chat.parse(e.text) == [("user", "first"), ("assistant", "second")]
    got = {r.conv_id: r for r in chat.digests(examples).collect()}
    by = {}
    for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    assert set(got) == set(by)
    for k, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[k].n_turns == len(turns)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[k].loss_chars, got[k].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digests(chat.prefix_examples(spark.createDataFrame([], SCHEMA))).count() == 0


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<nav><a>menu</a></nav>", ""),
        ("<body><nav><ul><li><a>a</a></li></ul></nav><div class='ad'>buy now please buy</div><article><h1>T</h1><p>one &amp; two\n three<p><b>x</b>y<br>z</article><footer>f</footer></body>", "T\none & two three\nxy\nz"),
        ("<article><p>a<script>var x='</p><p>no'</script>b<!-- c <p> --></p><form><p>mail</p></form><p>d &copy &am</article><section id=comments><p>me too</p></section>", "ab\nd © &am"),
        ("<article><p>" + "w " * 5000 + "</p><p>end <a", "w " * 4999 + "w\nend"),
        ("<div class=sidebar>s<article><p>inside an unclosed one</p></article>", "inside an unclosed one"),
    ],
)
def test_main_text(page, want):
    assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<html class='no-banner'><body class='has-sidebar'><p>one two three four</p></body></html>", "one two three four"),
        ("<body class=sidebar><p>one two three four</p></body>", "one two three four"),
        ("<div id='content' class='with-comments'><p>one two three four</p></div>", "one two three four"),
        ("<nav><a>x</a></nav><div class='widget post-body'><p>one two three four</p></div><div class='site-footer'>five</div>", "one two three four"),
        ("<article><header class='entry-header'><h1>Title here</h1></header><p>one two three</p><figure><img><figcaption>a caption</figcaption></figure><p>more</p></article>", "Title here\none two three\na caption\nmore"),
        ("<article><p>one two</p></article><section class='comment-list'><p>a b c d e f g h</p></section>", "one two"),
        ("<article><p>one two three</p><div class='ad-box'>buy</div><div class='social-share'>share</div><p>four five six</p></article>", "one two three\nfour five six"),
    ],
)
def test_names_do_not_overrule_the_words(page, want):
    assert html.main_text(page) == want


def test_best_run_is_brute_force():
    rng = random.Random(6)
    for _ in range(300):
        x = [rng.uniform(-1, 1) for _ in range(rng.randint(0, 12))]
        best = max([0.0, *(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1))])
        a, b = html.best_run(x)
        assert abs(sum(x[a:b]) - best) < 1e-12


def built_page(rng):
    """A page and its text, made side by side from parts that the weights never saw."""
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9)))
    say = lambda n: [word() for _ in range(n)]
    blocks, raw = [], []
    for _ in range(rng.randint(2, 9)):
        w = say(rng.randint(12, 60))
        kind = rng.choice(["p", "p", "p", "h2", "blockquote", "li", "table", "note", "open"])
        if kind == "li":
            raw.append("<ul>" + "".join(f"<li>{x}" for x in w[:6]) + "</ul>")
            blocks += w[:6]
        elif kind == "table":
            raw.append(f"<table><tr><td>{w[0]}</td><td class='x'>{w[1]}</td></tr></table>")
            blocks += w[:2]
        elif kind == "note":
            raw.append(rng.choice(["<div class='ad'>{}</div>", "<aside>{}</aside>", "<form><input value='>'>{}</form>", "<script>'</p>'+{}</script>", "<!-- {} -->", "<style>{}</style>", "<nav><a>{}</a></nav>"]).format(" ".join(w[:5])))
        elif kind == "open":
            raw.append(f"<p>{w[0]}&amp;{w[1]} <b title='a>b'>{w[2]}</b>\n\t{' '.join(w[3:])}")
            blocks.append(f"{w[0]}&{w[1]} {w[2]} {' '.join(w[3:])}")
        else:
            raw.append(f"<{kind}>{' '.join(w)}</{kind}>")
            blocks.append(" ".join(w))
    menu = "<nav><ul>" + "".join(f"<li><a href=/{i}>{word()}</a></li>" for i in range(rng.randint(2, 8))) + "</ul></nav>"
    head = f"<!doctype html><html><head><title>{word()}</title><meta name=x></head><body><header><div>{word()}</div></header>{menu}"
    tail = rng.choice(["<section class='comments'><article><p>{}</p></article></section>", "<aside><h3>{}</h3></aside>", "<div id='cookie-notice'><p>{}</p></div>", "<form><label>{}</label></form>"]).format(" ".join(say(9)))
    wrap = rng.choice(["article", "main"])
    return f"{head}<{wrap}>{''.join(raw)}</{wrap}>{tail}<footer><p>{' '.join(say(6))}</p></footer></body></html>", "\n".join(blocks)


def test_built_pages():
    rng = random.Random(12)
    for _ in range(200):
        page, want = built_page(rng)
        assert html.main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body class='single has-sidebar'><div class=content><p>one two three</p></div></body>", "one two three"),
        ("<article><p>one two three four five six</p></article><section class=comments><article><p>reader says a b</p></article></section>", "one two three four five six"),
        ("<article><p>one two three four</p></article><aside><article><p>related card</p></article></aside>", "one two three four"),
        ("<article><p class='lead share-me'>one two</p><figure><img><figcaption>cap tion</figcaption></figure><label>lab el</label><object>obj</object></article>", "one two\ncap tion\nlab elobj"),
        ("<form id=aspnetForm><div><p>one two three four</p></div></form>", "one two three four"),
        ("<p class=ad>buy<p>one two three", "one two three"),
        ("<article><p>a &am<b>p;</b> c</p></article>", "a &amp; c"),
        ("<article><p>one two three</p></article><article class=comment><p>mine</p></article>", "one two three"),
        ("<article data-x='a>b'><p>one two</p></article>", "one two"),
        ("<article><p>a<p>b</article>", "a\nb"),
    ],
)
def test_whole_article_and_nothing_else(page, want):
    assert html.main_text(page) == want


def test_broken_pages_take_linear_time():
    for page in ("<p" + " a" * 200, "<p" + " a" * 50_000, "<a b='" * 30_000, "<div>" * 30_000 + "</x>y" * 30_000, "<!--" * 30_000, "<script>" * 5_000, "<p>x" * 30_000):
        before = time.process_time()
        html.main_text(page)
        assert time.process_time() - before < 10


def test_extract(spark):
    schema = "page_id long, url string, html string, text string"
    df = spark.createDataFrame([(1, "u", "<p>a b</p>", "x"), (1, "u", "<p>a b</p>", "x"), (None, None, None, None)], schema)
    got = sorted(tuple(r) for r in html.extract_main_text(df).where("page_id is not null").collect())
    assert got == [(1, "u", "a b", 3)] * 2
    assert html.extract_main_text(df).count() == 3
    assert html.extract_main_text(spark.createDataFrame([], schema)).count() == 0
