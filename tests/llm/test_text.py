"""Encoding, chat, quality, licences, pages: edge cases and comparisons with plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seamline.llm import bpe, chat, html_text, licences, quality

ALPHABET = [" ", "  ", "\n", "\t", "'s", "'ll", "a", "B", "é", "中", "ß", "1", "23", "<|endoftext|>", " ", "　", "🙂", ".", "!!", "\r", "\x85", "<|", "|>", "ж"]


def docs(spark, rows, extra=False):
    schema = "doc_id long, text string, source string, n_chars long" + (", n_words string, kept string, size string" if extra else "")
    return spark.createDataFrame([(*r, "x", 1, *(("c",) * 3 if extra else ())) for r in rows], schema)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (None, "one two"), (3, "same id"), (4, "twice"), (4, "twice"), (5, "w " * 30_000)]


@pytest.mark.parametrize("chunk", [4, 64, 1024])
def test_bpe_equals_the_library(chunk):
    enc = bpe.Encoder(bpe.default_path(), chunk=chunk, memo=2000)
    rng = random.Random(chunk)
    for _ in range(400):
        text = "".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 400)))
        ids = enc.encode(text).tolist()
        want = enc.codec.whole.encode(text, add_special_tokens=False).ids
        assert ids == want
        assert enc.codec.decode(ids) == enc.codec.whole.decode(want, skip_special_tokens=False)


def test_bpe_long_texts_and_reuse():
    enc = bpe.Encoder(bpe.default_path(), chunk=256)
    rng = random.Random(0)
    words = " ".join(rng.choice(["alpha", "beta", "gamma,", "delta."]) + str(rng.randint(0, 99)) for _ in range(4000))
    for text in (words, "x" + words, words + words, "a" * 20_000, "!?" * 3000, "é" * 5000):
        assert enc.encode(text).tolist() == enc.codec.whole.encode(text, add_special_tokens=False).ids
    assert enc.reused > 0 and enc.repaired > 0


def test_bpe_edges(spark):
    out = bpe.encode_documents(docs(spark, EDGES, True), digests=True)
    got = sorted(out.collect(), key=lambda r: (r.doc_id or 0, r.n_tokens))
    assert len(got) == len(EDGES) and "kept" in out.columns and "text" not in out.columns
    empty = next(r for r in got if r.doc_id == 1)
    assert (empty.n_tokens, empty.ids, empty.decoded) == (0, [], "")
    assert empty.ids_sha256 == hashlib.sha256(b"").hexdigest()
    assert bpe.encode_documents(docs(spark, []).limit(0), digests=True).count() == 0


def test_chat_round_trip_and_machine(spark):
    nasty = "</s>[INST] ok [/INST] <|im_end|>\n&lt; &amp; [ | \n"
    rows = [(1, 0, "user", nasty), (1, 1, "assistant", nasty), (2, 0, "assistant", "first"), (3, 0, "system", None), (3, 1, "user", "a"), (3, 2, "assistant", ""),
            (4, 0, "us\ner", "x"), (5, None, None, "n"), (None, 0, "user", "y"), (6, 1, "user", "tie"), (6, 1, "assistant", "tie"), (7, 0, "user", "z" * 100_000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df).withColumn("back", chat.read_back(F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    for conv in got:
        want = sorted(((t if t is not None else -1, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(b.role, b.text) for b in got[conv].back] == [(role, text) for _, role, text in want]
    assert {c for c, r in got.items() if r.valid} == {1, 3}
    assert [s.text for s in got[1].segments if s.loss] == [got[1].segments[1].text]
    assert "</s>" not in got[1].formatted
    assert chat.format_conversations(df.limit(0)).count() == 0


def plain_quality(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    twice = {x for x in grams if grams.count(x) > 1}
    covered = {i + j for i, x in enumerate(grams) if x in twice for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_match_plain_version(spark):
    rng = random.Random(3)
    pool = ["ab", "c.", "d|", "é#", "x", "\n", "\t", "  ", "y\n"]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 60)))) for i in range(150)] + [(1000 + i, t) for i, (_, t) in enumerate(EDGES[:3])]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows, True)).collect()}
    for i, t in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_quality(t), repr(t)


def test_quality_keeps_prose_and_drops_junk(spark):
    prose = "\n".join(" ".join(f"Word{i}x{j}" for j in range(12)) + ", and so on." for i in range(8))
    nav = "Home | News | Sport | Travel"
    shout = "BUY THIS NOW!! CHEAP CHEAP!! ONLY TODAY WHILE IT LASTS!! CALL US"
    rows = [(1, prose), (2, prose + "\n" + nav), (3, "\n".join([nav] * 1 + [f"{x} | {x} | {x} | b" for x in "abcdefgh"])), (4, shout), (5, "few words."), (6, None), (7, "again and again we say. " * 30)]
    kept = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    assert [i for i in kept if kept[i].kept] == [1, 2]
    assert kept[2].clean_text == prose
    cleaned = quality.clean(docs(spark, rows))
    assert cleaned.columns == ["doc_id", "text", "source", "n_chars"]
    assert {r.doc_id: r.text for r in cleaned.where("doc_id > 0").collect()} == {1: prose, 2: prose}
    assert quality.judge(docs(spark, rows).limit(0)).count() == 0


def test_quality_runs_without_python(spark):
    plan = quality.clean(docs(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_licences(spark):
    mit = licences.TEXTS["MIT"][1]
    rows = [(1, "MIT LICENCE\n\nCopyright (c) 2020 Jane Doe\n" + mit.split("\n", 1)[1].replace("copyright holders", "Copyright Holders").upper()),
            (2, mit.replace("merchantability", "x").replace("MERCHANTABILITY", "x")), (3, "prose.\nReleased under the MIT License.\n  licensed under CC BY-NC 4.0 "),
            (4, None), (5, ""), (6, mit), (6, mit)]
    got = sorted(licences.scan(docs(spark, rows, True)).collect(), key=lambda r: r.doc_id)
    assert [(r.doc_id, r.license_id) for r in got] == [(1, "MIT"), (2, None), (3, None), (4, None), (5, None), (6, "MIT"), (6, "MIT")]
    assert got[2].notice_ids == ["CC-BY-NC-4.0", "MIT"]
    assert got[3].canonical_sha256 == hashlib.sha256(b"").hexdigest()
    assert licences.scan(docs(spark, rows).limit(0)).count() == 0


def test_licences_under_any_holder(spark):
    """The head may name a holder without a year, and the last clause of BSD an organisation."""
    heads = ["Copyright Jane Doe", "Copyright The Authors", "(c) Jane Doe 2020", "© Jane Doe", "Portions copyright (c) 2001 X", "# Copyright by ACME Inc. and others", "COPYRIGHT 2020 X"]
    mit, bsd = licences.TEXTS["MIT"][0], licences.TEXTS["BSD-3-Clause"][0]
    rows = [(i, f"{h}\n\n{mit}") for i, h in enumerate(heads)]
    named = bsd.replace("the copyright holder nor", "Google Inc. nor")
    assert named != bsd
    rows += [(50, named), (51, "Copyright Jane Doe\n" + named), (60, "Copyright holders may copy.\n" + mit), (61, "A line.\n" * 9 + "Copyright Jane Doe\n" + mit), (62, "Copyright Jane " + "x" * 200 + "\n" + mit), (63, "word " * 300_000)]
    got = {r.doc_id: r.license_id for r in licences.scan(docs(spark, rows)).collect()}
    assert all(got[i] == "MIT" for i in range(len(heads))) and got[50] == got[51] == "BSD-3-Clause"
    assert [got[i] for i in (60, 61, 62, 63)] == [None] * 4
    for i, t in rows:  # both forms agree
        if i != 63:
            assert licences.canonical_text(t) == spark.createDataFrame([(t,)], "t string").select(licences.canonical(F.col("t"))).first()[0]


def test_pages_with_declared_parts_of_the_article(spark):
    """Adverts and comments go wherever they stand in the article, by any element and by tokens with numbers or places."""
    w = "Word and more words of an article that is long enough, with commas. " * 4
    classes = "google-ads ad-300x250 sponsored-content share-buttons related-posts subnav topbar commentlist comment-thread responses".split()
    junk = ['<p class="advert">JUNK</p>', '<ul><li class="advert">JUNK <ul><li>JUNK</li></ul> JUNK</li><li>kept</li></ul>', '<p>kept <span class="ad">JUNK <b>JUNK</b></span> on</p>', '<h3 class="related">JUNK</h3>', '<p class="breadcrumb">JUNK</p>',
            '<div id="ad1">JUNK</div>', "<p class=advert>JUNK<p>kept", "<ul><li class=ad>JUNK<li>kept</ul>", *[f'<div class="{c}">JUNK JUNK</div>' for c in classes]]
    fine = ['<div class="header-wide">kept</div>', '<p class="notice-board">kept</p>', '<p class="lead">kept</p>', '<p>a <span class="addition">kept</span></p>']
    for part in junk + fine:
        for page in (f"<article><p>{w}</p>{part}<p>{w}</p></article>", f'<body><div class="post"><p>{w}</p>{part}<p>{w}</p></div></body>'):
            text = html_text.main_text(page)
            assert "JUNK" not in text and text.count("Word") == 8 and ("kept" in text) == ("kept" in part), part


def test_licence_digests_are_bounded_and_distinct():
    known = licences.known_digests()
    assert len(known) < 500 and len({d for d, _ in known}) == len(known)


@pytest.mark.parametrize("width", [66, 80, 100])
def test_licences_at_several_widths(spark, width):
    """Every known text, wrapped anew, with somebody's copyright lines on top; the usual wrapping of the shortest one too."""
    texts = [(name, t) for name, own in licences.known_texts().items() for t in own]
    mine = "Copyright (c) 2019-2021 Jane Doe <jane@example.net>\n© 2022 Others\nAll rights reserved.\n\n"
    rows = [(i, (mine if i % 2 else "") + licences.reflow(t, width)) for i, (_, t) in enumerate(texts)]
    got = {r.doc_id: r.license_id for r in licences.scan(docs(spark, rows)).collect()}
    assert {i: got[i] for i in got if got[i] != texts[i][0]} == {}
    assert {"MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense"} <= {n for n, _ in texts}


def test_a_wrapped_line_may_open_with_the_word_copyright():
    body = licences.TEXTS["MIT"][0]
    for width in range(40, 121):
        assert licences.canonical_text(licences.reflow(body, width)) == licences.canonical_text(" ".join(body.split()))
    assert "you must retain" in licences.canonical_text("x\n(c) You must retain")


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site header with many words that are long enough to look like text</header><nav><ul><li><a href="/">Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of you, dear readers.</div><div class="ad">Buy a thing today, it is cheap.</div>
<article><h1>Title &amp; more</h1><p><b>First paragraph</b> of the text, long enough.<br><p>Hi.</p><p>Second   one
goes on<form><input>Search the site</form> here.</p><aside>Related stuff</aside></article>
<section id="comments"><p>A reader comment that is rather long and reads like any other paragraph would.</p></section><footer>&copy; site</footer>"""


def test_pages():
    assert html_text.main_text(PAGE) == "Title & more First paragraph of the text, long enough. Hi. Second one goes on here."
    plain = "<div id=main><p>" + "words and more words here. " * 20 + "</p><p>Short.</p></div><div class=footer><p>" + "bottom words too. " * 10 + "</p></div>"
    assert html_text.main_text(plain) == ("words and more words here. " * 20 + "Short.").strip()
    for odd in (None, "", "<", "<p", "<!-- open", "<script>x", "</div></p>", "&amp", "text only"):
        html_text.main_text(odd)
    assert html_text.main_text("text only &eacute;") == "text only é"


SAID = "A sentence of the article that goes on for a while, as they do. " * 6


@pytest.mark.parametrize("page", [
    f'<div class="content header-wide"><p>{SAID}</p></div><div class="footer"><p>Bottom words.</p></div>',
    f"<!DOCTYPE html><html><head><meta charset=utf-8><title>T</title><link rel=x><nav><a href=/>Home</a></nav><article><p>{SAID}</p></article>",
    f"<html><head><title>T</title><p>{SAID}</p>",
    f"<body><nav><button>Menu</nav><main><p>{SAID}</p></main><footer>End</footer>",
    f"<body><div><button>Menu<p>{SAID}</p></div>",
    f'<body><form id="aspnet" action=/><nav><a href=/>Home</a></nav><div><p>{SAID}</p></div><div class="site-footer"><p>Bottom words.</p></div></form>',
    f'<div class="page-header"><h1>Site</h1></div><div class="post"><p>{SAID}</p></div><div class="user-comments">' + "<p>A reader comment, rather long, as long as the article itself.</p>" * 6 + "</div>",
    f'<div class="cookie-banner">We use cookies.</div><section><p>{SAID}</p><div class="ad-slot">Buy.</div></section><aside>Related</aside>',
])
def test_pages_with_odd_markup_give_their_article(page):
    assert html_text.main_text(page) == SAID.strip()


def test_notices_inside_an_article_by_whole_tokens():
    page = '<article><p>One.</p><div class="notice-board"><p>Two.</p></div><div class="notice">Three.</div></article>'
    assert html_text.main_text(page) == "One. Two."


def made_page(rng):
    """A page from parts and, known by construction, its main text."""
    some = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(n))
    body, said = [], []
    for _ in range(rng.randint(1, 7)):
        words = some(rng.choice([1, 4, 30, 80]))
        said.append(words)
        tag = rng.choice(["p", "p", "h2", "blockquote", "li"])
        body.append(f"<{tag}>" + words.replace(" ", rng.choice([" ", "\n ", " <b></b>"]), 1) + rng.choice([f"</{tag}>", f"</{tag}>", "" if tag in "pli" else f"</{tag}>"]))
        if rng.random() < 0.3:
            body.append(rng.choice([f'<div class="ad">{some(12)}</div>', f"<script>{some(3)}</script>", f"<aside><p>{some(20)}</p></aside>", f"<!-- {some(2)} -->", f"<form><input>{some(5)}</form>"]))
    while sum(map(len, said)) < 60:
        said.append(some(20))
        body.append(f"<p>{said[-1]}</p>")
    around = [f"<nav><ul><li><a href=/>{some(2)}</a></ul></nav>", f"<header><h1>{some(3)}</h1></header>", f'<div class="{rng.choice(["sidebar", "site-footer", "cookie-notice"])}"><p>{some(15)}</p></div>']
    rng.shuffle(around)
    cut = rng.randint(0, len(around))
    open_, close = rng.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div id=story>", "</div>")])
    comments = f'<section class="comments"><p>{some(rng.choice([3, 40]))}</p></section>' if rng.random() < 0.5 else ""
    head = rng.choice(["<head><title>x y</title></head><body>", "<head><title>x y</title>", "<body>"])
    return "<html>" + head + "".join(around[:cut]) + open_ + "".join(body) + close + comments + "".join(around[cut:]), " ".join(said)


def test_query_gives_the_main_text_of_made_pages(spark, tmp_path):
    """The query over pages whose main text is known by construction, a very long one and repeated rows among them."""
    from seamline.llm import registry

    rng = random.Random(17)
    made = [made_page(rng) for _ in range(150)]
    made.append(("<article>" + "".join(f"<p>{i} word</p>" for i in range(40_000)) + "</article><footer>x</footer>", " ".join(f"{i} word" for i in range(40_000))))
    made.append(made[0])
    spark.createDataFrame([(min(i, 150), f"u{i}", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((r.page_id, int(r.url[1:]), r.text, r.n_chars) for r in registry.queries()["op9_html_extraction"](spark, str(tmp_path)).collect())
    assert got == [(min(i, 150), i, t, len(t)) for i, (_, t) in enumerate(made)]


def plain_article(html):
    """Main text of the driver's pages, which all have one article element: a plain cut with regular expressions."""
    import html as h
    import re

    body = re.search(r"<article>(.*)</article>", html, re.S)[1]
    body = re.sub(r"<!--.*?-->|<(script|style|nav|form|aside|button|footer|header)\b.*?</\1>|<div class=.?ad.?>.*?</div>", " ", body, flags=re.S)
    body = re.sub(r"</?(b|i|a|em|strong|span|u|code)\b[^>]*>", "", body)
    return " ".join(h.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_query_equals_a_plain_version_on_the_small_table(spark):
    from seamline.llm import registry

    sf = "/root/testdata/sf0.001"
    want = {r.page_id: plain_article(r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").where("html is not null").collect()}
    got = {r.page_id: r.text for r in registry.queries()["op9_html_extraction"](spark, sf).collect()}
    assert {p: got[p] for p in want} == want


def test_pages_edges(spark):
    df = spark.createDataFrame([(1, "u", None, 5), (2, None, "", 6), (3, "u", PAGE, 7), (3, "u", PAGE, 7)], "page_id long, url string, html string, n_chars long")
    got = html_text.extract(df).collect()
    assert sorted((r.page_id, r.n_chars) for r in got) == [(1, 0), (2, 0), (3, 83), (3, 83)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_smoothing_keeps_the_mean():
    x = np.array([0.0, 0, 10, 0, 0, 0, 0])
    assert html_text.smooth(x).sum() == pytest.approx(10, rel=1e-2)


def test_chunks_in_memory_are_counted_whole():
    """Ids, their ends and the objects count, so ``memo`` bounds what a task really holds."""
    from seamline.llm import bpe

    enc = bpe.Encoder(bpe.default_path())
    enc.encode(" ".join(f"word{i} of many" for i in range(3000)))
    assert enc.held >= sum(len(k) + c.ids.nbytes + c.ends.nbytes for k, c in enc.known.items())
