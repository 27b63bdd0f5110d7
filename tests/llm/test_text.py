"""Main text, licences, quality rules and token files."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from compare import connect, duck_rows, spark_rows
from fixtures import SF, empty, odd, odd_rows, words
from tokenizers import Tokenizer

from inkspark.llm import html_extract, licenses, quality, token_files
from inkspark.llm.encode import Encoder
from inkspark.llm.queries import ORACLE, QUERIES

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=/a>Menu</a></ul></nav>
<div id="cookie-notice">We use cookies</div><!-- x --><div class="ad">Buy</div>
<article><h1>Title &amp; co</h1><p><b>One <a href="x>y">two</a>&nbsp;three<br>four
<p>five &lt;six&gt; &eacute; &#233; &bogus;</p><ul><li>a<li>b</ul>
<form><input value="z">Send</form><aside>Side</aside><script>var t="</p>";</script>
<div class="share-buttons">Share</div>{more}</article>
<section id="comments"><p>First!</p></section><footer>&copy; foot</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [
        (i, f"http://h{i % 2}.example/{i}", PAGE.replace("{more}", "<p>more</p>" * (i % 3)))
        for i in range(6)
    ]
    rows += [
        (10, "http://plain.example/", "<p>only</p><p>text</p>"), (11, None, None),
        (12, "odd", ""), (12, "odd", ""), (13, "http://h0.example/cut", PAGE[: PAGE.find("four")]),
        (14, "http://m.example/", "<body><main><p>a</p></main><p>b</p></body>"),
        (15, "http://d.example/", "<div class=sidebar>s</div><div class=content>t <i>u</i>v</div>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    head = "Title & co\nOne two three four\nfive <six> é é &bogus;\na\nb"
    for i in range(6):
        assert got[i].text == "\n".join([head, *["more"] * (i % 3)])
        assert got[i].n_chars == len(got[i].text)
    assert got[10].text == "only\ntext" and got[11].text == got[12].text == ""
    assert got[13].text == "Title & co\nOne two three"
    assert got[14].text == "a" and got[15].text == "t uv"
    assert html_extract.extract(pages.limit(0)).count() == 0
    assert html_extract.extract(pages).count() == len(rows)


def texts_of(spark, *pages):
    rows = [(i, f"http://p{i}.example/", page) for i, page in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return [r.text for r in html_extract.extract(df).orderBy("page_id").collect()]


def test_comments_and_notices_are_no_article(spark):
    thread = '<div id=thread><article class="comment"><p>reader</p></article></div>'
    got = texts_of(
        spark,
        f"<main><p>main</p>{thread}</main>",
        f"<article><p>main</p>{thread}</article>",
        '<article><p>main</p><p class="notice">n</p><p class="comment">c</p><p>more</p></article>',
    )
    assert got == ["main", "main", "main\nmore"]


def test_deep_and_broken_pages_are_read_whole_and_fast(spark):
    import time

    deep = "<div>" * 5000 + "<p>deep</p>" + "</div>" * 5000 + "<p>after</p>"
    quotes = [
        "<p>a</p>" + '<a href="' * 100_000, "<p>a</p>" + '<i ">" ' * 100_000,
        "<p>a</p>" + "<i '\"> \"" * 100_000, "<p>a</p>" + "<div>" * 100_000 + "</p>" * 100_000,
    ]
    begin = time.process_time()
    for page in quotes:
        assert html_extract.parse(page)[1][0][1].startswith("a")
    assert time.process_time() - begin < 30
    got = texts_of(spark, deep, '<p>x <a href="u>y</p><p>z</p>', '<p title="a>b">c</p><b title=\'d>e', "<p>f</p")
    assert got[0] == "deep\nafter" and got[2:] == ["c\ne", "f"]


def test_text_stays_where_a_name_only_holds_a_noise_word(spark):
    body = (
        "<h2 id='related-work'>a</h2><section id='social-impact'><p>b</p></section>"
        "<h2 id='legal-notice-periods'>c</h2><p class='alert'>d</p><p class='byline'>e</p>"
        "<figure><img src=x><figcaption>f</figcaption></figure><div class='meta'>g</div>"
        "<p>h <math><mi>i</mi><mo>=</mo><mn>1</mn></math></p>"
        "<div class='entry-header'>j</div><div class='overflow-hidden'>k</div>"
    )
    noise = (
        "<div class='share-buttons'>x</div><div id='comments-area'>x</div><p class='ad'>x</p>"
        "<div class='site-sidebar'>x</div><section id='comments'>x</section><aside>x</aside>"
    )
    around = (
        "<div class='layout has-sidebar'>{}</div>", "<div id='content-with-comments'>{}</div>",
        "<div class='sidebar'>{}</div>", "<form>{}</form>", "<div>{}</div>",
    )
    rows = [
        (i, f"http://h{i}.example/", x.format(f"<article>{body}{noise}</article>{noise}"))
        for i, x in enumerate(around)
    ]
    rows.append((9, "http://t.example/", "<div>t</div><aside><article>x</article></aside>"))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    text = "a b c d e f g".split() + ["h i=1", "j", "k"]
    assert got == {**dict.fromkeys(range(len(around)), "\n".join(text)), 9: "t"}


def test_text_that_all_pages_of_a_host_repeat_is_left_out(spark):
    page = (
        "<div class='c1'><ul><li>Home</li><li>Contact</li></ul></div><div class='c2'>Get our app</div>"
        "<div class='c3'><h1>Title {0}</h1><p>Text {0}</p><p>Same</p>{1}</div><div class='c4'>Foot</div>"
    )
    more = "<blockquote>Quoted</blockquote>"
    rows = [(i, "http://n.example/", page.format(i, more if i < 3 else "")) for i in range(9)]
    copy = "<div class='c1'>Menu</div><div class='c3'>Text</div>"
    rows += [(i, "http://copies.example/", copy) for i in range(10, 20)]
    rows += [(20 + i, "http://two.example/", page.format(i, "")) for i in range(2)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    for i in range(9):
        quoted = ["Quoted"] if i < 3 else []
        assert got[i].split("\n") == [f"Title {i}", f"Text {i}", "Same", *quoted]
    assert {got[i] for i in range(10, 20)} == {"Menu\nText"}
    assert got[20].startswith("Home\nContact") and got[20].endswith("Foot")


def test_wrapper_of_a_host_does_not_grow_with_its_pages(spark):
    def slug(i):
        return "".join("abcdefghij"[int(d)] for d in f"{i:04}")

    shape = "<div id='ad-{0}'>x</div><article id='post-{0}' class='{0}-story'>{1}</article>"
    page = "<div class='c1' id='{0}'>" + shape + "<div class='c2 {0}-ad'>x</div></div>"
    blocks = ("<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</ul>", "<pre>{}</pre>", "<blockquote>{}</blockquote>")
    rows = []
    for i in range(600):
        text = "".join(blocks[int(d)].format(f"t{i}") for d in np.base_repr(i, 5))
        rows.append((i, "http://h.example/", page.format(slug(i), text)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got == {i: "\n".join([f"t{i}"] * len(np.base_repr(i, 5))) for i in range(600)}
    host = html_extract.host_paths(pages).collect()
    assert len(host) == 1 and sorted(host[0].names) == ["c1", "c2"]
    assert len(host[0].wanted) <= len(blocks)
    few = html_extract.host_paths(pages.filter("page_id < 200")).first()
    assert few.names and sorted(few.wanted) == sorted(host[0].wanted)


def test_wrapper_is_a_union_free_expression():
    def own(page):
        return html_extract.wrapper_of(html_extract.parse(page)[0])

    a = own("<ul><li>x</li><li>y</li></ul><h2>t</h2>")
    b = own("<ul><li>z</li></ul><dl><dt>k<dd>v<dt>k<dd>v</dl>")
    both = html_extract._joined(a, b)
    expected = "<ul>(<li>#</li>)+</ul>(<h2>#</h2>)?(<dl>(<dt>#</dt>)+(<dd>#</dd>)+</dl>)?"
    assert html_extract.pattern(both) == expected


def test_main_text_of_the_articles(spark):
    """On the given pages the text is that of the article element."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["op4_main_text"](spark, SF).collect():
        page = pages[r.page_id]
        assert r.n_chars == len(r.text)
        assert re.sub(r"\W", "", r.text)[:20] in re.sub(r"<[^>]*>|&\w+;|\W", "", page)
        assert "example" not in r.text.split("\n")[-1] and r.text


def test_licenses_match_sql(spark):
    out = QUERIES["op5_license_scan"](spark, SF)
    _, expected = duck_rows(connect(SF), ORACLE["op5_license_scan"])
    assert spark_rows(out) == expected


MARKERS = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "/* SPDX-License-Identifier: GPL-2.0-or-later */\nint x;": "GPL-2.0-or-later",
    "# SPDX-License-Identifier: MIT OR Apache-2.0": "Apache-2.0 + MIT",
    "<!-- SPDX-License-Identifier: (GPL-3.0-or-later AND ISC) -->": "GPL-3.0-or-later + ISC",
    "SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note": "GPL-2.0-only",
    "code\n  * SPDX-License-Identifier:\tBSD-3-Clause\nmore code": "BSD-3-Clause",
    "SPDX-License-Identifier: Nonsense-1.0": "",
    "SPDX-License-Identifier:\nMIT": "",
    "License: MIT": "MIT",
    "license: Apache-2.0\nname: x": "Apache-2.0",
    "[MIT License](LICENSE)": "MIT",
    "Apache License\nVersion 2.0, January 2004\nhttp://x": "Apache-2.0",
    "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "GPL-3.0-only",
    "This work, by A. Author, is released under the MIT License.": "MIT",
    "All of it is hereby a licence to nothing.": "",
}


def test_common_markers_and_their_sql(spark):
    rows = list(enumerate(MARKERS))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = licenses.license_scan(docs)
    assert {r.doc_id: r.licenses for r in found.collect()} == dict(enumerate(MARKERS.values()))
    con = duckdb.connect()
    con.execute("CREATE TABLE marked (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO marked VALUES (?, ?)", rows)
    columns, expected = duck_rows(con, licenses.oracle("marked"))
    assert spark_rows(found.select(*columns)) == expected


def test_license_rules(spark):
    mit = licenses.SENTENCES
    rows = [
        (1, "Text.\nReleased under the MIT License.\nMore text."),
        (2, f"Copyright (c) X\n\n{mit['mit_grant']}:\n\n{mit['mit_notice']}."),
        (3, f"{mit['mit_notice']}. {mit['mit_grant']}:"),
        (4, f"{mit['bsd_grant']}:\n1. {mit['bsd_source']}.\n2. {mit['bsd_binary']}."),
        (5, ". ".join(mit[k] for k in ("bsd_grant", "bsd_source", "bsd_binary", "bsd_names"))),
        (6, "This work is licensed under the GNU General\nPublic License, version 3."),
        (7, "SPDX-License-Identifier: Apache-2.0\nLicensed under CC BY-NC 4.0."),
        (8, "A licence to kill is not a license."),
        (9, "This program is free software: you can redistribute it and/or modify it under the "
            "terms of the GNU General Public License as published by the Free Software "
            "Foundation, either version 2 of the License, or (at your option) any later version."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs).collect()}
    assert got == {
        1: "MIT", 2: "MIT", 3: "", 4: "BSD-2-Clause", 5: "BSD-3-Clause", 6: "GPL-3.0-only",
        7: "Apache-2.0 + CC-BY-NC-4.0", 8: "", 9: "GPL-2.0-or-later",
    }
    con = connect(SF)
    con.register("held", docs.toPandas())
    _, expected = duck_rows(con, licenses.oracle("held"))
    assert spark_rows(licenses.license_scan(docs).drop("matches")) == expected
    assert licenses.license_scan(odd(spark)).count() == len(odd_rows())
    assert licenses.license_scan(empty(spark)).count() == 0


def test_every_lead_with_every_name(spark):
    verbs = ["licensed", "released", "distributed", "available", "published", "provided",
             "made available", "shared"]
    names = {f: v[len("name:"):] for f, v in licenses.known().items() if f.startswith("under ")}
    assert "under gpl v3" in names and "under cc by sa 4 0" in names
    rows = [
        (f"{verb} {form}", lead.format(verb, form), name)
        for form, name in names.items()
        for verb in verbs
        for lead in ("{} {}.", "Text.\nThis work is {} {}.\nText.")
    ]
    docs = spark.createDataFrame(rows, "doc_id string, text string, name string")
    got = licenses.license_scan(docs).select("doc_id", "licenses").collect()
    assert Counter(map(tuple, got)) == Counter((d, name) for d, _, name in rows)


NOTICE = """    This {what} is free software; you can redistribute it and/or modify
    it under the terms of the GNU {kind} as published by
    the Free Software Foundation; either version {v}, or
    (at your option) any later version.

    This {what} is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU {kind} for more details.
"""


def test_gnu_notices_with_a_semicolon(spark):
    def notice(kind, v, what="program"):
        return NOTICE.format(kind=kind, v=v, what=what)

    gpl, lesser = "General Public License", "Lesser General Public\n    License"
    gpl2, lgpl3 = notice(gpl, "2 of the License"), notice(lesser, "3 of the License", "library")
    rows = [
        (1, gpl2), (2, notice(lesser, "2.1 of the License", "library")), (3, notice(gpl, "1")),
        (4, notice("Library " + gpl, "2 of the License", "library")),
        (5, "\n".join(" * " + x.strip() for x in gpl2.split("\n"))),
        (6, gpl2 + "\n\n" + lgpl3), (7, "Either version 2 of the License; see there."),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.licenses for r in licenses.license_scan(docs).collect()}
    assert got == {
        1: "GPL-2.0-or-later", 2: "LGPL-2.1-or-later", 3: "GPL-1.0-or-later",
        4: "LGPL-2.0-or-later", 5: "GPL-2.0-or-later",
        6: "GPL-2.0-or-later + LGPL-3.0-or-later", 7: "",
    }
    con = connect(SF)
    both = docs.filter("doc_id <> 3")  # the SQL does not know the older form
    con.register("held", both.toPandas())
    _, expected = duck_rows(con, licenses.oracle("held"))
    assert spark_rows(licenses.license_scan(both).drop("matches")) == expected


def brute_base(text):
    w = words(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    full = [x for x in (text or "").split("\n") if words(x)]
    n, rep = len(w), len(covered)
    return (
        n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
        len(full) - len(set(full)), rep, n < 20 or 100 * rep > 30 * n,
    )


@pytest.mark.parametrize("which", ["documents", "odd"])
def test_base_rules_match_brute_force(spark, which):
    docs = odd(spark) if which == "odd" else spark.read.parquet(f"{SF}/documents.parquet")
    for r in quality.base_rules(docs).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert (*got, r.base_failed) == brute_base(r.text)


def brute_grams(text, buckets):
    tokens = re.findall(r"[^\W_]+|(?:[^\w\s]|_)+", (text or "").lower())
    signed = lambda b: xxhash.xxh64_intdigest(b, 42)
    h = [signed(t.encode()) for t in tokens]
    twos = [
        xxhash.xxh64_intdigest(b.to_bytes(8, "little"), xxhash.xxh64_intdigest(a.to_bytes(8, "little"), 42))
        for a, b in zip(h, h[1:], strict=False)
    ]
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    return [as_long(x) % buckets for x in (*h, *twos)]


def test_llr_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and r.toxic == 0}
    texts = {r.doc_id: r.text for r in docs.collect()}
    buckets = 512
    grams = {d: brute_grams(t, buckets) for d, t in texts.items()}
    raw = Counter(g for x in grams.values() for g in x)
    target = Counter(g for d, x in grams.items() if d in good for g in x)
    n_raw, n_good = sum(raw.values()) + buckets, sum(target.values()) + buckets
    weight = {
        b: round(1000 * math.log((target[b] + 1) / n_good / ((raw[b] + 1) / n_raw)))
        for b in range(buckets)
    }
    out = quality.quality_rules(docs, labels, buckets=buckets).collect()
    assert len(out) == len(texts)
    for r in out:
        expected = sum(weight[g] for g in grams[r.doc_id]) / len(grams[r.doc_id]) / 1000
        assert r.llr == pytest.approx(expected, abs=2e-3)
        assert r.kept == (not r.base_failed and r.llr >= quality.THRESHOLD)


def test_quality_threshold_on_labels(spark):
    """Of labelled documents that pass the base rules, the threshold keeps all of quality 1
    and rejects nearly all of quality 0."""
    sf = SF.replace("0.001", "0.01")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES["op8_quality_rules"](spark, sf).filter("not base_failed").collect()
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert all(good) and sum(bad) <= 0.1 * len(bad)


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame(
        [(1, 1, 0), (1, 1, 0), (None, 1, 0), (14, 0, 1)], "doc_id long, quality int, toxic int"
    )
    rows = quality.quality_rules(odd(spark), labels).collect()
    assert len(rows) == len(odd_rows())
    assert not any(r.kept for r in rows if not words(r.text))
    assert quality.quality_rules(empty(spark), labels.limit(0)).count() == 0
    assert quality.quality_rules(odd(spark), labels.limit(0)).count() == len(rows)


TEXTS = [
    "", " ", "  a", "a  b", "a b", "a\n b", "a \nb", "one two\nthree  four\t five ", " x y",
    "x  y", "don't you're I'll", "Ünï çödé 123 4-5 !!??", "<|endoftext|> z <|endoftext|>",
    "a b c", "日本 語 text", "\U0001f600 \U0001f600", "\x1c a\x1d b", "a\u0085 b", "　 x",
]


def test_word_cache_gives_the_library_ids(spark):
    encode = Encoder(TOKENIZER, max_cached=50)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rng = random.Random(2)
    texts += ["".join(rng.choices("ab c\n .1' é", k=30)) for _ in range(500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y z", "<|endoftext"]
    whole = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    for start in range(0, len(texts), 100):
        for ids, w in zip(encode.batch(texts[start : start + 100]), whole[start:], strict=False):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids


def test_new_words_go_to_the_library_many_at_a_time():
    encode, texts = Encoder(TOKENIZER), []
    whole = encode.tokenizer

    class Counted:
        def encode_batch_fast(self, batch, **options):
            texts.extend(batch)
            return whole.encode_batch_fast(batch, **options)

    encode.tokenizer = Counted()
    text = " ".join(f"word{n},\n{n}" for n in range(2000))
    ids = encode.batch([text])[0]
    assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids
    assert len(texts) < 10


def test_a_piece_reaches_the_library_once_whatever_stands_beside_it():
    encode = Encoder(TOKENIZER)
    words = ["".join(random.Random(n).choices("abcdefghé", k=9)) for n in range(200)]
    texts = [" ".join(f"{w}{end}" for w in words) for end in ("", ",", ".\nNew", "!  ", "\t", " 12")]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    for ids, w in zip(encode.batch(texts), want, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == w.ids
    # Words by themselves, with the space before them, and the signs and numbers.
    assert len(encode.known) < len(words) + 20


def test_pieces_give_the_library_ids_for_any_character():
    rng, encode = random.Random(5), Encoder(TOKENIZER, max_cached=300)
    signs = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2070), 0x180E, 0x1D7D8, 0x3042]]
    signs += ["'s", "'re", "'LL", " ", " ", "\n", "\r\n", "a", "B", "7", "\U0001f600", "ǅ", "Ⅷ", "²"]
    texts = ["".join(rng.choices(signs, k=12)) for _ in range(4000)]
    texts += ["".join(rng.choices("ab'sl1. \n\t\r", k=12)) for _ in range(4000)]
    want = Tokenizer.from_file(TOKENIZER).encode_batch(texts, add_special_tokens=False)
    for start in range(0, len(texts), 500):
        for ids, w in zip(encode.batch(texts[start : start + 500]), want[start:], strict=False):
            assert np.frombuffer(ids, "<u4").tolist() == w.ids


def test_a_vocabulary_with_another_rule_is_encoded_whole(tmp_path):
    from tokenizers import pre_tokenizers

    other = Tokenizer.from_file(TOKENIZER)
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=True, use_regex=True)
    other.save(str(tmp_path / "other.json"))
    texts = ["one two", "don't, 12", "", None]
    ids = Encoder(str(tmp_path / "other.json")).batch(texts)
    for got, text in zip(ids, texts, strict=True):
        want = other.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(got, "<u4").tolist() == want


def test_a_task_leaves_no_cached_words_behind():
    from inkspark.llm.encode import encoding

    with encoding(TOKENIZER) as encode:
        encode.batch(["one two three"])
        assert encode.known
    assert not encode.known and not encode.older


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        control, data = token_files.pack_ranks(ranks)
        assert (token_files.unpack_ranks(control, data, n) == ranks).all()


def test_a_block_ranks_its_ids_without_sorting_its_tokens(monkeypatch):
    rng = np.random.default_rng(3)
    flat = (rng.integers(0, 50_000, 5000) >> rng.integers(0, 16, 5000)).astype("<u4")
    monkeypatch.setattr(np, "unique", None)
    block = token_files.write_block(2, 3, [7, None, 9], [flat[:10].tobytes(), b"", flat[10:].tobytes()])
    [(part, number, docs, counts, ids)] = token_files.read_blocks(block)
    assert (part, number, docs, counts.tolist()) == (2, 3, [7, None, 9], [10, 0, 4990])
    assert (ids == flat).all()


@pytest.mark.parametrize("block_tokens", [50, token_files.BLOCK_TOKENS])
def test_token_files_round_trip(spark, tmp_path, block_tokens):
    path = str(tmp_path / "tokens")
    token_files.write_tokens(odd(spark), path, TOKENIZER, block_tokens=block_tokens)
    rows = token_files.with_starts(token_files.read_tokens(spark, path)).collect()
    encode = Encoder(TOKENIZER)
    expected = Counter((d, encode.batch([t])[0] + b"\2\0\0\0") for d, t, *_ in odd_rows())
    assert Counter((r.doc_id, bytes(r.ids)) for r in rows) == expected
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id is not None for r in rows] == sorted(r.doc_id is not None for r in rows)
    known = [r.doc_id for r in rows if r.doc_id is not None]
    assert known == sorted(known)
    at = 0
    for r in rows:
        assert (r.start, r.n_tokens) == (at, len(r.ids) // 4)
        at += r.n_tokens
    none = str(tmp_path / "none")
    token_files.write_tokens(empty(spark), none, TOKENIZER)
    assert token_files.read_tokens(spark, none).count() == 0


def test_token_files_of_documents(spark):
    encode, at = Encoder(TOKENIZER), 0
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in QUERIES["op6_token_files"](spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        ids = encode.batch([d.text])[0] + b"\2\0\0\0"
        r = got[d.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids) // 4, zlib.crc32(ids))
        at += r.n_tokens
