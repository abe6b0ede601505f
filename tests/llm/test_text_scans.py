from detflow.llm import html as H
from detflow.llm import licences as L
from detflow.llm.common import read
from tests.llm import brute

SF = "/root/testdata/sf0.01"


def test_op4_against_brute_force(spark):
    got = {r["doc_id"]: r for r in L.op4_licences(spark, SF).collect()}
    rows = read(spark, SF, "documents").collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r["doc_id"]]
        assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"], g["base_labels"]) == brute.licences(r["text"])
        assert set(filter(None, g["base_labels"].split(","))) <= set(g["labels"].split(",")) and 0 <= g["score"] <= 1


def test_join_is_exact(spark):
    frequency = {w: i for i, w in enumerate(sorted(L.vocabulary(L.NOTICES)))}
    index = L.NoticeIndex(L.NOTICES, frequency, 0.8)
    texts = [t for _, t in L.NOTICES] + ["licensed under cc by", "the license", "", "under the mit", "x licensed y under z the apache license"]
    for t in texts:
        block = t.encode().split()
        want = sorted((label, len(s & set(block)) / len(s)) for label, n in L.NOTICES
                      if len((s := set(n.encode().split())) & set(block)) >= 0.8 * len(s) - 1e-9)
        assert sorted(index.contained(block)) == want


def test_licence_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "CC-BY cc by\ncc", "a"), (3, "CC-BY cc by\ncc", "a"), (4, "é MIT\tLicense " * 4000, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = L.scan(spark, df).collect()
    assert sorted((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got if r["n_base"]) == sorted(
        (i, *brute.licences(t)) for i, t, _ in rows if brute.licences(t)[1])
    assert len(got) == 5 and L.scan(spark, df.limit(0)).count() == 0


def test_html_rules(spark):
    page = ('<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href="/">Home</a></nav>'
            '<div class="cookie-notice">We use the cookies of the site.</div><article><h1>Head&amp;line</h1><p>One <b>two<br>three\n four</p>'
            '<p>caf&eacute; &lt;x&gt;</p><div class="ad">Buy</div></article><section id="comments"><p>I say</p></section>'
            '<script>var a="</p>";</script><footer>&copy; me</footer></body></html>')
    assert H.main_text(page) == "Head&line One two three four café <x>"
    long = "It was the best of the times and it was the worst of the times in the age of the wise and of the fool. " * 3
    plain = f"<body><ul><li><a href=x>Home page link</a></li></ul><p>Short head</p><p>{long}</p><p>{long}</p><div>Tail</div></body>"
    assert H.main_text(plain) == " ".join(["Short head", long.strip(), long.strip(), "Tail"])
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<script>x") == "" and H.main_text("<") in ("", "<")
    df = spark.createDataFrame([(1, None, page, 2), (1, None, page, 2), (None, "u", None, 3)], "page_id long, url string, html string, text int")
    assert H.extract(df).count() == 3 and H.extract(df.limit(0)).count() == 0


def test_op6_texts(spark):
    got = H.op6_html(spark, SF).collect()
    rows = {r["page_id"]: r for r in read(spark, SF, "pages").collect()}
    assert len(got) == len(rows)
    for r in got:
        html = rows[r["page_id"]]["html"]
        import re
        from html import unescape
        article = html[html.index("<article>") + 9:html.index("</article>")]
        want = " ".join(filter(None, (re.sub(r"\s+", " ", unescape(re.sub("<[^>]*>", "", x))).strip()
                                      for x in re.split(r"</?(?:p|h1|br|div)[^>]*>", article))))
        assert r["text"] == want and r["n_chars"] == len(want)


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following",
    "isc": " * Permission to use, copy, modify, and/or distribute this software for\r\n * any purpose with or without fee is hereby granted, provided",
    "mpl": "# This Source Code Form is subject to the terms of the Mozilla\n# Public License, v. 2.0. If a copy of the MPL was not",
    "lgpl": "you can redistribute it and/or modify\nit under the terms of the GNU\n\nLesser General Public License as published",
}


def test_wrapped_notices(spark):
    texts = [f"some words before\n{t}\nand more after" for t in WRAPPED.values()]
    one = "x\n" + L.NOTICES[8][1] + "\nin source"
    apart = L.NOTICES[8][1][:40] + "\n" + "other words stand here " * 10 + "\n" + L.NOTICES[8][1][40:]
    texts += [one, apart, "", "word"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(spark, df).collect()}
    for i, label in enumerate(WRAPPED):
        blocks = [b for b in got[i]["blocks"] if b["label"] == label]
        assert label in got[i]["labels"].split(",") and got[i]["score"] >= 0.8
        assert [(b["line"], b["last_line"]) for b in blocks] == [(1, 4 if label == "lgpl" else 2)]
    assert [(b["line"], b["last_line"], b["label"]) for b in got[4]["blocks"]] == [(1, 1, "bsd")]
    assert not got[5]["blocks"] and not got[6]["blocks"] and not got[7]["blocks"]


def test_html_layout_names_and_open_elements():
    text = "It was the best of the times and it was the worst of the times in the age of the wise. " * 3
    want = text.strip()
    for name in ("site has-sidebar", "no-sidebar", "content-sidebar-wrap", "header-fixed page", "comments-off", "cookies-accepted"):
        assert H.main_text(f'<body><div class="{name}"><p>{text}</p></div></body>') == want
        assert H.main_text(f'<body><div class="{name}"><article><p>{text}</p></article></div></body>') == want
    assert H.main_text(f'<div class="sidebar"><main><p>{text}</p></main></div>') == want
    for name in ("ad", "sidebar-left", "site-footer", "page-header", "cookie-notice", "main_nav"):
        assert H.main_text(f'<div class="{name}"><p>{text}</p></div><p>{text}</p>') == want
    assert H.main_text(f'<article><p>{text}</p></article><div id="comments"><article><p>I say of the of the</p></article></div>') == want
    for element in ('<svg viewBox="0 0 1 1" />', "<math/>", "<object data=x>", "<iframe src='x'/>", "<canvas>", "<svg><path/>x</svg>"):
        assert H.main_text(f"<article><p>{text}</p>{element}<p>{text}</p></article>") == f"{want} {want}"
    assert H.main_text(f"<article><p class=ad>Buy<p>{text}<p>{text}</article>") == f"{want} {want}"
    assert H.main_text(f"<article><ul><li class=share>Share<li>{text}</ul><p>{text}</article>") == f"{want} {want}"
    assert H.main_text(f"<article><ul><li class=share>Share<ul><li>in it</ul><li>{text}</ul></article>") == want
