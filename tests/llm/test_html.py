from __future__ import annotations

import random

from strandweave.llm import html_text as H

from .helpers import prose

CASES = [
    ("<p>a</p>", "a"),
    (None, ""),
    ("", ""),
    ("plain   text\n\nhere", "plain text here"),
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>m</li></ul></nav><article><h1>T</h1><p>x &amp; y<br>z</p></article><footer>f</footer>", "T\n\nx & y z"),
    ("<article><p>one<p>two<ul><li>a<li>b</ul></article>", "one\n\ntwo\n\na\n\nb"),
    ('<div class="ad">buy<article><p>kept</p></article>', "kept"),
    ("<article><p>x</p><script>var t='</p><p>no';</script><!-- <p>no</p> --><p>y</p></article>", "x\n\ny"),
    ('<article><p>x</p><div class="user comments"><p>no</p></div><aside>no</aside><form><p>no</p></form><p>y</p></article>', "x\n\ny"),
    ("<main><p>a <b>b</b>c <a href='>'>d</a></p></main>tail", "a bc d"),
    ("<p>1 < 2 &lt; 3</p>", "1 < 2 < 3"),
    ("<p>open <b", "open"),
    ("<article><p>cut of", "cut of"),
    ('<article class="post"><header><h1>T</h1></header><p>x</p></article><header>no</header>', "T\n\nx"),
    ('<p hidden>no</p><p>yes</p><div role="navigation">no</div>', "yes"),
]


def test_cases():
    for html, want in CASES:
        assert H.main_texts([html]) == [want], html


def brute(streams, run):
    out = []
    for s in streams:
        flags = [False] * len(s)
        for i in range(len(s) - run + 1):
            if any(o != s and any(o[j : j + run] == s[i : i + run] for j in range(len(o) - run + 1)) for o in streams):
                flags[i : i + run] = [True] * run
        out.append(flags)
    return out


def test_repeats_match_brute_force():
    rng = random.Random(6)
    for run in (1, 3, 5):
        streams = [[rng.choice("ab") for _ in range(rng.randint(0, 14))] for _ in range(6)]
        streams += [streams[0]]
        assert [f.tolist() for f in H.repeated([H.word_hashes(" ".join(x)) for x in streams], run)] == brute(streams, run)


def test_boilerplate_goes_and_unique_runs_and_copies_stay():
    rng = random.Random(2)
    note = prose(rng, 40)
    bodies = [prose(rng, 60) for _ in range(4)]
    got = H.main_texts([f"<div>{note}</div><div>{b}</div>" for b in bodies])
    assert got == bodies
    same = f"<article><p>{bodies[0]}</p></article>"
    assert H.main_texts([same, same, same]) == [bodies[0]] * 3


def test_frame(spark):
    rows = [(i, f"https://h{i % 2}.example/{i}", h) for i, (h, _) in enumerate(CASES)] + [(100, None, "<article>x</article>"), (None, "http://a", "<article>y</article>"), (0, "https://h0.example/0", CASES[0][0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = {(r.page_id, r.url): r for r in H.extract(df, chunk_chars=200).collect()}
    assert H.extract(df).count() == len(rows) and got[100, None].text == "x" and got[None, "http://a"].text == "y"
    for i, (_, want) in enumerate(CASES):
        if "article" in (CASES[i][0] or "") or "main" in (CASES[i][0] or ""):
            assert got[i, rows[i][1]].text == want and got[i, rows[i][1]].n_chars == len(want)
    assert H.extract(df.limit(0)).count() == 0


def test_repeats_between_groups_are_seen(spark):
    rng = random.Random(8)
    notes = [prose(rng, 30) for _ in range(6)]
    pages = [f"<div>{notes[k // 2]}</div><div>{prose(rng, 40)}</div>" for k in range(12)]  # a notice on two pages only
    pages += [pages[0]] * 3 + [f"<article><p>{notes[0]} {notes[1]}</p></article>", f"<p>{notes[5]}</p>", None, ""]
    want = H.main_texts(pages)
    assert all(w and "\n\n" not in w for w in want[:12])
    df = spark.createDataFrame([(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    for size in (1, 1000, 10**6):
        assert [r.text for r in H.extract(df, chunk_chars=size).orderBy("page_id").collect()] == want
    copies = spark.createDataFrame([(i, f"http://two.example/{i}", f"<p>{notes[0]}</p>") for i in range(5)], df.schema)
    assert {r.text for r in H.extract(copies, chunk_chars=1).collect()} == {notes[0]}


def test_articles_that_only_seem_marked_exchange_their_repeats(spark):
    rng = random.Random(12)
    notes = [prose(rng, 30) for _ in range(6)]
    seeming = ("<article></article>", "<article hidden>x</article>", "<script>'<main>'</script>", "<!-- <article> -->")
    pages = [f"{seeming[k % 4]}<div>{notes[k // 2]}</div><div>{prose(rng, 40)}</div>" for k in range(12)]
    want = H.main_texts(pages)
    assert all(w and "\n\n" not in w for w in want)
    df = spark.createDataFrame([(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    for size in (1, 1000):
        assert [r.text for r in H.extract(df, chunk_chars=size).orderBy("page_id").collect()] == want


def test_runs_that_two_streams_share_have_a_fingerprint_in_common():
    rng = random.Random(3)
    prints = lambda text, salt, run: set(H.Streams([[(0, text)]], [salt]).fingerprints(run)[1].tolist())
    for run in (3, 16):
        note = prose(rng, run)
        a, b = (prints(" ".join([prose(rng, i) or "x", note, prose(rng, 25)]), 7, run) for i in (1, 17))
        assert a & b and not a & prints(note, 8, run) and not prints(" ".join(note.split()[1:]), 7, run)


def test_what_marked_articles_share_stays_on_any_number_of_pages(spark):
    rng = random.Random(21)
    notice, bodies = prose(rng, 40), [prose(rng, 60) for _ in range(6)]
    pages = [f"<article><p>{notice}</p><p>{b}</p></article>" for b in bodies]
    want = [f"{notice}\n\n{b}" for b in bodies]
    assert H.main_texts(pages) == want and H.main_texts(pages[:4]) == want[:4]
    df = spark.createDataFrame([(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)], "page_id bigint, url string, html string")
    for size in (1, 1000, 10**6):
        assert [r.text for r in H.extract(df, chunk_chars=size).orderBy("page_id").collect()] == want
    # unique words next to a notice, in its block, stay
    assert H.main_texts([f"<div>{notice} uno{k} dos{k} tres{k}</div><div>{b}</div>" for k, b in enumerate(bodies)]) == [f"uno{k} dos{k} tres{k}\n\n{b}" for k, b in enumerate(bodies)]
    # copies of an article with some words changed stay whole
    near = [f"<article><p>{bodies[0]} {bodies[1]} word{k} {bodies[2]}</p></article>" for k in range(3)]
    assert H.main_texts(near) == [p[12:-14] for p in near]


def test_names_of_what_is_not_the_article():
    for mark in ('id="header"', 'class="header"', 'class="site-header"', 'class="page-header"', 'class="topbar"', 'class="newsletter-signup"', 'class="signup"', 'class="comment-body"', 'class="ad-slot-leaderboard"', 'class="related-posts"', 'class="share-this"', 'class="disclaimer"', 'id="legal"', 'class="gdpr"', 'class="copyright"', 'class="responses"'):
        assert H.main_texts([f"<div {mark}>no</div><p>x</p>"]) == ["x"], mark
        if "header" not in mark:
            assert H.main_texts([f"<article><p>x</p><div {mark}>no</div></article>"]) == ["x"], mark
    for mark in ('class="article-header"', 'class="has-sidebar"', 'class="no-comments"', 'class="content-with-sidebar"', 'class="entry-content"', 'class="lead"'):
        assert H.main_texts([f"<div {mark}>a</div><p>x</p>"]) == ["a\n\nx"], mark
    assert H.main_texts(['<article class="legal"><div class="header"><h1>T</h1></div><p>x</p></article>']) == ["T\n\nx"]


def test_long_broken_pages_are_linear():
    import time

    began = time.perf_counter()
    for part in ("<noscript>", "<svg>", "<template>", "<nav>", "<div class=ad>", "</div>", "<article>", "<b class=ad>", "<script>", "<!--", "<svg></svg", "<p>x", "<nav></b>", "<"):
        H.blocks(part * (1_000_000 // len(part)))
    assert time.perf_counter() - began < 60


def test_nothing_of_an_article_is_lost():
    long = "İ" * 40
    for html, want in (
        (f"<article><p>{long}</p><script>var a = 1;</script><p>kept</p></article>", f"{long}\n\nkept"),
        ("<article><p>one</p><svg><path d='m'><p>two</p></article>", "one\n\ntwo"),
        ("<article><svg><text>no</text></svg><p>two</p></article>", "two"),
        ('<article><p class="lead related">a</p><div class="share-of-market">b</div><p id="notice-period">c</p></article>', "a\n\nb\n\nc"),
        ('<article><p>x</p><div class="related">no</div><div class="share-buttons">no</div><div class="comments thread">no</div><div id="ad-slot">no</div></article>', "x"),
        ("<article><p>x</p><SCRIPT>no</SCRIPT ><p>y</p></article>", "x\n\ny"),
    ):
        assert H.main_texts([html]) == [want], html


def test_repeats_decide_blocks_in_doubt(spark):
    rng = random.Random(31)
    bodies = [prose(rng, 60) for _ in range(6)]
    short, long = "read also this", prose(rng, 30)
    pages = [f'<article><p>{b}</p><div class="lead related">{short}</div><div id="notice-period">{long} day</div><p class="lead related">own {k}</p></article>' for k, b in enumerate(bodies)]
    want = [f"{b}\n\nown {k}" for k, b in enumerate(bodies)]
    assert H.main_texts(pages) == want
    alone = [f'<article><p>{b}</p><div class="lead related">{short}</div></article>' for b in bodies[:1]]
    assert H.main_texts(alone) == [f"{bodies[0]}\n\n{short}"]
    rows = [(i, f"http://one.example/{i}", p) for i, p in enumerate(pages)] + [(100, "http://two.example/", alone[0])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for size in (1, 1500, 10**6):
        for limit in (0, 10**6):  # beyond the limit nothing is broadcast
            got = [r.text for r in H.extract(df, chunk_chars=size, limit=limit).orderBy("page_id").collect()]
            assert got == [*want, f"{bodies[0]}\n\n{short}"]


def test_whole_table_equals_one_array_for_each_host(spark):
    import os

    path = "/root/testdata/sf0.001/pages.parquet"
    if os.path.exists(path):
        df = spark.read.parquet(path)
        hosts = {}
        for r in df.select("*", H.host(df["url"]).alias("host")).collect():
            hosts.setdefault(r.host, []).append(r)
        want = {r.page_id: t for rows in hosts.values() for r, t in zip(rows, H.main_texts([r.html for r in rows]))}
        assert {r.page_id: r.text for r in H.extract(df, chunk_chars=20_000).collect()} == want and all(want.values())
