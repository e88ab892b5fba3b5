"""Web pages, url rules and conversations against plain versions."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tabscope.llm import chat, html_text, url_filter


def listed(df):
    return [r.asDict() for r in df.collect()]


# ---- main text --------------------------------------------------------------------

CASES = [
    ("<html><body><p>One &amp; two</p><p>three\n  four</p></body></html>", "One & two\n\nthree four"),
    ("<body><nav>menu</nav><article><h1>Title</h1><p><b>a</b>b<br>c<p>d</article><footer>f</footer></body>", "Title\n\nab c\n\nd"),
    ("<header>top</header><div class='side-bar sidebar'>s</div><main><header><h1>H</h1></header><p>x</p></main>", "H\n\nx"),
    ("<article><p>keep<div class=\"ad\">buy</div><p>more<section id='comments'><p>nice</section></article>", "keep\n\nmore"),
    ("<script>var a='<p>no</p>';</script><style>p{}</style><p>yes</p><!-- <p>no</p> --><form><p>no</p></form>", "yes"),
    ("<p>caf&eacute; &#8212; &#x41; &copy 5 &lt;b&gt;", "café — A © 5 <b>"),
    ("<ul><li>one<li>two</ul><table><tr><td>a<td>b<tr><td>c</table>", "one\n\ntwo\n\na\n\nb\n\nc"),
    ("<p hidden>no<p>yes<div role='navigation'>no</div></div></span>", "yes"),
    ("<article>truncated <p>text <b", "truncated\n\ntext <b"),
    ('<p title="a > b">in</p><p title=\'un"closed\'>out</p>', "in\n\nout"),
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<html><head><title>t</title></head></html>", ""),
]


def kept(html, gone=()):
    """What a page keeps of its blocks, those of a template set aside."""
    left = [b for b in html_text.parsed(html)[1] if b[:2] not in gone]
    least = min((b[2] for b in left), default=0)
    left = [b for b in left if b[2] == least]
    inside = [b for b in left if b[3]]
    if inside and 4 * sum(len(b[1]) for b in inside) >= sum(len(b[1]) for b in left):
        left = inside
    return "\n\n".join(b[1] for b in left)


@pytest.mark.parametrize("html,want", CASES)
def test_blocks_of_a_page(html, want):
    assert kept(html) == want


@pytest.mark.parametrize("html,want", [
    ("<article><p>a <span style='display:none'>hid</span>b</p><noscript>enable js</noscript><button>Subscribe</button><p>c<span class='ad'>AD</span> d</p></article>",
     "a b\n\nc d"),
    ("<p>one <label>name</label><select><option>x<option>y</select>two <b>three</b></p>", "one two three"),
    ("<p>a <svg><title>t</title><text>drawn</text></svg>b <video>old browser</video>c <iframe>frame</iframe>d</p>", "a b c d"),
    ("<p>see <object><p>fallback</p></object>", "see"),
    ("<p>x <template><b>no</b></template><span hidden>no <i>no</i></span> y</p><p>z", "x y\n\nz"),
    ("<div class='post'><p>long post text of the page itself</p></div><article class='card'><p>teaser</p></article>", "long post text of the page itself\n\nteaser"),
    ("<article><p>a</p><div class='related-posts'><p>r</p></div><ul class='comment-list'><li>c</ul><div class='share-bar'>s</div><div class='advert-slot'>b</div></article>"
     "<div class='top-nav'>n</div><div id='page-footer'>f</div>", "a"),
])
def test_elements_within_a_line_and_names_of_two_words(html, want):
    assert kept(html) == want


@pytest.mark.parametrize("html,want", [
    ("<div class='content-sidebar-wrap'><article><p>x</p></article></div><p>out</p>", "x"),
    ("<form id='aspnetForm'><div><p>x</p><div class='ad'>buy</div></div></form>", "x"),
    ("<form id='aspnetForm'><nav>menu</nav><main><p>x</p><form><p>search</p></form></main></form><p>out</p>", "x"),
    ("<div class='widget'><article><p>x</p></article></div><p>out</p>", "x"),
    ("<p>x</p><div class='comments'><article><p>nice</p></article></div>", "x"),
    ("<article><p>a</p><section class='comments'><article><p>nice</p></article></section></article>", "a"),
    ("<article><h2 id='related-work'>Related</h2><section id='social-history'><p class='notice'>n</p></section>"
     "<table class='comment-stats'><tr><td>7</table><div class='ad'>buy</div></article>", "Related\n\nn\n\n7"),
])
def test_names_are_whole_and_leave_the_article(html, want):
    assert kept(html) == want


def plain_templates(pages, importance, least):
    """The importance of each block of a site by its definition, from the parsed pages."""
    import math
    from collections import defaultdict
    sites = defaultdict(dict)
    for site, html in pages:
        heading, blocks, styles = html_text.parsed(html)
        own = sites[site].setdefault(heading, (set(), set()))
        own[0].update(b[:2] for b in blocks)
        own[1].update(styles)
    gone = set()
    for site, by_heading in sites.items():
        m = len(by_heading)
        if m < least:
            continue
        for block in {b for own, _ in by_heading.values() for b in own}:
            n = sum(block in own for own, _ in by_heading.values())
            seen = [s for _, styles in by_heading.values() for s in styles if s[0] == block[0]]
            total, spread = len(seen), 0.0
            for s in set(seen):
                p = seen.count(s) / total
                spread -= p * math.log(p, m)
            value = 0.1 * spread + 0.9 * (1 - math.log(n, m))
            if value <= importance:
                gone.add((site, block))
    return gone


def test_site_trees_remove_what_repeats(spark):
    rng = random.Random(1)
    pages = []
    for site in ("a.org", "b.org", "c.org"):
        for i in range(30 if site != "c.org" else 5):
            body = "".join(f"<p>{site} {i} {rng.random()}</p>" for _ in range(rng.randint(1, 5)))
            often = "<p>Follow us on the usual channels</p>" if i % 10 else ""
            pages.append((site, f"<div class='top'>Daily {site}</div><div class='body'><h2>story {rng.random()}</h2>{body}{often}<p>Some own {i % 4}</p></div>"))
    # many copies of one article must not make it a template
    pages += [("a.org", "<div class='body'><h1>Copied</h1><p>the same words</p></div>")] * 200
    rows = [(i, f"https://{site.upper()}/x{i}", html) for i, (site, html) in enumerate(pages)]
    rows += [(9000, None, "<p>no url</p>"), (9001, "https://a.org/", None), (9002, "https://a.org/", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("blocks", F.lit("mine"))
    got = {r["page_id"]: r["text"] for r in listed(html_text.main_text(df))}
    gone = plain_templates([*pages, ("a.org", ""), ("a.org", "")], 0.25, 10)
    assert {b[1] for _, b in gone} == {"Daily a.org", "Daily b.org", "Follow us on the usual channels"}
    for i, (site, html) in enumerate(pages):
        assert got[i] == kept(html, {b for of, b in gone if of == site})
    assert got[len(pages) - 1] == "Copied\n\nthe same words" and (got[9000], got[9001], got[9002]) == ("no url", "", "")
    assert html_text.main_text(df.limit(0)).count() == 0


def test_hand_made_sites_without_article(spark):
    """Pages made of a known text and of what surrounds it, under names that say nothing; the tree alone takes what repeats."""
    rng = random.Random(8)
    words = "river light stone garden winter paper cloud north letter quiet".split()
    rows, want = [], {}
    for i in range(80):
        site = f"site{i % 2}.net"
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 30))) + f" {i}." for _ in range(rng.randint(1, 6))]
        title = f"Heading {rng.random()}"
        boxes = "".join(f"<div class='x7'><a href='/{k}'>{site} part {k}</a></div>" for k in range(6))
        seldom = "<div class='y'>Seldom seen words</div>" if i == 4 else ""
        body = "".join(f"<p>{p.replace(' ', '  ', 1)}<button>like</button></p>" for p in parts)
        rows.append((i, f"http://{site}/p{i}", f"<html><body><div class='q'>The {site} daily</div><div class='r{i}'>{boxes}</div><div class='s'><h1>{title}</h1>{body}</div>{seldom}"
                        f"<div class='t'>All of {site} is ours</div><script>var x{i};</script></body></html>"))
        want[i] = "\n\n".join([title, *parts, *(["Seldom seen words"] if seldom else [])])
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(4)
    assert {r["page_id"]: r["text"] for r in listed(html_text.main_text(df))} == want


# ---- url rules --------------------------------------------------------------------

ALLOW, BLOCK = ["org/", "com/fr/", "deep.a.example.org/es/x"], ["example.org/es/", "example.org/en/1", "com/de/"]


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    end = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fits = []
    for verdict, rules in (("allow", ALLOW), ("block", BLOCK)):
        for rule in rules:
            of_host, _, rest_of = rule.partition("/")
            if (host == of_host or host.endswith("." + of_host)) and path.startswith("/" + rest_of):
                fits.append((len(rule), rule, verdict))
    return (host, path, *max(fits)[1:]) if fits else (host, path, None, "allow")


def test_url_rules(spark):
    rng = random.Random(2)
    hosts = ["example.org", "EXAMPLE.org", "deep.a.example.org", "badexample.org", "x.com", "com", "org", "a.net", "user:p@x.org:80", "", "é.org"]
    paths = ["", "/", "/es/", "/es/x/1", "/es", "/en/1", "/en/12", "/en/2", "/fr/", "/de/a", "/de", "?x=/de/", "#://", "//de/"]
    urls = [f"{rng.choice(['http', 'HTTPS', ''])}://{h}{p}{rng.choice(['', '?q=1', '#f'])}" for h in hosts for p in paths]
    urls += [None, "", "org/es/", "://", "://example.org/es/", "a://b://com/de/", "http://x.com/de/" + "y" * 5000] * 2
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").withColumn("rule", F.lit("mine"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in listed(url_filter.judge(df, ALLOW, BLOCK))}
    assert got == {i: plain_rule(u) for i, u in enumerate(urls)}
    assert url_filter.judge(df.limit(0), ALLOW, BLOCK).count() == 0
    assert {r["verdict"] for r in listed(url_filter.judge(df, [], []))} == {"allow"}


def test_cascades_are_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed_keys = universe.where("key rlike '7$'").unionByName(spark.createDataFrame([("unasked",), (None,), ("k7",)], "key string"))
    found = url_filter.cascade(listed_keys, universe)
    assert len(found.levels) > 1
    assert universe.where(found.holds(F.col("key")) != F.col("key").rlike("7$")).count() == 0
    with pytest.raises(ValueError, match="bits"):
        url_filter.bloom(spark.range(3_000_000).select(F.col("id").cast("string").alias("key")), 1, 2.0 ** -20)


# ---- chat -------------------------------------------------------------------------

@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", r"<\s> <\\s> <s>", r"[\INST] [INST]", "<<s>>", "é\n<s>", "[/INST", r"\\", "<\\"])
def test_escapes_are_reversible(text):
    written = chat.escape(text)
    assert chat.unescape(written) == text
    assert not any(c in written for c in (chat.BEGIN, chat.OPEN, chat.CLOSE, chat.END))


@pytest.fixture(scope="module")
def conversations(spark):
    rng = random.Random(4)
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 30)):
            role = "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2]
            rows.append((c, t, role, " ".join(rng.choice(["so", "</s>", "[INST]", "it", "is"]) for _ in range(rng.randint(0, 40)))))
    rows += [(50, t, ["user", "assistant"][t % 2], "word " * 30) for t in range(900)]  # a long one, over several segments
    rows += [(60, 0, "user", None), (60, 0, None, "tie"), (60, 0, None, "tie"), (60, None, "assistant", "first"), (None, 1, "assistant", "no id"),
             (61, 0, "assistant", "x" * 3000 + " y" * 3000)]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(7)


def test_conversations_read_back(conversations):
    windows = chat.formatted(conversations.withColumn("tokens", F.lit("mine")), budget=300, history=80).cache()
    got = {r["conv"]: r for r in listed(chat.read_back(windows))}
    turns = {}
    for r in listed(conversations):
        turns.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"], r["role"] or "", r["text"] or ""))
    assert len(got) == len(turns)
    for conv, own in turns.items():
        own = [x[2:] for x in sorted(own, key=lambda x: (x[0], x[1] or 0, *x[2:]))]
        r = got["{}" if conv is None else '{"id":%d}' % conv]
        loss = "".join(t for role, t in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == len(loss) and r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    for w in listed(windows):
        turns_in = chat.read_turns(w["formatted"])
        fresh = turns_in[w["n_context"]:]
        assert fresh and (w["n_tokens"] <= 300 or len(fresh) == 1)
        if w["conv"] in ('{"id":0}', '{"id":3}') and w["first_place"] > 0:
            assert turns_in[0][0] == "system"
    long = [w for w in listed(windows) if w["conv"] == '{"id":50}']
    assert len({w["segment"] for w in long}) > 1 and all(w["n_context"] > 0 for w in long if w["first_place"] > 0)
    assert chat.read_back(chat.formatted(conversations.limit(0))).count() == 0


def test_windows_hold_what_the_budget_allows():
    turns = [{"place": i, "role": ["user", "assistant"][i % 2], "text": str(i), "tokens": n, "fresh": True, "system": None}
             for i, n in enumerate([10, 10, 10, 50, 10, 10])]
    made = list(chat.windows_of(iter(turns), budget=40, history=15))
    assert [w["first_place"] for w in made] == [0, 3, 4] and [w["n_context"] for w in made] == [0, 0, 0]
    assert [len(w["loss"]) for w in made] == [1, 1, 1]
